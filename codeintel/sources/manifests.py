"""Package manifests and path aliases, from the texts of their files."""

from __future__ import annotations

import json
import posixpath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import base_name, dir_name


def _rows(files: DataFrame, where: Column, ecosystem: str, name: Column, version: Column, deps: Column, dev: Column | None = None) -> DataFrame:
    none = F.array().cast("array<string>")
    out = files.where(where).select("repo_id", name.alias("name"), dir_name(F.col("rel_path")).alias("rel_path"), F.col("rel_path").alias("manifest_path"), F.lit(ecosystem).alias("ecosystem"), version.alias("version"), F.coalesce(deps, none).alias("dependencies"), F.coalesce(dev, none).alias("dev_dependencies") if dev is not None else none.alias("dev_dependencies"))
    return out.where("name IS NOT NULL AND name <> ''")


def _first(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def packages(files: DataFrame) -> DataFrame:
    """The ``packages`` table of files (repo_id, rel_path, text)."""
    base, text = base_name(F.col("rel_path")), F.col("text")
    spec = F.from_json(text, "name string, version string, dependencies map<string,string>, devDependencies map<string,string>")
    npm = _rows(files, (base == "package.json") & ~F.contains("rel_path", F.lit("node_modules/")), "npm", spec["name"], spec["version"], F.map_keys(spec["dependencies"]), F.map_keys(spec["devDependencies"]))
    none = F.lit(None).cast("string")
    go = _rows(files, base == "go.mod", "go", _first(text, r"(?m)^module\s+(\S+)"), none, F.regexp_extract_all(text, F.lit(r"(?m)^\s+(\S+)\s+v\S+"), F.lit(1)))
    cargo = _rows(files, base == "Cargo.toml", "cargo", _first(text, r'(?m)^\s*name\s*=\s*"([^"]+)"'), _first(text, r'(?m)^\s*version\s*=\s*"([^"]+)"'), F.slice(F.regexp_extract_all(text, F.lit(r"(?m)^([a-z0-9_-]+)\s*="), F.lit(1)), 1, 200))
    plain = F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(F.element_at(F.split(s, r"[<>=!~\[\s]"), 1))), lambda s: (s != "") & ~s.startswith("#"))
    written = F.regexp_extract_all(text, F.lit(r"""(?m)^\s*["']?([A-Za-z0-9_.-]+)["']?\s*[>=<~]"""), F.lit(1))
    deps = F.slice(F.array_distinct(F.when(base == "requirements.txt", plain).otherwise(written)), 1, 300)
    folder = F.nullif(base_name(dir_name(F.col("rel_path"))), F.lit(""))
    python = _rows(files, base.isin("pyproject.toml", "setup.py", "requirements.txt"), "python", F.coalesce(_first(text, r"""(?m)^\s*name\s*=\s*["']([^"']+)["']"""), folder, F.lit(".")), none, deps)
    return npm.unionByName(go).unionByName(cargo).unionByName(python)


def go_module(files: DataFrame) -> str | None:
    """The module of the root's go.mod, that specifiers are resolved against."""
    row = files.where("rel_path = 'go.mod'").select(_first(F.col("text"), r"(?m)^module\s+(\S+)").alias("m")).first()
    return row.m if row else None


def path_aliases(files: DataFrame) -> dict[str, list[str]]:
    """Patterns of tsconfig paths and what they stand for; a later file overrides a pattern.

    Comments and trailing commas go before the JSON is read.  At most three rows
    reach the driver.
    """
    names = ["tsconfig.json", "tsconfig.base.json", "jsconfig.json"]
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"/\*[\s\S]*?\*/", ""), r"(?m)(^|[^:])//.*$", "$1"), r",(\s*[}\]])", "$1")
    texts = {r.rel_path: r.t for r in files.where(F.col("rel_path").isin(names)).select("rel_path", clean.alias("t")).collect()}
    out: dict[str, list[str]] = {}
    for name in names:
        try:
            options = json.loads(texts[name])["compilerOptions"]
            base = options["baseUrl"] if isinstance(options.get("baseUrl"), str) else "."
            for pattern, targets in options["paths"].items():
                to = [posixpath.normpath(posixpath.join(base, t)).removeprefix("./") for t in targets if isinstance(t, str)]
                if to:
                    out[pattern] = to
        except (KeyError, TypeError, ValueError, AttributeError):
            continue
    return out
