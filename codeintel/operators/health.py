"""Health checks: seven kinds of findings with one schema, ranked together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import dir_name
from ..schemas import Repo
from . import graph

CATEGORIES = ["possible-dead-code", "unused-dependency", "circular-import", "large-file", "missing-tests", "high-complexity", "unresolved-import"]
SEVERITIES = ["high", "medium", "low", "info"]
REFERENCES = ["calls", "references", "instantiates", "extends"]
TOOLCHAIN = r"^(@types/|@babel|eslint|postcss|prettier|tailwindcss|typescript$)"


def _finding(df: DataFrame, category: str, order: list, severity: Column | str, confidence: str, summary: Column, path: Column | None, line: Column | None, detail: Column | str, most: int) -> DataFrame:
    """The best ``most`` rows by ``order`` as findings, with their position."""
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    top = df.orderBy(*order).limit(most)
    return top.select(
        F.lit(category).alias("category"), lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), summary.alias("summary"), (path if path is not None else F.lit(None).cast("string")).alias("rel_path"),
        (line if line is not None else F.lit(None)).cast("int").alias("line"), lit(detail).alias("detail"), F.row_number().over(Window.orderBy(*order)).alias("position"),
    )


def dead_code(r: Repo, most: int = 15) -> DataFrame:
    used = r.edges.where(F.col("kind").isin(REFERENCES)).select(F.col("to_id").alias("symbol_id"))
    generated = r.files.where("is_generated").select("rel_path")
    s = r.symbols.where(F.col("kind").isin("function", "method", "class") & ~F.col("is_exported") & ~F.contains("rel_path", F.lit("test")) & (F.length("name") > 2) & ~F.col("name").startswith("<anonymous"))
    s = s.join(used, "symbol_id", "left_anti").join(generated, "rel_path", "left_anti")
    return _finding(s, "possible-dead-code", [F.desc("complexity"), "symbol_id"], "low", "medium", F.concat("kind", F.lit(" "), "qualified_name", F.lit(" has no resolved references")), F.col("rel_path"), F.col("start_line"), "Nothing in the index refers to it; dynamic dispatch, injection and reflection are not seen.", most)


def unused_dependencies(r: Repo, most: int = 15) -> DataFrame:
    used = r.imports.where("external_package IS NOT NULL").select(F.col("external_package").alias("dependency")).distinct()
    d = r.packages.select("name", "manifest_path", F.explode("dependencies").alias("dependency")).where(~F.col("dependency").rlike(TOOLCHAIN))
    d = d.join(used, "dependency", "left_anti")
    return _finding(d, "unused-dependency", ["name", "dependency"], "low", "medium", F.concat("dependency", F.lit(" is declared by "), "name", F.lit(" but never imported")), F.col("manifest_path"), None, "No import of it was found; plugins and command line tools are used without one.", most)


def circular_imports(r: Repo, most: int = 15, shown: int = 50) -> DataFrame:
    e = r.edges.where("kind = 'imports'").select("from_id", "to_id")
    c = graph.cycles(e).join(r.files.select(F.col("file_id").alias("node"), "rel_path"), "node", "left").withColumn("rel_path", F.coalesce("rel_path", "node"))
    nth = Window.partitionBy("cycle").orderBy("rel_path")
    # only so many names of a cycle are shown, so a row stays small whatever its size
    c = c.withColumn("n", F.row_number().over(nth)).groupBy("cycle").agg(F.count("*").alias("size"), F.min("rel_path").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= shown, F.struct("n", "rel_path")))), lambda x: x["rel_path"]), " → ").alias("names"))
    return _finding(c, "circular-import", [F.desc("size"), "first", "cycle"], "medium", "high", F.concat(F.lit("Import cycle across "), F.col("size").cast("string"), F.lit(" files")), F.col("first"), None, F.col("names"), most)


def large_files(r: Repo, most: int = 15, threshold: int = 200_000) -> DataFrame:
    f = r.files.where((F.col("size_bytes") > threshold) & ~F.col("is_generated"))
    skipped = F.col("skip_reason").isNotNull()
    summary = F.concat("rel_path", F.lit(" is "), F.floor(F.col("size_bytes") / 1024 + 0.5).cast("string"), F.lit(" KB"), F.when(skipped, " and was not indexed").otherwise(""))
    detail = F.when(skipped, F.concat(F.lit("Skipped ("), "skip_reason", F.lit("): what it defines is not seen."))).otherwise("Large files gather unrelated matters.")
    return _finding(f, "large-file", [F.desc("size_bytes"), "rel_path"], F.when(skipped, "medium").otherwise("info"), "high", summary, F.col("rel_path"), None, detail, most)


def prefixes(path: Column) -> Column:
    """A path and all folders above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def untested(r: Repo, most: int = 15, least: int = 5) -> DataFrame:
    """Folders of at least ``least`` symbols, where neither they nor a folder above holds a test."""
    tested = r.files.where("is_test").select(F.explode(prefixes(F.col("rel_path"))).alias("prefix")).distinct()
    dirs = r.symbols.select(dir_name(F.col("rel_path")).alias("dir")).where("dir <> ''").groupBy("dir").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    covered = dirs.select("dir", F.explode(prefixes(F.col("dir"))).alias("prefix")).join(tested, "prefix", "left_semi").select("dir").distinct()
    d = dirs.join(covered, "dir", "left_anti")
    return _finding(d, "missing-tests", [F.desc("n"), "dir"], "medium", "medium", F.concat("dir", F.lit(" defines "), F.col("n").cast("string"), F.lit(" symbols with no test file nearby")), F.col("dir"), None, "No file that is named as a test was found there or above.", most)


def complexity(r: Repo, most: int = 15) -> DataFrame:
    s = r.symbols.where("complexity >= 25")
    return _finding(s, "high-complexity", [F.desc("complexity"), "symbol_id"], F.when(F.col("complexity") >= 50, "high").otherwise("medium"), "high", F.concat("qualified_name", F.lit(" has cyclomatic complexity "), F.col("complexity").cast("string")), F.col("rel_path"), F.col("start_line"), "One and the number of branches; over 25 are hard to test.", most)


def unresolved(r: Repo, most: int = 15) -> DataFrame:
    u = r.imports.where("target_file_id IS NULL AND external_package IS NULL").groupBy("specifier").agg(F.count("*").alias("n"))
    times = F.when(F.col("n") == 1, " occurrence)").otherwise(" occurrences)")
    return _finding(u, "unresolved-import", [F.desc("n"), "specifier"], "info", "high", F.concat(F.lit('"'), "specifier", F.lit('" could not be resolved ('), F.col("n").cast("string"), times), None, None, "Neither a file nor a known package: an alias, or made by a build.", most)


CHECKS = [dead_code, unused_dependencies, circular_imports, large_files, untested, complexity, unresolved]


def findings(r: Repo, most: int = 15, category: str | None = None) -> DataFrame:
    """All findings, the gravest first; within a severity by category and position."""
    wanted = [f(r, most) for f, c in zip(CHECKS, CATEGORIES, strict=True) if category in (None, c)]
    if not wanted:
        return dead_code(r, most).limit(0)
    both = reduce(DataFrame.unionByName, wanted)
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    order = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    return both.orderBy(rank, order, "position")


def totals(r: Repo) -> DataFrame:
    """One row: files, indexed_files, symbols, test_files, external_packages."""
    f = r.files.agg(F.count("*").alias("files"), F.count_if(F.col("skip_reason").isNull()).alias("indexed_files"), F.count_if("is_test").alias("test_files"))
    s = r.symbols.agg(F.count("*").alias("symbols"))
    e = r.imports.agg(F.countDistinct("external_package").alias("external_packages"))
    return f.crossJoin(s).crossJoin(e)  # three single rows
