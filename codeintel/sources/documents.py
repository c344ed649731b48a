"""Documentation files: title, headings, lead; API descriptions: their operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import any_of, base_name
from ..functions.redact import redact
from .globs import glob_regex

METHODS = ["delete", "get", "head", "options", "patch", "post", "put"]


def doc_kind(path: Column) -> Column:
    name = F.lower(base_name(path))
    return (
        F.when(name.startswith("readme"), F.lit("readme"))
        .when(name.startswith("changelog"), F.lit("changelog"))
        .when(path.rlike(r"(?i)(^|/)(adr|decisions?)/") | name.rlike(r"^adr-\d+"), F.lit("adr"))
        .when(path.rlike(r"(?i)(^|/)docs?/"), F.lit("guide"))
        .otherwise(F.lit("other"))
    )


def outside_fences(text: Column) -> Column:
    """The lines of a text that aren't in fenced code, nor its fences."""
    zero = F.struct(F.lit(False).alias("in"), F.array().cast("array<string>").alias("lines"))

    def step(s: Column, line: Column) -> Column:
        fence = line.rlike(r"^\s*```")
        return F.struct(F.when(fence, ~s["in"]).otherwise(s["in"]).alias("in"), F.when(fence | s["in"], s["lines"]).otherwise(F.concat(s["lines"], F.array(line))).alias("lines"))

    return F.aggregate(F.split(text, "\n"), zero, step, lambda s: s["lines"])


def headings(lines: Column) -> Column:
    """array<struct<level, text>> of at most 80 headings of up to four marks."""
    pattern = r"^(#{1,4})\s+(.+?)\s*#*$"
    found = F.filter(lines, lambda s: s.rlike(pattern))
    return F.slice(F.transform(found, lambda s: F.struct(F.length(F.regexp_extract(s, pattern, 1)).alias("level"), F.trim(F.regexp_extract(s, pattern, 2)).alias("text"))), 1, 80)


def lead(lines: Column) -> Column:
    """The first paragraph that is neither heading, badge nor rule: at most 500 characters."""
    zero = F.struct(F.lit("").alias("text"), F.lit(False).alias("done"))

    def step(s: Column, raw: Column) -> Column:
        line = F.trim(raw)
        skip = line.rlike(r"^(#|\[!\[|<img|---)")
        text = F.when(s["done"] | skip | (line == ""), s["text"]).otherwise(F.when(s["text"] == "", line).otherwise(F.concat(s["text"], F.lit(" "), line)))
        return F.struct(text.alias("text"), (s["done"] | ((line == "") & (s["text"] != "")) | (F.length(text) > 400)).alias("done"))

    return F.left(F.aggregate(lines, zero, step, lambda s: s["text"]), F.lit(500))


def markdown(files: DataFrame) -> DataFrame:
    """The ``documents`` rows of Markdown files (repo_id, file_id, rel_path, text)."""
    x = files.withColumn("lines", outside_fences(F.col("text"))).withColumn("h", headings(F.col("lines")))
    first = F.try_element_at(F.filter("h", lambda s: s["level"] == 1), F.lit(1))["text"]
    title = F.coalesce(first, F.regexp_replace(base_name(F.col("rel_path")), r"\.[^.]+$", ""))
    return x.select("repo_id", "file_id", "rel_path", doc_kind(F.col("rel_path")).alias("kind"), redact(title).alias("title"), F.transform("h", lambda s: redact(s["text"])).alias("headings"), redact(lead(F.col("lines"))).alias("summary"))


def openapi(files: DataFrame) -> DataFrame:
    """The ``documents`` rows of OpenAPI files in JSON; in YAML, of their paths' plain layout."""
    is_json = F.col("rel_path").endswith(".json")
    spec = F.from_json("text", "openapi string, swagger string, info struct<title:string,description:string>, paths map<string,map<string,string>>")
    ops = F.flatten(F.transform(F.map_entries(spec["paths"]), lambda e: F.transform(F.filter(F.map_keys(e["value"]), lambda m: m.isin(METHODS)), lambda m: F.concat_ws(" ", F.upper(m), e["key"]))))
    # YAML: a route is a key that starts with a slash, a method a key below it
    zero = F.struct(F.lit("").alias("route"), F.array().cast("array<string>").alias("ops"))
    key = r"^\s+[\"']?(/[^\"':]*)[\"']?\s*:\s*$"
    verb = rf"^\s+({'|'.join(METHODS)})\s*:\s*$"

    def step(s: Column, line: Column) -> Column:
        route = F.when(line.rlike(key), F.regexp_extract(line, key, 1)).otherwise(s["route"])
        hit = line.rlike(verb) & (route != "")
        return F.struct(route.alias("route"), F.when(hit, F.concat(s["ops"], F.array(F.concat_ws(" ", F.upper(F.regexp_extract(line, verb, 1)), route)))).otherwise(s["ops"]).alias("ops"))

    yaml_ops = F.aggregate(F.split("text", "\n"), zero, step, lambda s: s["ops"])

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract("text", rf"(?m)^\s+{name}:\s*[\"']?([^\"'\n]+)", 1), F.lit(""))

    x = files.select(
        "repo_id", "file_id", "rel_path",
        F.when(is_json, spec["openapi"].isNotNull() | spec["swagger"].isNotNull()).otherwise(F.col("text").rlike(r"(?m)^(openapi|swagger)\s*:")).alias("is_api"),
        F.slice(F.coalesce(F.when(is_json, ops).otherwise(yaml_ops), F.array().cast("array<string>")), 1, 300).alias("headings"),
        F.when(is_json, spec["info"]["title"]).otherwise(field("title")).alias("t"),
        F.when(is_json, spec["info"]["description"]).otherwise(field("description")).alias("d"),
    ).where("is_api")
    summary = F.coalesce(F.nullif(F.left("d", F.lit(400)), F.lit("")), F.concat(F.size("headings").cast("string"), F.lit(" documented operations.")))
    return x.select("repo_id", "file_id", "rel_path", F.lit("openapi").alias("kind"), redact(F.coalesce("t", F.lit("API specification"))).alias("title"), "headings", redact(summary).alias("summary"))


def documents(files: DataFrame, config: dict) -> DataFrame:
    """All documents: an API description is one even where it also fits a documentation glob."""
    d = config["documentation"]
    api, doc = any_of(F.col("rel_path"), [glob_regex(g) for g in d["openapi"]]), any_of(F.col("rel_path"), [glob_regex(g) for g in d["include"]])
    some = files.where("text IS NOT NULL")
    return openapi(some.where(api)).unionByName(markdown(some.where(~api & doc)))
