"""Filters over symbols, edges, imports and commits: the conditions that tools combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import Repo

REFERENCE_KINDS = ["calls", "references", "instantiates", "extends", "implements"]


def ascii_lower(c: Column) -> Column:
    """As case is ignored in matches: A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like_pattern(text: str) -> str:
    r"""``text`` for LIKE ... ESCAPE '\', with its wild cards as themselves."""
    return "".join("\\" + c if c in "\\%_" else c for c in text)


def symbols(s: DataFrame, name: str | None = None, exact: bool = False, kinds: list[str] | None = None, path_prefix: str | None = None, exported: bool | None = None, repo: str | None = None, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Symbols by any of: name (whole, or a part of it in any case), kinds, path, export; exported and complex ones first."""
    if repo is not None:
        s = s.where(F.col("repo_id") == repo)
    if name is not None:
        s = s.where(F.col("name") == name if exact else F.contains(ascii_lower(F.col("name")), ascii_lower(F.lit(name))))
    if kinds:
        s = s.where(F.col("kind").isin(kinds))
    if path_prefix:
        s = s.where(ascii_lower(F.col("rel_path")).startswith(ascii_lower(F.lit(path_prefix))))
    if exported:
        s = s.where("is_exported")
    s = s.orderBy(F.desc("is_exported"), F.desc("complexity"), "name", "symbol_id")
    return s if limit is None else s.offset(offset).limit(limit)


def edges(e: DataFrame, kinds: list[str] | None = None, from_id: str | None = None, to_id: str | None = None, exact_only: bool = False, repo: str | None = None, limit: int | None = 500) -> DataFrame:
    """Edges by any of: kinds, ends, confidence; in the order of their ids."""
    for col, v in (("repo_id", repo), ("from_id", from_id), ("to_id", to_id)):
        if v is not None:
            e = e.where(F.col(col) == v)
    if kinds:
        e = e.where(F.col("kind").isin(kinds))
    if exact_only:
        e = e.where("confidence = 'exact'")
    return e if limit is None else e.orderBy("edge_id").limit(limit)


def ends(e: DataFrame, r: Repo, side: str) -> DataFrame:
    """``e`` with peer and peer_path of its ``from`` or ``to`` end: a symbol, or a file."""
    s = r.symbols.select(F.col("symbol_id").alias(f"{side}_id"), F.col("qualified_name").alias("s_name"), F.col("rel_path").alias("s_path"), F.col("start_line").alias("s_line"))
    f = r.files.select(F.col("file_id").alias(f"{side}_id"), F.col("rel_path").alias("f_path"))
    x = e.join(s, f"{side}_id", "left").join(f, f"{side}_id", "left")
    return x.select(*e.columns, F.coalesce("s_name", "f_path", f"{side}_id").alias("peer"), F.coalesce("s_path", "f_path").alias("peer_path"), F.col("s_line").alias("peer_line"))


def references(r: Repo, targets: DataFrame, exact_only: bool = False, limit: int = 100) -> DataFrame:
    """(target, kind, caller, location, confidence): who refers to each of ``targets``, at most ``limit`` each."""
    from pyspark.sql import Window

    e = edges(r.edges, REFERENCE_KINDS, exact_only=exact_only, limit=None).join(targets.select(F.col("symbol_id").alias("to_id"), F.col("qualified_name").alias("target")), "to_id")
    nth = Window.partitionBy("to_id").orderBy("edge_id")
    e = e.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= limit).drop("nth")
    at = r.files.select("file_id", F.col("rel_path").alias("at_path"))
    x = ends(e, r, "from").join(at, "file_id", "left")
    return x.select("target", "kind", F.col("peer").alias("caller"), F.concat(F.coalesce("at_path", F.lit("?")), F.lit(":"), F.col("line").cast("string")).alias("location"), "confidence")


def unresolved_imports(i: DataFrame) -> DataFrame:
    return i.where("target_file_id IS NULL AND external_package IS NULL")


def package_usage(i: DataFrame) -> DataFrame:
    """(external_package, n_files), the most used first."""
    return i.where("external_package IS NOT NULL").groupBy("external_package").agg(F.countDistinct("file_id").alias("n_files")).orderBy(F.desc("n_files"), "external_package")


def churn(commit_files: DataFrame, commits: DataFrame, since_ms: int | None = None) -> DataFrame:
    """(rel_path, churn): commits that touch each file; one counts once, however often it was read."""
    cf = commit_files.select("repo_id", "sha", "rel_path").distinct()
    if since_ms is not None:
        cf = cf.join(commits.where(F.col("timestamp_ms") >= since_ms).select("repo_id", "sha"), ["repo_id", "sha"], "left_semi")
    return cf.groupBy("rel_path").agg(F.count("*").alias("churn"))


def hotspots(r: Repo, most: int | None = 15, since_ms: int | None = None) -> DataFrame:
    """(rel_path, churn, complexity, score, top_symbol): changed often, and complex."""
    order = F.struct(-F.col("complexity"), F.when(F.col("is_exported"), 0).otherwise(1), "name", "symbol_id")
    cx = r.symbols.groupBy("rel_path").agg(F.sum("complexity").alias("complexity"), F.min_by("qualified_name", order).alias("top_symbol")).where("complexity > 0")
    x = churn(r.commit_files, r.commits, since_ms).join(cx, "rel_path").select("rel_path", "churn", "complexity", (F.col("churn") * F.col("complexity")).alias("score"), "top_symbol")
    x = x.orderBy(F.desc("score"), "rel_path")
    return x if most is None else x.limit(most)


def contributors(commits: DataFrame) -> DataFrame:
    """(author_email, author_name, commits): by address; the name is that of the latest commit."""
    return commits.groupBy("author_email").agg(F.max_by("author_name", F.struct("timestamp_ms", "sha")).alias("author_name"), F.count("*").alias("commits")).orderBy(F.desc("commits"), "author_email")


def frameworks(i: DataFrame, files: DataFrame) -> DataFrame:
    """(id, label, category, evidence): at most four signs of each framework, packages before files."""
    from ..functions.roles import FRAMEWORKS

    spark = i.sparkSession
    nth = {k: n for n, k in enumerate(FRAMEWORKS)}
    pk = spark.createDataFrame([(k, n, p) for k, (_, _, ps, _) in FRAMEWORKS.items() for n, p in enumerate(ps)], "id string, place int, external_package string")
    used = package_usage(i).join(F.broadcast(pk), "external_package")  # some sixty rows
    one = used.select("id", "place", F.concat(F.lit("imported by "), F.col("n_files").cast("string"), F.when(F.col("n_files") == 1, " file: ").otherwise(" files: "), "external_package").alias("sign"))
    # each path pattern is one conditional minimum: no pattern is joined to paths
    pats = [(k, n, p) for k, (_, _, _, ps) in FRAMEWORKS.items() for n, p in enumerate(ps)]
    row = files.agg(*[F.min(F.when(F.col("rel_path").rlike(p), F.col("rel_path"))).alias(f"p{m}") for m, (_, _, p) in enumerate(pats)])
    found = row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("id"), F.lit(100 + n).alias("place"), F.col(f"p{m}").alias("sign")) for m, (k, n, _) in enumerate(pats)])).alias("x")).select("x.*").where("sign IS NOT NULL")
    names = spark.createDataFrame([(k, label, cat, nth[k]) for k, (label, cat, _, _) in FRAMEWORKS.items()], "id string, label string, category string, nth int")
    all_ = one.unionByName(found).groupBy("id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("place", "sign"))), lambda x: x["sign"]), 1, 4).alias("evidence"))
    return all_.join(F.broadcast(names), "id").orderBy("nth").select("id", "label", "category", "evidence")


def within_budget(df: DataFrame, block: str, order: list, max_bytes: int = 48_000, reserve: int = 512) -> DataFrame:
    """The rows whose blocks, in order, fit in ``max_bytes - reserve`` bytes together; it ends at the first that doesn't.

    A range partitioning orders the rows; each partition's bytes are summed apart,
    and an offset a partition, a few numbers, is joined to it.  No task sees all rows.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    from ..shared import cut

    x = cut(df.withColumn("_bytes", F.coalesce(F.octet_length(block).cast("long"), F.lit(0))).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sums = x.groupBy("_part").agg(F.sum("_bytes").alias("b"))
    before = sums.select(F.col("_part"), (F.sum("b").over(Window.orderBy("_part")) - F.col("b")).alias("_before"))  # one row a partition
    run = F.sum("_bytes").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    near = x.join(F.broadcast(before), "_part").where(F.col("_before") <= max_bytes - reserve)
    return near.withColumn("used", F.col("_before") + run).where(F.col("used") <= max_bytes - reserve).drop("_bytes", "_part", "_before")
