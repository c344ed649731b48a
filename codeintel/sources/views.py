"""The engine's tables, derived from the driver's: files, chunks, symbols, commits, edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import stable_id


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")))
    return docs.select(
        stable_id("f_", "file", F.col("source"), path).alias("file_id"),
        F.col("source").alias("repo_id"),
        path.alias("rel_path"),
        F.col("lang").alias("language"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.when(F.length("text") == 0, 0).otherwise(F.regexp_count("text", F.lit("\n")) + 1).cast("int").alias("line_count"),
        F.sha2("text", 256).alias("content_hash"),
        (F.col("doc_id") % 7 == 0).alias("is_test"),
    )


def chunks(spark: SparkSession, d: str, size: int = 20, overlap: int = 5) -> DataFrame:
    """Sliding line windows of the documents."""
    stride = size - overlap
    docs = table(spark, d, "documents").select("doc_id", "source", F.split("text", "\n").alias("lines"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("lines") - overlap), F.lit(stride))
    each = docs.select("doc_id", F.col("source").alias("repo_id"), "lines", F.explode(starts).alias("start_line"))
    stop = F.least(F.col("start_line") + size - 1, F.size("lines"))
    return each.select("doc_id", "repo_id", F.concat_ws(":", "doc_id", "start_line").alias("chunk_id"), "start_line", stop.alias("end_line"), F.array_join(F.slice("lines", F.col("start_line"), stop - F.col("start_line") + 1), "\n").alias("text"))


def symbols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("symbol_id"),
        F.col("p_name").alias("name"),
        F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"),
        F.col("p_type").alias("kind"),
        F.col("p_size").alias("complexity"),
        (F.col("p_partkey") % 3 == 0).alias("is_exported"),
        F.concat(F.lit("part/"), (F.col("p_partkey") % 97).cast("string")).alias("rel_path"),
        (F.col("p_partkey") % 50 * 10 + 1).cast("int").alias("start_line"),
        (F.col("p_partkey") % 50 * 10 + 1 + F.col("p_size")).cast("int").alias("end_line"),
    )


def commits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"), (F.col("o_orderstatus") == "P").alias("is_merge"))


def commit_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sha"), F.concat(F.lit("part/"), (F.col("l_partkey") % 97).cast("string")).alias("rel_path")).distinct()


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("event_type").orderBy("ts", "event_id")
    ev = table(spark, d, "events").select("user_id", F.lead("user_id").over(order).alias("to_id"))
    return ev.where("to_id IS NOT NULL").select(F.col("user_id").alias("from_id"), "to_id").distinct()


def ring_edges(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "supplier").count()
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("from_id"), F.explode(F.array(*[F.lit(j) for j in (1, 2, 3)])).alias("j"))
    return s.select("from_id", F.pmod(F.col("from_id") + 7 * F.col("j"), F.lit(n)).alias("to_id"))


def tree_edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_partkey >= 2").select(F.col("p_partkey").alias("from_id"), F.floor(F.col("p_partkey") / 2).cast("long").alias("to_id"))
