"""Full-text ranking over stored postings: BM25 with phrases, fusion, structural re-rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import BUILD_OUTPUT, is_search_test_path
from ..functions.text import Query, analyse, name_affinity, search_tokens

BUCKETS = 64


def bucket_of(term: Column) -> Column:
    return F.pmod(F.crc32(F.encode(term, "UTF-8")), F.lit(BUCKETS)).cast("int")


def postings(chunks: DataFrame, key: str, text: str, also: list[str] | None = None) -> DataFrame:
    """(also.., key, term, tf, positions, dl, bucket): the inverted index of texts.

    A chunk's words are grouped in its own row, by sorting (word, place) pairs, so
    nothing is shuffled and no chunk is exploded into words twice.
    """
    also = also or []
    toks = chunks.select(*also, key, search_tokens(F.col(text)).alias("tok"))
    each = toks.select(*also, key, F.size("tok").alias("dl"), F.explode(_grouped(F.col("tok"))).alias("t"))
    return each.select(*also, key, "t.term", F.size("t.positions").alias("tf"), "t.positions", "dl", bucket_of(F.col("t.term")).alias("bucket"))


def _grouped(tok: Column) -> Column:
    """array<struct<term, positions>> of a text's words."""
    pairs = F.array_sort(F.transform(tok, lambda w, i: F.struct(w.alias("term"), i.alias("pos"))))

    def groups(p: Column, first: Column) -> Column:
        until = lambda j: F.coalesce(F.get(first, j + 1), F.size(p))
        return F.transform(first, lambda at, j: F.struct(F.get(p, at)["term"].alias("term"), F.transform(F.slice(p, at + 1, until(j) - at), lambda x: x["pos"]).alias("positions")))

    def firsts(p: Column) -> Column:
        places = F.transform(p, lambda _, i: i)
        return F.filter(places, lambda i: (i == 0) | (F.get(p, i)["term"] != F.get(p, i - 1)["term"]))

    # through arrays of one, so that pairs and firsts are worked out once a text
    one = F.transform(F.array(pairs), lambda p: F.struct(p.alias("p"), firsts(p).alias("first")))
    return F.flatten(F.transform(one, lambda x: groups(x["p"], x["first"])))


def write_index(chunks: DataFrame, key: str, text: str, path: str) -> None:
    """Postings by bucket of the term, sorted by term, and the lengths of all texts: what queries read."""
    p = postings(chunks, key, text)
    # pieces of a bucket, as large as Spark likes them: a piece is sorted in memory, however large the corpus
    p.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/postings")
    chunks.select(key, F.size(search_tokens(F.col(text))).alias("dl")).write.mode("overwrite").parquet(f"{path}/lengths")


class Index:
    """A written index.  N and the mean length are one row, read once."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.key = key
        self.postings = spark.read.parquet(f"{path}/postings")
        r = spark.read.parquet(f"{path}/lengths").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
        self.n, self.avgdl = r.n, r.avgdl or 1.0


def match(posts: DataFrame, key: str, clauses: list[list[str]]) -> DataFrame:
    """(key, clause, tf, dl): how often each clause occurs in each text that has it.

    A clause of several words is a phrase: the words' places, each less its rank,
    are intersected.  Only rows of the query's words are read.
    """
    words = sorted({w for c in clauses for w in c})
    if not words:
        return posts.sparkSession.createDataFrame([], f"{key} {posts.schema[key].dataType.simpleString()}, clause int, tf int, dl int")
    spark = posts.sparkSession
    asked = spark.createDataFrame([(i, w, k, len(c)) for i, c in enumerate(clauses) for k, w in enumerate(c)], "clause int, term string, nth int, n int")
    buckets = sorted({r.b for r in asked.select(bucket_of(F.col("term")).alias("b")).collect()})
    hit = posts.where(F.col("bucket").isin(buckets) & F.col("term").isin(words))
    single = hit.join(F.broadcast(asked.where("n = 1")), "term").select(key, "clause", "tf", "dl")  # the query: some dozens of rows
    if all(len(c) == 1 for c in clauses):
        return single
    each = hit.join(F.broadcast(asked.where("n > 1")), "term").select(key, "clause", "n", "dl", F.transform("positions", lambda p: p - F.col("nth")).alias("at"))
    both = each.groupBy(key, "clause", "n", "dl").agg(F.collect_list("at").alias("sets")).where(F.size("sets") == F.col("n"))
    tf = F.size(F.aggregate("sets", F.element_at("sets", 1), F.array_intersect))
    return single.unionByName(both.select(key, "clause", tf.alias("tf"), "dl").where("tf > 0"))


def bm25(index: Index, clauses: list[list[str]], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of an OR query; higher is better, idf floored at 1e-6.

    The frequency of a clause is counted over its matches, beside the scores: one
    more aggregate of the query's postings, not of the corpus.
    """
    m = match(index.postings, index.key, clauses)
    df = m.groupBy("clause").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    tf = F.col("tf").cast("double")
    part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / index.avgdl))
    return m.join(F.broadcast(df), "clause").groupBy(index.key).agg(F.sum(part).alias("score"))  # df: a row a clause


def like_score(chunks: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """(key, score) without an index: how many of at most eight terms a text contains."""
    low = F.lower(text)
    score = F.lit(0)
    for t in terms[:8]:
        score = score + F.when(F.contains(low, F.lit(t.lower())), 1).otherwise(0)
    return chunks.select(key, score.cast("double").alias("score")).where("score > 0")


def top(ranked: DataFrame, key: str, n: int) -> DataFrame:
    """The best ``n`` with their 0-based rank, ties by key."""
    best = ranked.orderBy(F.round("score", 9).desc(), key).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 9).desc(), key)) - 1)


def fuse(rankings: list[DataFrame], key: str | list[str], k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of rankings with a ``rank`` column."""
    keys = [key] if isinstance(key, str) else key
    all_ = rankings[0].select(*keys, "rank")
    for r in rankings[1:]:
        all_ = all_.unionByName(r.select(*keys, "rank"))
    return all_.groupBy(*keys).agg(F.sum(1.0 / (F.lit(k) + F.col("rank") + 1)).alias("fused"))


def rank_symbols(symbols: DataFrame, query: Query, per_term: int = 25, terms: int = 6) -> DataFrame:
    """symbol columns and rank: the best ``per_term`` symbols of each of the first terms, by affinity of their names.

    A query that looks like a symbol is looked up whole and exactly.
    """
    words = [query.text.strip()] if query.looks_like_symbol else list(query.terms[:terms])
    if not words:
        return symbols.limit(0).withColumn("rank", F.lit(0))
    low = F.translate("name", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    order = [F.desc("is_exported"), F.desc("complexity"), F.col("name"), F.col("symbol_id")]
    found = None
    for i, w in enumerate(words):
        hit = F.col("name") == w if query.looks_like_symbol else F.contains(low, F.lit(w.lower()))
        one = symbols.where(hit).orderBy(*order).limit(per_term).withColumn("term", F.lit(i))
        one = one.withColumn("nth", F.row_number().over(Window.orderBy(*order)))
        found = one if found is None else found.unionByName(one)
    # at most terms * per_term rows from here on
    first = Window.partitionBy("symbol_id").orderBy("term", "nth")
    once = found.withColumn("seen", F.row_number().over(first)).where("seen = 1")
    by = Window.orderBy(F.desc(F.round(name_affinity(F.col("name"), [w.lower() for w in words]), 9)), "term", "nth")
    return once.withColumn("rank", F.row_number().over(by) - 1).drop("seen", "term", "nth")


def rerank(fused: DataFrame, boost: float = 0.35, most_inbound: int = 40) -> DataFrame:
    """Adds ``final`` and ``reasons``.

    Looks at rel_path, symbol_id (null without one), inbound, is_exported and role.
    """
    has, b = F.col("symbol_id").isNotNull(), boost
    inbound = F.when(has, F.least(F.coalesce("inbound", F.lit(0)), F.lit(most_inbound))).otherwise(0)
    exported, role = has & F.coalesce("is_exported", F.lit(False)), F.when(has, F.coalesce("role", F.lit("unknown"))).otherwise(F.lit("unknown"))
    siblings = F.count("*").over(Window.partitionBy("rel_path"))
    x = fused.withColumns({"inbound_": inbound, "siblings": siblings, "test_": is_search_test_path(F.col("rel_path")), "build_": F.col("rel_path").rlike(BUILD_OUTPUT)})
    factor = (
        1
        + F.when(F.col("inbound_") > 0, b * F.least(F.lit(1.0), F.log1p("inbound_") / F.log1p(F.lit(float(most_inbound))))).otherwise(0.0)
        + F.when(exported, 0.3 * b).otherwise(0.0)
        + F.when(role != "unknown", 0.2 * b).otherwise(0.0)
        + F.when(F.col("siblings") > 1, b * F.least(F.lit(0.5), F.col("siblings") / 10)).otherwise(0.0)
    ) * F.when(F.col("test_"), 0.6).otherwise(1.0) * F.when(F.col("build_"), 0.4).otherwise(1.0)
    if boost <= 0:
        factor = F.lit(1.0)
    why = F.array_compact(
        F.array(
            F.lit("text match"),
            F.when(F.col("inbound_") > 0, F.concat(F.col("inbound_").cast("string"), F.when(F.col("inbound_") == 1, " inbound reference").otherwise(" inbound references"))),
            F.when(exported, F.lit("exported")),
            F.when(role != "unknown", role),
            F.when(F.col("siblings") > 1, F.concat(F.col("siblings").cast("string"), F.lit(" matches in this file"))),
            F.when(F.col("test_"), F.lit("test file (demoted)")),
            F.when(F.col("build_"), F.lit("generated or build output (demoted)")),
        )
    )
    return x.withColumns({"final": F.col("fused") * factor, "reasons": why if boost > 0 else F.array(F.lit("text match"))}).drop("inbound_", "siblings", "test_", "build_")


def nearest(vectors: DataFrame, queries: DataFrame, key: str, col: str, k: int = 10, block: int = 2048, piece: int = 512) -> DataFrame:
    """(query_id, key, cosine): the ``k`` nearest of ``vectors`` for each of ``queries``, ties (to six places) by key.

    The queries go in blocks of at most ``block`` on average, and vectors are held
    against them ``piece`` at a time, so what a task holds has a bound.  A task
    keeps ``k`` rows a query; only those are shuffled.
    """
    import math

    import numpy as np
    import pyarrow as pa

    blocks = max(1, math.ceil(queries.count() / block))
    kind = vectors.schema[key].dataType.simpleString()
    out = None
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b) if blocks > 1 else queries
        rows = part.select(key, col).where(F.col(col).isNotNull()).collect()
        ids = [r[0] for r in rows]
        q = np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def run(batches, ids=ids, q=q):
            # of each query: its best so far, and what a vector must reach to be among them
            best = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
            bar = np.full(len(ids), -np.inf)
            for batch in batches:
                for at in range(0, batch.num_rows, piece):
                    part = batch.slice(at, piece)
                    names = part.column(0).to_numpy(zero_copy_only=False)
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(names), -1)
                    if not len(ids):
                        continue
                    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                    cos = q @ x.T
                    near = ~(np.round(cos, 6) < bar[:, None])
                    for i in np.flatnonzero(near.any(axis=1)):
                        c, n = np.concatenate([best[i][0], cos[i, near[i]]]), np.concatenate([best[i][1], names[near[i]]])
                        top_ = np.lexsort((n, -np.round(c, 6)))[:k]
                        best[i] = c[top_], n[top_]
                        if len(top_) == k:
                            bar[i] = np.round(c[top_[-1]], 6)
            out_ = [(ids[i], n, c) for i in range(len(ids)) for c, n in zip(*best[i], strict=True)]
            if out_:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out_, strict=True)], names=["query_id", key, "cosine"])

        got = vectors.select(key, col).where(F.col(col).isNotNull()).mapInArrow(run, f"query_id {kind}, {key} {kind}, cosine double")
        out = got if out is None else out.unionByName(got)
    nth = Window.partitionBy("query_id").orderBy(F.round("cosine", 6).desc(), key)
    return out.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= k).drop("nth")


__all__ = ["Index", "analyse", "bm25", "fuse", "like_score", "match", "nearest", "postings", "rank_symbols", "rerank", "top", "write_index"]
