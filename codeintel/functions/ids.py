"""Content-free stable ids: a prefix and 22 characters of a digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = {"repository": "r_", "file": "f_", "symbol": "s_", "edge": "e_", "chunk": "c_", "commit": "g_"}


def stable_id(prefix: str, kind: str, *parts: Column) -> Column:
    """``prefix`` + 22 characters of the URL-safe SHA-1 of the parts; null parts count as empty."""
    joined = F.concat_ws("\0", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.translate(F.base64(F.unhex(F.sha1(joined))), "+/", "-_"), 1, 22))


def make(kind: str, *parts: Column) -> Column:
    return stable_id(PREFIX[kind], kind, *parts)


def repo_id(root: Column) -> Column:
    return make("repository", root)


def file_id(repo: Column, path: Column) -> Column:
    return make("file", repo, path)


def symbol_id(repo: Column, path: Column, kind: Column, qualified: Column, ordinal: Column) -> Column:
    """Has no line in it: edits that move a symbol leave its id."""
    return make("symbol", repo, path, kind, qualified, ordinal)


def edge_id(kind: Column, source: Column, target: Column) -> Column:
    return make("edge", kind, source, target)


def chunk_id(file: Column, start: Column, end: Column) -> Column:
    return make("chunk", file, start, end)


def commit_id(repo: Column, sha: Column) -> Column:
    return make("commit", repo, sha)


def tree_hash(files: DataFrame, group: str, order: str, digest: str, buckets: int = 4096) -> DataFrame:
    """(group, tree_hash): a digest of a group's digests that doesn't depend on partitioning.

    Two levels: the digests of each of ``buckets`` hash buckets in order of path,
    then the buckets in order.  No row ever holds more than a bucket, and a change
    of one file changes the result.  (A flat digest would put a whole repository
    into one row.)
    """
    key = F.conv(F.substring(F.sha2(F.col(order), 256), 1, 8), 16, 10).cast("long") % buckets
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(digest).alias("h"))))
    part = files.groupBy(group, key.alias("b")).agg(F.sha2(F.array_join(F.transform(pairs, lambda x: x["h"]), ""), 256).alias("h"))
    whole = F.array_sort(F.collect_list(F.struct("b", "h")))
    return part.groupBy(group).agg(F.sha2(F.array_join(F.transform(whole, lambda x: F.concat_ws(":", x["b"].cast("string"), x["h"])), ","), 256).alias("tree_hash"))
