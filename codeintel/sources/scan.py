"""Repository scan: the files of a folder, filtered in a set order, classified and read.

The walk lists names on the driver, at most ``max_files`` of them; the contents are
read, hashed and searched for zero bytes by tasks.
"""

from __future__ import annotations

import hashlib
import os
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import paths as P
from .globs import Globs, Ignore

SCANNED = "rel_path string, abs_path string, size_bytes bigint, mtime_ms bigint, language string, is_binary boolean, skip_reason string"
COUNTERS = "seen accepted directories gitignored excluded denied binary too_large symlinks".split()


def walk(root: str, config: dict) -> tuple[list[tuple], dict]:
    """((rel_path, abs_path, size, mtime_ms) of admitted files, counters).

    A folder's files come before its sub-folders; excluded and ignored folders are
    not entered, nor is one twice; unreadable ones are passed over.
    """
    w = config["workspace"]
    root = os.path.realpath(root)
    deny, exclude, include = Globs(config["security"]["deny"]), Globs(w["exclude"]), Globs(w["include"])
    n, out, seen = Counter(dict.fromkeys(COUNTERS, 0)), [], {root}
    hit_limit = False

    def ignored(stack: list[tuple[str, Ignore]], rel: str, is_dir: bool) -> bool:
        return any(i.ignores(rel[len(base) + 1 if base else 0 :], is_dir) for base, i in stack)

    def consider(path: str, rel: str, stack: list) -> None:
        nonlocal hit_limit
        n["seen"] += 1
        if len(out) >= w["max_files"]:
            hit_limit = True
        elif deny.match(rel):
            n["denied"] += 1
        elif exclude.match(rel) or (w["include"] and not include.match(rel)):
            n["excluded"] += 1
        elif ignored(stack, rel, False):
            n["gitignored"] += 1
        else:
            try:
                s = os.lstat(path)
            except OSError:
                return
            out.append((rel, path, s.st_size, int(s.st_mtime * 1000)))

    todo: list[tuple[str, str, list]] = [(root, "", [])]
    while todo and not hit_limit:
        folder, base, stack = todo.pop()
        if w["respect_gitignore"]:
            try:
                stack = [*stack, (base, Ignore(Path(folder, ".gitignore").read_text("utf-8", "replace")))]
            except OSError:
                pass
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            continue
        n["directories"] += 1
        below = []
        for e in entries:
            rel = f"{base}/{e.name}" if base else e.name
            if e.is_symlink():
                to = os.path.realpath(e.path)
                if not w["follow_symlinks"] or not os.path.exists(to) or not P.is_within(root, to):
                    n["symlinks"] += 1
                elif os.path.isdir(to):
                    below.append((to, rel))
                else:
                    consider(to, rel, stack)
            elif e.is_dir():
                if exclude.match(rel + "/") or exclude.match(rel):
                    n["excluded"] += 1
                elif ignored(stack, rel, True):
                    n["gitignored"] += 1
                else:
                    below.append((e.path, rel))
            elif e.is_file():
                consider(e.path, rel, stack)
        for path, rel in reversed(below):
            real = os.path.realpath(path)
            if real not in seen:
                seen.add(real)
                todo.append((path, rel, stack))
    return out, {**n, "hit_file_limit": hit_limit}


def scan(spark: SparkSession, root: str, config: dict) -> tuple[DataFrame, dict]:
    """(one row of ``SCANNED`` a file, counters).  Skipped files stay, with the reason."""
    rows, n = walk(root, config)
    df = classify(spark.createDataFrame(rows, "rel_path string, abs_path string, size_bytes bigint, mtime_ms bigint"), config)
    got = df.agg(F.count_if(F.expr("skip_reason IS NULL")).alias("accepted"), F.count_if("is_binary").alias("binary"), F.count_if(F.col("skip_reason").startswith("larger")).alias("too_large")).first()
    return df, n | got.asDict()


def classify(files: DataFrame, config: dict) -> DataFrame:
    """Adds language, is_binary and skip_reason; a skipped file has no language."""
    most = config["workspace"]["max_file_bytes"]
    path, lang = F.col("rel_path"), P.language_of(F.col("rel_path"), config["languages"]["extension_overrides"])
    enabled = lang.isin(config["languages"]["enabled"])
    reason = (
        F.when(P.is_binary_extension(path), F.lit("binary"))
        .when(F.col("size_bytes") > most, F.lit(f"larger than {most} bytes"))
        .when(lang.isNull(), F.lit("unrecognised file type"))
        .when(~enabled, F.concat(F.lit("language "), lang, F.lit(" is not enabled")))
    )
    out = files.withColumns({"is_binary": P.is_binary_extension(path), "skip_reason": reason})
    return out.withColumn("language", F.when(F.col("skip_reason").isNull(), lang)).select("rel_path", "abs_path", "size_bytes", "mtime_ms", "language", "is_binary", "skip_reason")


def read(scanned: DataFrame, tasks: int = 64) -> DataFrame:
    """``scanned`` with content_hash and text; a file with a zero byte early on is binary.

    Files that are skipped have the hash ''.  Files that vanish meanwhile drop out.
    """
    schema = SCANNED + ", content_hash string, text string"
    target = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                row |= {"content_hash": "", "text": None}
                if row["skip_reason"] is None:
                    try:
                        raw = Path(row["abs_path"]).read_bytes()
                    except OSError:
                        continue
                    if b"\0" in raw[:8192]:
                        row |= {"is_binary": True, "skip_reason": "binary", "language": None}
                    else:
                        row |= {"content_hash": hashlib.sha256(raw).hexdigest(), "text": raw.decode("utf-8", "replace")}
                cols = {k: [row[k]] for k in row}
                yield pa.RecordBatch.from_pydict(cols, schema=target)

    return scanned.repartition(tasks, "rel_path").mapInArrow(run, schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def file_table(read_files: DataFrame, root: str) -> DataFrame:
    """The ``files`` table of what ``read`` gives."""
    repo = ids.repo_id(F.lit(root))
    return read_files.select(
        ids.file_id(repo, F.col("rel_path")).alias("file_id"),
        repo.alias("repo_id"),
        "rel_path",
        "language",
        "size_bytes",
        F.coalesce(P.count_lines(F.col("text")), F.lit(0)).alias("line_count"),
        "content_hash",
        "mtime_ms",
        F.lit(None).cast("string").alias("package_name"),
        "is_binary",
        P.is_generated_path(F.col("rel_path")).alias("is_generated"),
        P.is_test_path(F.col("rel_path")).alias("is_test"),
        "skip_reason",
    )


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(rel_path, state): unchanged, changed, added or removed, by content hash."""
    o, n = old.select("rel_path", F.col("content_hash").alias("was")), new.select("rel_path", F.col("content_hash").alias("now"))
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "unchanged").otherwise("changed")
    return o.join(n, "rel_path", "full").select("rel_path", state.alias("state"))
