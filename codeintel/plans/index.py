"""Indexing a folder: scan, read, extract, resolve, store; whole or only what changed."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import resolve
from ..schemas import PARSED
from ..sources import documents, extract, git, manifests, scan
from ..sources.store import Store


def flat(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(symbols, references, imports, ranges) of extractor rows, with their order."""
    def each(column: str) -> DataFrame:
        return parsed.select("rel_path", F.posexplode(column).alias("ord", "x")).select("rel_path", "ord", "x.*")

    ranges = parsed.select("rel_path", "chunk_texts", F.explode("ranges").alias("x")).select("rel_path", "x.*", F.try_element_at("chunk_texts", F.concat_ws(":", F.col("x.start_line").cast("string"), F.col("x.end_line").cast("string"))).alias("text"))
    return each("symbols"), each("refs"), each("imports"), ranges.where("text IS NOT NULL")


def index(spark: SparkSession, store: Store, root: str, config: dict, force: bool = False) -> dict:
    """Brings the store's tables of ``root`` up to date; returns the report.

    Only changed files, and those that import a changed or removed one, are parsed
    again; their references are resolved against all symbols, so an incremental run
    and a full one give the same tables.
    """
    began = time.time()
    repo = spark.range(1).select(ids.repo_id(F.lit(root)).alias("i")).first().i
    known = None if force else store.metadata(repo)
    scanned, counts = scan.scan(spark, root, config)
    staged = f"{store.path}/_texts/{uuid.uuid4().hex}"
    scan.read(scanned).write.parquet(staged)
    texts = spark.read.parquet(staged).withColumn("repo_id", F.lit(repo)).withColumn("file_id", ids.file_id(F.lit(repo), F.col("rel_path")))
    files = scan.file_table(texts, root).withColumn("repo_id", F.lit(repo)).withColumn("file_id", ids.file_id(F.lit(repo), F.col("rel_path")))
    old = store.read("files", repo)
    state = scan.diff(old if known else old.limit(0), files)
    todo = state.where("state IN ('changed', 'added')").select("rel_path")
    removed = state.where("state = 'removed'").select(ids.file_id(F.lit(repo), F.col("rel_path")).alias("file_id"))
    n_changed, n_removed = todo.count(), removed.count()
    if known and not n_changed and not n_removed:
        return {"repo_id": repo, "mode": "incremental", "files_changed": 0, "files_removed": 0, "symbol_count": known["symbol_count"], "elapsed_ms": int((time.time() - began) * 1000), **counts}
    if known:  # one hop: who imports what changed; and who imports nothing known, as an added file may be it
        moved = todo.select(ids.file_id(F.lit(repo), F.col("rel_path")).alias("file_id")).unionByName(removed)
        cone = store.read("imports", repo).join(F.broadcast(moved.withColumnRenamed("file_id", "target_file_id")) if n_changed + n_removed < 100_000 else moved.withColumnRenamed("file_id", "target_file_id"), "target_file_id", "left_semi").select("file_id")
        open_ = store.read("imports", repo).where("target_file_id IS NULL").select("file_id")
        again = files.join(cone.unionByName(open_).distinct(), "file_id", "left_semi").select("rel_path")
        todo = todo.unionByName(again).distinct()
    parsed_now = extract.extract(texts.join(todo, "rel_path", "left_semi"))
    before = store._state["tables"].get("_parsed", {}).get(repo)
    if known and before:
        kept = spark.read.schema(PARSED).parquet(f"{store.path}/{before}").join(files.select("rel_path"), "rel_path", "left_semi").join(todo, "rel_path", "left_anti")
        parsed_now = parsed_now.unionByName(kept)
    fresh = f"_parsed/{uuid.uuid4().hex}"
    parsed_now.write.parquet(f"{store.path}/{fresh}")
    parsed = spark.read.schema(PARSED).parquet(f"{store.path}/{fresh}")
    some = texts.where("text IS NOT NULL")
    packages = manifests.packages(some)
    context = {"aliases": manifests.path_aliases(some), "packages": [(r.name, r.rel_path) for r in packages.select("name", "rel_path").distinct().orderBy("name").limit(10_000).collect()], "go_module": manifests.go_module(some)}
    raw_symbols, refs, raw_imports, ranges = flat(parsed)
    symbols = resolve.symbols(raw_symbols, files)
    imported = resolve.imports(raw_imports, files, **context)
    resolved = resolve.resolve_references(refs, symbols, imported, files)
    edges = resolve.import_edges(imported).unionByName(resolve.reference_edges(resolved))
    failures = [r.asDict() for r in parsed.where("error IS NOT NULL").groupBy(F.col("error").alias("reason")).count().orderBy(F.desc("count"), "reason").limit(5).collect()]
    with store.transaction():
        if force:
            store.clear(repo)
        store._state["tables"].setdefault("_parsed", {})[repo] = fresh
        store.replace("files", repo, files)
        store.replace("symbols", repo, symbols)
        store.replace("edges", repo, edges)
        store.replace("imports", repo, imported)
        store.replace("packages", repo, packages)
        store.replace("documents", repo, documents.documents(texts, config))
        store.replace_chunks(repo, resolve.chunks(ranges, symbols, files))
        head = None
        if config["git"]["enabled"]:
            try:
                g = git.Git(root)
                head = g.head()
                if head:
                    commits, changed = git.history(spark, root, config["git"]["max_commits"], config["git"]["merges"])
                    store.insert_ignore("commits", commits.withColumn("repo_id", F.lit(repo)))
                    store.insert_ignore("commit_files", changed.withColumn("repo_id", F.lit(repo)))
            except (OSError, KeyError, ValueError):  # history is an extra: without it the index stands
                head = None
        tree = ids.tree_hash(files.where("skip_reason IS NULL"), "repo_id", "rel_path", "content_hash").first()
        n = {t: store.read(t, repo).count() for t in ("files", "symbols", "edges")}
        store.put_metadata({"repo_id": repo, "root_path": root, "indexed_at_ms": int(time.time() * 1000), "file_count": n["files"], "symbol_count": n["symbols"], "edge_count": n["edges"], "head_sha": head, "tree_hash": tree.tree_hash if tree else ""})
    return {"repo_id": repo, "mode": "incremental" if known else "full", "files_changed": n_changed, "files_removed": n_removed, "symbol_count": n["symbols"], "edge_count": n["edges"], "parse_failures": failures, "elapsed_ms": int((time.time() - began) * 1000), **counts, **resolve.counters(resolved, imported)}
