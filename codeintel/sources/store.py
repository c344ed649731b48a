"""A catalogue of repositories in Parquet: upserts, deletes, and commits that are all or nothing.

A pointer file, ``CURRENT``, names the folder of each table and repository.  A
transaction writes new folders and then replaces the pointer in one rename, so a
reader sees all of it or none; a writer that dies leaves the old state.  Only the
repositories that a write touches are written again.  One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from copy import deepcopy
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES, VERSION, Repo, conform


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._stack: list[dict] = []

    # ----- the pointer -----------------------------------------------------------
    def _file(self, name: str):
        p = self._fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _load(self) -> dict:
        p, fs = self._file("CURRENT")
        if not fs.exists(p):
            return {"version": VERSION, "tables": {}}
        stream = fs.open(p)
        try:
            got = json.loads(bytes(b & 255 for b in stream.readAllBytes()).decode())
        finally:
            stream.close()
        if got["version"] > VERSION:
            raise RuntimeError("the store is of a newer version")
        return got if got["version"] == VERSION else {"version": VERSION, "tables": {}}

    def _save(self, state: dict) -> None:
        tmp, fs = self._file(f"CURRENT.{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        ctx = self._fs.FileContext.getFileContext(tmp.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 1)
        rename[0] = self._fs.Options.Rename.OVERWRITE
        ctx.rename(tmp, self._file("CURRENT")[0], rename)

    @property
    def _state(self) -> dict:
        return self._stack[-1] if self._stack else self._load()

    @contextmanager
    def transaction(self) -> Iterator[Store]:
        """All or nothing; nested, it is a savepoint."""
        self._stack.append(deepcopy(self._state))
        try:
            yield self
        except BaseException:
            self._stack.pop()
            raise
        state = self._stack.pop()
        if self._stack:
            self._stack[-1] = state
        else:
            self._save(state)

    # ----- reads -----------------------------------------------------------------
    def read(self, table: str, repo: str | None = None) -> DataFrame:
        """A table, of all repositories or one: only its folders are opened."""
        at = self._state["tables"].get(table, {})
        dirs = [d for r, d in sorted(at.items()) if repo is None or r == repo]
        ddl = TABLES[table][0] if table in TABLES else POSTINGS
        if not dirs:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(*[f"{self.path}/{d}" for d in dirs])

    def repo(self, repo: str) -> Repo:
        return Repo(**{t: self.read(t, repo) for t in TABLES})

    def repositories(self) -> list[str]:
        return sorted({r for t in self._state["tables"].values() for r in t})

    # ----- writes ----------------------------------------------------------------
    def _put(self, table: str, df: DataFrame, repos: list[str]) -> None:
        """Makes ``df`` all that the table has of ``repos``."""
        with self.transaction():
            at = self._state["tables"].setdefault(table, {})
            folder = f"{table}/{uuid.uuid4().hex}"
            df.withColumn("_repo", F.col("repo_id")).write.partitionBy("_repo").parquet(f"{self.path}/{folder}")
            for r in repos:
                part = f"{folder}/_repo={quote(r, safe='')}"
                p, fs = self._file(part)
                if fs.exists(p):
                    at[r] = part
                else:
                    at.pop(r, None)

    def _touched(self, df: DataFrame) -> list[str]:
        return [r.repo_id for r in df.select("repo_id").distinct().collect()]  # one row a repository

    def upsert(self, table: str, new: DataFrame) -> None:
        """Rows of ``new`` replace those with their key; of equal keys in it, one stays."""
        key = TABLES[table][1]
        new = conform(new, table).dropDuplicates(key)
        repos = self._touched(new)
        kept = [self.read(table, r).join(new.select(*key), key, "left_anti") for r in repos]
        for k in kept:
            new = new.unionByName(k)
        self._put(table, new, repos)

    def insert_ignore(self, table: str, new: DataFrame) -> None:
        """Rows of ``new`` whose key isn't there yet; also how imports and changes are appended, so none counts twice."""
        key = TABLES[table][1]
        new = conform(new, table).dropDuplicates(key)
        repos = self._touched(new)
        for r in repos:
            old = self.read(table, r)
            new = new.join(old.select(*key), key, "left_anti").unionByName(old) if r in self._state["tables"].get(table, {}) else new
        self._put(table, new, repos)

    def replace(self, table: str, repo: str, new: DataFrame) -> None:
        self._put(table, conform(new, table), [repo])

    def delete_files(self, repo: str, file_ids: DataFrame) -> None:
        """Drops files and all that hangs on them: symbols, edges either way, imports, chunks, documents."""
        gone = file_ids.select("file_id").distinct()
        with self.transaction():
            lost = self.read("symbols", repo).join(gone, "file_id", "left_semi").select(F.col("symbol_id").alias("to_id")).unionByName(gone.select(F.col("file_id").alias("to_id")))
            edges = self.read("edges", repo).join(gone, "file_id", "left_anti").join(lost, "to_id", "left_anti").select(*self.read("edges", repo).columns)
            keep = {t: self.read(t, repo).join(gone, "file_id", "left_anti") for t in ("files", "symbols", "imports", "chunks", "documents")}
            chunks = self.read("chunks", repo).join(gone, "file_id", "left_semi").select("chunk_id")
            if "postings" in self._state["tables"]:
                self._put("postings", self.read("postings", repo).join(chunks, "chunk_id", "left_anti"), [repo])
            for t, df in (keep | {"edges": edges}).items():
                self._put(t, conform(df, t), [repo])

    def clear(self, repo: str) -> None:
        """Everything of a repository but its row in ``repositories``."""
        with self.transaction():
            for t, at in self._state["tables"].items():
                if t != "repositories":
                    at.pop(repo, None)

    def put_chunks(self, new: DataFrame) -> None:
        """Upserts chunks and replaces their postings, so a chunk never has two sets."""
        from ..operators.search import postings

        with self.transaction():
            self.upsert("chunks", new)
            repos = self._touched(new)
            for r in repos:
                mine = new.where(F.col("repo_id") == r)
                old = self.read("postings", r).join(mine.select("chunk_id"), "chunk_id", "left_anti")
                fresh = postings(mine.select("repo_id", "chunk_id", "search_text"), "chunk_id", "search_text", ["repo_id"]).select(*old.columns)
                self._put("postings", old.unionByName(fresh), [r])

    def replace_chunks(self, repo: str, new: DataFrame) -> None:
        """Makes ``new`` the chunks of a repository; only those whose text is new are tokenized, the others keep their postings."""
        from ..operators.search import postings

        with self.transaction():
            old = self.read("chunks", repo).select("chunk_id", "search_text")
            held = self.read("postings", repo)
            self._put("chunks", conform(new, "chunks"), [repo])
            now = self.read("chunks", repo)
            same = now.join(old, ["chunk_id", "search_text"], "left_semi").select("chunk_id")
            fresh = now.join(same, "chunk_id", "left_anti").select("repo_id", "chunk_id", "search_text")
            made = postings(fresh, "chunk_id", "search_text", ["repo_id"]).select(*held.columns)
            self._put("postings", held.join(same, "chunk_id", "left_semi").select(*held.columns).unionByName(made), [repo])

    def put_metadata(self, row: dict) -> None:
        self.upsert("repositories", self.spark.createDataFrame([row | {"schema_version": VERSION}], TABLES["repositories"][0]))

    def metadata(self, repo: str) -> dict | None:
        row = self.read("repositories", repo).first()
        return row.asDict() if row else None


POSTINGS = "repo_id string, chunk_id string, term string, tf int, positions array<int>, dl int, bucket int"
