"""Changes of a folder as a stream, and refreshes that never overlap and outlive failures."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.paths import any_of
from ..sources.globs import glob_regex

LOG = logging.getLogger(__name__)
MAX_DEPTH = 24


def file_events(spark: SparkSession, root: str, ignore: list[str]) -> DataFrame:
    """(rel_path, ts): files that came or changed under ``root``, ignored globs left out.

    Spark's file source reports what is new; removals are found by comparing
    listings (``changes``), as no file source tells of them.
    """
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", True).load(root)
    base = root.removeprefix("file://").rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), f"^{base}/", "")
    x = source.select(rel.alias("rel_path"), F.col("modificationTime").alias("ts"))
    return x.where(~any_of(F.col("rel_path"), [glob_regex(g) for g in ignore]) & (F.size(F.split("rel_path", "/")) <= MAX_DEPTH))


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(root, rel_path, event) of two listings (root, rel_path, size_bytes, mtime_ms): add, change or unlink."""
    a = before.select("root", "rel_path", F.struct("size_bytes", "mtime_ms").alias("was"))
    b = now.select("root", "rel_path", F.struct("size_bytes", "mtime_ms").alias("is_"))
    event = F.when(F.col("was").isNull(), "add").when(F.col("is_").isNull(), "unlink").when(F.col("was") != F.col("is_"), "change")
    return a.join(b, ["root", "rel_path"], "full").select("root", "rel_path", event.alias("event")).where("event IS NOT NULL")


class Refresher:
    """Pending paths by root, and one refresh at a time.

    A batch adds its paths and asks for a refresh.  If one runs, exactly one more
    is queued.  A refresh that fails is logged; its paths stay pending, so the
    next one takes them too.
    """

    def __init__(self, refresh: Callable[[str, set[str]], None]):
        self.refresh, self.pending, self.failures = refresh, {}, []
        self._running: set[str] = set()
        self._again: set[str] = set()

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.groupBy("root").agg(F.collect_set("rel_path").alias("paths")).collect()  # one burst of edits a root
        for r in rows:
            self.pending.setdefault(r.root, set()).update(r.paths)
            self.run(r.root)

    def run(self, root: str) -> None:
        if root in self._running:
            self._again.add(root)
            return
        self._running.add(root)
        try:
            while True:
                paths = self.pending.pop(root, set())
                self._again.discard(root)
                try:
                    if paths:
                        self.refresh(root, paths)
                except Exception as e:  # the stream goes on; the paths are tried again
                    LOG.warning("refresh of %s failed: %s", root, e)
                    self.failures.append((root, str(e)))
                    self.pending.setdefault(root, set()).update(paths)
                    return
                if root not in self._again:
                    return
        finally:
            self._running.discard(root)


class Watcher:
    """A stream of events (root, rel_path, ts) whose bursts are refreshed; stops before its store is released."""

    def __init__(self, events: DataFrame, refresh: Callable[[str, set[str]], None], checkpoint: str, release: Callable[[], None] = lambda: None):
        self.refresher, self.release = Refresher(refresh), release
        self.query: StreamingQuery = events.writeStream.foreachBatch(self.refresher).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def wait(self, seconds: int) -> bool:
        return bool(self.query.awaitTermination(seconds))

    def stop(self) -> None:
        """The stream first, then what it writes to."""
        self.query.stop()
        self.release()
