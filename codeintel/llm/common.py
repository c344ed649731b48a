"""What the training-data operators share: tables, scratch space, Arrow maps."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder (as a URI) in the one that all executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset,
    as in local tests, a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="codeintel-")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base:
        # as Spark itself reads it: a path of the default file system
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        base = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
        if base.startswith("file:/") and not base.startswith("file:///"):
            base = "file://" + base[5:]
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def materialize(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends here.

    Lost executors then cost a read, not a second computation, and later jobs
    read only the columns they use.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of materialized tables that nothing lazy reads any more."""
    for t in tables:
        path = getattr(t, "_scratch", None)
        if path:
            p = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            t._scratch = None


def text_key(text: str | Column) -> Column:
    """16 bytes that equal texts have in common: what results that depend on the text alone are joined by."""
    return F.unhex(F.md5(whole(text)))


def parts(spark: SparkSession) -> int:
    """Partitions of an explicit shuffle."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, in any case of letters, made of ``names``."""
    has = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in has:
            n += "_"
        has.add(n.lower())
        out.append(n)
    return out


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with the Arrow batches of this session cut by bytes as well as by rows.

    A batch to Python then holds ``BATCH_BYTES`` or one row, however long the texts.
    A smaller bound that the session already has stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    has = conf.get(key, None)
    if not has or not 0 < _bytes(has) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def _bytes(size: str) -> int:
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    digits = size.lower().rstrip("bkmg")
    return int(digits or 0) * units[size.lower()[len(digits) :] or "b"]


def whole(text: str | Column) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def map_rows(df: DataFrame, f: Callable[..., Iterator[tuple]], schema: str, rows: int = 4000) -> DataFrame:
    """``mapInArrow`` for functions from a batch's columns (as lists) to rows.

    ``f(*columns)`` gets the columns of one Arrow batch and yields tuples.  The
    results leave in batches of ``rows``, so a batch that grows stays bounded.
    """
    target = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        for b in batches:
            for row in f(*[c.to_pylist() for c in b.columns]):
                out.append(row)
                if len(out) >= rows:
                    yield _batch(out, target)
                    out = []
        if out:
            yield _batch(out, target)

    return bounded(df).mapInArrow(run, schema)


def _batch(rows: list, target: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target, strict=True)], schema=target)


def _arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
