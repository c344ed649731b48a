"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, prefix: str = "engine") -> str:
    """A new folder's URI in the one the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset, as in local tests, a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="codeintel-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    base = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if base.startswith("file:/") and not base.startswith("file:///"):
        base = "file://" + base[5:]
    return f"{base.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written and read again: its lineage ends here, and a lost executor costs a read."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
