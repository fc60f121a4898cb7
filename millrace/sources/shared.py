"""A folder that the driver and every executor see, for what a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, under the warehouse, and with a local master (tests) in a temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark, "_millrace_dir", None)
        if base is None:
            master = spark.sparkContext.master
            alone = master.startswith("local") and not master.startswith("local-cluster")
            base = tempfile.mkdtemp(prefix="millrace-") if alone else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/millrace"
            spark._millrace_dir = base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again: lineage is cut, and a lost executor costs no recomputation."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._millrace_stored = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_millrace_stored", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
