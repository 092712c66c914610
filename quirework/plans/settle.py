"""Write an intermediate result once when several branches of a plan need it."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.  A temporary one serves only a session that runs on this machine alone; on a cluster
    each executor would write to its own disk, so there the setting is required."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return _local.setdefault("dir", tempfile.mkdtemp(prefix="spark-quirework-"))


def settle(df: DataFrame) -> DataFrame:
    """Store ``df`` as a table in the shared folder and read it back: the lineage ends there, so a lost executor
    costs one task's re-read, and no branch recomputes what lies below."""
    path = f"{shared_dir(df.sparkSession)}/settled/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
