"""Latest annotation state and live recents from streams, and running a stream over stored files."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.annotations import folded_changes
from ..operators.documents import recent_files
from ..plans.settle import shared_dir


def annotation_state(events: DataFrame, fields: list[str], late=None) -> DataFrame:
    """Latest state per annotation from add / update / remove events, without the removed ones.

    One aggregation, on a table or (``complete`` or ``update`` output) on a stream; with ``late``, repeated
    deliveries within that time are dropped first.
    """
    if late:
        events = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return folded_changes(events, fields)


def present(folded: DataFrame) -> DataFrame:
    """Annotations that exist after the fold: those added and not removed since."""
    return folded.filter(F.col("base_op") == "add").drop("base_op")


def recent_files_writer(path: str, k):
    """``foreachBatch`` function keeping the newest ``k`` paths as a table: each batch writes a new version.

    A repeated batch writes its own version again from the one before, so the result does not depend on retries.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select("path", "name", "ts")
        if batch_id > 0:
            old = spark.read.parquet(f"{path}/version={batch_id - 1}").withColumnRenamed("last_opened", "ts")
            fresh = fresh.unionByName(old)
        recent_files(fresh, k).write.mode("overwrite").parquet(f"{path}/version={batch_id}")

    return merge


def file_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """Stream over the file ``name`` of a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def run_to_end(stream: DataFrame, mode="append", base=None) -> DataFrame:
    """Run a stream over what is there now and return what it wrote, with the batch number as ``_batch``.

    ``base`` is the stream's folder: a later run with the same one goes on from its checkpoint, and returns the output of all runs.
    """
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    schema = StructType([*stream.schema.fields, StructField("_batch", LongType())])

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{base}/out/b={batch_id}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(
        availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/out/*")


def keep_state_on_disk(spark: SparkSession):
    """State with timers and maps needs this provider; sessions of ``quirework.session`` have it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_in_batches(table: DataFrame, transform, mode="append", batches=3) -> DataFrame:
    """Deliver a table with a time ``ts`` to a stream in several batches, in the order of time, and return what ``transform`` of
    the stream wrote.  The stream is stopped after every batch and started again from its checkpoint."""
    spark = table.sparkSession
    keep_state_on_disk(spark)
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    micros = F.unix_micros("ts")
    cuts = table.select(F.percentile_approx(micros, [k / batches for k in range(1, batches)])).first()[0] or []
    number = sum((F.when(micros >= cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    out = None
    for k in range(batches):
        table.filter(F.coalesce(number, F.lit(0)) == k).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(table.schema).parquet(f"{base}/in")
        out = run_to_end(transform(stream), mode, base)
    return out
