"""Helpers of the operators: global order without one big task, connected components, bounded membership bitmaps."""

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.plans.settle import settle, shared_dir

#: Code points between words: space and the controls tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_batches(spark: SparkSession, rows: int = 1000):
    """Hand texts to Python in small batches: a document may be long, and a batch is held whole on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


_HELD, _CLAIMED = {}, []


def claim(name: str, *caches: dict):
    """Worker memory goes to the step that runs: the first call under another name empties the caches of the other names and
    gives free memory back to the system, as a worker serves one step after the other."""
    _HELD[name] = caches
    if _CLAIMED != [name]:
        _CLAIMED[:] = [name]
        for other, held in _HELD.items():
            if other != name:
                for cache in held:
                    cache.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # no such call on this system
            pass


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and its place, for ``discard``."""
    path = f"{shared_dir(df.sparkSession)}/settled/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str):
    """Delete stored tables that no later plan reads."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def ascii_lower(text) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text) -> Column:
    """Array of the words of a text (null: empty array)."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACES)
    return F.filter(parts, lambda w: w != "")


def in_fold(doc_id) -> Column:
    """True for the fifth of the documents that no model learns from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def numbered(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """``df`` with its 0-based position in the global order as ``name``; a settled table.

    Ranges of the order are sorted in separate tasks and counted; the table of offsets has one row per range, as many
    as there are shuffle partitions.  Rows that the order doesn't tell apart keep an arbitrary but fixed order.
    """
    count = partitions(df.sparkSession)
    ranged = df.repartitionByRange(count, *order).sortWithinPartitions(*order)
    placed = settle(ranged.withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    joined = placed.join(F.broadcast(offsets), "_part")
    return joined.withColumn(name, F.col("_before") + local).drop("_place", "_part", "_before")


def running(df: DataFrame, key: str, order: list[Column], size: str, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``size`` over the rows of the same ``key`` that come earlier in the order.

    A key's rows are spread over ranges of (key, order): each range is scanned by itself and the sums of a key's
    earlier ranges are added from a table with one row per range and key.  Nulls form a key of their own.
    """
    count = partitions(df.sparkSession)
    by = [F.col(key).asc_nulls_last(), *order]
    placed = settle(df.repartitionByRange(count, *by).sortWithinPartitions(*by)
                    .withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    local = Window.partitionBy("_part", key).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_part", key).agg(F.sum(size).alias("_sum"))
    offsets = sums.select("_part", F.col(key).alias("_key"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_o"))
    scanned = placed.withColumn("_l", F.coalesce(F.sum(size).over(local), F.lit(0))).withColumnRenamed("_part", "_p")
    joined = scanned.join(offsets, (F.col("_p") == F.col("_part")) & F.col(key).eqNullSafe(F.col("_key")))
    return joined.withColumn(name, F.col("_o") + F.col("_l")).drop("_place", "_p", "_part", "_key", "_o", "_l")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v), where root is the smallest node of the component.

    Rounds of large-star and small-star: every node links its larger neighbours to the smallest one it knows, then the
    smaller ones.  A round is two aggregations and two joins over at most as many rows as there are edges; the number
    of rounds grows with the logarithm of the longest path.  Each round is written to the shared folder.
    """
    def star(pairs, larger):
        both = pairs if not larger else pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        met = both.join(least, "u")
        kept = met.filter(F.col("v") > F.col("u")) if larger else met
        out = kept.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not larger:
            out = out.unionByName(least.select("u", F.col("m").alias("v")))
        return out.filter(F.col("u") != F.col("v")).distinct()

    def down(pairs):
        return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))

    def mark(pairs):
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = settle(down(edges.select("u", "v").filter(F.col("u") != F.col("v"))).distinct())
    seen = mark(now)
    while seen[0]:
        now = settle(star(down(star(now, True)), False))
        last, seen = seen, mark(now)
        if last == seen:
            break
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


BITMAP_BITS = 1 << 24


def bitmap(keys: DataFrame, col: str) -> np.ndarray:
    """A set of 64-bit keys as a bitmap of a fixed 2 MB (position: the key's low 24 bits).  A cheap filter before a
    shuffle: it never loses a key, and lets through others at a rate that costs time, not rightness."""
    spot = F.col(col).bitwiseAND(F.lit(BITMAP_BITS - 1))
    rows = keys.select(spot.alias("s")).groupBy(F.shiftright("s", 15).alias("b")).agg(
        F.bitmap_construct_agg(F.col("s").bitwiseAND(F.lit(32767))).alias("bits")).collect()
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for r in rows:
        out[r["b"] * 4096:][:len(r["bits"])] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit ``keys`` may be in the bitmap."""
    spot = (keys.astype(np.uint64) & np.uint64(BITMAP_BITS - 1)).astype(np.int64)
    return ((bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1).astype(bool)
