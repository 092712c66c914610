"""Ordered scans over keys of any size.

A window partitioned by ``doc_id`` puts a whole document into one task.  ``ordered_scan`` cuts every key into
chunks that follow the order (``page_number div 1024``, for instance), scans inside the chunks, and adds what
came before each chunk from a small table with one row per chunk.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .settle import settle

_CHUNK, _NULLS = "_chunk", "_nulls"
_DEFAULTS = {"string": "", "boolean": False, "date": "1970-01-01", "timestamp": "1970-01-01", "timestamp_ntz": "1970-01-01"}


def _never_null(df, names):
    """``{name: column}`` that tells the rows of ``df`` apart as the named columns and ``_NULLS`` do, null for null."""
    kinds = dict(df.dtypes)

    def plain(n):
        if kinds[n].startswith(("struct", "array")):  # chunks of several columns, which are built and not null
            return F.col(n)
        return F.coalesce(F.col(n), F.lit(_DEFAULTS.get(kinds[n], 0)).cast(kinds[n]))

    return {f"_key_{n}": plain(n) for n in names}


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    chunk: Column,
    order: list[Column],
    rank: str | None = None,
    sums: dict[str, Column] | None = None,
    lags: dict[str, Column] | None = None,
    leads: dict[str, Column] | None = None,
    mins: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None,
) -> DataFrame:
    """Add scan columns to ``df``.

    ``chunk`` must not decrease along ``order`` (ascending columns).  ``rank`` is a 0-based position, ``sums``
    and ``mins`` run over the rows *before* the current one, ``lags`` and ``leads`` take the neighbour's value and
    ``totals`` are aggregates (``F.sum``/``F.count``-like, summable) over the whole key.
    """
    sums, lags, leads, mins, totals = sums or {}, lags or {}, leads or {}, mins or {}, totals or {}
    base = df.withColumn(_CHUNK, chunk)
    # Windows and the join back go by columns that are never null, so rows with a null key or chunk stay.
    plain = _never_null(base, [*keys, _CHUNK])
    flags = [F.col(n).isNull().cast("int") * (1 << i) for i, n in enumerate([*keys, _CHUNK])]
    base = base.withColumns(plain).withColumn(_NULLS, sum(flags[1:], flags[0]))
    whole_key = [f"_key_{k}" for k in keys]
    key_nulls = F.col(_NULLS) % (1 << len(keys))
    at = F.struct(*order)

    local = Window.partitionBy(*plain, _NULLS).orderBy(*order)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    cols, aggs, carried, fixed = [], [], [], []
    across = Window.partitionBy(*whole_key, key_nulls).orderBy(_CHUNK)
    across_before = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*whole_key, key_nulls)

    if rank:
        cols.append((F.row_number().over(local) - 1).cast("long").alias("_l_rank"))
        aggs.append(F.count(F.lit(1)).alias("_t_rank"))
        carried.append(F.coalesce(F.sum("_t_rank").over(across_before), F.lit(0)).alias("_o_rank"))
        fixed.append((F.col("_l_rank") + F.col("_o_rank")).alias(rank))
    for name, col in sums.items():
        cols.append(F.sum(col).over(before).alias(f"_l_{name}"))
        aggs.append(F.sum(col).alias(f"_t_{name}"))
        carried.append(F.sum(f"_t_{name}").over(across_before).alias(f"_o_{name}"))
        zero = F.lit(0)
        fixed.append((F.coalesce(f"_o_{name}", zero) + F.coalesce(f"_l_{name}", zero)).alias(name))
    for name, col in mins.items():
        cols.append(F.min(col).over(before).alias(f"_l_{name}"))
        aggs.append(F.min(col).alias(f"_t_{name}"))
        carried.append(F.min(f"_t_{name}").over(across_before).alias(f"_o_{name}"))
        fixed.append(F.least(f"_o_{name}", f"_l_{name}").alias(name))
    # A neighbour may legitimately be null, so "is there one in this chunk" is kept apart from its value.
    if lags:
        cols.append(F.row_number().over(local).alias("_first"))
    for name, col in lags.items():
        cols.append(F.lag(col).over(local).alias(f"_l_{name}"))
        aggs.append(F.max_by(col, at).alias(f"_t_{name}"))
        carried.append(F.lag(f"_t_{name}").over(across).alias(f"_o_{name}"))
        fixed.append(F.when(F.col("_first") > 1, F.col(f"_l_{name}")).otherwise(F.col(f"_o_{name}")).alias(name))
    if leads:
        cols.append(F.lead(F.lit(1)).over(local).alias("_more"))
    for name, col in leads.items():
        cols.append(F.lead(col).over(local).alias(f"_l_{name}"))
        aggs.append(F.min_by(col, at).alias(f"_t_{name}"))
        carried.append(F.lead(f"_t_{name}").over(across).alias(f"_o_{name}"))
        fixed.append(F.when(F.col("_more").isNotNull(), F.col(f"_l_{name}")).otherwise(F.col(f"_o_{name}")).alias(name))
    for name, col in totals.items():
        aggs.append(col.alias(f"_t_{name}"))
        carried.append(F.sum(f"_t_{name}").over(whole).alias(name))
        fixed.append(F.col(name))

    per_chunk = base.groupBy(*plain, _NULLS).agg(F.first(_CHUNK).alias(_CHUNK), *aggs)
    offsets = per_chunk.select(*plain, _NULLS, *carried)
    scanned = base.select("*", *cols)
    # Every chunk has its offsets; as an outer join it falls away where no scanned column is used.
    return scanned.join(offsets, [*plain, _NULLS], "left").select(*[F.col(c) for c in df.columns], *fixed)


def range_chunks(df: DataFrame, keys: list[str], order: list[Column], name: str = "chunk") -> DataFrame:
    """``df`` with a chunk number for ``ordered_scan``: ranges of (keys, order) of about equal numbers of rows.

    For orders without a natural cut, such as times that may all lie in one moment.  The ranges are written once, so that a row
    keeps its chunk when a task is run again.
    """
    by = [*[F.col(k) for k in keys], *order]
    ranged = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    return settle(ranged.withColumn(name, F.spark_partition_id().cast("long")))


def split_hot(df: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """Split ``df`` into rows of ordinary keys and rows of keys with more than ``limit`` rows.

    Whether the list of hot keys is broadcast is left to its measured size; when it is empty, adaptive execution drops
    the hot branch.  Rows with a null key count as ordinary.
    """
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(*keys)
    return df.join(hot, keys, "left_anti"), df.join(hot, keys, "left_semi")
