"""Matches within a tolerance, found by grid cell; and first-come de-duplication on top of them."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from .components import components
from .scan import ordered_scan, range_chunks
from .settle import settle

BLOCK_NODES = 500_000


def cell(value, size) -> Column:
    return F.floor(value / F.lit(float(size))).cast("long")


def around(x, y, size) -> Column:
    """The nine cells around a point, as an array to explode."""
    cx, cy = cell(x, size), cell(y, size)
    return F.array(*[
        F.struct((cx + dx).alias("cx"), (cy + dy).alias("cy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)
    ])


def first_near(targets: DataFrame, stored: DataFrame, keys, dims, tol, strict=True) -> DataFrame:
    """First stored row (smallest ``hit`` struct) within ``tol`` of each target in all ``dims``.

    ``targets`` has ``target_id``, ``keys`` and ``dims``; ``stored`` has ``hit``, ``keys`` and ``dims``.  Equal
    positions are merged on both sides before they meet, so copies cost nothing; rows with a null, NaN or infinite
    dimension do not match.  Two dimensions go by ``_first_in_plane``, whose work follows the rows however dense a page is.
    """
    good = F.lit(True)
    for d in dims:
        good = good & F.col(d).isNotNull() & ~F.isnan(F.col(d).cast("double")) & (F.abs(F.col(d)) < float("inf"))
    t = targets.filter(good)
    places = t.select(*keys, *dims).distinct()
    s = stored.filter(good).groupBy(*keys, *dims).agg(F.min("hit").alias("hit"))
    if len(dims) == 2:
        best = _first_in_plane(places, s, keys, dims, tol, strict)
    else:
        there = s.withColumn("_c", F.explode(around(F.col(dims[0]), F.col(dims[1]), tol))).select(
            *keys, *[F.col(d).alias(f"_s{i}") for i, d in enumerate(dims)], "hit",
            F.col("_c.cx").alias("_cx"), F.col("_c.cy").alias("_cy"))
        here = places.withColumn("_cx", cell(F.col(dims[0]), tol)).withColumn("_cy", cell(F.col(dims[1]), tol))
        best = _within(here.join(there, [*keys, "_cx", "_cy"]), dims, tol, strict).groupBy(*keys, *dims).agg(
            F.min("hit").alias("hit"))
    return t.join(best, [*keys, *dims]).select("target_id", "hit")


def _within(pairs, dims, tol, strict):
    for i, d in enumerate(dims):
        gap = F.abs(F.col(d) - F.col(f"_s{i}"))
        pairs = pairs.filter(gap < tol if strict else gap <= tol)
    return pairs


#: Fine cells to a tolerance; cells at most two apart lie within it whole, from six on beyond it (one is left for rounding).
FINE = 4


def _first_in_plane(places, stored, keys, dims, tol, strict) -> DataFrame:
    """(keys, dims, hit): the first of ``stored`` near each of ``places``.

    Both sides are gathered in fine cells, a quarter of the tolerance wide.  A cell of places first meets cells of stored rows, of
    which each has its first row only: what lies within the tolerance whole bounds the result for all its places.  Single rows
    are looked at only in the cells on the rim, and of those only rows that come before that bound, which are few.  A cell meets
    at most 120 others, so a page of any density makes rows in proportion to its own.
    """
    size = tol / FINE
    # Positions no page has share the outermost cells.
    held = lambda d: F.greatest(F.lit(-1e15), F.least(F.lit(1e15), F.col(d).cast("double")))
    fine = lambda df: df.withColumn("_fx", cell(held(dims[0]), size)).withColumn("_fy", cell(held(dims[1]), size))
    places, stored = settle(fine(places)), settle(fine(stored))
    coarse = lambda c: F.floor(F.col(c) / FINE)
    mine = places.select(*keys, "_fx", "_fy").distinct().withColumn("_cx", coarse("_fx")).withColumn("_cy", coarse("_fy"))
    steps = F.array(*[F.lit(k) for k in (-2, -1, 0, 1, 2)])
    theirs = stored.groupBy(*keys, F.col("_fx").alias("_gx"), F.col("_fy").alias("_gy")).agg(F.min("hit").alias("_first"))
    theirs = theirs.withColumn("_cx", F.explode(F.transform(steps, lambda k: coarse("_gx") + k))).withColumn(
        "_cy", F.explode(F.transform(steps, lambda k: coarse("_gy") + k)))
    # Of the 25 coarse cells around, those that no place within reach can lie in are left out before the rows meet.
    reach = lambda c, g: ((F.col(c) + 1) * FINE > F.col(g) - FINE - 1) & (F.col(c) * FINE <= F.col(g) + FINE + 1)
    theirs = theirs.filter(reach("_cx", "_gx") & reach("_cy", "_gy"))
    dx, dy = F.abs(F.col("_fx") - F.col("_gx")), F.abs(F.col("_fy") - F.col("_gy"))
    far = F.greatest(dx, dy)
    # Beyond this a double has too few digits left to tell cells apart: such rows are compared one by one.
    sure = (far <= FINE - 2) & (F.greatest(F.abs(F.col("_gx")), F.abs(F.col("_gy"))) < F.lit(10 ** 12))
    own = Window.partitionBy(*keys, "_fx", "_fy")
    met = mine.join(theirs, [*keys, "_cx", "_cy"]).filter(far <= FINE + 1).withColumn("_sure", sure).withColumn(
        "_bound", F.min(F.when(F.col("_sure"), F.col("_first"))).over(own))
    met = settle(met.select(*keys, "_fx", "_fy", "_gx", "_gy", "_first", "_sure", "_bound"))
    before = lambda c: F.col("_bound").isNull() | (F.col(c) < F.col("_bound"))
    rows = stored.select(*keys, F.col("_fx").alias("_gx"), F.col("_fy").alias("_gy"), "hit",
                         *[F.col(d).alias(f"_s{i}") for i, d in enumerate(dims)])
    rim = met.filter(~F.col("_sure") & before("_first")).join(rows, [*keys, "_gx", "_gy"]).filter(before("hit")).select(
        *keys, "_fx", "_fy", "hit", *[f"_s{i}" for i in range(len(dims))])
    single = _within(places.join(rim, [*keys, "_fx", "_fy"]), dims, tol, strict).select(*keys, *dims, "hit")
    bounds = met.filter("_bound is not null").select(*keys, "_fx", "_fy", F.col("_bound").alias("hit")).distinct()
    whole = places.join(bounds, [*keys, "_fx", "_fy"]).select(*keys, *dims, "hit")
    return whole.unionByName(single).groupBy(*keys, *dims).agg(F.min("hit").alias("hit"))


def keep_first(nodes: DataFrame, edges: DataFrame, block_nodes=BLOCK_NODES) -> DataFrame:
    """Nodes that survive when each is dropped if an earlier *surviving* node is its neighbour.

    ``nodes`` has ``node``, ``edges`` has ``earlier, later``.  The decision runs along the order of the nodes, but only inside
    connected groups: each group is scanned once, in order, by one task for ``block_nodes`` nodes.  A larger group takes a round
    for each further block, in which the neighbours of earlier blocks are settled; ordinary data take one round in all.  Nodes without
    neighbours never enter.
    """
    edges = settle(edges.distinct())
    groups = components(edges.select(F.col("earlier").alias("u"), F.col("later").alias("v")))
    at = [F.col("node")]
    placed = ordered_scan(range_chunks(groups, ["root"], at, "_range"), ["root"], F.col("_range"), at, rank="rank")
    placed = settle(placed.select("node", "root", "rank"))
    first = placed.select(F.col("node").alias("earlier"), F.col("rank").alias("e"))
    later = placed.select(F.col("node").alias("later"), "root", F.col("rank").alias("l"))
    pairs = settle(edges.join(first, "earlier").join(later, "later").select("root", "e", "l"))

    def changes(values):
        """Which places of an Arrow array begin a run of equal values; nulls are equal."""
        out = np.ones(len(values), bool)
        if len(values) < 2:
            return out
        if pa.types.is_struct(values.type):
            out[1:] = False
            for part in [values.is_valid(), *values.flatten()]:
                out |= changes(part)
            return out
        one, two = values.slice(1), values.slice(0, len(values) - 1)
        differ = pc.not_equal(one, two).fill_null(False).to_numpy(zero_copy_only=False)
        out[1:] = differ | (one.is_null().to_numpy(zero_copy_only=False) != two.is_null().to_numpy(zero_copy_only=False))
        return out

    def scan(batches):
        # Rows come sorted by root and place; a group may go on in the next batch.
        last, kept, now = None, {}, None
        for batch in batches:
            roots, gone = batch.column(0), []
            fresh = changes(roots if last is None else pa.concat_arrays([last, roots]))[0 if last is None else 1:]
            rows = zip(fresh.tolist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())
            for i, (new, e, l) in enumerate(rows):
                if new:
                    kept, now = {}, None
                if l != now:
                    now, kept[l] = l, True
                # An earlier node without a line of its own has no earlier neighbour.  -1 stands for one kept in an earlier block.
                if kept[l] and (e < 0 or kept.get(e, True)):
                    kept[l] = False
                    gone.append(i)
            if batch.num_rows:
                last = roots.slice(batch.num_rows - 1)
            at = pa.array(gone, pa.int64())
            yield pa.RecordBatch.from_arrays([roots.take(at), batch.column(2).take(at)], ["root", "l"])

    kind = StructType([StructField("root", groups.schema["root"].dataType), StructField("l", LongType())])
    block = lambda c: F.floor(F.col(c) / block_nodes)
    dropped = None
    for k in range((pairs.agg(F.max(block("l"))).first()[0] or 0) + 1):
        now = pairs.filter(block("l") == k)
        inner = now.filter(block("e") == k)
        if k:
            kept = now.filter(block("e") < k).join(dropped.withColumnRenamed("l", "e"), ["root", "e"], "left_anti")
            # A node with a surviving neighbour from before needs no other.
            lost = kept.select("root", "l").distinct()
            inner = inner.join(lost, ["root", "l"], "left_anti").select("root", "e", "l").unionByName(
                lost.select("root", F.lit(-1).cast("long").alias("e"), "l"))
        # Groups are many and mostly small: a task scans all of its own in one go, without a call for each.
        fresh = inner.select("root", "e", "l").repartition("root").sortWithinPartitions("root", "l").mapInArrow(scan, kind)
        dropped = settle(fresh if dropped is None else dropped.unionByName(fresh))
    if dropped is None:
        return nodes.select("node")
    gone = placed.join(dropped.withColumnRenamed("l", "rank"), ["root", "rank"], "left_semi")
    return nodes.join(gone.select("node"), "node", "left_anti").select("node")
