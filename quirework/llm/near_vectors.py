"""Near-duplicate vectors by a flat graph with robust pruning, built on overlapping shards of clusters.

1. Equal vectors are one point with a count.
2. Leaders picked from a bounded sample cut the space into cells; every point is a member of the cells of its nearest
   leaders, so neighbouring shards overlap.  A large shard is dealt to blocks of bounded size.
3. In each block, every point's nearest members are pruned robustly: a candidate is dropped when a kept neighbour is
   closer to it than the point is.  The adjacency lists of a point from all its blocks are united.
4. Each point is sought in the blocks of its home cell: a greedy search from the block's medoid over the united lists,
   which then widens to all neighbours of what lies within the range.  A found point whose own home cell does not hold the
   asking one cannot find it back, and is counted the link as well.
5. Recall is audited on a sample that grows with the table and on planted neighbours at the edge of the range.  While it is
   too low the points join more cells, at last all cells whose points can lie within the range; if that is still too
   low, the run fails.

A block's tasks return one row per point with the number of vectors found and one link into its connected part of the
block, never the pairs, so a large group of near copies costs rows in proportion to its size.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quirework.plans.settle import settle

from .common import components

#: Vectors per leader, most leaders, sampled vectors per leader, members and queries of a block, list lengths.
PER_LEADER, LEADERS, PER_SAMPLE, BLOCK, QUERIES = 1000, 4096, 8, 2048, 2048
DEGREE, POOL, BEAM, MEDOIDS, NEAREST, SLACK = 24, 48, 64, 32, 8, 1.2
#: Audited vectors at least, and for each root of the number of points; recall to go on with, and to fail without.
AUDITED, PER_ROOT, RECALL, LEAST_RECALL = 256, 8, 0.99, 0.9
#: Cells of a point in each attempt; None: all that can hold a point within the range.
OVERLAP = (4, 8, 16, None)


def _unit(rows) -> np.ndarray:
    x = np.array([np.asarray(r, float) for r in rows])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def points_of(vectors: DataFrame) -> DataFrame:
    """(pid, embedding, mult) of the distinct comparable vectors: no null, no null or non-finite component, not zero."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists(x, lambda v: v != 0)
    good = F.coalesce(x.isNotNull() & ~F.coalesce(bad, F.lit(False)) & some, F.lit(False))
    per = vectors.filter(good).groupBy("embedding").agg(F.count(F.lit(1)).alias("mult"), F.min("vec_id").alias("least"))
    return per.withColumn("dim", F.size("embedding")).withColumn("pid", F.monotonically_increasing_id())


def leaders_of(points: DataFrame, count: int, apart: float = 0.8) -> dict:
    """{dimension: leaders}: sampled points no two of which are closer than ``apart``; bounded by LEADERS in all.  The
    sample is the ``PER_SAMPLE * count`` points of the smallest hashes."""
    rows = points.orderBy(F.xxhash64("embedding"), "pid").limit(PER_SAMPLE * count).select("dim", "embedding").toPandas()
    out = {}
    for dim, part in rows.groupby("dim"):
        x, kept = _unit(part["embedding"]), []
        for k in range(len(x)):
            if len(kept) < count and (not kept or (x[kept] @ x[k]).max() < apart):
                kept.append(k)
        out[int(dim)] = x[kept]
    return out


def cells_of(x: np.ndarray, known: np.ndarray, overlap: int | None, within: float) -> list:
    """The leaders that each row of ``x`` is a member of, its home first.

    ``overlap``: so many nearest ones.  None: the home h and every leader c that can be home of a point q within the range.  Such a q
    has q.c >= q.h, so x.h - x.c <= (x - q).(h - c) <= |x - q| |h - c|, and |x - q| is at most the chord of the range."""
    close = x @ known.T
    if overlap is not None:
        return list(np.argsort(-close, axis=1, kind="stable")[:, :overlap])
    home, chord, out = close.argmax(axis=1), np.sqrt(max(0.0, 2 - 2 * within)), []
    for h, row in zip(home, close):
        apart = np.sqrt(np.maximum(0, 2 - 2 * (known @ known[h])))
        may = np.flatnonzero(row[h] - row <= chord * apart + 1e-9)
        out.append(np.concatenate([[h], may[may != h]]))
    return out


def members_of(points: DataFrame, leaders: dict, overlap: int | None, within: float) -> DataFrame:
    """(pid, mult, embedding, cell, home, cells) for each cell of a point: its home cell, and where that is this one all its cells."""
    kind = points.schema["embedding"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            pid, mult, rows = (batch.column(k).to_pylist() for k in range(3))
            by = {}
            for k, r in enumerate(rows):
                by.setdefault(len(r), []).append(k)
            take, cells, home, lists = [], [], [], []
            for dim, some in by.items():
                known = leaders.get(dim)
                if known is None:  # no sampled vector has this length: one cell
                    near = [np.zeros(1, int)] * len(some)
                else:
                    near = cells_of(_unit([rows[k] for k in some]), known, overlap, within)
                for k, its in zip(some, near):
                    its = (its + dim * (LEADERS + 1)).tolist()
                    take += [k] * len(its)
                    cells += its
                    home += its[:1] * len(its)
                    lists += [its] + [None] * (len(its) - 1)
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(cells, pa.int64()),
                 pa.array(home, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["pid", "mult", "embedding", "cell", "home", "cells"])

    return points.select("pid", "mult", "embedding").mapInArrow(
        run, f"pid long, mult long, embedding {kind}, cell long, home long, cells array<long>")


def prune(sims: np.ndarray, degree: int = DEGREE, pool: int = POOL, slack: float = SLACK) -> np.ndarray:
    """Robust pruning of every row's candidates: (n, 2 * degree + NEAREST) neighbours, -1 where there are no more.

    Candidates are the nearest others and some at growing ranks, so that a tight group also gets ways out.  Distances are
    chords.  Going outwards, a candidate is kept unless ``slack`` times its distance to a kept neighbour is at most its
    distance to the point.  The NEAREST first ones are kept in any case: around a hub, pruning alone leaves a star.  A kept
    neighbour links back, for the ``degree`` closest that chose it, so that a tight group also has ways in."""
    n = len(sims)
    out = np.full((n, degree), -1)
    if n < 2:
        return out
    masked = sims.copy()
    np.fill_diagonal(masked, -2)
    ranks = np.unique(np.concatenate([np.arange(pool // 2), np.geomspace(pool // 2, n - 1, pool // 2).astype(int)]))
    ranks = ranks[ranks < n - 1] if n > 2 else np.array([0])
    c = len(ranks)
    near = np.argsort(-masked, axis=1, kind="stable")[:, ranks]
    far = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(masked, near, 1)))
    alive, count = np.ones((n, c), bool), np.zeros(n, int)
    rows = np.arange(n)
    for k in range(c):
        ok = alive[:, k] & (count < degree)
        out[rows[ok], count[ok]] = near[ok, k]
        count[ok] += 1
        between = np.sqrt(np.maximum(0, 2 - 2 * sims[near[:, k:k + 1], near[:, k + 1:]]))
        alive[:, k + 1:] &= ~(ok[:, None] & (slack * between <= far[:, k + 1:]))
    out = np.concatenate([out, near[:, :NEAREST]], axis=1)
    u, k = np.nonzero(out >= 0)
    v = out[u, k]
    key = np.unique(u * n + v)
    u, v = key // n, key % n
    by = np.lexsort((-sims[v, u], v))
    u, v = u[by], v[by]
    slot = np.arange(len(v)) - np.searchsorted(v, v)
    back = np.full((n, degree), -1)
    back[v[slot < degree], slot[slot < degree]] = u[slot < degree]
    return np.concatenate([out, back], axis=1)


def _lists(rows: pd.DataFrame) -> pd.DataFrame:
    x = _unit(rows["embedding"])
    pid = rows["pid"].to_numpy()
    near = prune(x @ x.T)
    return pd.DataFrame({"pid": pid, "near": [pid[np.unique(r[r >= 0])] for r in near]})


def medoids(x, count: int = MEDOIDS) -> np.ndarray:
    """Entry points: the point nearest to the mean, then again and again the one farthest from those before it."""
    out = [int((x @ x.mean(axis=0)).argmax())]
    close = x @ x[out[0]]
    while len(out) < min(count, len(x)):
        out.append(int(close.argmin()))
        close = np.maximum(close, x @ x[out[-1]])
    return np.unique(out)


def search(x, links, q, within: float, beam: int = BEAM):
    """Boolean (queries, points): what the range-expanding greedy search over ``links`` finds for each query.

    All queries walk together.  From the medoids each expands its best open point until its ``beam`` best are expanded;
    then every found point within the range has its neighbours looked at until nothing new is within."""
    n, m = len(x), len(q)
    starts = medoids(x)
    seen, done, found = np.zeros((m, n), bool), np.zeros((m, n), bool), np.zeros((m, n), bool)
    width = min(max(beam, len(starts)), n)
    ids, sims = np.full((m, width), -1), np.full((m, width), -3.0)
    first = q @ x[starts].T
    ids[:, :len(starts)], sims[:, :len(starts)] = starts, first
    seen[:, starts] = True
    found[:, starts] = first >= within

    def look(row, at):
        """New neighbours of points ``at`` for queries ``row``: (query, point, cosine)."""
        to = links[at]
        r = np.repeat(row, to.shape[1])
        to = to.ravel()
        ok = to >= 0
        r, to = r[ok], to[ok]
        ok = ~seen[r, to]
        key = np.unique(r[ok] * n + to[ok])
        r, to = key // n, key % n
        seen[r, to] = True
        cos = np.einsum("ij,ij->i", q[r], x[to])
        found[r, to] = cos >= within
        return r, to, cos

    rows = np.arange(m)
    while len(rows):
        open_ = np.where((ids[rows] >= 0) & ~done[rows[:, None], ids[rows]], sims[rows], -4)
        best = open_.argmax(axis=1)
        some = open_[np.arange(len(rows)), best] > -4
        rows, best = rows[some], best[some]
        if not len(rows):
            break
        at = ids[rows, best]
        done[rows, at] = True
        r, to, cos = look(rows, at)
        if len(r):
            new = np.unique(r)
            per = np.bincount(r, minlength=m)
            wide = per.max()
            more_ids, more_sims = np.full((m, wide), -1), np.full((m, wide), -3.0)
            slot = np.arange(len(r)) - np.repeat(np.concatenate([[0], np.cumsum(per)[:-1]]), per)
            more_ids[r, slot], more_sims[r, slot] = to, cos
            all_ids = np.concatenate([ids[new], more_ids[new]], axis=1)
            all_sims = np.concatenate([sims[new], more_sims[new]], axis=1)
            top = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            ids[new], sims[new] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_sims, top, 1)
    r, at = np.nonzero(found & ~done)
    while len(r):
        fresh_r, fresh_at = [], []
        for cut in range(0, len(r), 50_000):
            rr, aa = r[cut:cut + 50_000], at[cut:cut + 50_000]
            done[rr, aa] = True
            a, b, cos = look(rr, aa)
            ok = cos >= within
            fresh_r.append(a[ok])
            fresh_at.append(b[ok])
        r, at = np.concatenate(fresh_r), np.concatenate(fresh_at)
    return found


def _roots(rows, cols, n):
    """Smallest reachable node of n nodes by links rows - cols."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, rows, label[cols])
        np.minimum.at(low, cols, label[rows])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _found(points: DataFrame, members: DataFrame, within: float) -> DataFrame:
    """(pid, root, found): of each point in the blocks of its home cell, the number of other vectors found; what points of
    other cells found of it that it cannot find itself; and links (pid, root) of the points that are linked inside a block."""
    at_home = F.col("home") == F.col("cell")
    sizes = members.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum(at_home.cast("long")).alias("homes"))
    sizes = settle(sizes.select("cell", F.ceil(F.col("n") / BLOCK).alias("blocks"),
                                F.greatest(F.lit(1), F.ceil(F.col("homes") / QUERIES)).alias("turns")))
    placed = settle(members.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("pid"), F.col("blocks"))))
    lists = placed.select("cell", "block", "pid", "embedding").groupBy("cell", "block").applyInPandas(_lists, "pid long, near array<long>")
    united = lists.groupBy("pid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    zero = F.lit(0).cast("long")
    here = placed.join(united, "pid").withColumn("turn", F.explode(F.sequence(zero, F.col("turns") - 1))).select(
        "cell", "block", "turn", "pid", "mult", "embedding", "near", "home")
    asked = placed.filter(at_home).withColumn("turn", F.pmod(F.xxhash64("pid", F.lit(1)), F.col("turns")))
    asked = asked.withColumn("to", F.explode(F.sequence(zero, F.col("blocks") - 1))).select(
        F.col("cell").alias("q_cell"), F.col("to").alias("q_block"), F.col("turn").alias("q_turn"), F.col("pid").alias("q"),
        F.col("embedding").alias("q_embedding"), F.col("mult").alias("q_mult"), F.col("cells").alias("q_cells"))

    def run(left, right):
        none = pd.DataFrame({"pid": [], "root": [], "found": []}, dtype="int64")
        if not len(left) or not len(right):
            return none
        pid, x = left["pid"].to_numpy(), _unit(left["embedding"])
        by = np.argsort(pid)
        links = np.full((len(pid), max(map(len, left["near"])) or 1), -1)
        for k, near in enumerate(left["near"]):
            at = by[np.minimum(np.searchsorted(pid, near, sorter=by), len(pid) - 1)]
            at = at[pid[at] == near]  # the united lists also name points of other blocks
            links[k, :len(at)] = at
        asks, q = right["q"].to_numpy(), _unit(right["q_embedding"])
        found = search(x, links, q, within)
        found &= asks[:, None] != pid[None, :]
        counts = (found * left["mult"].to_numpy()[None, :]).sum(axis=1)
        homes, of = np.unique(left["home"].to_numpy(), return_inverse=True)
        known = np.zeros((len(asks), len(homes)), bool)  # does the home cell of a found point hold the asking one?
        row = np.repeat(np.arange(len(asks)), right["q_cells"].map(len))
        its = np.concatenate(right["q_cells"].tolist())
        slot = np.minimum(np.searchsorted(homes, its), len(homes) - 1)
        same = homes[slot] == its
        known[row[same], slot[same]] = True
        back = ((found & ~known[:, of]) * right["q_mult"].to_numpy()[:, None]).sum(axis=0)
        met = np.flatnonzero(back)
        r, c = np.nonzero(found)
        keys = np.unique(np.concatenate([asks, pid]))
        label = _roots(np.searchsorted(keys, asks[r]), np.searchsorted(keys, pid[c]), len(keys))
        tied = np.flatnonzero(label != np.arange(len(keys)))
        return pd.DataFrame({"pid": np.concatenate([asks, pid[met], keys[tied]]),
                             "root": np.concatenate([asks, pid[met], keys[label[tied]]]),
                             "found": np.concatenate([counts, back[met], np.zeros(len(tied), np.int64)])})

    return here.groupBy("cell", "block", "turn").cogroup(asked.groupBy("q_cell", "q_block", "q_turn")).applyInPandas(
        run, "pid long, root long, found long")


def audited(points: DataFrame, counts: DataFrame, total: int) -> pd.DataFrame:
    """(pid, embedding, found) of AUDITED + PER_ROOT * sqrt(total) points, those of the smallest hashes of each stratum; a stratum is
    the number of links found, by doublings, and all have equal shares, so that a hot group is one of many."""
    size = AUDITED + int(PER_ROOT * total ** 0.5)
    level = F.when(F.col("found") > 0, F.floor(F.log2("found")) + 1).otherwise(0)
    known = settle(points.join(counts, "pid", "left").select("pid", "embedding", F.coalesce("found", F.lit(0)).alias("found")).withColumn(
        "level", level.cast("int")))
    levels = [r["level"] for r in known.select("level").distinct().collect()]  # at most 64
    parts = [known.filter(F.col("level") == k).orderBy(F.xxhash64("embedding", F.lit(7)), "pid").limit(-(-size // len(levels)))
             for k in levels]
    return pd.concat([p.select("pid", "embedding", "found").toPandas() for p in parts]) if parts else pd.DataFrame({"pid": []})


def audit(points: DataFrame, some: pd.DataFrame, within: float) -> float:
    """Recall of the audited points: of those that an exhaustive comparison finds links of, the mean share found."""
    if not len(some):
        return 1.0
    by = {dim: (part["pid"].to_numpy(), _unit(part["embedding"])) for dim, part in some.groupby(some["embedding"].map(len))}

    def run(batches):
        for batch in batches:
            pid, mult, rows = (batch.column(k).to_pylist() for k in range(3))
            pid, mult, sums = np.array(pid), np.array(mult), {}
            size = np.array([len(r) for r in rows])
            for dim, (keys, q) in by.items():
                these = np.flatnonzero(size == dim)
                for cut in range(0, len(these), 256):
                    at = these[cut:cut + 256]
                    near = (q @ _unit([rows[k] for k in at]).T >= within) & (keys[:, None] != pid[at][None, :])
                    for a, n in enumerate((near * mult[at][None, :]).sum(axis=1)):
                        if n:
                            sums[int(keys[a])] = sums.get(int(keys[a]), 0) + int(n)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], ["pid", "n"])

    truth = points.select("pid", "mult", "embedding").mapInArrow(run, "pid long, n long").groupBy("pid").agg(F.sum("n").alias("n"))
    met = truth.toPandas().merge(some[["pid", "found"]], on="pid")  # at most one row for each audited point
    return float(np.minimum(1, met["found"] / met["n"]).mean()) if len(met) else 1.0


def planted(some: pd.DataFrame, leaders: dict, overlap: int | None, within: float) -> float:
    """The share of audited points that would meet a neighbour just within the range, planted in a random direction: one of the two
    must be a member of the other's home cell.  It measures the cells where real links are too rare to."""
    rng, met, asked = np.random.default_rng(5), 0, 0
    for dim, part in some.groupby(some["embedding"].map(len)) if len(some) else ():
        if dim not in leaders or dim < 2:
            continue
        x = _unit(part["embedding"])
        side = rng.normal(size=x.shape)
        side -= (side * x).sum(axis=1, keepdims=True) * x
        y = within * x + np.sqrt(max(0.0, 1 - within * within)) * side / np.sqrt((side * side).sum(axis=1, keepdims=True))
        pairs = zip(cells_of(x, leaders[dim], overlap, within), cells_of(y, leaders[dim], overlap, within))
        met += sum(a[0] in b or b[0] in a for a, b in pairs)
        asked += len(x)
    return met / asked if asked else 1.0


def near_vectors(vectors: DataFrame, within: float = 0.95, overlap: tuple = OVERLAP) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row: vectors found directly linked (cosine >= ``within`` in double
    precision), the smallest vec_id that links reach, and whether that is the row's own.

    A vector that is null, zero, or holds a null or non-finite component links with nothing.  Vectors of different
    length don't link.  Equal vectors link.  Raises where the audited recall stays below LEAST_RECALL.  Rows that repeat a vec_id are separate vectors; a null vec_id takes part,
    and a component of null ids only has a null id and is not kept.  An empty table gives no rows; other columns are
    ignored.
    """
    # Floats travel as floats, every other kind as doubles.
    kind = "float" if vectors.schema["embedding"].dataType == ArrayType(FloatType()) else "double"
    given = vectors.select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    points = settle(points_of(given))
    total = points.count()
    leaders = leaders_of(points, max(1, min(LEADERS, total // PER_LEADER)))
    for cells in overlap:
        found = settle(_found(points, members_of(points, leaders, cells, within), within))
        counts = found.groupBy("pid").agg(F.sum("found").alias("found"))
        some = audited(points, counts, total)
        recall = min(audit(points, some, within), planted(some, leaders, cells, within))
        if recall >= RECALL:
            break
    if recall < LEAST_RECALL:
        raise RuntimeError(f"recall of near vectors is {recall:.3f} in the last attempt; {LEAST_RECALL} is wanted")
    roots = components(found.filter("pid != root").select(F.col("pid").alias("u"), F.col("root").alias("v")))
    per = points.join(roots.withColumnRenamed("node", "pid"), "pid", "left").withColumn("root", F.coalesce("root", "pid"))
    least = per.groupBy("root").agg(F.min("least").alias("component_id"))
    of = per.join(least, "root").join(counts, "pid", "left").select(
        F.col("embedding").alias("_e"), "component_id", (F.coalesce("found", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    out = given.join(of, F.col("embedding") == F.col("_e"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("_e").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
