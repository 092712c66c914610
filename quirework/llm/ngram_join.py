"""Exact Jaccard join of word n-gram sets by a token-group matrix.

1. Every text becomes its set of hashed n-grams; equal sets form a class, which is joined once.
2. Classes with the same smallest hash (similar sets mostly have it in common) are dealt to units of bounded size and
   compared with each other inside; the parts that links hold together are compared once more across the units of
   one hash.  A unit of one part belongs to the part's group; a unit of several parts is a group by itself, named apart
   from all parts, and so is a class that shares its smallest hash with no other.
3. The matrix holds, for every group, the union of its members' prefixes: of a set's n-grams in one global order, rare
   ones first, as many as two sets must share ``SHARED`` of when they are similar.  Groups that meet in fewer columns,
   or whose sizes are too far apart, cannot hold a similar pair; the others are candidates.
4. Candidate groups are opened: their members' whole sets are compared exactly, until all their parts are linked.
5. Links between parts make components.

A family of near copies costs links in proportion to its size, as parts that are linked are not compared again.
"""

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.plans.settle import settle

from .common import bitmap, claim, components, discard, maybe, stored

#: n-grams that the prefixes of two similar sets share at least.
SHARED = 3
#: Members of a unit; parts compared across units; hashes whose classes are split by a broadcast list; n-grams with a
#: known frequency; rows of the matrix in one task.  They bound memory and broadcasts (a few MB); none changes the result.
MEMBERS, PARTS, SPLIT, FREQUENT, TASK_ROWS = 256, 1024, 200_000, 100_000, 500_000
_MASK = np.uint64((1 << 48) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(h):
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_sets(texts: list, size: int = 5) -> list:
    """Sorted distinct 48-bit hashes of the word n-grams of each UTF-8 text (bytes or None).  Words are runs of other
    bytes than space and tab to carriage return, A-Z lower-cased; a text of fewer words has its whole sequence as one
    n-gram, one without words none."""
    cut = [t.lower().split() if t else [] for t in texts]
    flat = [w for words in cut for w in words]
    if not flat:
        return [np.empty(0, np.uint64) for _ in texts]
    hashed = pd.util.hash_array(np.array(flat, object), categorize=True)
    out, at = [], 0
    with np.errstate(over="ignore"):
        for words in cut:
            h = hashed[at:at + len(words)]
            at += len(words)
            if len(h) >= size:
                n = len(h) - size + 1
                grams = np.zeros(n, np.uint64)
                for k in range(size):
                    grams = _mix(grams * _STEP + h[k:k + n])
            elif len(h):
                grams = np.array([len(h)], np.uint64)
                for k in range(len(h)):
                    grams = _mix(grams * _STEP + h[k:k + 1])
            else:
                grams = np.empty(0, np.uint64)
            out.append(np.unique(grams & _MASK))
    return out


def _slices(batches, rows=1024):
    """Arrow batches in small slices: a task holds the sets of one slice at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _six(grams) -> bytes:
    """48-bit numbers as 6 bytes each."""
    return grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _eight(data) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def _stack(sets):
    """All members of some sets in a row, and the cuts between them."""
    cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), cuts


def _common(one, many, cuts):
    """Sizes of the intersections of a sorted set with each of the sets in ``many``."""
    spot = np.minimum(np.searchsorted(one, many), len(one) - 1)
    hits = np.concatenate([[0], np.cumsum(one[spot] == many)])
    return hits[cuts[1:]] - hits[cuts[:-1]]


def _similar(shared, a, b, percent):
    return 100 * shared >= percent * (a + b - shared)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, cls, set, often): ``set`` only on a task's first row of a class; ``often`` lists a batch's n-grams
    that many of its sets hold, with counts."""
    def run(batches):
        claim("ngrams")
        seen = set()
        kind = pa.list_(pa.struct([("gram", pa.int64()), ("n", pa.int64())]))
        for batch in _slices(batches):
            n, cls, sets, fresh = [], [], [], []
            for grams in gram_sets(batch.column(1).cast(pa.binary()).to_pylist(), size):
                n.append(len(grams))
                if not len(grams):
                    cls.append(None)
                    sets.append(None)
                    continue
                key = hashlib.blake2b(grams.tobytes(), digest_size=8).digest()
                cls.append(int.from_bytes(key, "little", signed=True))
                sets.append(None if key in seen else _six(grams))
                if key not in seen:
                    seen.add(key)
                    fresh.append(grams)
            often = [None] * len(n)
            if fresh:
                grams, counts = np.unique(np.concatenate(fresh), return_counts=True)
                many = counts >= 4
                pairs = zip(grams[many].astype(np.int64).tolist(), counts[many].tolist())
                often[0] = [{"gram": g, "n": c} for g, c in pairs]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sets, pa.binary()), pa.array(often, kind)],
                ["doc_id", "n", "cls", "set", "often"])

    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return cols.mapInArrow(run, "doc_id long, n long, cls long, set binary, often array<struct<gram:bigint,n:bigint>>")


class Order:
    """The global order of n-grams: those not known as frequent by hash, then the frequent ones by count and hash."""

    def __init__(self, grams, counts, percent):
        by = np.argsort(grams)
        self.grams, self.counts, self.percent = grams[by], counts[by], percent

    def least(self, n):
        """Members that a set of size n shares at least with a similar one."""
        return -(-self.percent * n // 100)

    def prefix(self, grams):
        n = len(grams)
        take = min(n, n - self.least(n) + SHARED)
        if not len(self.grams):
            return grams[:take]
        spot = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        known = self.grams[spot] == grams
        if not known.any():
            return grams[:take]
        rare = grams[~known]
        if len(rare) >= take:
            return rare[:take]
        rest, counts = grams[known], self.counts[spot[known]]
        return np.concatenate([rare, rest[np.lexsort((rest, counts))]])[:take]


def _order(sets: DataFrame, percent: int) -> Order:
    counts = sets.select(F.inline("often")).groupBy("gram").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "gram").limit(FREQUENT).toPandas()
    return Order(rows["gram"].to_numpy(np.uint64), rows["n"].to_numpy(np.int64), percent)


def _first(sets: DataFrame) -> DataFrame:
    """(head, cls) of every class: the smallest of its hashes."""
    def run(batches):
        for batch in _slices(batches):
            heads = [int(_eight(s.as_buffer()[:6])[0]) for s in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(heads, pa.int64()), batch.column(0)], ["head", "cls"])

    return sets.select("cls", "set").mapInArrow(run, "head long, cls long").distinct()


def _parts(members, percent) -> np.ndarray:
    """Part of each set: sets that links reach from one another; a part is named by one of its places."""
    label = np.arange(len(members))
    sizes = np.array([len(m) for m in members])
    for k in np.argsort(sizes, kind="stable")[::-1].tolist():
        other = np.flatnonzero((label != label[k]) & (100 * sizes >= percent * sizes[k]) & (100 * sizes[k] >= percent * sizes))
        if len(other):
            flat, cuts = _stack([members[o] for o in other.tolist()])
            near = other[_similar(_common(members[k], flat, cuts), sizes[k], sizes[other], percent)]
            for name in np.unique(label[near]).tolist():
                label[label == name] = label[k]
    return label


def _compared(rows: DataFrame, keys: list, order: "Order", unit: bool) -> DataFrame:
    """(head, unit, cls, part, set, columns) of classes that are compared with all others of the same keys.  ``part`` is
    the class that names the part; with ``unit``, ``columns`` holds the union of prefixes on the unit's first row.  Classes
    that have less than half in common (they only share a passage) gain nothing as a unit: then each part is one."""
    percent = order.percent

    def run(given):
        given = given.drop_duplicates("cls").sort_values("cls").reset_index(drop=True)
        cls, members = given["cls"].to_numpy(), [_eight(s) for s in given["set"]]
        out = given[["head"]].copy()
        out["unit"], out["cls"], out["part"], out["set"] = cls[0], cls, cls[_parts(members, percent)], given["set"]
        columns = [None] * len(out)
        if unit:
            prefixes = [order.prefix(m) for m in members]
            flat = np.concatenate(members)
            if 2 * len(np.unique(flat)) > len(flat):
                out["unit"] = out["part"]
            for name, places in out.groupby("unit").indices.items():
                sizes = [len(members[k]) for k in places]
                data = np.array([min(sizes), max(sizes)], "<u8").tobytes()
                columns[places[0]] = data + _six(np.unique(np.concatenate([prefixes[k] for k in places])))
        out["columns"] = pd.Series(columns, dtype=object)
        return out

    return rows.groupBy(*keys).applyInPandas(run, "head long, unit long, cls long, part long, set binary, columns binary")


def _grouped(sets: DataFrame, order: "Order", bits, large: dict) -> tuple[DataFrame, str]:
    """(grp, unit, cls, part, set, columns) of the classes that share their smallest hash, and the stored table that
    it reads."""
    def pick(batches):
        for batch in _slices(batches):
            heads = np.array([int(_eight(s.as_buffer()[:6])[0]) for s in batch.column(1)], np.int64)
            keep = np.flatnonzero(maybe(bits, heads))
            cls = batch.column(0).to_numpy(zero_copy_only=False)[keep]
            chunk = [c % large.get(h, 1) for h, c in zip(heads[keep].tolist(), cls.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(heads[keep]), pa.array(chunk, pa.int64()), pa.array(cls), batch.column(1).take(pa.array(keep))],
                ["head", "chunk", "cls", "set"])

    picked = sets.select("cls", "set").mapInArrow(pick, "head long, chunk long, cls long, set binary")
    first, first_at = stored(_compared(picked, ["head", "chunk"], order, True))
    named = first.filter(F.col("cls") == F.col("part"))
    many = named.groupBy("head").agg(F.count_distinct("unit").alias("units"), F.count(F.lit(1)).alias("n")).filter("units > 1")
    again = named.join(many, "head").withColumn("chunk", F.pmod(F.col("cls"), F.ceil(F.col("n") / PARTS)))
    joined = _compared(again.select("head", "chunk", "cls", "set"), ["head", "chunk"], order, False)
    renamed = settle(joined.select(F.col("cls").alias("part"), F.col("part").alias("whole")))
    parts = first.select("unit", "cls", "part").join(renamed, "part", "left").select(
        "unit", "cls", F.coalesce("whole", "part").alias("part"))
    units = parts.groupBy("unit").agg(F.min("part").alias("_low"), F.max("part").alias("_high"))
    # A unit is named by a class, as parts are: hashed with its kind, a unit of several parts never shares a part's group.
    group = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.xxhash64(F.lit("unit"), "unit"))
    labels = parts.join(units, "unit").select("cls", "part", group.alias("grp"))
    return first.select("unit", "cls", "set", "columns").join(labels, "cls"), first_at


def _singles(sets: DataFrame, order: Order, bits) -> DataFrame:
    """(grp, columns) of the classes that share their smallest hash with no other."""
    def run(batches):
        for batch in _slices(batches):
            cls, out = batch.column(0).to_pylist(), []
            for key, data in zip(cls, batch.column(1).to_pylist()):
                grams = _eight(data)
                if not maybe(bits, grams[:1])[0]:
                    out.append((key, np.array([len(grams)] * 2, "<u8").tobytes() + _six(order.prefix(grams))))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([c for _, c in out], pa.binary())],
                                             ["grp", "columns"])

    return sets.select("cls", "set").mapInArrow(run, "grp long, columns binary")


#: A row of the matrix: n-gram, group, and the group's smallest and largest size as steps of 6 %.
_ENTRY = np.dtype([("gram", "u1", 6), ("grp", "<i8"), ("low", "u1"), ("high", "u1")])
_LOG = math.log(1.06)


def _candidates(columns: DataFrame, order: Order, tasks: int) -> DataFrame:
    """(a, b) of the groups that may hold a similar pair."""
    def deal(batches):
        for batch in _slices(batches):
            grams, groups, low, high = [], [], [], []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                least, most = np.frombuffer(data, "<u8", 2).tolist()
                got = _eight(data[16:])
                grams.append(got)
                groups.append(np.full(len(got), key, np.int64))
                low.append(np.full(len(got), min(254, int(math.log(least) / _LOG)), np.uint8))
                high.append(np.full(len(got), min(255, int(math.log(most) / _LOG) + 1), np.uint8))
            if not grams:
                continue
            flat = np.concatenate(grams)
            table = np.empty(len(flat), _ENTRY)
            table["gram"] = flat.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            table["grp"], table["low"], table["high"] = (np.concatenate(x) for x in (groups, low, high))
            place = (_mix(flat) % np.uint64(tasks)).astype(np.int64)
            by = np.argsort(place, kind="stable")
            table, place = table[by], place[by]
            cuts = np.flatnonzero(np.diff(place)) + 1
            starts = np.concatenate([[0], cuts])
            yield pa.RecordBatch.from_arrays(
                [pa.array(place[starts], pa.int64()), pa.array([x.tobytes() for x in np.split(table, cuts)], pa.binary())],
                ["place", "entries"])

    def meet(batches):
        held = [d for batch in batches for d in batch.column(1).to_pylist()]
        if not held:
            return
        table = np.frombuffer(b"".join(held), _ENTRY)
        raw = np.zeros((len(table), 8), np.uint8)
        raw[:, :6] = table["gram"]
        gram, grp = raw.view("<u8").ravel(), table["grp"].copy()
        by = np.lexsort((grp, gram))
        gram, grp, low, high = gram[by], grp[by], table["low"][by].astype(np.int64), table["high"][by].astype(np.int64)
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (grp[1:] != grp[:-1])
        at = np.flatnonzero(new)
        low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
        gram, grp = gram[at], grp[at]
        several = np.zeros(len(gram), bool)
        several[1:] = gram[1:] == gram[:-1]
        several[:-1] |= several[1:]
        gram, grp, low, high = gram[several], grp[several], low[several], high[several]
        by = np.lexsort((low, gram))  # by size within a column: who is too large for one is so for all smaller ones
        gram, grp, low, high = gram[by], grp[by], low[by], high[by]
        reach = math.log(100 / order.percent) / _LOG
        live, step, held, size = np.arange(len(gram)), 1, [], 0
        while len(live):
            live = live[live + step < len(gram)]
            other = live + step
            ok = gram[live] == gram[other]
            live, other = live[ok], other[ok]
            far = (low[other] > high[live] + reach) & (high[live] < 255)
            live, other = live[~far], other[~far]
            a, b = np.minimum(grp[live], grp[other]), np.maximum(grp[live], grp[other])
            small = 1.06 ** np.maximum(low[live], low[other])  # at most the larger of the two smallest sizes
            need = np.minimum(SHARED, np.ceil(small * order.percent / 100 - 1e-9)).astype(np.int64)
            held.append((a, b, need))
            size += len(a)
            step += 1
            if size > 1_000_000 or not len(live):
                yield _counted(held)
                held, size = [], 0

    def _counted(held):
        a, b, need = (np.concatenate(x) for x in zip(*held))
        by = np.lexsort((b, a))
        a, b, need = a[by], b[by], need[by]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        at = np.flatnonzero(new)
        count = np.diff(np.append(at, len(a)))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a[at], b[at], count, need[at])], ["a", "b", "n", "need"])

    dealt = columns.select("grp", "columns").mapInArrow(deal, "place long, entries binary")
    met = dealt.repartition(tasks, "place").mapInArrow(meet, "a long, b long, n long, need long")
    summed = met.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need"))
    return summed.filter(F.col("n") >= F.col("need")).select("a", "b")


def _links(pairs: DataFrame, grouped: DataFrame, sets: DataFrame, order: Order, bits) -> DataFrame:
    """(u, v): parts of candidate groups that hold a similar pair."""
    wanted = bitmap(pairs.select(F.explode(F.array("a", "b")).alias("g")), "g")
    percent = order.percent

    def alone(batches):
        for batch in _slices(batches):
            keep = maybe(wanted, batch.column(0).to_numpy(zero_copy_only=False))
            heads = np.array([int(_eight(s.as_buffer()[:6])[0]) for s in batch.column(1)], np.int64)
            rows = pa.array(np.flatnonzero(keep & ~maybe(bits, heads)))
            cls = batch.column(0).take(rows)
            yield pa.RecordBatch.from_arrays([cls, cls, cls, batch.column(1).take(rows)], ["grp", "unit", "part", "set"])

    single = sets.select("cls", "set").mapInArrow(alone, "grp long, unit long, part long, set binary").dropDuplicates(["grp"])
    members = grouped.select("grp", "unit", "part", "set").unionByName(single)
    sizes = grouped.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sized = pairs.join(sizes.select(F.col("grp").alias("a"), F.col("n").alias("na")), "a", "left").join(
        sizes.select(F.col("grp").alias("b"), F.col("n").alias("nb")), "b", "left")
    swap = F.coalesce("nb", F.lit(1)) > F.coalesce("na", F.lit(1))  # the smaller group is sent to the larger one's units
    turned = settle(sized.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"),
                                 F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"),
                                 F.least(F.coalesce("na", F.lit(1)), F.coalesce("nb", F.lit(1))).alias("sets")))
    per = turned.groupBy("a").agg(F.ceil(F.sum("sets") / MEMBERS).alias("turns"))
    here = members.join(per.withColumnRenamed("a", "grp"), "grp").withColumn(
        "turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))).select(
        F.col("unit").alias("here"), F.col("grp").alias("here_grp"), F.col("turn").alias("here_turn"), "part", F.col("set").alias("mine"))
    units = grouped.select("grp", "unit").distinct().withColumnRenamed("grp", "a")
    sent = turned.drop("sets").join(per, "a").withColumn("turn", F.pmod(F.xxhash64("b"), F.col("turns"))).join(units, "a", "left").withColumn(
        "unit", F.coalesce("unit", "a"))
    sent = sent.join(members.select(F.col("grp").alias("b"), F.col("part").alias("their_part"), F.col("set").alias("theirs")), "b").select(
        F.col("unit").alias("there"), F.col("a").alias("there_grp"), F.col("turn").alias("there_turn"), "b", "their_part", "theirs")

    def compare(left, right):
        mine, parts = [_eight(s) for s in left["mine"]], left["part"].to_numpy()
        sizes, out = np.array([len(m) for m in mine]), []
        for _, some in right.groupby("b"):
            names = np.unique(np.concatenate([parts, some["their_part"].to_numpy()]))
            label = np.arange(len(names))
            ours = np.searchsorted(names, parts)
            for theirs, data in zip(np.searchsorted(names, some["their_part"].to_numpy()).tolist(), some["theirs"]):
                n = len(data) // 6
                open_ = np.flatnonzero((label[ours] != label[theirs]) & (100 * sizes >= percent * n) & (100 * n >= percent * sizes))
                if not len(open_):
                    continue
                flat, cuts = _stack([mine[k] for k in open_.tolist()])
                near = _similar(_common(_eight(data), flat, cuts), n, sizes[open_], percent)
                for name in np.unique(ours[open_[near]]).tolist():
                    out.append((names[name], names[theirs]))
                    label[label == label[name]] = label[theirs]
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    keys = ["here", "here_grp", "here_turn"], ["there", "there_grp", "there_turn"]
    return here.groupBy(*keys[0]).cogroup(sent.groupBy(*keys[1])).applyInPandas(compare, "u long, v long")


def similar_groups(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the size of its n-gram set and the smallest doc_id that links
    reach from it, itself included, where two documents link when 100 * |A and B| >= percent * |A or B|.

    Null or wordless text: size 0, linked with nothing, its own component.  Rows with a null id take part; such a row's
    component is the smallest id of those it is linked with, null if none has one.  Rows that repeat an id are separate
    documents.  An empty table gives no rows; other columns are ignored.
    """
    whole, sets_at = stored(_sets(docs, size))
    sets = whole.filter(F.col("set").isNotNull()).select("cls", "set")
    order = _order(whole, percent)
    heads = settle(_first(sets).groupBy("head").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    bits = bitmap(heads, "head")
    crowded = heads.filter(F.col("n") > MEMBERS).orderBy(F.desc("n"), "head").limit(SPLIT).collect()
    large = {r["head"]: -(-r["n"] // MEMBERS) for r in crowded}
    joined, first_at = _grouped(sets, order, bits, large)
    grouped, grouped_at = stored(joined)
    discard(docs.sparkSession, first_at)
    columns = grouped.filter(F.col("columns").isNotNull()).select("grp", "columns").unionByName(_singles(sets, order, bits))
    grams = whole.filter(F.col("set").isNotNull()).agg(F.sum("n")).first()[0] or 0
    tasks = max(8, int(grams * (100 - percent) / 100 / TASK_ROWS))
    pairs = settle(_candidates(columns, order, tasks))
    links = settle(_links(pairs, grouped, sets, order, bits))
    # Only the classes are needed from here on: the sets, by far the largest tables, make room.
    table, grouped = settle(whole.select("doc_id", "n", "cls")), settle(grouped.select("cls", "part"))
    discard(docs.sparkSession, sets_at, grouped_at)
    roots = components(links)
    moved = grouped.select("cls", F.col("part").alias("node")).join(roots, "node", "left").select(
        "cls", F.coalesce("root", "node").alias("root"))
    known = moved.unionByName(roots.select(F.col("node").alias("cls"), "root")).dropDuplicates(["cls"])
    per = table.filter(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("doc_id").alias("least"))
    per = per.join(known, "cls", "left").select("cls", F.coalesce("root", "cls").alias("root"), "least")
    least = per.groupBy("root").agg(F.min("least").alias("component_id"))
    of = per.select("cls", "root").join(least, "root").select("cls", "component_id")
    linked = table.select("doc_id", "n", "cls").join(of, "cls", "left")
    return linked.select("doc_id", F.col("n").alias("n_shingles"),
                         F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
