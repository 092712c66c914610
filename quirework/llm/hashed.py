"""Hashed terms of texts and the bounded labelled sample that classifiers learn from."""

import re
import zlib
from collections import Counter
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.plans.settle import settle

from .common import claim, in_fold

BUCKETS = 1 << 18
#: Labelled rows that a model learns from at most, and buckets with a weight at most.  Both bound what is collected.
TRAIN_ROWS, KEPT_TERMS = 16_384, 8_192
#: Pieces whose buckets a worker keeps.
_CACHED = 100_000
#: Characters of a shape: longer pieces have a shape for each window of so many.
WINDOW = 64
_TABLES = {}
_WORD = re.compile(r"\w+")
_RUN = re.compile(r"(.)\1+")


_MASK = BUCKETS - 1
_FOUR, _FIVE = zlib.crc32(b"4:"), zlib.crc32(b"5:")


def bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) & _MASK


def word_terms(piece: str) -> tuple:
    """Buckets of the words of a lower-cased piece and of their beginnings, which catch inflected forms."""
    out = []
    for w in (piece,) if piece.isalnum() else _WORD.findall(piece):
        out.append(bucket(w))
        # crc32 goes on from the checksum of the mark before a beginning.
        if len(w) > 4:
            out.append(zlib.crc32(w[:4].encode("utf-8", "surrogatepass"), _FOUR) & _MASK)
        if len(w) > 5:
            out.append(zlib.crc32(w[:5].encode("utf-8", "surrogatepass"), _FIVE) & _MASK)
    return tuple(out)


class Kinds(dict):
    """Code point -> kind of character, for ``str.translate``."""

    def __missing__(self, point):
        c = chr(point)
        out = self[point] = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        return out


_KINDS = Kinds()


def shape(kinds: str) -> str:
    """A piece's kinds of characters with runs as one: ``THE!!`` is ``A!``, ``Word,`` is ``Aa,``."""
    return _RUN.sub(r"\1", kinds)


class Cached(dict):
    """A bounded table of a function's results."""

    def __init__(self, fn):
        super().__init__()
        self.fn = fn

    def __missing__(self, key):
        if len(self) >= _CACHED:
            self.clear()
        out = self[key] = self.fn(key)
        return out


def presence(text, table) -> dict:
    """{bucket: 1} of the words of a whole text."""
    return dict.fromkeys(chain.from_iterable(map(table.__getitem__, set((text or "").lower().split()))), 1.0)


def style(text, table) -> dict:
    """{bucket: value}: the words, as in ``presence``, and how the text is written: root shares of word shapes, share of
    words equal to the one before, of distinct words and of distinct lines in tenths, and length by doublings.  A piece of
    more than WINDOW characters, as in text without spaces, counts as its consecutive windows in the shares of shapes."""
    text = text or ""
    words_, shapes = table
    pieces = text.split()
    counts = Counter(pieces)
    out = presence(" ".join(counts), words_)
    n = len(pieces)
    share = Counter()
    # No kind is white space but white space itself, so the kinds of a text fall into the same pieces; few differ.
    for kinds, k in Counter(text.translate(_KINDS).split()).items():
        for at in range(0, len(kinds), WINDOW):
            share[shapes[kinds[at:at + WINDOW]]] += k
    total = share.total()
    for b, k in share.items():
        out[b] = (k / total) ** 0.5
    same = sum(map(eq, pieces, pieces[1:]))
    lines = text.split("\n")
    for name, part in (("same", same / max(1, n)), ("distinct", len(counts) / max(1, n)), ("lines", len(set(lines)) / len(lines))):
        out[bucket(f"{name}:{int(10 * part)}")] = 1.0
    out[bucket(f"length:{n.bit_length()}")] = 1.0
    return out


def tables(kind):
    """The caches that a feature function needs; a worker keeps one of each."""
    claim("hashed", _TABLES)
    if not _TABLES:
        _TABLES.update(words=Cached(word_terms), shapes=Cached(lambda p: bucket(f"shape:{shape(p)}")))
    return _TABLES["words"] if kind is presence else (_TABLES["words"], _TABLES["shapes"])


def sample(docs: DataFrame, labels: DataFrame, grade: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, grade) of at most ``rows`` labelled documents outside the held-out fold, picked by a hash of the id;
    a settled table.  Rows without a label are no part of it; of repeated labels the largest counts."""
    known = labels.select("doc_id", grade.cast("int").alias("grade")).filter(F.col("grade").isNotNull() & ~in_fold("doc_id"))
    ids = known.groupBy("doc_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return settle(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "grade"))


def learned_terms(train: DataFrame, kind, top: int) -> np.ndarray:
    """Sorted buckets that say something about ``grade < top``: chi-square over 10.8 (p = 0.001) and at least three
    documents; at most KEPT_TERMS, the strongest."""
    def count(batches):
        table = tables(kind)
        for batch in batches:
            seen = []
            for text, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = np.fromiter(kind(text, table), np.int64)
                seen.append(got * 2 + (g < top))
            if seen:
                keys, n = np.unique(np.concatenate(seen), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys >> 1), pa.array((keys & 1) * n), pa.array(n)], ["b", "low", "n"])

    total, low = train.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("grade") < top).cast("long")), F.lit(0))).first()
    if not 0 < low < total:
        return np.empty(0, np.int64)
    per = train.select("text", "grade").mapInArrow(count, "b long, low long, n long").groupBy("b").agg(
        F.sum("low").alias("low"), F.sum("n").alias("n")).filter("n >= 3")
    a, n = F.col("low").cast("double"), F.col("n").cast("double")
    lows, rows = F.lit(float(low)), F.lit(float(total))
    chi = rows * F.pow(a * rows - n * lows, 2) / (n * (rows - n) * lows * (rows - lows))
    strong = per.withColumn("chi", F.when(F.col("n") < total, chi)).filter("chi > 10.8")
    return np.sort(strong.orderBy(F.desc("chi"), "b").limit(KEPT_TERMS).toPandas()["b"].to_numpy(np.int64))


def rows_of(texts, kind, table, terms) -> tuple:
    """Cuts, columns and values of the texts' rows over ``terms`` (sorted buckets)."""
    place = np.full(BUCKETS, -1, np.int64)
    place[terms] = np.arange(len(terms))
    cuts, cols, vals = [0], [np.empty(0, np.int64)], [np.empty(0)]
    for text in texts:
        row = kind(text, table)
        at = place[np.fromiter(row, np.int64, len(row))]
        known = at >= 0
        cols.append(at[known])
        vals.append(np.fromiter(row.values(), float, len(row))[known])
        cuts.append(cuts[-1] + len(cols[-1]))
    return np.array(cuts), np.concatenate(cols), np.concatenate(vals)


def matrix(train: DataFrame, kind, terms) -> tuple:
    """The sample's rows over ``terms`` on the driver (bounded by TRAIN_ROWS): row of each entry, column, value, grades."""
    def run(batches):
        table = tables(kind)
        for batch in batches:
            cuts, cols, vals = rows_of(batch.column(0).to_pylist(), kind, table, terms)
            pieces = [(cols[a:b].astype("<i4").tobytes(), vals[a:b].astype("<f4").tobytes()) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pieces], pa.binary()), pa.array([p[1] for p in pieces], pa.binary()), batch.column(1)],
                ["c", "v", "grade"])

    got = train.select("text", "grade").mapInArrow(run, "c binary, v binary, grade int").toPandas()
    cols = [np.frombuffer(c, "<i4") for c in got["c"]]
    rows = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    flat = np.concatenate(cols) if cols else np.empty(0, np.int32)
    vals = np.concatenate([np.frombuffer(v, "<f4") for v in got["v"]]) if cols else np.empty(0)
    return rows, flat.astype(np.int64), vals.astype(float), got["grade"].to_numpy(np.int64)


class Adam:
    def __init__(self, params, rate=0.05):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads):
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9 ** self.t)) / (np.sqrt(v / (1 - 0.999 ** self.t)) + 1e-8)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))
