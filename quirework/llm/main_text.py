"""Main text of web pages by suffix arrays over the pages of a host.

1. A page is a stream of words, those of its blocks (``page_blocks``) one after the other, between ``PAD`` marks for
   its beginning and end: a menu that always comes first may be shorter than ``LONG`` words.
2. Pages are dealt out by ranges of hosts; a large host is cut into parts.  A task concatenates the streams of a part, builds
   the suffix array by doubling up to ``LONG`` words, and finds the strings of that length that a share of its pages
   have in common.  A string that this share of *all* pages of the host have is so frequent in one part at least, so
   these candidates miss none.
3. A second pass counts the pages of every candidate, over all parts.  Strings that enough pages share are boilerplate;
   longer repeated strings are runs of them.
4. Covered words leave the text; the runs between them stay, in their blocks.

Markup decides where it speaks: furniture by element, role or name goes and the article stays, even where passages of it
recur.  So inside a marked article only what most pages of the host share counts as boilerplate, and on a page without
marks what a quarter of them share.  Pages that are copies of each other share everything; so a string is boilerplate only
on twice as many pages as the strings of the page's longest block typically are on.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.plans.settle import settle

from .common import bitmap, maybe, partitions
from .page_blocks import ARTICLE, FURNITURE, OPEN, blocks
from .urls import host_path

#: Words of a long string; share of a host's pages that makes it boilerplate on a page without marks, and in a marked article
#: (there on this many pages at least); words of a part.
LONG, PAD, SHARE, INSIDE, INSIDE_PAGES, PART_WORDS = 12, 6, 0.25, 0.5, 4, 1 << 20


# -- suffix arrays -----------------------------------------------------------------------------------------------


def suffix_ranks(stream: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every suffix of ``stream`` among all, by its first ``depth`` words; equal for equal ones.  The words are
    ranked first, then strings of twice the length by the ranks of their halves.  Suffixes that are shorter come first."""
    rank, length = np.unique(stream, return_inverse=True)[1].astype(np.int64) + 1, 1
    while length < depth:
        step = min(length, depth - length)
        after = np.zeros_like(rank)
        after[:-step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        length += step
    return rank


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def string_hashes(words: np.ndarray, depth: int) -> np.ndarray:
    """Hash of the ``depth`` words from each place on, for places that have so many."""
    count = len(words) - depth + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(count, np.uint64)
    for k in range(depth):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k:k + count]
    return _mix(out).view(np.int64)


def _stream(found: list[tuple[str, int]], host: str) -> np.ndarray:
    """Hashes of a page's words, different for each host, with the marks of its ends; nothing for no words."""
    if not found:
        return np.zeros(0, np.uint64)
    words = np.array(" ".join(text for text, _ in found).split(" "), dtype=object)
    salt = pd.util.hash_array(np.array([host], dtype=object), categorize=False)[0]
    marked = np.concatenate([np.full(PAD, 1, np.uint64), pd.util.hash_array(words, categorize=False), np.full(PAD, 2, np.uint64)])
    return _mix(marked ^ salt)


def shared_strings(streams: list[np.ndarray], share: float, depth: int = LONG):
    """(hash, pages) of the strings of ``depth`` words that at least ``share`` of the streams hold."""
    ends = np.cumsum([len(s) + 1 for s in streams])
    whole = np.zeros(int(ends[-1]), np.uint64)
    owner = np.repeat(np.arange(len(streams)), np.diff(ends, prepend=0))
    fit = np.zeros(len(whole), bool)
    for page, (stream, end) in enumerate(zip(streams, ends)):
        begin = end - len(stream) - 1
        whole[begin:end - 1] = stream
        whole[end - 1] = page  # one end mark per page: no string runs on into the next
        fit[begin:max(begin, end - depth)] = True
    if not fit.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = suffix_ranks(whole, depth)
    places = np.flatnonzero(fit)
    order = places[np.lexsort((owner[places], rank[places]))]  # the suffix array, by page within equal strings
    new_string = np.r_[True, rank[order][1:] != rank[order][:-1]]
    new_page = new_string | np.r_[True, owner[order][1:] != owner[order][:-1]]
    starts = np.flatnonzero(new_string)
    pages = np.add.reduceat(new_page.astype(np.int64), starts)
    often = pages >= share * len(streams)
    first = order[starts[often]]
    hashes = np.zeros(len(first), np.uint64)
    for k in range(depth):
        hashes = hashes * np.uint64(0xD6E8FEB86659FD93) + whole[first + k]
    return _mix(hashes).view(np.int64), pages[often]


# -- passes over the pages -----------------------------------------------------------------------------------------


def _parsed(batch: pa.RecordBatch):
    """(blocks, host) of the pages of a batch with columns html and host."""
    for page, host in zip(batch.column("html"), batch.column("host")):
        yield blocks(page.as_py() or ""), host.as_py()


def _parts(batches):
    """(host, streams, whole) of pages that come sorted by host, in parts of about PART_WORDS words.  The first and the last
    part of a task may have more of their host elsewhere; the others are ``whole`` unless they were cut for their size."""
    host, streams, size, cut = None, [], 0, True
    for batch in batches:
        for found, name in _parsed(batch):
            if streams and (name != host or size >= PART_WORDS):
                yield host, streams, name != host and not cut
                cut, streams, size = name == host, [], 0
            host = name
            streams.append(_stream(found, host))
            size += len(streams[-1])
    if streams:
        yield host, streams, False


_COUNTS = "host string, string long, pages long"


def _counts(hosts, strings, pages):
    return pa.RecordBatch.from_arrays([
        pa.array(hosts, pa.string()), pa.array(strings, pa.int64()), pa.array(pages, pa.int64())],
        ["host", "string", "pages"])


def boilerplate(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """(host, string, pages, total): hashes of the strings of LONG words that at least two and ``share`` of the
    ``total`` pages of a host hold.  ``pages`` has host and html; hashes tell hosts apart."""
    spark, pages = pages.sparkSession, pages.select("host", "html")

    def candidates(batches):
        for host, streams, whole in _parts(batches):
            yield _counts([host], [None], [len(streams)])
            strings, counts = shared_strings(streams, share)
            if whole:
                strings, counts = strings[counts >= 2], counts[counts >= 2]
            yield _counts([host] * len(strings), strings, counts)

    # Rows of a host are told apart by their number, so that no host is too large for a range.
    by = [F.col("host"), F.monotonically_increasing_id()]
    ranged = pages.repartitionByRange(partitions(spark), *by).sortWithinPartitions("host")
    local = settle(ranged.mapInArrow(candidates, _COUNTS))
    totals = local.filter("string is null").groupBy("host").agg(F.sum("pages").alias("total"))
    wanted = settle(local.filter("string is not null").select("host", "string").distinct().join(totals, "host"))
    some = bitmap(wanted, "string")

    def counted(batches):
        for batch in batches:
            hosts, met = [], [np.zeros(0, np.int64)]
            for found, host in _parsed(batch):
                strings = np.unique(string_hashes(_stream(found, host), LONG))
                met.append(strings[maybe(some, strings)])
                hosts += [host] * len(met[-1])
            met = np.concatenate(met)
            yield _counts(hosts, met, np.ones(len(met), np.int64))

    exact = pages.mapInArrow(counted, _COUNTS).groupBy("host", "string").agg(F.sum("pages").alias("pages"))
    return exact.join(wanted, ["host", "string"]).filter((F.col("pages") >= 2) & (F.col("pages") >= F.col("total") * share))


def _removed(found, places, counts, totals) -> np.ndarray:
    """Which words of a page are boilerplate, given the places of its frequent strings."""
    sizes = np.array([text.count(" ") + 1 for text, _ in found])
    kinds = np.array([kind for _, kind in found])
    ends = np.cumsum(sizes)
    words = int(ends[-1])
    begin, end = np.clip(places - PAD, 0, words), np.clip(places - PAD + LONG, 0, words)
    on = np.ones(words + 1, np.int64)
    on[begin] = counts
    kept = np.flatnonzero(kinds != FURNITURE)
    gone = np.zeros(words, bool)
    if not len(kept):
        return gone
    longest = kept[sizes[kept].argmax()]
    typical = float(np.median(on[ends[longest] - sizes[longest]:ends[longest]]))
    cut = counts >= 2 * typical
    kind_at = np.repeat(kinds, sizes)
    for inside in (False, True):
        use = cut & ((counts >= INSIDE_PAGES) & (counts > INSIDE * totals) if inside else True)
        edge = np.zeros(words + 1, np.int64)
        np.add.at(edge, begin[use], 1)
        np.add.at(edge, end[use], -1)
        gone |= (np.cumsum(edge[:-1]) > 0) & (kind_at == (ARTICLE if inside else OPEN))
    return gone


def _text(found, gone) -> str:
    if gone is None:
        return "\n".join(text for text, kind in found if kind != FURNITURE)
    out, at = [], 0
    for text, kind in found:
        words = text.split(" ")
        if kind != FURNITURE:
            left = [w for w, g in zip(words, gone[at:at + len(words)]) if not g]
            if left:
                out.append(" ".join(left))
        at += len(words)
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of ``pages``.

    A null or empty page has an empty text; a null url, or one without a host, belongs to the host named by the empty
    string; a null or repeated page_id is kept; repeated rows are pages of their own; further columns are ignored.
    """
    base = pages.select("page_id", "url", "html", host_path(F.col("url"))[0].alias("host"))
    hits = settle(boilerplate(base).select("host", "string", "pages", "total"))
    some = bitmap(hits, "string")
    # Rows are told apart by id and contents: a page's boilerplate follows from its host and html.
    keyed = base.withColumn("page_key", F.xxhash64("host", "html"))

    def places(batches):
        for batch in batches:
            rows = []
            for key, (found, host) in zip(batch.column("page_key").to_pylist(), _parsed(batch)):
                if any(kind != FURNITURE for _, kind in found):
                    strings = string_hashes(_stream(found, host), LONG)
                    at = np.flatnonzero(maybe(some, strings))
                    rows.append((np.full(len(at), key, np.int64), np.array([host] * len(at), dtype=object), strings[at], at))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) if k != 1 else pa.array(np.concatenate(c), pa.string())
                                                  for k, c in enumerate(zip(*rows))], ["page_key", "host", "string", "place"])

    met = keyed.select("page_key", "host", "html").mapInArrow(places, "page_key long, host string, string long, place long")
    # Equal pages give equal places once.
    marks = met.join(hits, ["host", "string"]).groupBy("page_key", "host").agg(
        F.collect_set(F.struct("place", "pages", "total")).alias("marks"))
    marked = settle(marks.withColumnsRenamed({"page_key": "k", "host": "h"}))
    joined = keyed.join(marked, (F.col("page_key") == F.col("k")) & (F.col("host") == F.col("h")), "left")

    @F.pandas_udf("string")
    def text_of(html: pd.Series, marks: pd.Series) -> pd.Series:
        out = []
        for page, mark in zip(html, marks):
            found, gone = blocks(page or ""), None
            if mark is not None and len(mark):
                where, counts, totals = np.array([[m["place"], m["pages"], m["total"]] for m in mark], np.int64).T
                gone = _removed(found, where, counts, totals)
            out.append(_text(found, gone))
        return pd.Series(out, dtype=object)

    with_text = joined.select("page_id", "url", text_of("html", "marks").alias("text"))
    return with_text.withColumn("n_chars", F.length("text").cast("long"))
