"""Reading order, page and document text, corpus search."""

from collections import Counter
from functools import reduce
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.folding import automaton, find_all, fold
from ..functions.needles import NeedleTable, find_in_texts
from ..plans.deal import deal, noted
from ..plans.scan import ordered_scan, split_hot
from ..plans.settle import settle

PAGE_KEY = ["doc_id", "page_number"]
LINE_GAP = 5.0
PAGES_PER_PART = 256
# Pages with more spans than this leave the one-task-per-page plan.
HOT_PAGE_ROWS = 2_000_000
# Characters of queries in one automaton, which every task builds for itself (about 100 bytes a character).
NEEDLE_CHARS = 1_000_000
# From so many queries of one length on they are sought by a table of hashes; tables of one pass take so many bytes.
MANY_NEEDLES = 1_000
TABLE_BYTES = 1 << 26
HITS_AT_ONCE = 1 << 18


def _anchor(anchor):
    return F.col("y0") if anchor == "bottom" else (F.col("y0") + F.col("y1")) / F.lit(2.0)


def _down(y):
    """Heights from top to bottom; a null or NaN height comes last, on the last line."""
    return F.coalesce(-y, F.lit(float("inf")))


def _cell(value, size):
    """Number of a cell of ``size``, in the order of the values; NaN and infinity have the last one."""
    far = F.lit(float(1 << 40))
    inside = F.floor(F.least(F.greatest(value, -far), far) / size)
    return F.when(F.isnan(value) | (value >= far), F.lit(1 << 41)).otherwise(inside)


def _order_small_pages(spans, y):
    down = Window.partitionBy(*PAGE_KEY).orderBy(_down(F.col("_y")))
    new_line = F.when(F.lag("_y").over(down) - F.col("_y") > LINE_GAP, 1).otherwise(0)
    lined = spans.withColumn("_y", y).withColumn("_brk", new_line).withColumn(
        "line_index", F.sum("_brk").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    across = Window.partitionBy(*PAGE_KEY).orderBy("line_index", "x0", "span_id")
    return lined.withColumn("read_index", (F.row_number().over(across) - 1).cast("long")).drop("_y", "_brk")


def _chunked_lines(heights):
    """``line_index`` and ``_start`` of heights of pages with any number of heights."""
    band = _cell(F.col("_down"), 64)
    heights = ordered_scan(heights, PAGE_KEY, band, [F.col("_down")], lags={"_above": F.col("_y")})
    heights = heights.withColumn("_brk", F.when(F.col("_above") - F.col("_y") > LINE_GAP, 1).otherwise(0))
    heights = ordered_scan(heights, PAGE_KEY, band, [F.col("_down")], sums={"_breaks": F.col("_brk")})
    heights = settle(heights.withColumn("line_index", (F.col("_breaks") + F.col("_brk")).cast("long")))
    sizes = heights.groupBy(*PAGE_KEY, "line_index").agg(F.sum("_n").alias("_size"))
    starts = ordered_scan(
        sizes, PAGE_KEY, F.floor(F.col("line_index") / 1024), [F.col("line_index")], sums={"_start": F.col("_size")})
    return heights.join(starts, [*PAGE_KEY, "line_index"])


def _plain_lines(heights):
    """The same where the heights of a page fit into a task."""
    page = Window.partitionBy(*PAGE_KEY)
    down = page.orderBy("_down")
    brk = F.when(F.lag("_y").over(down) - F.col("_y") > LINE_GAP, 1).otherwise(0)
    lined = heights.withColumn("_brk", brk).withColumn(
        "line_index", F.sum("_brk").over(down.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    before = page.orderBy("line_index").rangeBetween(Window.unboundedPreceding, -1)
    return lined.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn(
        "_size", F.sum("_n").over(Window.partitionBy(*PAGE_KEY, "line_index")))


def _order_dense_pages(spans, y, hot_rows):
    """The same order for pages of any size: lines come from the distinct heights, which carry what a span needs of its line.

    So spans are shuffled to their height and to their line; the branch of lines beyond ``hot_rows`` shuffles them to their height
    once more.  Only lines beyond ``hot_rows`` spans are scanned in chunks, and
    only pages with more than ``hot_rows`` heights.
    """
    marked = spans.withColumn("_y", y).withColumn("_down", _down(F.col("_y")))
    heights = settle(marked.groupBy(*PAGE_KEY, "_down").agg(F.count(F.lit(1)).alias("_n"), F.first("_y").alias("_y")))
    few, many = split_hot(heights, PAGE_KEY, hot_rows)
    found = [*PAGE_KEY, "_down", "line_index", "_start", "_size"]
    lines = settle(_plain_lines(few).select(*found).unionByName(_chunked_lines(many).select(*found)))
    line_key, out = [*PAGE_KEY, "line_index"], [*spans.columns, "line_index", "read_index"]
    ordinary, hot = (
        marked.join(lines.filter(kind), [*PAGE_KEY, "_down"]) for kind in (F.col("_size") <= hot_rows, F.col("_size") > hot_rows))
    across = Window.partitionBy(*line_key).orderBy("x0", "span_id")
    plain = ordinary.withColumn("_in_line", F.row_number().over(across) - 1)
    ranked = (df.withColumn("read_index", (F.col("_start") + F.col("_in_line")).cast("long")).select(*out) for df in (plain, _chunked_ranks(hot)))
    return reduce(DataFrame.unionByName, ranked)


def _chunked_ranks(spans, width=16):
    """``_in_line`` of spans of lines with any number of spans; a chunk is ``width`` wide."""
    return ordered_scan(
        spans, [*PAGE_KEY, "line_index"], _cell(F.col("x0"), width), [F.col("x0"), F.col("span_id")], rank="_in_line")


def _order_dealt_pages(spans, y, hot_rows, dealt_by):
    """The same order for spans dealt by some of the page's keys: heights and pages are counted where the spans are, and the lines of
    dense pages are dealt to them.

    Only spans of lines beyond ``hot_rows`` are shuffled, to their chunks.  These are as wide as to hold some ``hot_rows`` spans, as
    narrow ones would be about as many as the spans.
    """
    marked = spans.withColumn("_y", y).withColumn("_down", _down(F.col("_y")))
    finite = F.when(F.abs("x0") < float(1 << 40), F.col("x0"))
    heights = marked.groupBy(*PAGE_KEY, "_down").agg(
        F.count(F.lit(1)).alias("_n"), F.first("_y").alias("_y"), F.min(finite).alias("_from"), F.max(finite).alias("_to"))
    page = Window.partitionBy(*PAGE_KEY)
    sized = heights.withColumns({"_spans": F.sum("_n").over(page), "_heights": F.count(F.lit(1)).over(page),
                                 "_extent": F.max("_to").over(page) - F.min("_from").over(page)}).drop("_from", "_to")
    known = F.col("doc_id").isNotNull() & F.col("page_number").isNotNull()
    dense = settle(sized.filter((F.col("_spans") > hot_rows) & known).drop("_spans"))
    few, many = (dense.filter(kind).drop("_heights") for kind in (F.col("_heights") <= hot_rows, F.col("_heights") > hot_rows))
    found = [*PAGE_KEY, "_down", "line_index", "_start", "_size", "_extent"]
    lines = settle(_plain_lines(few).select(*found).unionByName(_chunked_lines(many).select(*found)))
    placed = noted(marked, deal(lines, dealt_by), [*PAGE_KEY, "_down"], "_line", lambda line: F.first(line, ignorenulls=True))
    placed = placed.withColumns({"_dense": F.col("_line.line_index"), "_start": F.coalesce("_line._start", F.lit(0)),
                                 "_size": F.coalesce("_line._size", F.lit(0))})
    out = [*spans.columns, "line_index", "read_index"]
    # Small pages, which have no line yet, and ordinary lines of dense pages go through the same windows.
    group = Window.partitionBy(*PAGE_KEY, "_dense")
    down = group.orderBy("_down")
    new_line = F.when(F.col("_dense").isNull() & (F.lag("_y").over(down) - F.col("_y") > LINE_GAP), 1).otherwise(0)
    lined = placed.filter(F.col("_size") <= hot_rows).withColumn("_brk", new_line).withColumn(
        "line_index", F.coalesce("_dense", F.sum("_brk").over(down.rowsBetween(Window.unboundedPreceding, 0))))
    plain = lined.withColumn("_in_line", F.row_number().over(group.orderBy("line_index", "x0", "span_id")) - 1)
    hot = placed.filter(F.col("_size") > hot_rows).withColumn("line_index", F.col("_dense"))
    width = F.greatest(F.lit(16.0), F.col("_line._extent") * hot_rows / F.col("_size"))  # skips a null
    ranked = (df.withColumn("read_index", (F.col("_start") + F.col("_in_line")).cast("long")).select(*out)
              for df in (plain, _chunked_ranks(hot, width)))
    return reduce(DataFrame.unionByName, ranked)


def reading_order(spans: DataFrame, anchor="bottom", hot_rows=HOT_PAGE_ROWS, dealt_by: list[str] | None = None) -> DataFrame:
    """Add ``line_index`` and ``read_index`` (0-based within the page): top line first, left to right.

    A new line starts where the next lower edge lies more than 5 pt below.  Pages beyond ``hot_rows`` spans are
    ordered in chunks; ``hot_rows=None`` states that there are none and saves counting.  ``dealt_by`` states by which of the page's
    keys the spans are dealt (``plans.deal``), so that they stay where they are.
    """
    y = _anchor(anchor)
    if hot_rows is None:
        return _order_small_pages(spans, y)
    if dealt_by:
        return _order_dealt_pages(spans, y, hot_rows, dealt_by)
    small, dense = split_hot(spans, PAGE_KEY, hot_rows)
    return _order_small_pages(small, y).unionByName(_order_dense_pages(dense, y, hot_rows))


def joined_text(order, text, sep):
    # sort_array compares structs as such; array_sort evaluates a function for every two of them.
    pieces = F.sort_array(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
    return F.array_join(F.transform(pieces, lambda p: p["t"]), sep)


def page_text(ordered: DataFrame, sep="") -> DataFrame:
    """Text of every page; the input has ``read_index``.  A page's text is one value, as in the data model."""
    return ordered.groupBy(*PAGE_KEY).agg(joined_text(F.col("read_index"), F.col("text"), sep).alias("text"))


def span_offsets(ordered: DataFrame, sep="", hot_rows=HOT_PAGE_ROWS) -> DataFrame:
    """Character range of every span within its page text."""
    step = F.length("text") + len(sep)

    def end(df):
        return df.withColumn("char_start", F.col("char_start").cast("long")).withColumn(
            "char_end", F.col("char_start") + F.length("text"))

    def plain(df):
        w = Window.partitionBy(*PAGE_KEY).orderBy("read_index").rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("char_start", F.coalesce(F.sum(step).over(w), F.lit(0)))

    if hot_rows is None:
        return end(plain(ordered))
    small, dense = split_hot(ordered, PAGE_KEY, hot_rows)
    chunked = ordered_scan(
        dense, PAGE_KEY, F.floor(F.col("read_index") / 65536), [F.col("read_index")], sums={"char_start": step})
    return end(plain(small).unionByName(chunked))


def page_text_with_spans(offsets: DataFrame, sep="") -> DataFrame:
    """``page_text`` with ``spans``, the spans of the page that have text, in their order; the input is from ``span_offsets``.

    So hits find their spans in the page's own row (``search``, ``hit_quads``) and no span is shuffled to them.  The spans of a page
    are one value here, some ten times its text; where that is too much, ``hit_quads`` takes the offsets as a table.
    """
    span = F.struct("char_start", "char_end", "span_id", "x0", "y0", "x1", "y1")
    pieces = F.sort_array(F.collect_list(F.struct(F.col("read_index").alias("o"), F.col("text").alias("t"), span.alias("s"))))
    return offsets.groupBy(*PAGE_KEY).agg(pieces.alias("_p")).select(
        *PAGE_KEY, F.array_join(F.transform("_p", lambda p: p["t"]), sep).alias("text"),
        F.transform(F.filter("_p", lambda p: p["s"]["char_end"] > p["s"]["char_start"]), lambda p: p["s"]).alias("spans"))


def page_banner(page_number, text):
    return F.concat(F.lit("--- Page "), (page_number + 1).cast("string"), F.lit(" ---\n\n"), text, F.lit("\n"))


def page_or_placeholder(page_number, text):
    failed = F.concat(F.lit("[Error extracting text from page "), (page_number + 1).cast("string"), F.lit("]\n"))
    return F.coalesce(text, failed)


def document_text(page_texts: DataFrame, first=None, last=None, pages_per_part=PAGES_PER_PART) -> DataFrame:
    """Text of documents with a banner per page, in parts of ``pages_per_part`` pages.

    The parts of a document in order, joined by a newline, are its text; ordinary documents have one part.  A page
    whose text is null gets a placeholder.
    """
    if first is not None:
        page_texts = page_texts.filter(F.col("page_number") >= first)
    if last is not None:
        page_texts = page_texts.filter(F.col("page_number") <= last)
    page = F.col("page_number")
    return (
        page_texts.withColumn("part", F.floor(page / pages_per_part).cast("int"))
        .groupBy("doc_id", "part")
        .agg(joined_text(page, page_banner(page, page_or_placeholder(page, F.col("text"))), "\n").alias("text"))
    )


def selection_text(selected: DataFrame, order=("read_index",)) -> DataFrame:
    """Text of each selection; ``order`` names the columns that order its pieces."""
    return selected.groupBy("sel_id").agg(joined_text(F.struct(*order), F.col("text"), "").alias("text"))


def _folded(queries):
    """The distinct folded queries of a table with their lengths, blank ones left out."""

    def folded(batches):
        for batch in batches:
            names = (fold(q) for q in batch.column(0).to_pylist() if q)
            names = pa.array(list({q for q in names if q.strip()}), pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.array([len(q) for q in names.to_pylist()], pa.int32())], ["query", "size"])

    return settle(queries.select("query").distinct().mapInArrow(folded, "query string, size int").distinct())


def _tables(sizes, load):
    """Tables of the lengths with MANY_NEEDLES or more, as parts that take TABLE_BYTES at most; ``sizes`` tells how many
    needles have a length and ``load(length, number, parts)`` gives some of them."""
    part, taken = [], 0
    for length, count in sorted(sizes.items()):
        if count < MANY_NEEDLES:
            continue
        weight = 2 * length + 20
        pieces = -(-count * weight // TABLE_BYTES)
        for number in range(pieces):
            if part and taken + count * weight // pieces > TABLE_BYTES:
                yield part
                part, taken = [], 0
            needles = load(length, number, pieces)
            if needles:
                part.append(NeedleTable(needles, length))
                taken += len(needles) * weight
    if part:
        yield part


def _automata(needles):
    """Parts of the needles, each of at most NEEDLE_CHARS characters (or one needle)."""
    part, size = [], 0
    for q in needles:
        if part and size + len(q) > NEEDLE_CHARS:
            yield part
            part, size = [], 0
        part.append(q)
        size += len(q)
    if part:
        yield part


def _passes(queries):
    """(tables, needles of an automaton) for each pass over the text."""
    if isinstance(queries, DataFrame):
        found = _folded(queries)
        sizes = {r[0]: r[1] for r in found.groupBy("size").agg(F.count(F.lit(1))).collect()}

        def load(length, number, pieces):
            here = F.pmod(F.xxhash64("query"), F.lit(pieces)) == number
            return found.filter((F.col("size") == length) & here).select("query").toArrow()["query"].to_pylist()

        few = [length for length, count in sizes.items() if count < MANY_NEEDLES]
        rest = (r[0] for r in found.filter(F.col("size").isin(few)).select("query").toLocalIterator()) if few else ()
    else:
        folded = (fold(q) for q in queries if q)
        found = sorted({q for q in folded if q.strip()})
        sizes = Counter(len(q) for q in found)

        def load(length, number, pieces):
            return [q for q in found if len(q) == length][number::pieces]

        rest = (q for q in found if sizes[len(q)] < MANY_NEEDLES)
    return zip_longest(_tables(sizes, load), _automata(rest), fillvalue=[])


def _spans_under(spans, rows, start, size):
    """Of lists of spans in order (char_start, char_end, ...), one list per text: those under each hit, given by its text and place."""
    offsets, spans = spans.offsets.to_numpy().astype(np.int64), spans.values
    at = np.arange(offsets[0], offsets[-1])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) << 32
    edge = lambda name: text + spans.field(name).to_numpy(zero_copy_only=False)[at]
    hit = (np.asarray(rows, np.int64) << 32) + np.asarray(start, np.int64)
    first = np.searchsorted(edge("char_end"), hit, "right")
    count = np.searchsorted(edge("char_start"), hit + np.asarray(size, np.int64), "left") - first
    ends = np.cumsum(count)
    inside = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + count, count) + offsets[0]
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), spans.take(pa.array(inside)))


def find_matches(page_texts: DataFrame, queries, per_page=None) -> DataFrame:
    """Literal hits whatever the case (``functions.folding``); ``per_page`` limits them to the first ones of a page and query
    (default: all).  ``query`` is the folded query; start and length are in the text itself.

    ``queries`` is a list of strings or a table with a column ``query``; blank ones find nothing.  All queries are sought in one
    pass over the text: many of one length by tables of their hashes (``functions.needles``), the others by one automaton.  Beyond
    TABLE_BYTES and NEEDLE_CHARS there is one pass per so many, over texts that are written once.  Of ``page_text_with_spans`` each
    hit has its ``spans``.
    """
    key = [f for f in page_texts.schema.fields if f.name in PAGE_KEY]
    carried = [f for f in page_texts.schema.fields if f.name == "spans"]
    spark, texts = page_texts.sparkSession, page_texts.select(*PAGE_KEY, "text", *[f.name for f in carried])
    schema = StructType([*sorted(key, key=lambda f: PAGE_KEY.index(f.name)), StructField("query", StringType()),
                         StructField("start", IntegerType()), StructField("hit_length", IntegerType()), *carried])

    def finder(tables, needles):
        sizes = [len(n) for n in needles]

        def out(batch, rows, names, start, size):
            at = pa.array(rows, pa.int32())
            return pa.RecordBatch.from_arrays([
                batch.column(0).take(at), batch.column(1).take(at), names, pa.array(start, pa.int32()),
                pa.array(size, pa.int32()), *[_spans_under(batch.column(3), rows, start, size) for _ in carried]], schema.names)

        def find(batches):
            machine = automaton(needles) if needles else None
            for batch in batches:
                texts = batch.column(2).to_pylist()
                if machine:
                    rows, hits = [], []
                    for row, text in enumerate(texts):
                        if text:
                            found = find_all(machine, sizes, text, per_page)
                            hits += found
                            rows += [row] * len(found)
                    number, start, size = zip(*hits) if hits else ((), (), ())
                    yield out(batch, rows, pa.array(needles, pa.string()).take(pa.array(number, pa.int32())), start, size)
                if tables:
                    for table, rows, number, start, size in find_in_texts(tables.value, texts, per_page):
                        for k in range(0, len(rows), HITS_AT_ONCE):
                            cut = slice(k, k + HITS_AT_ONCE)
                            yield out(batch, rows[cut], table.needles.take(pa.array(number[cut])), start[cut], size[cut])

        return find

    finders = [finder(spark.sparkContext.broadcast(tables) if tables else None, needles) for tables, needles in _passes(queries)]
    if not finders:
        return spark.createDataFrame([], schema)
    if len(finders) > 1:
        texts = settle(texts)
    return reduce(DataFrame.unionByName, [texts.mapInArrow(find, schema) for find in finders])


def search(page_texts: DataFrame, queries, per_page=None) -> DataFrame:
    """Hits numbered through each document (``match_index``).

    The hits are written once: numbering reads them twice, and they are far smaller than the text.
    """
    found = settle(find_matches(page_texts, queries, per_page))
    return ordered_scan(
        found, ["query", "doc_id"], F.floor(F.col("page_number") / 1024),
        [F.col("page_number"), F.col("start")], rank="match_index")


def search_counts(hits: DataFrame) -> DataFrame:
    """Hits per page and per document."""
    per_page = hits.groupBy("query", *PAGE_KEY).agg(F.count(F.lit(1)).alias("page_hits"))
    per_doc = per_page.groupBy("query", "doc_id").agg(F.sum("page_hits").alias("doc_hits"))
    return per_page.join(per_doc, ["query", "doc_id"])


def hits_per_document(hits: DataFrame) -> DataFrame:
    per_page = hits.groupBy("query", *PAGE_KEY).agg(F.count(F.lit(1)).alias("_n"))
    return per_page.groupBy("query", "doc_id").agg(
        F.sum("_n").alias("hits"), F.count(F.lit(1)).alias("pages_hit"))


def match_neighbours(hits: DataFrame) -> DataFrame:
    """Next and previous hit of a document, going round at the ends."""
    scanned = ordered_scan(
        hits, ["query", "doc_id"], F.floor(F.col("page_number") / 1024), [F.col("match_index")],
        totals={"_n": F.count(F.lit(1))})
    i, n = F.col("match_index"), F.col("_n")
    return scanned.select(
        *hits.columns, F.pmod(i + 1, n).alias("next_index"), F.pmod(i - 1, n).alias("previous_index"))


def hit_spans(hits: DataFrame, offsets: DataFrame, bucket=256) -> DataFrame:
    """Spans under each hit: overlap of character ranges, joined by bucket of the page text."""
    cell = lambda c: F.floor(c / bucket).cast("int")
    h = hits.withColumn("_end", F.col("start") + F.col("hit_length")).withColumn(
        "_b", F.explode(F.sequence(cell(F.col("start")), cell(F.col("_end") - 1))))
    s = offsets.filter(F.col("char_end") > F.col("char_start")).withColumn(
        "_b", F.explode(F.sequence(cell(F.col("char_start")), cell(F.col("char_end") - 1))))
    later = F.greatest(F.col("start"), F.col("char_start"))
    return h.join(s, [*PAGE_KEY, "_b"]).filter(
        (F.col("start") < F.col("char_end")) & (F.col("_end") > F.col("char_start")) & (F.col("_b") == cell(later))
    ).drop("_b", "_end")


def hit_quads(hits: DataFrame, offsets: DataFrame | None = None) -> DataFrame:
    """One rectangle per hit and span, cut to the matched characters, as quads per hit.

    Hits of ``page_text_with_spans`` have their spans; others are joined with ``offsets``, for pages of any size.
    """
    if offsets is None:
        over = hits.withColumn("_s", F.explode("spans")).select("query", *PAGE_KEY, "match_index", "start", "hit_length", "_s.*")
        length = F.col("char_end") - F.col("char_start")
    else:
        over, length = hit_spans(hits, offsets), F.length("text")
    width = (F.col("x1") - F.col("x0")) / length
    first = F.greatest(F.col("start") - F.col("char_start"), F.lit(0))
    last = F.least(F.col("start") + F.col("hit_length"), F.col("char_end")) - F.col("char_start")
    x0, x1 = F.col("x0") + first * width, F.col("x0") + last * width
    return over.select(
        "query", *PAGE_KEY, "match_index", "start", "span_id", x0.alias("x0"), F.col("y0"), x1.alias("x1"), F.col("y1"),
        first.cast("int").alias("a"), (last - 1).cast("int").alias("b"))


def distribute_text(quads: DataFrame, page_texts: DataFrame) -> DataFrame:
    """Deal a page's text out over its quads, ``ceil(length / quads)`` characters each."""
    counted = quads.groupBy(*PAGE_KEY).agg(F.count(F.lit(1)).alias("_n"))
    texts = page_texts.join(counted, PAGE_KEY).select(
        *PAGE_KEY, "text", F.ceil(F.length("text") / F.col("_n")).cast("int").alias("_per"))
    # Cut in the page's own row, so that the text is not copied to every quad.
    pieces = texts.filter("_per > 0").select(
        *PAGE_KEY,
        F.posexplode(F.transform(
            F.sequence(F.lit(0), (F.floor((F.length("text") - 1) / F.col("_per"))).cast("int")),
            lambda i: F.substring(F.col("text"), (i * F.col("_per") + 1).cast("int"), F.col("_per")),
        )).alias("quad_index", "text"))
    return quads.join(pieces, [*PAGE_KEY, "quad_index"], "left").withColumn("text", F.coalesce("text", F.lit("")))
