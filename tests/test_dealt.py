"""Spans that are dealt by document stay where they are."""

import random

from quirework import catalog
from quirework.operators import redact, text
from quirework.plans.deal import deal

from .conftest import SF_DIR
from .test_golden import SPAN, rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def words(spark, n, odd=()):
    dice = random.Random(7)
    data = [(d, p, i, dice.choice(["the", "other", "x", "thethe", "", None]), 10.0 * dice.randrange(40), 700.0 - 3 * dice.randrange(30), 0.0, 0.0)
            for d in (1, 2, 2**60 + 1) for p in range(3) for i in range(n)]
    data = [(*r[:6], r[4] + 7.0 * len(r[3] or ""), r[5] + 12.0) for r in data]
    return spark.createDataFrame([*data, *odd], SPAN)


def test_redaction_leaves_dealt_spans_in_place(spark):
    """The ranges go to the spans; what is left is the same, with spans of null keys and of one key twice."""
    odd = [(None, 0, 3, "the", 0.0, 0.0, 21.0, 12.0), (1, None, 3, "the", 0.0, 0.0, 21.0, 12.0),
           (1, 0, 3, "twice", 0.0, 0.0, 35.0, 12.0)]
    spans = words(spark, 60, odd)
    hits = spark.createDataFrame(
        [(1, 0, 3, 0, 0), (1, 0, 3, 0, 1), (1, 1, 7, 1, 2), (2**60 + 1, 2, 9, 0, 2), (2, 0, 11, 4, 4), (2, 0, 11, 2, 3), (9, 9, 9, 0, 1),
         (None, 0, 3, 0, 2), (1, None, 3, 0, 2)], "doc_id long, page_number int, span_id long, a int, b int")
    want, want_ranges = redact.search_and_redact(spans, hits)
    got, got_ranges = redact.search_and_redact(deal(spans, ["doc_id"]), hits, dealt_by=["doc_id"])
    key = lambda df: sorted(map(repr, df.collect()))
    assert got.columns == want.columns and key(got) == key(want)
    flat = lambda df: sorted(repr((*r[:3], sorted(r.removed))) for r in df.collect())
    assert flat(got_ranges) == flat(want_ranges)
    assert "Exchange" in plan(got) and "ENSURE_REQUIREMENTS" not in plan(got)


def test_search_and_redact_shuffles_text_and_hits_only(spark):
    """Neither spans nor numbered hits: documents are dealt, then hits."""
    query = plan(catalog.queries()["search_and_redact"](spark, SF_DIR))
    assert query.count("Exchange hashpartitioning") == 2 and "ENSURE_REQUIREMENTS" not in query


def test_numbering_that_is_not_used_falls_away(spark):
    texts = spark.createDataFrame([(1, 0, "the other"), (1, 1, "the"), (None, 2, "the")], "doc_id long, page_number int, text string")
    hits = text.search(texts, ["the"])
    assert rows(hits.filter("doc_id = 1"), "page_number", "start", "match_index") == [(0, 0, 0), (0, 5, 1), (1, 0, 2)]
    assert hits.count() == 4
    assert "Exchange" in plan(hits) and "Exchange" not in plan(hits.select("doc_id", "page_number", "start"))


def test_dense_pages_are_ordered_where_they_are_dealt(spark):
    """The same order for all limits; only spans of lines beyond the limit are shuffled, to their chunks."""
    nan = float("nan")
    odd = [(None, 0, k, "t", float(k % 3), 700.0 - 7 * (k % 4), 0.0, 0.0) for k in range(70)] + [(1, None, 1, "t", 1.0, 2.0, 0.0, 0.0)]
    odd += [(5, 0, k, "t", x, y, x, y) for k, (x, y) in enumerate(
        [(1.0, 700.0), (None, 700.0), (nan, 700.0), (2.0, None), (3.0, nan), (None, None), (1.0, 700.0), (-4.0, 299.0), (0.0, 0.0), (1.0, -0.0)])]
    spans = words(spark, 60, odd)
    dealt, keys = deal(spans, ["doc_id"]), ("doc_id", "page_number", "span_id", "line_index", "read_index")
    order = lambda df: sorted(map(repr, df.select(*keys).collect()))
    want = order(text.reading_order(spans, hot_rows=None))
    for limit in (5, 25, 59, 1000):
        got = text.reading_order(dealt, hot_rows=limit, dealt_by=["doc_id"])
        assert order(got) == want and got.columns == [*spans.columns, "line_index", "read_index"]
    kept = [line for line in plan(got).splitlines() if "ENSURE_REQUIREMENTS" in line]
    assert kept and all("_key_" in line for line in kept)


def test_reading_order_dense_shuffles_long_lines_only(spark):
    lines = plan(catalog.queries()["reading_order_dense"](spark, SF_DIR)).splitlines()
    kept = [line for line in lines if "ENSURE_REQUIREMENTS" in line]
    assert kept and all("_key_line_index" in line for line in kept)


def test_runs_are_worked_out_once_and_exploded_from_a_column(spark):
    spans = words(spark, 5, [(1, 0, 9, "abcdef", 0.0, 0.0, 42.0, 12.0), (1, 0, 10, "gone", 0.0, 0.0, 28.0, 12.0)])
    hits = spark.createDataFrame([(1, 0, 9, 1, 1), (1, 0, 9, 3, 4), (1, 0, 10, 0, 3)], "doc_id long, page_number int, span_id long, a int, b int")
    left, _ = redact.search_and_redact(spans, hits)
    assert rows(left.filter("doc_id = 1 and page_number = 0 and span_id > 5"), "span_id", "run_index", "text", "x0", "x1") == [
        (9, 0, "a", 0.0, 7.0), (9, 1, "c", 14.0, 21.0), (9, 2, "f", 35.0, 42.0)]
    query = plan(left)
    assert "posexplode(_runs" in query and query.count("aggregate(array_sort(") == 1


def test_chunks_of_a_long_line_hold_many_spans(spark, monkeypatch):
    """Words far apart don't get a chunk each; the order is the plain one, with odd places."""
    places = [100.0 * (i * 37 % 400) for i in range(400)] + [None, float("nan"), float("inf"), -float("inf"), 1e300, -1e300]
    data = [(1, 0, i, "t", x, 20.0, 0.0, 32.0) for i, x in enumerate(places)]
    data += [(2, 0, i, "t", None, 20.0, 0.0, 32.0) for i in range(150)] + [(3, 0, i, "t", 7.0, 20.0, 0.0, 32.0) for i in range(150)]
    spans, chunks, scan = spark.createDataFrame(data, SPAN), [], text.ordered_scan

    def watched(df, keys, chunk, *a, **k):
        chunks.append(df.filter("doc_id = 1").select(chunk.alias("c")).distinct().count())
        return scan(df, keys, chunk, *a, **k)

    want = text.reading_order(spans, hot_rows=None)
    monkeypatch.setattr(text, "ordered_scan", watched)
    got = text.reading_order(deal(spans, ["doc_id"]), hot_rows=100, dealt_by=["doc_id"])
    keys = ("doc_id", "span_id", "line_index", "read_index")
    assert rows(got, *keys) == rows(want, *keys)
    assert 3 <= chunks[-1] <= 8
