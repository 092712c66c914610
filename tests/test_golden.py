"""Hand-computed cases of the quirks, and brute force where there is no SQL."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quirework.functions import geometry as g
from quirework.functions import paths, values
from quirework.operators import annotations as ann
from quirework.operators import documents, pages, redact, selection, text
from quirework.sources import annotations as raw_src
from quirework.sources import documents as doc_src
from quirework.sources import settings as settings_src
from quirework.sources import sinks
from quirework.sources.structured_text import read_structured_text
from quirework.schema import RAW_ANNOTATION

SPAN = "doc_id long, page_number int, span_id long, text string, x0 double, y0 double, x1 double, y1 double"


def spans(spark, rows):
    return spark.createDataFrame([(1, 0, i, r[0], *map(float, r[1:])) for i, r in enumerate(rows)], SPAN)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


# -- structured text -----------------------------------------------------------------------------------------


def test_structured_text_mixed(spark):
    page = {"blocks": [
        {"type": "image"},
        {"type": "text", "lines": [
            {"text": "obj", "bbox": {"x": 10, "y": 20, "w": 30, "h": 12}, "font": {"name": "F", "size": 9}},
            {"text": "arr", "bbox": [1, 2, 3, 4], "font": {"family": "G"}},
            {"text": "est", "x": 5, "y": 6, "font": {"size": 10}},
            {"text": "short", "bbox": [1, 2], "x": 5, "y": 6},
            {"text": "none"},
            {"text": "", "bbox": [1, 2, 3, 4]},
            {"spans": [{"text": "in", "bbox": [1, 2, 3, 4]}, {"text": "skip", "bbox": [1], "x": 1, "y": 1}, {"text": "no"}]},
        ]},
        {"type": "paragraph", "lines": [{"text": "p", "x": 0, "y": 0}]},
    ]}
    df = spark.createDataFrame(
        [(1, 0, 100.0, json.dumps(page)), (2, 0, 100.0, json.dumps(page["blocks"])), (3, 0, 100.0, "broken")],
        "doc_id long, page_number int, page_height double, json string")
    got = read_structured_text(df).orderBy("doc_id", "span_id")
    one = [(r.text, r.x0, r.y0, r.x1, r.y1) for r in got.collect() if r.doc_id == 1]
    assert one == [
        ("obj", 10.0, 68.0, 40.0, 80.0), ("arr", 1.0, 96.0, 3.0, 98.0), ("est", 5.0, 84.0, 5 + 3 * 10.0 * 0.6, 94.0),
        ("short", 5.0, 82.0, 5 + 5 * 12.0 * 0.6, 94.0), ("in", 1.0, 96.0, 3.0, 98.0), ("p", 0.0, 88.0, 12.0 * 0.6, 100.0)]
    assert [r.font for r in got.filter("doc_id = 1").collect()][:2] == ["F", "G"]
    assert got.filter("doc_id = 2").count() == 6 and got.filter("doc_id = 3").count() == 0


# -- reading order -------------------------------------------------------------------------------------------


def test_reading_order_edges(spark):
    """Exactly 5 pt stays on the line, more starts a new one, a chain of small steps is one line."""
    s = spans(spark, [("b", 50, 100, 60, 110), ("a", 10, 95, 20, 105), ("c", 5, 89.99, 15, 100),
                      ("e", 30, 40, 40, 50), ("d", 20, 36, 30, 46), ("f", 10, 32, 15, 40)])
    for hot in (None, 1000, 1):
        got = {r.text: (r.line_index, r.read_index) for r in text.reading_order(s, hot_rows=hot).collect()}
        assert got == {"a": (0, 0), "b": (0, 1), "c": (1, 2), "f": (2, 3), "d": (2, 4), "e": (2, 5)}


def test_reading_order_ignores_input_order(spark):
    rng = random.Random(3)
    data = [(1, p, i, f"w{i}", rng.random() * 500, rng.choice([100.0, 103.0, 300.0, 500.5]), 0.0, 0.0)
            for p in range(3) for i in range(60)]
    want = None
    for parts in (1, 7):
        rng.shuffle(data)
        got = rows(text.reading_order(spark.createDataFrame(data, SPAN).repartition(parts), hot_rows=40), "page_number", "span_id", "read_index")
        want = want or got
        assert got == want


def test_dense_and_plain_agree(spark):
    rng = random.Random(4)
    data = [(1, 0, i, "x", rng.choice([rng.random() * 600, 10.0]), rng.random() * 800, 0.0, 0.0) for i in range(2000)]
    s = spark.createDataFrame(data, SPAN)
    keys = ("span_id", "line_index", "read_index")
    assert rows(text.reading_order(s, hot_rows=None), *keys) == rows(text.reading_order(s, hot_rows=10), *keys)


# -- selection -----------------------------------------------------------------------------------------------


def test_touching_counts_as_intersecting(spark):
    s = spans(spark, [("left", 0, 0, 10, 10), ("far", 20.01, 0, 30, 10)])
    rect = spark.createDataFrame([(7, 1, 0, 10.0, 10.0, 20.0, 200.0)],
                                 "sel_id long, doc_id long, page_number int, x0 double, y0 double, x1 double, y1 double")
    assert rows(selection.select_in_rect(s, rect), "text") == [("left",)]


def flow_by_loop(ordered, start, end):
    """Index rule of the flow selection, walked span by span."""
    if end[1] > start[1] or (abs(end[1] - start[1]) < 5 and end[0] < start[0]):
        start, end = end, start
    first = last = None
    for i, (x0, y0, x1, y1) in enumerate(ordered):
        if first is None:
            near = y0 - 5 <= start[1] <= y1 + 5
            if (near and start[0] <= x1) or (not near and start[1] > y1):
                first = i
        if y0 - 5 <= end[1] <= y1 + 5:
            last = i if end[0] >= x0 else last
        elif end[1] > (y0 + y1) / 2:
            last = i - 1 if last is None and i > 0 else last
        else:
            last = i
    first, last = first or 0, len(ordered) - 1 if last is None else last
    return (min(first, last), max(first, last))


def test_flow_matches_loop(spark):
    rng = random.Random(5)
    data = [(1, 0, i, f"w{i}", float(40 * (i % 6)), 700.0 - 20 * (i // 6), 40.0 * (i % 6) + 30, 712.0 - 20 * (i // 6))
            for i in range(60)]
    ordered = text.reading_order(spark.createDataFrame(data, SPAN), "center", hot_rows=None)
    boxes = [(r.x0, r.y0, r.x1, r.y1) for r in ordered.orderBy("read_index").collect()]
    sels = [(k, 1, 0, *[float(rng.randint(-20, 300)) if j % 2 == 0 else float(rng.randint(480, 760)) for j in range(4)])
            for k in range(80)]
    df = spark.createDataFrame(sels, "sel_id long, doc_id long, page_number int, sx double, sy double, ex double, ey double")
    got = {}
    for r in selection.select_by_flow(ordered, df).collect():
        lo, hi = got.get(r.sel_id, (10 ** 9, -1))
        got[r.sel_id] = (min(lo, r.read_index), max(hi, r.read_index))
    assert got == {k: flow_by_loop(boxes, (sx, sy), (ex, ey)) for k, _, _, sx, sy, ex, ey in sels}


# -- redaction -----------------------------------------------------------------------------------------------


def test_redaction_leaves_nothing_under_a_rect(spark):
    rng = random.Random(6)
    data = [(1, 0, i, "abcdefgh"[: 1 + i % 8], float(rng.randint(0, 400)), float(rng.randint(0, 700)), 0.0, 0.0) for i in range(200)]
    data = [(*d[:6], d[4] + 7.0 * len(d[3]), d[5] + 10) for d in data]
    s = spark.createDataFrame(data, SPAN)
    pages_ = spark.createDataFrame([(1, 0, 612.0, 792.0, 0)], "doc_id long, page_number int, width double, height double, rotation int")
    boxes = [(1, 0, "redact", float(rng.randint(-50, 400)), float(rng.randint(-50, 700)), float(rng.choice([0, 60, 200])), float(rng.choice([0, 30])))
             for _ in range(12)]
    a = spark.createDataFrame(boxes, "doc_id long, page_number int, type string, x double, y double, width double, height double")
    left, kept, report = redact.apply_redactions(s, a, pages_)
    areas = [tuple(r)[2:] for r in redact.redaction_areas(a, pages_).collect()]
    whole = {r.span_id: 0 for r in s.collect()}
    touched = {d[2] for d in data for x0, y0, x1, y1 in areas for i in range(len(d[3]))
               if d[4] + i * 7.0 <= x1 and d[4] + (i + 1) * 7.0 >= x0 and d[5] <= y1 and d[5] + 10 >= y0}
    for r in selection.explode_characters(left).collect():
        for x0, y0, x1, y1 in areas:
            assert not (r.x1 - 1e-6 > x0 and r.x0 + 1e-6 < x1 and r.y1 >= y0 and r.y0 <= y1)
        whole[r.span_id] += 1
    n = sum(len(d[3]) for d in data) - sum(whole.values())
    assert report.agg(F.sum("characters_removed")).first()[0] == n
    assert {k for k, v in whole.items() if v < len(data[k][3])} == touched
    assert kept.count() == 0


# -- pages ---------------------------------------------------------------------------------------------------

PAGE = "doc_id long, page_number int, width double, height double, rotation int"


def page_table(spark, n, doc=1):
    return spark.createDataFrame([(doc, i, 612.0 + i, 792.0, 90 * (i % 4)) for i in range(n)], PAGE)


def test_delete_refuses_all_pages_and_ignores_repeats(spark):
    p = page_table(spark, 4).unionByName(page_table(spark, 2, 2))
    gone = spark.createDataFrame([(1, 1), (1, 1), (1, 9), (2, 0), (2, 1)], "doc_id long, page_number int")
    assert rows(pages.deletion_map(p, gone), "doc_id", "page_number", "new_page_number") == [
        (1, 0, 0), (1, 2, 1), (1, 3, 2), (2, 0, 0), (2, 1, 1)]


def test_delete_undoes_insert(spark):
    p = page_table(spark, 5)
    grown = pages.insert_blank(p, spark.createDataFrame([(1, 3)], "doc_id long, at int"))
    back = pages.renumber(grown, pages.deletion_map(grown, spark.createDataFrame([(1, 3)], "doc_id long, page_number int")))
    assert rows(back, *p.columns) == rows(p, *p.columns)
    first = pages.insert_blank(p, spark.createDataFrame([(1, 0)], "doc_id long, at int"))
    assert rows(first.filter("page_number = 0"), "width") == [(612.0,)] and first.count() == 6


def test_reorder_is_the_list_splice(spark):
    rng = random.Random(7)
    n, want, reqs = 9, [], []
    for doc in range(30):
        ops = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(1, 6))]
        order = list(range(n))
        for a, b in ops:
            order.insert(b, order.pop(a))
        want += [(doc, old, new) for new, old in enumerate(order)]
        reqs.append((doc, ops))
    p = spark.createDataFrame([(d, i) for d in range(30) for i in range(n)], "doc_id long, page_number int")
    r = spark.createDataFrame(reqs, "doc_id long, ops array<struct<from_index: int, to_index: int>>")
    assert rows(pages.reorder_map(p, r), "doc_id", "page_number", "new_page_number") == sorted(want)


def test_drag_to_ops(spark):
    df = spark.createDataFrame([([4, 2], 8), ([2, 4], 1), ([1], 1)], "d array<int>, t int")
    got = [[tuple(o) for o in r[0]] for r in df.select(pages.drag_to_ops(F.col("d"), F.col("t"))).collect()]
    assert got == [[(2, 6), (4, 7)], [(2, 1), (4, 2)], [(1, 1)]]


@pytest.mark.parametrize("mode", ["reference", "geometric"])
def test_four_quarter_turns(spark, mode):
    a = spark.createDataFrame([(1, 0, "a", 10.0, 20.0, 30.0, 40.0, [[1.0, 2.0, 3.0, 2.0, 3.0, 5.0, 1.0, 5.0]])],
                              "doc_id long, page_number int, ann_id string, x double, y double, width double, height double, quads array<array<double>>")
    turned, p = a, spark.createDataFrame([(1, 0, 612.0, 792.0, 0)], PAGE)
    seen = []
    for k in range(4):
        new = spark.createDataFrame([(1, 0, (k + 1) * 90 % 360)], "doc_id long, page_number int, new_rotation int")
        turned = pages.rotate_annotations(turned, p, new, mode)
        p = pages.rotate_pages(p, spark.createDataFrame([(1, 0, 90)], "doc_id long, page_number int, degrees int"))
        seen.append(turned.first())
    # The unrotated page is the frame throughout, so each turn uses the same width and height.
    assert rows(p, *p.columns) == [(1, 0, 612.0, 792.0, 0)]
    assert tuple(seen[0])[5:7] == (40.0, 30.0)
    assert (seen[0].x, seen[0].y) == ((20.0, 602.0) if mode == "reference" else (792.0 - 20 - 40, 10.0))
    assert seen[0].quads[0][:2] == [790.0, 1.0]


def test_page_ranges(spark):
    cases = {"1-5, 8, 11-13": [0, 1, 2, 3, 4, 7, 10, 11, 12], "-3": [0, 1, 2], "4-": list(range(3, 13)), "9-2": [], "x": [],
             "": [], "2,2, 1-2": [0, 1], "0": [], "12-99": [11, 12], "3x": [2], "x-2": [0, 1], " 5 - 6 ": [4, 5]}
    df = spark.createDataFrame([(i, t, 13) for i, t in enumerate(cases)], "doc_id long, custom_range string, page_count int")
    for block in (65536, 4):
        got = {i: [] for i in range(len(cases))}
        for d, p in rows(pages.expand_page_range(df, block=block), "doc_id", "page_number"):
            got[d].append(p)
        assert list(got.values()) == list(cases.values())


@pytest.mark.parametrize("per", [1, 2, 4, 6, 9, 16])
def test_nup(spark, per):
    for n in (1, 5, 16, 17):
        s = spark.createDataFrame([(1, per)], "doc_id long, pages_per_sheet int")
        got = pages.nup_layout(page_table(spark, n), s)
        cols = pages.SHEET_COLUMNS[per]
        want = [(i // per, i % per, i % per // cols, i % per % cols, i if i < n else None) for i in range(math.ceil(n / per) * per)]
        assert [tuple(r) for r in got.select("sheet", "slot", "row", "col", "page_number").orderBy("sheet", "slot").collect()] == want


def test_long_documents_cross_chunks(spark):
    p = spark.range(5000).select(F.lit(1).alias("doc_id").cast("long"), F.col("id").cast("int").alias("page_number"),
                                 F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.lit(0).alias("rotation"))
    gone = p.filter("page_number % 3 = 0").select("doc_id", "page_number")
    m = {r.page_number: r.new_page_number for r in pages.deletion_map(p, gone).collect()}
    assert m == {old: i for i, old in enumerate(i for i in range(5000) if i % 3)}
    tops = {r.page_number: r.top for r in pages.page_offsets(p).collect()}
    assert all(tops[i] == i * 816.0 for i in range(5000))


# -- paths and values ----------------------------------------------------------------------------------------


def simplify(pts, tol):
    """Recursive form."""
    def away(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        n = dx * dx + dy * dy
        u = 0 if n == 0 else min(1, max(0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n))
        return math.dist(p, (a[0] + u * dx, a[1] + u * dy))

    if len(pts) < 3:
        return pts
    far = [away(p, pts[0], pts[-1]) for p in pts[1:-1]]
    top = max(far)
    if top <= tol:
        return [pts[0], pts[-1]]
    k = far.index(top) + 1
    return simplify(pts[: k + 1], tol)[:-1] + simplify(pts[k:], tol)


def test_simplify(spark):
    rng = random.Random(8)
    data = []
    for k in range(12):
        x, y, pts = 0.0, 0.0, []
        for _ in range(rng.choice([50, 101, 300])):
            x, y = x + rng.random() * 3, y + rng.uniform(-3, 3)
            pts.append((x, y))
        data.append((k, pts))
    df = spark.createDataFrame(data, "k int, path array<struct<x: double, y: double>>")
    got = {r.k: [tuple(p) for p in r.s] for r in df.select("k", paths.simplify_path(F.col("path"), 2.0, 100).alias("s")).collect()}
    assert got == {k: simplify(p, 2.0) if len(p) > 100 else p for k, p in data}


def test_simplify_batches(spark):
    """Paths of one batch don't meet; null paths, repeated and missing points; many paths come in one call."""
    rng = random.Random(9)
    zigzag = [(float(i), 50.0 * (i % 2) + rng.random()) for i in range(120)]
    closed = [(10.0 * math.cos(i / 20), 10.0 * math.sin(i / 20)) for i in range(126)] + [(10.0, 0.0)]
    given = [zigzag, None, [(1.0, 1.0)] * 150, [], closed, [(float(i), 0.0) for i in range(200)], zigzag[:100], None]
    df = spark.createDataFrame(list(enumerate(given)), "k int, path array<struct<x: double, y: double>>").coalesce(1)
    got = {r.k: r.s and [tuple(p) for p in r.s] for r in df.select("k", paths.simplify_path(F.col("path"), 2.0, 100).alias("s")).collect()}
    assert got == {k: simplify(p, 2.0) if p and len(p) > 100 else p for k, p in enumerate(given)}
    hole = [(float(i), None if i == 60 else 0.0) for i in range(120)]
    row = spark.createDataFrame([(hole,)], "path array<struct<x: double, y: double>>").select(paths.simplify_path(F.col("path"), 2.0, 100))
    assert [tuple(p) for p in row.first()[0]] == [hole[0], hole[-1]]


def test_simplify_at_once():
    """50,000 points in 500 paths take a few numpy calls for each depth, not for each cut."""
    import numpy as np

    n, size = 500, 100
    rng = random.Random(10)
    x, y = np.tile(np.arange(size, dtype=float), n), np.tile([50.0 * (i % 2) + rng.random() for i in range(size)], n)
    starts = np.arange(n) * size
    keep = paths._keep_mask(x, y, starts, starts + size, 2.0)
    assert (keep.reshape(n, size) == keep[:size]).all()
    one = [(p, q) for p, q, k in zip(x[:size], y[:size], keep[:size]) if k]
    assert one == simplify(list(zip(x[:size], y[:size])), 2.0)


def test_paths_are_dealt_out(spark):
    from quirework.catalog import scalars

    assert scalars._paths(spark, "/root/testdata/sf0.001", 160).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_path_quads(spark):
    df = spark.createDataFrame([(0, [(0.0, 0.0), (10.0, 0.0), (10.0, 0.0)]), (1, [(5.0, 5.0)]), (2, [])],
                               "k int, path array<struct<x: double, y: double>>")
    got = {r.k: r.q for r in df.select("k", paths.path_to_quads(F.col("path"), F.lit(4.0)).alias("q")).collect()}
    square = [8.0, -2.0, 12.0, -2.0, 12.0, 2.0, 8.0, 2.0]
    assert got == {0: [[0.0, 2.0, 0.0, -2.0, 10.0, -2.0, 10.0, 2.0], square], 1: [[3.0, 3.0, 7.0, 3.0, 7.0, 7.0, 3.0, 7.0]], 2: []}


def test_point_forms(spark):
    texts = ["[1,2,3,4,5]", "[[1,2],[3,4]]", "[[1,2,3,4]]", "[[[1,2],[3,4],[5]]]", "[1,NaN,3,4]", "oops", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    got = [[tuple(p) for p in r[0]] for r in df.orderBy("k").select(paths.parse_points(F.col("t"))).collect()]
    two = [(1.0, 2.0), (3.0, 4.0)]
    assert got == [two, two, two, two, [(3.0, 4.0)], [], []]


def test_labels(spark):
    df = spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (1280,), (5 * 1024 ** 4,)], "n long")
    assert [r[0] for r in df.select(values.format_bytes(F.col("n"))).collect()] == ["0 B", "1023 B", "1 KB", "1.5 KB", "1.3 KB", "5120 GB"]
    names = spark.createDataFrame([("a.b.pdf",), (".hidden",), ("plain",)], "n string")
    assert [r[0] for r in names.select(values.base_name(F.col("n"))).collect()] == ["a.b", ".hidden", "plain"]


def test_flip_is_its_own_inverse(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "a double, b double, c double, d double")
    f = g.flip_bbox(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.lit(792.0))
    ff = g.flip_bbox(f["x0"], f["y0"], f["x1"], f["y1"], F.lit(792.0))
    assert tuple(df.select(ff.alias("r")).first().r) == (1.0, 2.0, 3.0, 4.0)


# -- annotations ---------------------------------------------------------------------------------------------


def raw_rows(spark, *records):
    names = [p.strip().split(" ")[0] for p in raw_src._top_level(RAW_ANNOTATION)]
    base = {"doc_id": 1, "page_number": 0, "source": "list", "page_height": 800.0}
    return spark.createDataFrame(
        [tuple({**base, "ord": i, **r}.get(n) for n in names) for i, r in enumerate(records)], RAW_ANNOTATION)


STAMP = json.dumps({"type": "stamp", "stampData": {"id": "s", "name": "n", "type": "text"}})


def test_raw_annotations(spark):
    rect = [10.0, 20.0, 110.0, 70.0]
    records = [
        {"subtype": "Highlight", "quads": [[10.0, 10.0, 20.0, 10.0, 20.0, 30.0, 10.0, 30.0]], "contents": "c"},
        {"subtype": "Highlight", "rect": rect, "color": [1.0, 0.0, 0.5], "opacity": 0.2},
        {"subtype": "Highlight", "quads": [[5.0] * 8]},
        {"subtype": "Redact", "rect": rect}, {"subtype": "Redact"},
        {"subtype": "Stamp", "rect": rect, "contents": STAMP}, {"subtype": "Stamp", "rect": rect, "contents": "Approved"},
        {"subtype": "FreeText", "rect": rect, "contents": STAMP, "flags": {"StampAnnotation": "true"}},
        {"subtype": "FreeText", "rect": rect, "contents": json.dumps({"type": "image", "imageData": "d"}), "flags": {"ImageWidth": "64"}},
        {"subtype": "FreeText", "rect": rect, "contents": json.dumps({"type": "callout", "boxPosition": {"x": 5, "y": 100}})},
        {"subtype": "FreeText", "rect": rect, "contents": "plain", "flags": {"CustomAnnotation": "/true", "HTMLContent": "(<b>x</b>)", "BackgroundColor": r"(rgb\(1\))"}},
        {"subtype": "FreeText", "rect": rect, "contents": "native"},
        {"subtype": "Line", "line": "[300,300,400,350]"}, {"subtype": "Line", "line": "[[10,10],[20,20]]"},
        {"subtype": "Line", "line": "[1,2,300000,4]"}, {"subtype": "Line", "line": "garbage"},
        {"subtype": "Square", "rect": rect, "interior_color": [0.0, 1.0, 0.0]}, {"subtype": "Circle", "rect": rect, "border_width": 0.0},
        {"subtype": "Ink", "ink": "[[1,2,3,4]]"}, {"subtype": "Ink", "ink": "[[[1,2],[3,5]]]", "flags": {"BM": "/Multiply", "CA": "0.3"}},
        {"subtype": "Ink", "ink": "[[1,2]]"}, {"subtype": "Popup", "rect": rect},
    ]
    got = {r.ord: r for r in raw_src.load_annotations(raw_rows(spark, *records)).collect()}
    kinds = {k: (r.type, r.highlight_mode or r.shape_type) for k, r in got.items()}
    assert kinds == {
        0: ("highlight", "text"), 1: ("highlight", "text"), 3: ("redact", None), 5: ("stamp", None), 7: ("stamp", None),
        8: ("image", None), 9: ("callout", None), 10: ("text", None), 12: ("shape", "arrow"), 16: ("shape", "rectangle"),
        17: ("shape", "circle"), 18: ("draw", None), 19: ("highlight", "overlay")}
    assert (got[0].y, got[0].height, got[0].color, got[0].opacity) == (770.0, 20.0, "#FFFF00", 0.5)
    assert (got[1].color, got[1].opacity, got[1].y) == ("#ff0080", 0.2, 20.0)
    assert (got[5].y, got[5].stamp_id, got[3].y) == (730.0, "s", 20.0)
    assert (got[8].image_width, got[8].image_height, got[8].preserve_aspect) == (64.0, 200.0, True)
    assert (got[9].x, got[9].y, got[9].font_size, got[9].color) == (5.0, 700.0, 12.0, "#000000")
    assert (got[10].content, got[10].background_color, got[10].has_background) == ("<b>x</b>", "rgb(1)", True)
    assert (got[12].stroke_width, got[12].arrow_head_size) == (2.0, 10.0)
    assert (got[16].fill_color, got[16].fill_opacity, got[17].fill_color, got[17].stroke_width) == ("#00ff00", 0.5, None, 2.0)
    assert ([tuple(p) for p in got[18].path], got[18].stroke_width) == ([(1.0, 798.0), (3.0, 796.0)], 3.0)
    assert got[19].opacity == 0.3


def test_widgets_of_both_passes(spark):
    flags = {"FT": "/Tx", "T": "date_a", "Ff": "3"}
    records = [
        {"subtype": "Widget", "rect": [10.0, 700.0, 60.0, 720.0], "flags": flags},
        {"subtype": "Widget", "source": "page", "rect": [10.4, 80.4, 60.0, 100.0], "flags": flags},
        {"subtype": "Widget", "source": "page", "rect": [200.0, 80.0, 220.0, 100.0], "flags": {"FT": "Btn", "Ff": "32768", "ParentT": "(g)", "V": "/Yes"}},
        {"subtype": "Widget", "source": "page", "rect": [200.9, 80.0, 220.0, 100.0], "flags": {"FT": "Btn"}},
        {"subtype": "Widget", "source": "page", "rect": [201.5, 80.0, 220.0, 100.0], "flags": {"FT": "Ch"}, "options": ["a"]},
    ]
    got = {r.ord: r for r in raw_src.load_annotations(raw_rows(spark, *records)).collect()}
    # The fourth is next to the third; the fifth only to the dropped fourth.
    assert sorted(got) == [0, 2, 4]
    assert (got[0].field_type, got[0].required, got[0].read_only, got[0].y) == ("date", True, True, 80.0)
    assert (got[2].field_type, got[2].field_name, got[2].radio_group, got[2].value_bool) == ("radio", "g", "g", True)
    assert got[4].options == ["a"]


def test_raw_round_trip(spark):
    from quirework.catalog.annotations import typed_annotations
    from quirework.plans import fixtures as fx

    sf = "/root/testdata/sf0.001"
    typed = typed_annotations(spark, sf).cache()
    back = raw_src.load_annotations(raw_src.to_raw(typed, fx.pages(spark, sf)), merge_widgets=False)
    skip = {"ann_id", "opacity", "x", "y", "width", "height", "quads", "path", "points", "arrow_point", "box_position"}
    cols = [c for c in typed.columns if c not in skip]
    js = lambda df: {r.ord: r.j for r in df.select("ord", F.to_json(F.struct(*cols)).alias("j")).collect()}
    a, b = js(typed), js(back)
    assert a.keys() == b.keys()
    assert not {k: (a[k], b[k]) for k in a if a[k] != b[k]}
    typed.unpersist()


STORED = ("ann_id string, ord int, doc_id long, page_number int, type string, subtype string, highlight_mode string, x double, y double, "
          "width double, height double, stamp_id string, quads array<array<double>>, path array<struct<x: double, y: double>>")


FAR = [(300.0, 300.0), (400.0, 400.0)]
MATCHES = [
    ("text", "FreeText", {"x": 9.9}, True), ("text", "FreeText", {"x": 10.0}, False),
    ("stamp", "Stamp", {"x": 500.0, "stamp_id": "s"}, True), ("stamp", "Stamp", {"x": 500.0, "stamp_id": "t"}, False),
    ("highlight", "Highlight", {"quads": [[0.05] * 8]}, True), ("highlight", "Highlight", {"quads": [[0.2] * 8]}, False),
    ("highlight", "Highlight", {"quads": [[0.0] * 8] * 2}, False),
    ("draw", "Ink", {"x": 49.0, "width": 500.0, "path": FAR}, True),
    ("draw", "Ink", {"x": 51.0, "width": 500.0, "path": FAR}, False),
    ("draw", "Ink", {"x": 51.0, "width": 149.0, "path": FAR}, True),
    ("draw", "Ink", {"x": 51.0, "width": 500.0, "path": [(4.9, 0.0), (9.0, 9.0)]}, True),
    ("draw", "Ink", {"x": 51.0, "width": 500.0, "path": [(5.0, 0.0), (9.0, 9.0)]}, False),
]


def test_match_tolerances(spark):
    """Every case on its own document, just inside and just outside the tolerance."""
    names = [p.strip().split(" ")[0] for p in raw_src._top_level(STORED)]
    stored, targets = [], []
    for doc, (kind, subtype, change, _) in enumerate(MATCHES):
        base = {"ann_id": f"a{doc}", "ord": 1, "doc_id": doc, "page_number": 0, "type": kind, "subtype": subtype, "highlight_mode": None,
                "x": 0.0, "y": 0.0, "width": 100.0, "height": 100.0, "stamp_id": "s" if kind == "stamp" else None,
                "quads": [[0.0] * 8] if kind == "highlight" else None, "path": [(0.0, 0.0), (9.0, 9.0)] if kind == "draw" else None}
        stored.append(tuple(base[n] for n in names))
        targets.append(tuple({**base, **change}[n] for n in names))
    t = spark.createDataFrame(targets, STORED).withColumn("target_id", F.col("doc_id"))
    found = {r.target_id for r in ann.match_annotations(t, spark.createDataFrame(stored, STORED)).collect()}
    assert found == {doc for doc, case in enumerate(MATCHES) if case[3]}


def test_arrow_chain(spark):
    """Of a chain of three, the middle one is dropped and the last one stays; a turned copy is the same arrow."""
    cols = ("ann_id string, ord int, doc_id long, page_number int, type string, shape_type string, points array<struct<x: double, y: double>>, "
            "x double, y double, width double, height double, handle string")

    def arrow(i, p, q, handle=None):
        return (f"a{i}", i, 1, 0, "shape", "arrow", [p, q], p[0], p[1], 1.0, 1.0, handle)

    batch = spark.createDataFrame([
        arrow(0, (300.0, 300.0), (400.0, 400.0)), arrow(1, (300.9, 300.0), (400.0, 400.0)), arrow(2, (301.5, 300.0), (400.0, 400.0)),
        arrow(3, (400.0, 400.0), (300.2, 300.0)), arrow(4, (10.0, 10.0), (20.0, 20.0)), arrow(5, (500.0, 0.0), (600.0, 0.0), "h"),
        arrow(6, (700.0, 0.0), (800.0, 0.0), "h")], cols)
    store = spark.createDataFrame([arrow(90, (15.0, 15.0), (29.0, 29.0)), arrow(91, (28.0, 28.0), (14.0, 14.0))], cols)
    added, updated = ann.dedupe_on_load(batch, store)
    assert rows(added, "ann_id") == [("a0",), ("a2",), ("a5",)]
    assert rows(updated, "ann_id", "x") == [("a90", 10.0), ("a91", 28.0)]


# -- documents, files ----------------------------------------------------------------------------------------


def test_outline_blank_titles_pages_and_cycles(spark):
    nodes = spark.createDataFrame(
        [(1, 1, None, 0, "A", 3), (1, 2, 1, 1, "B", None), (1, 3, 1, 0, "", 5), (1, 4, None, 1, None, 7), (1, 8, 9, 0, "x", 1), (1, 9, 8, 0, "y", 1)],
        "doc_id long, node_id long, parent_id long, ord int, title string, page_number int")
    got = [tuple(r) for r in documents.flatten_outline(nodes).orderBy("position").select("title", "page_number", "depth").collect()]
    assert got == [("A", 3, 0), ("A > ", 5, 1), ("A > B", 0, 1), ("Untitled", 7, 0)]


def test_scan_and_parse(spark, tmp_path):
    for name in ("a.pdf", "b.PDF", "c.txt"):
        (tmp_path / name).write_bytes(b"1\n2")
    found = doc_src.scan_documents(spark, str(tmp_path), with_content=True)
    assert rows(found, "name", "file_size") == [("a.pdf", 3), ("b.PDF", 3)]

    def count(frames):
        for f in frames:
            yield f.assign(n=[c.count(b"\n") for c in f["content"]])[["name", "n"]]

    assert rows(doc_src.parse_pdf(found, count, "name string, n long"), "name", "n") == [("a.pdf", 1), ("b.PDF", 1)]


def test_exports(spark, tmp_path):
    t = spark.createDataFrame([(1, i, f"t{i}" if i != 1 else None) for i in range(5)], "doc_id long, page_number int, text string")
    sinks.export_text(t, str(tmp_path / "txt"))
    got = "".join(p.read_text() for p in sorted((tmp_path / "txt" / "doc_id=1").glob("part-*")))
    body = [f"t{i}" if i != 1 else "[Error extracting text from page 2]\n" for i in range(5)]
    assert got == "".join(f"--- Page {i + 1} ---\n\n{b}\n\n" for i, b in enumerate(body))
    sinks.write_pages(t, str(tmp_path / "pages"), buckets=None)
    assert (tmp_path / "pages" / "doc_id=1" / "page_number=3").is_dir()
    html = sinks.export_html(t.withColumnRenamed("text", "fragment"), spark.createDataFrame([(1, "a.pdf")], "doc_id long, name string"), 2)
    whole = "\n".join(r.html for r in html.orderBy("part").collect())
    assert whole.startswith("<!DOCTYPE html>") and whole.endswith("</html>") and whole.count('class="page"') == 4 and "<title>a</title>" in whole


def test_settings_parts(spark):
    s = spark.createDataFrame([(d, "a4", "auto", 1, "", "none", "fit", 100.0) for d in range(1, 2501)],
                              "doc_id long, page_size string, orientation string, pages_per_sheet int, custom_range string, margin_preset string, scaling_mode string, custom_scale double")
    written = settings_src.write_settings(s)
    assert written.count() == 3
    assert sorted(int(r.doc_id) for r in settings_src.read_settings(written).collect()) == list(range(1, 2501))


def test_settings_file_has_all_settings_and_any_id(spark):
    whole = {"orientation": "portrait", "pageSize": "custom", "customPageSize": {"width": 4.0, "height": 6.5}, "pagesPerSheet": 4, "pageOrder": "vertical",
             "marginPreset": "custom", "customMargins": {"top": 1.0, "right": 0.5, "bottom": 0.25, "left": 0.0}, "scalingMode": "custom", "customScale": 80.0,
             "printRange": "custom", "customRange": "1-5, 8"}
    given = {"settings": {"doc_a/b \u00fc": whole, "7": {"pageSize": "a4"}, "12345678901234567890": {}}}
    read = settings_src.read_settings(spark.createDataFrame([(json.dumps(given),)], "json string"))
    assert {r.doc_id for r in read.collect()} == set(given["settings"])
    back = {}
    for r in settings_src.write_settings(read).collect():
        back |= json.loads(r.json)["settings"]
    assert back == given["settings"]
    docs = spark.createDataFrame([("doc_a/b \u00fc",), ("7",), ("other",)], "doc_id string")
    got = {r.doc_id: (r.page_order, r.print_range, r.custom_width, r.custom_height, r.margin_top, r.margin_left) for r in documents.effective_settings(docs, read).collect()}
    assert got == {"doc_a/b \u00fc": ("vertical", "custom", 4.0, 6.5, 1.0, 0.0), "7": ("horizontal", "all", 8.27, 11.69, 0.0, 0.0), "other": ("horizontal", "all", 8.5, 11.0, 0.0, 0.0)}


def test_edits_of_settings(spark):
    stored = spark.createDataFrame([("a", "legal", 9.0), ("b", "a4", None), ("c", "a4", 1.0)], "doc_id string, page_size string, custom_width double")
    cols = "doc_id string, ts long, event_id long, action string, page_size string, custom_width double, margin_preset string"
    edits = [("a", 1, 1, "set", "tabloid", None, None), ("a", 2, 2, "set", None, 3.5, None), ("b", 1, 3, "remove", None, None, None),
             ("c", 1, 4, "set", "legal", None, None), ("c", 2, 5, "reset", None, None, None), ("c", 2, 6, "set", None, None, "wide"),
             ("new", 5, 7, "set", "a4", None, None), ("gone", 1, 8, "set", "a4", None, None), ("gone", 2, 9, "remove", None, None, None)]
    got = documents.edit_settings(stored, spark.createDataFrame(edits, cols)).collect()
    assert {r.doc_id: (r.page_size, r.custom_width, r.margin_preset, r.margin_left) for r in got} == {
        "a": ("custom", 3.5, None, None), "c": ("letter", 8.5, "wide", 1.0), "new": ("a4", 8.27, "none", 0.0)}


def test_two_patches_for_one_key(spark):
    base = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "k long, x string, y string")
    patch = spark.createDataFrame([(1, "new", None, 2), (1, "old", "late", 1), (1, "older", None, 0)], "k long, x string, y string, patch_no int")
    assert rows(ann.merge_updates(base, patch, ["k"]), "k", "x", "y") == [(1, "new", "b"), (2, "c", "d")]
    assert ann.merge_updates(base, patch.drop("patch_no"), ["k"]).count() == 2


def test_search_all_hits_and_blank(spark):
    t = spark.createDataFrame([(1, 0, "The " * 150), (1, 1, "other (the)"), (None, 2, "the"), (2, 0, None), (2, 1, "")],
                              "doc_id long, page_number int, text string")
    hits = text.search(t, ["the", " ", "(the)"])
    counts = hits.groupBy("query", "page_number").count()
    assert rows(counts, "query", "page_number", "count") == [("(the)", 1, 1), ("the", 0, 150), ("the", 1, 2), ("the", 2, 1)]
    assert [r.start for r in hits.filter("page_number = 0").orderBy("start").collect()] == [4 * i for i in range(150)]
    assert [r.match_index for r in hits.filter("query = 'the' and doc_id = 1").orderBy("page_number", "start").collect()] == list(range(152))
    first = text.find_matches(t, ["the"], per_page=100)
    assert first.filter("page_number = 0").count() == 100
    assert text.search(t, ["", " "]).count() == 0


def test_search_offsets_of_the_original(spark):
    """Lower-casing can lengthen a text; hits lie in the text as it is."""
    words = "\u0130\u0130\u0130 Secret \u00dcBER x sEcReT"
    t = spark.createDataFrame([(1, 0, words)], "doc_id long, page_number int, text string")
    got = rows(text.find_matches(t, ["secret", "\u00fcber"]), "query", "start", "hit_length")
    assert got == [("secret", 4, 6), ("secret", 18, 6), ("\u00fcber", 11, 4)]


def test_folded_search(spark):
    """Any case and length: a query and a text meet by their full case folding, at whole characters of the text."""
    words = "\u0130stanbul and istanbul; STRASSE, stra\u00dfe Stra\u1e9ee; \ufb01n FIN; \u03a3\u03b1\u03c2"
    t = spark.createDataFrame([(1, 0, words)], "doc_id long, page_number int, text string")

    def at(query):
        return [words[r.start:r.start + r.hit_length] for r in text.find_matches(t, [query]).orderBy("start").collect()]

    assert at("\u0130stanbul") == at("ISTANBUL") == ["\u0130stanbul", "istanbul"] and at("\u0130") == ["\u0130", "i"] + at("i")[2:]
    assert at("strasse") == at("STRA\u00dfE") == ["STRASSE", "stra\u00dfe", "Stra\u1e9ee"]
    assert at("fin") == ["\ufb01n", "FIN"] and at("\u03c3\u03b1\u03c3") == ["\u03a3\u03b1\u03c2"]
    assert at("ras") == ["RAS"] and at("n f") == ["n F"]  # half of a sharp s is no hit
    assert {r.query for r in text.find_matches(t, ["Stra\u00dfe", "STRASSE"]).collect()} == {"strasse"}


def brute_hits(page, needle):
    from quirework.functions.folding import fold

    starts, out, at = [0], [], 0
    for ch in page:
        starts.append(starts[-1] + len(fold(ch)))
    folded, place = fold(page), {p: k for k, p in enumerate(starts)}
    while (at := folded.find(needle, at)) >= 0:
        if at in place and at + len(needle) in place:
            out.append((place[at], place[at + len(needle)] - place[at]))
            at += len(needle)
        else:
            at += 1
    return out


def test_many_needles_against_brute_force(spark):
    import random

    from quirework.functions.folding import fold

    dice = random.Random(8)
    letters = "aAbBsS\u00df\u0130i \ufb01"
    pages = [(d, p, "".join(dice.choice(letters) for _ in range(dice.choice([0, 5, 400])))) for d in (1, 2, None) for p in range(4)]
    needles = {"".join(dice.choice(letters) for _ in range(dice.randint(1, 5))) for _ in range(400)} | {"aaa", "abab", "a" * 40}
    want = {(d, p, q, *h) for d, p, t in pages for q in {fold(n) for n in needles if n.strip()} for h in brute_hits(t, q)}
    df = spark.createDataFrame([*pages, (5, 0, None)], "doc_id long, page_number int, text string")
    table = spark.createDataFrame([(n,) for n in needles] + [(None,), ("",)], "query string")
    got = text.find_matches(df, table)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert {tuple(r) for r in text.find_matches(df, sorted(needles)).collect()} == want


def test_ten_thousand_needles_in_one_pass(spark):
    table = spark.range(10_000).select(F.concat(F.lit("Word"), F.col("id").cast("string"), F.lit(".")).alias("query"))
    df = spark.createDataFrame([(1, 0, " ".join(f"wORD{k}." for k in range(0, 10_000, 3)))], "doc_id long, page_number int, text string")
    hits = text.find_matches(df, table)
    assert hits.count() == 3334 and hits.select("query").distinct().count() == 3334
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


@pytest.mark.parametrize("table_bytes", [1 << 26, 600])
@pytest.mark.parametrize("per_page", [None, 2])
def test_needles_in_tables_against_automaton(spark, monkeypatch, table_bytes, per_page):
    """Every length by its table of hashes: the same hits, in one pass or several, with folding, overlaps and limits."""
    dice = random.Random(9)
    letters = "aAbB\u00df\u0130i \ufb01\u4e2d\U0001d400"
    pages = [(d, p, "".join(dice.choice(letters) for _ in range(dice.choice([0, 3, 300])))) for d in (1, None) for p in range(4)]
    df = spark.createDataFrame([*pages, (5, 0, None)], "doc_id long, page_number int, text string")
    needles = sorted({"".join(dice.choice(letters) for _ in range(dice.randint(1, 4))) for _ in range(150)} | {"aaa", "abab", "a" * 500})
    want = sorted(map(str, text.find_matches(df, needles, per_page).collect()))
    monkeypatch.setattr(text, "MANY_NEEDLES", 1)
    monkeypatch.setattr(text, "TABLE_BYTES", table_bytes)
    table = spark.createDataFrame([(n,) for n in needles] + [(None,), ("",)], "query string")
    assert sorted(map(str, text.find_matches(df, needles, per_page).collect())) == want
    assert sorted(map(str, text.find_matches(df, table, per_page).collect())) == want and want


def test_many_characters_of_needles_are_one_pass(spark):
    table = spark.range(150_000).select(F.format_string("w%07d", F.col("id")).alias("query"))
    df = spark.createDataFrame([(1, 0, " ".join(f"W{k:07d}" for k in range(0, 150_000, 50)))], "doc_id long, page_number int, text string")
    hits = text.find_matches(df, table)
    assert hits.count() == 3000 and hits.select("query").distinct().count() == 3000
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_needles_in_parts(spark, monkeypatch):
    monkeypatch.setattr(text, "NEEDLE_CHARS", 10)
    df = spark.createDataFrame([(1, 0, "alpha beta gamma delta")], "doc_id long, page_number int, text string")
    hits = text.find_matches(df, ["ALPHA", "beta", "gamma", "delta", "epsilon"])
    assert rows(hits, "query", "start") == [("alpha", 0), ("beta", 6), ("delta", 17), ("gamma", 11)]


def test_structured_text_is_parsed_once(spark):
    """Two schemas of the whole, and of each box two: no place of a box parses it for itself, no filter parses the blocks again."""
    df = spark.createDataFrame([
        (1, 0, 100.0, '{"blocks": [{"type": "text", "lines": [{"text": "a", "bbox": [1, 2, 3, 4]}]}, {"type": "text"}]}'),
        (2, 0, 100.0, '[{"type": "paragraph", "lines": [{"text": "b", "bbox": {"x": 1, "y": 2, "w": 3, "h": 4}}]}]'),
        (3, 0, 100.0, "[]"), (4, 0, 100.0, None), (5, 0, 100.0, '[{"type": "text", "lines": []}, null]')],
        "doc_id long, page_number int, page_height double, json string")
    read = read_structured_text(df)
    assert rows(read, "doc_id", "text", "x0", "x1", "y0", "y1") == [(1, "a", 1.0, 3.0, 96.0, 98.0), (2, "b", 1.0, 4.0, 94.0, 98.0)]
    assert 0 < read._jdf.queryExecution().optimizedPlan().toString().count("from_json(") <= 6


def test_pieces_are_not_compared_by_a_function(spark):
    df = spark.createDataFrame([(1, 0, k, t) for k, t in [(2, "c"), (None, "a"), (1, "b"), (1, None), (3, None)]],
                               "doc_id long, page_number int, read_index long, text string")
    joined = text.page_text(df, "-")
    assert joined.first().text == "a-b-c"
    assert "array_sort" not in joined._jdf.queryExecution().analyzed().toString()


def test_hits_carry_their_spans(spark):
    """The same quads as by the join with all spans, and no span is shuffled for them."""
    dice = random.Random(5)
    words = ["the", "th", "e", "", "stra\u00dfe", "\U0001d400the", "other", None]
    data = [(d, 0, k, dice.choice(words), 10.0 * k, 700.0, 10.0 * k + 9, 712.0) for d in (1, 2, None) for k in range(40)]
    df = spark.createDataFrame(data, SPAN).filter("doc_id is not null")
    offsets = text.span_offsets(text.reading_order(df, hot_rows=None), " ", hot_rows=None)
    carried = text.page_text_with_spans(offsets, " ")
    plain = text.page_text(text.reading_order(df, hot_rows=None), " ")
    assert rows(carried, "doc_id", "text") == rows(plain, "doc_id", "text")
    queries = ["the", "the th", "e", "STRASSE", " "]
    want = text.hit_quads(text.search(plain, queries), offsets)
    got = text.hit_quads(text.search(carried, queries))
    assert rows(got, *want.columns) == rows(want, *want.columns) and got.count() > 50
    assert "Window" in want._jdf.queryExecution().optimizedPlan().toString()
    assert "read_index" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_folded_text_is_redacted(spark):
    data = [(1, 0, k, w, 60.0 * k, 700.0, 60.0 * k + 7 * len(w), 712.0) for k, w in enumerate(["\u0130stanbul", "in", "Stra\u00dfe", "istanbul"])]
    spans = spark.createDataFrame(data, "doc_id long, page_number int, span_id long, text string, x0 double, y0 double, x1 double, y1 double")
    ordered = text.reading_order(spans, hot_rows=None)
    hits = text.search(text.page_text(ordered, " "), ["\u0130stanbul", "STRASSE"])
    left, _ = redact.search_and_redact(spans, text.hit_quads(hits, text.span_offsets(ordered, " ", hot_rows=None)))
    assert [r.text for r in left.collect()] == ["in"]


def test_no_redacted_text_survives(spark):
    """What was sought and removed is found no more, on dense pages and next to letters that change length."""
    import random

    dice = random.Random(6)
    data, sid = [], 0
    for page in range(3):
        for line in range(40):
            for word in range(8):
                w = dice.choice(["secret", "SECRET", "xsecretx", "\u0130\u0130secret", "plain", "se", "cret", "secretsecret"])
                data.append((1, page, sid, w, 60.0 * word, 800.0 - 16 * line, 60.0 * word + 7.0 * len(w), 812.0 - 16 * line))
                sid += 1
    spans = spark.createDataFrame(data, "doc_id long, page_number int, span_id long, text string, x0 double, y0 double, x1 double, y1 double")
    ordered = text.reading_order(spans, hot_rows=None)
    hits = text.search(text.page_text(ordered, " "), ["secret"])
    per_page = [r["count"] for r in hits.groupBy("page_number").count().collect()]
    assert min(per_page) > 100
    boxes = text.hit_quads(hits, text.span_offsets(ordered, " ", hot_rows=None))
    left, ranges = redact.search_and_redact(spans, boxes)
    kept = "".join(r.text for r in left.collect())
    assert not any("secret" in r.text.lower() for r in left.collect())
    whole = sum(len(d[3]) for d in data)
    assert len(kept) == whole - 6 * hits.count()
    assert ranges.count() > 300


def test_spans_without_areas_are_passed_by(spark):
    """Only spans of documents and pages with areas are spread over bands; the pairs are all there, each once."""
    from quirework.operators import selection

    rng = random.Random(12)
    box = lambda: (x := rng.random() * 500, y := rng.random() * 700, x + 60.0, y + 100.0)
    spans = [(d, p, i, "t", *box()) for d in (1, 2, 3) for p in range(3) for i in range(60)] + [(None, 0, 1, "t", *box())]
    rects = [(k, d, p, *box()) for k, (d, p) in enumerate([(1, 0), (1, 0), (1, 2), (3, 1), (7, 0), (None, 0)])]
    df = selection.select_in_rect(
        spark.createDataFrame(spans, SPAN), spark.createDataFrame(rects, "sel_id long, doc_id long, page_number int, x0 double, y0 double, x1 double, y1 double"))
    want = sorted((r[0], s[0], s[1], s[2]) for r in rects for s in spans if r[1] is not None and r[1:3] == s[:2]
                  and s[6] >= r[3] and s[4] <= r[5] and s[7] >= r[4] and s[5] <= r[6])
    assert want and sorted((r.sel_id, r.doc_id, r.page_number, r.span_id) for r in df.collect()) == want
    assert df._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") >= 2


def test_dense_page_of_ordinary_lines_makes_no_chunks(spark, monkeypatch):
    """Only lines beyond the limit are scanned in chunks, and only pages with more heights than the limit."""
    data = [(1, 0, i, "x", float(i * 37 % 600), 20.0 * (i // 30), 0.0, 0.0) for i in range(600)]
    data += [(1, 1, i, "x", float(i * 37 % 600), 20.0 if i < 500 else 40.0 * i, 0.0, 0.0) for i in range(600)]
    s, scanned, scan = spark.createDataFrame(data, SPAN), [], text.ordered_scan
    monkeypatch.setattr(text, "ordered_scan", lambda df, *a, **k: scanned.append(df.count()) or scan(df, *a, **k))
    keys = ("page_number", "span_id", "line_index", "read_index")
    assert rows(text.reading_order(s, hot_rows=200), *keys) == rows(text.reading_order(s, hot_rows=None), *keys)
    assert scanned[-1] == 500 and max(scanned[:-1], default=0) == 0
    assert rows(text.reading_order(s, hot_rows=20), *keys) == rows(text.reading_order(s, hot_rows=None), *keys)


def test_dense_pages_keep_odd_spans(spark):
    """The plan for dense pages orders null, NaN and tied coordinates as the plain one does."""
    nan = float("nan")
    data = [(1, 0, i, "t", x, y, x, y) for i, (x, y) in enumerate(
        [(1.0, 700.0), (None, 700.0), (nan, 700.0), (2.0, None), (3.0, nan), (None, None), (1.0, 700.0), (5.0, 300.0), (-4.0, 299.0), (1.0, 2.0)])]
    s = spark.createDataFrame(data, "doc_id long, page_number int, span_id long, text string, x0 double, y0 double, x1 double, y1 double")
    keys = ["span_id", "line_index", "read_index"]
    assert rows(text.reading_order(s, hot_rows=None), *keys) == rows(text.reading_order(s, hot_rows=3), *keys)
    assert text.reading_order(s, hot_rows=3).count() == len(data)


def test_ordered_scan_null_keys(spark):
    from quirework.plans.scan import ordered_scan

    data = [(k, v) for k in (None, "", "a") for v in (None, 1, 2, 70, 71, 200)]
    df = spark.createDataFrame(data, "k string, v long")
    got = ordered_scan(df, ["k"], (F.col("v") / 64).cast("int"), [F.col("v")], rank="r", sums={"s": F.col("v")},
                       lags={"p": F.col("v")}, totals={"n": F.count(F.lit(1))}).collect()
    assert len(got) == len(data) and all(r.n == 6 for r in got)
    for k in (None, "", "a"):
        mine = sorted((r for r in got if r.k == k), key=lambda r: r.r)
        assert [r.v for r in mine] == [None, 1, 2, 70, 71, 200] and [r.s for r in mine] == [0, 0, 1, 3, 73, 144]
        assert [r.p for r in mine] == [None, None, 1, 2, 70, 71]


def test_several_requests_for_a_document(spark):
    page = spark.createDataFrame([(1, i, float(i), 1.0, 0) for i in range(3)] + [(2, i, 10.0 + i, 1.0, 0) for i in range(2)],
                                 "doc_id long, page_number int, width double, height double, rotation int")
    req = spark.createDataFrame([(1, 1, 2, [0], 1), (1, 0, 2, [1, 0], 2), (1, 1, 2, None, 3)],
                                "doc_id long, at int, source_doc_id long, source_pages array<int>, ord int")
    got = {r.page_number: r.width for r in pages.insert_pages(page.filter("doc_id = 1"), page, req).collect()}
    want = [0.0, 1.0, 2.0]
    for at, fresh in ((1, [10.0]), (0, [11.0, 10.0]), (1, [10.0, 11.0])):  # each in what the one before has left
        want[at:at] = fresh
    assert [got[i] for i in range(len(want))] == want and len(got) == len(want)


def test_repeated_values_and_closed_tabs(spark):
    fields = spark.createDataFrame([(1, "a", "text", "old", None)], "doc_id long, field_name string, field_type string, value_str string, value_bool boolean")
    given = spark.createDataFrame([(1, "a", "x", None, 2), (1, "a", "z", None, 1)], "doc_id long, field_name string, value_str string, value_bool boolean, ord int")
    assert [r.value_str for r in documents.fill_forms(fields, given).collect()] == ["x"]
    tabs = spark.createDataFrame([(1, i, i) for i in range(4)], "user_id long, tab_id long, ord long")
    got = rows(documents.active_after_close(tabs, tabs.filter("tab_id in (1, 2)")), "closed_id", "active_id")
    assert got == [(1, 0), (2, 0)]
    got = rows(documents.active_after_close(tabs, tabs.filter("tab_id in (0, 1)")), "closed_id", "active_id")
    assert got == [(0, 2), (1, 2)]


def test_bad_records_are_skipped(spark):
    got = spark.createDataFrame([("rgb(1.2.3,4,5)",), ("rgb(255,0,0)",)], "c string").select(values.parse_color(F.col("c")).alias("v")).collect()
    assert [round(sum(tuple(r.v)), 3) for r in got] == [0.0, 1.0]
    df = spark.createDataFrame([('{"settings": {"x": {"pageSize": "a4"}, "7": {"pageSize": "legal"}}}',)], "json string")
    assert sorted(((r.doc_id, r.page_size) for r in settings_src.read_settings(df).collect()), key=str) == [("7", "legal"), ("x", "a4")]


# -- rounds of the iterative operators -----------------------------------------------------------------------------


def jobs_of(spark, run):
    """Spark jobs that a call takes."""
    group = f"count {run.__name__}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("", "")


def greedy(nodes, edges):
    near = {}
    for a, b in edges:
        near.setdefault(b, []).append(a)
    kept = set()
    for n in sorted(nodes):
        if not any(e in kept for e in near.get(n, [])):
            kept.add(n)
    return kept


def test_first_come_against_brute_force(spark):
    from quirework.plans import near

    dice = random.Random(4)
    nodes = list(range(400))
    edges = {tuple(sorted(dice.sample(nodes[:150], 2))) for _ in range(120)} | {tuple(sorted(dice.sample(nodes[150:200], 2))) for _ in range(400)}
    ndf = spark.createDataFrame([(n,) for n in nodes], "node long")
    edf = spark.createDataFrame(list(edges) * 2, "earlier long, later long")
    want = greedy(nodes, edges)
    for block in (1000, 20):
        assert {r.node for r in near.keep_first(ndf, edf, block).collect()} == want
    assert near.keep_first(ndf, edf.limit(0)).count() == 400


def test_a_long_chain_of_near_copies(spark):
    """Ten thousand fields, each within a point of the one before: every second one goes, in a bounded number of jobs."""
    cols = "ann_id string, doc_id long, page_number int, ord long, x double, y double"
    found = spark.range(10_000).selectExpr("lpad(id, 6, '0') as ann_id", "1L as doc_id", "0 as page_number", "id as ord", "id * 0.75 as x", "5.0D as y")
    listed = spark.createDataFrame([], cols)
    out, jobs = jobs_of(spark, lambda: sorted(int(r.ann_id) for r in ann.dedupe_widgets(listed, found).collect()))
    assert out == list(range(0, 10_000, 2)) and jobs < 200


def test_components(spark):
    from quirework.plans.components import components

    dice = random.Random(3)
    edges = [(dice.randrange(300), dice.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1300)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in label.items() if k not in alone}


def plain_outline(nodes):
    """Depth-first walk with the reference's rule for titles."""
    out = {}

    def below(parent, path, depth):
        for n in sorted((n for n in nodes if n[1] == parent), key=lambda n: (n[2], n[0])):
            title = f"{path} > {n[3] or ''}" if path else n[3] or ""
            out[n[0]] = (title or "Untitled", n[4] or 0, depth, len(out))
            below(n[0], title, depth + 1)

    below(None, "", 0)
    return out


def test_outline_with_cycles_gaps_and_blanks(spark):
    dice = random.Random(5)
    nodes = [(k, None if k < 4 else dice.randrange(k), dice.randrange(3), dice.choice(["", None, "A", "b > c"]), dice.choice([None, k])) for k in range(120)]
    nodes += [(200, 201, 0, "c", 1), (201, 202, 0, "c", 1), (202, 200, 0, "c", 1), (203, 202, 0, "c", 1), (204, 204, 0, "s", 1), (205, 999, 0, "lost", 1)]
    cols = "doc_id long, node_id long, parent_id long, ord int, title string, page_number long"
    df = spark.createDataFrame([(d, *n) for d in (None, (1 << 60) + 1) for n in nodes], cols).repartition(3)
    want = plain_outline(nodes)
    got = documents.flatten_outline(df).collect()
    for d in (None, (1 << 60) + 1):
        assert {r.node_id: (r.title, r.page_number, r.depth, r.position) for r in got if r.doc_id == d} == want
    assert documents.flatten_outline(df.limit(0)).count() == 0


def test_deep_outline_in_logarithmic_rounds(spark):
    deep = 3000
    df = spark.range(deep).selectExpr("1L as doc_id", "id as node_id", "case when id > 0 then id - 1 end as parent_id", "0 as ord", "'t' as title", "id as page_number")
    out, jobs = jobs_of(spark, lambda: documents.flatten_outline(df).select("node_id", "depth", "position", F.length("title").alias("n")).collect())
    assert jobs < 300 and all(r.depth == r.position == r.node_id and r.n == 4 * r.node_id + 1 for r in out) and len(out) == deep
