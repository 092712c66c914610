"""Text selection by rectangle, by quads and by flow; hit tests."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import intersects, quad_bbox
from ..plans.bands import band_of, bands, home_band
from ..plans.scan import ordered_scan
from ..plans.settle import settle
from .text import reading_order

PAGE_KEY = ["doc_id", "page_number"]
BAND = 5.0


def explode_characters(spans: DataFrame) -> DataFrame:
    """One row per character, the span's width shared equally."""
    width = (F.col("x1") - F.col("x0")) / F.length("text")
    chars = spans.filter(F.length("text") > 0).withColumn("_w", width).select(
        *[c for c in spans.columns if c not in ("text", "x0", "x1")], "_w", F.col("x0").alias("_x"),
        F.col("x1").alias("_x1"), F.length("text").alias("_n"), F.posexplode(F.split("text", "")).alias("char_index", "text"))
    # A single character keeps its span's box untouched.
    right = F.when(F.col("_n") == 1, F.col("_x1")).otherwise(F.col("_x") + (F.col("char_index") + 1) * F.col("_w"))
    return chars.withColumn("x0", F.col("_x") + F.col("char_index") * F.col("_w")).withColumn("x1", right).drop(
        "_w", "_x", "_x1", "_n")


def band_join(spans: DataFrame, areas: DataFrame) -> DataFrame:
    """Pairs of spans and areas (``ax0, ay0, ax1, ay1``) of a page that intersect, each pair once.

    Spans of documents and then of pages without areas are passed by before anything is shuffled.
    """
    marked = areas.select(*PAGE_KEY).distinct()
    spans = spans.join(marked.select("doc_id").distinct(), "doc_id", "left_semi").join(marked, PAGE_KEY, "left_semi")
    s = spans.withColumn("_band", F.explode(bands(F.col("y0"), F.col("y1"))))
    a = areas.withColumn("_band", F.explode(bands(F.col("ay0"), F.col("ay1"))))
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1", "ax0", "ay0", "ax1", "ay1")]
    return s.join(a, [*PAGE_KEY, "_band"]).filter(
        intersects(*box) & (F.col("_band") == home_band(F.col("y0"), F.col("ay0")))).drop("_band")


def _areas(df, x0, y0, x1, y1):
    return df.select(
        *[c for c in df.columns if c not in (x0, y0, x1, y1)],
        F.col(x0).alias("ax0"), F.col(y0).alias("ay0"), F.col(x1).alias("ax1"), F.col(y1).alias("ay1"))


def select_in_rect(spans: DataFrame, rects: DataFrame) -> DataFrame:
    """Spans that touch each rectangle; ``rects`` has ``sel_id``, the page key and ``x0, y0, x1, y1``."""
    return band_join(spans, _areas(rects, "x0", "y0", "x1", "y1")).drop("ax0", "ay0", "ax1", "ay1")


def select_by_quads(spans: DataFrame, quads: DataFrame) -> DataFrame:
    """Characters under the quads of each selection, each box once; ``quads`` has ``sel_id, quad_index, quad``.

    Whole spans meet the quads first, so that only touched spans are split into characters.  The first of equal
    boxes wins, by quad, then span, then character.
    """
    q = quads.withColumn("_q", quad_bbox(F.col("quad"))).filter(F.col("_q").isNotNull()).select(
        "sel_id", "quad_index", *PAGE_KEY, *[F.col(f"_q.{c}").alias(f"a{c}") for c in ("x0", "y0", "x1", "y1")])
    chars = explode_characters(band_join(spans, settle(q))).filter(
        intersects(*[F.col(c) for c in ("x0", "y0", "x1", "y1", "ax0", "ay0", "ax1", "ay1")]))
    rank = F.struct("quad_index", "span_id", "char_index")
    return chars.groupBy("sel_id", *PAGE_KEY, "x0", "y0", "x1", "y1").agg(
        F.min_by(F.struct("text", "span_id", "char_index", "quad_index"), rank).alias("c")
    ).select("sel_id", *PAGE_KEY, "x0", "y0", "x1", "y1", "c.*")


INDEX_BLOCK = 256


def flow_text(spans: DataFrame, sels: DataFrame, **how) -> DataFrame:
    """``select_by_flow`` on spans without a reading order: only pages with a selection are put in order."""
    sels = settle(sels)
    picked = spans.join(sels.select(*PAGE_KEY).distinct(), PAGE_KEY, "left_semi")
    return select_by_flow(reading_order(picked, "center", **how), sels)


def select_by_flow(ordered: DataFrame, sels: DataFrame) -> DataFrame:
    """Everything between two points in reading order.

    ``ordered`` has ``read_index`` with the centre anchor; ``sels`` has ``sel_id``, the page key and
    ``sx, sy, ex, ey``.  Only spans near the height of a point are compared with it; what lies wholly above or below
    comes from running minima over the heights of the page, and the text between from blocks of indexes.
    """
    swap = (F.col("ey") > F.col("sy")) | ((F.abs(F.col("ey") - F.col("sy")) < BAND) & (F.col("ex") < F.col("sx")))
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    ends = F.array(
        F.struct(F.lit(True).alias("first"), pick("sx", "ex").alias("px"), pick("sy", "ey").alias("py")),
        F.struct(F.lit(False).alias("first"), pick("ex", "sx").alias("px"), pick("ey", "sy").alias("py")))
    points = settle(sels.select("sel_id", *PAGE_KEY, F.explode(ends).alias("_p")).select("sel_id", *PAGE_KEY, "_p.*"))
    i, first, none = F.col("read_index"), F.col("first"), F.lit(None).cast("long")
    out = ["sel_id", *PAGE_KEY, "a", "b", "c"]  # smallest start, largest end, smallest index past the end

    ordered = settle(ordered)  # read three times
    spans = ordered.select(*PAGE_KEY, "read_index", "x0", "y0", "x1", "y1")
    near = spans.withColumn("_band", F.explode(bands(F.col("y0") - BAND, F.col("y1") + BAND)))
    beside = points.withColumn("_band", band_of(F.col("py"))).join(near, [*PAGE_KEY, "_band"]).filter(
        (F.col("py") >= F.col("y0") - BAND) & (F.col("py") <= F.col("y1") + BAND)
    ).groupBy("sel_id", *PAGE_KEY).agg(
        F.min(F.when(first & (F.col("px") <= F.col("x1")), i)).alias("a"),
        F.max(F.when(~first & (F.col("px") >= F.col("x0")), i)).alias("b"), F.min(none).alias("c"))

    # Few rows from all spans, used three times.
    heights = settle(spans.groupBy(*PAGE_KEY, "y0", "y1").agg(
        F.min(i).alias("lo"), F.max(i).alias("hi"), F.min(F.when(i > 0, i)).alias("past")))
    # Points come before heights of the same value: a height at the edge of the band is beside, not beyond.
    marks = points.select(*PAGE_KEY, "sel_id", "first", F.col("py").alias("v"), F.lit(0).alias("k"),
                          none.alias("lo"), none.alias("past"), none.alias("hi"))

    def beyond(edge, sign):
        rows = heights.select(*PAGE_KEY, F.lit(None).alias("sel_id"), F.lit(None).cast("boolean").alias("first"),
                              edge.alias("v"), F.lit(1).alias("k"), "lo", "past", "hi")
        both = marks.unionByName(rows).withColumn("v", F.col("v") * sign)
        return ordered_scan(
            both, PAGE_KEY, F.floor(F.col("v") / 64), [F.col("v"), F.col("k"), F.col("sel_id"), F.col("first")],
            mins={"_lo": F.col("lo"), "_past": F.col("past"), "_hi": -F.col("hi")}).filter(F.col("k") == 0)

    below = beyond(F.col("y1") + BAND, 1.0).select(
        "sel_id", *PAGE_KEY, F.when(first, F.col("_lo")).alias("a"), none.alias("b"), F.when(~first, F.col("_past")).alias("c"))
    above = beyond(F.col("y0") - BAND, -1.0).select(
        "sel_id", *PAGE_KEY, none.alias("a"), F.when(~first, -F.col("_hi")).alias("b"), none.alias("c"))

    last = heights.groupBy(*PAGE_KEY).agg(F.max("hi").alias("_n"))
    found = beside.select(*out).unionByName(below.select(*out)).unionByName(above.select(*out)).groupBy(
        "sel_id", *PAGE_KEY).agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("c").alias("c")).join(last, PAGE_KEY)
    a, b = F.coalesce("a", F.lit(0)), F.coalesce(F.col("b"), F.col("c") - 1, F.col("_n"))
    block = lambda v: F.floor(v / INDEX_BLOCK)
    ranged = found.select("sel_id", *PAGE_KEY, F.least(a, b).alias("_from"), F.greatest(a, b).alias("_to")).withColumn(
        "_block", F.explode(F.sequence(block(F.col("_from")), block(F.col("_to")))))
    return ordered.withColumn("_block", block(i)).join(ranged, [*PAGE_KEY, "_block"]).filter(
        i.between(F.col("_from"), F.col("_to"))).drop("_from", "_to", "_block")


def hit_areas(annotations: DataFrame) -> DataFrame:
    """Clickable boxes of annotations: text boxes (default 200x100), stroked overlays, quads."""
    kind, mode = F.col("type"), F.col("highlight_mode")
    pad = F.coalesce(F.nullif(F.col("stroke_width"), F.lit(0.0)), F.lit(15.0)) / 2 + 10.0
    xs = F.transform("path", lambda p: p["x"])
    ys = F.transform("path", lambda p: p["y"])
    overlay = (mode == "overlay") & (F.size("path") > 0)
    box = lambda a, b, c, d: F.struct(a.alias("ax0"), b.alias("ay0"), c.alias("ax1"), d.alias("ay1"))
    w = F.coalesce(F.nullif(F.col("width"), F.lit(0.0)), F.lit(200.0))
    h = F.coalesce(F.nullif(F.col("height"), F.lit(0.0)), F.lit(100.0))
    quad_boxes = F.transform(
        F.filter("quads", lambda q: F.size(q) >= 8),
        lambda q: box(F.least(q[0], q[2], q[4], q[6]), F.least(q[1], q[3], q[5], q[7]),
                      F.greatest(q[0], q[2], q[4], q[6]), F.greatest(q[1], q[3], q[5], q[7])))
    boxes = (
        F.when(kind == "text", F.array(box(F.col("x"), F.col("y"), F.col("x") + w, F.col("y") + h)))
        .when((kind == "highlight") & overlay, F.array(box(
            F.array_min(xs) - pad, F.array_min(ys) - pad, F.array_max(xs) + pad, F.array_max(ys) + pad)))
        .when(kind == "highlight", quad_boxes)
    )
    return annotations.select("ann_id", "ord", *PAGE_KEY, F.explode(boxes).alias("_a")).select(
        "ann_id", "ord", *PAGE_KEY, "_a.*")


def hit_test(points: DataFrame, areas: DataFrame) -> DataFrame:
    """First annotation in list order under each point (``point_id``, page key, ``px, py``)."""
    # Equal boxes are one candidate, so that copies of an annotation do not multiply.
    first = areas.groupBy(*PAGE_KEY, "ax0", "ay0", "ax1", "ay1").agg(
        F.min(F.struct("ord", "ann_id")).alias("_hit"))
    a = first.withColumn("_band", F.explode(bands(F.col("ay0"), F.col("ay1"))))
    p = points.withColumn("_band", band_of(F.col("py")))
    inside = F.col("px").between(F.col("ax0"), F.col("ax1")) & F.col("py").between(F.col("ay0"), F.col("ay1"))
    found = p.join(a, [*PAGE_KEY, "_band"]).filter(inside).groupBy("point_id", *PAGE_KEY).agg(
        F.min("_hit").alias("_hit"))
    return found.select("point_id", *PAGE_KEY, F.col("_hit.ann_id").alias("ann_id"))


def over_text(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Points that lie on text."""
    s = spans.select(*PAGE_KEY, "x0", "y0", "x1", "y1").withColumn("_band", F.explode(bands(F.col("y0"), F.col("y1"))))
    p = points.withColumn("_band", band_of(F.col("py")))
    inside = (
        F.col("px").between(F.col("x0"), F.col("x1")) & F.col("py").between(F.col("y0"), F.col("y1")))
    joined = p.alias("p").join(
        s.alias("s"),
        (F.col("p.doc_id") == F.col("s.doc_id")) & (F.col("p.page_number") == F.col("s.page_number"))
        & (F.col("p._band") == F.col("s._band")) & inside, "left_semi")
    return joined.drop("_band")
