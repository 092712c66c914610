"""Region redaction: remove characters under rectangles and report what was done."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import clamp_rect
from ..plans.deal import deal, noted
from ..plans.settle import settle
from .selection import PAGE_KEY, band_join

SPAN_KEY = [*PAGE_KEY, "span_id"]


def redaction_areas(annotations: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct redaction rectangles, cut to their page; rows on missing pages drop out."""
    a = annotations.filter(F.col("type") == "redact").join(pages.select(*PAGE_KEY, "width", "height").withColumnsRenamed(
        {"width": "_pw", "height": "_ph"}), PAGE_KEY)
    cut = clamp_rect(F.col("x"), F.col("y"), F.col("width"), F.col("height"), F.col("_pw"), F.col("_ph"))
    return a.select(*PAGE_KEY, cut.alias("_r")).select(
        *PAGE_KEY, *[F.col(f"_r.{c}").alias(f"a{c}") for c in ("x0", "y0", "x1", "y1")]).distinct()


def removed_ranges(spans: DataFrame, areas: DataFrame) -> DataFrame:
    """Per touched span the set of removed character ranges ``{a, b}``.

    The characters of a span have equal widths, so a rectangle removes one run of them; characters never become
    rows.  Equal runs merge before the shuffle.
    """
    hit = band_join(spans, areas)
    n, w = F.length("text"), (F.col("x1") - F.col("x0")) / F.length("text")
    left = lambda i: F.col("x0") + i * w
    right = lambda i: F.when(n == 1, F.col("x1")).otherwise(F.col("x0") + (i + 1) * w)
    # Rounding may put the computed edge one character off; the exact test decides among the neighbours.
    near = lambda v: F.floor((v - F.col("x0")) / w).cast("int")
    around = lambda v: F.filter(
        F.sequence(near(v) - 2, near(v) + 2), lambda i: (i >= 0) & (i < n))
    first = F.when(F.col("ax0") <= F.col("x0"), 0).otherwise(
        F.array_min(F.filter(around(F.col("ax0")), lambda i: right(i) >= F.col("ax0"))))
    last = F.when(F.col("ax1") >= F.col("x1"), n - 1).otherwise(
        F.array_max(F.filter(around(F.col("ax1")), lambda i: left(i) <= F.col("ax1"))))
    # No filter on the computed range before the aggregation: it would move into the join condition and be
    # computed for every candidate pair.
    ranged = hit.filter(n > 0).select(*SPAN_KEY, F.struct(first.cast("int").alias("a"), last.cast("int").alias("b")).alias("_r"))
    sets = ranged.groupBy(*SPAN_KEY).agg(F.collect_set("_r").alias("removed"))
    return sets.withColumn("removed", F.filter("removed", lambda r: r["a"] <= r["b"])).filter(F.size("removed") > 0)


def remove_characters(spans: DataFrame, ranges: DataFrame) -> DataFrame:
    """Spans without the removed characters; a cut span continues as one row per remaining run."""
    return _without(spans.join(ranges, SPAN_KEY, "left"), spans.columns)


def _without(joined, columns):
    """The same for spans that have their ``removed`` ranges, or null."""
    n = F.length("text")
    run = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    none = F.array().cast("array<struct<a:int,b:int>>")
    # The removed ranges in order leave gaps: one pass over the ranges, none over the characters.
    left = F.aggregate(
        F.array_sort("removed"), F.struct(F.lit(0).alias("next"), none.alias("runs")),
        lambda acc, r: F.struct(
            F.greatest(acc["next"], r["b"] + 1).alias("next"),
            F.when(r["a"] > acc["next"], F.concat(acc["runs"], F.array(run(acc["next"], r["a"] - 1)))).otherwise(
                acc["runs"]).alias("runs")),
        lambda acc: F.concat(acc["runs"], F.when(acc["next"] < n, F.array(run(acc["next"], n - 1))).otherwise(none)))
    runs = F.when(F.col("removed").isNull(), F.array(run(F.lit(0), n - 1))).otherwise(left)
    w = (F.col("x1") - F.col("x0")) / n
    # In a column of its own, as a function on arrays would keep the explosion from generated code, and of the outer form, for which
    # Spark adds no filter that works the runs out a second time.
    out = joined.withColumn("_runs", runs).select(
        *columns, "removed", F.posexplode_outer("_runs").alias("run_index", "_run")).filter(F.col("_run").isNotNull())
    whole = F.col("removed").isNull()
    a, b = F.col("_run.a"), F.col("_run.b")
    fresh = {
        "text": F.when(whole, F.col("text")).otherwise(F.substring("text", a + 1, b - a + 1)),
        "x0": F.when(whole | (a == 0), F.col("x0")).otherwise(F.col("x0") + a * w),
        "x1": F.when(whole | (b == n - 1), F.col("x1")).otherwise(F.col("x0") + (b + 1) * w),
    }
    return out.select(*[fresh.get(c, F.col(c)).alias(c) for c in columns], "run_index")


def apply_redactions(spans: DataFrame, annotations: DataFrame, pages: DataFrame):
    """``(spans, annotations, report)`` after burning in every redaction.

    Redaction rows are consumed where their page exists; everything else stays.
    """
    # Written once for the three outputs; their known sizes also let the joins with all spans be broadcast where small.
    areas = settle(redaction_areas(annotations, pages))
    ranges = settle(removed_ranges(spans, areas))
    left = remove_characters(spans, ranges)
    is_redact = F.col("type") == "redact"
    kept = annotations.filter(~is_redact).unionByName(
        annotations.filter(is_redact).join(pages.select(*PAGE_KEY), PAGE_KEY, "left_anti").select(annotations.columns))
    return left, kept, redaction_report(areas, ranges)


def removed_count(removed):
    """Number of distinct characters in a set of ranges."""
    seq = F.flatten(F.transform(removed, lambda r: F.sequence(r["a"], r["b"])))
    return F.size(F.array_distinct(seq))


def redaction_report(areas: DataFrame, ranges: DataFrame) -> DataFrame:
    """Per page: rectangles applied, spans touched and characters removed."""
    applied = areas.groupBy(*PAGE_KEY).agg(F.count(F.lit(1)).alias("areas"))
    removed = ranges.groupBy(*PAGE_KEY).agg(
        F.count(F.lit(1)).alias("spans_touched"), F.sum(removed_count(F.col("removed"))).alias("characters_removed"))
    zero = F.lit(0).cast("long")
    return applied.join(removed, PAGE_KEY, "left").select(
        *PAGE_KEY, "areas", F.coalesce("spans_touched", zero).alias("spans_touched"),
        F.coalesce("characters_removed", zero).alias("characters_removed"))


def search_and_redact(spans: DataFrame, hits: DataFrame, dealt_by: list[str] | None = None):
    """Remove the text under search hits (rows of ``hit_quads``, which name span and character range).

    ``dealt_by`` states by which of their keys the spans are dealt (``plans.deal``): the ranges are then dealt to them, and no span
    is shuffled.
    """
    hits = hits.select(*SPAN_KEY, "a", "b")
    if dealt_by:
        hits = deal(hits, dealt_by)
    ranges = hits.groupBy(*SPAN_KEY).agg(F.collect_set(F.struct("a", "b")).alias("removed"))
    if not dealt_by:
        return remove_characters(spans, ranges), ranges
    joined = noted(spans, ranges, SPAN_KEY, "_range", lambda note: F.first(note, ignorenulls=True))
    return _without(joined.withColumn("removed", F.col("_range.removed")), spans.columns), ranges
