"""Page operations: delete, insert, reorder, rotate, resize, lay out."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..plans.scan import ordered_scan
from ..plans.settle import settle

PAGE_KEY = ["doc_id", "page_number"]
PAGE_CHUNK = 1024
# Columns of the sheet grid by pages per sheet.
SHEET_COLUMNS = {1: 1, 2: 2, 4: 2, 6: 2, 9: 3, 16: 4}
# Annotation kinds that travel with an extracted page.
EXTRACTED_TYPES = ("text", "highlight", "callout", "image", "draw", "shape")

def page_scan(pages: DataFrame, **kw) -> DataFrame:
    """``ordered_scan`` through the pages of each document."""
    return ordered_scan(pages, ["doc_id"], F.floor(F.col("page_number") / PAGE_CHUNK), [F.col("page_number")], **kw)


def page_count(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("page_count"))


def without(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """All rows but those of the given keys."""
    return df.join(gone.select(*keys), keys, "left_anti")


# -- deletion ------------------------------------------------------------------------------------------------


def effective_deletions(pages: DataFrame, deletions: DataFrame) -> DataFrame:
    """Distinct deletions of existing pages, without documents that would lose every page."""
    wanted = deletions.select(*PAGE_KEY).distinct().withColumn("_hit", F.lit(1))
    marked = pages.select(*PAGE_KEY).join(wanted, PAGE_KEY, "left")
    refused = marked.groupBy("doc_id").agg(
        F.count("_hit").alias("_d"), F.count(F.lit(1)).alias("_n")).filter(F.col("_d") == F.col("_n"))
    return marked.filter(F.col("_hit").isNotNull()).select(*PAGE_KEY).join(
        refused.select("doc_id"), "doc_id", "left_anti")


def deletion_map(pages: DataFrame, deletions: DataFrame) -> DataFrame:
    """``page_number -> new_page_number`` for the pages that stay."""
    # The deletions are few and are read by both passes of the numbering.
    gone = settle(effective_deletions(pages, deletions))
    kept = pages.select(*PAGE_KEY).join(gone, PAGE_KEY, "left_anti")
    return page_scan(kept, rank="new_page_number").withColumn("new_page_number", F.col("new_page_number").cast("int"))


def renumber(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Move rows to the new page numbers; rows of pages outside the mapping drop out."""
    moved = df.join(mapping, PAGE_KEY)
    return moved.select(*[F.col("new_page_number").alias(c) if c == "page_number" else F.col(c) for c in df.columns])


def delete_pages(pages: DataFrame, annotations: DataFrame, deletions: DataFrame):
    """``(pages, annotations)`` after deletion and renumbering."""
    mapping = deletion_map(pages, deletions)
    return renumber(pages, mapping), renumber(annotations, mapping)


def adjust_current(current: DataFrame, deletions: DataFrame, counts: DataFrame) -> DataFrame:
    """Current page after a deletion: ``current`` has ``current_page``, ``counts`` the page count before."""
    gone = deletions.select(*PAGE_KEY).distinct()
    tally = gone.join(current, "doc_id").groupBy("doc_id").agg(
        F.max("page_number").alias("_max"), F.count(F.lit(1)).alias("_d"),
        F.count_if(F.col("page_number") < F.col("current_page")).alias("_before"))
    at, left = F.col("current_page"), F.col("page_count") - F.coalesce("_d", F.lit(0))
    new = (
        F.when(F.col("_d").isNull(), at)
        .when((at >= F.col("_max")) & (left > 0), F.greatest(F.lit(0), at - F.col("_before")))
        .when((left > 0) & (at >= left), left - 1)
        .otherwise(at)
    )
    return current.join(counts, "doc_id").join(tally, "doc_id", "left").select(
        "doc_id", new.cast("int").alias("current_page"))


# -- insertion -----------------------------------------------------------------------------------------------


def _request_key(df):
    """Order of a document's insertions: ``ord`` where given, then position and source."""
    zero = F.lit(0).cast("long")
    own = [F.col(c).cast("long") if c in df.columns else zero for c in ("ord", "at", "source_doc_id")]
    return F.struct(*[v.alias(n) for v, n in zip(own, ("ord", "at", "src"))])


def _insert_lists(inserts: DataFrame) -> DataFrame:
    """(doc_id, _ops): a document's insertions in their order; as many as it has requests."""
    return inserts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(
        _request_key(inserts).alias("key"), F.col("at").cast("int").alias("at"), F.col("count").cast("int").alias("n")))).alias("_ops"))


def _shifted(page, ops):
    """Page number after a list of insertions, each of which sees the pages as the one before has left them."""
    return F.aggregate(ops, page.cast("int"), lambda p, o: (p + F.when(p >= o["at"], o["n"]).otherwise(0)).cast("int"))


def shift_for_insert(df: DataFrame, inserts: DataFrame) -> DataFrame:
    """Move rows at or after ``at`` up by ``count`` pages, for each insertion of the document in turn."""
    joined = df.join(_insert_lists(inserts), "doc_id", "left")
    moved = F.when(F.col("_ops").isNull(), F.col("page_number")).otherwise(_shifted(F.col("page_number"), F.col("_ops"))).cast("int")
    return joined.select(*[moved.alias(c) if c == "page_number" else F.col(c) for c in df.columns])


def _picked_pages(requests: DataFrame, source: DataFrame) -> DataFrame:
    """Source pages per request with their position ``idx``: the listed ones in list order, or all; ``_key`` orders a
    document's requests, and requests of one key are one."""
    counts = page_count(source).select(F.col("doc_id").alias("source_doc_id"), F.col("page_count").alias("_m"))
    r = requests.withColumn("_key", _request_key(requests)).dropDuplicates(["doc_id", "_key"]).join(counts, "source_doc_id")
    valid = F.filter("source_pages", lambda p: (p >= 0) & (p < F.col("_m")))
    listed = r.filter(F.size("source_pages") > 0).select(
        "doc_id", "_key", "at", "source_doc_id", F.posexplode(valid).alias("idx", "_p"))
    src = source.withColumnsRenamed({"doc_id": "source_doc_id", "page_number": "_p"})
    some = listed.join(src, ["source_doc_id", "_p"])
    every = r.filter(F.coalesce(F.size("source_pages"), F.lit(0)) <= 0).select("doc_id", "_key", "at", "source_doc_id").join(
        src, "source_doc_id").withColumn("idx", F.col("_p"))
    return some.unionByName(every)


def _placed(picked: DataFrame):
    """The insertions of each document, and the picked pages with their final page number."""
    picked = settle(picked)  # read three times
    counts = picked.groupBy("doc_id", "_key", "at").agg(F.count(F.lit(1)).alias("count")).select(
        "doc_id", F.col("_key.ord").alias("ord"), "at", F.col("_key.src").alias("source_doc_id"), "count")
    later = F.filter("_ops", lambda o: o["key"] > F.col("_key"))
    placed = picked.join(_insert_lists(counts), "doc_id").withColumn("page_number", _shifted(F.col("at") + F.col("idx"), later))
    return counts, placed


def insert_pages(target: DataFrame, source: DataFrame, requests: DataFrame) -> DataFrame:
    """Insert pages of other documents; ``requests`` has ``doc_id, at, source_doc_id, source_pages`` and, to order
    several requests of a document, ``ord``: each one's position counts in the pages that those before it have left."""
    counts, placed = _placed(_picked_pages(requests, source))
    return shift_for_insert(target, counts).unionByName(placed.select(*target.columns))


def paste_annotations(annotations: DataFrame, source_annotations: DataFrame, source_pages: DataFrame,
                      requests: DataFrame, stamp: str) -> DataFrame:
    """Annotations after ``insert_pages``: existing ones shifted, those of the copied pages added under new ids."""
    counts, placed = _placed(_picked_pages(requests, source_pages.select(*PAGE_KEY)))
    src = source_annotations.withColumnsRenamed({"doc_id": "source_doc_id", "page_number": "_p"})
    copies = placed.join(src, ["source_doc_id", "_p"]).withColumn(
        "ann_id", F.concat(F.col("ann_id").cast("string"), F.lit(f"_copy_{stamp}_"), F.col("idx").cast("string")))
    kept = shift_for_insert(annotations, counts).withColumn("ann_id", F.col("ann_id").cast("string"))
    return kept.unionByName(copies.select(*annotations.columns))


def insert_blank(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """Insert an empty page at ``at``, sized like the page before it (the first page for ``at = 0``).

    Requests outside the document do nothing.
    """
    valid = requests.join(page_count(pages), "doc_id").filter(
        (F.col("at") >= 0) & (F.col("at") <= F.col("page_count"))).select("doc_id", "at")
    template = valid.withColumn("page_number", F.greatest(F.col("at") - 1, F.lit(0)).cast("int"))
    fresh = template.join(pages, PAGE_KEY).withColumn("page_number", F.col("at").cast("int")).select(*pages.columns)
    return shift_for_insert(pages, valid.withColumn("count", F.lit(1))).unionByName(fresh)


# -- order ---------------------------------------------------------------------------------------------------


def moved_position(position: Column, ops: Column, count: Column) -> Column:
    """Where a page ends up after moves ``{from_index, to_index}`` applied one after another."""

    def step(pos, op):
        source, target = op["from_index"], F.least(F.greatest(op["to_index"], F.lit(0)), count - 1)
        closed = F.when(pos > source, pos - 1).otherwise(pos)
        opened = F.when(closed >= target, closed + 1).otherwise(closed)
        real = (source >= 0) & (source < count)
        return F.when(~real, pos).when(pos == source, target).otherwise(opened).cast("int")

    return F.aggregate(ops, position.cast("int"), step)


def reorder_map(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """``page_number -> new_page_number``; ``requests`` has one row per document with ``ops`` in order.

    Every page follows the moves on its own, so a long document stays spread over tasks.
    """
    with_ops = pages.select(*PAGE_KEY).join(requests.select("doc_id", "ops"), "doc_id", "left").join(
        page_count(pages), "doc_id")
    new = F.when(F.col("ops").isNull(), F.col("page_number")).otherwise(moved_position(F.col("page_number"), F.col("ops"), F.col("page_count")))
    return with_ops.select(*PAGE_KEY, new.cast("int").alias("new_page_number"))


def reorder_pages(pages: DataFrame, requests: DataFrame) -> DataFrame:
    return renumber(pages, reorder_map(pages, requests))


def drag_to_ops(dragged: Column, target: Column) -> Column:
    """Moves for dropping pages on ``target``; a target below the dragged pages moves up by their number."""
    at = F.when(target > F.array_max(dragged), target - F.size(dragged)).otherwise(target)
    return F.transform(
        F.array_sort(dragged),
        lambda p, i: F.struct(p.cast("int").alias("from_index"), (at + i).cast("int").alias("to_index")))


# -- geometry ------------------------------------------------------------------------------------------------


def rotate_pages(pages: DataFrame, turns: DataFrame) -> DataFrame:
    """Turn pages by ``degrees``; a quarter turn swaps the displayed size."""
    joined = pages.join(turns.select(*PAGE_KEY, F.col("degrees").alias("_deg")), PAGE_KEY, "left")
    new = F.when(F.col("_deg").isNull(), F.col("rotation")).otherwise(g.add_rotation(F.col("rotation"), F.col("_deg")))
    swap = F.pmod(new - F.col("rotation"), F.lit(180)) == 90
    return joined.select(
        *PAGE_KEY, F.when(swap, F.col("height")).otherwise(F.col("width")).alias("width"),
        F.when(swap, F.col("width")).otherwise(F.col("height")).alias("height"), new.cast("int").alias("rotation"))


def rotate_annotations(annotations: DataFrame, pages: DataFrame, new_rotations: DataFrame, mode="reference") -> DataFrame:
    """Turn rectangles, quads and callout points with their page.

    ``pages`` holds the pages before the turn and ``new_rotations`` their ``new_rotation``; other pages keep their
    annotations.  See ``turn_rect`` for ``mode``.
    """
    size = g.mediabox(F.col("width"), F.col("height"), F.col("rotation"))
    turned = new_rotations.join(pages, PAGE_KEY).select(
        *PAGE_KEY, size["width"].alias("_w"), size["height"].alias("_h"),
        F.pmod(F.col("new_rotation") - F.col("rotation"), F.lit(360)).alias("_rel"))
    a = annotations.join(turned, PAGE_KEY, "left").withColumn("_rel", F.coalesce("_rel", F.lit(0)))
    rel, w, h = F.col("_rel"), F.col("_w"), F.col("_h")
    r = g.turn_rect(*[F.col(c) for c in ("x", "y", "width", "height")], rel, w, h, mode)
    fresh = {c: r[c] for c in ("x", "y", "width", "height")}
    if "quads" in annotations.columns:
        fresh["quads"] = g.turn_quads(F.col("quads"), rel, w, h)
    for c in ("arrow_point", "box_position"):
        if c in annotations.columns:
            fresh[c] = F.when(F.col(c).isNotNull(), g.turn_point(F.col(f"{c}.x"), F.col(f"{c}.y"), rel, w, h))
    return a.select(*[fresh.get(c, F.col(c)).alias(c) for c in annotations.columns])


def resize_pages(pages: DataFrame, spec: DataFrame) -> DataFrame:
    """Give pages a new size; a spec without page number applies to the whole document.  Annotations stay."""
    one = spec.filter(F.col("page_number").isNotNull()).select(*PAGE_KEY, F.col("width").alias("_w1"), F.col("height").alias("_h1"))
    every = spec.filter(F.col("page_number").isNull()).select("doc_id", F.col("width").alias("_w2"), F.col("height").alias("_h2"))
    joined = pages.join(one, PAGE_KEY, "left").join(every, "doc_id", "left")
    fresh = {"width": F.coalesce("_w1", "_w2", "width"), "height": F.coalesce("_h1", "_h2", "height")}
    return joined.select(*[fresh.get(c, F.col(c)).alias(c) for c in pages.columns])


# -- layout --------------------------------------------------------------------------------------------------


def page_offsets(pages: DataFrame, scale=1.0, gap=24.0) -> DataFrame:
    """Top and bottom of every page in a continuous column of pages."""
    tall = F.col("height") * F.lit(float(scale))
    scanned = page_scan(pages.select(*PAGE_KEY, "height"), sums={"top": tall + F.lit(float(gap))})
    top = F.col("top").cast("double")
    return scanned.select(*PAGE_KEY, top.alias("top"), (top + tall).alias("bottom"))


def layout_height(pages: DataFrame, scale=1.0, gap=24.0) -> DataFrame:
    return pages.groupBy("doc_id").agg(
        (F.sum(F.col("height") * F.lit(float(scale))) + (F.count(F.lit(1)) - 1) * F.lit(float(gap))).alias("height"))


def visible_pages(offsets: DataFrame, views: DataFrame, gap=24.0, buffer=2, band=4096.0) -> DataFrame:
    """First and last page to draw for a scroll interval (``view_id, doc_id, view_top, view_bottom``).

    With the gap before it, every page owns a stretch of the column, so each end of a view falls to one page and is
    found by band instead of comparing views with all pages.
    """
    cell = lambda v: F.floor(v / F.lit(band)).cast("long")
    counts = page_count(offsets)
    lead = offsets.withColumn("_from", F.col("top") - F.lit(gap)).withColumn(
        "_b", F.explode(F.sequence(cell(F.col("_from")), cell(F.col("bottom")))))
    tail = offsets.withColumn("_to", F.col("bottom") + F.lit(gap)).withColumn(
        "_b", F.explode(F.sequence(cell(F.col("top")), cell(F.col("_to")))))
    first = views.withColumn("_b", cell(F.col("view_top"))).join(lead, ["doc_id", "_b"]).filter(
        (F.col("_from") < F.col("view_top")) & (F.col("view_top") <= F.col("bottom"))).select(
        "view_id", F.col("page_number").alias("_first"))
    last = views.withColumn("_b", cell(F.col("view_bottom"))).join(tail, ["doc_id", "_b"]).filter(
        (F.col("top") <= F.col("view_bottom")) & (F.col("view_bottom") < F.col("_to"))).select(
        "view_id", F.col("page_number").alias("_last"))
    n = F.col("page_count")
    return views.join(counts, "doc_id").join(first, "view_id", "left").join(last, "view_id", "left").select(
        "view_id", "doc_id",
        F.greatest(F.lit(0), F.coalesce(F.col("_first") - buffer, F.lit(0))).cast("int").alias("first"),
        F.least(n - 1, F.coalesce(F.col("_last") + buffer, n - 1)).cast("int").alias("last"))


def expand_page_range(df: DataFrame, range_col="custom_range", total_col="page_count", block=65536) -> DataFrame:
    """0-based pages of texts like ``1-5, 8, 11-13``: bad tokens ignored, open ends filled, no repeats."""
    total = F.col(total_col)
    number = lambda s: F.regexp_extract(s, r"^\s*\+?(\d+)", 1).try_cast("long")
    or_else = lambda v, d: F.coalesce(F.nullif(v, F.lit(0).cast("long")), d.cast("long"))

    def bounds(token):
        ends = F.split(token, "-")
        first = F.greatest(F.lit(1).cast("long"), or_else(number(F.get(ends, F.lit(0))), F.lit(1)))
        last = F.least(total.cast("long"), or_else(number(F.get(ends, F.lit(1))), total))
        single = number(token)
        in_doc = (single >= 1) & (single <= total)
        return F.when(F.contains(token, F.lit("-")), F.struct(first.alias("a"), last.alias("b"))).when(
            in_doc, F.struct(single.alias("a"), single.alias("b")))

    parts = df.select("doc_id", F.explode(F.transform(F.split(range_col, ","), bounds)).alias("_r")).filter(
        F.col("_r.a") <= F.col("_r.b"))
    # Long ranges are cut into blocks, so that no row holds the whole sequence.
    cell = lambda v: F.floor((v - 1) / block)
    blocks = parts.select("doc_id", "_r", F.explode(F.sequence(cell(F.col("_r.a")), cell(F.col("_r.b")))).alias("_k"))
    lo = F.greatest(F.col("_r.a") - 1, F.col("_k") * block)
    hi = F.least(F.col("_r.b") - 1, F.col("_k") * block + block - 1)
    pages = blocks.select("doc_id", F.explode(F.sequence(lo, hi)).alias("_p"))
    return pages.select("doc_id", F.col("_p").cast("int").alias("page_number")).distinct()


def sheets_needed(printed: DataFrame, settings: DataFrame) -> DataFrame:
    """Pages and sheets per document (``settings.pages_per_sheet``)."""
    counts = printed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    return counts.join(settings.select("doc_id", "pages_per_sheet"), "doc_id").select(
        "doc_id", "pages", F.ceil(F.col("pages") / F.col("pages_per_sheet")).cast("long").alias("sheets"))


def nup_layout(printed: DataFrame, settings: DataFrame) -> DataFrame:
    """Sheet, slot, row and column of every printed page, always row by row; blank slots fill the last sheet."""
    per = F.col("pages_per_sheet")
    grid = F.create_map(*[F.lit(v) for kv in SHEET_COLUMNS.items() for v in kv])
    cols = F.coalesce(F.try_element_at(grid, per), F.lit(1))
    s = settings.select("doc_id", "pages_per_sheet")
    placed = page_scan(printed.select(*PAGE_KEY).distinct(), rank="_i").join(s, "doc_id")
    totals = printed.select(*PAGE_KEY).distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).join(s, "doc_id")
    blanks = totals.filter(F.col("_n") % per != 0).select(
        "doc_id", F.lit(None).cast("int").alias("page_number"),
        F.explode(F.sequence(F.col("_n"), F.ceil(F.col("_n") / per) * per - 1)).alias("_i"), "pages_per_sheet")
    slot = (F.col("_i") % per).cast("int")
    return placed.unionByName(blanks).select(
        *PAGE_KEY, F.floor(F.col("_i") / per).cast("int").alias("sheet"), slot.alias("slot"),
        F.floor(slot / cols).cast("int").alias("row"), (slot % cols).cast("int").alias("col"))


# -- copies and references -----------------------------------------------------------------------------------


def copy_pages(annotations: DataFrame, picked: DataFrame, per_part=1024) -> DataFrame:
    """Picked pages with their annotations nested, in parts of ``per_part`` list positions.

    A page without annotations keeps one row with an empty list.
    """
    fields = [c for c in annotations.columns if c not in PAGE_KEY]
    nested = annotations.join(picked.select(*PAGE_KEY), PAGE_KEY, "left_semi").groupBy(
        *PAGE_KEY, F.floor(F.col("ord") / per_part).alias("part")
    ).agg(F.array_sort(F.collect_list(F.struct("ord", *[f for f in fields if f != "ord"]))).alias("annotations"))
    return picked.select(*PAGE_KEY).distinct().join(nested, PAGE_KEY, "left")


def extract_pages(pages: DataFrame, annotations: DataFrame, keys: DataFrame):
    """``(pages, annotations)`` of an extract; form fields, stamps and redactions stay behind."""
    k = keys.select(*PAGE_KEY)
    return pages.join(k, PAGE_KEY, "left_semi"), annotations.filter(F.col("type").isin(*EXTRACTED_TYPES)).join(
        k, PAGE_KEY, "left_semi")


def valid_page_refs(df: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows whose page exists."""
    return df.join(docs.select("doc_id", F.col("page_count").alias("_n")), "doc_id").filter(
        (F.col("page_number") >= 0) & (F.col("page_number") < F.col("_n"))).select(*df.columns)


def orphans(child: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows whose document is gone."""
    return child.join(docs.select("doc_id"), "doc_id", "left_anti")


def toggle_selection(clicks: DataFrame) -> DataFrame:
    """Selected pages: those toggled an odd number of times."""
    return clicks.groupBy(*PAGE_KEY).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") % 2 == 1).select(*PAGE_KEY)
