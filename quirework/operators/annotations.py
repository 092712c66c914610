"""Annotation stores: filters, edits, synchronisation, matching, de-duplication."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.near import around, cell, first_near, keep_first
from ..plans.settle import settle

PAGE_KEY = ["doc_id", "page_number"]
LIST_PART = 1024
# Kinds that the incremental write knows.
SYNC_NEW_TYPES = ("text", "highlight", "callout", "redact", "image")
MANAGED_KINDS = ("Ink", "Highlight", "Line", "Square", "Circle", "Widget")


def annotations_for(annotations, doc_id=None, page_number=None, types=None) -> DataFrame:
    """Rows of a document, page or kind; plain comparisons, so that they reach the scan."""
    for name, value in (("doc_id", doc_id), ("page_number", page_number)):
        if value is not None:
            annotations = annotations.filter(F.col(name) == value)
    return annotations.filter(F.col("type").isin(*types)) if types else annotations


def annotations_by_page(annotations: DataFrame, per_part=LIST_PART) -> DataFrame:
    """Annotations nested per page in list order, in parts of ``per_part`` list positions."""
    fields = [c for c in annotations.columns if c not in [*PAGE_KEY, "ord"]]
    return annotations.groupBy(*PAGE_KEY, F.floor(F.col("ord") / per_part).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("ord", *fields))).alias("annotations"))


def image_stamps(stamps: DataFrame, per_part=LIST_PART) -> DataFrame:
    """Image stamps with data to place, per document, in parts of ``per_part`` list positions."""
    wanted = stamps.filter((F.col("stamp.type") == "image") & (F.coalesce("stamp.imageData", F.lit("")) != ""))
    place = F.struct(
        "ord", "ann_id", "page_number", "x", "y",
        F.coalesce(F.nullif("width", F.lit(0.0)), F.lit(100.0)).alias("width"),
        F.coalesce(F.nullif("height", F.lit(0.0)), F.lit(100.0)).alias("height"))
    return wanted.groupBy("doc_id", F.floor(F.col("ord") / per_part).alias("part")).agg(
        F.array_sort(F.collect_list(place)).alias("placements"))


def page_annotation_stats(annotations: DataFrame) -> DataFrame:
    """Per document: pages with annotations, widgets, stamps and redactions left."""
    per_page = annotations.groupBy(*PAGE_KEY).agg(*[
        F.count_if(F.col("type") == t).alias(t) for t in ("formField", "stamp", "redact")])
    return per_page.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages_with_annotations"), F.sum("formField").alias("widgets"),
        F.sum("stamp").alias("stamps"), F.sum("redact").alias("redactions_left"))


def merge_updates(base: DataFrame, patch: DataFrame, keys: list[str], set_keys="set_keys") -> DataFrame:
    """``{...base, ...patch}``: only given values overwrite; fields listed in ``set_keys`` overwrite even with null.

    Of several patches for a key one stays, so that no row of ``base`` is doubled: the last in the order of ``patch_no`` if the patch
    has that column, else the largest.
    """
    fields = [c for c in patch.columns if c not in [*keys, set_keys, "patch_no"]]
    values = [*[F.col(c).alias(f"_p_{c}") for c in fields],
              (F.col(set_keys) if set_keys in patch.columns else F.array().cast("array<string>")).alias("_set")]
    first = [F.col("patch_no")] if "patch_no" in patch.columns else []
    last = patch.groupBy(*keys).agg(F.max(F.struct(*first, *values)).alias("_p"))
    renamed = last.select(*keys, *[F.col(f"_p._p_{c}").alias(f"_p_{c}") for c in fields], F.col("_p._set").alias("_set"))
    j = base.join(renamed, keys, "left")
    forced = lambda c: F.coalesce(F.array_contains("_set", c), F.lit(False))
    return j.select(*[
        (F.when(forced(c), F.col(f"_p_{c}")).otherwise(F.coalesce(f"_p_{c}", c)) if c in fields else F.col(c)).alias(c)
        for c in base.columns])


def folded_changes(changes: DataFrame, fields: list[str], keys=("doc_id", "ann_id"), order=("ts", "event_id")) -> DataFrame:
    """Net effect of add / update / remove changes per annotation.

    One aggregation with partial results: the last add or remove, and per field the last value given.  A value
    counts only if it is not older than that add or remove.  ``base_op`` is ``add``, ``remove`` or null (updates of
    an annotation that was there before).
    """
    at = F.struct(*order)
    reset = F.col("op").isin("add", "remove")
    edit = F.col("op").isin("add", "update")
    aggs = [F.max(F.when(reset, F.struct(at.alias("at"), F.col("op").alias("op")))).alias("_reset")]
    for f in fields:
        aggs.append(F.max(F.when(edit & F.col(f).isNotNull(), F.struct(at.alias("at"), F.col(f).alias("v")))).alias(f"_f_{f}"))
    folded = changes.filter(reset | edit).groupBy(*keys).agg(*aggs)
    live = lambda f: F.when(
        F.col("_reset").isNull() | (F.col(f"_f_{f}.at") >= F.col("_reset.at")), F.col(f"_f_{f}.v"))
    return folded.select(*keys, F.col("_reset.op").alias("base_op"), *[live(f).alias(f) for f in fields])


def apply_changes(annotations: DataFrame, changes: DataFrame, fields: list[str], keys=("doc_id", "ann_id"),
                  order=("ts", "event_id")) -> DataFrame:
    """Annotation table after a batch of changes; an update of a missing annotation does nothing."""
    keys = list(keys)
    net = folded_changes(changes, fields, keys, order).select(
        *keys, F.col("base_op").alias("_op"), F.lit(True).alias("_net"), *[F.col(f).alias(f"_n_{f}") for f in fields])
    old = annotations.withColumn("_old", F.lit(True))
    j = old.join(net, keys, "full_outer")
    added = F.col("_op") == "add"
    there = F.coalesce(added, F.col("_op").isNull() & F.col("_old"))
    value = lambda f: F.when(added, F.col(f"_n_{f}")).otherwise(F.coalesce(f"_n_{f}", f))
    return j.filter(F.coalesce(there, F.lit(False))).select(
        *[(value(c) if c in fields else F.col(c)).alias(c) for c in annotations.columns])


# -- synchronisation with stored rows ------------------------------------------------------------------------


def stored_kind(kind, shape=None, mode=None) -> Column:
    """Subtype under which an annotation is stored."""
    out = (
        F.when(kind.isin("text", "image", "callout"), "FreeText").when(kind == "redact", "Redact")
        .when(kind == "stamp", "Stamp").when(kind == "formField", "Widget").when(kind == "draw", "Ink"))
    out = out.when((kind == "highlight") & (mode == "overlay"), "Ink") if mode is not None else out
    out = out.when(kind == "highlight", "Highlight")
    if shape is not None:
        out = out.when(shape == "arrow", "Line").when(shape == "rectangle", "Square").when(shape == "circle", "Circle")
    return out


def is_managed(subtype, custom, stamped, stamp_contents) -> Column:
    """Stored rows that a full save owns: the drawn kinds, widgets, own text boxes and stamps."""
    no = F.lit(False)
    custom, stamped = F.coalesce(custom, no), F.coalesce(stamped, no)
    return (
        subtype.isin(*MANAGED_KINDS) | ((subtype == "FreeText") & custom)
        | (subtype.isin("FreeText", "Stamp") & stamped) | ((subtype == "Stamp") & F.coalesce(stamp_contents, no)))


def sync_annotations(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Full save: managed rows are replaced by the current set, foreign ones survive."""
    managed = is_managed(F.col("subtype"), F.col("custom"), F.col("stamped"), F.col("stamp_contents"))
    return stored.filter(~managed).select(current.columns).unionByName(current)


def sync_new(annotations: DataFrame) -> DataFrame:
    """Rows that an incremental write adds."""
    return annotations.filter(~F.coalesce(F.col("already_synced"), F.lit(False)) & F.col("type").isin(*SYNC_NEW_TYPES))


def sync_pages(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Per page, replace only the kinds that occur in the current set; highlights and drawings go together."""
    kind = F.col("type")
    replaced = (
        F.when(kind == "text", F.array(F.lit("FreeText"))).when(kind == "formField", F.array(F.lit("Widget")))
        .when(kind.isin("highlight", "draw"), F.array(F.lit("Ink"), F.lit("Highlight")))
        .when(kind == "shape", F.array(F.when(F.col("shape_type") == "arrow", "Line").when(
            F.col("shape_type") == "rectangle", "Square").otherwise("Circle")))
    )
    touched = current.select(*PAGE_KEY, F.explode(replaced).alias("subtype")).distinct()
    foreign_text = (F.col("subtype") == "FreeText") & ~F.coalesce(F.col("custom"), F.lit(False))
    # A foreign text box has no kind to be replaced by.
    marked = stored.withColumn("_kind", F.when(~foreign_text, F.col("subtype")))
    kept = marked.join(touched.withColumnRenamed("subtype", "_kind"), [*PAGE_KEY, "_kind"], "left_anti")
    return kept.select(current.columns).unionByName(current)


def flatten(annotations: DataFrame, pages: DataFrame | None = None):
    """``(annotations left, report)`` after flattening all pages or the given ones."""
    if pages is None:
        gone, left = annotations, annotations.limit(0)
    else:
        key = pages.select(*PAGE_KEY)
        gone, left = annotations.join(key, PAGE_KEY, "left_semi"), annotations.join(key, PAGE_KEY, "left_anti")
    return left, gone.groupBy("doc_id").agg(F.count(F.lit(1)).alias("flattened"))


def copy_annotations(annotations: DataFrame, ids: DataFrame, stamp: str) -> DataFrame:
    """Copies of the picked annotations under new ids."""
    return annotations.join(ids.select("doc_id", "ann_id"), ["doc_id", "ann_id"], "left_semi").withColumn(
        "ann_id", F.concat(F.col("ann_id").cast("string"), F.lit(f"_copy_{stamp}"))).select(annotations.columns)


# -- matching ------------------------------------------------------------------------------------------------


def match_annotations(targets: DataFrame, stored: DataFrame) -> DataFrame:
    """First stored row (by ``ord``) that each target stands for: ``target_id, ann_id``.

    Any stored row that is neither ink nor a text highlight matches within 10 pt, which includes the tighter rules
    for text boxes and stamps.  Besides: stamps by stamp id; highlights with as many quads, all within 0.1;
    drawings and overlays against ink by both path ends within 5, or by position or by size within 50.
    Columns: page key, ``type, highlight_mode, x, y, width, height, stamp_id, quads, path`` on both sides,
    ``subtype`` and ``ord`` on the stored side.
    """
    t = targets
    s = stored.withColumn("hit", F.struct("ord", "ann_id"))
    ink_like = (F.col("type") == "draw") | ((F.col("type") == "highlight") & (F.col("highlight_mode") == "overlay"))
    drawn, ink = t.filter(ink_like), s.filter(F.col("subtype") == "Ink")

    found = [first_near(t, s.filter(~F.col("subtype").isin("Ink", "Highlight")), PAGE_KEY, ["x", "y"], 10.0)]

    own = s.filter(F.col("subtype").isin("FreeText", "Stamp") & F.col("stamp_id").isNotNull())
    by_id = own.groupBy(*PAGE_KEY, "stamp_id").agg(F.min("hit").alias("hit"))
    found.append(t.filter(F.col("type") == "stamp").join(by_id, [*PAGE_KEY, "stamp_id"]).select("target_id", "hit"))

    corner = lambda df: df.withColumn("_qx", F.get(F.get("quads", 0), 0)).withColumn("_qy", F.get(F.get("quads", 0), 1))
    found.append(_same_quads(
        corner(t.filter((F.col("type") == "highlight") & (F.size("quads") > 0))),
        corner(s.filter(F.col("subtype") == "Highlight"))))

    ends = lambda df: df.filter(F.size("path") >= 2).select(
        "*", F.get("path", 0)["x"].alias("_ax"), F.get("path", 0)["y"].alias("_ay"),
        F.element_at("path", -1)["x"].alias("_bx"), F.element_at("path", -1)["y"].alias("_by"))
    found.append(first_near(ends(drawn), ends(ink), PAGE_KEY, ["_ax", "_ay", "_bx", "_by"], 5.0))
    found.append(first_near(drawn, ink, PAGE_KEY, ["x", "y"], 50.0))
    found.append(first_near(drawn, ink, PAGE_KEY, ["width", "height"], 50.0))

    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.groupBy("target_id").agg(F.min("hit").alias("hit")).select("target_id", F.col("hit.ann_id").alias("ann_id"))


def _same_quads(targets, stored, tol=0.1) -> DataFrame:
    t = targets.select(*PAGE_KEY, "quads", "_qx", "_qy").distinct().withColumn("_n", F.size("quads")).withColumn(
        "_cx", cell(F.col("_qx"), 1)).withColumn("_cy", cell(F.col("_qy"), 1))
    s = stored.groupBy(*PAGE_KEY, F.col("quads").alias("_sq"), "_qx", "_qy").agg(F.min("hit").alias("hit")).withColumn(
        "_n", F.size("_sq")).withColumn("_c", F.explode(around(F.col("_qx"), F.col("_qy"), 1))).select(
        *PAGE_KEY, "_sq", "hit", "_n", F.col("_c.cx").alias("_cx"), F.col("_c.cy").alias("_cy"))
    near = lambda a, b: F.when(
        (F.size(a) >= 8) & (F.size(b) >= 8),
        F.forall(F.zip_with(F.slice(a, 1, 8), F.slice(b, 1, 8), lambda p, q: F.abs(p - q) <= tol), lambda ok: ok)
    ).otherwise(F.lit(True))
    j = t.join(s, [*PAGE_KEY, "_n", "_cx", "_cy"]).filter(
        F.forall(F.zip_with("quads", "_sq", near), lambda ok: ok))
    best = j.groupBy(*PAGE_KEY, "quads").agg(F.min("hit").alias("hit"))
    return targets.join(best, [*PAGE_KEY, "quads"]).select("target_id", "hit")


def delete_matched(stored: DataFrame, targets: DataFrame) -> DataFrame:
    """Stored rows without those that a target stands for."""
    gone = match_annotations(targets, stored).select("ann_id").distinct()
    return stored.join(gone, "ann_id", "left_anti").select(stored.columns)


# -- de-duplication ------------------------------------------------------------------------------------------


def dedupe_widgets(listed: DataFrame, found: DataFrame, tol=1.0) -> DataFrame:
    """Form fields of both passes: one found later is dropped if one within 1 pt is there already."""
    near = first_near(
        found.withColumn("target_id", F.col("ann_id")), listed.withColumn("hit", F.col("ann_id")), PAGE_KEY, ["x", "y"], tol)
    fresh = found.join(near.select(F.col("target_id").alias("ann_id")).distinct(), "ann_id", "left_anti")
    places = settle(fresh.groupBy(*PAGE_KEY, "x", "y").agg(F.min(F.struct("ord", "ann_id")).alias("node")))
    edges = _near_pairs(places, ["x", "y"], tol)
    first = keep_first(places.select("node"), edges).select(F.col("node.ann_id").alias("ann_id"))
    return listed.unionByName(fresh.join(first, "ann_id", "left_semi").select(found.columns))


def _near_pairs(places, dims, tol):
    """Pairs of places of a page within the tolerance, earlier one first."""
    a = places.withColumn("_cx", cell(F.col(dims[0]), tol)).withColumn("_cy", cell(F.col(dims[1]), tol))
    b = places.withColumn("_c", F.explode(around(F.col(dims[0]), F.col(dims[1]), tol))).select(
        *PAGE_KEY, F.col("node").alias("earlier"), *[F.col(d).alias(f"_o{i}") for i, d in enumerate(dims)],
        F.col("_c.cx").alias("_cx"), F.col("_c.cy").alias("_cy"))
    j = a.join(b, [*PAGE_KEY, "_cx", "_cy"]).filter(F.col("earlier") < F.col("node"))
    for i, d in enumerate(dims):
        j = j.filter(F.abs(F.col(d) - F.col(f"_o{i}")) < tol)
    return j.select("earlier", F.col("node").alias("later"))


_ENDS = ["ax", "ay", "bx", "by"]


def _arrow_ends(df):
    """Ends of the arrows, and nothing else of them."""
    arrows = df.filter((F.col("type") == "shape") & (F.col("shape_type") == "arrow") & (F.size("points") == 2))
    p, q = F.get("points", 0), F.get("points", 1)
    return settle(arrows.select(
        F.struct("ord", "ann_id").alias("node"), *PAGE_KEY,
        p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))


def _turned(df):
    """Each arrow in both directions."""
    both = F.array(
        F.struct(*[F.col(e) for e in _ENDS]),
        F.struct(*[F.col(o).alias(e) for o, e in zip(("bx", "by", "ax", "ay"), _ENDS)]))
    return df.select(*[c for c in df.columns if c not in _ENDS], F.explode(both).alias("_e")).select(
        *[c for c in df.columns if c not in _ENDS], "_e.*")


# What a matching loaded arrow overwrites.
ARROW_UPDATES = ("points", "x", "y", "width", "height", "stroke_color", "stroke_width", "arrow_head_size")


def dedupe_on_load(batch: DataFrame, store: DataFrame):
    """``(rows to add, store with updates)`` when a loaded batch meets the store.

    A loaded row is a duplicate if it has the handle of a row that is there, or is an arrow on the same page whose
    ends match, in either direction, an earlier added arrow within 1 pt or a stored one within 10 pt; the first
    such stored arrow takes over its geometry, the last loaded one winning.
    """
    loaded, existing = _arrow_ends(batch), _arrow_ends(store)
    hits = settle(first_near(
        loaded.withColumn("target_id", F.col("node")), _turned(existing).withColumn("hit", F.col("node")),
        PAGE_KEY, _ENDS, 10.0))
    known = store.filter(F.col("handle").isNotNull()).select("doc_id", "handle").distinct()
    matched = hits.select(F.col("target_id.ann_id").alias("ann_id")).distinct()
    fresh = batch.select("doc_id", "ann_id", "ord", "handle").join(known, ["doc_id", "handle"], "left_anti").join(
        matched, "ann_id", "left_anti")
    # Rows of one handle are one object: the first stands for all.
    firsts = fresh.filter(F.col("handle").isNotNull()).groupBy("doc_id", "handle").agg(
        F.min(F.struct("ord", "ann_id")).alias("node")).select("node")
    single = settle(fresh.filter(F.col("handle").isNull()).select(F.struct("ord", "ann_id").alias("node")).unionByName(firsts))

    # Equal arrows are one place; arrows that point the other way meet through the edges.
    places = settle(loaded.join(single, "node", "left_semi").groupBy(*PAGE_KEY, *_ENDS).agg(F.min("node").alias("node")))
    other = _turned(places).withColumn("_c", F.explode(around(F.col("ax"), F.col("ay"), 1.0))).select(
        *PAGE_KEY, F.col("node").alias("earlier"), *[F.col(d).alias(f"_o{d}") for d in _ENDS],
        F.col("_c.cx").alias("_cx"), F.col("_c.cy").alias("_cy"))
    pairs = places.withColumn("_cx", cell(F.col("ax"), 1.0)).withColumn("_cy", cell(F.col("ay"), 1.0)).join(
        other, [*PAGE_KEY, "_cx", "_cy"]).filter(F.col("earlier") < F.col("node"))
    for d in _ENDS:
        pairs = pairs.filter(F.abs(F.col(d) - F.col(f"_o{d}")) < 1.0)
    first = keep_first(places.select("node"), pairs.select("earlier", F.col("node").alias("later")))
    plain = single.join(loaded.select("node"), "node", "left_anti")
    to_add = batch.join(
        plain.unionByName(first).select(F.col("node.ann_id").alias("ann_id")), "ann_id", "left_semi").select(batch.columns)

    last = hits.groupBy("hit").agg(F.max("target_id").alias("_t")).select(
        F.col("hit.ann_id").alias("_stored"), F.col("_t.ann_id").alias("_loaded"))
    values = [c for c in (*ARROW_UPDATES, "handle") if c in batch.columns]
    patch = last.join(batch.select(F.col("ann_id").alias("_loaded"), *values), "_loaded").select(
        F.col("_stored").alias("ann_id"), *values)
    return to_add, merge_updates(store, patch, ["ann_id"])
