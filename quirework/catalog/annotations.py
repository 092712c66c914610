"""Annotation stores: loading, edits, matching, synchronisation."""

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import values
from ..operators import annotations as op
from ..plans import fixtures as fx
from ..plans.oracle import with_tables
from ..plans.settle import settle
from ..schema import ANNOTATION
from ..sources import annotations as src
from ..sources.structured_text import read_structured_text as read_stext
from .registry import query

c = F.col
KEY = ["doc_id", "page_number"]


@query("P38", with_tables("ann", "select ann_id, doc_id, page_number, type from ann where page_number = 1 and type in ('text', 'stamp')"))
def annotations_for(spark, sf):
    return op.annotations_for(fx.annotations(spark, sf), page_number=1, types=["text", "stamp"]).select("ann_id", *KEY, "type")


@query("A1", with_tables("annv", """
    select doc_id, page_number, ord // 1024 as part, count(*) as n, string_agg(ann_id::varchar || ':' || type, ',' order by ord) as annotations from annv group by 1, 2, 3"""))
def annotations_by_page(spark, sf):
    nested = op.annotations_by_page(fx.valid_annotations(spark, sf).select("ann_id", *KEY, "ord", "type"))
    label = lambda a: F.concat(a["ann_id"].cast("string"), F.lit(":"), a["type"])
    return nested.select(*KEY, "part", F.size("annotations").cast("long").alias("n"),
                         F.array_join(F.transform("annotations", label), ",").alias("annotations"))


@query("A7", with_tables("annv", """
    select doc_id, count(distinct page_number) as pages_with_annotations, count(*) filter (type = 'formField') as widgets,
        count(*) filter (type = 'stamp') as stamps, count(*) filter (type = 'redact') as redactions_left from annv group by 1"""))
def page_annotation_stats(spark, sf):
    return op.page_annotation_stats(fx.valid_annotations(spark, sf))


def _stamps(spark, sf):
    s = fx.annotations(spark, sf).filter(c("type") == "stamp")
    e = c("ann_id")
    kind = F.when(e % 3 == 0, "image").when(e % 3 == 1, "text").otherwise("signature")
    return s.withColumn("stamp", F.struct(
        F.concat(F.lit("s"), (e % 12).cast("string")).alias("id"), kind.alias("type"),
        F.when(e % 2 == 0, "data:image/png;base64,AAAA").alias("imageData"))).withColumn(
        "width", F.when(e % 5 == 0, F.lit(0.0)).otherwise(c("width")))


@query("A12", with_tables("ann", """
    select doc_id, ord // 1024 as part, string_agg(ann_id || '@' || page_number || ':' || (case when ann_id % 5 = 0 then 100 else width end)::int, ',' order by ord) as placements
    from ann where type = 'stamp' and ann_id % 6 = 0 group by 1, 2"""))
def image_stamps(spark, sf):
    label = lambda p: F.concat(
        p["ann_id"].cast("string"), F.lit("@"), p["page_number"].cast("string"), F.lit(":"), p["width"].cast("int").cast("string"))
    return op.image_stamps(_stamps(spark, sf)).select(
        "doc_id", "part", F.array_join(F.transform("placements", label), ",").alias("placements"))


@query("P39", with_tables("ann", """
    select ann_id, case when ann_id % 4 = 0 then 'new' when ann_id % 4 = 1 then null else content end as content, case when ann_id % 3 = 0 then x + 1 else x end as x
    from ann"""))
def merge_updates(spark, sf):
    base = fx.annotations(spark, sf).select("ann_id", "content", "x")
    patch = base.select(
        "ann_id", F.when(c("ann_id") % 4 == 0, "new").alias("content"), F.when(c("ann_id") % 3 == 0, c("x") + 1).alias("x"),
        F.when(c("ann_id") % 4 == 1, F.array(F.lit("content"))).otherwise(F.array().cast("array<string>")).alias("set_keys"))
    return op.merge_updates(base, patch, ["ann_id"])


_FOLD = """
    , ch as (select doc_id, ann_id, event_id, ts, op, case when op = 'remove' then null else value end as v, case when event_id % 3 = 0 and op <> 'remove' then 'n' || event_id end as note from edit where op in ('add', 'update', 'remove')),
    rs as (select doc_id, ann_id, first(op order by ts desc, event_id desc) as base_op, max({'ts': ts, 'e': event_id}) as rat from ch where op in ('add', 'remove') group by 1, 2),
    ed as (select ch.*, {'ts': ts, 'e': event_id} as eat from ch where op in ('add', 'update')),
    net as (select k.doc_id, k.ann_id, rs.base_op, first(ed.v order by ed.eat desc) filter (ed.v is not null and (rs.rat is null or ed.eat >= rs.rat)) as value,
        first(ed.note order by ed.eat desc) filter (ed.note is not null and (rs.rat is null or ed.eat >= rs.rat)) as note
        from (select distinct doc_id, ann_id from ch) k left join rs using (doc_id, ann_id) left join ed using (doc_id, ann_id) group by 1, 2, 3)"""


def _changes(spark, sf):
    e = fx.edit_events(spark, sf).filter(c("op").isin("add", "update", "remove"))
    return e.withColumn("note", F.when((c("event_id") % 3 == 0) & (c("op") != "remove"), F.concat(F.lit("n"), c("event_id").cast("string"))))


@query("E1", with_tables("edit", _FOLD + """
    , base as (select distinct user_id % 20 as doc_id, event_id % 40 as ann_id, 0::double as value, 'old' as note from events where event_id % 7 = 0)
    select coalesce(b.doc_id, n.doc_id) as doc_id, coalesce(b.ann_id, n.ann_id) as ann_id, case when base_op = 'add' then n.value else coalesce(n.value, b.value) end as value,
        case when base_op = 'add' then n.note else coalesce(n.note, b.note) end as note
    from base b full join net n on b.doc_id = n.doc_id and b.ann_id = n.ann_id where base_op = 'add' or (base_op is null and b.doc_id is not null)"""))
def apply_changes(spark, sf):
    base = fx.table(spark, sf, "events").filter(c("event_id") % 7 == 0).select(
        (c("user_id") % 20).alias("doc_id"), (c("event_id") % 40).alias("ann_id"), F.lit(0.0).alias("value"), F.lit("old").alias("note")).distinct()
    return op.apply_changes(base, _changes(spark, sf), ["value", "note"])


_STORED = """
    , st as (select ann_id::varchar as ann_id, doc_id, page_number, type, case type when 'highlight' then 'Highlight' when 'text' then 'FreeText' when 'redact' then 'Redact' when 'stamp' then 'Stamp' else 'Widget' end as subtype,
        type = 'text' and ann_id % 2 = 0 as custom, type = 'stamp' and ann_id % 3 = 0 as stamped, type = 'stamp' and ann_id % 3 = 1 as jsn from annv),
    cur as (select 'c' || ann_id as ann_id, doc_id, page_number, type from annv where ann_id % 4 = 0)"""


def _stored(spark, sf):
    a = fx.valid_annotations(spark, sf)
    e, t = c("ann_id"), c("type")
    stored = a.select(
        e.cast("string").alias("ann_id"), *KEY, "type", op.stored_kind(t).alias("subtype"),
        ((t == "text") & (e % 2 == 0)).alias("custom"), ((t == "stamp") & (e % 3 == 0)).alias("stamped"),
        ((t == "stamp") & (e % 3 == 1)).alias("stamp_contents"))
    current = a.filter(e % 4 == 0).select(F.concat(F.lit("c"), e.cast("string")).alias("ann_id"), *KEY, "type")
    return stored, current


@query("E2", with_tables("annv", _STORED + """
    select ann_id, doc_id, page_number, type from st where not (subtype in ('Highlight', 'Widget') or custom or stamped or jsn) union all select * from cur"""))
def sync_annotations(spark, sf):
    return op.sync_annotations(*_stored(spark, sf))


@query("E3", with_tables("annv", "select ann_id, type from annv where ann_id % 3 > 0 and type in ('text', 'highlight', 'callout', 'redact', 'image')"))
def sync_new(spark, sf):
    return op.sync_new(fx.valid_annotations(spark, sf).withColumn("already_synced", c("ann_id") % 3 == 0)).select("ann_id", "type")


@query("E4", with_tables("annv", _STORED + """
    , k as (select distinct doc_id, page_number, case type when 'text' then 'FreeText' when 'formField' then 'Widget' when 'highlight' then 'Highlight' end as subtype from cur)
    select ann_id, doc_id, page_number, type from st where not exists (select 1 from k where k.doc_id = st.doc_id and k.page_number = st.page_number and k.subtype = st.subtype and (st.subtype <> 'FreeText' or custom))
    union all select * from cur"""))
def sync_pages(spark, sf):
    stored, current = _stored(spark, sf)
    none = F.lit(None).cast("string")
    out = op.sync_pages(stored.withColumn("shape_type", none), current.withColumn("shape_type", none))
    return out.select("ann_id", *KEY, "type")


@query("E5", with_tables("page annv", """
    select doc_id, count(*) as flattened from annv semi join (select doc_id, page_number from page where page_number % 2 = 0) using (doc_id, page_number) group by 1"""))
def flatten_report(spark, sf):
    even = fx.pages(spark, sf).filter(c("page_number") % 2 == 0)
    return op.flatten(fx.valid_annotations(spark, sf), even)[1]


@query("E5", with_tables("page annv", """
    select ann_id, doc_id from annv anti join (select doc_id, page_number from page where page_number % 2 = 0) using (doc_id, page_number)"""))
def flatten_pages(spark, sf):
    even = fx.pages(spark, sf).filter(c("page_number") % 2 == 0)
    return op.flatten(fx.valid_annotations(spark, sf), even)[0].select("ann_id", "doc_id")


@query("J15", with_tables("ann", "select ann_id || '_copy_1700' as ann_id, doc_id, type from ann where ann_id % 6 = 0"))
def copy_annotations(spark, sf):
    a = fx.annotations(spark, sf).select("ann_id", "doc_id", "type")
    return op.copy_annotations(a, a.filter(c("ann_id") % 6 == 0), "1700")


# -- matching: targets are stored rows nudged by a few points ---------------------------------------------------

_MATCH = """
    , s0 as (select ann_id, ord, doc_id, page_number, type, ann_id % 2 = 0 as ov, x, y, width as w, height as h, case when type = 'stamp' then 's' || (ann_id % 30) end as sid from annv),
    s as (select *, case type when 'text' then 'FreeText' when 'redact' then 'Redact' when 'stamp' then 'Stamp' when 'formField' then 'Widget' else case when ov then 'Ink' else 'Highlight' end end as st from s0),
    t as (select ann_id as target_id, doc_id, page_number, type, ov, sid, x + (ann_id % 23) * 0.7::double as x, y - (ann_id % 17) * 0.8::double as y, w, h, (ann_id % 5) * 0.03::double as d from s where ann_id % 2 = 0 or ann_id % 3 = 0),
    m as (select target_id, s.ord, s.ann_id from t join s using (doc_id, page_number) where
        (st not in ('Ink', 'Highlight') and abs(t.x - s.x) < 10 and abs(t.y - s.y) < 10)
        or (t.type = 'stamp' and st = 'Stamp' and t.sid = s.sid)
        or (t.type = 'highlight' and not t.ov and st = 'Highlight' and abs(t.x + d - s.x) <= 0.1::double and abs(t.y - s.y) <= 0.1::double and abs(t.x + d + t.w - (s.x + s.w)) <= 0.1::double and abs(t.y + t.h - (s.y + s.h)) <= 0.1::double)
        or (t.type = 'highlight' and t.ov and st = 'Ink' and ((abs(t.x - s.x) < 5 and abs(t.y - s.y) < 5 and abs(t.x + t.w - (s.x + s.w)) < 5 and abs(t.y + t.h - (s.y + s.h)) < 5)
            or (abs(t.x - s.x) < 50 and abs(t.y - s.y) < 50) or (abs(t.w - s.w) < 50 and abs(t.h - s.h) < 50))))"""


def _match_inputs(spark, sf):
    # Both sides are stored tables in practice; here they are derived, so they are written once.
    a = settle(fx.valid_annotations(spark, sf))
    e, t = c("ann_id"), c("type")
    overlay = (t == "highlight") & (e % 2 == 0)

    def shaped(df, shift):
        pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
        x, y, w, h = c("x"), c("y"), c("width"), c("height")
        return df.withColumn("highlight_mode", F.when(overlay, "overlay").when(t == "highlight", "text")).withColumn(
            "stamp_id", F.when(t == "stamp", F.concat(F.lit("s"), (e % 30).cast("string")))).withColumn(
            "quads", F.when((t == "highlight") & ~overlay, F.array(g.rect_quad(x + shift, y, w, h)))).withColumn(
            "path", F.when(overlay, F.array(pt(x, y), pt(x + w, y + h))))

    stored = shaped(a, F.lit(0.0)).withColumn("subtype", op.stored_kind(t, mode=c("highlight_mode")))
    moved = a.filter((e % 2 == 0) | (e % 3 == 0)).withColumn("x", c("x") + (e % 23) * F.lit(0.7)).withColumn(
        "y", c("y") - (e % 17) * F.lit(0.8))
    return shaped(moved, (e % 5) * F.lit(0.03)).withColumn("target_id", e), stored


@query("J6", with_tables("annv", _MATCH + " select target_id, first(ann_id order by ord) as ann_id from m group by 1"))
def match_annotations(spark, sf):
    return op.match_annotations(*_match_inputs(spark, sf))


@query("J6", with_tables("annv", _MATCH + """
    , b as (select target_id, first(ann_id order by ord) as ann_id from m group by 1)
    select ann_id, doc_id, page_number, type from annv anti join b using (ann_id)"""))
def delete_matched(spark, sf):
    targets, stored = _match_inputs(spark, sf)
    return op.delete_matched(stored, targets).select("ann_id", *KEY, "type")


@query("J7", with_tables("annv", """
    , l as (select ann_id, doc_id, page_number, x, y from annv where type = 'formField'),
    f as (select 'p' || ann_id as ann_id, ord, doc_id, page_number, x + (ann_id % 4) * 0.5::double as x, y from annv where type = 'formField'),
    c as (select *, row_number() over (partition by doc_id, page_number order by ord, ann_id) as i from f where not exists
        (select 1 from l where l.doc_id = f.doc_id and l.page_number = f.page_number and abs(l.x - f.x) < 1 and abs(l.y - f.y) < 1)),
    s as (select distinct doc_id, page_number, 0::bigint as i, []::struct(ann_id varchar, x double, y double)[] as kept from c
        union all select s.doc_id, s.page_number, c.i, case when len(list_filter(kept, lambda k: abs(k.x - c.x) < 1 and abs(k.y - c.y) < 1)) > 0 then kept
            else list_append(kept, {'ann_id': c.ann_id, 'x': c.x, 'y': c.y}) end from s join c on c.doc_id = s.doc_id and c.page_number = s.page_number and c.i = s.i + 1),
    z as (select doc_id, page_number, last(kept order by i) as kept from s group by 1, 2)
    select ann_id::varchar as ann_id, doc_id, page_number from l union all select k.ann_id, doc_id, page_number from z, unnest(kept) u(k)""", recursive=True))
def dedupe_widgets(spark, sf):
    w = fx.valid_annotations(spark, sf).filter(c("type") == "formField").select("ann_id", "ord", *KEY, "type", "x", "y")
    found = w.withColumn("x", c("x") + (c("ann_id") % 4) * F.lit(0.5)).withColumn(
        "ann_id", F.concat(F.lit("p"), c("ann_id").cast("string")))
    return op.dedupe_widgets(w.withColumn("ann_id", c("ann_id").cast("string")), found).select("ann_id", *KEY)


def _arrows(annotations, kind, shift, prefix):
    a = annotations.filter(c("type") == kind)
    e = c("ann_id")
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y = c("x") + (e % 3) * F.lit(shift), c("y")
    one, two = pt(x, y), pt(x + c("width"), y + c("height"))
    return a.select(
        F.concat(F.lit(prefix), e.cast("string")).alias("ann_id"), "ord", *KEY, F.lit("shape").alias("type"),
        F.lit("arrow").alias("shape_type"), F.when(e % 2 == 0, F.array(one, two)).otherwise(F.array(two, one)).alias("points"),
        x.alias("x"), y.alias("y"), "width", "height", F.lit(None).cast("string").alias("handle"))


_NEAR = """((abs({a}.ax - {b}.ax) < {t} and abs({a}.ay - {b}.ay) < {t} and abs({a}.bx - {b}.bx) < {t} and abs({a}.by_ - {b}.by_) < {t})
            or (abs({a}.ax - {b}.bx) < {t} and abs({a}.ay - {b}.by_) < {t} and abs({a}.bx - {b}.ax) < {t} and abs({a}.by_ - {b}.ay) < {t}))"""


def _arrow_sql(kind, shift, prefix, later=0):
    return f"""select '{prefix}' || ann_id as ann_id, ord + {later} as ord, doc_id, page_number, xx as x, case when ev then xx else xx + width end as ax, case when ev then y else y + height end as ay,
            case when ev then xx + width else xx end as bx, case when ev then y + height else y end as by_ from (select *, x + (ann_id % 3) * {shift}::double as xx, ann_id % 2 = 0 as ev from annv where type = '{kind}')"""


@query("J8", with_tables("annv", f"""
    , st as ({_arrow_sql('text', 0, 's')}),
    ld as ({_arrow_sql('text', 4, 'b')} union all {_arrow_sql('highlight', 0.4, 'n')} union all {_arrow_sql('highlight', 0.7, 'm', 100000000)}),
    hit as (select ld.ann_id, ld.ord, ld.x, first(st.ann_id order by st.ord, st.ann_id) as stored from ld join st using (doc_id, page_number) where {_NEAR.format(a='ld', b='st', t=10)} group by 1, 2, 3),
    c as (select *, row_number() over (partition by doc_id, page_number order by ord, ann_id) as i from ld where ann_id not in (select ann_id from hit)),
    s as (select distinct doc_id, page_number, 0::bigint as i, []::struct(ann_id varchar, x double, ax double, ay double, bx double, by_ double)[] as kept from c
        union all select s.doc_id, s.page_number, c.i, case when len(list_filter(kept, lambda k: {_NEAR.format(a='k', b='c', t=1)})) > 0 then kept
            else list_append(kept, {{'ann_id': c.ann_id, 'x': c.x, 'ax': c.ax, 'ay': c.ay, 'bx': c.bx, 'by_': c.by_}}) end from s join c on c.doc_id = s.doc_id and c.page_number = s.page_number and c.i = s.i + 1),
    z as (select doc_id, page_number, last(kept order by i) as kept from s group by 1, 2),
    up as (select stored, last(x order by ord, ann_id) as x from hit group by 1)
    select k.ann_id, doc_id, page_number, 'added' as outcome, k.x from z, unnest(kept) u(k)
    union all select st.ann_id, doc_id, page_number, 'stored', coalesce(up.x, st.x) from st left join up on up.stored = st.ann_id""", recursive=True))
def dedupe_on_load(spark, sf):
    """Arrows of the store, loaded again with shifts and turned round, plus fresh ones."""
    # Batch and store are stored tables in practice; here they are derived, so their rows are written once.
    a = settle(fx.valid_annotations(spark, sf).filter(c("type").isin("text", "highlight")).select(
        "ann_id", "ord", *KEY, "type", "x", "y", "width", "height"))
    store, again = _arrows(a, "text", 0.0, "s"), _arrows(a, "text", 4.0, "b")
    twice = _arrows(a, "highlight", 0.4, "n").unionByName(
        _arrows(a, "highlight", 0.7, "m").withColumn("ord", c("ord") + 100000000))
    to_add, updated = op.dedupe_on_load(again.unionByName(twice), store)
    return to_add.select("ann_id", *KEY, F.lit("added").alias("outcome"), "x").unionByName(
        updated.select("ann_id", *KEY, F.lit("stored").alias("outcome"), "x"))


# -- loading ----------------------------------------------------------------------------------------------------


def typed_annotations(spark, sf):
    """Full typed rows of eleven kinds, from the events."""
    a = fx.valid_annotations(spark, sf)
    e = c("ann_id")
    kinds = ["highlight", "redact", "text", "image", "callout", "stamp", "formField", "arrow", "rectangle", "circle", "draw", "overlay"]
    k = F.element_at(F.array(*map(F.lit, kinds)), (e % len(kinds) + 1).cast("int"))
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, w, h = c("x") + 200, c("y"), c("width"), c("height")
    color = F.format_string("#%02x%02x%02x", e * 7 % 256, e * 13 % 256, e * 29 % 256)
    ft = F.element_at(F.array(*map(F.lit, ("text", "checkbox", "radio", "dropdown", "date"))), (F.floor(e / 12) % 5 + 1).cast("int"))
    field = k == "formField"
    shape = k.isin("arrow", "rectangle", "circle")
    name = F.concat(F.when(ft == "date", "date_").otherwise("f"), (e % 9).cast("string"))
    given = {
        "ann_id": e.cast("string"), "ord": c("ord").cast("int"),
        "type": F.when(shape, "shape").when(k == "overlay", "highlight").otherwise(k), "x": x, "y": y, "width": w, "height": h,
        "content": F.when(k == "highlight", c("content")).when(k == "text", F.concat(F.lit("<b>"), c("content"), F.lit("</b><br>x"))).when(k == "callout", c("content")),
        "color": F.when(k.isin("highlight", "overlay", "draw", "callout"), color).when(k == "text", "#000000"),
        "opacity": F.when(k.isin("highlight", "overlay"), (e % 10) / 10),
        "rotation": F.when(k == "image", F.lit(30.0)),
        "quads": F.when(k == "highlight", F.array(g.rect_quad(x, y, w, h))),
        "path": F.when(k.isin("draw", "overlay"), F.array(pt(x, y), pt(x + w, y), pt(x + w, y + h))),
        "points": F.when(k == "arrow", F.array(pt(x, y), pt(x + w, y + h))),
        "highlight_mode": F.when(k == "highlight", "text").when(k == "overlay", "overlay"),
        "arrow_point": F.when(k == "callout", pt(x - 30, y + 40)), "box_position": F.when(k == "callout", pt(x, y)),
        "shape_type": F.when(shape, k), "stroke_color": F.when(shape, color),
        "stroke_width": F.when(shape | k.isin("draw", "overlay"), (e % 6 + 1).cast("double")),
        "fill_color": F.when(k.isin("rectangle", "circle") & (e % 2 == 0), color),
        "fill_opacity": F.when(k.isin("rectangle", "circle") & (e % 2 == 0), F.lit(0.25)),
        "arrow_head_size": F.when(k == "arrow", F.lit(14.0)),
        "font_size": F.when(k == "text", F.lit(12.0)).when(k == "callout", F.lit(9.0)),
        "font_family": F.when(k == "text", "Arial").when(k == "callout", "Times"),
        "has_background": F.when(k == "text", e % 24 == 2), "background_color": F.when(k == "text", "rgb(1, 2, 3)"),
        "image_data": F.when(k == "image", "data:image/png;base64,AAAA"), "image_width": F.when(k == "image", F.lit(64.0)),
        "image_height": F.when(k == "image", F.lit(48.0)), "preserve_aspect": F.when(k == "image", e % 24 == 3),
        "field_type": F.when(field, ft), "field_name": F.when(field, name),
        "value_str": F.when(field & ft.isin("text", "dropdown", "date"), c("content")),
        "value_bool": F.when(field & ft.isin("checkbox", "radio"), e % 7 < 3),
        "options": F.when(field & (ft == "dropdown"), F.array(c("content"), F.lit("other"))),
        "required": F.when(field, e % 5 == 0), "read_only": F.when(field, e % 3 == 0),
        "multiline": F.when(field, ((ft == "text") & (e % 2 == 0)) | (ft == "date")),
        "radio_group": F.when(field & (ft == "radio"), name),
        "stamp_id": F.when(k == "stamp", F.lit("s1")),
        "stamp": F.when(k == "stamp", F.struct(F.lit("s1").alias("id"), F.lit("Approved").alias("name"), F.lit("text").alias("type"), c("content").alias("text"))),
    }
    ddl = {p.strip().split(" ")[0]: p.strip().split(" ", 1)[1] for p in src._top_level(ANNOTATION)}

    def column(n):
        if n == "stamp":
            return F.from_json(F.to_json(given[n]), ddl[n]).alias(n)
        return given[n].cast(ddl[n]).alias(n)

    return a.select(*[c(n) if n in KEY else column(n) for n in ddl])


@query("S4 S4a S4b S4c S4d S4e S4f S4g S4h S4i S5 S15 P32", with_tables("annv", """
    , k as (select *, ['highlight', 'redact', 'text', 'image', 'callout', 'stamp', 'formField', 'arrow', 'rectangle', 'circle', 'draw', 'overlay'][ann_id % 12 + 1] as k from annv)
    select ord::int as ord, doc_id, page_number, case when k in ('arrow', 'rectangle', 'circle') then 'shape' when k = 'overlay' then 'highlight' else k end as type, round(x + 200, 6) as x, round(y, 6) as y, round(width, 6) as width, round(height, 6) as height,
        case when k = 'text' then '<b>' || content || '</b><br>x' when k in ('highlight', 'callout') then content when k = 'overlay' then null end as content,
        case when k in ('arrow', 'rectangle', 'circle') then k end as shape_type, case k when 'highlight' then 'text' when 'overlay' then 'overlay' end as highlight_mode,
        case when k in ('arrow', 'rectangle', 'circle', 'draw', 'overlay') then (ann_id % 6 + 1)::double end as stroke_width,
        case when k in ('highlight', 'overlay') then (ann_id % 10) / 10 end::double as opacity,
        case when k in ('highlight', 'overlay', 'draw', 'callout') then printf('#%02x%02x%02x', ann_id * 7 % 256, ann_id * 13 % 256, ann_id * 29 % 256) when k = 'text' then '#000000' end as color,
        case when k = 'stamp' then 's1' end as stamp_id, case when k = 'formField' then ['text', 'checkbox', 'radio', 'dropdown', 'date'][(ann_id // 12) % 5 + 1] end as field_type
    from k"""))
def load_annotations(spark, sf):
    """Typed rows written as raw records and loaded again."""
    pages = fx.pages(spark, sf)
    back = src.load_annotations(src.to_raw(typed_annotations(spark, sf), pages), merge_widgets=False)
    return back.select(
        "ord", *KEY, "type", *[F.round(n, 6).alias(n) for n in ("x", "y", "width", "height")], "content", "shape_type",
        "highlight_mode", "stroke_width", "opacity", "color", "stamp_id", "field_type")


# The page's own list has every widget again, half of them moved by half a point to one and a half.
@query("S4c J7", with_tables("annv", """
    , l as (select ord, doc_id, page_number, x + 200 as x, y from annv where ann_id % 12 = 6),
    f as (select ord + 10000000 as ord, doc_id, page_number, x + (ord % 4) * 0.5::double as x, y from l),
    c as (select *, row_number() over (partition by doc_id, page_number order by ord) as i from f where not exists
        (select 1 from l where l.doc_id = f.doc_id and l.page_number = f.page_number and abs(l.x - f.x) < 1 and abs(l.y - f.y) < 1)),
    s as (select distinct doc_id, page_number, 0::bigint as i, []::struct(ord bigint, x double, y double)[] as kept from c
        union all select s.doc_id, s.page_number, c.i, case when len(list_filter(kept, lambda k: abs(k.x - c.x) < 1 and abs(k.y - c.y) < 1)) > 0 then kept
            else list_append(kept, {'ord': c.ord, 'x': c.x, 'y': c.y}) end from s join c on c.doc_id = s.doc_id and c.page_number = s.page_number and c.i = s.i + 1),
    z as (select doc_id, page_number, last(kept order by i) as kept from s group by 1, 2)
    select ord::int as ord, doc_id, page_number, x, y from l union all select k.ord::int, doc_id, page_number, k.x, k.y from z, unnest(kept) u(k)""", recursive=True))
def load_widgets(spark, sf):
    """Raw records of both widget passes, loaded and merged."""
    typed, pages = typed_annotations(spark, sf).filter(c("type") == "formField"), fx.pages(spark, sf)
    again = typed.withColumn("x", c("x") + (c("ord") % 4) * F.lit(0.5)).withColumn("ord", (c("ord") + 10_000_000).cast("int"))
    r, h = c("rect"), c("page_height")
    # The list gives rectangles from the top of the page, the page's own array from its bottom.
    second = src.to_raw(again, pages).withColumn("source", F.lit("page")).withColumn("rect", F.array(r[0], h - r[3], r[2], h - r[1]))
    raw = src.to_raw(typed, pages).unionByName(second)
    return src.load_annotations(raw).select("ord", *KEY, "x", "y")


@query("S6", with_tables("annv", "select count(*) as n, count(distinct ann_id) as ids from annv"))
def annotation_ids(spark, sf):
    back = src.load_annotations(src.to_raw(typed_annotations(spark, sf), fx.pages(spark, sf)), merge_widgets=False)
    # Ids are unique by construction; distinct ids are counted by grouping, which pre-aggregates.
    per_id = back.groupBy("ann_id").agg(F.count(F.lit(1)).alias("k"))
    return per_id.agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("ids"))


@query("S2", with_tables("span page", """
    , s as (select s.*, p.height as h from span s join page p using (doc_id, page_number))
    select doc_id, page_number, span_id % 5 as form, count(*) as n, round(min(case when span_id % 5 = 2 then x0 else x0 end), 6) as x0, round(max(case when span_id % 5 = 2 then x0 + length(text) * 10 * 0.6::double else x1 end), 6) as x1,
        round(min(case when span_id % 5 = 2 then y1 - 10 else y0 end), 6) as y0, round(max(y1), 6) as y1
    from s where span_id % 5 < 3 or span_id % 5 = 4 group by 1, 2, 3"""))
def read_structured_text(spark, sf):
    """Every word as a one-line page: box as object, as array, estimated, missing, and as a nested span."""
    s = fx.spans(spark, sf)
    h = fx.page_height(c("doc_id"))
    form = c("span_id") % 5
    top, low = h - c("y1"), h - c("y0")
    arr = F.array(c("x0"), top, c("x1"), low)
    obj = F.struct(c("x0").alias("x"), top.alias("y"), (c("x1") - c("x0")).alias("w"), (low - top).alias("h"))
    plain = lambda *f: F.to_json(F.struct(c("text").alias("text"), *f))
    line = (
        F.when(form == 0, plain(obj.alias("bbox"))).when(form == 1, plain(arr.alias("bbox")))
        .when(form == 2, plain(c("x0").alias("x"), top.alias("y"), F.struct(F.lit(10.0).alias("size")).alias("font")))
        .when(form == 3, plain())
        .otherwise(F.to_json(F.struct(F.array(F.struct(c("text").alias("text"), arr.alias("bbox"))).alias("spans")))))
    block = F.concat(F.lit('{"blocks":[{"type":"image"},{"type":"text","lines":['), line, F.lit("]}]}"))
    pages = s.select("doc_id", "page_number", h.alias("page_height"), "span_id", block.alias("json"))
    # The word's own id travels as the page number, to tell the rows apart afterwards.
    read = read_stext(pages.withColumn("page_number", F.struct("page_number", "span_id")))
    return read.select(
        "doc_id", c("page_number.page_number").alias("page_number"), (c("page_number.span_id") % 5).alias("form"), "x0", "x1", "y0", "y1"
    ).groupBy("doc_id", "page_number", "form").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("x0"), 6).alias("x0"), F.round(F.max("x1"), 6).alias("x1"),
        F.round(F.min("y0"), 6).alias("y0"), F.round(F.max("y1"), 6).alias("y1"))


@query("P37", with_tables("ann", "select ann_id, content from ann where contains(lower(content), 'te 3')"))
def name_search(spark, sf):
    a = fx.annotations(spark, sf).select("ann_id", "content")
    return a.filter(values.name_contains(c("content"), F.lit("TE 3")))
