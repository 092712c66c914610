"""Forms, outlines, bookmarks, settings and exports."""

from pyspark.sql import functions as F

from ..functions import fields as ff
from ..operators import documents as op
from ..plans import fixtures as fx
from ..plans.oracle import with_tables
from ..sources import annotations as src
from ..sources import settings as st
from ..sources import sinks
from .registry import query
from .text import _page_text

c = F.col
KEY = ["doc_id", "page_number"]

_FORM = """(select event_id, user_id as doc_id, 'f' || (event_id % 9) as field_name, ['text', 'checkbox', 'radio', 'dropdown', 'date'][event_id % 5 + 1] as field_type,
    event_id % 3 = 0 as required, case when event_id % 4 = 0 then '' when event_id % 4 = 1 then null else 'v' || event_id end as value_str, event_id % 2 = 0 as value_bool from events)"""


def _form(spark, sf):
    e = c("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("text", "checkbox", "radio", "dropdown", "date"))), (e % 5 + 1).cast("int"))
    return fx.table(spark, sf, "events").select(
        "event_id", c("user_id").alias("doc_id"), F.concat(F.lit("f"), (e % 9).cast("string")).alias("field_name"),
        kind.alias("field_type"), (e % 3 == 0).alias("required"),
        F.when(e % 4 == 0, "").when(e % 4 > 1, F.concat(F.lit("v"), e.cast("string"))).alias("value_str"),
        (e % 2 == 0).alias("value_bool"))


@query("P41", f"select event_id from {_FORM} where required and field_type in ('text', 'date', 'dropdown') and coalesce(value_str, '') = ''")
def missing_required(spark, sf):
    f = _form(spark, sf)
    return f.filter(ff.missing_required(c("field_type"), c("required"), c("value_str"))).select("event_id")


@query("E6", f"""with f as {_FORM}, g as (select distinct user_id as doc_id, 'f' || (user_id % 9) as field_name, case when user_id % 3 > 0 then 'new' || user_id end as s, user_id % 2 = 0 as b from events)
    select event_id, f.doc_id, field_name, case when g.doc_id is not null and field_type in ('text', 'date') then coalesce(s, '') when g.doc_id is not null and field_type = 'dropdown' then coalesce(s, value_str) else value_str end as value_str,
        case when g.doc_id is not null and field_type in ('checkbox', 'radio') then b else value_bool end as value_bool, case when g.doc_id is not null and field_type in ('text', 'date') then coalesce(s, '') end as default_value,
        case when g.doc_id is not null and field_type in ('checkbox', 'radio') then case when b then 'Yes' else 'Off' end end as state
    from f left join g using (doc_id, field_name)""")
def fill_forms(spark, sf):
    u = c("doc_id")
    given = fx.table(spark, sf, "events").select(c("user_id").alias("doc_id")).distinct().select(
        "doc_id", F.concat(F.lit("f"), (u % 9).cast("string")).alias("field_name"),
        F.when(u % 3 > 0, F.concat(F.lit("new"), u.cast("string"))).alias("value_str"), (u % 2 == 0).alias("value_bool"))
    return op.fill_forms(_form(spark, sf), given).drop("field_type", "required")


@query("E7", with_tables("annv", """
    select ann_id::int as ord, doc_id, page_number, 'date_' || (ann_id % 7) as field_name, case ann_id % 3 when 0 then 'date' when 1 then case when ann_id % 2 = 0 then 'radio' else 'checkbox' end else 'dropdown' end as field_type,
        case when ann_id % 3 <> 1 then content end as value_str, case when ann_id % 3 = 1 then ann_id % 4 < 2 end as value_bool, x, y, width, height from annv where type = 'formField'"""))
def detect_fields(spark, sf):
    a = fx.valid_annotations(spark, sf)
    e = c("ann_id")
    raw = a.select(
        *KEY, e.cast("int").alias("ord"), F.when(c("type") == "formField", "Widget").otherwise("Highlight").alias("subtype"),
        F.array(c("x"), c("y"), c("x") + c("width"), c("y") + c("height")).alias("rect"),
        F.create_map(
            F.lit("FT"), F.when(e % 3 == 0, "/Tx").when(e % 3 == 1, "Btn").otherwise("/Ch"),
            F.lit("Ff"), F.when((e % 3 == 1) & (e % 2 == 0), "32768").otherwise("0"),
            F.lit("T"), F.concat(F.lit("(date_"), (e % 7).cast("string"), F.lit(")")),
            F.lit("V"), F.when(e % 3 == 1, F.when(e % 4 < 2, "/Yes").otherwise("/Off")).otherwise(c("content"))).alias("flags"))
    return src.detect_fields(raw)


_OUTLINE = """, t as (select doc_id, node_id, page_number, title, [{'o': ord, 'n': node_id}] as path, 0 as depth from outline where parent_id is null
    union all select o.doc_id, o.node_id, o.page_number, t.title || ' > ' || o.title, list_append(t.path, {'o': o.ord, 'n': o.node_id}), depth + 1
    from outline o join t on o.doc_id = t.doc_id and o.parent_id = t.node_id)"""


@query("A8 S7", with_tables("outline", _OUTLINE + """
    select doc_id, node_id, title, page_number, depth, row_number() over (partition by doc_id order by path) - 1 as position from t""", recursive=True))
def flatten_outline(spark, sf):
    return op.flatten_outline(fx.outline_nodes(spark, sf))


@query("S7", with_tables("outline", "select doc_id, node_id, parent_id, ord, title, page_number from outline"))
def outline_nodes(spark, sf):
    return fx.outline_nodes(spark, sf)


@query("U1", with_tables("outline", """
    , a as (select doc_id, 'n' || node_id as bookmark_id, page_number, title, 0 as src from outline union all
        select doc_id, 'a' || node_id, page_number, case when node_id % 2 = 0 then title else 'note' end, 1 from outline
        union all select doc_id, 'b' || node_id, page_number, 'note', 1 from outline)
    select doc_id, page_number, title, first(bookmark_id order by src, bookmark_id) as bookmark_id from a group by 1, 2, 3"""))
def merge_bookmarks(spark, sf):
    o = fx.outline_nodes(spark, sf)
    mark = lambda p, title: o.select("doc_id", F.concat(F.lit(p), c("node_id").cast("string")).alias("bookmark_id"),
                                     "page_number", title.alias("title"))
    app = mark("a", F.when(c("node_id") % 2 == 0, c("title")).otherwise("note")).unionByName(mark("b", F.lit("note")))
    return op.merge_bookmarks(mark("n", c("title")), app)


# A quarter of the documents have a record without values; ids are text, some of which looks like no number.
_ID = "case when doc_id % 3 = 0 then 'doc-' || doc_id else doc_id::varchar end"
_SET = f"""(select {_ID} as doc_id, case when b then ['auto', 'portrait', 'landscape'][doc_id % 3 + 1] end as orientation, case when b then ['letter', 'a4', 'legal', 'tabloid', 'custom'][doc_id % 5 + 1] end as page_size,
    case when b then [1, 2, 4, 6, 9, 16][doc_id % 6 + 1] end as pages_per_sheet, case when b then ['horizontal', 'vertical'][doc_id % 2 + 1] end as page_order,
    case when b then ['none', 'narrow', 'normal', 'wide', 'custom'][doc_id % 5 + 1] end as margin_preset, case when b then ['fit', 'actual', 'custom'][doc_id % 3 + 1] end as scaling_mode, case when b then (doc_id % 500)::double end as custom_scale,
    case when b then ['all', 'current', 'custom'][doc_id % 3 + 1] end as print_range, case when b then '1-' || (doc_id % 9 + 1) end as custom_range,
    case when b and doc_id % 7 > 0 then (doc_id % 30) / 2 end::double as custom_width, case when b and doc_id % 7 > 0 then (doc_id % 40) / 2 end::double as custom_height,
    case when b and doc_id % 2 > 0 then (doc_id % 8) / 4 end::double as margin_top, case when b and doc_id % 2 > 0 then (doc_id % 4) / 4 end::double as margin_right,
    case when b and doc_id % 2 > 0 then (doc_id % 5) / 4 end::double as margin_bottom, case when b and doc_id % 2 > 0 then (doc_id % 16) / 4 end::double as margin_left from (select *, doc_id % 4 > 0 as b from documents))"""


def _doc_name(d):
    return F.when(d % 3 == 0, F.concat(F.lit("doc-"), d.cast("string"))).otherwise(d.cast("string"))


def _settings(spark, sf):
    d = c("doc_id")
    set_ = lambda v, more=F.lit(True): F.when((d % 4 > 0) & more, v)
    pick = lambda vals: set_(F.element_at(F.array(*map(F.lit, vals)), (d % len(vals) + 1).cast("int")))
    sized = lambda n: set_((d % n) / 2, d % 7 > 0)
    edge = lambda n: set_((d % n) / 4, d % 2 > 0)
    return fx.table(spark, sf, "documents").select(
        _doc_name(d).alias("doc_id"), pick(("auto", "portrait", "landscape")).alias("orientation"),
        pick(("letter", "a4", "legal", "tabloid", "custom")).alias("page_size"), pick((1, 2, 4, 6, 9, 16)).alias("pages_per_sheet"),
        pick(("horizontal", "vertical")).alias("page_order"), pick(("none", "narrow", "normal", "wide", "custom")).alias("margin_preset"),
        pick(("fit", "actual", "custom")).alias("scaling_mode"), set_((d % 500).cast("double")).alias("custom_scale"),
        pick(("all", "current", "custom")).alias("print_range"), set_(F.concat(F.lit("1-"), (d % 9 + 1).cast("string"))).alias("custom_range"),
        sized(30).alias("custom_width"), sized(40).alias("custom_height"), edge(8).alias("margin_top"), edge(4).alias("margin_right"),
        edge(5).alias("margin_bottom"), edge(16).alias("margin_left"))


@query("S8", f"select * from {_SET}")
def settings_round_trip(spark, sf):
    """All eleven settings, the custom size and the four margins included, through the file format."""
    return st.read_settings(st.write_settings(_settings(spark, sf)))


_PAPER = "(case {p} when 'a4' then 8.27 when 'tabloid' then 11 else 8.5 end)::double", "(case {p} when 'a4' then 11.69 when 'legal' then 14 when 'tabloid' then 17 else 11 end)::double"
_MARGIN = "(case {m} when 'narrow' then 0.25 when 'normal' then 0.5 when 'wide' then 1 when 'custom' then 0.5 else 0 end)::double"
_EDGES = ("margin_top", "margin_right", "margin_bottom", "margin_left")
_W, _H, _M = _PAPER[0].format(p="page_size"), _PAPER[1].format(p="page_size"), _MARGIN.format(m="margin_preset")


@query("E9 P25", f"""with s as {_SET}, d as (select {_ID} as doc_id from documents), j as (select d.doc_id, coalesce(orientation, 'auto') as orientation, coalesce(page_size, 'letter') as page_size, coalesce(pages_per_sheet, 1)::int as pages_per_sheet,
        coalesce(page_order, 'horizontal') as page_order, coalesce(margin_preset, 'none') as margin_preset, coalesce(scaling_mode, 'fit') as scaling_mode, greatest(25, least(coalesce(custom_scale, 100), 400))::double as custom_scale,
        coalesce(print_range, 'all') as print_range, coalesce(custom_range, '') as custom_range, custom_width as cw, custom_height as ch, {', '.join(f'{e} as c{e}' for e in _EDGES)} from d left join s using (doc_id))
    select doc_id, orientation, page_size, pages_per_sheet, page_order, margin_preset, scaling_mode, custom_scale, print_range, custom_range,
        case page_size when 'custom' then coalesce(cw, {_W}) else {_W} end as custom_width, case page_size when 'custom' then coalesce(ch, {_H}) else {_H} end as custom_height,
        {', '.join(f"case margin_preset when 'custom' then coalesce(c{e}, {_M}) else {_M} end as {e}" for e in _EDGES)} from j""")
def effective_settings(spark, sf):
    docs = fx.table(spark, sf, "documents").select(_doc_name(c("doc_id")).alias("doc_id"))
    return op.effective_settings(docs, _settings(spark, sf))


# Edits of a few documents: sizes, margins, own margins, resets and removals by the type of the event.
_EDIT_SQL = f"""with recursive e as (select event_id, 'u' || (user_id % 40) as doc_id, event_type as k, event_id % 5 as n, row_number() over (partition by user_id % 40 order by ts, event_id) as i from events),
    z as (select 'u' || doc_id as doc_id, true as there, ['letter', 'a4', 'legal', 'tabloid', 'custom'][doc_id % 5 + 1] as page_size, 'wide' as margin_preset, 1::double as margin_top, 7::double as custom_width, 3::int as pages_per_sheet from documents where doc_id % 2 = 0 and doc_id < 40),
    s as (select 'u' || g as doc_id, 0::bigint as i, coalesce(there, false) as there, coalesce(page_size, 'letter') as page_size, coalesce(margin_preset, 'none') as margin_preset, coalesce(margin_top, 0)::double as margin_top,
            coalesce(custom_width, 8.5)::double as custom_width, coalesce(pages_per_sheet, 1)::int as pages_per_sheet from range(40) t(g) left join z on z.doc_id = 'u' || g
        union all select s.doc_id, e.i, not (e.k = 'error' and n = 0),
            case when e.k = 'error' and n < 2 then 'letter' when e.k = 'click' then ['letter', 'a4', 'legal', 'tabloid', 'custom'][n + 1] else s.page_size end,
            case when e.k = 'error' and n < 2 then 'none' when e.k = 'view' then ['none', 'narrow', 'normal', 'wide', 'custom'][n + 1] when e.k = 'purchase' then 'custom' else s.margin_preset end,
            case when e.k = 'error' and n < 2 then 0 when e.k = 'view' then [0, 0.25, 0.5, 1, 0.5][n + 1] when e.k = 'purchase' then n / 2 else s.margin_top end::double,
            case when e.k = 'error' and n < 2 then 8.5 when e.k = 'click' then [8.5, 8.27, 8.5, 11, 8.5][n + 1] else s.custom_width end::double,
            case when e.k = 'error' and n < 2 then 1 when e.k = 'signup' then [1, 2, 4, 6, 9][n + 1] else s.pages_per_sheet end::int
        from s join e on e.doc_id = s.doc_id and e.i = s.i + 1)
    select doc_id, page_size, margin_preset, margin_top, custom_width, pages_per_sheet from s where there and i = (select count(*) from e where e.doc_id = s.doc_id)"""


@query("E9", _EDIT_SQL)
def setting_edits(spark, sf):
    """Stored settings after a log of edits, resets and removals."""
    kind, n = c("event_type"), c("event_id") % 5
    pick = lambda when, *vals: F.when(kind == when, F.element_at(F.array(*map(F.lit, vals)), (n + 1).cast("int")))
    edits = fx.table(spark, sf, "events").select(
        F.concat(F.lit("u"), (c("user_id") % 40).cast("string")).alias("doc_id"), "ts", "event_id",
        F.when((kind == "error") & (n == 0), "remove").when((kind == "error") & (n == 1), "reset").otherwise("set").alias("action"),
        pick("click", "letter", "a4", "legal", "tabloid", "custom").alias("page_size"), pick("view", "none", "narrow", "normal", "wide", "custom").alias("margin_preset"),
        F.when(kind == "purchase", n / 2).alias("margin_top"), pick("signup", 1, 2, 4, 6, 9).alias("pages_per_sheet"))
    d = c("doc_id")
    stored = fx.table(spark, sf, "documents").filter((d % 2 == 0) & (d < 40)).select(
        F.concat(F.lit("u"), d.cast("string")).alias("doc_id"),
        F.element_at(F.array(*map(F.lit, ("letter", "a4", "legal", "tabloid", "custom"))), (d % 5 + 1).cast("int")).alias("page_size"),
        F.lit("wide").alias("margin_preset"), F.lit(1.0).alias("margin_top"), F.lit(7.0).alias("custom_width"), F.lit(3).alias("pages_per_sheet"))
    return op.edit_settings(stored, edits).select("doc_id", "page_size", "margin_preset", "margin_top", "custom_width", "pages_per_sheet")


@query("S9", with_tables("ptext", """
    select doc_id, page_number, '--- Page ' || (page_number + 1) || ' ---' || chr(10) || chr(10) || text || chr(10) as value from ptext"""))
def text_records(spark, sf):
    return sinks.text_records(_page_text(spark, sf))


@query("S10", with_tables("page doc", """
    , f as (select doc_id, page_number, case when (doc_id + page_number) % 9 > 0 then '<p>' || width::int || '</p>' end as fragment from page),
    b as (select doc_id, (page_number // 256)::int as part, string_agg(case when fragment is null then '<div class="page error">Error converting page ' || (page_number + 1) || '</div>'
        else '<div class="page" data-page="' || (page_number + 1) || '">' || fragment || '</div>' end, chr(10) order by page_number) as body from f group by 1, 2),
    e as (select *, part = min(part) over (partition by doc_id) as is_first, part = max(part) over (partition by doc_id) as is_last from b)
    select doc_id, part, case when is_first then '<!DOCTYPE html>' || chr(10) || '<html lang="en">' || chr(10) || '<head>' || chr(10) || '<meta charset="UTF-8">' || chr(10) || '<title>doc.' || doc_id || '</title>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) else '' end
        || body || case when is_last then chr(10) || '</body>' || chr(10) || '</html>' else '' end as html from e"""))
def export_html(spark, sf):
    ok = (c("doc_id") + c("page_number")) % 9 > 0
    fragments = fx.pages(spark, sf).select(
        *KEY, F.when(ok, F.concat(F.lit("<p>"), c("width").cast("int").cast("string"), F.lit("</p>"))).alias("fragment"))
    return sinks.export_html(fragments, fx.docs(spark, sf))


@query("S12", with_tables("page", "select doc_id, page_number, width, rotation from page"))
def write_pages(spark, sf):
    """Pages written to bucket folders and read back."""
    import uuid

    from ..plans.settle import shared_dir

    path = f"{shared_dir(spark)}/pages/{uuid.uuid4().hex}"
    sinks.write_pages(fx.pages(spark, sf).select(*KEY, "width", "rotation"), path, buckets=16)
    return spark.read.schema("doc_id bigint, page_number int, width double, rotation int, doc_bucket int").parquet(
        path).drop("doc_bucket")

