"""Page operations."""

from pyspark.sql import functions as F

from ..operators import pages as op
from ..plans import fixtures as fx
from ..plans.oracle import with_tables
from ..plans.settle import settle
from .registry import query

c = F.col
KEY = ["doc_id", "page_number"]

# Every third page by a mixed number is deleted; documents with doc_id % 11 = 0 ask to lose all pages.
_DEL = "(doc_id * 7 + page_number * 5) % 3 = 0 or doc_id % 11 = 0"
_DELETED = f"""
    , want as (select doc_id, page_number from page where {_DEL}),
    refused as (select doc_id from page left join (select *, 1 as hit from want) using (doc_id, page_number) group by 1 having count(hit) = count(*)),
    eff as (select * from want anti join refused using (doc_id)),
    map as (select doc_id, page_number, (row_number() over (partition by doc_id order by page_number) - 1)::int as new_page from page anti join eff using (doc_id, page_number))"""


def _deletions(pages):
    return pages.filter(((c("doc_id") * 7 + c("page_number") * 5) % 3 == 0) | (c("doc_id") % 11 == 0)).select(*KEY)


@query("W3", with_tables("page", _DELETED + """
    select doc_id, new_page as page_number, width, height, rotation from page join map using (doc_id, page_number)"""))
def delete_pages(spark, sf):
    pages = fx.pages(spark, sf)
    return op.renumber(pages, op.deletion_map(pages, _deletions(pages)))


@query("W3", with_tables("page annv", _DELETED + """
    select ann_id, doc_id, new_page as page_number, type from annv join map using (doc_id, page_number)"""))
def annotations_after_delete(spark, sf):
    pages = fx.pages(spark, sf)
    ann = fx.valid_annotations(spark, sf).select("ann_id", *KEY, "type")
    _, kept = op.delete_pages(pages, ann, _deletions(pages))
    return kept


@query("W13", with_tables("page counted", """
    , want as (select doc_id, page_number from page where (doc_id * 7 + page_number * 5) % 3 = 0),
    cur as (select doc_id, page_count, (doc_id * 3 % page_count)::int as ix from counted),
    t as (select cur.doc_id, max(page_number) as mx, count(*) as d, count(*) filter (page_number < ix) as b from want join cur using (doc_id) group by 1)
    select doc_id, (case when d is null then ix when ix >= mx and page_count - d > 0 then greatest(0, ix - b) when page_count - d > 0 and ix >= page_count - d then page_count - d - 1 else ix end)::int as current_page
    from cur left join t using (doc_id)"""))
def adjust_current(spark, sf):
    pages = fx.pages(spark, sf)
    counts = op.page_count(pages)
    current = counts.select("doc_id", (c("doc_id") * 3 % c("page_count")).cast("int").alias("current_page"))
    gone = pages.filter((c("doc_id") * 7 + c("page_number") * 5) % 3 == 0)
    return op.adjust_current(current, gone, counts)


_SOURCE = "(doc_id * 13 + 5) % (select count(*) from documents)"
_INSERTS = f"""
    , req as (select doc_id, (doc_id * 3 % (page_count + 1))::int as ix, {_SOURCE} as source_doc_id, case when doc_id % 2 = 0 then [1, 0, 99, 0] end as lst from counted where doc_id % 5 < 4),
    pick as (select r.doc_id, ix, source_doc_id, (idx - 1)::int as idx, p from (select r.*, list_filter(lst, lambda q: q >= 0 and q < s.page_count) as v from req r join counted s on s.doc_id = r.source_doc_id) r, unnest(v) with ordinality u(p, idx) where lst is not null
        union all select r.doc_id, ix, source_doc_id, s.page_number, s.page_number from req r join page s on s.doc_id = r.source_doc_id where lst is null),
    cnt as (select doc_id, ix, count(*) as n from pick group by 1, 2)"""


def _requests(spark, sf, counts):
    n = fx.table(spark, sf, "documents").agg(F.count(F.lit(1))).scalar()
    listed = F.when(c("doc_id") % 2 == 0, F.array(*map(F.lit, (1, 0, 99, 0))))
    return counts.filter(c("doc_id") % 5 < 4).select(
        "doc_id", (c("doc_id") * 3 % (c("page_count") + 1)).cast("int").alias("at"),
        ((c("doc_id") * 13 + 5) % n).alias("source_doc_id"), listed.alias("source_pages"))


@query("J14 W4", with_tables("page counted", _INSERTS + """
    select doc_id, (case when page_number >= ix then page_number + n else page_number end)::int as page_number, width, height, rotation from page left join cnt using (doc_id)
    union all select pick.doc_id, (ix + idx)::int, width, height, rotation from pick join page s on s.doc_id = source_doc_id and s.page_number = p"""))
def insert_pages(spark, sf):
    pages = fx.pages(spark, sf)
    return op.insert_pages(pages, pages, _requests(spark, sf, op.page_count(pages)))


@query("W4 U4", with_tables("page counted annv", _INSERTS + """
    select ann_id::varchar as ann_id, doc_id, (case when page_number >= ix then page_number + n else page_number end)::int as page_number, type from annv left join cnt using (doc_id)
    union all select a.ann_id || '_copy_7_' || idx, pick.doc_id, (ix + idx)::int, a.type from pick join annv a on a.doc_id = source_doc_id and a.page_number = p"""))
def paste_annotations(spark, sf):
    # Pages and annotations are stored tables in practice; here they are derived, so they are written once.
    pages = settle(fx.pages(spark, sf).select(*KEY))
    ann = settle(fx.valid_annotations(spark, sf).select("ann_id", *KEY, "type"))
    return op.paste_annotations(ann, ann, pages, _requests(spark, sf, op.page_count(pages)), "7")


@query("W7", with_tables("page counted", """
    , req as (select doc_id, (doc_id % (page_count + 2))::int as ix from counted where doc_id % 3 < 2),
    ok as (select doc_id, ix from req join counted using (doc_id) where ix between 0 and page_count)
    select doc_id, (case when page_number >= ix then page_number + 1 else page_number end)::int as page_number, width, height, rotation from page left join ok using (doc_id)
    union all select p.doc_id, ix, width, height, rotation from ok join page p on p.doc_id = ok.doc_id and p.page_number = greatest(ix - 1, 0)"""))
def insert_blank(spark, sf):
    pages = fx.pages(spark, sf)
    req = op.page_count(pages).filter(c("doc_id") % 3 < 2).select(
        "doc_id", (c("doc_id") % (c("page_count") + 2)).cast("int").alias("at"))
    return op.insert_blank(pages, req)


def _ops(a, b):
    return F.struct(a.cast("int").alias("from_index"), b.cast("int").alias("to_index"))


@query("W5", with_tables("page counted", """
    , op as (select doc_id, page_count as n, doc_id * 7 % page_count as f, doc_id * 5 % page_count as t from counted where doc_id % 4 > 0),
    s as (select page.*, f, t, case when page_number > f then page_number - 1 else page_number end as p1 from page left join op using (doc_id))
    select doc_id, (case when f is null then page_number when page_number = f then t when p1 >= t then p1 + 1 else p1 end)::int as page_number, width, height, rotation from s"""))
def reorder_pages(spark, sf):
    pages = fx.pages(spark, sf)
    n = c("page_count")
    req = op.page_count(pages).filter(c("doc_id") % 4 > 0).select(
        "doc_id", F.array(_ops(c("doc_id") * 7 % n, c("doc_id") * 5 % n)).alias("ops"))
    return op.reorder_pages(pages, req)


@query("W6 W5", with_tables("page counted", """
    , d as (select doc_id, page_count as n, doc_id * 5 % page_count as t0 from counted where page_count > 3),
    o as (select doc_id, n, case when t0 > 2 then t0 - 2 else t0 end as t from d),
    s1 as (select p.doc_id, page_number, n, t, case when n is null then page_number when page_number = 0 then least(t, n - 1) else case when page_number - 1 >= least(t, n - 1) then page_number else page_number - 1 end end as p1 from page p left join o using (doc_id)),
    s2 as (select *, least(t + 1, n - 1) as t2, case when p1 > 2 then p1 - 1 else p1 end as q from s1)
    select doc_id, page_number, (case when n is null then page_number when p1 = 2 then t2 when q >= t2 then q + 1 else q end)::int as new_page_number from s2"""))
def drag_pages(spark, sf):
    """Pages 0 and 2 dragged to a target where there is a page beyond them: adjusted moves, then the moves applied."""
    pages = fx.pages(spark, sf)
    req = op.page_count(pages).filter(c("page_count") > 3).select(
        "doc_id", op.drag_to_ops(F.array(F.lit(2), F.lit(0)), c("doc_id") * 5 % c("page_count")).alias("ops"))
    return op.reorder_map(pages, req)


_TURN = """
    , t as (select p.*, case when rotation in (90, 270) then height else width end as w, case when rotation in (90, 270) then width else height end as h, (doc_id % 3 + 1) * 90 as rel from page p where page_number % 2 = 0),
    k as (select a.*, coalesce(rel, 0) as rel, w, h from annv a left join (select doc_id, page_number, rel, w, h from t) using (doc_id, page_number))"""


def _new_rotations(pages):
    return pages.filter(c("page_number") % 2 == 0).select(
        *KEY, ((c("rotation") + (c("doc_id") % 3 + 1) * 90) % 360).cast("int").alias("new_rotation"))


@query("P13", with_tables("page annv", _TURN + """
    select ann_id, doc_id, page_number, case rel when 90 then y when 270 then h - y - height when 180 then w - x - width else x end as x,
        case rel when 90 then w - x when 270 then x when 180 then h - y - height else y end as y,
        case when rel in (90, 270) then height else width end as width, case when rel in (90, 270) then width else height end as height,
        case rel when 90 then h - y when 270 then y when 180 then w - x else x end as qx, case rel when 90 then x when 270 then w - x when 180 then h - y else y end as qy from k"""))
def rotate_annotations(spark, sf):
    from ..functions.geometry import rect_quad

    pages = fx.pages(spark, sf)
    ann = fx.valid_annotations(spark, sf).select(
        "ann_id", *KEY, "x", "y", "width", "height",
        F.array(rect_quad(c("x"), c("y"), c("width"), c("height"))).alias("quads"))
    turned = op.rotate_annotations(ann, pages, _new_rotations(pages))
    return turned.select("ann_id", *KEY, "x", "y", "width", "height", c("quads")[0][0].alias("qx"), c("quads")[0][1].alias("qy"))


@query("P13", with_tables("page annv", _TURN + """
    select ann_id, doc_id, page_number, 'geometric' as mode, case rel when 90 then h - y - height when 270 then y when 180 then w - x - width else x end as x,
        case rel when 90 then x when 270 then w - x - width when 180 then h - y - height else y end as y,
        case when rel in (90, 270) then height else width end as width, case when rel in (90, 270) then width else height end as height from k"""))
def rotate_annotations_geometric(spark, sf):
    pages = fx.pages(spark, sf)
    ann = fx.valid_annotations(spark, sf).select("ann_id", *KEY, "x", "y", "width", "height")
    return op.rotate_annotations(ann, pages, _new_rotations(pages), "geometric").withColumn("mode", F.lit("geometric"))


@query("P11 P12", with_tables("page", """
    , k as (select *, (doc_id % 5) * 90 - 90 as deg from page),
    n as (select *, (((rotation + deg) % 360 + 360) % 360)::int as r from k)
    select doc_id, page_number, case when abs(r - rotation) % 180 = 90 then height else width end as width, case when abs(r - rotation) % 180 = 90 then width else height end as height, r as rotation from n"""))
def rotate_pages(spark, sf):
    pages = fx.pages(spark, sf)
    return op.rotate_pages(pages, pages.select(*KEY, ((c("doc_id") % 5) * 90 - 90).alias("degrees")))


@query("P18", with_tables("page", """
    select doc_id, page_number, case when doc_id % 3 = 0 and page_number = 1 then 300 when doc_id % 2 = 0 then 500 else width end::double as width,
        case when doc_id % 3 = 0 and page_number = 1 then 400 when doc_id % 2 = 0 then 600 else height end::double as height, rotation from page"""))
def resize_pages(spark, sf):
    pages = fx.pages(spark, sf)
    docs = op.page_count(pages)
    none = F.lit(None).cast("int")
    spec = docs.filter(c("doc_id") % 3 == 0).select(
        "doc_id", F.lit(1).alias("page_number"), F.lit(300.0).alias("width"), F.lit(400.0).alias("height")
    ).unionByName(docs.filter(c("doc_id") % 2 == 0).select(
        "doc_id", none.alias("page_number"), F.lit(500.0).alias("width"), F.lit(600.0).alias("height")))
    return op.resize_pages(pages, spec)


_OFFS = """
    , o as (select doc_id, page_number, coalesce(sum(height * 1.5::double + 24) over (partition by doc_id order by page_number rows between unbounded preceding and 1 preceding), 0)::double as top, height * 1.5::double as h from page)"""


@query("W9", with_tables("page", _OFFS + " select doc_id, page_number, top, top + h as bottom from o"))
def page_offsets(spark, sf):
    return op.page_offsets(fx.pages(spark, sf), 1.5)


@query("A10", with_tables("page", "select doc_id, sum(height * 1.5::double) + (count(*) - 1) * 24::double as height from page group by 1"))
def layout_height(spark, sf):
    return op.layout_height(fx.pages(spark, sf), 1.5)


@query("A11", with_tables("page", "select doc_id, count(*)::int as page_count from page group by 1"))
def page_count(spark, sf):
    return op.page_count(fx.pages(spark, sf))


@query("W10", with_tables("page annv", _OFFS + """
    , v as (select ann_id as view_id, doc_id, y * 4 - 50 as vt, y * 4 + 750 as vb from annv),
    n as (select doc_id, count(*) as n from page group by 1),
    f as (select view_id, min(page_number) filter (top + h >= vt) as a, max(page_number) filter (top <= vb) as b from v join o using (doc_id) group by 1)
    select view_id, doc_id, greatest(0, coalesce(a - 2, 0))::int as first, least(n - 1, coalesce(b + 2, n - 1))::int as last from v join n using (doc_id) left join f using (view_id)"""))
def visible_pages(spark, sf):
    pages = fx.pages(spark, sf)
    views = fx.valid_annotations(spark, sf).select(
        c("ann_id").alias("view_id"), "doc_id", (c("y") * 4 - 50).alias("view_top"), (c("y") * 4 + 750).alias("view_bottom"))
    return op.visible_pages(op.page_offsets(pages, 1.5), views)


_RANGES = ["1-5, 8, 11-13", "-3", "4-", "9-2", "x, 2", "", "3, 3,1-2", "0-2,99, 5x", "2-x", " 7 - 9 "]
_RANGE_SQL = "['" + "', '".join(_RANGES) + f"'][doc_id % {len(_RANGES)} + 1]"
_EXPANDED = f"""
    , tok as (select doc_id, page_count as n, trim(tk) as tk from (select *, {_RANGE_SQL} as r from counted), unnest(string_split(r, ',')) u(tk)),
    num as (select *, nullif(try_cast(nullif(regexp_extract(string_split(tk, '-')[1], '^\\s*\\+?(\\d+)', 1), '') as bigint), 0) as a, nullif(try_cast(nullif(regexp_extract(string_split(tk, '-')[2], '^\\s*\\+?(\\d+)', 1), '') as bigint), 0) as b from tok),
    lim as (select doc_id, n, case when contains(tk, '-') then greatest(1, coalesce(a, 1)) else a end as lo, case when contains(tk, '-') then least(n, coalesce(b, n)) else case when a <= n then a end end as hi from num),
    rng as (select distinct doc_id, (p - 1)::int as page_number from lim, unnest(range(lo, hi + 1)) u(p) where lo <= hi)"""


def _settings(spark, sf, counts):
    pick = F.element_at(F.array(*map(F.lit, _RANGES)), (c("doc_id") % len(_RANGES) + 1).cast("int"))
    per = F.element_at(F.array(*map(F.lit, (1, 2, 4, 6, 9, 16))), (c("doc_id") % 6 + 1).cast("int"))
    return counts.select("doc_id", "page_count", pick.alias("custom_range"), per.alias("pages_per_sheet"))


@query("P40 U2", with_tables("counted", _EXPANDED + " select * from rng"))
def expand_page_range(spark, sf):
    return op.expand_page_range(_settings(spark, sf, op.page_count(fx.pages(spark, sf))))


_PER = "[1, 2, 4, 6, 9, 16][doc_id % 6 + 1]"


@query("W8", with_tables("page", f"""
    , i as (select doc_id, page_number, row_number() over (partition by doc_id order by page_number) - 1 as i, {_PER} as k from page),
    n as (select doc_id, count(*) as n, {_PER} as k from page group by 1),
    a as (select * from i union all select doc_id, null, j, k from n, unnest(range(n, (ceil(n / k::double) * k)::bigint)) u(j)),
    g as (select *, (i % k)::int as slot, case k when 1 then 1 when 9 then 3 when 16 then 4 else 2 end as cols from a)
    select doc_id, page_number, (i // k)::int as sheet, slot, (slot // cols)::int as row, (slot % cols)::int as col from g"""))
def nup_layout(spark, sf):
    pages = fx.pages(spark, sf)
    return op.nup_layout(pages, _settings(spark, sf, op.page_count(pages)))


@query("A9", with_tables("counted", _EXPANDED + f"""
    , n as (select doc_id, count(*) as pages from rng group by 1)
    select doc_id, pages, ceil(pages / {_PER}::double)::bigint as sheets from n"""))
def sheets_needed(spark, sf):
    settings = _settings(spark, sf, op.page_count(fx.pages(spark, sf)))
    return op.sheets_needed(op.expand_page_range(settings), settings)


@query("J10", with_tables("page annv", """
    , k as (select doc_id, page_number from page where (doc_id + page_number) % 3 = 0),
    a as (select doc_id, page_number, ord // 1024 as part, string_agg(ann_id::varchar || ':' || type, ',' order by ord) as annotations from annv semi join k using (doc_id, page_number) group by 1, 2, 3)
    select doc_id, page_number, part, annotations from k left join a using (doc_id, page_number)"""))
def copy_pages(spark, sf):
    picked = fx.pages(spark, sf).filter((c("doc_id") + c("page_number")) % 3 == 0)
    ann = fx.valid_annotations(spark, sf).select("ann_id", *KEY, "ord", "type")
    label = lambda a: F.concat(a["ann_id"].cast("string"), F.lit(":"), a["type"])
    return op.copy_pages(ann, picked).withColumn(
        "annotations", F.when(c("annotations").isNotNull(), F.array_join(F.transform("annotations", label), ",")))


@query("S13", with_tables("page annv", """
    , k as (select doc_id, page_number from page where (doc_id + page_number) % 4 = 0)
    select ann_id, doc_id, page_number, type from annv semi join k using (doc_id, page_number) where type in ('text', 'highlight', 'callout', 'image', 'draw', 'shape')"""))
def extract_pages(spark, sf):
    pages = fx.pages(spark, sf)
    keys = pages.filter((c("doc_id") + c("page_number")) % 4 == 0)
    _, ann = op.extract_pages(pages, fx.valid_annotations(spark, sf), keys)
    return ann.select("ann_id", *KEY, "type")


@query("J12", with_tables("ann counted", """
    select ann_id, doc_id, page_number, type from ann join counted using (doc_id) where type = 'stamp' and page_number >= 0 and page_number < page_count"""))
def valid_page_refs(spark, sf):
    stamps = fx.annotations(spark, sf).filter(c("type") == "stamp").select("ann_id", *KEY, "type")
    return op.valid_page_refs(stamps, op.page_count(fx.pages(spark, sf)))


@query("J9", with_tables("ann", """
    , d as (select distinct doc_id from documents where doc_id % 3 > 0) select ann_id, doc_id from ann anti join d using (doc_id)"""))
def orphans(spark, sf):
    left = fx.table(spark, sf, "documents").filter(c("doc_id") % 3 > 0)
    return op.orphans(fx.annotations(spark, sf).select("ann_id", "doc_id"), left)


@query("U3", with_tables("annv", "select doc_id, page_number from annv group by 1, 2 having count(*) % 2 = 1"))
def toggle_selection(spark, sf):
    return op.toggle_selection(fx.valid_annotations(spark, sf))


@query("U5", with_tables("page annv", """
    select ann_id, doc_id, page_number from annv anti join (select doc_id, page_number from page where page_number % 2 = 1) using (doc_id, page_number)"""))
def without_pages(spark, sf):
    odd = fx.pages(spark, sf).filter(c("page_number") % 2 == 1)
    return op.without(fx.valid_annotations(spark, sf).select("ann_id", *KEY), odd, KEY)


@query("S3", """select doc_id, (doc_id % 7)::int as page_number, (612 + doc_id % 4)::double as width, (792 + doc_id % 9)::double as height,
    ((((doc_id * 90 - 450) % 360) + 360) % 360)::int as rotation from documents""")
def page_metadata(spark, sf):
    from ..sources.documents import page_metadata as source

    d = c("doc_id")
    bounds = F.array((d % 4 * 0 + 10), (d * 0 + 20), d % 4 + 622, d % 9 + 812).cast("array<double>")
    return source(fx.table(spark, sf, "documents").select(
        "doc_id", (d % 7).cast("int").alias("page_number"), bounds.alias("bounds"), (d * 90 - 450).cast("int").alias("rotation")))
