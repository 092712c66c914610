"""Scalar functions over every annotation, page, span or event."""

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import fields, paths, values
from ..plans import fixtures as fx
from ..plans.oracle import with_tables
from .registry import query

c = F.col


@query("P1", with_tables("annv page", """
    select ann_id, x as x0, height_p - (y + height) as y0, x + width as x1, height_p - y as y1
    from annv join (select doc_id, page_number, height as height_p from page) using (doc_id, page_number)"""))
def flip_bbox(spark, sf):
    a = fx.valid_annotations(spark, sf).withColumn("ph", fx.page_height(c("doc_id")))
    return a.select("ann_id", g.flip_bbox(c("x"), c("y"), c("x") + c("width"), c("y") + c("height"), c("ph")).alias("b")
                    ).select("ann_id", "b.*")


@query("P2", with_tables("ann", """
    select ann_id, x as x0, coalesce(case when ann_id % 5 > 0 then 842::double end, 792::double) - (y + height) as y0,
        x + width as x1, coalesce(case when ann_id % 5 > 0 then 842::double end, 792::double) - y as y1 from ann"""))
def xywh_to_bbox(spark, sf):
    h = F.when(c("ann_id") % 5 > 0, F.lit(842.0))
    return fx.annotations(spark, sf).select(
        "ann_id", g.xywh_to_bbox(c("x"), c("y"), c("width"), c("height"), h).alias("b")).select("ann_id", "b.*")


@query("P3", with_tables("ann", """
    select ann_id, x as x0, y as y0, x + length(content) * coalesce(nullif(size, 0), 12::double) * 0.6::double as x1,
        y + coalesce(nullif(size, 0), 12::double) as y1
    from (select *, case ann_id % 3 when 0 then 0::double when 1 then 9.5::double end as size from ann)"""))
def estimate_bbox(spark, sf):
    size = F.when(c("ann_id") % 3 == 0, F.lit(0.0)).when(c("ann_id") % 3 == 1, F.lit(9.5))
    return fx.annotations(spark, sf).select(
        "ann_id", g.estimate_bbox(c("content"), c("x"), c("y"), size).alias("b")).select("ann_id", "b.*")


@query("P4", with_tables("span", """
    , ch as (select doc_id, page_number, text[i + 1] as t,
            case when length(text) = 1 then x0 else x0 + i * ((x1 - x0) / length(text)) end as x0,
            case when length(text) = 1 then x1 else x0 + (i + 1) * ((x1 - x0) / length(text)) end as x1
        from span, unnest(range(length(text))) u(i))
    select doc_id, page_number, count(*) as n_chars, min(x0) as x0, max(x1) as x1, max(t) as last_char,
        sum(floor(x0 * 10)::bigint)::bigint as x_sum from ch group by 1, 2"""))
def explode_characters(spark, sf):
    from ..operators.selection import explode_characters as op

    # The last character goes by its code point, which orders as the text does: a string in the buffer would sort every
    # character by page before it is counted.
    per_page = op(fx.spans(spark, sf)).groupBy("doc_id", "page_number").agg(
        F.count(F.lit(1)).alias("n_chars"), F.min("x0").alias("x0"), F.max("x1").alias("x1"),
        F.max(F.ascii("text")).alias("_code"), F.sum(F.floor(c("x0") * 10)).alias("x_sum"))
    last = F.decode(F.unhex(F.lpad(F.hex(c("_code")), 8, "0")), "UTF-32")
    return per_page.select("doc_id", "page_number", "n_chars", "x0", "x1", last.alias("last_char"), "x_sum")


_DRAG = """(select event_id, (event_id * 37 % 400)::double as sx, (event_id * 53 % 700)::double as sy,
    (event_id * 91 % 400)::double as ex, (event_id * 29 % 700)::double as ey from events)"""


def _drags(spark, sf):
    e = c("event_id")
    part = lambda k, m: (e * k % m).cast("double")
    return fx.table(spark, sf, "events").select(
        "event_id", part(37, 400).alias("sx"), part(53, 700).alias("sy"), part(91, 400).alias("ex"),
        part(29, 700).alias("ey"))


_D = ("sx", "sy", "ex", "ey")


@query("P5", f"""select event_id, least(sx, ex) as x, least(sy, ey) as y, greatest(sx, ex) - least(sx, ex) as width,
    greatest(sy, ey) - least(sy, ey) as height from {_DRAG}""")
def normalize_rect(spark, sf):
    return _drags(spark, sf).select("event_id", g.normalize_rect(*map(c, _D)).alias("r")).select("event_id", "r.*")


@query("P6", with_tables("ann", """
    select ann_id, case when y - 20 >= y - 20 + h then 'flipped' when y - 20 < 0 or y - 20 + h > 640 then 'out_of_bounds'
        else 'ok' end as verdict from (select *, case when ann_id % 9 = 0 then -height else height end as h from ann)"""))
def validate_rect(spark, sf):
    h = F.when(c("ann_id") % 9 == 0, -c("height")).otherwise(c("height"))
    return fx.annotations(spark, sf).select(
        "ann_id", g.validate_rect(c("y") - 20, h, F.lit(640.0)).alias("verdict"))


@query("P7", with_tables("ann", """
    , r as (select ann_id, x - 60 as x, y - 30 as y, coalesce(nullif(case when ann_id % 4 = 0 then 0 else width end, 0), 100) as w,
        coalesce(nullif(case ann_id % 5 when 0 then null when 1 then -height else height end, 0), 50) as h from ann),
    k as (select ann_id, greatest(0, least(x, 300)) as x0, greatest(0, least(y, 500)) as a,
        greatest(0, least(x + w, 300)) as x1, greatest(0, least(y + h, 500)) as b from r)
    select ann_id, x0::double as x0, least(a, b)::double as y0, x1::double as x1, greatest(a, b)::double as y1 from k"""))
def clamp_rect(spark, sf):
    w = F.when(c("ann_id") % 4 == 0, F.lit(0.0)).otherwise(c("width"))
    h = F.when(c("ann_id") % 5 == 0, F.lit(None).cast("double")).when(c("ann_id") % 5 == 1, -c("height")).otherwise(c("height"))
    return fx.annotations(spark, sf).select(
        "ann_id", g.clamp_rect(c("x") - 60, c("y") - 30, w, h, F.lit(300.0), F.lit(500.0)).alias("r")
    ).select("ann_id", "r.*")


@query("P8", with_tables("ann", """
    , k as (select *, width / 4 as w, height / 2 as h, case ann_id % 4 when 0 then 'text' when 1 then 'dropdown' when 2 then 'date'
        else 'checkbox' end as ft, case type when 'stamp' then 'callout' when 'highlight' then 'shape' else type end as kind from ann)
    select ann_id, kind, w, h from k where case kind
        when 'redact' then w > 10 and h > 10 when 'callout' then w > 20 and h > 20 when 'shape' then w >= 10 or h >= 10
        when 'formField' then case when ft = 'checkbox' then w >= 20 and h >= 20 else true end
        else true end"""))
def filter_min_size(spark, sf):
    k = c("ann_id") % 4
    ft = F.when(k == 0, "text").when(k == 1, "dropdown").when(k == 2, "date").otherwise("checkbox")
    kind = F.when(c("type") == "stamp", "callout").when(c("type") == "highlight", "shape").otherwise(c("type"))
    a = fx.annotations(spark, sf).select(
        "ann_id", kind.alias("kind"), (c("width") / 4).alias("w"), (c("height") / 2).alias("h"), ft.alias("ft"))
    return a.filter(g.large_enough(c("kind"), c("w"), c("h"), c("ft"))).drop("ft")


def _quads(spark, sf):
    """Two quads per annotation; every eleventh list holds a broken one."""
    a = fx.annotations(spark, sf)
    q = g.rect_quad(c("x"), c("y"), c("width"), c("height"))
    q2 = g.rect_quad(c("x") + 5, c("y") - 14, c("width") * 2, c("height"))
    bad = F.array(c("x"), c("y"))
    return a.withColumn("quads", F.when(c("ann_id") % 11 == 0, F.array(q, bad)).when(
        c("ann_id") % 13 == 0, F.array(bad)).otherwise(F.array(q, q2)))


@query("P9", with_tables("ann", """
    select ann_id, x as x0, case when ann_id % 11 = 0 then y else y - 14 end as y0,
        case when ann_id % 11 = 0 then x + width else greatest(x + width, x + 5 + width * 2) end as x1,
        case when ann_id % 11 = 0 then y + height else greatest(y + height, y - 14 + height) end as y1
    from ann where ann_id % 11 = 0 or ann_id % 13 <> 0"""))
def quads_bbox(spark, sf):
    return _quads(spark, sf).select("ann_id", g.quads_bbox(c("quads")).alias("b")).filter(
        c("b").isNotNull()).select("ann_id", "b.*")


@query("P10", with_tables("ann", """
    , q as (select ann_id, 0 as quad_index, x, y, width as w, height as h, ann_id % 11 <> 0 and ann_id % 13 = 0 as bad from ann
        union all select ann_id, 1, x + 5, y - 14, width * 2, height, ann_id % 11 = 0 from ann
            where ann_id % 11 = 0 or ann_id % 13 <> 0)
    select ann_id, quad_index, case when bad then 0 else x end::double as qx0, case when bad then 0 else 792 - y end::double as qy0,
        case when bad then 0 else x + w end::double as qx2, case when bad then 0 else 792 - (y + h) end::double as qy2 from q"""))
def flip_quads(spark, sf):
    return _quads(spark, sf).select(
        "ann_id", F.posexplode(g.flip_quads(c("quads"), F.lit(792.0))).alias("quad_index", "q")
    ).select("ann_id", "quad_index", c("q")[0].alias("qx0"), c("q")[1].alias("qy0"), c("q")[4].alias("qx2"), c("q")[5].alias("qy2"))


@query("P11", """
    , k as (select event_id, (event_id % 5) * 90 - 90 as cur, (event_id * 7) % 800 - 400 as deg from events),
    t as (select event_id, (((((cur % 360) + 360) % 360) + deg) % 360 + 360) % 360 as total from k)
    select event_id, ((floor(total / 90.0::double + 0.5::double) * 90)::int % 360)::int as rotation from t""".replace(
    "\n    , k", "with k", 1))
def add_rotation(spark, sf):
    e = c("event_id")
    return fx.table(spark, sf, "events").select(
        "event_id", g.add_rotation((e % 5) * 90 - 90, (e * 7) % 800 - 400).alias("rotation"))


@query("P12", with_tables("page", """
    select doc_id, page_number, case when rotation in (90, 270) then height else width end as mb_width,
        case when rotation in (90, 270) then width else height end as mb_height from page"""))
def mediabox(spark, sf):
    return fx.pages(spark, sf).select(
        "doc_id", "page_number", g.mediabox(c("width"), c("height"), c("rotation")).alias("m")
    ).select("doc_id", "page_number", c("m.width").alias("mb_width"), c("m.height").alias("mb_height"))


@query("P14", with_tables("annv page", """
    , k as (select ann_id, a.x, a.y, p.width as pw, p.height as ph, p.rotation as rot from annv a
        join page p using (doc_id, page_number))
    select ann_id, x / 2::double as pdf_x, (case when rot in (90, 270) then pw else ph end) - y / 2::double as pdf_y,
        x * 2::double as canvas_x, ((case when rot in (90, 270) or (y > ph and pw > ph) then pw else ph end) - y) * 2::double as canvas_y
    from k"""))
def canvas_coordinates(spark, sf):
    p = fx.pages(spark, sf).select("doc_id", "page_number", c("width").alias("pw"), c("height").alias("ph"), "rotation")
    a = fx.valid_annotations(spark, sf).join(p, ["doc_id", "page_number"])
    size = (c("pw"), c("ph"), c("rotation"))
    return a.select(
        "ann_id", g.canvas_to_pdf(c("x"), c("y"), *size).alias("p"), g.pdf_to_canvas(c("x"), c("y"), *size).alias("v")
    ).select("ann_id", c("p.x").alias("pdf_x"), c("p.y").alias("pdf_y"), c("v.x").alias("canvas_x"), c("v.y").alias("canvas_y"))


@query("P15", with_tables("page", """
    select doc_id, page_number, width / 72::double as w_in, width / 28.346::double as w_cm,
        (width / 72::double) * 72::double as back_in, (width / 28.346::double) * 28.346::double as back_cm from page"""))
def unit_conversion(spark, sf):
    w = c("width")
    return fx.pages(spark, sf).select(
        "doc_id", "page_number", g.from_points(w, "in").alias("w_in"), g.from_points(w, "cm").alias("w_cm"),
        g.to_points(g.from_points(w, "in"), "in").alias("back_in"), g.to_points(g.from_points(w, "cm"), "cm").alias("back_cm"))


@query("P16 P17", with_tables("page", """
    , k as (select doc_id, page_number, width + (doc_id % 7) * 1.5::double as w, height + (doc_id % 3) * 2.5::double as h from page)
    select doc_id, page_number, case
        when abs(w / 72 - 612 / 72::double) < 0.1::double and abs(h / 72 - 792 / 72::double) < 0.1::double then 'letter'
        when abs(w / 72 - 612 / 72::double) < 0.1::double and abs(h / 72 - 1008 / 72::double) < 0.1::double then 'legal'
        when abs(w / 72 - 595 / 72::double) < 0.1::double and abs(h / 72 - 842 / 72::double) < 0.1::double then 'a4'
        when abs(w / 72 - 792 / 72::double) < 0.1::double and abs(h / 72 - 1224 / 72::double) < 0.1::double then 'tabloid'
        else 'custom' end as preset, case when w < h then 'portrait' else 'landscape' end as orientation, w > h as is_landscape
    from k"""))
def page_size_class(spark, sf):
    w, h = c("width") + (c("doc_id") % 7) * F.lit(1.5), c("height") + (c("doc_id") % 3) * F.lit(2.5)
    return fx.pages(spark, sf).select(
        "doc_id", "page_number", g.classify_page_size(w, h).alias("preset"), g.orientation(w, h).alias("orientation"),
        g.is_landscape(w, h).alias("is_landscape"))


_HEX = "printf('#%02x%02x%02x', event_id * 7 % 256, event_id * 13 % 256, event_id * 29 % 256)"


@query("P19", f"""with k as (select event_id, {_HEX} as color from events)
    select event_id, color as back, ('0x' || substr(color, 2, 2))::int / 255::double as r,
        ('0x' || substr(color, 4, 2))::int / 255::double as g, ('0x' || substr(color, 6, 2))::int / 255::double as b from k""")
def hex_rgb(spark, sf):
    e = c("event_id")
    color = F.format_string("#%02x%02x%02x", e * 7 % 256, e * 13 % 256, e * 29 % 256)
    return fx.table(spark, sf, "events").select("event_id", values.hex_to_rgb(color).alias("c")).select(
        "event_id", "c.*", values.rgb_to_hex(c("c.r"), c("c.g"), c("c.b")).alias("back"))


@query("P45", f"""with k as (select event_id, event_id * 7 % 256 as r, event_id * 13 % 256 as g, event_id * 29 % 256 as b from events)
    select event_id, case event_id % 4 when 3 then 0 else r end / 255::double as r, case event_id % 4 when 3 then 0 else g end / 255::double as g,
        case event_id % 4 when 3 then 0 else b end / 255::double as b from k""")
def parse_color(spark, sf):
    e = c("event_id")
    rgb = (e * 7 % 256, e * 13 % 256, e * 29 % 256)
    color = F.when(e % 4 == 0, F.format_string("#%02x%02x%02x", *rgb)).when(
        e % 4 == 1, F.format_string("rgb(%d, %d,%d)", *rgb)).when(
        e % 4 == 2, F.format_string("rgba(%d,%d,%d,0.5)", *rgb)).otherwise("red")
    return fx.table(spark, sf, "events").select("event_id", values.parse_color(color).alias("c")).select("event_id", "c.*")


@query("P20", r"""select page_id, replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<br\s*/?>', chr(10), 'gi'),
    '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"') as text from pages""")
def html_to_text(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", values.html_to_text(c("html")).alias("text"))


@query("P25", """select event_id, greatest(25, least(value * 10, 400))::double as print_scale, greatest(0.1::double, least(value / 50, 2::double)) as stamp_size,
    greatest(0.25::double, least(value / 20, 5::double)) as zoom, greatest(1, least(value, 50))::double as draw_stroke,
    greatest(5, least(value, 50))::double as highlight_stroke, greatest(1, least(value, 20))::double as shape_stroke,
    greatest(0, least(value / 100, 1))::double as opacity, greatest(5, least(value, 30))::double as arrow_head from events""")
def clamp_settings(spark, sf):
    v = c("value")
    given = {"print_scale": v * 10, "stamp_size": v / 50, "zoom": v / 20, "opacity": v / 100}
    return fx.table(spark, sf, "events").select(
        "event_id", *[g.clamp_setting(given.get(name, v), name).alias(name) for name in g.CLAMPS])


def _paths(spark, sf, n=24):
    """A path per event, from integer arithmetic."""
    e = c("event_id")
    i = lambda k: k.cast("long")
    pts = F.transform(
        F.sequence(F.lit(0), (e % n).cast("int")),
        lambda k: g.point(((e * 3 + i(k) * 17) % 500).cast("double"), ((e * 5 + i(k) * i(k) * 7) % 700).cast("double")))
    # Dealt out while an event is one number: few files hold many events, and a path costs far more than its event.
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return fx.table(spark, sf, "events").select("event_id").repartition(n_tasks, "event_id").select("event_id", pts.alias("path"))


_PATH = """(select event_id, k, ((event_id * 3 + k * 17) % 500)::double as px, ((event_id * 5 + k * k * 7) % 700)::double as py
    from events, unnest(range(event_id % {n} + 1)) t(k))"""


@query("P26", f"select event_id, min(px) as x0, min(py) as y0, max(px) as x1, max(py) as y1 from {_PATH.format(n=24)} group by 1")
def path_bbox(spark, sf):
    return _paths(spark, sf).select("event_id", paths.path_bbox(c("path")).alias("b")).select("event_id", "b.*")


@query("P27", f"""with p as {_PATH.format(n=6)}, s as (select a.event_id, a.k, a.px as ax, a.py as ay, b.px as bx, b.py as by_
        from p a join p b on a.event_id = b.event_id and b.k = a.k + 1),
    d as (select *, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) as len from s)
    select event_id, k::int as quad_index, round(case when len = 0 then ax - 4 else ax + -(by_ - ay) / len * 4 end, 6) as qx0,
        round(case when len = 0 then ay - 4 else ay + (bx - ax) / len * 4 end, 6) as qy0,
        round(case when len = 0 then ax + 4 else bx - -(by_ - ay) / len * 4 end, 6) as qx2,
        round(case when len = 0 then ay + 4 else by_ - (bx - ax) / len * 4 end, 6) as qy2 from d
    union all select event_id, 0::int, px - 4, py - 4, px + 4, py + 4 from p where event_id % 6 = 0""")
def path_to_quads(spark, sf):
    q = _paths(spark, sf, 6).select(
        "event_id", F.posexplode(paths.path_to_quads(c("path"), F.lit(8.0))).alias("quad_index", "q"))
    return q.select("event_id", "quad_index", *[F.round(c("q")[i], 6).alias(n) for i, n in
                                                [(0, "qx0"), (1, "qy0"), (4, "qx2"), (5, "qy2")]])


@query("P28", f"""with p as {_PATH.format(n=5)}, n as (select event_id, count(*) as n from p group by 1 having count(*) >= 3),
    s as (select p.event_id, p.k, t.s, p0.px as x0, p.px as x1, p2.px as x2, p3.px as x3, p0.py as y0, p.py as y1, p2.py as y2, p3.py as y3, t.s / 10::double as u
        from n join p on p.event_id = n.event_id and p.k < n.n - 1 join p p0 on p0.event_id = p.event_id and p0.k = greatest(p.k - 1, 0)
        join p p2 on p2.event_id = p.event_id and p2.k = p.k + 1 join p p3 on p3.event_id = p.event_id and p3.k = least(p.k + 2, n.n - 1),
        unnest(range(1, 11)) t(s))
    select event_id, (k * 10 + s)::int as i, 0.5::double * ((2 * x1) + (-x0 + x2) * u + (2 * x0 - 5 * x1 + 4 * x2 - x3) * (u * u) + (-x0 + 3 * x1 - 3 * x2 + x3) * (u * u * u)) as x,
        0.5::double * ((2 * y1) + (-y0 + y2) * u + (2 * y0 - 5 * y1 + 4 * y2 - y3) * (u * u) + (-y0 + 3 * y1 - 3 * y2 + y3) * (u * u * u)) as y from s
    union all select p.event_id, 0::int, px, py from p join n using (event_id) where k = 0
    union all select p.event_id, ((n - 1) * 10 + 1)::int, px, py from p join n using (event_id) where k = n - 1
    union all select event_id, k::int, px, py from p where event_id not in (select event_id from n)""")
def smooth_path(spark, sf):
    return _paths(spark, sf, 5).select("event_id", F.posexplode(paths.smooth_path(c("path"))).alias("i", "p")).select(
        "event_id", "i", c("p.x").alias("x"), c("p.y").alias("y"))


# Segments of a path, cut at the farthest point while that is beyond the tolerance; a cut makes two of one.
@query("P29", f"""with recursive pts as (select event_id, list(px order by k) as xs, list(py order by k) as ys, count(*)::int as n from {_PATH.format(n=160)} group by 1),
    seg(event_id, lo, hi) as (select event_id, 1, n from pts where n > 100
        union all select event_id, case side when 0 then lo else lo + spot end, case side when 0 then lo + spot else hi end from (
            select *, list_position(ds, far)::int as spot from (select *, list_max(ds) as far from (
                select s.event_id, lo, hi, list_transform(list_transform(list_transform(range(lo + 1, hi), lambda i: {{'x': xs[i] - xs[lo], 'y': ys[i] - ys[lo]}}),
                    lambda d: {{'x': d.x, 'y': d.y, 'a': case when q > 0 then greatest(0, least(1, (d.x * rx + d.y * ry) / q)) else 0 end}}),
                    lambda d: sqrt((d.x - d.a * rx) * (d.x - d.a * rx) + (d.y - d.a * ry) * (d.y - d.a * ry))) as ds
                from (select seg.event_id, lo, hi, xs, ys, xs[hi] - xs[lo] as rx, ys[hi] - ys[lo] as ry, (xs[hi] - xs[lo]) * (xs[hi] - xs[lo]) + (ys[hi] - ys[lo]) * (ys[hi] - ys[lo]) as q
                    from seg join pts on pts.event_id = seg.event_id where hi - lo > 1) s)) where far > 30), (values (0), (1)) t(side)),
    k as (select event_id, (2 + (count(*) - 1) // 2)::int as kept from seg group by 1)
    select event_id, n as n_points, coalesce(kept, n)::int as n_kept from pts left join k using (event_id)""")
def simplify_path(spark, sf):
    return _paths(spark, sf, 160).select("event_id", F.size("path").alias("n_points"),
                                         paths.simplify_path(c("path"), 30.0, 100).alias("p")).select(
        "event_id", "n_points", F.size("p").alias("n_kept"))


@query("P30", f"""with k as (select *, abs(ex - sx) as dx, abs(ey - sy) as dy, atan2(abs(ey - sy), abs(ex - sx)) * (180 / pi()) as ang from {_DRAG}),
    l as (select *, case when abs(ang - 45) < 10 then 'diagonal' when dx > dy * 1.1::double then 'horizontal' when dy > dx * 1.1::double then 'vertical'
        when dx > dy then 'horizontal' else 'vertical' end as lock,
        floor(atan2(ey - sy, ex - sx) / (pi() / 4) + 0.5::double) * (pi() / 4) as snap, sqrt(dx * dx + dy * dy) as len from k)
    select event_id, lock, case lock when 'horizontal' then ex when 'vertical' then sx else sx + ((ex - sx) + (ey - sy)) / 2 end as lock_x,
        case lock when 'horizontal' then sy when 'vertical' then ey else sy + ((ex - sx) + (ey - sy)) / 2 end as lock_y,
        round(sx + len * cos(snap), 6) + 0.0::double as snap_x, round(sy + len * sin(snap), 6) + 0.0::double as snap_y,
        sx + case when ex > sx then greatest(dx, dy) else -greatest(dx, dy) end as square_x,
        sy + case when ey > sy then greatest(dx, dy) else -greatest(dx, dy) end as square_y from l""")
def drag_constraints(spark, sf):
    p = list(map(c, _D))
    d = _drags(spark, sf).select(
        "event_id", g.lock_direction(*p).alias("lock"), g.locked_end(*p).alias("l"), g.snap_angle(*p).alias("s"),
        g.square_end(*p).alias("q"))
    return d.select(
        "event_id", "lock", c("l.x").alias("lock_x"), c("l.y").alias("lock_y"),
        (F.round("s.x", 6) + F.lit(0.0)).alias("snap_x"), (F.round("s.y", 6) + F.lit(0.0)).alias("snap_y"),
        c("q.x").alias("square_x"), c("q.y").alias("square_y"))


@query("P31", f"""select event_id, k::int as i, px as x, py as y from {_PATH.format(n=7)}""")
def parse_points(spark, sf):
    p = _paths(spark, sf, 7)
    pair = F.transform("path", lambda q: F.array(q["x"], q["y"]))
    e = c("event_id") % 4
    text = F.when(e == 0, F.to_json(F.flatten(pair))).when(e == 1, F.to_json(pair)).when(
        e == 2, F.to_json(F.array(F.flatten(pair)))).otherwise(F.to_json(F.array(pair)))
    return p.select("event_id", F.posexplode(paths.parse_points(text)).alias("i", "p")).select(
        "event_id", "i", c("p.x").alias("x"), c("p.y").alias("y"))


@query("T5", f"""with p as (select *, row_number() over (partition by event_id order by k desc) as r from {_PATH.format(n=160)})
    select event_id, count(*) as kept, min(k)::bigint as first_kept, sum(px) as sx from p where r <= 100 group by 1""")
def tail_points(spark, sf):
    kept = _paths(spark, sf, 160).select("event_id", F.size("path").alias("n"), paths.tail_points(c("path"), 100).alias("p"))
    return kept.select(
        "event_id", F.size("p").cast("long").alias("kept"), (c("n") - F.size("p")).cast("long").alias("first_kept"),
        F.aggregate("p", F.lit(0.0), lambda a, q: a + q["x"]).alias("sx"))


@query("P33", """with k as (select doc_id, text from documents)
    select doc_id, case doc_id % 4 when 0 then 'png' when 1 then 'jpeg' when 2 then 'jpeg' end as media,
        case when doc_id % 4 < 3 then strlen(text) end::int as n_bytes, case when doc_id % 4 < 3 then md5(text) end as digest from k""")
def decode_data_url(spark, sf):
    d = c("doc_id") % 4
    kind = F.when(d == 0, "data:image/png;base64,").when(d == 1, "data:image/jpeg;base64,").when(
        d == 2, "data:image/jpg;base64,").otherwise("data:image/gif;base64,")
    url = F.concat(kind, F.base64(F.to_binary("text", F.lit("utf-8"))))
    return fx.table(spark, sf, "documents").select("doc_id", values.decode_data_url(url).alias("u")).select(
        "doc_id", c("u.media").alias("media"), F.octet_length("u.data").alias("n_bytes"), F.md5("u.data").alias("digest"))


@query("P34", f"""with k as (select event_id, greatest(50, sx + 20) as w, greatest(50, sy + 10) as h, 200::double as w0, 100::double as h0 from {_DRAG})
    select event_id, (case when abs(w / h - 2) > 0.01::double and not abs(w - w0) > abs(h - h0) then h * 2 else w end)::double as width,
        (case when abs(w / h - 2) > 0.01::double and abs(w - w0) > abs(h - h0) then w / 2 else h end)::double as height from k""")
def fit_aspect(spark, sf):
    return _drags(spark, sf).select("event_id", g.fit_aspect(
        F.lit(200.0), F.lit(100.0), c("sx") + 20, c("sy") + 10, F.lit(2.0)).alias("r")).select("event_id", "r.*")


@query("P35", """with k as (select event_id, ts, (epoch_us(ts) - epoch_us(ts)) // 1000000 + event_id * 977 % 1000000 as s from events),
    m as (select *, s // 60 as mi, s // 3600 as h, s // 86400 as d from k)
    select event_id, case when mi < 1 then 'Just now' when mi < 60 then mi || ' minute' || case when mi > 1 then 's' else '' end || ' ago'
        when h < 24 then h || ' hour' || case when h > 1 then 's' else '' end || ' ago'
        when d < 7 then d || ' day' || case when d > 1 then 's' else '' end || ' ago' else strftime(ts, '%Y-%m-%d') end as label from m""")
def relative_time(spark, sf):
    """Every event, seen from a moment up to eleven days later."""
    now = F.timestamp_micros(F.unix_micros("ts") + c("event_id") * 977 % 1000000 * 1000000)
    return fx.table(spark, sf, "events").select(
        "event_id", values.relative_time(c("ts"), now).alias("label"))


@query("P36", """with k as (select event_id, case event_id % 4 when 0 then event_id % 1500 when 1 then event_id * 777 when 2 then event_id * 900001 else event_id * 99999999 end as n from events)
    select event_id, regexp_replace(printf('%.1f', floor(n / (1024 ** i)::double * 10 + 0.5::double) / 10), '\\.0$', '') || ' ' || ['B', 'KB', 'MB', 'GB'][i + 1] as label
    from (select *, case when n < 1024 then 0 when n < 1048576 then 1 when n < 1073741824 then 2 else 3 end as i from k)""")
def format_bytes(spark, sf):
    e = c("event_id")
    n = F.when(e % 4 == 0, e % 1500).when(e % 4 == 1, e * 777).when(e % 4 == 2, e * 900001).otherwise(e * 99999999)
    return fx.table(spark, sf, "events").select("event_id", values.format_bytes(n).alias("label"))


@query("P42", f"""select event_id, greatest(50, sx / 6::double * 1.5::double)::double as width, greatest(30, sy / 6::double * 1.5::double)::double as height from {_DRAG}""")
def stamp_size(spark, sf):
    return _drags(spark, sf).select(
        "event_id", g.stamp_size(c("sx"), c("sy"), F.lit(1.5)).alias("r")).select("event_id", "r.*")


@query("P43", f"""with k as (select *, event_id % 5 = 0 or (abs(ex2 - sx) < 5 and abs(ey2 - sy) < 5) as click from
        (select *, case when event_id % 3 = 0 then sx + 2 else ex end as ex2, case when event_id % 3 = 0 then sy - 3 else ey end as ey2 from {_DRAG}))
    select event_id, case when click then sx else least(sx, ex2) end as x, case when click then sy else greatest(sy, ey2) end as y,
        case when click then 108 else greatest(50, abs(ex2 - sx)) end::double as width, case when click then 18 else greatest(30, abs(ey2 - sy)) end::double as height from k""")
def textbox_size(spark, sf):
    e = c("event_id")
    none = F.lit(None).cast("double")
    ex = F.when(e % 5 == 0, none).when(e % 3 == 0, c("sx") + 2).otherwise(c("ex"))
    ey = F.when(e % 5 == 0, none).when(e % 3 == 0, c("sy") - 3).otherwise(c("ey"))
    return _drags(spark, sf).select("event_id", g.textbox_size(c("sx"), c("sy"), ex, ey).alias("r")).select("event_id", "r.*")


@query("P44", f"""with k as (select *, (event_id % 24) * 15 * (pi() / 180) as a from {_DRAG})
    select event_id, round(ex + (sx - ex) * cos(a) - (sy - ey) * sin(a), 6) + 0.0::double as x,
        round(ey + (sx - ex) * sin(a) + (sy - ey) * cos(a), 6) + 0.0::double as y from k""")
def rotate_point(spark, sf):
    r = g.rotate_point(c("sx"), c("sy"), c("ex"), c("ey"), (c("event_id") % 24) * 15)
    return _drags(spark, sf).select("event_id", r.alias("r")).select(
        "event_id", (F.round("r.x", 6) + F.lit(0.0)).alias("x"), (F.round("r.y", 6) + F.lit(0.0)).alias("y"))


@query("P46", with_tables("doc", """
    , k as (select doc_id, page_count as n, (doc_id * 7 % 25)::int as p, case when doc_id % 2 = 0 then 'before' else 'after' end as pos, (doc_id * 3 % 30)::int - 3 as a, (doc_id * 5 % 40)::int - 3 as b from doc),
    m as (select *, p - 1 + case when pos = 'before' then 0 else 1 end as ix, greatest(0, least(a - 1, n - 1)) as f from k)
    select doc_id, (case when ix >= 0 and ix <= n then ix end)::int as insert_at, f::int as first, greatest(f, least(b - 1, n - 1))::int as last from m"""))
def insert_index(spark, sf):
    d, n = c("doc_id"), c("page_count")
    pos = F.when(d % 2 == 0, "before").otherwise("after")
    return fx.docs(spark, sf).select(
        "doc_id", g.insert_index((d * 7 % 25).cast("int"), pos, n).alias("insert_at"),
        g.clamp_range((d * 3 % 30).cast("int") - 3, (d * 5 % 40).cast("int") - 3, n).alias("r")
    ).select("doc_id", "insert_at", "r.*")


@query("S11", with_tables("doc page", """
    select p.doc_id, page_number, 'doc.' || p.doc_id || '_png_' || (page_number + 1) || '.png' as file_name from page p join doc using (doc_id)"""))
def page_file_name(spark, sf):
    p = fx.pages(spark, sf).join(fx.docs(spark, sf).select("doc_id", "name"), "doc_id")
    return p.select("doc_id", "page_number", values.page_file_name(c("name"), "png", c("page_number")).alias("file_name"))


_FIELD = """(select event_id, case event_id % 4 when 0 then '/Tx' when 1 then 'Btn' when 2 then '/Ch' else 'Sig' end as ft,
    case when event_id % 7 = 0 then null else (event_id * 4099 % 300000)::int end as ff,
    case when event_id % 3 = 0 then 'date_' else 'name_' end || (event_id % 50) as fname from events)"""


def _fields(spark, sf):
    e = c("event_id")
    ft = F.when(e % 4 == 0, "/Tx").when(e % 4 == 1, "Btn").when(e % 4 == 2, "/Ch").otherwise("Sig")
    ff = F.when(e % 7 == 0, F.lit(None).cast("int")).otherwise((e * 4099 % 300000).cast("int"))
    name = F.concat(F.when(e % 3 == 0, "date_").otherwise("name_"), (e % 50).cast("string"))
    return fx.table(spark, sf, "events").select("event_id", ft.alias("ft"), ff.alias("ff"), name.alias("fname"))


@query("P21", f"""with k as (select event_id, ltrim(ft, '/') as t, coalesce(ff, 0) as f from {_FIELD})
    select event_id, t = 'Tx' and f & 4096 <> 0 as multiline, t <> 'Sig' and f & 1 <> 0 as read_only, t <> 'Sig' and f & 2 <> 0 as required,
        t = 'Btn' and f & 32768 <> 0 as radio from k""")
def decode_field_flags(spark, sf):
    return _fields(spark, sf).select("event_id", fields.decode_field_flags(c("ft"), c("ff")).alias("f")).select("event_id", "f.*")


@query("P22", """with k as (select event_id, ['text', 'checkbox', 'radio', 'dropdown', 'date'][event_id % 5 + 1] as t, event_id % 2 = 0 as m, event_id % 3 = 0 as ro, event_id % 7 = 0 as rq, (event_id * 4099 % 300000)::int as f from events)
    select event_id, (case when t = 'text' and m or t = 'date' then 4096 else 0 end | case when t = 'radio' then 32768 else 0 end | case when t = 'dropdown' then 131072 else 0 end
        | case when ro then 1 else 0 end | case when rq then 2 else 0 end)::int as flags,
        ((f - f % 4) | case when ro then 1 else 0 end | case when rq then 2 else 0 end)::int as updated from k""")
def encode_field_flags(spark, sf):
    e = c("event_id")
    t = F.element_at(F.array(*map(F.lit, ("text", "checkbox", "radio", "dropdown", "date"))), (e % 5 + 1).cast("int"))
    m, ro, rq = e % 2 == 0, e % 3 == 0, e % 7 == 0
    return fx.table(spark, sf, "events").select(
        "event_id", fields.encode_field_flags(t, m, ro, rq).alias("flags"),
        fields.update_field_flags((e * 4099 % 300000).cast("int"), ro, rq).alias("updated"))


@query("P23", f"""with k as (select event_id, ltrim(ft, '/') as t, coalesce(ff, 0) as f, fname from {_FIELD})
    select event_id, case when t = 'Tx' and fname like 'date\\_%' escape '\\' then 'date' when t = 'Btn' and f & 32768 <> 0 then 'radio' when t = 'Btn' then 'checkbox'
        when t = 'Ch' then 'dropdown' else 'text' end as field_type from k""")
def field_type(spark, sf):
    return _fields(spark, sf).select("event_id", fields.field_type(c("ft"), c("ff"), c("fname")).alias("field_type"))


@query("P24", """with k as (select event_id, ['/Yes', 'On', 'Off', null, '/On'][event_id % 5 + 1] as v, ['Yes', '/Off', null][event_id % 3 + 1] as a from events)
    select event_id, coalesce(ltrim(coalesce(v, a), '/') in ('Yes', 'On'), false) as checked from k""")
def field_bool(spark, sf):
    e = c("event_id")
    v = F.get(F.array(*map(F.lit, ("/Yes", "On", "Off", None, "/On"))), (e % 5).cast("int"))
    a = F.get(F.array(*map(F.lit, ("Yes", "/Off", None))), (e % 3).cast("int"))
    return fx.table(spark, sf, "events").select("event_id", fields.field_bool(v, a).alias("checked"))


@query("P1 P3 P11 P15 P19 P25", with_tables("ann", """
    select ann_id, 792 - (y + height) as flipped_y0, x + length(content) * 12::double * 0.6::double as guess_x1, x + width >= 100 and x <= 200 and y + height >= 100 and y <= 300 as touches,
        greatest(25, least(value, 400))::double as scale, ((ann_id % 9) * 90 % 360)::int as rotation, x / 72::double as inches, case when width < height then 'portrait' else 'landscape' end as side,
        printf('#%02x%02x%02x', ann_id * 7 % 256, ann_id * 13 % 256, ann_id * 29 % 256) as color from ann"""))
def sql_functions(spark, sf):
    """The functions called from SQL text."""
    from ..functions.sqlfuncs import register_functions

    register_functions(spark, "qw_")
    return spark.sql("""
        select ann_id, qw_flip_bbox(x, y, x + width, y + height, 792D).y0 as flipped_y0, qw_estimate_bbox(content, x, y, 0D).x1 as guess_x1,
            qw_boxes_touch(x, y, x + width, y + height, 100D, 100D, 200D, 300D) as touches, qw_clamp_to(value, 25D, 400D) as scale,
            qw_add_rotation(cast(ann_id % 9 as int) * 90 - 360, 0) as rotation, qw_points_to_inches(x) as inches, qw_page_orientation(width, height) as side,
            qw_rgb_to_hex(ann_id * 7 % 256 / 255D, ann_id * 13 % 256 / 255D, ann_id * 29 % 256 / 255D) as color
        from {ann}""", ann=fx.annotations(spark, sf))


@query("S14", """select doc_id, len(string_split(text, chr(10)))::bigint as n_lines, strlen(text)::bigint as n_bytes from documents""")
def parse_hook(spark, sf):
    """A stand-in parser over document bytes."""
    from ..sources.documents import parse_pdf

    def lines(frames):
        for pdf in frames:
            yield pdf.assign(n_lines=[b.count(b"\n") + 1 for b in pdf["content"]],
                             n_bytes=[len(b) for b in pdf["content"]])[["doc_id", "n_lines", "n_bytes"]]

    docs = fx.table(spark, sf, "documents").select("doc_id", F.to_binary("text", F.lit("utf-8")).alias("content"))
    return parse_pdf(docs, lines, "doc_id BIGINT, n_lines BIGINT, n_bytes BIGINT")
