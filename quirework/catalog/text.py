"""Reading order, page text, search, selection and redaction."""

from pyspark.sql import functions as F

from ..functions.geometry import rect_quad
from ..operators import redact, selection, text
from ..plans import fixtures as fx
from ..plans.oracle import with_tables
from .registry import query

c = F.col
QUERIES = ["the", "de la", "ZZZ", " "]
KEY = ["doc_id", "page_number"]


def _ordered(spark, sf, anchor="bottom"):
    # A page here is twenty lines of one document row, so no page can outgrow a task.
    return text.reading_order(fx.spans(spark, sf), anchor, hot_rows=None)


def _page_text(spark, sf, sep=" "):
    return text.page_text(_ordered(spark, sf), sep)


def _hits_on_spans(spark, sf):
    offsets = text.span_offsets(_ordered(spark, sf), " ", hot_rows=None)
    return text.search(text.page_text_with_spans(offsets, " "), QUERIES)


_HITS = """
    , needle as (select unnest(['the', 'de la', 'zzz']) as query),
    cut as (select doc_id, page_number, query, string_split(lower(text), query) as ps from ptext, needle where contains(lower(text), query)),
    piece as (select doc_id, page_number, query, i, len(ps) as n, coalesce(sum(length(ps[i + 1]) + length(query)) over (partition by doc_id, page_number, query order by i
            rows between unbounded preceding and 1 preceding), 0) + length(ps[i + 1]) as start from cut, unnest(range(len(ps))) t(i)),
    hit as (select doc_id, page_number, query, start::int as start, length(query)::int as hit_length,
            row_number() over (partition by query, doc_id order by page_number, start) - 1 as match_index
        from piece where i < n - 1)"""


@query("A5 A6", with_tables("ptext", _HITS + """
    select query, doc_id, count(*) as hits, count(distinct page_number) as pages_hit from hit group by 1, 2"""))
def search_flagship(spark, sf):
    hits = text.find_matches(_page_text(spark, sf), QUERIES)
    return text.hits_per_document(hits)


@query("W1", with_tables("ordered", """
    select doc_id, page_number, span_id, line_index::bigint as line_index, read_index from ordered"""))
def reading_order(spark, sf):
    return _ordered(spark, sf).select(*KEY, "span_id", c("line_index").cast("long"), "read_index")


@query("W1", with_tables("span", """
    , g as (select *, (y0 + y1) / 2 as m from span),
    b as (select *, case when lag(m) over (partition by doc_id, page_number order by m desc, x0, span_id) - m > 5 then 1 else 0 end as brk from g),
    l as (select *, sum(brk) over (partition by doc_id, page_number order by m desc, x0, span_id rows between unbounded preceding and current row) as li from b)
    select doc_id, page_number, span_id, li::bigint as line_index, row_number() over (partition by doc_id, page_number order by li, x0, span_id) - 1 as read_index from l"""))
def reading_order_dense(spark, sf):
    """Centre anchor, every page of more than 200 spans treated as dense."""
    return text.reading_order(fx.spans(spark, sf), "center", hot_rows=200, dealt_by=fx.DEALT_BY).select(
        *KEY, "span_id", c("line_index").cast("long"), "read_index")


@query("A2", with_tables("ptext0", "select doc_id, page_number, text from ptext0"))
def page_text(spark, sf):
    return _page_text(spark, sf, "")


@query("A3 T6", with_tables("ptext", """
    select doc_id, (page_number // 256)::int as part, string_agg('--- Page ' || (page_number + 1) || ' ---' || chr(10) || chr(10) ||
        coalesce(case when (doc_id + page_number) % 17 > 0 then text end, '[Error extracting text from page ' || (page_number + 1) || ']' || chr(10)) || chr(10), chr(10) order by page_number) as text
    from ptext group by 1, 2"""))
def document_text(spark, sf):
    failed = (c("doc_id") + c("page_number")) % 17 == 0
    pages = _page_text(spark, sf).withColumn("text", F.when(~failed, c("text")))
    return text.document_text(pages)


@query("A5 W2 T3", with_tables("ptext", _HITS + " select doc_id, page_number, query, start, hit_length, match_index from hit"))
def search_hits(spark, sf):
    return text.search(_page_text(spark, sf), QUERIES)


# Ten needles of eight characters from every document, none of which can overlap itself.
_MANY = """
    , piece8 as (select lower(substr(text, ((doc_id * 37 + k * 101) % greatest(length(text) - 7, 1) + 1)::bigint, 8)) as query from documents, range(10) r(k)),
    needle as (select distinct query from piece8 where regexp_full_match(query, '[a-z][a-z ]{6}[a-z]') and not contains(query, 'ss')
        and len(list_filter(range(1, 8), lambda k: query[1:k] = query[9 - k:8])) = 0),
    cut as (select doc_id, page_number, o, regexp_extract_all(substr(lower(text), o + 1), '(?s).{8}') as ps from ptext, range(8) t(o)),
    spot as (select doc_id, page_number, (o + 8 * (generate_subscripts(ps, 1) - 1))::int as start, unnest(ps) as query from cut)
    select doc_id, page_number, query, start, 8 as hit_length from spot join needle using (query)"""


@query("A5", with_tables("ptext", _MANY))
def search_many(spark, sf):
    """Queries as a table: about ten for every document, all sought in one pass."""
    docs = fx.table(spark, sf, "documents")
    # All pieces of a document are cut in its own row: a filter on an exploded column is not computed from the whole text again.
    at = lambda k: (c("doc_id") * 37 + k * 101) % F.greatest(c("n") - 7, F.lit(1)) + 1
    piece = lambda k: F.lower(F.substring(c("text"), at(k).cast("int"), F.lit(8)))
    pieces = docs.select("doc_id", "text", F.length("text").alias("n")).select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), piece)).alias("query")).distinct()
    border = F.exists(F.sequence(F.lit(1), F.lit(7)), lambda k: F.left(c("query"), k) == F.right(c("query"), k))
    needles = pieces.filter(c("query").rlike("^[a-z][a-z ]{6}[a-z]$") & ~c("query").contains("ss") & ~border)
    return text.find_matches(_page_text(spark, sf), needles)


@query("A6", with_tables("ptext", _HITS + """
    , p as (select query, doc_id, page_number, count(*) as page_hits from hit group by 1, 2, 3)
    select *, sum(page_hits) over (partition by query, doc_id)::bigint as doc_hits from p"""))
def search_counts(spark, sf):
    return text.search_counts(text.search(_page_text(spark, sf), QUERIES))


@query("W11", with_tables("ptext", _HITS + """
    select query, doc_id, match_index, (match_index + 1) % n as next_index, (match_index - 1 + n) % n as previous_index
    from (select *, count(*) over (partition by query, doc_id) as n from hit)"""))
def match_neighbours(spark, sf):
    hits = text.search(_page_text(spark, sf), QUERIES)
    return text.match_neighbours(hits).select("query", "doc_id", "match_index", "next_index", "previous_index")


_OFFSETS = """
    , offs as (select *, coalesce(sum(length(text) + 1) over (partition by doc_id, page_number order by read_index rows between unbounded preceding and 1 preceding), 0)::bigint as char_start from ordered),
    hs as (select h.*, o.span_id, o.text, o.x0 as sx0, o.x1 as sx1, o.y0, o.y1, greatest(start - char_start, 0) as f, least(start + hit_length, char_start + length(o.text)) - char_start as l
        from hit h join offs o using (doc_id, page_number) where start < char_start + length(o.text) and start + hit_length > char_start)"""


@query("J13", with_tables("ptext", _HITS + _OFFSETS + """
    select query, doc_id, page_number, match_index, start, span_id, sx0 + f * ((sx1 - sx0) / length(text)) as x0, y0,
        sx0 + l * ((sx1 - sx0) / length(text)) as x1, y1, f::int as a, (l - 1)::int as b from hs"""))
def hit_quads(spark, sf):
    return text.hit_quads(_hits_on_spans(spark, sf))


@query("E10", with_tables("ptext", _HITS + _OFFSETS + """
    , gone as (select distinct doc_id, page_number, span_id, i from hs, unnest(range(f, l)) t(i)),
    ch as (select doc_id, page_number, span_id, i, text[i + 1] as t from span, unnest(range(length(text))) t(i)),
    kept as (select * from ch anti join gone using (doc_id, page_number, span_id, i))
    select doc_id, page_number, string_agg(t, '' order by span_id, i) as text from kept group by 1, 2"""))
def search_and_redact(spark, sf):
    boxes = text.hit_quads(_hits_on_spans(spark, sf))
    left, _ = redact.search_and_redact(fx.spans(spark, sf), boxes, dealt_by=fx.DEALT_BY)
    return left.groupBy(*KEY).agg(
        text.joined_text(F.struct("span_id", "run_index"), c("text"), "").alias("text"))


_RECTS = "select ann_id as sel_id, doc_id, page_number, x - 20 as ax0, y as ay0, x + width * 2 as ax1, y + height * 3 as ay1 from ann where type <> 'redact'"


def _rects(spark, sf):
    return fx.annotations(spark, sf).filter(c("type") != "redact").select(
        c("ann_id").alias("sel_id"), *KEY, (c("x") - 20).alias("x0"), c("y").alias("y0"),
        (c("x") + c("width") * 2).alias("x1"), (c("y") + c("height") * 3).alias("y1"))


@query("J1", with_tables("span ann", f"""
    , r as ({_RECTS}) select sel_id, doc_id, page_number, span_id, text from r join span using (doc_id, page_number)
    where x1 >= ax0 and x0 <= ax1 and y1 >= ay0 and y0 <= ay1"""))
def select_in_rect(spark, sf):
    r = _rects(spark, sf)
    s = fx.spans(spark, sf)
    return selection.select_in_rect(s, r).select("sel_id", *KEY, "span_id", "text")


@query("A4", with_tables("ordered ann", f"""
    , r as ({_RECTS}) select sel_id, string_agg(text, '' order by read_index) as text from r join ordered using (doc_id, page_number)
    where x1 >= ax0 and x0 <= ax1 and y1 >= ay0 and y0 <= ay1 group by 1"""))
def selection_text(spark, sf):
    picked = selection.select_in_rect(_ordered(spark, sf), _rects(spark, sf))
    return text.selection_text(picked)


_CHARS = """
    ch as (select doc_id, page_number, span_id, i, text[i + 1] as t, y0, y1,
        case when length(text) = 1 then x0 else x0 + i * ((x1 - x0) / length(text)) end as x0,
        case when length(text) = 1 then x1 else x0 + (i + 1) * ((x1 - x0) / length(text)) end as x1
        from span, unnest(range(length(text))) u(i))"""


@query("J2", with_tables("span annv", f"""
    , {_CHARS}, q as (select ann_id as sel_id, doc_id, page_number, 0 as qi, x as ax0, y as ay0, x + width as ax1, y + height as ay1 from annv where type = 'highlight'
        union all select ann_id, doc_id, page_number, 1, x + 30, y - 10, x + 30 + width, y - 10 + height from annv where type = 'highlight'),
    m as (select *, row_number() over (partition by sel_id, x0, y0, x1, y1 order by qi, span_id, i) as r from q join ch using (doc_id, page_number)
        where x1 >= ax0 and x0 <= ax1 and y1 >= ay0 and y0 <= ay1)
    select sel_id, doc_id, page_number, x0, y0, x1, y1, t as text, span_id, i::int as char_index, qi::int as quad_index from m where r = 1"""))
def select_by_quads(spark, sf):
    a = fx.valid_annotations(spark, sf).filter(c("type") == "highlight")
    both = F.array(rect_quad(c("x"), c("y"), c("width"), c("height")),
                   rect_quad(c("x") + 30, c("y") - 10, c("width"), c("height")))
    quads = a.select(c("ann_id").alias("sel_id"), *KEY, F.posexplode(both).alias("quad_index", "quad"))
    return selection.select_by_quads(fx.spans(spark, sf), quads)


@query("J3", with_tables("span annv", """
    , g as (select *, (y0 + y1) / 2 as m from span),
    b as (select *, case when lag(m) over (partition by doc_id, page_number order by m desc, x0, span_id) - m > 5 then 1 else 0 end as brk from g),
    l as (select *, sum(brk) over (partition by doc_id, page_number order by m desc, x0, span_id rows between unbounded preceding and current row) as li from b),
    o as materialized (select doc_id, page_number, span_id, x0, y0, x1, y1, m, row_number() over (partition by doc_id, page_number order by li, x0, span_id) - 1 as ri from l),
    s as (select ann_id as sel_id, doc_id, page_number, x as sx, y + 300 as sy, x + width as ex, y + 330 - height * 3 as ey from annv where type = 'text'),
    w as (select *, ey > sy or (abs(ey - sy) < 5 and ex < sx) as sw from s),
    t as (select sel_id, doc_id, page_number, case when sw then ex else sx end as sx, case when sw then ey else sy end as sy, case when sw then sx else ex end as ex, case when sw then sy else ey end as ey from w),
    p as (select t.*, o.ri, o.x0, o.y0, o.x1, o.y1, o.m, sy >= y0 - 5 and sy <= y1 + 5 as sin, ey >= y0 - 5 and ey <= y1 + 5 as ein from t join o using (doc_id, page_number)),
    e as (select sel_id, doc_id, page_number, coalesce(min(ri) filter (case when sin then sx <= x1 else sy > y1 end), 0) as a,
        coalesce(max(ri) filter (case when ein then ex >= x0 else ey <= m end), min(ri) filter (not ein and ey > m and ri > 0) - 1, max(ri)) as b from p group by 1, 2, 3)
    select sel_id, doc_id, page_number, span_id, ri as read_index from e join o using (doc_id, page_number) where ri between least(a, b) and greatest(a, b)"""))
def select_by_flow(spark, sf):
    a = fx.valid_annotations(spark, sf).filter(c("type") == "text")
    sels = a.select(
        c("ann_id").alias("sel_id"), *KEY, c("x").alias("sx"), (c("y") + 300).alias("sy"),
        (c("x") + c("width")).alias("ex"), (c("y") + 330 - c("height") * 3).alias("ey"))
    return selection.flow_text(fx.spans(spark, sf), sels, hot_rows=None).select("sel_id", *KEY, "span_id", "read_index")


_REDACT = f"""
    , {_CHARS}, k as (select distinct doc_id, page_number, greatest(0, least(x, p.width)) as ax0, greatest(0, least(y, p.height)) as ay0,
        greatest(0, least(x + a.width, p.width)) as ax1, greatest(0, least(y + a.height, p.height)) as ay1
        from ann a join page p using (doc_id, page_number) where type = 'redact'),
    gone as (select distinct doc_id, page_number, span_id, i from k join ch using (doc_id, page_number)
        where x1 >= ax0 and x0 <= ax1 and y1 >= ay0 and y0 <= ay1)"""


@query("J4", with_tables("span ann page", _REDACT + """
    , kept as (select * from ch anti join gone using (doc_id, page_number, span_id, i)),
    run as (select *, i - row_number() over (partition by doc_id, page_number, span_id order by i) as grp from kept),
    part as (select doc_id, page_number, span_id, grp, string_agg(t, '' order by i) as text, min(x0) as x0, max(x1) as x1 from run group by 1, 2, 3, 4)
    select doc_id, page_number, count(*) as pieces, string_agg(text, '|' order by span_id, grp) as text, round(min(x0), 6) as x0, round(max(x1), 6) as x1 from part group by 1, 2"""))
def apply_redactions(spark, sf):
    left, _, _ = redact.apply_redactions(fx.spans(spark, sf), fx.annotations(spark, sf), fx.pages(spark, sf))
    return left.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("pieces"),
        text.joined_text(F.struct("span_id", "run_index"), c("text"), "|").alias("text"),
        F.round(F.min("x0"), 6).alias("x0"), F.round(F.max("x1"), 6).alias("x1"))


@query("J4", with_tables("ann page", """
    select ann_id, doc_id, page_number, type from ann a where type <> 'redact' or not exists
        (select 1 from page p where p.doc_id = a.doc_id and p.page_number = a.page_number)"""))
def annotations_after_redaction(spark, sf):
    _, kept, _ = redact.apply_redactions(fx.spans(spark, sf), fx.annotations(spark, sf), fx.pages(spark, sf))
    return kept.select("ann_id", *KEY, "type")


@query("J4 E10", with_tables("span ann page", _REDACT + """
    , n as (select doc_id, page_number, count(*) as areas from k group by 1, 2),
    g as (select doc_id, page_number, count(distinct span_id) as spans_touched, count(*) as characters_removed from gone group by 1, 2)
    select doc_id, page_number, areas, coalesce(spans_touched, 0)::bigint as spans_touched, coalesce(characters_removed, 0)::bigint as characters_removed
    from n left join g using (doc_id, page_number)"""))
def redaction_report(spark, sf):
    _, _, report = redact.apply_redactions(fx.spans(spark, sf), fx.annotations(spark, sf), fx.pages(spark, sf))
    return report


@query("J5", with_tables("annv page", """
    , a as (select ann_id, ord, doc_id, page_number, type, x, y, width, height, ann_id % 3 = 0 as ov from annv where type in ('text', 'highlight')),
    b as (select ann_id, ord, doc_id, page_number, x as ax0, y as ay0, x + width as ax1, y + height as ay1 from a where type = 'text'
        union all select ann_id, ord, doc_id, page_number, x - 14, y - 14, x + width + 14, y + height + 14 from a where type = 'highlight' and ov
        union all select ann_id, ord, doc_id, page_number, x, y, x + width, y + height from a where type = 'highlight' and not ov),
    p as (select ann_id as point_id, doc_id, page_number, x + 10 as px, y + 8 as py from annv where type not in ('text', 'highlight'))
    select point_id, doc_id, page_number, first(b.ann_id order by b.ord) as ann_id from p join b using (doc_id, page_number)
    where px between ax0 and ax1 and py between ay0 and ay1 group by 1, 2, 3"""))
def hit_test(spark, sf):
    a = fx.valid_annotations(spark, sf)
    overlay = (c("type") == "highlight") & (c("ann_id") % 3 == 0)
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    shaped = a.filter(c("type").isin("text", "highlight")).select(
        "ann_id", "ord", *KEY, "type", "x", "y", "width", "height",
        F.when(overlay, "overlay").otherwise("text").alias("highlight_mode"), F.lit(8.0).alias("stroke_width"),
        F.when(overlay, F.array(corner(c("x"), c("y")), corner(c("x") + c("width"), c("y") + c("height")))).alias("path"),
        F.when(~overlay, F.array(rect_quad(c("x"), c("y"), c("width"), c("height")))).alias("quads"))
    points = a.filter(~c("type").isin("text", "highlight")).select(
        c("ann_id").alias("point_id"), *KEY, (c("x") + 10).alias("px"), (c("y") + 8).alias("py"))
    return selection.hit_test(points, selection.hit_areas(shaped))


@query("J5", with_tables("annv span", """
    select ann_id as point_id, doc_id, page_number, x as px, y + 400 as py from annv a where exists (select 1 from span s
        where s.doc_id = a.doc_id and s.page_number = a.page_number and a.x between x0 and x1 and a.y + 400 between y0 and y1)"""))
def over_text(spark, sf):
    points = fx.valid_annotations(spark, sf).select(
        c("ann_id").alias("point_id"), *KEY, c("x").alias("px"), (c("y") + 400).alias("py"))
    return selection.over_text(points, fx.spans(spark, sf))


@query("W14", with_tables("annv ptext0", """
    , q as (select ann_id, doc_id, page_number, row_number() over (partition by doc_id, page_number order by ann_id) - 1 as quad_index,
        count(*) over (partition by doc_id, page_number) as n from annv where type = 'highlight')
    select ann_id, doc_id, page_number, quad_index::int as quad_index, substr(text, (quad_index * ceil(length(text) / n::double) + 1)::bigint, ceil(length(text) / n::double)::bigint) as text
    from q join ptext0 using (doc_id, page_number)"""))
def distribute_text(spark, sf):
    from ..plans.scan import ordered_scan

    a = fx.valid_annotations(spark, sf).filter(c("type") == "highlight").select("ann_id", *KEY)
    quads = ordered_scan(a, KEY, F.floor(c("ann_id") / 4096), [c("ann_id")], rank="quad_index").withColumn(
        "quad_index", c("quad_index").cast("int"))
    return text.distribute_text(quads, _page_text(spark, sf, "")).select("ann_id", *KEY, "quad_index", "text")
