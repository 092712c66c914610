"""Open, edit and save: whole workflows over a versioned store."""

import uuid

from pyspark.sql import functions as F

from ..operators.annotations import stored_kind
from ..operators.pages import extract_pages, page_count
from ..operators.workspace import Workspace
from ..plans import fixtures as fx
from ..plans.oracle import with_tables
from ..plans.settle import shared_dir
from ..sources.versions import TableStore
from .annotations import _STORED
from .registry import query

c = F.col
KEY = ["doc_id", "page_number"]
FIELDS = ["page_number", "type", "subtype", "custom", "stamped", "stamp_contents", "note"]


def _stored(spark, sf):
    a = fx.valid_annotations(spark, sf)
    k, kind = c("ann_id"), c("type")
    return a.select(
        k.cast("string").alias("ann_id"), *KEY, "type", stored_kind(kind).alias("subtype"), ((kind == "text") & (k % 2 == 0)).alias("custom"),
        ((kind == "stamp") & (k % 3 == 0)).alias("stamped"), ((kind == "stamp") & (k % 3 == 1)).alias("stamp_contents"), F.lit(None).cast("string").alias("note"))


def _flow(n):
    return c("doc_id") % 6 == n


_DONE = """
    , pg as (select *, doc_id % 6 as w from page),
    ins as (select doc_id, w, (case when w = 3 and page_number >= 1 then page_number + 1 else page_number end)::int as p, width, height, rotation from pg
        union all select doc_id, w, 1, width, height, rotation from pg where w = 3 and page_number = 0),
    old as (select ann_id, doc_id, doc_id % 6 as w, (case when doc_id % 6 = 3 and page_number >= 1 then page_number + 1 else page_number end)::int as p,
        subtype in ('Ink', 'Highlight', 'Line', 'Square', 'Circle', 'Widget') or (subtype = 'FreeText' and custom) or (subtype in ('FreeText', 'Stamp') and stamped) or (subtype = 'Stamp' and jsn) as ours from st),
    a1 as (select doc_id, w, p, ours and w >= 4 and ann_id::int % 3 = 0 as edited from old where not (ours and w >= 4 and ann_id::int % 3 = 1)
        union all select doc_id, w, p, false from ins where w < 4),
    n as (select doc_id, count(*) as n from ins group by 1),
    gone as (select doc_id, 0 as p from n where doc_id % 6 = 1 and n > 1),
    map as (select ins.*, case when w = 0 then case when p = 0 then n - 1 when p >= n then p else p - 1 end
            when w = 1 then row_number() over (partition by doc_id order by p) - 1 else p end::int as q
        from ins join n using (doc_id) anti join gone using (doc_id, p)),
    a2 as (select map.doc_id, map.q, edited from a1 join map using (doc_id, p) where not (map.w = 2 and map.q % 2 = 0))
    select doc_id, (w)::int as workflow, q as page_number, case when w = 2 then height else width end as width, case when w = 2 then width else height end as height,
        (case when w = 2 then (rotation + 90) % 360 else rotation end)::int as rotation, count(edited) as annotations, count(*) filter (edited) as edited
    from map left join a2 using (doc_id, q) group by all"""


def _run(spark, sf):
    store = TableStore(spark, f"{shared_dir(spark)}/stores/{uuid.uuid4().hex}")
    store.save({"pages": fx.pages(spark, sf), "annotations": _stored(spark, sf)}, 0)

    def fresh(work, flows):
        one = work.pages.filter(c("doc_id") % 6 < flows if flows else F.lit(False))
        highlight = F.lit("highlight")
        return one.select("doc_id", F.concat(F.lit("n"), c("doc_id").cast("string"), F.lit("-"), c("page_number").cast("string")).alias("ann_id"),
                          F.lit("add").alias("op"), F.lit(1).alias("ts"), F.lit(1).alias("event_id"), "page_number", highlight.alias("type"),
                          stored_kind(highlight).alias("subtype"), *[F.lit(False).alias(f) for f in ("custom", "stamped", "stamp_contents")],
                          F.lit(None).cast("string").alias("note"))

    def changed(work, mine):
        k = c("ann_id").try_cast("int") % 3
        rows = work.current.filter(mine & k.isin(0, 1))
        return rows.select("doc_id", "ann_id", F.when(k == 0, "update").otherwise("remove").alias("op"), F.lit(1).alias("ts"), F.lit(1).alias("event_id"),
                           *[(F.when(k == 0, "edited") if f == "note" else F.lit(None).cast(work.current.schema[f].dataType)).alias(f) for f in FIELDS])

    work = Workspace.open(store)
    first = work.pages.select("doc_id").distinct()
    work = work.insert_blank(first.filter(_flow(3)).select("doc_id", F.lit(1).alias("at")))
    work = work.edit(fresh(work, 4), FIELDS).edit(changed(work, _flow(4)), FIELDS)
    counts = page_count(work.pages)
    to_end = F.struct(F.lit(0).alias("from_index"), (c("page_count") - 1).cast("int").alias("to_index"))
    work = work.reorder(counts.filter(_flow(0)).select("doc_id", F.array(to_end).alias("ops")))
    work = work.delete(work.pages.filter(_flow(1) & (c("page_number") == 0)).select(*KEY))
    work = work.rotate(work.pages.filter(_flow(2)).select(*KEY, F.lit(90).alias("degrees")))
    work = work.flatten(work.pages.filter(_flow(2) & (c("page_number") % 2 == 0)).select(*KEY)).save()
    # Several documents open at once: each half is edited and saved by itself, from what the other has left.
    for half in (0, 1):
        work = work.edit(changed(work, _flow(5) & (c("doc_id") % 12 == 5 + 6 * half)), FIELDS).save()
    return work


@query("E1 E2 W3 W5 W7 P11 E5 S12", with_tables("page annv", _STORED + _DONE))
def save_workflows(spark, sf):
    """Six workflows, one for each sixth of the documents: add and reorder; add and delete pages; add, rotate and flatten; insert
    and add; edit what was loaded; edit several documents in turn.  Saved in three versions and opened again."""
    work = _run(spark, sf)
    rows = work.stored.groupBy(*KEY).agg(F.count(F.lit(1)).alias("annotations"), F.count_if(c("note") == "edited").alias("edited"))
    zero = F.lit(0).cast("long")
    return work.pages.join(rows, KEY, "left").select(
        "doc_id", (c("doc_id") % 6).cast("int").alias("workflow"), "page_number", "width", "height", "rotation",
        F.coalesce("annotations", zero).alias("annotations"), F.coalesce("edited", zero).alias("edited"))


@query("S13", with_tables("page annv", _STORED + _DONE.rsplit("select doc_id, (w)::int", 1)[0] + """
    select doc_id, q as page_number, width, height, rotation from map where w = 3 and q = 0"""))
def export_after_edit(spark, sf):
    """The first page of each document with an inserted page, extracted from what was saved."""
    work = _run(spark, sf)
    keys = work.pages.filter(_flow(3) & (c("page_number") == 0)).select(*KEY)
    return extract_pages(work.pages, work.stored, keys)[0].select(*KEY, "width", "height", "rotation")
