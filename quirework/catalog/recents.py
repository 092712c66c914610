"""Recent items, tabs and document status."""

from pyspark.sql import functions as F

from ..operators import documents as op
from ..plans import fixtures as fx
from ..plans.oracle import with_tables
from .registry import query

c = F.col


def _ntz(df, *cols):
    return df.withColumns({n: c(n).cast("timestamp_ntz") for n in cols})


@query("T1", with_tables("opened", """
    select path, max(ts) as last_opened, first(name order by ts desc) as name from opened group by 1 order by 2 desc, 1 limit 30"""))
def recent_files(spark, sf):
    return _ntz(op.recent_files(fx.open_events(spark, sf), 30), "last_opened")


_BY_USER = """
    , e as (select event_id, ts, user_id, '/d/' || (event_id % 50) || '.pdf' as path, (event_id % 50) || '.pdf' as name from events),
    l as (select user_id, path, max(ts) as last_opened, first(name order by ts desc) as name from e group by 1, 2),
    r as (select *, row_number() over (partition by user_id order by last_opened desc, path)::int as rank from l)
    select * from r where rank <= 5""".replace("\n    , e as", "with e as", 1)


@query("T1", _BY_USER)
def recent_files_per_user(spark, sf):
    path = F.concat(F.lit("/d/"), (c("event_id") % 50).cast("string"), F.lit(".pdf"))
    e = fx.table(spark, sf, "events").select(
        "ts", "user_id", path.alias("path"), F.concat((c("event_id") % 50).cast("string"), F.lit(".pdf")).alias("name"))
    return _ntz(op.recent_files(e, 5, "user_id"), "last_opened")


@query("T2 J11", """with u as (select user_id, event_id % 37 as stamp_id, max(ts) as last_used from events where event_type = 'purchase' group by 1, 2),
    r as (select *, row_number() over (partition by user_id order by last_used desc, stamp_id)::int as rank from u),
    k as (select r.*, 'stamp ' || stamp_id as name, row_number() over (partition by user_id order by rank) as n from r where rank <= 10 and stamp_id in (select event_id % 37 from events where (event_id % 37) % 5 > 0))
    select user_id, stamp_id, last_used, rank, name from k where n <= 5""")
def recent_stamps(spark, sf):
    e = fx.table(spark, sf, "events")
    uses = e.filter(c("event_type") == "purchase").select("user_id", (c("event_id") % 37).alias("stamp_id"), "ts")
    known = e.select((c("event_id") % 37).alias("stamp_id")).distinct()
    stamps = known.filter(c("stamp_id") % 5 > 0).select(
        "stamp_id", F.concat(F.lit("stamp "), c("stamp_id").cast("string")).alias("name"))
    return _ntz(op.recent_stamps(uses, stamps, keep=10, show=5), "last_used")


@query("W12", """with t as (select user_id, event_id as tab_id,
        max(event_id) filter (event_id % 3 > 0) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) as b,
        min(event_id) filter (event_id % 3 > 0) over (partition by user_id order by event_id rows between 1 following and unbounded following) as a from events)
    select user_id, tab_id as closed_id, coalesce(b, a) as active_id from t where tab_id % 3 = 0""")
def active_after_close(spark, sf):
    tabs = fx.table(spark, sf, "events").select("user_id", c("event_id").alias("tab_id"), c("event_id").alias("ord"))
    return op.active_after_close(tabs, tabs.filter(c("tab_id") % 3 == 0))


@query("E8", """with e as (select user_id as doc_id, ts, case when event_type in ('click', 'error') then 'edit' when event_type = 'purchase' then 'save' else 'view' end as kind from events),
    f as (select doc_id, max(ts) filter (kind = 'edit') as last_edit, max(ts) filter (kind = 'save') as last_saved from e group by 1)
    select doc_id, last_saved, last_edit is not null and (last_saved is null or last_edit > last_saved) as is_modified from f""")
def document_status(spark, sf):
    t = c("event_type")
    e = fx.table(spark, sf, "events").select(
        c("user_id").alias("doc_id"), "ts",
        F.when(t.isin("click", "error"), "edit").when(t == "purchase", "save").otherwise("view").alias("kind"))
    return _ntz(op.document_status(e), "last_saved")


@query("E8 J11", with_tables("opened", """
    select user_id, first(path order by ts desc, event_id desc) as active_path, count(distinct path) as open_tabs from opened group by 1"""))
def active_documents(spark, sf):
    return op.active_documents(fx.open_events(spark, sf))
