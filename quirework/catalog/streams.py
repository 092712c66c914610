"""Edit logs, as tables and as streams over the same files."""

from pyspark.sql import functions as F

from ..plans import fixtures as fx
from ..plans.oracle import with_tables
from ..streaming import restore, state, timing, undo
from .annotations import _FOLD
from .annotations import _changes as _edits
from .registry import query

c = F.col


def _stream(spark, sf):
    """``events`` as a stream."""
    state.keep_state_on_disk(spark)
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return state.file_stream(spark, sf, "events.parquet", schema).withColumn("ts", c("ts").cast("timestamp"))


def _ops(events):
    kind = c("event_type")
    return events.select(
        "event_id", "ts", (c("user_id") % 20).alias("doc_id"), (c("event_id") % 40).alias("ann_id"),
        F.when(kind == "signup", "add").when(kind == "click", "update").when(kind == "purchase", "remove")
        .when(kind == "error", "undo").otherwise("redo").alias("op"), "value")


# The history is a list with a cursor; a recursive query carries it through the log of every document at once.
_UNDO = """
    , n as (select *, row_number() over (partition by doc_id order by ts, event_id) as i from edit),
    s as (select doc_id, 0::bigint as i, []::bigint[] as h, 0 as c, 0::bigint as pushes from (select distinct doc_id from edit)
        union all select s.doc_id, n.i, case when op in ('undo', 'redo') then h else list_append(case when c = 50 then h[2:50] else h[1:c] end, n.event_id) end,
            case op when 'undo' then greatest(c - 1, 0) when 'redo' then least(c + 1, len(h)) else least(c + 1, 50) end, pushes + (op not in ('undo', 'redo'))::int
        from s join n on n.doc_id = s.doc_id and n.i = s.i + 1),
    z as (select * from s where i = (select count(*) from edit e where e.doc_id = s.doc_id))
    select doc_id, c::int as cursor, len(h)::int as history_length, case when c > 0 then h[c] end as undo_event, case when c < len(h) then h[c + 1] end as redo_event, pushes, array_to_string(h, ',') as history from z"""


def _flat(df):
    return df.withColumn("history", F.array_join(F.transform("history", lambda e: e.cast("string")), ","))


@query("X1 T4", with_tables("edit", _UNDO, recursive=True))
def undo_redo(spark, sf):
    """Blocks of 100 events, so that documents are chained from several."""
    return _flat(undo.undo_redo_batch(fx.edit_events(spark, sf), block_rows=100))


@query("X1 X7", with_tables("edit", _UNDO, recursive=True))
def undo_redo_stream(spark, sf):
    out = state.run_to_end(undo.undo_redo_stream(_ops(_stream(spark, sf))), "update")
    cols = [f.name for f in out.schema if f.name not in ("doc_id", "_batch")]
    last = out.groupBy("doc_id").agg(F.max_by(F.struct(*cols), "_batch").alias("_r"))
    return _flat(last.select("doc_id", "_r.*"))


# Every seventh edit is one of pages, which moves to another page and removes two annotations.
def _log(events):
    """Edit log with its changes; one document has no id, another a large one."""
    e = c("event_id")
    paged = (e % 7 == 0) & ~c("op").isin("undo", "redo")
    doc = F.when(c("doc_id") == 0, F.lit(None)).when(c("doc_id") == 1, F.lit((1 << 60) + 1)).otherwise(c("doc_id"))
    note = F.when((e % 3 == 0) & (c("op") != "remove"), F.concat(F.lit("n"), e.cast("string")))

    def change(ann, op, value, note):
        return F.struct(ann.alias("ann_id"), op.alias("op"), value.alias("value"), note.alias("note"))

    none = F.lit(None)
    one = F.array(change(c("ann_id"), c("op"), F.when(c("op") != "remove", c("value")), note))
    two = F.array(*[change((e + k) % 40, F.lit("remove"), none.cast("double"), none.cast("string")) for k in (0, 1)])
    return events.select(
        "event_id", "ts", doc.cast("long").alias("doc_id"), "op",
        F.when(paged, (e % 11).cast("int")).alias("page_before"), F.when(paged, (e % 5).cast("int")).alias("page_after"),
        F.when(paged, two).when(~c("op").isin("undo", "redo"), one).alias("changes"))


def _changes(log):
    flat = log.select("doc_id", "event_id", F.posexplode("changes").alias("change_no", "x"))
    return flat.select("doc_id", "event_id", "change_no", "x.*")


_PATHS = """
    , lg as (select event_id, ts, case doc_id when 0 then null when 1 then 1152921504606846977 else doc_id end as doc_id, doc_id as d, ann_id, op, value,
        event_id % 7 = 0 and op not in ('undo', 'redo') as paged, row_number() over (partition by doc_id order by ts, event_id) as i from edit),
    s(d, i, path, back, avail, op, hit) as (select d, 0::bigint, []::bigint[], []::bigint[], 0::bigint, '', null::bigint from (select distinct d from lg)
        union all select s.d, n.i,
            case n.op when 'undo' then case when avail > 0 then path[1:len(path) - 1] else path end
                when 'redo' then case when len(back) > 0 then list_append(path, back[len(back)]) else path end else list_append(path, n.event_id) end,
            case n.op when 'undo' then case when avail > 0 then list_append(back, path[len(path)]) else back end
                when 'redo' then case when len(back) > 0 then back[1:len(back) - 1] else back end else []::bigint[] end,
            case n.op when 'undo' then greatest(avail - 1, 0) when 'redo' then avail + (len(back) > 0)::int else least(avail + 1, 50) end, n.op,
            case n.op when 'undo' then case when avail > 0 then path[len(path)] end when 'redo' then case when len(back) > 0 then back[len(back)] end else n.event_id end
        from s join lg n on n.d = s.d and n.i = s.i + 1),
    z as (select d, unnest(path) as event_id, generate_subscripts(path, 1) as pos from s where i = (select count(*) from lg e where e.d = s.d)),
    one as (select z.d, pos * 2 as seq, ann_id, op, case when op <> 'remove' then value end as v, case when z.event_id % 3 = 0 and op <> 'remove' then 'n' || z.event_id end as note
        from z join lg on lg.d = z.d and lg.event_id = z.event_id where not paged),
    ch as (select * from one union all select z.d, pos * 2 + k, (z.event_id + k) % 40, 'remove', null, null from z join lg on lg.d = z.d and lg.event_id = z.event_id, (values (0), (1)) t(k) where paged),
    rs as (select d, ann_id, first(op order by seq desc) as base_op, max(seq) as rat from ch where op in ('add', 'remove') group by 1, 2),
    ed as (select * from ch where op in ('add', 'update')),
    net as (select k.d, k.ann_id, rs.base_op, first(ed.v order by ed.seq desc) filter (ed.v is not null and (rs.rat is null or ed.seq >= rs.rat)) as value,
        first(ed.note order by ed.seq desc) filter (ed.note is not null and (rs.rat is null or ed.seq >= rs.rat)) as note
        from (select distinct d, ann_id from ch) k left join rs using (d, ann_id) left join ed using (d, ann_id) group by 1, 2, 3),
    names as (select distinct d, doc_id from lg)"""


@query("X1 E1", with_tables("edit", _PATHS + """
    , base as (select distinct user_id % 20 as d, event_id % 40 as ann_id, 0::double as value, 'old' as note from events where event_id % 7 = 0),
    j as (select coalesce(b.d, n.d) as d, coalesce(b.ann_id, n.ann_id) as ann_id, case when base_op = 'add' then n.value else coalesce(n.value, b.value) end as value,
        case when base_op = 'add' then n.note else coalesce(n.note, b.note) end as note
        from base b full join net n on b.d = n.d and b.ann_id = n.ann_id where base_op = 'add' or (base_op is null and b.d is not null))
    select doc_id, ann_id, value, note from j join names using (d)""", recursive=True))
def undo_annotations(spark, sf):
    """Annotations after undo and redo, over blocks of 100 events."""
    log = _log(fx.edit_events(spark, sf))
    doc = c("user_id") % 20
    base = fx.table(spark, sf, "events").filter(c("event_id") % 7 == 0).select(
        F.when(doc == 0, F.lit(None)).when(doc == 1, F.lit((1 << 60) + 1)).otherwise(doc).alias("doc_id"),
        (c("event_id") % 40).alias("ann_id"), F.lit(0.0).alias("value"), F.lit("old").alias("note")).distinct()
    return restore.annotations_after(log, _changes(log), base, ["value", "note"], block_rows=100)


_PAGE = """ select doc_id, first((case s.op when 'undo' then lg.event_id % 11 else lg.event_id % 5 end)::int order by s.i desc) as current_page
    from s join lg on lg.d = s.d and lg.event_id = s.hit where lg.paged group by s.d, doc_id"""


@query("X1", with_tables("edit", _PATHS + _PAGE, recursive=True))
def undo_page(spark, sf):
    """The page shown after undo and redo."""
    return restore.page_after(_log(fx.edit_events(spark, sf)), block_rows=100)


def _restored(spark, sf):
    log = _log(fx.edit_events(spark, sf))
    return state.run_in_batches(log, lambda s: restore.restore_stream(s, "value double, note string"), "update")


@query("X1 X7", with_tables("edit", _PATHS + " select doc_id, ann_id, value, note from net join names using (d) where base_op = 'add'", recursive=True))
def undo_annotations_stream(spark, sf):
    """The same from a stream in three batches, with a restart after each; no annotation is there at first."""
    out = _restored(spark, sf).filter("of_annotation")
    last = out.groupBy("doc_id", "ann_id").agg(F.max_by(F.struct("present", "value", "note"), "_batch").alias("r"))
    return last.filter("r.present").select("doc_id", "ann_id", "r.value", "r.note")


@query("X1 X7", with_tables("edit", _PATHS + _PAGE, recursive=True))
def undo_page_stream(spark, sf):
    out = _restored(spark, sf).filter("not of_annotation")
    last = out.groupBy("doc_id").agg(F.max_by(F.struct("current_page"), "_batch").alias("r"))
    return last.select("doc_id", "r.current_page").filter("current_page is not null")


# One user has no id, another a large one.
_USERS = "with ev as (select event_id, case user_id when 1 then null when 2 then 1152921504606846977 else user_id end as user_id, user_id as u, ts from events)"


def _users(events):
    user = c("user_id")
    return events.select("event_id", F.when(user == 1, F.lit(None)).when(user == 2, F.lit((1 << 60) + 1)).otherwise(user).cast("long").alias("user_id"), "ts")


def _plain_time(df):
    return df.withColumn("ts", c("ts").cast("timestamp_ntz"))


@query("X2", _USERS + """ select event_id, user_id, ts from (select *, lead(ts) over (partition by u order by ts, event_id) as nx from ev)
    where nx is null or nx - ts >= interval 6 hours""")
def debounce(spark, sf):
    return _plain_time(timing.debounce_batch(_users(fx.table(spark, sf, "events")), "user_id", 6 * 3600 * 1000))


@query("X2", _USERS + """ select event_id, user_id, ts from (select *, lead(ts) over (partition by u order by ts, event_id) as nx, max(ts) over () as mx from ev)
    where (nx is null or nx - ts >= interval 6 hours) and ts + interval 6 hours <= mx - interval 10 seconds""")
def debounce_stream(spark, sf):
    """Bursts that the watermark has passed when the stream ends; the open ones would follow with later events.  Three batches,
    with a restart after each."""
    out = state.run_in_batches(_users(fx.table(spark, sf, "events")), lambda s: timing.debounce_stream(s, "user_id", 6 * 3600 * 1000))
    return _plain_time(out.drop("_batch"))


_THROTTLE = _USERS.replace("with ev", "with recursive ev") + """, e as (select *, row_number() over (partition by u order by ts, event_id) as i from ev),
    p as (select u, user_id, event_id, ts, i from e where i = 1
        union all select e.u, e.user_id, e.event_id, e.ts, e.i from p join e on e.u = p.u and e.i = (select min(f.i) from e f where f.u = p.u and f.i > p.i and f.ts - p.ts >= interval 6 hours))
    select user_id, event_id, ts from p"""


@query("X3", _THROTTLE)
def throttle(spark, sf):
    """Blocks of 50 events, so that chains are followed over several."""
    e = _users(fx.table(spark, sf, "events"))
    return _plain_time(timing.throttle_batch(e, "user_id", 6 * 3600 * 1000, block_rows=50))


@query("X3", _THROTTLE)
def throttle_stream(spark, sf):
    """Three batches, with a restart after each."""
    out = state.run_in_batches(_users(fx.table(spark, sf, "events")), lambda s: timing.throttle_stream(s, "user_id", 6 * 3600 * 1000))
    return _plain_time(out.drop("_batch"))


@query("X4", """select event_id, user_id from events where ts <= timestamp '2024-01-20 12:00:00' and timestamp '2024-01-20 12:00:00' - ts < interval 2 days""")
def live_notifications(spark, sf):
    e = fx.table(spark, sf, "events").select("event_id", "user_id", "ts")
    at = F.lit("2024-01-20 12:00:00").cast("timestamp")
    return timing.live_at(e, at, 2 * 86400 * 1000).select("event_id", "user_id")


@query("X4", _USERS + """, e as (select event_id, user_id, ts, (select max(ts) from events) as mx from ev)
    select user_id, event_id, 'shown' as state from e union all
    select user_id, event_id, 'expired' from e where epoch_ms(ts) + 3000 <= epoch_ms(mx - interval 1 second)""")
def expire_stream(spark, sf):
    """Every notification is shown; those whose three seconds the watermark has passed have expired.  Three batches, with a
    restart after each."""
    return state.run_in_batches(_users(fx.table(spark, sf, "events")), timing.expire).drop("_batch")


@query("X5 T1", with_tables("opened", """
    select path, max(ts) as last_opened, first(name order by ts desc) as name from opened group by 1 order by 2 desc, 1 limit 30"""))
def recent_files_stream(spark, sf):
    import uuid

    from ..plans.settle import shared_dir

    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    name = F.concat((c("user_id") % 50).cast("string"), F.lit(".pdf"))
    opened = _stream(spark, sf).filter(c("event_type") == "view").select(
        "ts", F.concat(F.lit("/d/"), name).alias("path"), name.alias("name"))
    run = opened.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(
        state.recent_files_writer(f"{base}/out", 30)).start()
    run.awaitTermination()
    last = spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out/*")
    newest = last.agg(F.max("version")).scalar()
    return last.filter(c("version") == newest).drop("version").withColumn("last_opened", c("last_opened").cast("timestamp_ntz"))


@query("X6", with_tables("edit", _FOLD + " select doc_id, ann_id, value, note from net where base_op = 'add'"))
def annotation_state(spark, sf):
    return state.present(state.annotation_state(_edits(spark, sf), ["value", "note"]))


@query("X6 X7", with_tables("edit", _FOLD + " select doc_id, ann_id, value, note from net where base_op = 'add'"))
def annotation_state_stream(spark, sf):
    """Every event delivered twice; the repeats are dropped.  Three batches, with a restart after each."""
    e = fx.edit_events(spark, sf)
    e = e.withColumn("note", F.when((c("event_id") % 3 == 0) & (c("op") != "remove"), F.concat(F.lit("n"), c("event_id").cast("string"))))
    twice = e.withColumn("_k", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_k")
    out = state.run_in_batches(twice, lambda s: state.annotation_state(s, ["value", "note"], late="1 hour"), "update")
    last = out.groupBy("doc_id", "ann_id").agg(F.max_by(F.struct("base_op", "value", "note"), "_batch").alias("_r"))
    return state.present(last.select("doc_id", "ann_id", "_r.*"))
