"""Edit logs against a plain fold; streams in several batches against the whole table."""

import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from quirework.streaming import restore, state, timing, undo

START = datetime(2024, 1, 1)


def log(n, docs, seed=1, step_ms=700):
    rng = random.Random(seed)
    ops = ["push"] * 5 + ["undo"] * 4 + ["redo"] * 2
    return [(i, START + timedelta(milliseconds=i * step_ms), rng.choice(docs), rng.choice(ops)) for i in range(n)]


def fold(events):
    out = {}
    for i, _, doc, op in events:
        history, cursor = out.get(doc, ([], 0))
        cursor = undo.step(history, cursor, op, i)
        out[doc] = (history, cursor)
    return {d: (c, h) for d, (h, c) in out.items()}


SCHEMA = "event_id long, ts timestamp, doc_id long, op string"


def got(df):
    return {r.doc_id: (r.cursor, list(r.history)) for r in df.collect()}


def test_history_limit_and_ends():
    history, cursor = [], 0
    assert undo.step(history, cursor, "undo", 0) == 0 and undo.step(history, cursor, "redo", 0) == 0
    for i in range(51):
        cursor = undo.step(history, cursor, "push", i)
    assert (len(history), cursor, history[0]) == (50, 50, 1)
    cursor = undo.step(history, cursor, "undo", 99)
    cursor = undo.step(history, cursor, "push", 100)
    assert (cursor, history[-2:]) == (50, [49, 100])


def test_blocks_chain_to_the_whole_fold(spark):
    # Document 1 holds most events, so that its log is cut into many blocks.
    events = log(4000, [1] * 6 + [2, 3])
    df = spark.createDataFrame(events, SCHEMA).repartition(5)
    for block in (37, 1000, 100000):
        assert got(undo.undo_redo_batch(df, block)) == fold(events)


def test_any_event_ids_and_limits(spark):
    """Ids below zero are as good as others, in one block and in several; the limit is the caller's."""
    events = [(-i * 7 + 3, t, d, op) for i, t, d, op in log(600, [1, 1, 2])]
    events.sort(key=lambda e: (e[1], e[0]))
    df = spark.createDataFrame(events, SCHEMA).repartition(3)
    for block in (29, 100000):
        assert got(undo.undo_redo_batch(df, block)) == fold(events)
    short = {r.doc_id: r.history_length for r in undo.undo_redo_batch(df, 29, limit=5).collect()}
    assert max(short.values()) <= 5
    whole = {r.doc_id: r.history for r in undo.undo_redo_batch(df, 100000, limit=5).collect()}
    assert {r.doc_id: r.history for r in undo.undo_redo_batch(df, 29, limit=5).collect()} == whole


def test_only_moves_in_a_block(spark):
    events = [(i, START + timedelta(seconds=i), 1, op) for i, op in enumerate(["push"] * 3 + ["undo"] * 9 + ["redo"] * 2 + ["undo"])]
    assert got(undo.undo_redo_batch(spark.createDataFrame(events, SCHEMA), 2)) == fold(events)


def test_undo_stream_over_several_batches(spark, tmp_path):
    events = log(300, [1, 2])
    for k in range(3):
        part = events[k * 100:(k + 1) * 100]
        # Every batch repeats the last events of the one before.
        part = (events[max(0, k * 100 - 5):k * 100]) + part
        pd.DataFrame(part, columns=["event_id", "ts", "doc_id", "op"]).to_parquet(tmp_path / f"p{k}.parquet", coerce_timestamps="us")
    stream = spark.readStream.schema("event_id long, ts timestamp_ntz, doc_id long, op string").option(
        "maxFilesPerTrigger", 1).parquet(str(tmp_path)).withColumn("ts", F.col("ts").cast("timestamp"))
    out = state.run_to_end(undo.undo_redo_stream(stream), "update")
    cols = [c for c in out.columns if c not in ("doc_id", "_batch")]
    last = out.groupBy("doc_id").agg(F.max_by(F.struct(*cols), "_batch").alias("r")).select("doc_id", "r.*")
    assert out.select("_batch").distinct().count() == 3
    assert got(last) == fold(events)


def test_throttle_and_debounce(spark):
    rng = random.Random(2)
    at, events = 0, []
    for i in range(2000):
        at += rng.choice([0, 1, 2, 3, 4, 6, 40])
        events.append((i, START + timedelta(milliseconds=at), 1, "x"))
    df = spark.createDataFrame(events, SCHEMA)
    want, last = [], None
    for i, ts, _, _ in events:
        if last is None or ts - last >= timedelta(milliseconds=5):
            want.append(i)
            last = ts
    assert sorted(r.event_id for r in timing.throttle_batch(df, "doc_id").collect()) == want
    ends = [a[0] for a, b in zip(events, events[1:] + [None]) if b is None or b[1] - a[1] >= timedelta(milliseconds=30)]
    assert sorted(r.event_id for r in timing.debounce_batch(df, "doc_id", 30).collect()) == ends


def test_recents_over_batches(spark, tmp_path):
    write = state.recent_files_writer(str(tmp_path / "out"), k=2)
    cols = "path string, name string, ts timestamp"
    write(spark.createDataFrame([("a", "A", START), ("b", "B", START + timedelta(1))], cols), 0)
    second = spark.createDataFrame([("c", "C", START + timedelta(2)), ("a", "A", START + timedelta(3))], cols)
    write(second, 1)
    write(second, 1)
    assert [r.path for r in spark.read.parquet(str(tmp_path / "out" / "version=1")).orderBy(F.desc("last_opened")).collect()] == ["a", "c"]


BIG = (1 << 60) + 1


def test_null_and_large_documents(spark):
    """A null document is one document; a large id beside it stays as it is, in the table and in the stream."""
    events = log(400, [None, BIG, None, 3])
    df = spark.createDataFrame(events, SCHEMA).repartition(3)
    for block in (31, 100000):
        assert got(undo.undo_redo_batch(df, block)) == fold(events)
    out = state.run_in_batches(df, undo.undo_redo_stream, "update")
    cols = [c for c in out.columns if c not in ("doc_id", "_batch")]
    last = out.groupBy("doc_id").agg(F.max_by(F.struct(*cols), "_batch").alias("r")).select("doc_id", "r.*")
    assert got(last) == fold(events)


def test_null_and_large_users_in_throttle(spark):
    events = [(i, START + timedelta(milliseconds=2 * i), None if i % 2 else BIG, "x") for i in range(12)]
    df = spark.createDataFrame(events, SCHEMA)
    # A user's events are 4 ms apart, so every second one passes.
    want = {(u, i) for i, _, u, _ in events if (i // 2) % 2 == 0}
    assert {(r.doc_id, r.event_id) for r in timing.throttle_batch(df, "doc_id", 5).collect()} == want
    out = state.run_in_batches(df, lambda s: timing.throttle_stream(s, "doc_id", 5))
    assert {(r.doc_id, r.event_id) for r in out.collect()} == want


def throttled(events, millis):
    want, last = set(), {}
    for i, ts, doc, _ in sorted((e for e in events if e[1] is not None), key=lambda e: (e[1], e[0])):
        if doc not in last or ts - last[doc] >= timedelta(milliseconds=millis):
            want.add(i)
            last[doc] = ts
    return want


def test_throttle_follows_chains_over_blocks(spark):
    rng = random.Random(7)
    events, at = [], {1: 0, 2: 0, None: 0}
    for i in range(3000):
        doc = rng.choice([1, 1, 1, 2, None])
        at[doc] += rng.choice([0, 0, 1, 2, 3, 4, 40]) if doc != 2 else 1
        events.append((i, START + timedelta(milliseconds=at[doc]), doc, "x"))
    events.append((9999, None, 1, "x"))
    df = spark.createDataFrame(events, SCHEMA).repartition(4)
    for millis, block in ((5, 10), (5, 333), (17, 7), (900, 50), (5, 100000)):
        assert {r.event_id for r in timing.throttle_batch(df, "doc_id", millis, block_rows=block).collect()} == throttled(events, millis)
    assert timing.throttle_batch(df.limit(0), "doc_id", 5).count() == 0
    assert timing.throttle_batch(df, "doc_id", 0).count() == 3000


def test_throttle_spreads_one_long_run(spark):
    """One key whose events all lie within the gap of their neighbours: no task gets more than a block of them."""
    n = 200_000
    df = spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_micros(F.col("id") * 1000).alias("ts"), F.lit(1).alias("k"))
    out = timing.throttle_batch(df, "k", 5, block_rows=10_000)
    assert out.agg(F.count("*"), F.max("event_id")).first() == (n // 5, n - 5)


def restored(events, changes, base, limit=50):
    """Snapshots of the whole store, put back and forth."""
    docs = {}
    for (doc, ann), value in base.items():
        docs.setdefault(doc, [{}, [], 0, None])[0][ann] = dict(value)
    for i, _, doc, op, before, after in events:
        store, past, cursor, page = docs.setdefault(doc, [{}, [], 0, None])
        if op == "undo":
            if cursor:
                cursor -= 1
                old, _, pages = past[cursor]
                store, page = dict(old), page if pages == (None, None) else pages[0] or 0
        elif op == "redo":
            if cursor < len(past):
                _, new, pages = past[cursor]
                cursor += 1
                store, page = dict(new), page if pages == (None, None) else pages[1] or 0
        else:
            new = dict(store)
            for ann, kind, v, note in changes.get(i, []):
                if kind == "add":
                    new[ann] = {"v": v, "note": note}
                elif kind == "update" and ann in new:
                    new[ann] = {"v": new[ann]["v"] if v is None else v, "note": new[ann]["note"] if note is None else note}
                elif kind == "remove":
                    new.pop(ann, None)
            past = (past[:cursor] + [(store, new, (before, after))])[-limit:]
            store, cursor = new, len(past)
            page = page if (before, after) == (None, None) else after or 0
        docs[doc] = [store, past, cursor, page]
    rows = {(d, a, x["v"], x["note"]) for d, s in docs.items() for a, x in s[0].items()}
    return rows, {(d, s[3]) for d, s in docs.items() if s[3] is not None}


def edits(n, docs, seed):
    rng = random.Random(seed)
    events, changes = [], {}
    for i in range(n):
        op = rng.choice(["push"] * 5 + ["undo"] * 4 + ["redo"] * 2 + [None] * (i % 50 == 0))
        paged = op not in ("undo", "redo") and rng.random() < 0.2
        pages = (rng.choice([None, 1, 2]), rng.choice([3, 4])) if paged else (None, None)
        events.append((i, START + timedelta(seconds=i // 2), rng.choice(docs), op, *pages))
        if op not in ("undo", "redo"):
            changes[i] = [(rng.randrange(8), rng.choice(["add", "update", "update", "remove"]), rng.choice([None, 0.5, float(i)]),
                           rng.choice([None, f"n{i}"])) for _ in range(rng.choice([0, 1, 1, 3]))]
    return events, changes


def test_restored_annotations_and_page(spark):
    docs = [1, 1, 1, 1, None, BIG]
    events, changes = edits(900, docs, 5)
    where = {e[0]: e[2] for e in events}
    base = {(d, a): {"v": -1.0, "note": "old"} for d in set(docs) for a in (0, 3, 5)}
    table = spark.createDataFrame([(d, a, v["v"], v["note"], "kept") for (d, a), v in base.items()], "doc_id long, ann_id long, v double, note string, other string")
    df = spark.createDataFrame(events, SCHEMA + ", page_before int, page_after int").repartition(4)
    flat = spark.createDataFrame([(where[i], i, k, *c) for i, cs in changes.items() for k, c in enumerate(cs)],
                                 "doc_id long, event_id long, change_no int, ann_id long, op string, v double, note string")
    for block, limit in ((23, 50), (100000, 50), (11, 4)):
        want, pages = restored(events, changes, base, limit)
        out = restore.annotations_after(df, flat, table, ["v", "note"], block_rows=block, limit=limit)
        assert {(r.doc_id, r.ann_id, r.v, r.note) for r in out.collect()} == want
        assert {tuple(r) for r in restore.page_after(df, block_rows=block, limit=limit).collect()} == pages
    # Nothing logged: the table as it was, and no page.
    none = df.limit(0)
    assert restore.annotations_after(none, flat, table, ["v", "note"]).exceptAll(table).count() == 0
    assert restore.page_after(none).count() == 0


def test_restored_from_a_stream(spark):
    events, changes = edits(300, [1, None, BIG], 9)
    kind = SCHEMA + ", page_before int, page_after int, changes array<struct<ann_id: long, op: string, v: double, note: string>>"
    df = spark.createDataFrame([(*e, changes.get(e[0])) for e in events], kind)
    out = state.run_in_batches(df, lambda s: restore.restore_stream(s, "v double, note string", limit=6), "update", batches=4)
    want, pages = restored(events, changes, {}, 6)
    anns = out.filter("of_annotation").groupBy("doc_id", "ann_id").agg(F.max_by(F.struct("present", "v", "note"), "_batch").alias("r"))
    assert {(r.doc_id, r.ann_id, r.r.v, r.r.note) for r in anns.filter("r.present").collect()} == want
    last = out.filter("not of_annotation").groupBy("doc_id").agg(F.max_by(F.struct("current_page"), "_batch").alias("r"))
    assert {(r.doc_id, r.r.current_page) for r in last.collect() if r.r.current_page is not None} == pages
    assert out.select("_batch").distinct().count() >= 4


class _Store:
    """State of one key that counts its calls."""

    def __init__(self):
        self.kept, self.timers, self.calls = {}, set(), 0

    def getMapState(self, *_):
        return self

    def containsKey(self, k):
        self.calls += 1
        return k in self.kept

    def getValue(self, k):
        self.calls += 1
        return self.kept[k]

    def updateValue(self, k, v):
        self.calls += 1
        self.kept[k] = v

    def removeKey(self, k):
        self.calls += 1
        del self.kept[k]

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


def test_expiry_calls_the_state_per_batch():
    """10,000 notifications of a user with different ends: a few calls for their arrival and for every end of a batch."""
    from types import SimpleNamespace as Plain

    rng, p, store = random.Random(4), timing.ExpiryProcessor(3000), _Store()
    p.init(store)
    at = rng.sample(range(100_000), 10_000)
    shown = []
    for part in (range(6000), range(6000, 10_000)):
        shown += list(p.handleInputRows(("=1",), [pd.DataFrame({"event_id": list(part), "us": [at[i] * 1000 for i in part]})], None))
    assert sorted(pd.concat(shown)["event_id"]) == list(range(10_000))
    gone = set()
    for mark in (2_000, 50_000, 50_001, 103_000):
        fired = sorted(t for t in store.timers if t <= mark)
        while fired:
            t = fired.pop(0)
            store.timers.remove(t)
            for out in p.handleExpiredTimer(("=1",), Plain(getCurrentWatermarkInMs=lambda: mark), Plain(getExpiryTimeInMs=lambda: t)):
                assert not gone & set(out["event_id"])
                gone |= set(out["event_id"])
        assert gone == {i for i in range(10_000) if at[i] + 3000 <= mark}
    assert not store.kept and store.calls < 60


def test_expiry_over_batches(spark):
    """Ends at the watermark itself, several users and ends of one moment, three batches with a restart after each."""
    rng = random.Random(5)
    late = 90_000
    millis = sorted([rng.randrange(late) for _ in range(200)] + [late - 4000] * 3 + [late - 3999, late - 4001, late])
    data = [(i, rng.choice([None, 1, 2]), START + timedelta(milliseconds=m)) for i, m in enumerate(millis)]
    out = state.run_in_batches(spark.createDataFrame(data, "event_id long, user_id long, ts timestamp"), timing.expire)
    found = [(r.event_id, r.state, r.user_id) for r in out.collect()]
    want = [(i, "shown", u) for i, u, _ in data] + [(i, "expired", data[i][1]) for i, m in enumerate(millis) if m + 4000 <= late]
    assert len(found) == len(want)
    assert set(found) == set(want)


def test_throttle_takes_many_small_blocks_at_once(spark, monkeypatch):
    """Blocks of a few events: no call of Python for each of them, and blocks whose times lie far apart keep apart."""
    def refuse(*_, **__):
        raise AssertionError("one call for each block")

    import pyspark.sql.group as group

    monkeypatch.setattr(group.GroupedData, "applyInPandas", refuse)
    monkeypatch.setattr(group.GroupedData, "cogroup", refuse)
    rng = random.Random(3)
    day = 86_400_000
    events = [(i, START + timedelta(milliseconds=rng.choice([0, 3000 * day]) + rng.randrange(600)), rng.choice([*range(30), None]), "x") for i in range(2000)]
    df = spark.createDataFrame(events, SCHEMA).repartition(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for millis, block in ((5, 3), (40, 1), (200, 11)):
            assert {r.event_id for r in timing.throttle_batch(df, "doc_id", millis, block_rows=block).collect()} == throttled(events, millis)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_restoring_calls_the_state_per_batch():
    """5,000 edits, undos and redos of two annotations: a few calls for each batch, and the store as it should be after it."""
    import json

    class Both(_Store):
        def getValueState(self, *_):
            return self.past

    store = Both()
    store.past = type("Past", (), {"now": None, "exists": lambda s: s.now is not None, "get": lambda s: s.now,
                                   "update": lambda s, v: setattr(s, "now", v)})()
    p = restore.RestoreProcessor(["v"], 50)
    p.init(store)
    rng = random.Random(6)
    rows, want, history, cursor = [], {}, [], 0
    for i in range(5000):
        op = rng.choice(["add", "update", "remove", "undo", "redo"])
        ann = rng.choice("ab")
        rows.append((START + timedelta(milliseconds=i), i, op, None, None,
                     None if op in ("undo", "redo") else json.dumps([{"ann": ann, "op": op, "v": i}])))
        if op == "undo" or op == "redo":
            at = cursor - 1 if op == "undo" else cursor
            if 0 <= at < len(history):
                cursor = at if op == "undo" else at + 1
                a, old, new = history[at]
                want[a] = old if op == "undo" else new
        else:
            old = want.get(ann)
            new = {"add": i, "update": None if old is None else i, "remove": None}[op]
            want[ann] = new
            history = (history[:cursor] + [(ann, old, new)])[-50:]
            cursor = len(history)
        if i % 1000 == 999:
            pdf = pd.DataFrame(rows, columns=["ts", "event_id", "op", "page_before", "page_after", "changes"], dtype=object)
            list(p.handleInputRows(("=1",), [pdf], None))
            rows = []
            assert {k[0]: json.loads(v[0])["v"] for k, v in store.kept.items()} == {a: v for a, v in want.items() if v is not None}
    assert store.calls < 60
