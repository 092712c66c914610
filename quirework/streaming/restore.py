"""What undo and redo leave in the tables: annotations and current page after a log of edits.

An edit is a row of the log; what it changes are rows of ``changes`` (versions of annotations), and it may move to
another page.  The edits in force form a path: an edit lies one level above the state it was made in, undo goes down a
level and redo up again, and a new edit takes the place of what was above.  So a state is, for every level up to the
present one, the latest edit of that level; undo of an edit beyond the history's limit is not possible, yet the edit stays
in force.

1. The log of a document is cut into blocks.  A block's effect on cursor, history length and entries fallen out is a small
   table with a row per cursor it may start from; chaining these tables gives every block its starting state.
2. Each block is run again from that state, which gives every event its level: blocks are independent tasks.
3. The edit that an undo or redo hits is the latest edit of its level before it, found by an as-of scan over each level.
4. Edits in force meet the stored changes by event, and the latest ones of an annotation make its present version.
"""

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..operators.annotations import apply_changes
from ..plans.keys import key_back, key_text
from ..plans.scan import ordered_scan, range_chunks
from ..plans.settle import settle
from .undo import BLOCK_ROWS, HISTORY_LIMIT

SCAN_ROWS = 65_536


# -- levels of a log -----------------------------------------------------------------------------------------------


def block_effect(ops, limit=HISTORY_LIMIT):
    """``(runs, lanes)``: moves before the first edit, and for each cursor at that edit the (cursor, length, fallen out)
    at the end of the block; lanes is None when nothing is pushed."""
    first = next((i for i, op in enumerate(ops) if op not in ("undo", "redo")), len(ops))
    runs = []
    for op in ops[:first]:
        move = 1 if op == "redo" else -1
        if runs and runs[-1] * move > 0:
            runs[-1] += move
        else:
            runs.append(move)
    if first == len(ops):
        return runs, None
    cursor = np.arange(limit + 1)
    length, fallen = cursor.copy(), np.zeros(limit + 1, np.int64)
    for op in ops[first:]:
        if op == "undo":
            np.maximum(cursor - 1, 0, out=cursor)
        elif op == "redo":
            np.minimum(cursor + 1, length, out=cursor)
        else:
            fallen += cursor == limit
            np.minimum(cursor + 1, limit, out=cursor)
            length[:] = cursor
    return runs, (cursor, length, fallen)


def advance(state, runs, lanes):
    """(cursor, length, fallen out) after a block."""
    cursor, length, fallen = state
    for run in runs:
        cursor = min(max(cursor + int(run), 0), length)
    if lanes is None:
        return cursor, length, fallen
    return int(lanes[0][cursor]), int(lanes[1][cursor]), fallen + int(lanes[2][cursor])


def replay(ops, state, limit=HISTORY_LIMIT):
    """(levels, hits) of a block's events from its starting state: the level after each event, and the level of the edit
    it made, undid or redid, 0 where it did nothing."""
    cursor, length, fallen = state
    levels, hits = [], []
    for op in ops:
        hit = 0
        if op == "undo":
            if cursor:
                hit, cursor = fallen + cursor, cursor - 1
        elif op == "redo":
            if cursor < length:
                cursor += 1
                hit = fallen + cursor
        else:
            if cursor == limit:
                fallen += 1
            else:
                cursor += 1
            length = cursor
            hit = fallen + cursor
        levels.append(fallen + cursor)
        hits.append(hit)
    return levels, hits


_EFFECT = "doc string, block long, runs array<int>, cursors array<int>, lengths array<int>, fallen array<long>"


def _summary(key: tuple, pdf: pd.DataFrame, limit: int) -> pd.DataFrame:
    runs, lanes = block_effect(pdf.sort_values("i")["op"].tolist(), limit)
    sides = [None] * 3 if lanes is None else [x.tolist() for x in lanes]
    return pd.DataFrame({"doc": [key[0]], "block": [key[1]], "runs": [runs], "cursors": [sides[0]], "lengths": [sides[1]],
                         "fallen": [sides[2]]})


def _starts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Starting state of every block; the effects arrive in document and block order."""
    doc, state = None, None
    for pdf in frames:
        out = []
        for row in pdf.itertuples():
            if row.doc != doc:
                doc, state = row.doc, (0, 0, 0)
            out.append((row.doc, row.block, *state))
            state = advance(state, row.runs, None if row.cursors is None else (row.cursors, row.lengths, row.fallen))
        yield pd.DataFrame(out, columns=["doc", "block", "cursor", "length", "gone"])


def levels(log: DataFrame, block_rows=BLOCK_ROWS, limit=HISTORY_LIMIT) -> DataFrame:
    """(doc, i, event_id, op, level, hit): every event in ``(ts, event_id)`` order of its document.

    ``log`` has doc_id, ts, event_id, op; what is neither ``undo`` nor ``redo`` is an edit.  ``doc`` is the key's text
    (``plans.keys``): null is a document of its own.
    """
    keyed = log.select(key_text("doc_id").alias("doc"), "ts", "event_id", F.coalesce("op", F.lit("")).alias("op"))
    at = [F.col("ts"), F.col("event_id")]
    ranked = ordered_scan(range_chunks(keyed, ["doc"], at, "range"), ["doc"], F.col("range"), at, rank="i")
    ranked = settle(ranked.withColumn("block", F.floor(F.col("i") / block_rows)).drop("ts", "range"))
    moves = ranked.select("doc", "block", "i", "op")
    effects = moves.groupBy("doc", "block").applyInPandas(lambda key, pdf: _summary(key, pdf, limit), _EFFECT)
    starts = effects.repartition("doc").sortWithinPartitions("doc", "block").mapInPandas(
        _starts, "doc string, block long, cursor long, length long, gone long")

    def again(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        level, hit = replay(pdf["op"].tolist(), tuple(int(pdf[c].iloc[0]) for c in ("cursor", "length", "gone")), limit)
        return pd.DataFrame({"doc": key[0], "i": pdf["i"].to_numpy(), "level": level, "hit": hit})

    found = moves.join(starts, ["doc", "block"]).groupBy("doc", "block").applyInPandas(
        again, "doc string, i long, level long, hit long")
    return settle(found.join(ranked.select("doc", "i", "event_id", "op"), ["doc", "i"]))


def _is_edit():
    return ~F.col("op").isin("undo", "redo")


def hits(leveled: DataFrame) -> DataFrame:
    """(doc, i, op, target): the place of the edit that each effective event made, undid or redid.

    An as-of scan: the latest edit of the same document and level before the event.  A level that is used over and over
    is scanned in chunks.
    """
    effective = leveled.filter(F.col("hit") > 0).select("doc", "hit", "i", "op")
    made = F.when(_is_edit(), -F.col("i"))
    scanned = ordered_scan(effective, ["doc", "hit"], F.floor(F.col("i") / SCAN_ROWS), [F.col("i")], mins={"before": made})
    return scanned.select("doc", "i", "op", F.when(_is_edit(), F.col("i")).otherwise(-F.col("before")).alias("target"))


def in_force(leveled: DataFrame) -> DataFrame:
    """(doc, i, event_id) of the edits in force at the end of the log: the latest one of each level up to the last."""
    last = leveled.groupBy("doc").agg(F.max_by("level", "i").alias("last"))
    latest = leveled.filter(_is_edit()).groupBy("doc", F.col("hit").alias("level")).agg(
        F.max(F.struct("i", "event_id")).alias("e"))
    return latest.join(last, "doc").filter(F.col("level") <= F.col("last")).select("doc", "e.i", "e.event_id")


# -- tables ----------------------------------------------------------------------------------------------------------


def annotations_after(log: DataFrame, changes: DataFrame, annotations: DataFrame, fields: list[str], **how) -> DataFrame:
    """The annotation table as undo and redo leave it.

    ``changes`` has doc_id, event_id, change_no (order within an edit), ann_id, op (add, update, remove) and ``fields``; an edit
    may change any number of annotations.  Changes of edits that are undone or cut off count for nothing.
    """
    kept = in_force(levels(log, **how)).withColumnRenamed("event_id", "_event")
    ours = changes.withColumn("_doc", key_text("doc_id"))
    effective = ours.join(kept, (F.col("_doc") == F.col("doc")) & (F.col("event_id") == F.col("_event")))
    whole = annotations.withColumn("_doc", key_text("doc_id"))
    kind = annotations.schema["doc_id"].dataType
    out = apply_changes(whole, effective.select("_doc", "ann_id", "i", "change_no", "op", *fields), fields,
                        ("_doc", "ann_id"), ("i", "change_no"))
    # Added annotations have no row in the old table, so their document comes from its text.
    return out.withColumn("doc_id", key_back("_doc", kind)).select(annotations.columns)


def page_after(log: DataFrame, **how) -> DataFrame:
    """(doc_id, current_page): the page that the last effective event with a page leads to.

    The log has page_before and page_after for edits of pages (both null for others).  Making or redoing such an edit shows
    its later page, undoing it the earlier one (page 0 where none is given).  Documents without such an event have none.
    """
    leveled = levels(log, **how)
    paged = log.filter(F.col("page_before").isNotNull() | F.col("page_after").isNotNull()).select(
        key_text("doc_id").alias("doc"), "event_id", "page_before", "page_after")
    edits = leveled.filter(_is_edit()).select("doc", "event_id", F.col("i").alias("target")).join(paged, ["doc", "event_id"])
    shown = hits(leveled).join(edits.drop("event_id"), ["doc", "target"])
    page = F.coalesce(F.when(F.col("op") == "undo", F.col("page_before")).otherwise(F.col("page_after")), F.lit(0))
    last = shown.groupBy("doc").agg(F.max_by(page, "i").alias("current_page"))
    return last.select(key_back("doc", log.schema["doc_id"].dataType).alias("doc_id"), "current_page")


# -- stream ----------------------------------------------------------------------------------------------------------


class RestoreProcessor(StatefulProcessor):
    """History of a document with what each entry changed, and its annotations.

    An entry keeps the values before and after it of the annotations it changed; undo and redo put them back.  The state is
    the last ``limit`` entries and one value per annotation, however long the log.
    """

    def __init__(self, fields, limit):
        self.fields, self.limit = fields, limit

    def init(self, handle) -> None:
        self.past = handle.getValueState("past", "cursor INT, entries ARRAY<STRING>, page INT")
        self.anns = handle.getMapState("anns", "ann_id STRING", "fields STRING")

    def _put(self, ann, value):
        self.held[ann] = value

    def _now(self, ann):
        if ann not in self.held:
            self.held[ann] = json.loads(self.anns.getValue((ann,))[0]) if self.anns.containsKey((ann,)) else None
        return self.held[ann]

    def _store(self):
        """Write what the batch's annotations have become, each once: a call to the store costs far more than an edit."""
        for ann, value in self.held.items():
            if value is not None:
                self.anns.updateValue((ann,), (json.dumps(value),))
            elif self.anns.containsKey((ann,)):
                self.anns.removeKey((ann,))

    def _edit(self, row):
        entry = {"page": [None if pd.isna(v) else int(v) for v in (row.page_before, row.page_after)], "anns": {}}
        for change in json.loads(row.changes or "[]"):
            ann, op = change["ann"], change["op"]
            old = self._now(ann)
            given = {f: change.get(f) for f in self.fields}
            new = old
            if op == "add":
                new = given
            elif op == "update" and old is not None:
                new = {f: old[f] if given[f] is None else given[f] for f in self.fields}
            elif op == "remove":
                new = None
            self._put(ann, new)
            entry["anns"].setdefault(ann, [old, None])[1] = new
        return entry

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        cursor, entries, page = self.past.get() if self.past.exists() else (0, [], None)
        entries = [json.loads(e) for e in entries]
        touched, self.held = set(), {}
        frames = [f for f in rows if len(f)]
        for row in pd.concat(frames).sort_values(["ts", "event_id"]).itertuples() if frames else ():
            if row.op == "undo" or row.op == "redo":
                side = 0 if row.op == "undo" else 1
                at = cursor - 1 + side
                if not 0 <= at < len(entries):
                    continue
                entry, cursor = entries[at], at + side
                for ann, both in entry["anns"].items():
                    self._put(ann, both[side])
            else:
                side, entry = 1, self._edit(row)
                entries = (entries[:cursor] + [entry])[-self.limit:]
                cursor = len(entries)
            touched.update(entry["anns"])
            if entry["page"] != [None, None]:
                page = entry["page"][side] or 0
        self._store()
        self.past.update((cursor, [json.dumps(e) for e in entries], page))
        out = [(key[0], None, None, page)] + [(key[0], ann, None if (v := self._now(ann)) is None else json.dumps(v), page) for ann in sorted(touched)]
        yield pd.DataFrame(out, columns=["doc", "ann", "fields", "page"], dtype=object)

    def close(self) -> None:
        pass


def restore_stream(log: DataFrame, fields: str, late="10 minutes", deduplicate=True, limit=HISTORY_LIMIT) -> DataFrame:
    """(doc_id, ann_id, present, fields..., current_page) of what each micro-batch changed; a row without ann_id tells the page.

    ``log`` is a stream with doc_id, ts, event_id, op, page_before, page_after and ``changes``, an array of structs (ann_id, op,
    fields...); ``fields`` is their schema.  The store is empty at first.  Across micro-batches a document's events must arrive in order.
    """
    kinds = _parse_datatype_string(fields)
    names = [f.name for f in kinds.fields]
    pairs = F.transform("changes", lambda x: F.struct(
        key_text(x["ann_id"]).alias("ann"), x["op"].alias("op"), *[x[n].alias(n) for n in names]))
    if deduplicate:
        log = log.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    flat = log.select(key_text("doc_id").alias("doc"), "ts", "event_id", F.coalesce("op", F.lit("")).alias("op"),
                      "page_before", "page_after", F.to_json(pairs).alias("changes"))
    out = flat.groupBy("doc").transformWithStateInPandas(
        statefulProcessor=RestoreProcessor(names, limit),
        outputStructType="doc STRING, ann STRING, fields STRING, page INT", outputMode="Update", timeMode="None")
    ann_kind = log.schema["changes"].dataType.elementType["ann_id"].dataType
    value = F.from_json("fields", StructType([StructField(f.name, f.dataType) for f in kinds.fields]))
    return out.select(
        key_back("doc", log.schema["doc_id"].dataType).alias("doc_id"), F.col("ann").isNotNull().alias("of_annotation"),
        key_back("ann", ann_kind).alias("ann_id"), F.col("fields").isNotNull().alias("present"),
        *[value[n].alias(n) for n in names], F.col("page").alias("current_page"))
