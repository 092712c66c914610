"""Undo / redo as a fold over the edit log of each document.

An edit pushes its event, cutting off what could be redone; at most 50 events are kept, the oldest falls out.  Undo
and redo move a cursor and do nothing at the ends.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..plans.keys import key_back, key_text
from ..plans.scan import ordered_scan, range_chunks

# Fixed value.
HISTORY_LIMIT = 50
BLOCK_ROWS = 20_000
RESULT = (
    "doc_id STRING, cursor INT, history_length INT, undo_event BIGINT, redo_event BIGINT, pushes BIGINT, "
    "history ARRAY<BIGINT>"
)


def step(history, cursor, op, event_id, limit=HISTORY_LIMIT):
    """State after one event; ``history`` is changed in place."""
    if op == "undo":
        return max(cursor - 1, 0)
    if op == "redo":
        return min(cursor + 1, len(history))
    del history[cursor:]
    history.append(event_id)
    if len(history) > limit:
        del history[0]
    return len(history)


def _result(doc_id, history, cursor, pushes):
    return {
        "doc_id": doc_id, "cursor": cursor, "history_length": len(history),
        "undo_event": history[cursor - 1] if cursor else None,
        "redo_event": history[cursor] if cursor < len(history) else None, "pushes": pushes, "history": list(history),
    }


def _with_keys(result: DataFrame, events: DataFrame) -> DataFrame:
    """In Python a document goes by its key's text, as null is a document of its own and large ids must not change."""
    return result.withColumn("doc_id", key_back("doc_id", events.schema["doc_id"].dataType))


# -- batch ---------------------------------------------------------------------------------------------------
#
# A document's log is cut into blocks of BLOCK_ROWS events.  The effect of a block on any state it may start from
# is small: before its first push only the cursor moves, and what follows the first push depends on the cursor
# alone.  So each block is folded once for every possible cursor (0..limit), side by side, into a table; chaining the
# tables of a document gives its final state.  Kept old entries appear in the tables by their places.


def fold_block(ops, limit=HISTORY_LIMIT):
    """Effect of a block: ``(moves before the first push, lanes)``; a lane per cursor at the first push.

    A lane is ``(cursor, history)`` at the end of the block.  A history entry from zero on is the number of an event of
    the block; one below zero is an old place (``-1`` is the first).  ``lanes`` is None when nothing is pushed.
    """
    first = next((i for i, op in enumerate(ops) if op not in ("undo", "redo")), len(ops))
    moves = [1 if op == "redo" else -1 for op in ops[:first]]
    if first == len(ops):
        return moves, None
    n_lanes = limit + 1
    table = np.zeros((n_lanes, limit + 1), np.int64)
    table[:, :limit] = -np.arange(1, limit + 1)
    cursor = np.arange(n_lanes)
    length = cursor.copy()
    rows = np.arange(n_lanes)
    for event, op in enumerate(ops[first:], first):
        if op == "undo":
            np.maximum(cursor - 1, 0, out=cursor)
        elif op == "redo":
            np.minimum(cursor + 1, length, out=cursor)
        else:
            full = cursor == limit
            if full.any():
                table[full, :limit - 1] = table[full, 1:limit]
                cursor[full] -= 1
            table[rows, cursor] = event
            cursor += 1
            length[:] = cursor
    return moves, (cursor, length, table)


def _pack(moves, lanes, ids, limit):
    # Runs of equal moves clamp like their single steps.
    runs = []
    for m in moves:
        if runs and runs[-1] * m > 0:
            runs[-1] += m
        else:
            runs.append(m)
    if lanes is None:
        return runs, None, None, None, None
    cursor, length, table = lanes
    flat = table[:, :limit].ravel()
    old = flat < 0
    return (runs, cursor.tolist(), length.tolist(), np.where(old, 0, np.asarray(ids, np.int64)[np.where(old, 0, flat)]).tolist(),
            np.where(old, -flat, 0).tolist())


_BLOCK = "doc_id STRING, block BIGINT, pushes BIGINT, runs ARRAY<INT>, cursors ARRAY<INT>, lengths ARRAY<INT>, entries ARRAY<BIGINT>, places ARRAY<BIGINT>"


def _fold(key: tuple, pdf: pd.DataFrame, limit: int) -> pd.DataFrame:
    pdf = pdf.sort_values("_i")
    ops, ids = pdf["op"].tolist(), pdf["event_id"].tolist()
    runs, cursors, lengths, entries, places = _pack(*fold_block(ops, limit), ids, limit)
    pushes = sum(op not in ("undo", "redo") for op in ops)
    return pd.DataFrame({
        "doc_id": [key[0]], "block": [key[1]], "pushes": [pushes], "runs": [runs], "cursors": [cursors],
        "lengths": [lengths], "entries": [entries], "places": [places]})


def _advance(row, history, cursor, pushes):
    """State after a block, from its table."""
    for run in row.runs:
        cursor = min(max(cursor + int(run), 0), len(history))
    if row.cursors is not None:
        width = len(row.entries) // len(row.cursors)
        at = slice(cursor * width, cursor * width + int(row.lengths[cursor]))
        history = [history[int(p) - 1] if p else int(e) for e, p in zip(row.entries[at], row.places[at])]
        cursor = int(row.cursors[cursor])
    return history, cursor, pushes + int(row.pushes)


def _chain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chain block tables that arrive in document and block order; only one state is held."""
    doc, state = None, None
    for pdf in frames:
        out = []
        for row in pdf.itertuples():
            if row.doc_id != doc:
                if doc is not None:
                    out.append(_result(doc, *state))
                doc, state = row.doc_id, ([], 0, 0)
            state = _advance(row, *state)
        if out:
            yield pd.DataFrame(out, dtype=object)
    if doc is not None:
        yield pd.DataFrame([_result(doc, *state)], dtype=object)


def undo_redo_batch(events: DataFrame, block_rows=BLOCK_ROWS, limit=HISTORY_LIMIT) -> DataFrame:
    """Final history of every document from its whole log, in ``(ts, event_id)`` order; ``limit`` entries are kept.

    A task holds one block of events, or streams through block tables; a log of any length is spread.
    """
    at = [F.col("ts"), F.col("event_id")]
    named = events.select(key_text("doc_id").alias("doc_id"), "ts", "event_id", "op")
    ranked = ordered_scan(range_chunks(named, ["doc_id"], at, "_range"), ["doc_id"], F.col("_range"), at, rank="_i")
    blocks = ranked.withColumn("block", F.floor(F.col("_i") / block_rows))
    folded = blocks.groupBy("doc_id", "block").applyInPandas(lambda key, pdf: _fold(key, pdf, limit), _BLOCK)
    chained = folded.repartition("doc_id").sortWithinPartitions("doc_id", "block").mapInPandas(_chain, RESULT)
    return _with_keys(chained, events)


# -- stream --------------------------------------------------------------------------------------------------


class UndoProcessor(StatefulProcessor):
    """History and cursor of one document; the events of a micro-batch are taken in ``(ts, event_id)`` order."""

    def __init__(self, limit=HISTORY_LIMIT):
        self.limit = limit

    def init(self, handle) -> None:
        self.state = handle.getValueState("undo", "history ARRAY<BIGINT>, cursor INT, pushes BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get() if self.state.exists() else ([], 0, 0)
        history, cursor, pushes = list(old[0]), old[1], old[2]
        for row in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():
            cursor = step(history, cursor, row.op, int(row.event_id), self.limit)
            pushes += row.op not in ("undo", "redo")
        self.state.update((history, cursor, pushes))
        yield pd.DataFrame([_result(key[0], history, cursor, pushes)])

    def close(self) -> None:
        pass


def undo_redo_stream(events: DataFrame, late="10 minutes", deduplicate=True, limit=HISTORY_LIMIT) -> DataFrame:
    """History per document after every micro-batch.

    Repeated deliveries of an event within ``late`` are dropped first.  Across micro-batches a document's events
    must arrive in order (a log partitioned by document does that).
    """
    if deduplicate:
        events = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    named = events.withColumn("doc_id", key_text("doc_id"))
    folded = named.groupBy("doc_id").transformWithStateInPandas(
        statefulProcessor=UndoProcessor(limit), outputStructType=RESULT, outputMode="Update", timeMode="None")
    return _with_keys(folded, events)

