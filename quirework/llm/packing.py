"""Vector bin packing of token pieces into sequences with limits on tokens, segments and loss-bearing tokens."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, "
          "sequence_id long, offset long")
_ARROW = pa.schema([(f.split()[0], pa.int64()) for f in SCHEMA.split(", ")])


class Packer:
    """Packs one task's pieces.  ``put`` takes (key, start, tokens, first loss-bearing token); ``emit`` gets
    (key, start, length, loss tokens, sequence number, offset)."""

    def __init__(self, emit, tokens: int, segments: int, loss: int, pool: int):
        self.emit, self.limits, self.pool = emit, np.array([tokens, segments, loss], float), pool
        self.items, self.count = [], 0

    def _close(self, pieces):
        offset = 0
        for key, start, length, loss in pieces:
            self.emit(key, start, length, loss, self.count, offset)
            offset += length
        self.count += 1

    def put(self, key, start, length, free):
        """``free``: how many of these leading tokens bear no loss."""
        size, most = int(self.limits[0]), int(self.limits[2])
        while length >= size and size - min(free, size) <= most:
            self._close([(key, start, size, size - min(free, size))])
            start, length, free = start + size, length - size, max(0, free - size)
        while length:  # the rest, cut so that each piece fits an empty sequence
            take = min(length, size, min(free, length) + most)
            self.items.append((key, start, take, take - min(free, take)))
            start, length, free = start + take, length - take, max(0, free - take)
            if len(self.items) >= self.pool:
                self.pack(keep=True)

    def pack(self, keep):
        """Fill sequences from the pool by the dot-product rule: of the pieces that fit, the one whose needs point
        most along what is left.  When none fits whole, the one that points most along it is cut to fit.  With
        ``keep``, a last sequence that the pool can't fill waits for more pieces."""
        items = self.items
        need = np.array([(n, 1, loss) for _, _, n, loss in items], float).reshape(-1, 3)
        there = np.ones(len(items), bool)
        while there.any():
            if keep and need[there, 0].sum() < self.limits[0]:
                break
            left, pieces = self.limits.copy(), []
            while left[0] >= 1 and left[1] >= 1 and there.any():
                along = (need / self.limits) @ (left / self.limits)
                fits = there & (need <= left).all(axis=1)
                if fits.any():
                    k = int(np.where(fits, along, -1).argmax())
                    key, start, n, loss = items[k]
                    there[k] = False
                else:
                    k = int(np.where(there, along, -1).argmax())
                    key, start, whole, borne = items[k]
                    free = whole - borne
                    n = int(min(left[0], whole, free + left[2]))
                    if n < 1:
                        break
                    loss = n - min(free, n)
                    rest = (key, start + n, whole - n, borne - loss)
                    items[k], need[k] = rest, (rest[2], 1, rest[3])
                    there[k] = rest[2] > 0
                pieces.append((key, start, n, loss))
                left -= (n, 1, loss)
            total = sum(p[2] for p in pieces)
            if not keep and not there.any() and total < self.limits[0]:
                self._powers(pieces, total)
            else:
                self._close(pieces)
        self.items = [x for x, t in zip(items, there) if t]

    def _powers(self, pieces, total):
        """The task's last, short sequence as sequences whose lengths are powers of two, which need no padding."""
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            now = []
            while room:
                key, start, n, loss = pieces[0]
                take = min(n, room)
                borne = take - min(n - loss, take)
                now.append((key, start, take, borne))
                room -= take
                if take == n:
                    pieces.pop(0)
                else:
                    pieces[0] = (key, start + take, n - take, loss - borne)
            self._close(now)


def pack(docs: DataFrame, vocabulary: str, end_id: int, spaced: bool, tokens: int = 2048, segments: int = 256,
         loss: int | None = None, prompt: str | None = None, pool: int = 2048) -> DataFrame:
    """One row per piece of a document's tokens (its text's ids, then ``end_id``) with its place in a sequence.

    ``tokens``, ``segments`` and ``loss`` limit a sequence's length, its pieces and its loss-bearing tokens (default:
    all may bear loss); ``prompt`` names a column with the number of leading tokens that bear none (null or none: 0).
    Every task packs the documents it reads, ``pool`` pieces at a time, and numbers its sequences from its partition's
    number times 2**40, so no shuffle is needed and a repeated task gives the same rows.  Full stretches of a
    document are sequences of their own; at a task's end what is left makes sequences of power-of-two lengths.
    Null text: the end id alone.  Null ids are kept, repeated rows are packed each, an empty table gives no rows.
    """
    most = tokens if loss is None else loss
    lead = F.col(prompt).cast("long") if prompt else F.lit(0).cast("long")
    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(lead, F.lit(0)).alias("lead"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc, base = encoder(vocabulary, spaced), TaskContext.get().partitionId() << 40
        held, rows = {}, []

        def emit(key, start, length, borne, seq, offset):
            ids, doc = held[key][:2]
            rows.append((doc, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), len(ids) // 4, borne,
                         base + seq, offset))
            held[key][2] -= length
            if not held[key][2]:
                del held[key]

        packer, key = Packer(emit, tokens, segments, most, pool), 0
        for batch in batches:
            docs_, texts, leads = (batch.column(i).to_pylist() for i in range(3))
            for at in range(0, len(texts), 256):
                for doc, free, ids in zip(docs_[at:], leads[at:], enc.encode(texts[at:at + 256])):
                    ids += end
                    held[key] = [ids, doc, len(ids) // 4]
                    packer.put(key, 0, len(ids) // 4, max(0, free))
                    key += 1
            yield from _batch(rows)
            rows.clear()
        packer.pack(keep=False)
        yield from _batch(rows)

    return cols.mapInArrow(run, SCHEMA)


def _batch(rows):
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_ARROW)
