"""Token ids in files of directly addressable codes.

Format, little-endian: ``DAC1``, length of the header (uint32), header (JSON), then its parts back to back.  An id is
split into chunks of 8 bits.  Level 0 holds the lowest chunk of every id and a bitmap that says which ids go on; level
1 holds the next chunk of those, and so on.  A rank directory gives the number of set bits before every 512th bit, so
the place of an id's next chunk is one look-up and a count of at most 512 bits: any id is read without its neighbours.
"""

import json
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quirework.plans.settle import settle, shared_dir

from .common import partitions
from .tokens import encoder

MAGIC, BLOCK = b"DAC1", 512
_BITS = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def write_codes(ids: np.ndarray, doc_ids: list, offsets: np.ndarray) -> bytes:
    """A file's bytes: ``ids`` of all its documents, their ids (null allowed) and the n + 1 offsets of their ids."""
    parts = {"docs": np.array([d or 0 for d in doc_ids], "<i8"), "null": np.array([d is None for d in doc_ids], np.uint8),
             "offsets": offsets.astype("<u8")}
    rest, level = ids.astype(np.uint32), 0
    while True:
        parts[f"chunks{level}"] = rest.astype(np.uint8)
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ones = _BITS[bits].reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint64)
        parts[f"more{level}"] = bits
        parts[f"rank{level}"] = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        rest, level = rest[more] >> 8, level + 1
        if not len(rest):
            break
    head = json.dumps({"ids": len(ids), "levels": level, "parts": [[k, v.dtype.str, len(v)] for k, v in parts.items()]}).encode()
    return b"".join([MAGIC, np.uint32(len(head)).tobytes(), head, *(v.tobytes() for v in parts.values())])


class Codes:
    """A file's bytes, read in place."""

    def __init__(self, data):
        assert bytes(data[:4]) == MAGIC, "not a file of token codes"
        size = int(np.frombuffer(data, "<u4", 1, 4)[0])
        head = json.loads(bytes(data[8:8 + size]))
        self.n, self.levels, at = head["ids"], head["levels"], 8 + size
        self.parts = {}
        for name, kind, count in head["parts"]:
            self.parts[name] = np.frombuffer(data, kind, count, at)
            at += count * np.dtype(kind).itemsize

    def token(self, i: int) -> int:
        """Id number ``i`` of the file."""
        out = 0
        for level in range(self.levels):
            out |= int(self.parts[f"chunks{level}"][i]) << (8 * level)
            bits = self.parts[f"more{level}"]
            if not (bits[i >> 3] >> (i & 7)) & 1:
                return out
            start = i // BLOCK * (BLOCK // 8)
            before = _BITS[bits[start:i >> 3]].sum() + _BITS[bits[i >> 3] & ((1 << (i & 7)) - 1)]
            i = int(self.parts[f"rank{level}"][i // BLOCK]) + int(before)
        return out

    def tokens(self) -> np.ndarray:
        """All ids of the file."""
        out = self.parts["chunks0"].astype("<u4")
        there = np.arange(self.n)
        for level in range(1, self.levels):
            more = np.unpackbits(self.parts[f"more{level - 1}"], count=len(there), bitorder="little").astype(bool)
            there = there[more]
            out[there] |= self.parts[f"chunks{level}"].astype("<u4") << np.uint32(8 * level)
        return out

    def documents(self):
        """(doc_id or None, offset, ids) of each document."""
        ids, off = self.tokens(), self.parts["offsets"]
        for k, (doc, null) in enumerate(zip(self.parts["docs"].tolist(), self.parts["null"].tolist())):
            yield (None if null else doc), int(off[k]), ids[int(off[k]):int(off[k + 1])]


def _store(folder: str, data: bytes) -> str:
    """Write one file to the shared folder; its name is new for each attempt, so a repeated task harms none."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}.dac"
    with system.open_output_stream(os.path.join(path, name)) as out:
        out.write(data)
    return name


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int, spaced: bool,
                 ids_per_file: int = 1 << 22) -> DataFrame:
    """Write the ids of each text and ``end_id`` to files in ``folder`` in ascending doc_id order (nulls first), and
    return the list of files (file, part, seq, n_docs, n_ids, start), ``start`` being the ids in all files before.

    Texts are dealt to ranges of doc_id; a task writes its range as files of ``ids_per_file`` ids or little more (a
    document is never cut).  The list names what the successful attempts wrote, and is settled, so that nothing is
    written twice.  Null text: the end id alone.  Rows with equal ids stand in any order; an empty table gives no file.
    """
    end = np.array([end_id], "<u4").tobytes()
    count = partitions(docs.sparkSession)
    ranged = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(
        count, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())

    def run(batches):
        enc, part = encoder(vocabulary, spaced), TaskContext.get().partitionId()
        held, names, size, seq, rows = [], [], 0, 0, []

        def flush():
            ids = np.frombuffer(b"".join(held), "<u4")
            offsets = np.concatenate([[0], np.cumsum([len(h) // 4 for h in held])])
            rows.append((_store(folder, write_codes(ids, names, offsets)), part, seq, len(held), len(ids)))

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(keys), 256):
                for key, ids in zip(keys[at:at + 256], enc.encode(texts[at:at + 256])):
                    held.append(ids + end)
                    names.append(key)
                    size += len(ids) // 4 + 1
                    if size >= ids_per_file:
                        flush()
                        held, names, size, seq = [], [], 0, seq + 1
        if held:
            flush()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["file", "part", "seq", "n_docs", "n_ids"])

    files = settle(ranged.mapInArrow(run, "file string, part long, seq long, n_docs long, n_ids long"))
    zero = F.lit(0).cast("long")
    by_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    by_seq = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("_n")).select(
        "part", F.coalesce(F.sum("_n").over(by_part), zero).alias("_before"))
    placed = files.withColumn("_in", F.coalesce(F.sum("n_ids").over(by_seq), zero)).join(F.broadcast(parts), "part")
    return placed.withColumn("start", F.col("_before") + F.col("_in")).drop("_before", "_in")


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the listed files of ``folder``."""
    spark = files.sparkSession
    schema = "file string, doc_id long, at long, n_tokens long, ids_crc32 long"
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [(path.rsplit("/", 1)[-1], doc, at, len(ids), zlib.crc32(ids.tobytes()))
                        for doc, at, ids in Codes(data.as_buffer()).documents()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), *[pa.int64()] * 4])],
                    ["file", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(folder)
    docs = found.select("path", "content").mapInArrow(run, schema)
    listed = files.select("file", F.col("start").alias("_start"))
    return docs.join(listed, "file").select("doc_id", (F.col("_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def new_folder(spark) -> str:
    return f"{shared_dir(spark)}/tokens/{uuid.uuid4().hex}"
