"""Token ids in a fixed-width binary format: every id takes the least bits that the vocabulary needs.

A file is a header (magic, version, bits, ids in a block, documents, ids, blocks), the byte offset of each block, the
name (an integer, or none) and number of ids of each document, and the blocks. A block holds a fixed number of ids, bit-packed
from the lowest bit, and starts at a byte, so any id is found by one division and blocks unpack with numpy alone: a
document, or any range of ids, is read from its own blocks. Files hold whole documents, and all that is said of them; Spark
writes them as values of a Parquet table, which any store that Spark knows can hold, beside their order and sizes.

Defined results: null text counts as empty and gives its end id alone; documents of equal id are in the order of their
texts; null ids come first; ids are integers; an empty table gives no files; other columns are not carried.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut, fields, map_lists
from .tokens import encoder, vocabulary_size

MAGIC, VERSION, HEADER = b"SFBP", 2, struct.Struct("<4sHHIQQQ")
#: Ids in a block, and ids after which a writer closes a file at the next document's end.
BLOCK, FILE_IDS = 4096, 1 << 19


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16 or bits == 32 or bits == 8:
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype("<u4")[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits == 16 or bits == 32 or bits == 8:
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype("<u4")
    planes = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


def write_file(ids: np.ndarray, lengths: np.ndarray, bits: int, block: int = BLOCK, names: list[int | None] | None = None) -> bytes:
    blocks = [pack_bits(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype("<u8")
    head = HEADER.pack(MAGIC, VERSION, bits, block, len(lengths), len(ids), len(blocks))
    names = names if names is not None else list(range(len(lengths)))
    known, named = np.array([n is not None for n in names], dtype="u1"), np.array([n or 0 for n in names], dtype="<i8")
    return b"".join([head, offsets.tobytes(), lengths.astype("<u8").tobytes(), named.tobytes(), known.tobytes(), *blocks])


class File:
    """Reads a file's ids: all, or any range of them through the block offsets."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        magic, version, self.bits, self.block, documents, self.n, blocks = HEADER.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a file of this format")
        at = HEADER.size
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at)
        at += 8 * (blocks + 1)
        self.lengths = np.frombuffer(data, "<u8", documents, at).astype(np.int64)
        at += 8 * documents
        named, known = np.frombuffer(data, "<i8", documents, at), np.frombuffer(data, "u1", documents, at + 8 * documents)
        self.names = [n if k else None for n, k in zip(named.tolist(), known.tolist())]
        self.start = at + 9 * documents
        self.ends = np.cumsum(self.lengths)

    def document(self, i: int) -> np.ndarray:
        """The ids of the file's i-th document, from its own blocks."""
        return self.ids(int(self.ends[i] - self.lengths[i]), int(self.ends[i]))

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        end = self.n if end is None else min(end, self.n)
        if end <= start:
            return np.empty(0, "<u4")
        out = []
        for b in range(start // self.block, -(-end // self.block)):
            part = self.data[self.start + int(self.offsets[b]) : self.start + int(self.offsets[b + 1])]
            out.append(unpack_bits(part, min(self.block, self.n - b * self.block), self.bits))
        skip = start // self.block * self.block
        return np.concatenate(out)[start - skip : end - skip]


def write(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2) -> DataFrame:
    """The table of files: part and file (ascending with the documents' integer ids), n_ids, data."""
    bits = max(1, (vocabulary_size(tokenizer) - 1).bit_length())
    schema = fields("part int, file long, n_ids long, data binary")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, file = encoder(tokenizer, end_id).ids, TaskContext.get().partitionId(), 0
        keys, got, n = [], [], 0

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(got), "<u4")
            data = write_file(ids, np.array([len(g) // 4 for g in got]), bits, names=keys)
            return pa.RecordBatch.from_pydict({"part": [part], "file": [file], "n_ids": [len(ids)], "data": [data]}, schema=arrow)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(key)
                got.append(ids_of(text.as_py()))
                n += len(got[-1]) // 4
                if n >= FILE_IDS:
                    yield closed()
                    keys, got, n, file = [], [], 0, file + 1
        if got:
            yield closed()

    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = named.repartitionByRange("id").sortWithinPartitions("id", "text")
    return cut(ordered.mapInArrow(run, schema))


def read(files: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row for each document of the files: id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids)."""
    schema = fields("part int, file long, id long, before long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)

    def step(batch: dict[str, list]) -> dict[str, list]:
        rows = []
        for part, number, data in zip(batch["part"], batch["file"], batch["data"]):
            file = File(data)
            whole = memoryview(file.ids().tobytes())  # each block is unpacked once
            for name, n, end in zip(file.names, file.lengths.tolist(), file.ends.tolist()):
                ids = whole[4 * (end - n) : 4 * end]
                rows.append((part, number, name, end - n, n, zlib.crc32(ids), bytes(ids) if with_ids else None)[: 6 + with_ids])
        return dict(zip(schema.names, map(list, zip(*rows))))

    # Two steps: the parts are few, and each part's files are summed by themselves.
    sizes = files.select("part", "file", "n_ids")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(upto(Window.orderBy("part"))), F.lit(0)).alias("p"))
    starts = sizes.withColumn("f", F.coalesce(F.sum("n_ids").over(upto(Window.partitionBy("part").orderBy("file"))), F.lit(0))).join(parts, "part")
    out = map_lists(files.select("part", "file", "data"), lambda: step, schema, rows=1)
    joined = out.join(starts.select("part", "file", (F.col("p") + F.col("f")).alias("begin")), ["part", "file"])
    return joined.select(F.col("id").alias(id_col), (F.col("begin") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
