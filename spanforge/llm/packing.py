"""Best-fit packing of tokenised documents into sequences, by vectors of what each sequence has left.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared piece lengths). A piece, the
longest first, goes to the open sequence that it fits under every capacity and that leaves the smallest weighted norm of
residuals (rule "norm"), or has the largest weighted dot product of piece and residual (rule "dot"); else it opens one.

Defined results: null text counts as empty and gives its end id alone; equal rows are packed apart; an empty table gives
no rows; other columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import cut, fields, map_lists
from .tokens import encoder

#: Pieces that are packed together: a task's share is cut into blocks of about this many.
BLOCK = 8192


def pieces(docs: DataFrame, tokenizer: str, tokens: int = 1024, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): only documents of over `tokens` ids are cut; their first piece is the shorter one."""
    schema = StructType([docs.schema[id_col], *fields("piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids).fields])

    def make():
        ids_of = encoder(tokenizer, end_id).ids

        def step(batch: dict[str, list]) -> dict[str, list]:
            rows = []
            for key, text in zip(batch[id_col], batch[text_col]):
                ids = ids_of(text)
                n = len(ids) // 4
                first = n if n <= tokens else n % tokens or tokens
                for i, start in enumerate([0, *range(first, n, tokens)]):
                    part = ids[4 * start : 4 * (start + tokens if i else first)]
                    rows.append((key, i, start, len(part) // 4, zlib.crc32(part), part)[: 5 + with_ids])
            return dict(zip(schema.names, map(list, zip(*rows))))

        return step

    return map_lists(docs.select(id_col, text_col), make, schema)


def best_fit(lengths: np.ndarray, tokens: int = 1024, documents: int = 1024, attention: int = 1024 * 1024, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> np.ndarray:
    """The bin of each piece; lengths come in the order of placing."""
    caps = np.array([tokens, documents, attention], dtype=float)
    left = np.empty((3, max(1, len(lengths))))
    open_bins = np.empty(max(1, len(lengths)), dtype=np.int64)
    w = np.array(weights)[:, None]
    out, made, n_open = np.empty(len(lengths), dtype=np.int64), 0, 0
    for i, length in enumerate(lengths):
        need = np.array([length, 1.0, float(length) ** 2]) / caps
        rest = left[:, :n_open] - need[:, None]
        fits = (rest >= -1e-12).all(axis=0)
        if fits.any():
            score = (w * rest * rest).sum(axis=0) if rule == "norm" else -(w * left[:, :n_open] * need[:, None]).sum(axis=0)
            at = int(np.argmin(np.where(fits, score, np.inf)))
            left[:, at] = rest[:, at]
        else:
            at, n_open = n_open, n_open + 1
            left[:, at], open_bins[at] = 1 - need, made
            made += 1
        out[i] = open_bins[at]
        if left[:, at].min() < 1e-9:  # full: it leaves the search
            n_open -= 1
            left[:, at], open_bins[at] = left[:, n_open], open_bins[n_open]
    return out


def pack(parts: DataFrame, tokens: int = 1024, id_col: str = "doc_id", **capacities) -> DataFrame:
    """parts with sequence_id and offset (place in the sequence, gapless from 0).

    Each task packs its own share; shares are dealt evenly, so one source's or key's pieces never meet in one task."""
    parts = cut(parts)
    shares = max(1, -(-parts.count() // BLOCK))
    order = [("length", "descending"), *((c, "ascending") for c in ("ids_crc32", "piece", "start", id_col))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 33, 0
        if not (got := [b for b in batches if b.num_rows]):
            return
        share = pa.Table.from_batches(got).sort_by(order)
        blocks = -(-share.num_rows // (2 * BLOCK))
        for b in range(blocks):  # each block has pieces of all lengths
            block = share.take(pa.array(range(b, share.num_rows, blocks))).combine_chunks()
            lengths = block.column("length").to_numpy()
            bins = best_fit(lengths, tokens, **capacities)
            by_bin = np.argsort(bins, kind="stable")
            before = np.cumsum(lengths[by_bin]) - lengths[by_bin]
            first = np.flatnonzero(np.diff(bins[by_bin], prepend=-1))
            offset = np.empty(len(bins), dtype=np.int64)
            offset[by_bin] = before - np.repeat(before[first], np.diff(np.append(first, len(bins))))
            out = block.append_column("sequence_id", pa.array(base + made + bins)).append_column("offset", pa.array(offset))
            made += int(bins.max()) + 1
            yield from out.to_batches()

    return parts.repartition(shares).mapInArrow(run, StructType([*parts.schema.fields, *fields("sequence_id long, offset long").fields]))


def pack_documents(docs: DataFrame, tokenizer: str, tokens: int = 1024, capacities: dict | None = None, **options) -> DataFrame:
    """capacities: documents, attention, weights and rule of best_fit; as they are by default, only tokens bind."""
    return pack(pieces(docs, tokenizer, tokens, **options), tokens, options.get("id_col", "doc_id"), **(capacities or {}))
