"""Joins of texts with any number of literals or words.

Literals and texts meet by anchors: hashes of a literal's first bytes. A bitmap of fixed size holds all anchors; tasks roll
over their texts' bytes and make a row only where the bitmap has the hash, so a rare dictionary moves next to nothing
and the number of literals has no bound. What meets is compared in full.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bits of the bitmap; it goes to all tasks and takes BITS / 8 bytes whatever the number of literals.
BITS = 1 << 23
#: Bytes of anchors: a literal's is the longest that it has. Words of up to 7 bytes are their own anchors.
LITERAL_SIZES, WORD_SIZES = (1, 2, 4, 8, 16), (1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 24, 32)
#: Rows of two numbers that are sent to all tasks at most; more of them meet the texts in a shuffle.
FEW = 1 << 20
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_PIECE = 1 << 20
_WORD = np.zeros(256, dtype=bool)
_WORD[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"]] = True
_FOLDERS: dict[str, str] = {}


def kept(df: DataFrame) -> DataFrame:
    """df as a written table in the folder of spark.checkpoint.dir, which driver and executors share (one of our own where it
    is unset, in local mode only)."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _FOLDERS:
            _FOLDERS[app] = tempfile.mkdtemp(prefix="spanforge-")
        folder = _FOLDERS[app]
    path = f"{folder.rstrip('/')}/spanforge-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rolled(raw: np.ndarray, at: np.ndarray, sizes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size (rising), the places of at from which so many bytes follow, and the hashes of these bytes."""
    h, done = np.zeros(len(at), dtype=np.uint64), 0
    for n in sizes:
        fits = at + n <= len(raw)
        at, h = at[fits], h[fits]
        for k in range(done, n):
            h = h * _ODD + raw[at + k] + np.uint64(1)
        done = n
        mixed = (h ^ (h >> np.uint64(31))) * _MIX + np.uint64(n)
        yield n, at, mixed ^ (mixed >> np.uint64(29))


def _anchored(literals: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """value, anchor, size for each value (not empty)."""
    schema = StructType.fromDDL("value string, anchor long, size int")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, chosen = [], []
            for value in batch.column(0).to_pylist():
                raw = np.frombuffer(value.encode("utf-8"), dtype=np.uint8)
                n, _, h = [*rolled(raw, np.zeros(1, dtype=np.int64), tuple(s for s in sizes if s <= len(raw)))][-1]
                anchors.append(int(h.view(np.int64)[0]))
                chosen.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(anchors, pa.int64()), pa.array(chosen, pa.int32())], schema=arrow)

    return literals.select("value").mapInArrow(run, schema)


def _bitmap(anchored: DataFrame) -> np.ndarray:
    """A bit for each anchor, modulo BITS."""
    spot = F.pmod(F.col("anchor"), F.lit(BITS)) + 1
    rows = anchored.select(F.bitmap_bucket_number(spot).alias("bucket"), F.bitmap_bit_position(spot).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(BITS, dtype=bool)
    for bucket, bits in rows.toLocalIterator():  # BITS / 32768 rows
        found = np.flatnonzero(np.unpackbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little")) + (bucket - 1) * 32768
        out[found] = True
    return np.packbits(out, bitorder="little")


def _sent(spark: SparkSession, anchored: DataFrame):
    """The bitmap for all tasks, and the sizes that occur."""
    sizes = tuple(sorted(r[0] for r in anchored.select("size").distinct().collect()))  # of a fixed list
    return spark.sparkContext.broadcast(_bitmap(anchored)), sizes


def _hits(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    spot = (hashes & np.uint64(BITS - 1)).astype(np.int64)
    return (marks[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)


def literal_semi_join(texts: DataFrame, text_col: str, patterns: DataFrame, pattern_col: str) -> DataFrame:
    """texts that hold any of the patterns' values, of any number.

    A null text holds none, an empty value is in every other text; null values count for nothing; repeated rows all stay."""
    text = F.col(f"`{text_col}`")
    values = patterns.select(F.col(f"`{pattern_col}`").alias("value")).where(F.col("value").isNotNull()).distinct()
    if not values.where("value = ''").isEmpty():
        return texts.where(text.isNotNull())
    anchored = kept(_anchored(values, LITERAL_SIZES))
    marks, sizes = _sent(texts.sparkSession, anchored)
    schema = StructType.fromDDL("h1 long, h2 long, anchor long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, found = [], []
            for i, value in enumerate(batch.column(2)):
                raw, got = np.frombuffer(value.as_buffer() or b"", dtype=np.uint8), []
                for begin in range(0, max(len(raw), 1), _PIECE):
                    part = raw[begin : begin + _PIECE + LITERAL_SIZES[-1]]
                    got += [h[_hits(marks.value, h)] for _, _, h in rolled(part, np.arange(min(len(part), _PIECE)), sizes)]
                held = np.unique(np.concatenate(got)) if got else np.empty(0, dtype=np.uint64)
                of.append(np.full(len(held), i))
                found.append(held)
            if of and (rows := pa.array(np.concatenate(of))):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate(found).view(np.int64))], schema=arrow)

    names = [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("text"), text).alias("h2")]
    met = texts.where(text.isNotNull()).select(*names, text.alias("text")).mapInArrow(run, schema).join(anchored, "anchor").select("h1", "h2", "value").distinct()
    met = kept(met)
    able = _within(texts.where(text.isNotNull()).select(text.alias("text"), *names), met.select("h1", "h2").distinct())
    found = kept(able.dropDuplicates(["h1", "h2"]).join(met, ["h1", "h2"]).where(F.contains("text", F.col("value"))).select("h1", "h2").distinct())
    named = texts.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(texts.columns)], *names)
    return _within(named, found).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(texts.columns)])


def _within(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows whose h1, h2 wanted has: by all tasks where these are few, else in a shuffle."""
    return rows.join(F.broadcast(wanted) if wanted.count() <= FEW else wanted, ["h1", "h2"], "left_semi")


def dictionary_join(df: DataFrame, keys: list[str], text_col: str, words: DataFrame, word_col: str) -> DataFrame:
    """keys, match_no, start, end (bytes), text: the dictionary's words in each text, as whole words, from the left, the
    longest at each place, without overlap; a dictionary of any size. keys name a row of df.

    A word's edge is where word characters (ASCII letters, digits, _) and others meet. Words may hold other characters, and
    several of them count only if they start and end with word characters; null words count for nothing, null texts have none."""
    value = F.col(f"`{word_col}`")
    able = words.select(value.alias("value")).where(value.rlike(r"\A[0-9A-Za-z_](?:[\s\S]*[0-9A-Za-z_])?\z")).distinct()
    anchored = kept(_anchored(able, WORD_SIZES).withColumn("length", F.octet_length("value")))
    longest = anchored.agg(F.max("length")).first()[0] or 0
    marks, sizes = _sent(df.sparkSession, anchored)
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], F.col(f"`{text_col}`").alias("text")).where(F.col("text").isNotNull())
    schema = StructType([*rows.schema.fields[:-1], *StructType.fromDDL("anchor long, start int, piece binary").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                batch = whole.slice(first, 500)
                of, anchors, starts, pieces = [], [], [], []
                for i, text in enumerate(batch.column(batch.num_columns - 1)):
                    data = text.as_buffer().to_pybytes() if text.as_buffer() else b""
                    raw = np.frombuffer(data, dtype=np.uint8)
                    word = _WORD[raw]
                    edges = np.flatnonzero(word & ~np.concatenate(([False], word[:-1])))
                    after = np.concatenate((word, [False]))
                    for n, at, h in rolled(raw, edges, sizes):
                        good = _hits(marks.value, h)
                        if n < 8:  # a longer word has a longer anchor
                            good &= ~(after[at + n] & after[at + n - 1])
                        for a, x in zip(at[good].tolist(), h[good].view(np.int64).tolist()):
                            of.append(i)
                            anchors.append(x)
                            starts.append(a)
                            pieces.append(data[a : a + longest + 1])
                took = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([*[c.take(took) for c in batch.columns[:-1]], pa.array(anchors, pa.int64()), pa.array(starts, pa.int32()), pa.array(pieces, pa.binary())], schema=arrow)

    met = rows.mapInArrow(run, schema).join(anchored, "anchor")
    ends = F.substring(F.col("piece"), F.col("length") + 1, F.lit(1))
    fits = (F.substring(F.col("piece"), F.lit(1), F.col("length")) == F.encode("value", "UTF-8")) & ~F.coalesce(F.decode(ends, "ISO-8859-1").rlike("[0-9A-Za-z_]"), F.lit(False))
    # The longest at each place first; then each text's places, from the left (all of one text).
    best = met.where(fits).groupBy(*names, "start").agg(F.max_by(F.struct("length", "value"), "length").alias("w"))
    places = best.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("start", (F.col("start") + F.col("w.length")).alias("end"), F.col("w.value").alias("text")))).alias("places"))
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    chosen = F.aggregate("places", F.struct(F.lit(0).alias("at"), none.alias("out")), lambda acc, p: F.when(p["start"] >= acc["at"], F.struct(p["end"].alias("at"), F.array_append(acc["out"], p).alias("out"))).otherwise(acc), lambda acc: acc["out"])
    out = places.select(*names, F.posexplode(chosen).alias("n", "m"))
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], (F.col("n") + 1).alias("match_no"), "m.start", "m.end", "m.text")
