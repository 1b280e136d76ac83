"""What the operators share: table access, row keys, cut lineage, ordered prefix sums and word hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, MapType, StructType

#: A word: a run without space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PIECE, _KEPT = 1 << 18, 1 << 20  # bytes hashed at once, powers that a worker keeps


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only where it is unset in local mode (tests), one of our own."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="spanforge-")
    return _OWN_DIRS[app]


def cut(df: DataFrame, **options: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again, so that no later step recomputes it.

    The files outlive lost executors; they go with the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/spanforge-{uuid.uuid4().hex}"
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spent(*tables: DataFrame) -> None:
    """Deletes the files of tables that cut() wrote and that nothing reads any more."""
    for df in tables:
        spark, folder = df.sparkSession, f"{shared_dir(df.sparkSession)}/spanforge-"
        at = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for name in (f for f in at if "/spanforge-" in f and f.split(":", 1)[-1].lstrip("/").startswith(folder.split(":", 1)[-1].lstrip("/"))):
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """A-Z only; the common case of plain ASCII text takes Spark's fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_key(df: DataFrame) -> tuple[Column, Column]:
    """128 bits that name a row by all its values; equal rows share them. Nulls are told from values and from each other."""
    told = []
    for f in df.schema.fields:
        value = F.col(f"`{f.name}`")
        plain = not isinstance(f.dataType, (ArrayType, MapType, StructType)) and f.dataType.typeName() != "variant"
        told += [value.isNull(), value if plain else F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})]
    return F.xxhash64(*told), F.xxhash64(F.lit("row"), *told)


def packed(docs: DataFrame, text_col: str) -> DataFrame:
    """k1, k2 (the row_key), text, and doc: the whole row as a struct, so that no column's name can clash with others."""
    k1, k2 = row_key(docs)
    return docs.select(k1.alias("k1"), k2.alias("k2"), F.col(f"`{text_col}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


#: Bits of a bitmap of hashes; it is broadcast, and takes BITS / 8 bytes whatever the data.
BITS = 1 << 26


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """A bit for each hash (modulo BITS) that df holds, as bytes."""
    spot = F.pmod(F.col(column), F.lit(BITS)) + 1
    rows = df.select(F.bitmap_bucket_number(spot).alias("bucket"), F.bitmap_bit_position(spot).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(BITS // 8, dtype=np.uint8)
    width = 4096  # bytes of one of Spark's bitmaps
    for bucket, bits in rows.collect():  # BITS bits at most
        raw = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little")
        at = np.flatnonzero(raw) + (bucket - 1) * 8 * width
        np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out


def ranged(df: DataFrame, *order: Column) -> DataFrame:
    """df range-partitioned by order and written, with the partition's number in __part (rising with order)."""
    return cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))


def with_prefix(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """Adds out: the sum of value over the rows of the same group before this one in order.

    df comes from ranged() by group and order, so a group that holds most rows spans many parts: each (group, part)
    is summed alone, and only one number for each of them meets the others of its group."""
    keys = [*group, "__part"]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    on = reduce(lambda x, y: x & y, same)
    return rows.alias("a").join(starts.alias("b"), on).select("a.*", (F.col("__in") + F.col("__start")).alias(out)).drop("__in")


#: Keys that hold a thousandth of all rows or more are at most so many.
HEAVY = 1000


def join_keyed(rows: DataFrame, keyed: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined with keyed (one row for each key, and how many of rows have it, at least).

    Keys of a HEAVY-th of all these rows or more are at most HEAVY; their few rows of keyed meet rows by broadcast, so
    that no task gets one key's rows. keyed is a written table."""
    total = keyed.agg(F.sum(count)).first()[0] or 0
    least = max(total // HEAVY, 10_000)
    small = keyed.where(F.col(count) > least).drop(count).limit(HEAVY)
    hot = [r[0] for r in small.select(key).collect()]
    rest = keyed.where(F.col(count) <= least).drop(count)
    if not hot:
        return rows.join(rest, key)
    is_hot = F.col(key).isin(hot)
    return rows.where(~is_hot).join(rest, key).unionByName(rows.where(is_hot).join(F.broadcast(small), key))


def map_lists(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list] | None]], schema: StructType, rows: int = 1000) -> DataFrame:
    """df mapped by make()(columns as lists) -> columns as lists, `rows` rows at a time; nulls stay None and ids exact."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                if (out := step({n: c.to_pylist() for n, c in zip(part.schema.names, part.columns)})) is not None:
                    yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, make: Callable[[], Callable[[list], dict[str, list]]], source: str, added: StructType, rows: int = 1000) -> DataFrame:
    """df with columns that make()(values of source) gives; all other columns pass through untouched."""
    arrow, schema = to_arrow_schema(added), StructType([*df.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                more = pa.RecordBatch.from_pydict(step(part.column(part.schema.get_field_index(source)).to_pylist()), schema=arrow)
                yield pa.RecordBatch.from_arrays([*part.columns, *more.columns], names=[*part.schema.names, *arrow.names])

    return df.mapInArrow(run, schema)


def fields(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32(doc_id as text) mod 4 is 2. A null doc_id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n + 1, dtype=np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_POWERS: list[np.ndarray] = []


def _both_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, up to n and more."""
    if n > _KEPT:
        return _powers(_P, n), _powers(_P_INV, n)
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(_PIECE, 1 << n.bit_length())
        _POWERS[:] = _powers(_P, size), _powers(_P_INV, size)
    return _POWERS[0], _POWERS[1]


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of about _PIECE bytes that end where a word ends (a longer word is kept whole)."""
    start = 0
    while len(data) - start > _PIECE:
        end = start + _PIECE
        gaps = np.flatnonzero(_SPACE[data[start:end]])
        if not len(gaps):
            more = np.flatnonzero(_SPACE[data[end:]])
            end = end + int(more[0]) + 1 if len(more) else len(data)
        else:
            end = start + int(gaps[-1]) + 1
        yield data[start:end]
        start = end
    yield data[start:]


def word_hashes(text: str | None, fold: bool = True, lines: bool = False):
    """A 64-bit hash of each word of the text, A-Z lower-cased with fold (and, with lines, the number of its line)."""
    if not text:
        return (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)) if lines else np.empty(0, dtype=np.uint64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    out, at, line = [], [], 0
    for data in _pieces(raw):
        space = _SPACE[data]
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        starts, ends = edge[::2], edge[1::2]
        if lines:
            feeds = np.flatnonzero(data == 10)
            at.append(np.searchsorted(feeds, starts) + line)
            line += len(feeds)
        if not len(starts):
            continue
        up, down = _both_powers(len(data))
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((_FOLD[data] if fold else data).astype(np.uint64) * up[: len(data)] + up[: len(data)], out=total[1:])
        out.append(mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MULT))
    hashes = np.concatenate(out) if out else np.empty(0, dtype=np.uint64)
    return (hashes, np.concatenate(at)) if lines else hashes


@dataclass
class Words:
    """The words of a batch of texts, one after another."""

    hashes: np.ndarray
    first: np.ndarray  # where each text's words start, and their number
    line: np.ndarray  # number of the line of each word, counted through the batch
    first_line: np.ndarray  # number of each text's first line
    digits: np.ndarray  # whether a word holds a digit 0-9

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def batch_words(texts: pa.Array, fold: bool = True) -> Words:
    """word_hashes of all texts of a string column at once; null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(texts) else np.empty(0, dtype=np.uint8)
    at = at - at[0] if len(at) else np.zeros(1, dtype=np.int64)
    hashes, places, lines, digits, feeds_at, begun, feeds_before = [], [], [], [], [], 0, 0
    for data in _pieces(raw):
        edges = at[np.searchsorted(at, begun, "right") : np.searchsorted(at, begun + len(data))] - begun  # texts that start inside
        word = ~_SPACE[data]
        head, tail = word.copy(), word.copy()
        head[1:] &= ~word[:-1]
        tail[:-1] &= ~word[1:]
        head[edges], tail[edges - 1] = word[edges], word[edges - 1]
        starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
        feeds = np.flatnonzero(data == 10)
        up, down = _both_powers(len(data))
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(((_FOLD[data] if fold else data).astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        hashes.append(mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MULT))
        held = np.concatenate(([0], np.cumsum((data >= 48) & (data <= 57), dtype=np.int32)))
        digits.append(held[ends] > held[starts])
        feeds_at.append(feeds + begun)
        places.append(starts + begun)
        lines.append(np.searchsorted(feeds, starts) + feeds_before)
        begun, feeds_before = begun + len(data), feeds_before + len(feeds)
    where = np.concatenate(places)
    return Words(np.concatenate(hashes), np.searchsorted(where, at), np.concatenate(lines), np.searchsorted(np.concatenate(feeds_at), at[:-1]), np.concatenate(digits))


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """values dealt to lists of the given lengths."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), type=pa.int32()), values)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: StructType, rows: int = 1000) -> DataFrame:
    """df mapped by make()(Arrow batch) -> Arrow batch, `rows` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                if (out := step(batch.slice(at, rows))) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def sieved(df: DataFrame, column: str, wanted: DataFrame, held: bool = True, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: StructType | None = None, rows: int = 1000) -> DataFrame:
    """df without most rows whose column's value wanted doesn't hold: those that a bitmap of fixed size shows to be of no use to a join.
    Without held, those rows. With then, what it makes (of schema) of the rows that stay, `rows` at a time, in the same worker:
    a second map after this one would take a second worker for each task, and workers keep their memory between tasks."""
    marks = df.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64(column).alias("hash")), "hash"))  # of BITS bits
    names = df.columns

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        spot = batch.column(batch.num_columns - 1).to_numpy() & (BITS - 1)
        found = marks.value[spot >> 3] >> (spot & 7).astype(np.uint8) & 1
        left = batch.filter(pa.array(found == held)).select(names)
        return then(left) if then else left

    return map_batches(df.withColumn("sieve hash", F.xxhash64(column)), lambda: step, schema or df.schema, rows=rows)


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all k-word shingles in order; a shorter sequence is one shingle, no words none."""
    if not len(words):
        return words
    if len(words) < k:
        h = np.array([len(words)], dtype=np.uint64)
        for i in range(len(words)):
            h = mix64(h * _MULT + words[i : i + 1])
        return h
    h = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for i in range(k):
        h = h * _MULT + words[i : len(words) - k + 1 + i]
    return mix64(h)


def sequence_hashes(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each of the sequences of `sizes` words from `starts`."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    up, down = _both_powers(len(words))
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum((mix64(words + _MULT)) * up[: len(words)], out=total[1:])
    return mix64((total[starts + sizes] - total[starts]) * down[starts] + sizes.astype(np.uint64) * _MULT)


def sliding(values: np.ndarray, size: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each `size` values in a row."""
    wide, out = 1, values
    while 2 * wide <= size:
        out = best(out[:-wide], out[wide:])
        wide *= 2
    return best(out[: len(out) - (size - wide)], out[size - wide :]) if size > wide else out.copy()


def spans(text: str) -> list[tuple[int, int]]:
    """Where each word of the text starts and ends."""
    return [m.span() for m in re.finditer(WORD, text)]
