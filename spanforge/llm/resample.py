"""Importance resampling towards a target distribution, by a dictionary of distinct features.

A feature is a run of words. Feature strings are counted over the whole corpus, each task adding up its own first; each
distinct string is then hashed once, to a bucket, and a bucket's gain is the log ratio of its smoothed shares in the
target and in the corpus. Gains join back to each document's feature counts over the dictionary, and a document's weight
is their mean. A Gumbel term from the document's id makes the highest scores a draw without replacement.

The join has two sides. Strings that make up a FREQUENT-th of all features or more are at most FREQUENT, each known by
under LONG bytes, and go to all tasks; they are the bulk of all occurrences, and all hot keys. The rest, of which no
string has more rows than that, meets the dictionary in a shuffle and is summed by document. Both are exact.

Defined results: null and wordless texts have no features and weigh 0; a null id counts as the empty text for the draw,
and comes last in ties; repeated rows are drawn each by itself; an empty target gives every bucket its smoothed share;
an empty corpus gives no rows; other columns are not carried, but by `drawn`, which gives whole rows.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import cut, fields, ranged, row_key, spent, with_prefix

#: The most strings whose gains go to all tasks; from so many bytes on, a string is known by its SHA-256.
FREQUENT, LONG = 1 << 17, 64
#: Distinct strings, and bytes of texts, after which a task passes on what it has counted.
HELD, READ = 300_000, 64 << 20


def _folded(byte: int) -> int:
    """What a byte of UTF-8 becomes: A-Z lower case; what no word holds, a space."""
    if chr(byte).isascii():
        return ord(chr(byte).lower()) if chr(byte).isalnum() else 0x20
    return byte


_FOLDED = bytes(map(_folded, range(256)))


def words(text: str | None) -> list[bytes]:
    """Runs of letters and digits of ASCII and of all characters beyond it; A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLDED).split() if text else []


def features(found: list[bytes], least: int, most: int) -> Iterator[bytes]:
    """All runs of least to most words."""
    for size in range(least, most + 1):
        if size == 1:
            yield from found
        else:
            yield from map(b" ".join, zip(*(found[i:] for i in range(size))))


def key_of(feature: bytes) -> bytes:
    return feature if len(feature) < LONG else hashlib.sha256(feature).hexdigest().encode()


def counted(texts: DataFrame, text_col: str, least: int, most: int) -> DataFrame:
    """feature, n: of all texts; tasks count before they pass on."""
    schema = fields("feature binary, n long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        read = 0

        def passed() -> Iterator[pa.RecordBatch]:
            names, sizes = list(counts), list(counts.values())
            for at in range(0, len(names), 50_000):
                yield pa.RecordBatch.from_pydict({"feature": names[at : at + 50_000], "n": sizes[at : at + 50_000]}, schema=arrow)
            counts.clear()

        for batch in batches:
            for text in batch.column(0):
                found = words(text.as_py())
                counts.update(features(found, least, most))
                read += sum(map(len, found)) * most
                if len(counts) > HELD or read > READ:
                    yield from passed()
                    read = 0
        yield from passed()

    return texts.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema).groupBy("feature").agg(F.sum("n").alias("n"))


def hashed(counts: DataFrame, buckets: int) -> DataFrame:
    """key, n, bucket of each distinct string: the dictionary."""
    key = F.when(F.octet_length("feature") < LONG, F.col("feature")).otherwise(F.sha2("feature", 256).cast("binary"))
    return counts.select(key.alias("key"), "n", (F.crc32("feature") % buckets).cast("int").alias("bucket"))


def totals(dictionary: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences in each bucket: one number for each, whatever the data."""
    out = np.zeros(buckets, dtype=np.int64)
    for r in dictionary.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 * ln of a bucket's smoothed share in the target over that in the corpus)."""
    buckets, all_s, all_t = len(corpus), int(corpus.sum()), int(target.sum())
    return [math.floor(1000 * math.log(((t + 1) * (all_s + buckets)) / ((s + 1) * (all_t + buckets)))) for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist())]


def _documents(docs: DataFrame, id_col: str, text_col: str, least: int, most: int, known: dict[bytes, int]) -> DataFrame:
    """row, k1, k2, id, n_words, n_features, part (the sum of known gains), rest (strings of other gains, and their counts); written."""
    k1, k2 = row_key(docs)
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = StructType([*rows.schema.fields[:3], *fields("n_words long, n_features long, part long, rest array<struct<key: binary, c: long>>").fields])
    arrow = to_arrow_schema(schema)
    sent = docs.sparkSession.sparkContext.broadcast(known)  # of FREQUENT strings under LONG bytes, at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain_of = sent.value.get
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                n_words, n_features, parts, rest = [], [], [], []
                for text in batch.column(3):
                    found = words(text.as_py())
                    part, others, n = 0, [], 0
                    for feature, c in Counter(features(found, least, most)).items():
                        n += c
                        if (gain := gain_of(key := key_of(feature))) is None:
                            others.append({"key": key, "c": c})
                        else:
                            part += c * gain
                    n_words.append(len(found))
                    n_features.append(n)
                    parts.append(part)
                    rest.append(others)
                more = [pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(parts, pa.int64()), pa.array(rest, arrow.field("rest").type)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *more], schema=arrow)

    return cut(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", least: int = 1, most: int = 1, buckets: int = 10_000) -> DataFrame:
    """row, k1, k2 (a row's key), id, n_words, n_features, weight of each document; a written table."""
    dictionary = cut(hashed(counted(docs, text_col, least, most), buckets))
    corpus = totals(dictionary, buckets)
    found = gains(corpus, totals(hashed(counted(target, target_col, least, most), buckets), buckets))
    table = docs.sparkSession.createDataFrame([*enumerate(found)], "bucket int, gain long")
    gained = dictionary.join(F.broadcast(table), "bucket")  # `buckets` rows
    often = F.col("n") > int(corpus.sum()) // FREQUENT
    known = {bytes(r["key"]): r["gain"] for r in gained.where(often).select("key", "gain").toLocalIterator()}
    rows = _documents(docs, id_col, text_col, least, most, known)
    sums = rows.select("row", F.inline("rest")).join(gained.where(~often), "key").groupBy("row").agg(F.sum(F.col("c") * F.col("gain")).alias("more"))
    joined = rows.drop("rest").join(sums, "row", "left").withColumn("whole", F.col("part") + F.coalesce("more", F.lit(0)))
    mean = F.when(F.col("n_features") > 0, F.expr("(whole - pmod(whole, n_features)) div n_features")).otherwise(F.lit(0))
    out = cut(joined.select("row", "k1", "k2", "id", "n_words", "n_features", mean.cast("long").alias("weight")))
    spent(dictionary, rows)
    return out


def importance(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", least: int = 1, most: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """row, k1, k2, id, n_features, weight, score, rank of each document.

    Of the documents with at least least_words words, `percent` of a hundred are drawn: those of the highest scores,
    ranked from 1 on; ties go to the smaller id. All others have a null rank."""
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(told, 1, 8), 16, 10).cast("long").cast("double") + 0.5) / 4294967296.0
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log(u))).cast("long")
    scored = weights(docs, target, id_col, text_col, target_col, least, most, buckets).withColumn("score", score)
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    placed = with_prefix(ranged(able, *order), [], order, F.lit(1), "before").drop("__part")
    ranked = placed.withColumn("rank", F.when(F.col("before") < drawn, F.col("before") + 1).cast("long")).drop("before")
    return ranked.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))).drop("n_words")


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs that importance() draws, with all their columns."""
    k1, k2 = row_key(docs)
    times = importance(docs, target, **options).where(F.col("rank").isNotNull()).groupBy("k1", "k2").agg(F.count(F.lit(1)).cast("int").alias("times"))
    held = docs.select(k1.alias("k1"), k2.alias("k2"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    one = held.join(times.hint("merge"), ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("doc").alias("doc"), F.first("times").alias("times"))
    return one.select(F.explode(F.array_repeat("doc", F.col("times"))).alias("doc")).select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def resampling_report(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """id, n_features, weight, score, rank of each document."""
    return importance(docs, target, id_col, **options).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
