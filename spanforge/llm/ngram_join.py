"""N-gram Jaccard join by parity sketches.

A document is the set of its 5-word shingles. Hashed into positions, the shingles flip bits of a sketch, so shingles of
both documents cancel: the Hamming distance of two sketches is at most the symmetric difference of the sets. Two sets
that reach the threshold are of like size and differ in at most a known number of shingles. The sketch is cut into parts;
differing shingles can touch only some of them, so a linked pair agrees in others. Documents of a size band, and of
the next, meet where a part agrees (key: band, part and the part's parity vector, folded to 64 bits by XOR), and every
pair that could be linked is verified on its full sets.

Parts are tuned for each band: a pair at the threshold is left without an agreeing part of at least some shingles with a
probability under MISS (in small sets, by several independent cuts), and pairs far from it agree in as few parts as can
be. Parts with too few shingles give no key: they would bring together documents that share a common line only. Pairs
whose whole sketches lie too far apart are passed over in the join itself.

Defined results: A-Z are lower-cased; with fewer than five words the whole sequence is one shingle; null and wordless
texts have no shingles and are linked with nothing; documents of equal sets are one class, whatever their ids;
component_id is the smallest non-null doc_id of the component (null if it has none); an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import batch_words, cut, fields, map_batches, mix64, packed, shingles, spent, word_hashes
from .links import SKETCH, SOME, clusters, meeting

#: Chance that a pair exactly at the threshold shares no key.
MISS = 1e-6
#: Keys for each shingle of a document in one band, about.
KEYS = 0.16


NODE_SALT = np.uint64(0xA0761D6478BD642F)


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    return np.unique(shingles(word_hashes(text), k))


def node_of(found: np.ndarray) -> int:
    """64 bits that name a set."""
    mixed = mix64(found ^ NODE_SALT)
    return int(mix64(np.array([np.bitwise_xor.reduce(mixed) + np.uint64(len(found))], dtype=np.uint64)).view(np.int64)[0])


def _agrees(parts: int, least: int, same: int, apart: int) -> float:
    """Chance that a part of two sets agrees and holds `least` of their `same` common shingles, `apart` others being in one set."""
    p = 1 / parts
    if same < 200:
        thin = sum(math.comb(same, i) * p**i * (1 - p) ** (same - i) for i in range(min(least, same + 1)))
    else:
        thin = sum(math.exp(-same * p) * (same * p) ** i / math.factorial(i) for i in range(least))
    return (1 - p) ** apart * max(0.0, 1 - thin)


@lru_cache(maxsize=None)
def tuned(band: int, percent: int) -> tuple[int, int, int]:
    """(parts, cuts, least shingles of a part) for pairs of which the smaller set is in band.

    Among the choices that keep MISS, and give a document at most about KEYS keys a shingle, the one under which a pair
    far from the threshold (half as similar) shares the fewest keys."""
    t = percent / 100
    low, high = math.ceil(t**-band - 1e-9), t ** -(band + 1)
    best = None
    for least in (1, 2, 3, 4, 5, 6):
        for parts in sorted({max(2, round(high / x)) for x in np.geomspace(1.5, 24, 40)}):
            worst = 1.0
            for smaller in np.linspace(low, high, 4):
                for ratio in (1.0, t):
                    union = smaller / t if ratio == t else 2 * smaller / (1 + t)
                    same = round(union * t)
                    worst = min(worst, _agrees(parts, least, same, math.floor(union - union * t + 1e-9)))
            if worst <= 1e-6:
                continue
            cuts = max(1, math.ceil(math.log(MISS) / (parts * math.log(1 - min(worst, 1 - 1e-12)))))
            held = _agrees(parts, least, round(high), 0)
            union = 2 * high / (1 + t / 2)
            far = parts * cuts * _agrees(parts, least, round(union * t / 2), round(union * (1 - t / 2)))
            over = max(1.0, parts * cuts * held / (KEYS * high + 40))
            if best is None or (over, far) < best[0]:
                best = ((over, far), parts, cuts, least)
    return best[1:]


def band_of(n: int, percent: int) -> int:
    return int(math.floor(math.log(n) / -math.log(percent / 100) + 1e-9))


def sketch_keys(found: np.ndarray, percent: int) -> np.ndarray:
    """The keys of a set: its parts under its own band, where it may be the smaller set, and under the band before."""
    if len(found) < 2:
        return np.empty(0, dtype=np.uint64)
    out, own = [], band_of(len(found), percent)
    for band in (own, own - 1):
        if band < 0:
            continue
        parts, cuts, least = tuned(band, percent)
        for c in range(cuts):
            seed = np.uint64((band * 1009 + c) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            h = mix64(found + seed)
            part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            sketch = np.zeros(parts, dtype=np.uint64)
            np.bitwise_xor.at(sketch, part, mix64(h))
            held = np.flatnonzero(np.bincount(part, minlength=parts) >= least)
            out.append(mix64(sketch[held] + mix64(held.astype(np.uint64) + seed)))
    return np.concatenate(out)


def _sets(docs: DataFrame, text_col: str, k: int) -> DataFrame:
    """docs without the text, with n_shingles and node."""
    kept = [f for f in docs.schema.fields if f.name != text_col]
    schema = StructType([*kept, *fields("n_shingles long, node long").fields])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [*_found(batch.column(batch.num_columns - 1), k)]
        more = [pa.array([len(s) for s in found], type=pa.int64()), pa.array([node_of(s) if len(s) else None for s in found], type=pa.int64())]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=schema.names)

    return map_batches(docs.select(*[f.name for f in kept], text_col), lambda: step, schema, rows=200)


def _keys(docs: DataFrame, text_col: str, k: int, percent: int) -> DataFrame:
    """key, node; equal sets give their keys once a task, so a group of copies doesn't multiply them."""
    schema = fields("key long, node long")

    def make():
        seen: set[int] = set()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            keys, nodes = [], []
            for found in _found(batch.column(0), k):
                if len(found) < 2 or (node := node_of(found)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(node)
                keys.append(sketch_keys(found, percent).view(np.int64))
                nodes.append(np.full(len(keys[-1]), node))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, nodes)], names=schema.names) if keys else None

        return step

    return map_batches(docs.select(text_col), make, schema, rows=200)


def _found(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The set of each text."""
    w = batch_words(texts)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        yield np.unique(shingles(w.hashes[a:b], k))


def labelled(docs: DataFrame, k: int = 5, percent: int = 75, text_col: str = "text") -> DataFrame:
    """docs (k1, k2, the text and others) without the text, with n_shingles, node and label (equal within a component;
    null without shingles); a written table."""
    sets = cut(_sets(docs, text_col, k))
    some = docs.where(F.pmod(F.xxhash64(F.lit("some"), text_col), F.lit(SOME)) == 0)
    multi = meeting(_keys(docs, text_col, k, percent), _keys(some, text_col, k, percent), merge=True)
    needed = cut(multi.select("node").distinct())
    one = sets.where(F.col("node").isNotNull()).join(needed, "node", "left_semi").groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("x")).select("node", "x.*")
    texts = cut(_texts(docs, one, text_col, k))
    labels, tables = clusters(multi, texts, lambda text: shingle_set(text.decode("utf-8", "surrogatepass"), k), percent)
    out = cut(sets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    spent(needed, multi, sets, labels, *tables)
    return out


def sketch(found: np.ndarray) -> list[int]:
    """The parity of the shingles that fall on each of SKETCH bits, as 64-bit words."""
    bits = np.bincount((mix64(found) >> np.uint64(20)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def _texts(docs: DataFrame, one: DataFrame, text_col: str, k: int) -> DataFrame:
    """node, words (a text of each node, in UTF-8), n and sketch of its set."""
    # The texts move, whatever the size.
    found = docs.select("k1", "k2", F.col(text_col).alias("text")).join(one.withColumnRenamed("node", "of").hint("merge"), ["k1", "k2"])
    schema = fields("node long, words binary, n long, sketch array<long>")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets, nodes = [*_found(batch.column(1), k)], batch.column(0).to_pylist()
        rows = [(n, t.as_py().encode("utf-8", "surrogatepass"), len(s), sketch(s)) for n, t, s in zip(nodes, batch.column(1), sets) if len(s) and node_of(s) == n]
        return pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*rows)))) if rows else {n: [] for n in schema.names}, schema=to_arrow_schema(schema))

    return map_batches(found.select("of", "text"), lambda: step, schema, rows=200).dropDuplicates(["node"])


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """One row for each document: id, n_shingles, component_id."""
    keyed = packed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text").select("k1", "k2", F.col("doc.id").alias("id"), "text")
    found = labelled(keyed, k, percent)
    least = cut(found.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("id").alias("least")))
    joined = found.join(least, "label", "left")
    return joined.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("label").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """docs with one row of each component, that of the smallest id; rows without shingles stay; columns may have any names."""
    keyed = packed(docs, text_col)
    found = labelled(keyed.select("k1", "k2", F.col("doc").getField(id_col).alias("id"), "text"), k, percent)
    pick = F.min(F.struct(F.col("id").isNull().alias("o"), F.col("id").alias("i"), "k1", "k2"))
    stays = found.where(F.col("label").isNotNull()).groupBy("label").agg(pick.alias("x")).select("x.k1", "x.k2", F.lit(True).alias("one"))
    alone = found.where(F.col("label").isNull()).select("k1", "k2", F.lit(False).alias("one")).distinct()
    kept = cut(stays.union(alone))
    # The texts move, whatever the size.
    rows = keyed.select("k1", "k2", "doc").join(kept.hint("merge"), ["k1", "k2"]).withColumn("turn", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1")))
    return rows.where("not one or turn = 1").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
