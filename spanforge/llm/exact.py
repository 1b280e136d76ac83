"""Exact dedup by content sort, with DataFrame functions only.

Sampled splitters range-partition the normalised texts by their first characters and a hash of the whole, an external
sort places equals adjacent, and neighbouring rows are compared in full (a window over the text itself: a group ends
where the next text differs). Texts that make up more
than a five-hundredth of a sample are salted before the sort, so that splitters may cut their group; these few texts are
also grouped as wholes, by full text with partial sums, and their rows take the result by the text's SHA-256. The sample
steers the layout only: results don't depend on it.

Defined results: null text counts as empty; equal rows are one group; documents of equal id and text share keep_id;
a group without any id has a null keep_id and keeps nothing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower

#: Rows of the sample, its share that makes a text heavy, and the parts that a heavy text's copies are dealt to.
SAMPLE, HEAVY, SALTS = 50_000, 500, 32
#: Characters by which texts are ordered at first; Spark samples splitters on the driver, so their keys are kept short.
START = 24


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row for each document: id, keep_id, group_size, kept, text_sha256; keep: which id of a group stays, max or min."""
    best = F.max if keep == "max" else F.min
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    base = docs.select(F.col(id_col).alias("__id"), norm.alias("__text")).withColumn("__sha", F.sha2("__text", 256))
    heavy = _heavy(docs, base, id_col)
    salt = F.when(F.col("__sha").isin(heavy), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0)) if heavy else F.lit(0)
    ordered = base.withColumns({"__salt": salt.cast("int"), "__start": F.substring("__text", 1, START), "__rest": F.xxhash64("__text")})
    ordered = ordered.repartitionByRange("__start", "__rest", "__salt")
    adjacent = Window.partitionBy("__start", "__rest", "__salt", "__text")
    found = ordered.select("__id", "__sha", best("__id").over(adjacent).alias("__keep"), F.count(F.lit(1)).over(adjacent).alias("__n"))
    if heavy:
        found = _joined(base, found, heavy, best)
    return found.select(F.col("__id").alias(id_col), F.col("__keep").alias("keep_id"), F.col("__n").alias("group_size"), F.coalesce(F.col("__id") == F.col("__keep"), F.lit(False)).alias("kept"), F.col("__sha").alias("text_sha256"))


def _heavy(docs: DataFrame, base: DataFrame, id_col: str) -> list[str]:
    """Digests of at most HEAVY texts that each make up a HEAVY-th of a bounded sample, or more."""
    rows = docs.count()
    share = min(1.0, SAMPLE / rows) if rows else 1.0
    spread = F.pmod(F.xxhash64(F.lit("sample"), "__id"), F.lit(1 << 30))
    counts = base.where(spread < int(share * (1 << 30))).groupBy("__sha").count()
    least = max(20, int(rows * share / HEAVY))
    return [r[0] for r in counts.where(F.col("count") >= least).orderBy(F.desc("count"), "__sha").limit(HEAVY).collect()]


def _joined(base: DataFrame, found: DataFrame, heavy: list[str], best) -> DataFrame:
    """found, with the partial groups of heavy texts made whole: at most HEAVY rows."""
    partial = base.where(F.col("__sha").isin(heavy)).groupBy("__text").agg(F.first("__sha").alias("__sha"), best("__id").alias("__all_keep"), F.count(F.lit(1)).alias("__all_n"))
    whole = partial.select("__sha", "__all_keep", "__all_n")
    joined = found.join(F.broadcast(whole), "__sha", "left")
    return joined.withColumns({"__keep": F.coalesce("__all_keep", "__keep"), "__n": F.coalesce("__all_n", "__n")})
