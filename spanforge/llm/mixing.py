"""Mixing sources to target weights by systematic sampling.

Within a source, in order of size, each document's expected copies are prefix-summed, one random offset is added, and a
copy is emitted for every integer boundary that a document crosses. Ordering by size makes the words taken as even as
the copies.

Defined results: null text has size 0; the null source is a source of its own and comes last; equal rows are drawn like
any others; a source without words, and an empty table, take nothing; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, packed, ranged, with_prefix


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: float = 3.0) -> DataFrame:
    """__source, __size: source, source_size, weight, target, rate (expected copies) of each source.

    Sources by code point, null last, weigh weights, repeating. Targets share all words by weight; a target stops at
    max_repeat times its source's size and the excess is shared again, until none is above. The common level (words for
    each unit of weight) rises at each pass over the table of sources, of which only two sums reach the driver."""
    totals = sizes.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size"))
    order = [F.col("source").isNull(), F.col("source")]
    ranks = with_prefix(ranged(totals, *order), [], order, F.lit(1).cast("long"), "__rank")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    sources = cut(ranks.select("source", "source_size", pick.alias("weight"), (F.col("source_size") * float(max_repeat)).alias("__cap")))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1.0
    while level > before:
        full = F.col("__cap") <= level * F.col("weight")
        fixed, open_weight = sources.agg(F.sum(F.when(full, F.col("__cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        before, level = level, max(level, (total - fixed) / open_weight) if open_weight else level
    target = F.least(F.col("__cap"), level * F.col("weight"))
    rate = F.when(F.col("source_size") == 0, 0.0).when(F.col("__cap") <= level * F.col("weight"), float(max_repeat)).otherwise(target / F.col("source_size"))
    return sources.select("source", "source_size", "weight", target.alias("target"), rate.alias("rate"))


def draw(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: float = 3.0, seed: int = 7) -> DataFrame:
    """sizes (__source, __size, __id and any others) with source_size, target and copies of each row."""
    sizes = cut(sizes)
    order = [F.col("__size"), F.col("__id")]
    parts = ranged(sizes, F.col("__source"), *order)
    placed = with_prefix(parts, ["__source"], order, F.lit(1).cast("long"), "__place")
    targets = source_targets(sizes, weights, max_repeat)
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("")))), 1, 7)
    offset = F.conv(digits, 16, 10).cast("long") / float(1 << 28)  # one for each source
    mixed = placed.join(targets.withColumn("__offset", offset), F.col("__source").eqNullSafe(F.col("source")))
    crossed = F.floor(F.col("rate") * (F.col("__place") + 1) + F.col("__offset")) - F.floor(F.col("rate") * F.col("__place") + F.col("__offset"))
    return mixed.withColumn("copies", F.least(crossed, F.lit(int(max_repeat))).cast("long"))


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row for each document: id, size, source_size, target, copies, taken (words taken, repeats counted)."""
    sizes = docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), word_count(F.col(text_col)).alias("__size"))
    return draw(sizes, **options).select(F.col("__id").alias(id_col), F.col("__size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("__size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: docs' own columns, each row as often as it is drawn.

    Only narrow rows are ordered and drawn; the texts move once, to meet their rows' copies by a 128-bit row key."""
    keyed = packed(docs, text_col)
    value = F.col("doc").getField
    sizes = keyed.select("k1", "k2", value(id_col).alias("__id"), value(source_col).alias("__source"), word_count(F.col("text")).alias("__size"))
    drawn = draw(sizes, **options).groupBy("k1", "k2").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    # The texts move, whatever the size. Equal rows share their copies by turns.
    rows = keyed.select("k1", "k2", "doc").join(drawn.where("copies > 0").hint("merge"), ["k1", "k2"])
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1")))
    times = F.floor(F.col("copies") / F.col("rows")) + (F.col("turn") <= F.col("copies") % F.col("rows")).cast("long")
    taken = rows.select("doc", times.cast("int").alias("times")).where("times > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time")).select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
