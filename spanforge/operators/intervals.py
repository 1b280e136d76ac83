"""Joins by place: intervals that lie near each other, and the last row at or before each row.

Both are equi-joins on bins of places (Spark has no other join that scales by order), with the exact test beside. A key of
very many rows is spread over its bins; only one row for each of its bins comes together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import Pattern
from .matches import match_table


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions, F.lit(True))


def interval_join(a: DataFrame, b: DataFrame, keys: list[str], within: int = 0, a_span: tuple[str, str] = ("start", "end"), b_span: tuple[str, str] = ("start", "end"), width: int | None = None) -> DataFrame:
    """keys, a and b (structs of the rows' other columns), gap: pairs of rows of equal keys whose intervals [start, end) are
    at most `within` apart. gap is what lies between them, or minus what they share; within=-1 asks for a common place.

    Each interval of a, made longer by within, goes to the bins of `width` that it touches, and so does each of b; a
    pair is made in the first bin that both touch, so none comes twice. Rows for an interval grow with its length over
    width. Null keys, starts or ends join nothing; repeated rows pair each; an interval of no length has a place, too."""
    width = width or max(32, 2 * abs(within))
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))

    def binned(df: DataFrame, side: str, span: tuple[str, str], more: int) -> DataFrame:
        start, end = F.col(f"`{span[0]}`").cast("long"), F.col(f"`{span[1]}`").cast("long")
        row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in keys])
        kept = df.where(start.isNotNull() & end.isNotNull() & (start <= end))
        return kept.select(*[F.col(f"`{k}`").alias(f"{side}k{i}") for i, k in enumerate(keys)], row.alias(f"{side}row"), start.alias(f"{side}s"), end.alias(f"{side}e"), bins(start - more, end + more).alias(f"{side}bin"))

    more = max(within, 0)
    left, right = binned(a, "a", a_span, more), binned(b, "b", b_span, 0)
    same = _all([F.col(f"ak{i}") == F.col(f"bk{i}") for i in range(len(keys))])
    gap = F.greatest(F.col("bs") - F.col("ae"), F.col("as") - F.col("be"))
    first = F.greatest(F.floor((F.col("as") - more) / width), F.floor(F.col("bs") / width))
    pairs = left.join(right, same & (F.col("abin") == F.col("bbin")) & (gap <= within) & (F.col("abin") == first))
    return pairs.select(*[F.col(f"ak{i}").alias(k) for i, k in enumerate(keys)], F.col("arow").alias("a"), F.col("brow").alias("b"), gap.alias("gap"))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, width: float, ties: list[str] | None = None, strictly: bool = False, forward: bool = False, within: float | None = None) -> DataFrame:
    """left's columns, and found: the struct of right's row of equal keys with the largest right_on at or before left_on
    (strictly: before it; forward: the smallest at or after it); null if there is none, or none within `within`.

    Rows of both sides meet by keys and bins of `width`; inside a bin a running last_value finds the row, and the last row
    of each bin is carried over the later ones. So a key is spread over its bins, whatever its number of rows. Places are
    numbers or timestamps (width and within then in seconds). Of rows at one place the largest by `ties` (all of right's
    columns of simple types, if not given) is found. Null keys or places find and are found by none; left rows all stay."""

    def place(df: DataFrame, column: str) -> Column:
        kind = df.schema[column].dataType.typeName()
        at = F.col(f"`{column}`")
        at = F.unix_micros(at.cast("timestamp")) if kind.startswith("timestamp") else at.cast("double") if kind in ("double", "float") else at
        return -at if forward else at

    unit = 1_000_000 if left.schema[left_on].dataType.typeName().startswith("timestamp") else 1
    simple = [f.name for f in right.schema.fields if f.dataType.typeName() not in ("map", "array", "struct", "variant")]
    order = ties if ties is not None else simple
    names = [f"k{i}" for i in range(len(keys))]
    key = lambda df: [F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)]
    whole = lambda df: F.struct(*[F.col(f"`{c}`") for c in df.columns])
    bin_of = lambda at: F.floor(at / F.lit(width * unit)).alias("bin")
    l_at, r_at = place(left, left_on), place(right, right_on)
    ordered = F.struct(r_at.alias("at"), F.struct(*[F.col(f"`{c}`") for c in order]).alias("tie")) if order else F.struct(r_at.alias("at"))
    none = F.lit(None)
    # kind: at one place, rows of right come first, or after those of left if they must be strictly before.
    lefts = left.select(*key(left), bin_of(l_at), l_at.alias("at"), F.lit(1).alias("kind"), whole(left).alias("l"), none.cast(right.select(ordered.alias("o")).schema["o"].dataType).alias("o"), none.cast(right.select(whole(right).alias("r")).schema["r"].dataType).alias("r"))
    rights = right.where(r_at.isNotNull()).select(*key(right), bin_of(r_at), r_at.alias("at"), F.lit(2 if strictly else 0).alias("kind"), none.cast(left.select(whole(left).alias("l")).schema["l"].dataType).alias("l"), ordered.alias("o"), whole(right).alias("r"))
    able = _all([F.col(n).isNotNull() for n in names])
    rights = rights.where(able)
    rows = lefts.where(able & F.col("at").isNotNull()).unionByName(rights)
    inside = Window.partitionBy(*names, "bin").orderBy("at", "kind", F.col("o").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumn("near", F.last(F.when(F.col("r").isNotNull(), F.struct("at", "r")), ignorenulls=True).over(inside)).where("kind = 1")
    last = rows.groupBy(*names, "bin").agg(F.max_by(F.when(F.col("r").isNotNull(), F.struct("at", "r")), "o").alias("last"), F.max("kind").alias("k"))
    before = Window.partitionBy(*names).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*names, "bin", F.last("last", ignorenulls=True).over(before).alias("carried"))
    met = seen.join(carried, [*names, "bin"], "left")
    found = F.coalesce("near", "carried")
    if within is not None:
        found = F.when(F.col("at") - found["at"] <= within * unit, found)
    out = met.select("l", found["r"].alias("found"))
    rest = lefts.where(~(able & F.col("at").isNotNull()) | (~able).isNull()).select("l", F.col("r").alias("found"))
    return out.union(rest).select(*[F.col("l").getField(c).alias(c) for c in left.columns], "found")


def _named(row: str) -> list[Column]:
    return [F.col(f"{row}.{c}").alias(f"{row}_{c}") for c in ("match_no", "start", "end", "text")]


def near_matches(df: DataFrame, keys: list[str], text_col: str, a: Pattern, b: Pattern, within: int, after: bool = False) -> DataFrame:
    """keys, a_match_no, a_start, a_end, a_text, b_..., gap: matches of a and of b in one text that are at most `within`
    bytes apart (after: b's at or after the end of a's). keys name a row of df."""
    pairs = interval_join(match_table(df, keys, text_col, a), match_table(df, keys, text_col, b), keys, within)
    pairs = pairs.where("b.start >= a.end") if after else pairs
    return pairs.select(*keys, *_named("a"), *_named("b"), "gap")


def last_before(df: DataFrame, keys: list[str], text_col: str, marks: Pattern, pattern: Pattern, width: int = 1 << 16) -> DataFrame:
    """keys, match_no, start, end, text, mark_no, mark_start, mark_end, mark: each match of pattern with the last match of
    marks (a heading, say) that ends at or before its start; nulls without one."""
    found = asof_join(match_table(df, keys, text_col, pattern), match_table(df, keys, text_col, marks), keys, "start", "end", width, ties=["match_no"])
    return found.select(*keys, "match_no", "start", "end", "text", F.col("found.match_no").alias("mark_no"), F.col("found.start").alias("mark_start"), F.col("found.end").alias("mark_end"), F.col("found.text").alias("mark"))
