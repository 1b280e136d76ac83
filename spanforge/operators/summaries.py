"""Summaries of matches that merge: counts and sketches of distinct values, by captured groups and columns.

A summary is a table of one row for each finest group, so it can be written, added to by later summaries of other rows, and
rolled up over any grouping sets without its texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import Pattern
from .matches import capture_table

#: Fixed columns of a summary beside its fields: matches, rows with matches, and a sketch of distinct values.
MATCHES, TEXTS, SKETCH = "matches", "texts", "sketch"


def match_summary(df: DataFrame, text_col: str, pattern: Pattern, by: list[str], distinct: str | None = None, columns: list[str] | None = None, log2_size: int = 12) -> DataFrame:
    """by (groups of the pattern, or names in columns: df's own), matches, texts, sketch (of the group or column `distinct`).

    texts counts a text once in each finest group. Tasks sum up their own rows first; a sketch takes 2**log2_size values'
    space at most. Null texts have no matches; a null field is a group of its own, and null values are not counted as distinct."""
    kept = columns or []
    held = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.monotonically_increasing_id().alias("row"), F.col(f"`{text_col}`").alias("text"))
    found = capture_table(held, [*[f"c{i}" for i in range(len(kept))], "row"], "text", pattern)
    of = lambda name: F.col(f"c{kept.index(name)}") if name in kept else F.col(f"`{name}`")
    rows = found.select(*[of(b).alias(b) for b in by], of(distinct).cast("string").alias("v") if distinct else F.lit(None).cast("string").alias("v"), "row")
    once = rows.groupBy(*by, "row").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("v", F.lit(log2_size)).alias("s"))
    return once.groupBy(*by).agg(F.sum("n").alias(MATCHES), F.count(F.lit(1)).alias(TEXTS), F.hll_union_agg("s").alias(SKETCH))


def merged(*summaries: DataFrame) -> DataFrame:
    """One summary of the rows of several, which share no rows."""
    by = [c for c in summaries[0].columns if c not in (MATCHES, TEXTS, SKETCH)]
    return _summed(reduce(DataFrame.unionByName, summaries).groupBy(*by))


def rolled_up(summary: DataFrame, sets: list[list[str]] | str = "cube") -> DataFrame:
    """The summary's fields, level (Spark's grouping_id: a bit for each field that is summed over, the last field's the
    lowest), matches, texts (of the finest groups, added up), distinct (estimated from the merged sketches).

    sets: "cube", "rollup", or lists of the fields to group by."""
    by = [c for c in summary.columns if c not in (MATCHES, TEXTS, SKETCH)]
    if sets == "cube":
        grouped = summary.cube(*by)
    elif sets == "rollup":
        grouped = summary.rollup(*by)
    else:
        grouped = summary.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in by])
    out = grouped.agg(F.grouping_id().alias("level"), F.sum(MATCHES).alias(MATCHES), F.sum(TEXTS).alias(TEXTS), F.hll_sketch_estimate(F.hll_union_agg(SKETCH)).alias("distinct"))
    return out.select(*by, "level", MATCHES, TEXTS, "distinct")


def _summed(grouped) -> DataFrame:
    return grouped.agg(F.sum(MATCHES).alias(MATCHES), F.sum(TEXTS).alias(TEXTS), F.hll_union_agg(SKETCH).alias(SKETCH))
