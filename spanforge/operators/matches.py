"""Matches as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.patterns import Pattern, rows_of


def match_table(df: DataFrame, keys: list[str], text_col: str, pattern: Pattern) -> DataFrame:
    """keys, match_no (from 1), start, end (bytes), text: one row for each match; no row leaves its place."""
    rows = df.select(*keys, F.posexplode(pattern.spans(F.col(text_col))).alias("n", "m"))
    return rows.select(*keys, (F.col("n") + 1).alias("match_no"), "m.start", "m.end", "m.text")


def capture_table(df: DataFrame, keys: list[str], text_col: str, pattern: Pattern, spans: bool = False) -> DataFrame:
    """keys, match_no, and a column for the match and each group; spans: as start, end (bytes) and text."""
    rows = df.select(*keys, F.posexplode(pattern.captures_all(F.col(text_col), spans)).alias("n", "m"))
    return rows.select(*keys, (F.col("n") + 1).alias("match_no"), "m.*")


def tokenize(df: DataFrame, keys: list[str], text_col: str, pattern: Pattern) -> DataFrame:
    """keys, position (from 0), token."""
    return df.select(*keys, F.posexplode(pattern.find_all(F.col(text_col))).alias("position", "token"))


def token_counts(df: DataFrame, text_col: str, pattern: Pattern) -> DataFrame:
    """token, n: counted on the map side before the shuffle."""
    return df.select(F.explode(pattern.find_all(F.col(text_col))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def dictionary_matches(df: DataFrame, keys: list[str], text_col: str, words: list[str], ignore_case: bool = False) -> DataFrame:
    """keys, word, n for each of a driver's words that a text holds as a whole word.

    All words are one alternation, so the text is searched once, and no text meets a word in a join."""
    from ..functions.patterns import compile, escape

    ordered = sorted(set(words), key=lambda w: (-len(w), w))
    pattern = compile(("(?i)" if ignore_case else "") + r"\b(?:" + "|".join(map(escape, ordered)) + r")\b", optimize_prefixes=False)
    found = df.select(*keys, F.explode(pattern.find_all(F.col(text_col))).alias("word"))
    if ignore_case:
        found = found.withColumn("word", F.lower("word"))
    return found.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))


@udtf(returnType="match_no int, start int, end int, text string")
class MatchRows:
    """One row for each match of a pattern in a text; null gives none."""

    def eval(self, text: str | None, pattern: str | None):
        if text is None or pattern is None:
            return
        for k, m in enumerate(rows_of(pattern, text), 1):
            yield k, m["start"], m["end"], m["text"]


def register_pattern(spark: SparkSession, name: str, pattern: Pattern) -> None:
    """Makes one pattern a table function of SQL: SELECT ... FROM t, LATERAL name(t.text), with match_no, start, end (bytes)
    and text. Its body is the pattern's native spelling, so the plan holds Spark's own functions alone.

    ValueError for patterns of the route outside and for those that may match nothing (their rows: `register`)."""
    if pattern.nullable or pattern.route("find_all") != "native":
        raise ValueError(f"not native, or may match nothing: {pattern.pattern}")
    java = "'" + pattern._java().replace("\\", "\\\\").replace("'", "\\'") + "'"
    row = "STRUCT<match_no INT, start INT, end INT, text STRING>"
    begun, ended = "acc.at + octet_length(x.gap)", "acc.at + octet_length(x.gap) + octet_length(x.found)"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(value STRING) RETURNS TABLE (match_no INT, start INT, end INT, text STRING)
        RETURN SELECT m.match_no, m.start, m.end, m.text FROM (SELECT explode(aggregate(
            zip_with(slice(split(value, {java}), 1, size(regexp_extract_all(value, {java}, 0))), regexp_extract_all(value, {java}, 0), (g, f) -> named_struct('gap', g, 'found', f)),
            named_struct('at', 0, 'out', CAST(array() AS ARRAY<{row}>)),
            (acc, x) -> named_struct('at', {ended}, 'out', array_append(acc.out, CAST(named_struct('match_no', size(acc.out) + 1, 'start', {begun}, 'end', {ended}, 'text', x.found) AS {row}))),
            acc -> acc.out)) AS m)""")


def register(spark: SparkSession, name: str = "matches") -> None:
    """Makes the table function known to SQL: SELECT ... FROM t, LATERAL matches(t.text, 'pattern')."""
    spark.udtf.register(name, MatchRows)
