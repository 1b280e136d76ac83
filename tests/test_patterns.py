import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spanforge.functions import compile, escape, escape_column, match_bytes, match_is_empty, match_length
from spanforge.operators import matches

from . import spec

PATTERNS = [
    r"a", r"ab|a", r"[a-c]+", r"\bfoo\b", r"a*", r"a?b?c?", r"\d*", r"\w+(?=ing\b)", r"(?<=@)\w+", r"(['\"])[^'\"]*\1", r"(?m)^\w", r"(?m)\w$", r"\w$", r"(?:ab)+", r"(?:a|ab)+c?", r"(a)|(b)", r"(x)(y)?",
    r"\s+", r"(?i)cat", r".+?b", r"(?:a|b)*c", r"\X", r"[^a]b", r"(?s).", r"\R", r"(?!a)\w", r"x{2,3}", r"(\w)(\w)", r"\p{L}+", r"(?:[a-z]+ )+[a-z]+",
    r"a*?", r"|a", r"x??", r"\b|x", r"(?:|ab)", r"(|a)*", r"(a*)*", r"x(?:|a)*", r"(?:|a)+b", r"(?:a|)+?b", r"(?:a??b)*", r"\B", r"(?=(a))b?", r"(?=(a))a", r"(?=a(b))(a)", r"(?=(a))\1", r"(?<=(a))\w", r"(?=(\w)\1)\w+",
    r"\w+1", r"[a-z]+(?=y)", r"\w{2,}\b", r"[ab]+[bc]", r"\bab\b", r"\bx\w", r"\b[ab]+9?\b", r"a\b.", r"\b \b", r"(\w+)=(\w+)", r"\bno\bx", r"é\b", r"\bé",
]
TEXTS = [
    "", "b", "no match here", "one1two2", "\n\n", "x \r\n y", "Cat scat CATS", "naïve café", "ΣσςΑ", "→←", "food foo", "sing king ring", "cost: 5 or 55", "tail\n", "snake_case_9", "mail me@host, you@there",
    "aaa", "abac", "👍🏽x", "say 'a' or \"b\"", "xxyxxxy", "a=b c=d1", "ab ab1", "abab9 ba", "noxno", "x1y1z1",
]


def corpus():
    rng = random.Random(7)
    alphabet = ["a", "b", "c", "x", "y", "9", " ", "\n", "\r", "\t", ".", "'", " ", "é", "中", "😀", "e", "@", "A"]
    return TEXTS + ["".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(60)] + [None]


def spans(pattern, t):
    b = lambda i: len(t[:i].encode())
    return [(b(s), b(e), t[s:e]) for s, e, _ in spec.find_all(pattern, t)]


def test_iteration_after_empty_matches():
    places = lambda p, t: [(a, b) for a, b, _ in spec.find_all(p, t)]
    assert places("a*?", "aa") == [(0, 0), (1, 1), (2, 2)] and places("a*", "aa") == [(0, 2)]
    assert places("(|a)*", "a") == [(0, 0), (1, 1)] and places("|a", "a") == [(0, 0), (1, 1)]
    assert spec.find_all("(a*)*", "a") == [(0, 1, {1: (0, 1)})]


@pytest.mark.parametrize("pattern", [p for p in PATTERNS if p != r"\X"])
def test_all_routes_agree_with_the_specification(spark, pattern):
    p, texts = compile(pattern), corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    t = F.col("t")
    rows = df.select("t", "id", p.is_match(t).alias("m"), p.count(t).alias("n"), p.find(t).alias("f"), p.find_all(t).alias("a"), p.spans(t).alias("s"), p.replace(t, "$1\\").alias("r1"), p.replace_all(t, "<$0>").alias("r"), p.captures_all(t, spans=True).alias("c")).collect()
    for r in rows:
        if r.t is None:
            assert (r.m, r.n, r.f, r.a, r.s, r.r, r.r1) == (None,) * 7
            continue
        want = spans(pattern, r.t)
        assert (r.m, r.n) == (bool(want), len(want)), r.t
        assert (r.f and tuple(r.f)) == (want[0] if want else None), r.t
        assert r.a == [x[2] for x in want] and [tuple(x) for x in r.s] == want, r.t
        hits = spec.find_all(pattern, r.t)
        out, at = [], 0
        for s, e, _ in hits:
            out += [r.t[at:s], "<$0>"]
            at = e
        assert r.r == "".join([*out, r.t[at:]]), r.t
        assert r.r1 == (r.t[: hits[0][0]] + "$1\\" + r.t[hits[0][1] :] if hits else r.t), r.t
        for got, (_, _, groups) in zip(r.c, hits, strict=True):
            for g in range(1, p.group_count + 1):
                assert (got[g] and got[g].text) == (r.t[slice(*groups[g])] if g in groups else None), (r.t, g)
    table = matches.match_table(df, ["id"], "t", p).orderBy("id", "match_no").collect()
    want = [(i, k, *x) for i, t in enumerate(texts) if t is not None for k, x in enumerate(spans(pattern, t), 1)]
    assert [tuple(r) for r in table] == want


def test_captures_by_name_and_strict(spark):
    df = spark.createDataFrame([("2024-01-15",), ("none",), (None,)], "t string")
    p = compile(r"(?<year>\d{4})-(?<month>\d\d)")
    got = df.select(p.captures(F.col("t")).alias("c"), p.group(F.col("t"), 1).alias("g")).collect()
    assert got[0].c.year == "2024" and got[0].c.month == "01" and got[0].c.match == "2024-01" and got[0].g == "2024"
    assert got[1].c is None and got[2].c is None
    with pytest.raises(Exception, match="no group year"):
        df.select(p.group(F.col("t"), "year", strict=True)).collect()


def test_texts_that_hold_the_marks(spark):
    df = spark.createDataFrame([(1, "ab a"), (2, "ba")], "id long, t string")
    got = matches.match_table(df, ["id"], "t", compile("a")).orderBy("id", "match_no").collect()
    assert [(r.id, r.start) for r in got] == [(1, 0), (1, 6), (2, 1)]


def test_limits_are_errors_only_where_asked(spark):
    df = spark.createDataFrame([("x" * 4000,), ("aab",), (None,)], "t string")
    p = compile(r"(x+)(x+)+\1\2y|aab", seconds=0.3)
    long, short, null = df.select(p.try_is_match(F.col("t")).alias("m"), p.try_find(F.col("t")).alias("f"), p.try_captures(F.col("t")).alias("c")).collect()
    for x in long:
        assert x.value is None and x.error.startswith("MatchLimitExceeded")
    assert [x.error for x in short] == [None] * 3 and short.m.value is True and tuple(short.f.value) == (0, 3, "aab") and short.c.value.match == "aab" and short.c.value.group1 is None
    assert tuple(null) == (None, None, None)
    with pytest.raises(Exception, match="MatchLimitExceeded"):
        df.select(p.is_match(F.col("t"))).collect()


def test_tries_run_natively_where_no_limit_can_be_met(spark):
    df = spark.createDataFrame([("k=v",), ("none",), (None,)], "t string")
    p = compile(r"(?<key>\w)=(?<value>\w)")
    plan = df.select(p.try_is_match(F.col("t")).alias("m"), p.try_find(F.col("t")).alias("f"), p.try_captures(F.col("t")).alias("c"))
    assert "ArrowEval" not in plan._jdf.queryExecution().toString()
    hit, miss, null = plan.collect()
    assert hit.m.value and tuple(hit.f.value) == (0, 3, "k=v") and tuple(hit.c.value) == ("k=v", "k", "v")
    assert miss.m.value is False and miss.f.value is None and miss.c.value is None and miss.m.error is None
    assert tuple(null) == (None, None, None)


def test_options_that_change_no_match(spark):
    df = spark.createDataFrame([(t,) for t in ["them they the", "thermal", "", "on one only"]], "t string")
    pattern = r"\b(?:the|them|they|one|only|on)\b|the"
    plain, merging, jit = compile(pattern), compile(pattern, optimize_prefixes=True), compile(pattern, jit=True)
    t = F.col("t")
    for r in df.select(plain.find_all(t).alias("a"), merging.find_all(t).alias("b"), jit.find_all(t).alias("c")).collect():
        assert r.a == r.b == r.c
    short = compile("the|them|they", optimize_prefixes=True)
    assert len(short.explain()) < len(compile("the|them|they").explain()) + 8 and short.explain() != compile("the|them|they").explain()
    assert df.select(short.find_all(t)).first()[0] == ["the", "the", "the"]  # the first branch is still preferred


def test_match_accessors(spark):
    df = spark.createDataFrame([("é1",), ("x",)], "t string").select(compile(r"é?\d").find(F.col("t")).alias("m"))
    got = [tuple(r) for r in df.select(match_length(F.col("m")), match_is_empty(F.col("m")), match_bytes(F.col("m"))).collect()]
    assert got == [(3, False, bytearray("é1".encode())), (None, None, None)]


def test_what_every_match_holds():
    for pattern, text in (("@", "@"), (r"\w+(?=ing\b)", "ing"), (r"\bthe\b", "the"), (r"a(?!bcd)", "a"), (r"(?<=key=)\d+", "key="), (r"(?:ab|cd)x*", ""), (r"a+@[b-d]+\.e", ".e"), (r"a\b\.b", "a.b")):
        assert compile(pattern).needed == text, pattern


def test_escape(spark):
    raw = ["a.b|c d", "x+y*\n\t#", "[q](w){e}^$\\", "é-&~"]
    df = spark.createDataFrame([(r,) for r in raw], "t string")
    assert [r[0] for r in df.select(escape_column(F.col("t"))).collect()] == [escape(r) for r in raw]
    for r in raw:
        assert compile(escape(r)).is_match and df.where(compile(escape(r)).is_match(F.col("t"))).count() == 1


def test_prefilter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("Licensed x1",), ("b",)], "t string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where(compile(r"Licensed \w\d").is_match(F.col("t")))
    assert "StringContains(t,Licensed" in df._jdf.queryExecution().toString() and df.count() == 1


LONG = """
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from spanforge.functions import compile
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
df = s.createDataFrame([("ab" * 10000,), ('"' + "\\\\x" * 20000 + '"',), ("bb " * 100000 + "b",)], "t string")
for p in (r"^(?:a|b)*$", r'"(?:[^"\\\\]|\\\\.)*"', r"^(?:[a-z]+ )*[a-z]+$", r"^(?:ab)+$"):
    print(p, df.where(compile(p).is_match(F.col("t"))).count())
"""


def test_long_texts_leave_the_jvm_alive():
    """In a process of its own, since a full stack would end it."""
    root = str(Path(__file__).resolve().parent.parent)
    out = subprocess.run([sys.executable, "-c", LONG.format(root=root)], capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert [x.rsplit(" ", 1)[1] for x in out.stdout.strip().splitlines()] == ["1", "1", "2", "1"], out.stdout


def test_stream(spark, tmp_path):
    from spanforge.streaming import match_rates, matching

    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts, if(id % 3 = 0, 'error a', 'fine') AS t FROM range(180)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    p = compile("error")
    q = matching(stream, "t", p).writeStream.format("memory").queryName("hits").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("hits").count() == 60
    q = match_rates(stream, "ts", "t", p).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.matches for r in spark.table("rates").collect()) == [20, 20, 20]


def test_sources(spark, tmp_path):
    from spanforge import sources

    (tmp_path / "a.txt").write_text("one\ntwo")
    assert sources.read_texts(spark, str(tmp_path / "a.txt")).first().text == "one\ntwo"
    (tmp_path / "b.json").write_text('{"text": "x"}\n')
    assert sources.read_json_texts(spark, str(tmp_path / "b.json")).first().text == "x"
    df = spark.createDataFrame([(1, "ab")], "id long, t string")
    sources.write_matches(matches.match_table(df, ["id"], "t", compile("b")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first().start == 1


def test_table_function(spark):
    matches.register(spark)
    got = spark.sql("SELECT id, m.* FROM VALUES (1, 'aXbX'), (2, 'n'), (3, null) AS v(id, t), LATERAL matches(t, 'X') m").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, 2, "X"), (1, 2, 3, 4, "X")]


def test_sliding_windows_and_late_rows(spark, tmp_path):
    from spanforge.streaming import match_rates

    at = "timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,{})"
    schema = None
    for i, (first, last) in enumerate([(0, 1800), (3600, 5400), (60, 120)]):  # the last file comes far too late
        rows = spark.sql(f"SELECT {at.format('id')} AS ts, 'error' AS t FROM range({first}, {last}, 10)").coalesce(1)
        schema = rows.schema
        rows.write.mode("append").parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    rates = match_rates(stream, "ts", "t", compile("error"), window="10 minutes", slide="5 minutes", late="10 minutes")
    q = rates.writeStream.format("memory").queryName("slid").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.window_start.isoformat(): r.matches for r in spark.table("slid").collect()}
    assert got["2024-01-01T00:05:00"] == 60 and got["2023-12-31T23:55:00"] == 30  # late rows add nothing
