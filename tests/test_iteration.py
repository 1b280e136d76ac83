"""Iteration on all routes: random patterns on random texts, and long texts outside the JVM."""

import random
import time

import pytest
from pyspark.sql import functions as F

from spanforge.functions import compile, outside
from spanforge.functions.patterns import rows_of
from spanforge.operators import matches

from . import spec

RUNS = [r"\w+-\w", r"\d+\.\d", r"[ab]+c[ab]", r"(\w+)-\w", r"a+(?=b)", r"[a-c]+[bc]", r"(a+)b\1", r"\w{2,}\d", r"[ab]+(?:c|ab)", r"(?:a+)b", r"\w+?1", r"a+b?c", r"[^c]+c", r"\w+\b.\w"]
CASES = {r"\w+-\w": ("a-bc-d", ["a-b", "c-d"]), r"\d+\.\d": ("1.23.4", ["1.2", "3.4"]), r"[ab]+c[ab]": ("acabcb", ["aca", "bcb"])}


def pattern(rng, depth=3):
    """A random pattern of the dialect's common parts."""
    kind = rng.random()
    if depth == 0 or kind < 0.35:
        return rng.choice(["a", "b", "c", "1", "-", r"\.", r"\w", r"\d", "[ab]", "[^a]", "[b-d1]", ".", "é", r"\s"])
    if kind < 0.55:
        body = pattern(rng, 0) if rng.random() < 0.7 else f"(?:{pattern(rng, depth - 1)})"
        return body + rng.choice(["+", "+", "*", "?", "{2}", "{1,3}", "+?", "*?", "{2,}"])
    if kind < 0.85:
        return "".join(pattern(rng, depth - 1) for _ in range(rng.randint(2, 3)))
    if kind < 0.9:
        return f"({pattern(rng, depth - 1)})"
    if kind < 0.95:
        return f"(?:{pattern(rng, depth - 1)}|{pattern(rng, depth - 1)})"
    return rng.choice([r"\b", r"(?=a)", r"(?!b)", r"(?<=a)", r"(?<!1)", "^", "$"]) + pattern(rng, depth - 1)


def texts(rng, n=100):
    return ["".join(rng.choices("aabbc11-. é\n", k=rng.randint(0, 18))) for _ in range(n)] + [t for t, _ in CASES.values()]


def test_random_patterns_agree_on_all_routes(spark):
    rng = random.Random(20)
    patterns = RUNS + [pattern(rng) for _ in range(200)]
    data = texts(rng)
    df, t = spark.createDataFrame([(x,) for x in data], "t string"), F.col("t")
    native = 0
    for at in range(0, len(patterns), 30):
        some = [compile(p) for p in patterns[at : at + 30]]
        native += sum(p.route("find_all") == "native" for p in some)
        shown = [c for i, p in enumerate(some) for c in (p.find_all(t).alias(f"a{i}"), p.count(t).alias(f"n{i}"), p.replace_all(t, "<>").alias(f"r{i}"))]
        for row in df.select(t, *shown).collect():
            for i, p in enumerate(some):
                want = [m.group() for m in outside.found(p._spelled(set(), python=True).text, row.t, None)]
                assert row[f"a{i}"] == want and row[f"n{i}"] == len(want), (p.pattern, row.t)
                assert row[f"r{i}"].count("<>") == len(want), (p.pattern, row.t)
    assert native > 100
    for p in rng.sample(patterns, 60):
        for x in data[:25]:
            assert [m["text"] for m in rows_of(p, x)] == [x[a:b] for a, b, _ in spec.find_all(p, x)], (p, x)


@pytest.mark.parametrize("which", sorted(CASES))
def test_a_match_may_start_where_one_ended_inside_a_run(spark, which):
    text, want = CASES[which]
    p, df, t = compile(which), spark.createDataFrame([(1, text)], "id long, t string"), F.col("t")
    row = df.select(p.find_all(t).alias("a"), p.count(t).alias("n"), p.replace_all(t, "#").alias("r"), F.size(p.captures_all(t)).alias("c")).first()
    assert p.route("find_all") == "native" and row.a == want and row.n == row.c == len(want) and row.r.count("#") == len(want)
    assert [r.text for r in matches.match_table(df, ["id"], "t", p).orderBy("match_no").collect()] == want


@pytest.mark.parametrize("text", ["word and é " * 450_000, "plain words " * 420_000])
def test_long_texts_outside_take_linear_time(text):
    """5 MB and more, with the default limit of 10 s of searching."""
    begun = time.time()
    found = rows_of(r"\w+", text)
    assert len(found) > 800_000 and time.time() - begun < 40
    raw = text.encode()
    for m in random.Random(1).sample(found, 50) + found[-1:]:
        assert raw[m["start"] : m["end"]].decode() == m["text"]


def test_only_searching_counts_for_the_limit():
    seen = 0
    for _ in outside.found(r"a", "a" * 30, 0.05):
        time.sleep(0.01)
        seen += 1
    assert seen == 30


GROUPED = [r"(a)|(b)", r"(x)(y)?", r"(a)?(b)?c", r"(?:(a)|b)*c", r"(a+)?-(b)?", r"((a)b)?c", r"(?=(a))\w", r"(\w)(?:-(\d))?", r"(a)(?:b|(c))", r"(?:(a)|(b)|c)+", r"(?<x>\d)(?<y>\.\d)?(?<z>a|b)?", r"(a)(b)?\1", r"(?:(b)c)?a", r"(a(b(c)?)?)"]
PLACED = [r"(a+)(b)?", r"-(\w)(\d)?", r"(a(b)(c)?)1", r"\b(a)\w(b)?", r"x?(\w+)[. ](\w)", r"((a)(b))c", r"(é)(\d)", r"(?<=a)(b)(c)?", r"(\w)(\w)\1", r"(\d+)(?=\.)", r"a(b|c)(1)?"]
NULLABLE = [r"a*", r"\b|x", r"a*?", r"|a", r"(?:|a)+b?", r"\d*", r"(?=a)", r"\B", r"(?!b)", r"(?:ab?)*", r"$", r"(?m)^", r"[^a]*", r"(?<!a)", r"x?\b", r"a??b?"]


def test_groups_that_may_take_no_part_are_native(spark):
    rng = random.Random(6)
    data = texts(rng, 120) + ["ac", "xy x", "bca", "abcabc", "aba", "😀a", "é1", ""]
    df, t = spark.createDataFrame([(x,) for x in data], "t string"), F.col("t")
    some = [compile(p) for p in GROUPED]
    assert all(p.route("captures_all") == "native" for p in some), [p.pattern for p in some if p.route("captures_all") != "native"]
    shown = [c for i, p in enumerate(some) for c in (p.captures(t).alias(f"c{i}"), p.captures_all(t).alias(f"a{i}"))]
    plan = df.select(t, *shown)
    assert "ArrowEval" not in plan._jdf.queryExecution().toString()
    for row in plan.collect():
        for i, p in enumerate(some):
            hits = spec.find_all(p.pattern, row.t)
            want = [(row.t[a:b], *(row.t[slice(*g[k])] if k in g and k not in p.unseen else None for k in range(1, p.group_count + 1))) for a, b, g in hits]
            assert [tuple(x) for x in row[f"a{i}"]] == want, (p.pattern, row.t)
            assert (row[f"c{i}"] and tuple(row[f"c{i}"])) == (want[0] if want else None), (p.pattern, row.t)
    assert compile(r"(a*)?b").route("captures") == "outside"


def test_groups_are_placed_natively(spark):
    rng = random.Random(8)
    data = texts(rng, 120) + ["abc1", "é1", "éabc x1", "😀ab", "aXa bcb"]
    df, t = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "id int, t string"), F.col("t")
    some = [compile(p) for p in PLACED]
    native = [p for p in some if p.route("capture_spans") == "native"]
    assert len(native) >= len(some) - 2
    plan = df.select(t, *[p.captures(t, spans=True).alias(f"c{i}") for i, p in enumerate(native)])
    assert "ArrowEval" not in plan._jdf.queryExecution().toString()
    byte = lambda x, i: len(x[:i].encode())

    def placed(p, x):
        for a, b, g in spec.find_all(p.pattern, x):
            yield tuple((byte(x, s[0]), byte(x, s[1]), x[s[0] : s[1]]) if s else None for s in [(a, b), *(g.get(k) if k not in p.unseen else None for k in range(1, p.group_count + 1))])

    for row in plan.collect():
        for i, p in enumerate(native):
            got = row[f"c{i}"] and tuple(x and tuple(x) for x in row[f"c{i}"])
            assert got == next(placed(p, row.t), None), (p.pattern, row.t)
    for p in some[:4]:
        rows = sorted(matches.capture_table(df, ["id"], "t", p, spans=True).collect(), key=lambda r: (r.id, r.match_no))
        want = [(i, k, *m) for i, x in enumerate(data) for k, m in enumerate(placed(p, x), 1)]
        assert [(r[0], r[1], *(x and tuple(x) for x in r[2:])) for r in rows] == want, p.pattern


def test_patterns_that_may_match_nothing_are_native(spark):
    rng = random.Random(4)
    data = texts(rng, 60) + ["😀", "a😀😀b", "aa😀", "é", "", "b", "aab", "x x", "中a", "a"]
    df, t = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "id int, t string"), F.col("t")
    some = [p for p in map(compile, NULLABLE) if p.route("find_all") == "native"]
    assert len(some) >= len(NULLABLE) - 2  # loops over groups
    shown = [c for i, p in enumerate(some) for c in (p.is_match(t).alias(f"m{i}"), p.find_all(t).alias(f"a{i}"), p.count(t).alias(f"n{i}"), p.replace_all(t, "<>").alias(f"r{i}"), p.replace(t, "<>").alias(f"o{i}"), p.find(t).alias(f"f{i}"))]
    plan = df.select("id", t, *shown)
    assert "ArrowEval" not in plan._jdf.queryExecution().toString()
    for row in plan.collect():
        for i, p in enumerate(some):
            hits = spec.find_all(p.pattern, row.t)
            where = (p.pattern, row.t)
            assert row[f"a{i}"] == [row.t[a:b] for a, b, _ in hits] and row[f"n{i}"] == len(hits) and row[f"m{i}"] == bool(hits), where
            out, at = [], 0
            for a, b, _ in hits:
                out += [row.t[at:a], "<>"]
                at = b
            assert row[f"r{i}"] == "".join([*out, row.t[at:]]), where
            first = hits[0][:2] if hits else None
            assert row[f"o{i}"] == (row.t[: first[0]] + "<>" + row.t[first[1] :] if first else row.t), where
            byte = lambda k, x=row.t: len(x[:k].encode())
            assert (row[f"f{i}"] and tuple(row[f"f{i}"])) == (first and (byte(first[0]), byte(first[1]), row.t[slice(*first)])), where
    for p in some[:6]:
        got = sorted((r.id, r.match_no, r.start, r.end, r.text) for r in matches.match_table(df, ["id"], "t", p).collect())
        assert got == sorted((i, k, *m.values()) for i, x in enumerate(data) for k, m in enumerate(rows_of(p.pattern, x), 1)), p.pattern


def test_a_pattern_as_a_table_function_of_sql(spark):
    rng = random.Random(12)
    data = texts(rng, 60) + ["\ue000a'\ue001 b\\'c", "😀é1", None, ""]
    spark.createDataFrame([(i, x) for i, x in enumerate(data)], "id int, t string").createOrReplaceTempView("sql_texts")
    for k, pattern in enumerate([r"[a-c]+(?:1|-)?", r"(?<=a)\w", r"\\'\w|'", r"\w+\b", "é"]):
        matches.register_pattern(spark, f"found_{k}", compile(pattern))
        df = spark.sql(f"SELECT v.id, m.* FROM sql_texts v, LATERAL found_{k}(v.t) m")
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
        want = [(i, j, *m.values()) for i, x in enumerate(data) if x is not None for j, m in enumerate(rows_of(pattern, x), 1)]
        assert sorted(map(tuple, df.collect())) == sorted(want), pattern
    for pattern in ("a*", r"(?:a|ab)+c"):
        with pytest.raises(ValueError, match="not native"):
            matches.register_pattern(spark, "none", compile(pattern))


def test_places_in_long_texts_take_linear_time_in_the_jvm(spark):
    text = "plain words é " * 100_000
    df = spark.createDataFrame([(1, text)], "id int, t string")
    begun = time.time()
    table = matches.match_table(df, ["id"], "t", compile(r"\w+"))
    last = table.selectExpr("max(struct(match_no, start, end, text)) AS m", "count(*) AS n").first()
    assert "Python" not in table._jdf.queryExecution().executedPlan().toString() and "Exchange" not in table._jdf.queryExecution().executedPlan().toString()
    assert last.n == 200_000 and tuple(last.m) == (200_000, len(text.encode()) - 9, len(text.encode()) - 4, "words") and time.time() - begun < 60
