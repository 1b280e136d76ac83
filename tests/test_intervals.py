import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spanforge.functions import compile
from spanforge.functions.patterns import rows_of
from spanforge.operators import intervals


def spans(rng, n, texts=4, far=400):
    out = []
    for i in range(n):
        start = rng.choice([rng.randrange(-50, far), rng.randrange(5)])
        out.append((rng.choice([*range(texts), None]), rng.choice(["x", "y"]), rng.choice([start, start, start, None]), start + rng.choice([0, 1, 3, 20, 300]), i))
    return out + out[:3]


@pytest.mark.parametrize(("within", "width"), [(0, None), (-1, 8), (7, 5), (60, None), (3, 1000)])
def test_interval_join_against_all_pairs(spark, within, width):
    rng = random.Random(within)
    a, b = spans(rng, 120), spans(rng, 90)
    schema = "id int, kind string, start int, end int, gap int"  # gap clashes with the result's
    got = intervals.interval_join(*(spark.createDataFrame(x, schema).repartition(3) for x in (a, b)), ["id", "kind"], within, width=width)
    assert got.columns == ["id", "kind", "a", "b", "gap"]
    want = []
    for x in a:
        for y in b:
            if x[:2] == y[:2] and None not in (x[0], x[2], y[2]):
                gap = max(y[2] - x[3], x[2] - y[3])
                if gap <= within:
                    want.append((*x[:2], x[2:], y[2:], gap))
    assert sorted((r.id, r.kind, tuple(r.a), tuple(r.b), r.gap) for r in got.collect()) == sorted(want) and len(want) > 50


def brute_asof(left, right, at_l, at_r, keys, strictly, forward, within):
    out = []
    for x in left:
        best = None
        for y in right:
            if None in (*(x[k] for k in keys), *(y[k] for k in keys), x[at_l], y[at_r]) or any(x[k] != y[k] for k in keys):
                continue
            apart = (y[at_r] - x[at_l]) if forward else (x[at_l] - y[at_r])
            if apart < apart * 0 or (strictly and apart == apart * 0) or (within is not None and apart > within):
                continue
            if best is None or (-apart, y[2]) > best[:2]:
                best = (-apart, y[2], y)
        out.append((x, best and best[2]))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("strictly", "forward", "within", "width"), [(False, False, None, 10), (True, False, None, 1), (False, True, None, 1000), (True, True, 6, 7), (False, False, 3, 50)])
def test_asof_join_against_all_pairs(spark, strictly, forward, within, width):
    rng = random.Random(5)
    row = lambda i: (rng.choice([1, 2, 3, None]), rng.choice([rng.randrange(-30, 200), 7, None]), i)
    left, right = [row(i) for i in range(150)], [row(i) for i in range(60)]
    left += left[:4]
    schema = "k int, at long, n int"
    got = intervals.asof_join(*(spark.createDataFrame(x, schema).repartition(3) for x in (left, right)), ["k"], "at", "at", width, ["n"], strictly, forward, within)
    assert sorted(((tuple(r)[:3], r.found and tuple(r.found)) for r in got.collect()), key=repr) == brute_asof(left, right, 1, 1, [0], strictly, forward, within)


def test_asof_join_of_times_and_clashing_names(spark):
    t0, rng = datetime(2024, 1, 1), random.Random(3)
    left = [(rng.randrange(3), t0 + timedelta(milliseconds=rng.randrange(90_000)), i, "l", {"m": i}) for i in range(80)]
    right = [(rng.randrange(3), t0 + timedelta(milliseconds=rng.randrange(90_000)), i, "r", {"m": i}) for i in range(40)]
    a = spark.createDataFrame(left, "k0 int, at timestamp, found int, bin string, r map<string,int>")
    b = spark.createDataFrame(right, "k0 int, at timestamp, found int, bin string, l map<string,int>")
    got = intervals.asof_join(a, b, ["k0"], "at", "at", 10, ["found"], within=20)
    want = brute_asof(left, right, 1, 1, [0], False, False, timedelta(seconds=20))
    rows = got.toDF("k0", "at", "number", "bin", "r", "other").collect()
    assert sorted(((tuple(r)[:5], r.other and tuple(r.other)) for r in rows), key=repr) == want
    none = b.where("false")
    assert all(r.other is None for r in intervals.asof_join(a, none, ["k0"], "at", "at", 10).toDF("k0", "at", "number", "bin", "r", "other").collect())
    assert intervals.asof_join(a.where("false"), b, ["k0"], "at", "at", 10).count() == 0


TEXTS = ["Ab 12 cd E9, é7F xx 3", "", None, "A1B22C333  4", "5 5 5 HEAD 6 é 7 TAIL", "no", "中A1"]


def test_near_matches_and_last_before(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "id int, t string, gap int")
    a, b = "[A-Z]+", r"\d+"
    placed = lambda p: [(i, k, *m.values()) for i, t in enumerate(TEXTS) if t is not None for k, m in enumerate(rows_of(p, t), 1)]
    for after in (False, True):
        want = [(x[0], *x[1:], *y[1:], max(y[2] - x[3], x[2] - y[3])) for x in placed(a) for y in placed(b) if x[0] == y[0] and max(y[2] - x[3], x[2] - y[3]) <= 3 and (not after or y[2] >= x[3])]
        got = intervals.near_matches(df, ["id"], "t", compile(a), compile(b), 3, after)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    want = []
    for x in placed(b):
        marks = [y for y in placed(a) if y[0] == x[0] and y[3] <= x[2]]
        want.append((*x, *(max(marks, key=lambda y: y[3])[1:] if marks else (None,) * 4)))
    for width in (1 << 16, 4):
        got = intervals.last_before(df, ["id"], "t", compile(a), compile(b), width)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_no_nested_loop_and_no_python(spark):
    df = spark.createDataFrame([(1, "A1")], "id int, t string")
    for out in (intervals.near_matches(df, ["id"], "t", compile("[A-Z]+"), compile(r"\d+"), 3), intervals.last_before(df, ["id"], "t", compile("[A-Z]+"), compile(r"\d+"))):
        plan = out.where(F.lit(True))._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
