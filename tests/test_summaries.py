import random
import re
from collections import Counter, defaultdict

from spanforge.functions import compile
from spanforge.operators import summaries

PATTERN = r"(?<key>[a-c])=(?<value>\d+)"


def rows(n=300, seed=2):
    rng = random.Random(seed)
    return [(rng.choice(["x", "y", None]), None if rng.random() < 0.05 else " ".join(f"{rng.choice('abcd')}={rng.randint(0, 40)}" for _ in range(rng.randint(0, 6))), i) for i in range(n)] + [("x", "a=1", 0)] * 2


def test_merged_summaries_equal_one_of_all_rows(spark):
    data = rows()
    df = spark.createDataFrame(data, "kind string, t string, row int").repartition(4)
    make = lambda d: summaries.match_summary(d, "t", compile(PATTERN), ["kind", "key"], "value", columns=["kind"])
    whole, parts = make(df), summaries.merged(make(df.where("row % 2 = 0")), make(df.where("row % 2 = 1")))
    counts, texts, values = Counter(), Counter(), defaultdict(set)
    for kind, t, _ in data:
        found = re.findall(r"([a-c])=(\d+)", t or "")
        for key, value in found:
            for at in ((kind, key, 0), (kind, None, 1), (None, key, 2), (None, None, 3)):
                counts[at] += 1
                values[at].add(value)
        for key in {k for k, _ in found}:
            for at in ((kind, key, 0), (kind, None, 1), (None, key, 2), (None, None, 3)):
                texts[at] += 1
    want = {(*at, n, texts[at], len(values[at])) for at, n in counts.items()}
    for summary in (whole, parts):  # so few distinct values are counted exactly
        assert {tuple(r) for r in summaries.rolled_up(summary).collect()} == want
    two = {tuple(r) for r in summaries.rolled_up(parts, [["key"], []]).collect()}
    assert two == {w for w in want if w[2] in (2, 3)}
    assert {tuple(r) for r in summaries.rolled_up(whole, "rollup").collect()} == {w for w in want if w[2] != 2}
    assert summaries.match_summary(df.where("false"), "t", compile(PATTERN), ["key"], "value").count() == 0
