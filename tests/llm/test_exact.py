import hashlib
from collections import defaultdict

import pytest

from spanforge.llm import exact

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, best):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(FOLD)].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = best([i for i in ids if i is not None], default=None)
        out += [(i, keep, len(ids), i is not None and i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("keep", "best"), [("max", max), ("min", min)])
def test_against_brute_force(odd, keep, best):
    want = brute([(r.doc_id, r.text) for r in odd.collect()], best)
    assert sorted((tuple(r) for r in exact.exact_dedup(odd, keep=keep).collect()), key=repr) == want


def test_heavy_groups_are_salted_and_whole(spark):
    rows = [(i, "Same text") for i in range(3000)] + [(5000 + i, f"text {i % 900}") for i in range(1800)] + [(None, "same TEXT")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((tuple(r) for r in exact.exact_dedup(df).collect()), key=repr) == brute(rows, max)


def test_only_dataframe_functions(odd, none):
    plan = exact.exact_dedup(odd)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas")) and "rangepartitioning" in plan.lower()
    assert exact.exact_dedup(none).count() == 0
