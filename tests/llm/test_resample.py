import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from spanforge.llm import resample

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def grams(text, least, most):
    w = tokens(text)
    return [" ".join(w[i : i + k]) for k in range(least, most + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, least=1, most=1, buckets=10_000, least_words=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode("utf-8")) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, grams(text, least, most)))
    for text in target:
        t.update(map(bucket, grams(text, least, most)))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for i, text in docs:
        found = grams(text, least, most)
        weight = math.floor(sum(gain(bucket(f)) for f in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(found), weight, score, None, len(tokens(text))])
    able = sorted((r for r in rows if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize(("most", "frequent", "percent"), [(1, 1 << 17, 10), (1, 50, 60), (2, 400, 100), (3, 1, 35)])
def test_against_brute_force(spark, odd, monkeypatch, most, frequent, percent):
    monkeypatch.setattr(resample, "FREQUENT", frequent)
    texts = ["alpha beta gammas, delta", None, "", "the THE x" + "y" * 90, "été zeta" * 30]
    target = spark.createDataFrame([(t, 1, 2) for t in texts], "text string, n long, bucket int")
    got = resample.resampling_report(odd, target, most=most, percent=percent)
    want = brute([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], texts, 1, most, percent=percent)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert any(r[4] for r in want) and any(len(f) >= resample.LONG for t in texts for f in tokens(t))


def test_drawn_rows_are_whole_and_as_many_as_ranked(spark, odd):
    target = spark.createDataFrame([("alpha beta",)], "text string")
    ranked = resample.resampling_report(odd, target, percent=60).where("rank is not null").count()
    rows = resample.drawn(odd, target, percent=60)
    assert rows.columns == odd.columns and rows.count() == ranked
    have = Counter(repr(r) for r in odd.collect())
    assert not Counter(repr(r) for r in rows.collect()) - have


def test_empty_tables(spark, none, odd):
    target = spark.createDataFrame([], "text string")
    assert resample.resampling_report(none, target).collect() == [] and resample.drawn(none, target).collect() == []
    got = resample.resampling_report(odd, target).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], [])


def test_a_task_passes_on_what_it_holds(spark, odd, monkeypatch):
    counts = lambda: {bytes(r.feature): r.n for r in resample.counted(odd, "text", 1, 2).collect()}
    whole = counts()
    want = Counter(f.encode() for r in odd.collect() for f in grams(r.text, 1, 2))
    monkeypatch.setattr(resample, "HELD", 3)
    assert counts() == whole == want
