import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import langid, quality
from spanforge.llm.common import held_out
from spanforge.llm.queries import op2_language_id, op5_quality

DATA = "/root/testdata/sf0.01"


def test_held_out_language_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang", "text")
    rows = op2_language_id(spark, DATA).join(docs, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and 0.15 < len(held) / len(rows) < 0.35
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) / len(rows) < 0.01
    again = {r.doc_id: r.score for r in op2_language_id(spark, DATA).collect()}
    assert all(again[r.doc_id] == r.score for r in rows)


def test_language_of_odd_rows(odd, none):
    model = langid.train(odd, ~held_out(F.col("doc_id")))
    rows = langid.predict(odd, model, prefix="x_").collect()
    assert len(rows) == odd.count() and rows[0].asDict().keys() >= set(odd.columns)
    for r in rows:
        if not r.text or not any(unicodedata.category(c)[0] == "L" for c in r.text):
            assert (r["x_lang_pred"], r["x_score"], r["x_rejected"]) == ("und", 0.0, True)
        else:
            assert r["x_lang_pred"] in ("en", "fr")
    assert [model.predict(t)[0] for t in ("½ ² ①", "Ⅷ", "²", "٣ 7", "!?")] == ["und"] * 5 and model.predict("ª")[0] != "und"
    kept = langid.recognised(odd, model)
    assert kept.schema == odd.schema
    assert kept.count() == sum(not r["x_rejected"] for r in rows)
    empty = langid.train(none, F.lit(True))
    assert langid.predict(none, empty).count() == 0
    assert {r.lang_pred for r in langid.predict(odd.select("doc_id", "text"), empty).collect()} == {"und"}


def test_subwords_read_the_whole_text(monkeypatch):
    text = "Héllo wörld, again and again " * 400
    whole = np.bincount(np.concatenate([*langid.subwords(text)]), minlength=langid.BUCKETS)
    monkeypatch.setattr(langid, "_CHUNK", 997)
    assert np.abs(np.bincount(np.concatenate([*langid.subwords(text)]), minlength=langid.BUCKETS) - whole).sum() < 0.02 * whole.sum()


def test_strange_text_is_rejected():
    rng = random.Random(1)
    say = lambda parts: " ".join("".join(rng.choices(parts, k=3)) for _ in range(60))
    a, b = ["the", "ing", "er", "on"], ["que", "os", "ión", "ar"]
    model = langid.fit([(say(a), "a") for _ in range(150)] + [(say(b), "b") for _ in range(150)])
    assert model.predict(say(a))[0] == "a" and model.predict(say(b))[0] == "b"
    assert not model.predict(say(a))[2] and 0 < model.reject_below <= 0.5


def test_held_out_quality(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality")
    rows = op5_quality(spark, DATA).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    area = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert area >= 0.95
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.93
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)


def test_risk_is_kept_from_falling_below_zero():
    rng = np.random.default_rng(2)
    p, u = rng.normal(1, 1, (200, 3)), np.concatenate([rng.normal(1, 1, (300, 3)), rng.normal(-1, 1, (300, 3))])
    w = quality.nonnegative_risk(p, u, 0.5)
    assert (u[:300] @ w).mean() > 0 > (u[300:] @ w).mean()
    s = lambda x: 1 / (1 + np.exp(-x @ w))
    assert s(u).mean() - 0.5 * s(p).mean() > -0.05


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (6, 1), (20, 1), (21, 0), (22, 0), (None, 1), (30, None), (5, 1)], "doc_id long, quality int")
    model = quality.train(odd, labels, lambda c: ~held_out(c))
    rows = quality.score(odd.drop("score"), model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1
    clashing = labels.union(spark.createDataFrame([(5, 0), (6, None), (21, 0)], labels.schema))  # the largest label of an id counts
    assert np.array_equal(quality.train(odd, clashing, lambda c: ~held_out(c)).weights, model.weights)
    blank = quality.train(none, labels.limit(0), lambda c: ~held_out(c))
    assert {r.score for r in quality.score(odd.drop("score"), blank).collect()} == {0.5}
    assert quality.score(none.drop("score"), blank).count() == 0


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_prior_of_mixtures(share):
    rng = np.random.default_rng(11)
    good = quality.bins(rng.normal(1.5, 1, 2000))
    mixed = quality.bins(np.concatenate([rng.normal(1.5, 1, int(20000 * share)), rng.normal(-1.5, 1, int(20000 * (1 - share)))]))
    count = lambda x: np.bincount(x, minlength=quality.BINS)
    assert abs(quality.estimate_prior(count(good), count(mixed)) - share) < 0.06
    assert quality.estimate_prior(count(good[:0]), count(mixed)) == 0.5


def test_calibration_without_negatives():
    rng = np.random.default_rng(12)
    good, bad = rng.normal(2, 1, 3000), rng.normal(-1, 1, 7000)
    a, b = quality.calibrated(rng.normal(2, 1, 1000), np.concatenate([good, bad]), 0.3)
    s = lambda x: 1 / (1 + np.exp(-(a * x + b)))
    score = s(np.concatenate([good, bad]))
    assert abs(score.mean() - 0.3) < 0.02
    near = (score > 0.4) & (score < 0.6)
    assert 0.3 < near[:3000].sum() / near.sum() < 0.7


@pytest.mark.parametrize("text", [None, "", "a"])
def test_features_sum(text):
    f = quality.features(text)
    assert f[-1] == 1 and f[:-1].sum() == pytest.approx(1.0 if text else 0.0)
