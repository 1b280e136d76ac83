import random
import re

import pytest

from spanforge.operators import literals


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_semi_join_of_any_number_of_values(spark, monkeypatch, few):
    monkeypatch.setattr(literals, "FEW", few)
    rng = random.Random(3)
    say = lambda n: "".join(rng.choices("abé\n 中", k=n))
    texts = [say(rng.randint(0, 60)) for _ in range(80)] + [None, "same", "same", "x" * 2_100_000 + "needle in the end"]
    words = [say(n) for n in (2, 3, 4, 5, 6, 8, 9, 15, 16, 17, 20)] + [texts[5][3:30], texts[9][1:9], None, "sam", "xneedle in the e"]
    df = spark.createDataFrame([(t, i, 1, 2) for i, t in enumerate(texts)], "t string, h1 int, anchor int, value int").repartition(3)
    w = spark.createDataFrame([(x,) for x in words if x != ""], "w string")
    want = sorted(i for i, t in enumerate(texts) if t is not None and any(x in t for x in words if x))
    got = literals.literal_semi_join(df, "t", w, "w")
    assert got.columns == df.columns and sorted(r.h1 for r in got.collect()) == want and 0 < len(want) < len(texts)
    assert literals.literal_semi_join(df, "t", w.union(spark.createDataFrame([("",)], "w string")), "w").count() == len(texts) - 1
    none = spark.createDataFrame([], "w string")
    assert literals.literal_semi_join(df, "t", none, "w").count() == 0 and literals.literal_semi_join(df.where("false"), "t", w, "w").count() == 0


def brute(text, words):
    """From the left, the longest whole word at each place."""
    ordered = sorted(words, key=lambda w: (-len(w), w))
    pattern = re.compile(r"(?<![0-9A-Za-z_])(?:" + "|".join(map(re.escape, ordered)) + r")(?![0-9A-Za-z_])")
    return [(len(text[: m.start()].encode()), len(text[: m.end()].encode()), m.group()) for m in pattern.finditer(text)]


def test_dictionary_join_against_one_alternation(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abc1_é", k=rng.randint(1, 5)))
    words = {word() for _ in range(60)} | {f"{word()} {word()}" for _ in range(60)} | {"a very long entry of the dictionary, with 40 bytes and more", "a very long entry", "a-b", "long entry of"}
    able = {w for w in words if re.fullmatch(r"[0-9A-Za-z_](?:.*[0-9A-Za-z_])?", w)}
    pool = sorted(words)
    texts = ["".join(rng.choice([rng.choice(pool), word(), " ", "-", ", ", "\n", "é"]) for _ in range(rng.randint(0, 30))) for _ in range(120)]
    texts += ["a very long entry of the dictionary, with 40 bytes and more or less", "xa very long entry of it", "", None]
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in enumerate(texts)], "id int, t string, start int, k0 string").repartition(3)
    dictionary = spark.createDataFrame([(w,) for w in [*words, None, "a-b", "", "é", "- a"]], "w string")
    got = literals.dictionary_join(df, ["id", "k0"], "t", dictionary, "w")
    want = [(i, "k", k, *m) for i, t in enumerate(texts) if t is not None for k, m in enumerate(brute(t, able), 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 300
    assert literals.dictionary_join(df, ["id"], "t", dictionary.where("false"), "w").count() == 0
    assert literals.dictionary_join(df.where("false"), ["id"], "t", dictionary, "w").count() == 0


def test_a_dictionary_of_very_many_words(spark):
    words = spark.range(120_000).selectExpr("concat('word', id) AS w")
    texts = spark.createDataFrame([(i, f"word{i * 700} and sword{i} or word{i * 700}7x, word{10**9 + i} word{i}") for i in range(300)], "id int, t string")
    got = {(r.id, r.text) for r in literals.dictionary_join(texts, ["id"], "t", words, "w").collect()}
    assert got == {(i, w) for i in range(300) for w in (f"word{i * 700}", f"word{i}") if int(w[4:]) < 120_000}
