import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, target string, score string, copies int, node string, line string, label string, data string, media string, piece int, start string"
#: Columns named as operators name theirs.
CLASHING = ["__k1", "__k2", "k1", "k2", "doc", "gone", "__gone", "rejected", "__rejected", "__score", "lang_pred", "copies_", "__copies", "__row", "turn", "times", "__size", "__source", "__part", "id", "one", "n"]
SCHEMA += "".join(f", {c} long" for c in CLASHING) + ", marks map<string,int>, parts array<struct<a:int,b:string>>"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Epsilon", "zeta", "eta", "theta", "iota", "kappa", "été", "no1"]) + rng.choice(["", "s", ",", ".", "x", "y"]) for _ in range(n))


def odd_rows():
    """Nulls everywhere, empty and very long texts, ties, repeated rows, and columns whose names operators use."""
    rng = random.Random(3)
    texts = [None, "", " \t\n", "a", "One two three", words(rng, 40), words(rng, 300), words(rng, 20000), "x" * 50000, "é\x00ß 中文 😀", "the the the the the the"]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    base = words(rng, 120)
    rows += [(20 + i, base, "en", "a", len(base)) for i in range(6)]
    rows += [(30, base.upper(), None, "b", len(base)), (31, base + " end", "en", "b", None), (32, base.replace("alpha", "omega", 1), "en", "c", None)]
    rows += [rows[6], rows[6], (None, words(rng, 30), "fr", "a", 5), (None, None, None, None, None), (7, words(rng, 50), "fr", "b", 1)]
    clashing = [[None, 5, -1][i % 3] for i in range(len(CLASHING))]
    return [(*r, 1, "t", "s", 2, "n", "l", "k", "d", "m", 3, "z", *clashing, {"a": 1, "b": None}, [(1, None), None]) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
