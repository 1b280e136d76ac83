import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import links, ngram_join, paragraphs
from spanforge.llm.common import cut
from spanforge.llm.links import jaccard_at_least

SETS = "node long, words binary, n long, sketch array<long>"


def boilerplate(n, rng, families=3):
    """Sets that share half of their values with all others of a family, some of them near copies."""
    common, out = [[rng.getrandbits(62) for _ in range(24)] for _ in range(families)], []
    for _ in range(n):
        if out and rng.random() < 0.4:
            base = list(rng.choice(out[-30:]))
            for _ in range(rng.randint(0, 6)):
                base[rng.randrange(len(base))] = rng.getrandbits(62)
        else:
            base = rng.choice(common) + [rng.getrandbits(62) for _ in range(rng.randint(10, 24))]
        out.append(base)
    return {i + 1: np.unique(np.array(s, dtype=np.uint64)) for i, s in enumerate(out)}


def brute(found, keys, percent):
    label = {i: i for i in found}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for nodes in keys.values():
        for a in nodes:
            for b in nodes:
                if a < b and jaccard_at_least(found[a], found[b], percent):
                    x, y = sorted((root(a), root(b)))
                    label[y] = x
    return {i: root(i) for i in found}


@pytest.mark.parametrize(("rounds", "small", "block"), [(2, 32, 1024), (0, 1, 7), (1, 4, 1024), (0, 10_000, 16)])
def test_clusters_against_all_pairs_of_each_key(spark, monkeypatch, rounds, small, block):
    monkeypatch.setattr(links, "ROUNDS", rounds)
    monkeypatch.setattr(links, "SMALL", small)
    monkeypatch.setattr(links, "BLOCK", block)
    rng = random.Random(11)
    found = boilerplate(150, rng)
    keys = {k: [i for i in found if rng.random() < share] for k, share in enumerate((1.0, 0.3, 0.05, 0.02))}
    table = cut(spark.createDataFrame([(i, s.tobytes(), len(s), ngram_join.sketch(s)) for i, s in found.items()], SETS))
    multi = cut(spark.createDataFrame([(k, i, min(v)) for k, v in keys.items() for i in v if len(v) > 1], "key long, node long, lo long"))
    labels, _ = links.clusters(multi, table, lambda b: np.frombuffer(b, dtype=np.uint64), 75)
    got = {r.node: r.label for r in labels.collect()}
    want = brute(found, keys, 75)
    assert {i: got.get(i, i) for i in found} == want and len(set(want.values())) < len(found)


@pytest.mark.parametrize("merge", [False, True])
def test_keys_of_very_many_nodes_meet_alike(spark, monkeypatch, merge):
    rng = random.Random(2)
    rows = [(1, i) for i in range(300)] + [(2, i) for i in range(300)] + [(k, rng.randrange(300)) for k in range(3, 200) for _ in range(rng.randint(1, 3))]
    keys = cut(spark.createDataFrame(rows + rows[:50], "key long, node long").repartition(4))
    none = keys.where("false")
    plain = links.meeting(keys, none, merge).collect()
    monkeypatch.setattr(links, "MANY", 5)
    hot = links.meeting(keys, keys.where("node % 8 = 0"), merge).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, hot))
    groups = {}
    for k, node in set(rows):
        groups.setdefault(k, set()).add(node)
    want = {(frozenset(g), min(g)) for g in groups.values() if len(g) > 1}
    got = {}
    for r in plain:
        got.setdefault((r.key, r.lo), set()).add(r.node)
    assert {(frozenset(g), lo) for (_, lo), g in got.items()} == want
    assert len(got) == (len(want) if merge else sum(len(g) > 1 for g in groups.values()))


def test_more_links_join_components(spark):
    labels = links.components(spark.createDataFrame([(1, 2), (3, 4), (5, 6), (9, 9)], "a long, b long"))
    more = spark.createDataFrame([(2, 4), (7, 8), (8, 6), (1, 2)], "a long, b long")
    got = {r.node: r.label for r in links.joined_components(labels, more).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 5, 8: 5}
    alone = links.components(spark.createDataFrame([], "a long, b long"))
    assert {r.node: r.label for r in links.joined_components(alone, more).collect()} == {1: 1, 2: 1, 4: 1, 6: 6, 7: 6, 8: 6}


def test_pairs_that_are_tried_grow_with_the_rows(spark, monkeypatch):
    """Paragraphs of 34 words that share 24: no two are linked, and all share keys."""
    tried = []
    plain = links.crossed

    def crossed(rows, keys, fits):
        tried.append(plain(rows, keys, F.lit(True)).count())
        return plain(rows, keys, fits)

    monkeypatch.setattr(links, "crossed", crossed)
    at = {}
    for n in (400, 1600):
        rng = random.Random(5)
        common = " ".join(f"c{i}" for i in range(24))
        rows = [(i, f"{common} " + " ".join(f"w{rng.getrandbits(40)}" for _ in range(10))) for i in range(n)]
        tried.clear()
        found = paragraphs.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), least_words=30).count()
        assert found == 0
        at[n] = sum(tried)
    assert at[1600] <= 5 * max(at[400], 400), at
