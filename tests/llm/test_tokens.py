import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanforge.llm import binary, packing
from spanforge.llm.queries import TOKENIZER
from spanforge.llm.tokens import Encoder


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def truth(odd):
    t = Tokenizer.from_file(TOKENIZER)
    return [(r.doc_id, r.text, t.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in odd.collect()]


def test_remembered_ids_are_the_librarys():
    rng, t, e = random.Random(5), Tokenizer.from_file(TOKENIZER), Encoder(TOKENIZER)
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "中", "1", "'s", "'", "!", ",", "\x1c", "\x00", "\r\n", "<|endoftext|>", "word", "ɐx", "x²", " the", ".\n", "\n "]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        assert np.frombuffer(e.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids + [2], repr(text)


def test_packing(odd, none, truth):
    rows = packing.pack_documents(odd, TOKENIZER).collect()
    by, seqs = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for parts in seqs.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(p.length for p in parts[:i]) for i in range(len(parts))]
        assert sum(r.length for r in parts) <= 1024
    want = []
    for doc_id, _, ids in truth:
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        for i, s in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[s : s + 1024] if i else ids[:first]
            want.append((doc_id, i, s, len(part), crc(part)))
    assert sorted((tuple(r)[:5] for r in rows), key=repr) == sorted(want, key=repr)
    tokens = sum(len(ids) for *_, ids in truth)
    assert len(seqs) <= -(-tokens // 1024) + 2
    assert packing.pack_documents(none, TOKENIZER).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(1, 400, 600))[::-1]
    bins = packing.best_fit(lengths, 1024, 6, 300_000, rule=rule)
    for b in set(bins.tolist()):
        mine = lengths[bins == b]
        assert mine.sum() <= 1024 and len(mine) <= 6 and (mine.astype(float) ** 2).sum() <= 300_000
    assert len(packing.best_fit(np.array([], int))) == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_against_brute_force(rule):
    rng = np.random.default_rng(7)
    lengths = np.sort(rng.integers(1, 1025, 400))[::-1]
    for documents, attention in ((1024, 1024 * 1024), (4, 400_000)):
        w, caps, left, want = (1.0, 0.05, 0.05), (1024, documents, attention), [], []
        for n in lengths.tolist():
            need = [n / 1024, 1 / documents, n * n / attention]
            best = None
            for b, r in enumerate(left):
                rest = [x - y for x, y in zip(r, need)]
                if min(rest) >= -1e-12:
                    score = sum(k * x * x for k, x in zip(w, rest)) if rule == "norm" else -sum(k * x * y for k, x, y in zip(w, r, need))
                    if best is None or score < best[0] - 1e-12:
                        best = (score, b, rest)
            if best is None:
                left.append([1 - y for y in need])
                want.append(len(left) - 1)
            else:
                left[best[1]] = best[2]
                want.append(best[1])
        got = packing.best_fit(lengths, *caps, rule=rule)
        fill = lambda bins: sorted(np.bincount(bins, lengths).tolist())
        assert fill(got) == fill(np.array(want))


def test_binary_output(odd, none, truth):
    files = binary.write(odd, TOKENIZER)
    rows = binary.read(files, with_ids=True).collect()
    ordered = sorted(truth, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))
    start, want = 0, []
    for doc_id, _, ids in ordered:
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert [tuple(r)[:4] for r in sorted(rows, key=lambda r: r.start)] == want
    assert sum(len(r.ids) // 4 for r in rows) == start
    assert binary.read(binary.write(none, TOKENIZER)).count() == 0
    assert files.select(F.sum("n_ids")).first()[0] == start


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31, 32])
def test_any_width_and_random_access(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 10_001, dtype=np.uint64).astype("<u4")
    f = binary.File(binary.write_file(ids, np.array([10_000, 0, 1]), bits, block=128))
    assert (f.ids() == ids).all() and f.lengths.tolist() == [10_000, 0, 1]
    assert [f.document(i).tolist() for i in (0, 1, 2)] == [ids[:10_000].tolist(), [], ids[10_000:].tolist()]
    named = binary.File(binary.write_file(ids[:5], np.array([2, 3]), bits, names=[None, -7]))
    assert named.names == [None, -7] and (named.document(1) == ids[2:5]).all()
    for a, b in ((0, 1), (127, 129), (5000, 9999), (10_000, 10_001), (3, 3)):
        assert (f.ids(a, b) == ids[a:b]).all()
    assert len(f.data) <= 10_001 * bits / 8 + 16 * 90 + 200


def test_packing_keeps_every_capacity(spark):
    df = spark.createDataFrame([(i, "one two three") for i in range(12)], "doc_id long, text string")
    for capacities, most in (({"documents": 3}, 3), ({"attention": 40, "rule": "dot"}, 11), (None, 12)):
        rows = packing.pack_documents(df, TOKENIZER, capacities=capacities).collect()
        counts = Counter(r.sequence_id for r in rows)
        assert len(rows) == 12 and max(counts.values()) <= most
        if capacities and "attention" in capacities:
            assert all(n == 1 or sum(r.length**2 for r in rows if r.sequence_id == s) <= 40 for s, n in counts.items())
        else:
            assert max(counts.values()) == most
