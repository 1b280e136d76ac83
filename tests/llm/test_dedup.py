import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from spanforge.llm import lines, links, ngram_join, paragraphs
from spanforge.llm.common import batch_words, cut, shingles, word_hashes

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(text, k=5):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows):
    """(doc_id, n, component) by comparing every pair."""
    found, parent = [sets(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(found):
        for j in range(i):
            both = len(a & found[j])
            if a and found[j] and 100 * both >= 75 * (len(a) + len(found[j]) - both):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)].append(doc_id)
    return sorted(((d, len(s), min(least[root(i)], default=None) if s else d) for i, ((d, _), s) in enumerate(zip(rows, found))), key=repr)


def near_rows(seed, groups=25):
    """Groups of texts at every distance, many around the threshold, of all sizes."""
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        n = rng.choice([3, 5, 6, 7, 8, 9, 12, 20, 40, 90, 200])
        base = [f"w{rng.randint(0, 5000)}" for _ in range(n)]
        for _ in range(rng.randint(1, 7)):
            w = list(base)
            for _ in range(rng.randint(0, 1 + n // 25)):
                at = rng.randrange(len(w) + 1)
                if rng.random() < 0.5 and at < len(w):
                    w[at] = f"v{rng.randint(0, 9999)}"
                else:
                    w[at:at] = [f"x{rng.randint(0, 9999)}"] * rng.randint(1, 3)
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_against_all_pairs(spark, seed):
    rows = near_rows(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((tuple(r) for r in ngram_join.ngram_join(df).collect()), key=repr) == brute(rows)


def test_ngram_join_of_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((tuple(r) for r in ngram_join.ngram_join(odd).collect()), key=repr) == brute(rows)
    assert ngram_join.ngram_join(none).count() == 0 and ngram_join.keep_one(none).count() == 0


def test_ngram_join_of_rows_without_id(spark):
    rng = random.Random(7)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(60)]
    apart = [["start", *base], ["start", *base[:-6]], base[:-14]]  # the first and the last alone are no link
    other = [f"z{rng.randint(0, 5000)}" for _ in range(60)]
    rows = [(1, " ".join(apart[0])), (None, " ".join(apart[1])), (2, " ".join(apart[2])), (9, " ".join(other)), (None, " ".join(other[1:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in ngram_join.ngram_join(df).collect()), key=repr) == brute(rows)
    assert sorted(r.doc_id for r in ngram_join.keep_one(df).collect()) == sorted({c for _, _, c in brute(rows)})


def test_one_of_each_group_stays(odd):
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    texts = {}
    for d, t in rows:
        texts.setdefault((d, sets(t)), t)
    want = [d for (d, s), t in texts.items() if s and (d, len(s), d) in brute(rows)]
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted((d for d, t in got if sets(t)), key=repr) == sorted(want, key=repr)
    assert sum(not sets(t) for _, t in got) == sum(not sets(t) for _, t in rows)


def test_every_linked_pair_shares_a_key():
    rng, missed, pairs = random.Random(9), 0, 0
    for n in [3, 4, 5, 6, 8, 10, 14, 20, 33, 60, 150, 400, 1500]:
        for _ in range(60):
            base = [rng.getrandbits(64) for _ in range(n)]
            apart = n // 4  # a subset at the threshold or just above
            a, b = (np.unique(np.array(x, dtype=np.uint64)) for x in (base, base[apart:]))
            if not len(b) or 100 * len(b) < 75 * len(a):
                continue
            pairs += 1
            missed += not len(np.intersect1d(ngram_join.sketch_keys(a, 75), ngram_join.sketch_keys(b, 75)))
    assert pairs > 500 and missed == 0


def test_shingles_are_told_apart():
    assert len(shingles(word_hashes("a b c"))) == 1 and not len(shingles(word_hashes("")))
    assert (shingles(word_hashes("A b C")) == shingles(word_hashes("a  B\nc"))).all()
    assert shingles(word_hashes("a b c"))[0] != shingles(word_hashes("a b"))[0]
    assert (word_hashes("É") != word_hashes("é")).all()  # A-Z alone are folded
    assert len(word_hashes("x" * 3_000_000 + " y")) == 2


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2001 + i) for i in range(200)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.label for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- lines


def test_recurring_lines_go_and_copies_stay(spark):
    rng = random.Random(6)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    rows, boiler = [], "Read more at our site today"
    for i in range(12):
        rows.append((i, f"{say(30)}\n{boiler}\n{say(20)}"))
    for i in range(12, 22):
        rows.append((i, f"{say(30)}\nPosted by user on 2024-01-{i} at {i}:00\n{say(25)}"))
    copied = f"{say(40)}\n{say(30)}\n{say(50)}"
    rows += [(100 + i, copied) for i in range(20)]
    rows += [(200 + i, copied.replace(" ", f" k{chr(97 + i)} ", 1)) for i in range(10)]
    df = spark.createDataFrame([(a, b, len(b)) for a, b in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in lines.drop_lines(df).collect()}
    for i, t in rows:
        want = "\n".join(x for x in t.split("\n") if x != boiler and not x.startswith("Posted by"))
        assert got[i].text == want and got[i].n_chars == len(want)
    report = {r.doc_id: r.dropped_lines for r in lines.line_report(df).collect()}
    assert report == {i: int(i < 22) for i, _ in rows}


def test_lines_recur_beside_other_boilerplate_and_copies(spark):
    rng = random.Random(16)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    footer, line, rows = "\n".join(say(20) for _ in range(3)), say(8), []
    for i in range(8):  # the footer is more than half of the text
        rows.append((i, f"{say(40)}\n{footer}"))
    copied = say(200)
    for i in range(60):  # near copies, and a few unlike documents with the same line
        words = copied.split()
        words[rng.randrange(200)] = f"edit{i}"
        rows.append((100 + i, " ".join(words) + f"\n{line}"))
    rows += [(200 + i, f"{say(60)}\n{line}") for i in range(6)]
    only = say(9)
    rows += [(300 + i, f"{copied[:400]}\n{only}\n{i}") for i in range(30)]  # a line of near copies alone
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    gone = set(footer.split("\n")) | {line}
    for r, want in ((r, dict(rows)[r.doc_id]) for r in lines.drop_lines(df).collect()):
        assert r.text == "\n".join(x for x in want.split("\n") if x not in gone)


def test_lines_of_odd_rows(odd, none):
    rows = lines.drop_lines(odd).collect()
    assert lines.drop_lines(odd).columns == odd.columns
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, map(tuple, odd.collect())))
    assert lines.line_report(odd).count() == odd.count()
    assert lines.drop_lines(none).count() == 0 and lines.line_report(none).count() == 0


def brute_lines(rows, classes):
    """Numbers of the lines to drop of each text, by the rules as they are written; classes: the class of each row."""

    def tokens(line):
        return ["<*>" if any(c in "0123456789" for c in w) else w for w in WORD.findall(line)]

    held = defaultdict(lambda: defaultdict(set))  # leaf, line: classes
    for (_, text), c in zip(rows, classes):
        for line in text.split("\n"):
            if t := tokens(line):
                held[len(t), *t[: lines.DEPTH]][tuple(t)].add(c)
    drop = set()
    for found in held.values():
        size = len(next(iter(found)))
        need = lines.SHORT_RECURS if size < lines.SHORT else lines.RECURS
        if len(set().union(*found.values())) < need:
            continue
        support = defaultdict(int)
        for t, cs in found.items():
            for i, w in enumerate(t):
                support[i, w] += len(cs)
        fixed = {t: tuple(w if w != "<*>" and support[i, w] >= lines.RECURS else "<*>" for i, w in enumerate(t)) for t in found}
        spread = defaultdict(set)
        for t, f in fixed.items():
            if sum(w != "<*>" for w in f) >= lines.CONSTANT * size:
                spread[f] |= found[t]
        drop |= {t for t, f in fixed.items() if len(spread.get(f, ())) >= need}
    return [[i for i, line in enumerate(text.split("\n")) if tuple(tokens(line)) in drop] for _, text in rows]


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_against_brute_force(spark, seed):
    rng = random.Random(seed)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    names = [say(1) for _ in range(4)]
    made = [lambda: f"Posted by {rng.choice(names)} at {rng.randint(1, 99)}:{rng.randint(10, 99)}", lambda: f"Read {rng.choice(names)} more", lambda: "All rights reserved here", lambda: "x y", lambda: "--", lambda: f"{rng.randint(1, 9)} 2 3", lambda: f"see also {say(1)} {say(1)} {rng.choice(names)}", lambda: ""]
    rows, classes = [], []
    for c in range(40):
        parts = [say(rng.randint(1, 12)) for _ in range(8)] + [say(60)]
        parts += [rng.choice(made)() for _ in range(rng.randint(0, 6))]
        rng.shuffle(parts)
        for copy in range(rng.choice([1, 1, 1, 7])):
            edited = list(parts)
            if copy % 2:
                edited[0] += " also"
            rows.append((len(rows), "\n".join(edited)))
            classes.append(c)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_lines(rows, classes)
    got = {r.doc_id: r.out or [] for r in lines.drop_lines(df, dropped_col="out").collect()}
    assert sum(map(len, want)) > 60
    for (d, _), w in zip(rows, want):
        assert sorted(got[d]) == w, d


def test_signatures_tell_near_copies():
    rng = random.Random(5)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(400)]
    near, far = list(words), words[:200] + [f"v{i}" for i in range(200)]
    near[50], near[300] = "edit", "edit"
    w = batch_words(pa.array([" ".join(x) for x in (words, words, near, far)] + ["", "a b", None]))
    s = lines.signatures(w.hashes, w.first)
    share = lambda a, b: (s[a] == s[b]).mean()
    assert share(0, 1) == 1 and share(0, 2) > 0.8 and share(0, 3) < 0.5 and not s[4].any() and s[5].any() and not s[6].any()


# ---- paragraphs


def test_bands_find_pairs_at_the_threshold():
    rng, met, pairs = random.Random(15), 0, 0
    for n in (25, 40, 60, 150):
        for _ in range(150):
            base = [rng.getrandbits(32) for _ in range(n)]
            other, at = list(base), sorted(rng.sample(range(n), rng.choice([1, 2, 3])))
            for i in at:
                other[i] = rng.getrandbits(32)
            a, b = (paragraphs.paragraph_set(np.array(x, dtype="<u4").tobytes()) for x in (base, other))
            both = len(np.intersect1d(a, b))
            if not 75 * (len(a) + len(b) - both) <= 100 * both <= 82 * (len(a) + len(b) - both):
                continue
            words = np.array(base + other, dtype=np.uint64)
            keys = paragraphs.band_keys(words, np.array([0, n]), np.array([n, n]), paragraphs.BANDS, paragraphs.ROWS)
            pairs, met = pairs + 1, met + bool((keys[0] == keys[1]).any())
    assert pairs > 100 and met / pairs >= 0.95


def test_every_stretch_has_an_anchor_that_is_chosen_alike():
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 1 << 32, 25, dtype=np.uint64)
    for _ in range(60):
        a, b = (rng.integers(0, 1 << 32, rng.integers(0, 120), dtype=np.uint64) for _ in range(2))
        found = []
        for before, after in ((a, b), (b, a)):
            words = np.concatenate((before, passage, after))
            at, keys = paragraphs.chosen_windows(words, np.zeros(len(words), int), np.array([0, len(words)]), 8, 25)
            found.append(set(keys.tolist()))
        assert found[0] & found[1]


def passages(seed=8):
    rng = random.Random(seed)
    say = lambda n: [f"{rng.choice('abcdefgh')}{rng.randint(0, 99999)}" for _ in range(n)]
    rows, planted = [], {}
    for p in range(12):
        passage = say(rng.randint(51, 90))
        for _ in range(rng.randint(2, 5)):
            a, b = say(rng.randint(0, 200)), say(rng.randint(0, 200))
            rows.append((len(rows), " ".join(a + passage + b)))
            planted.setdefault(p, []).append((len(rows) - 1, len(a), len(a) + len(passage)))
    clean = [(len(rows) + i, " ".join(say(rng.randint(1, 300)))) for i in range(30)]
    return rows + clean, planted, {i for i, _ in clean}


def test_planted_passages_are_found(spark):
    rows, planted, clean = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spans = defaultdict(list)
    for r in paragraphs.repeated_spans(df).collect():
        spans[r.doc_id].append(r)
    assert not clean & set(spans)
    for places in planted.values():
        first = min(d for d, *_ in places)
        for doc, a, b in places:
            (r,) = spans[doc]
            assert r.first_doc_id == first and r.removed == (doc != first) and r.n_words >= 25
            assert r.start_word <= a and b <= r.end_word
            # more words only where the whole paragraphs are near copies
            assert (r.start_word, r.end_word) == (a, b) or r.n_words <= 4 * (b - a) / 3 + 5


def test_what_spans_leave():
    assert paragraphs._left([], 40, 24) == [(0, 40)] and paragraphs._left([(0, 40)], 40, 24) == []
    assert paragraphs._left([(10, 90), (50, 100)], 200, 5) == [(0, 15), (95, 200)]
    assert paragraphs._left([(10, 12), (90, 200)], 200, 5) == [(0, 95)]


@pytest.mark.parametrize("n", [25, 30, 35, 40, 45, 49, 50])
def test_short_stretches_inside_unlike_lines_are_found(spark, n):
    rng, rows, at = random.Random(n), [], {}
    say = lambda n: [f"{rng.choice('abcdefgh')}{rng.randint(0, 99999)}" for _ in range(n)]
    for _ in range(40):
        passage = say(n)
        for removed in (False, True):
            a = say(rng.randint(40, 200))
            at[len(rows)] = (len(a), len(a) + n, removed)
            rows.append((len(rows), " ".join(a + passage + say(rng.randint(40, 200)))))
    found = {r.doc_id: r for r in paragraphs.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    exact = 0
    for d, (a, b, removed) in at.items():
        r = found[d]
        assert r.start_word <= a and b <= r.end_word and r.removed == removed and r.n_words <= 4 * n / 3 + 5  # near copies of whole paragraphs
        exact += (r.start_word, r.end_word) == (a, b)
    assert exact >= 0.9 * len(at) == 0.9 * len(found)


@pytest.mark.parametrize("kind", [pa.int64(), pa.string(), pa.float64(), pa.bool_()])
def test_spans_are_decided_as_arrays(kind):
    rng = random.Random(4)
    firsts = {"int64": [None, 3, -7, 90], "string": [None, "b", "é", "a"], "double": [None, 0.5, -2.0, 7.0], "bool": [None, True, False]}[str(kind)]
    rows = [[(a, a + rng.choice([25, 25, 25, 40]), rng.choice(firsts), rng.random() < 0.4) for a in (rng.randrange(rng.choice([90, 900])) for _ in range(rng.randrange(30)))] for _ in range(300)]
    least = lambda s: (s[0], s[1], s[2] is None, s[2] or 0 if str(kind) != "string" else s[2] or "")
    rows = [sorted(r, key=least) for r in rows]  # of spans at one place, the one with the smallest first leads
    struct = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first", kind), ("removed", pa.bool_())]))
    spans = pa.array([[dict(zip(("start", "end", "first", "removed"), s)) for s in rng.sample(r, len(r))] for r in rows], type=struct)
    names = ["doc_id", "start", "end", "words", "first", "removed"]
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), spans], names=["doc_id", "spans"])
    for batch in (whole, whole.slice(100, 7), whole.slice(0, 0)):
        got = [tuple(r.values()) for r in paragraphs.decided_batch(batch, names, 25).to_pylist()]
        assert got == [(i, a, b, b - a, f, g) for i in batch.column(0).to_pylist() for a, b, f, g in paragraphs.decided(rows[i], 25)]


def test_no_task_takes_two_workers(spark, monkeypatch):
    """Each worker keeps its memory when its task is over, so a task with two maps in a row holds twice the memory."""
    plans = []
    monkeypatch.setattr(paragraphs, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(9999)}" for _ in range(60)) for _ in range(6)]
    spans = paragraphs.repeated_spans(spark.createDataFrame(list(enumerate([*texts, "x " + texts[0] + " y"])), "doc_id long, text string"))
    assert spans.where("removed").count() == 1
    plans.append(spans._jdf.queryExecution().executedPlan().toString())
    assert sum("MapInArrow" in p for p in plans) > 3
    for plan in plans:
        open_at = None  # depth of a map that no exchange or join is under yet
        for line in plan.split("\n"):
            depth, name = re.match(r"[\s:+|-]*", line).end(), line.lstrip(" :+|-")
            if open_at is not None and (depth <= open_at or "Exchange" in name or "Join" in name):
                open_at = None
            if "MapInArrow" in name:
                assert open_at is None, plan
                open_at = depth


def test_deciding_spans_takes_little_memory():
    import tracemalloc

    struct = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first", pa.int64()), ("removed", pa.bool_())]))
    spans = pa.array([[{"start": a, "end": a + 25, "first": 1, "removed": True} for a in range(300)]] * 200, type=struct)
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), spans], names=["doc_id", "spans"])
    tracemalloc.start()
    out = paragraphs.decided_batch(batch, ["doc_id", "start", "end", "words", "first", "removed"], 25)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.column(3).to_pylist() == [324] * 200 and peak < 150 * 60_000, peak


def test_nothing_is_left_in_two_documents(spark):
    """Texts of passages, copies, edits and quotes of all lengths: by brute force, what stays shares no 25 words in a row."""
    rng = random.Random(21)
    say = lambda n: [f"{rng.choice('abcdefgh')}{rng.randint(0, 9999)}" for _ in range(n)]
    texts = [say(rng.randint(1, 250)) for _ in range(40)]
    while len(texts) < 160:
        words, kind = list(rng.choice(texts)), rng.random()
        if kind < 0.3:
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = "edit"
        else:
            start = rng.randrange(len(words))
            words = say(rng.randint(0, 120)) + words[start : start + rng.randint(10, 90)] + say(rng.randint(0, 120))
        texts.append(words or ["x"])
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    gone, spans = defaultdict(set), paragraphs.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    for r in spans:
        assert 0 <= r.start_word and r.end_word <= len(texts[r.doc_id]) and r.n_words == r.end_word - r.start_word >= 25
        if r.removed:
            gone[r.doc_id] |= set(range(r.start_word, r.end_word))
    held, whole = defaultdict(set), defaultdict(set)
    for i, words in enumerate(texts):
        for at in range(len(words) - 24):
            whole[tuple(words[at : at + 25])].add(i)
            if not gone[i] & set(range(at, at + 25)):
                held[tuple(words[at : at + 25])].add(i)
    assert sum(len(h) > 1 for h in whole.values()) > 300 and all(len(h) == 1 for h in held.values())
    # and every removal has a copy, or nearly: most of its runs of 5 words are left in another text
    left = {tuple(w[a : a + 5]) for i, w in enumerate(texts) for a in range(len(w) - 4) if not gone[i] & set(range(a, a + 5))}
    for r in spans:
        if r.removed:
            w = texts[r.doc_id][r.start_word : r.end_word]
            grams = [tuple(w[a : a + 5]) for a in range(len(w) - 4)]
            assert sum(g in left for g in grams) >= 0.6 * len(grams)


def test_a_whole_table_against_brute_force(spark):
    """All documents of a small table: every 25 words in a row that two documents hold are in spans of both or removed, and
    what stays shares none; documents that share none with any other have no span but of near copies."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: WORD.findall((r.text or "").translate(FOLD)) for r in docs.collect()}
    marked, gone = defaultdict(set), defaultdict(set)
    for r in paragraphs.repeated_spans(docs).collect():
        marked[r.doc_id] |= set(range(r.start_word, r.end_word))
        if r.removed:
            assert r.first_doc_id < r.doc_id
            gone[r.doc_id] |= set(range(r.start_word, r.end_word))
    shared, left = defaultdict(set), defaultdict(set)
    for d, words in texts.items():
        for at in range(len(words) - 24):
            window = tuple(words[at : at + 25])
            shared[window].add(d)
            if not gone[d] & set(range(at, at + 25)):
                left[window].add(d)
    assert sum(len(h) > 1 for h in shared.values()) > 500 and all(len(h) == 1 for h in left.values())
    fives = defaultdict(set)
    for d, words in texts.items():
        for at in range(len(words) - 4):
            fives[tuple(words[at : at + 5])].add(d)
    for d, words in texts.items():
        for at in range(len(words) - 24):
            if len(shared[tuple(words[at : at + 25])]) > 1:
                assert set(range(at, at + 25)) <= marked[d], (d, at)
        if not marked[d]:
            continue
        runs = [at for at in range(len(words) - 4) if at in marked[d] and at + 4 in marked[d]]
        assert sum(len(fives[tuple(words[at : at + 5])]) > 1 for at in runs) >= 0.6 * len(runs), d


def test_ids_of_any_simple_type(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randint(0, 99999)}" for _ in range(n))
    shared = say(40)
    df = spark.createDataFrame([("b", f"{say(50)} {shared} {say(50)}"), ("a", f"{say(60)} {shared}"), (None, say(80))], "name string, text string")
    got = {(r.name, r.first_doc_id, r.removed) for r in paragraphs.repeated_spans(df, "name").collect()}
    assert got == {("a", "a", False), ("b", "a", True)}


def test_near_paragraphs_are_joined(spark):
    rng = random.Random(2)
    base = [f"p{rng.randint(0, 99999)}" for _ in range(13)]
    near = base[:-1] + ["other"]  # eight shingles of ten
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, "alone " * 13)], "doc_id long, text string")
    got = {r.doc_id for r in paragraphs.repeated_spans(df, least_words=10).collect()}
    assert got == {1, 2}


def test_a_copied_text_that_quotes_an_earlier_one_keeps_a_copy(spark):
    rng = random.Random(5)
    say = lambda n: [f"{rng.choice('abcdefgh')}{rng.randint(0, 99999)}" for _ in range(n)]
    passage, before, after = say(80), say(150), say(150)
    whole = " ".join(before + passage + after)
    rows = [(5, " ".join(say(60) + passage + say(60))), (10, whole), (50, whole), (None, whole)]
    got = defaultdict(list)
    for r in paragraphs.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].append((r.start_word, r.end_word, r.removed))
    assert [r[2] for r in sorted(got[10])] == [False, True, False]
    assert all(125 <= a and b <= 255 for a, b, gone in got[10] if gone)
    assert got[50] == got[None] == [(0, 380, True)] and [r[2] for r in got[5]] == [False]


def test_edited_passages_against_brute_force(spark):
    rng, rows, whole = random.Random(12), [], {}
    say = lambda n: [f"{rng.choice('abcdefgh')}{rng.randint(0, 99999)}" for _ in range(n)]
    for n in [51, 51, 51, 51, 55, 60, 60, 60, 70, 80, 90, 100] * 3:
        passage, edits = say(n), len(rows) // 2 % 3
        for copy in range(2):
            words = list(passage)
            for i in range(edits * copy):
                words[(i + 1) * n // (edits + 1)] = "edited"
            a = say(rng.randint(30, 90))
            if n >= 25 * (edits + 1) + edits:  # each stretch alone is long enough
                whole[len(rows)] = (len(a), len(a) + n)
            rows.append((len(rows), " ".join(a + words + say(rng.randint(30, 90)))))
    line = say(20)  # common, shorter than a span; two of its documents share more
    for _ in range(8):
        rows.append((len(rows), " ".join(say(40) + line + say(40))))
    tail = say(6)
    for _ in range(2):
        rows.append((len(rows), " ".join(say(40) + line + tail + say(40))))
    held, marks = defaultdict(set), {}
    texts = [t.split() for _, t in rows]
    for d, w in enumerate(texts):
        for i in range(len(w) - 24):
            held[tuple(w[i : i + 25])].add(d)
    for d, w in enumerate(texts):
        marks[d] = {j for i in range(len(w) - 24) if len(held[tuple(w[i : i + 25])]) > 1 for j in range(i, i + 25)}
    got = defaultdict(list)
    for r in paragraphs.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got[r.doc_id].append((r.start_word, r.end_word))
    for d in range(len(rows)):
        assert marks[d] <= {j for a, b in got[d] for j in range(a, b)}, d
        assert bool(marks[d]) == bool(got[d]) or d < 72
    assert len(whole) > 30
    for d, (a, b) in whole.items():
        ((start, end),) = got[d]
        assert a - paragraphs.REACH <= start <= a and b <= end <= b + paragraphs.REACH


def test_paragraphs_of_odd_rows(odd, none):
    rows = paragraphs.repeated_spans(odd).collect()
    assert {20, 21, 22, 23, 24, 25} <= {r.doc_id for r in rows} and all(r.n_words >= 25 for r in rows)
    assert paragraphs.repeated_spans(none).count() == 0
    same = shingles(word_hashes("same " * 1000), 2)
    assert not paragraphs.cuts(same, np.zeros(len(same))).any()
