"""Substring dedup: paragraph MinHash banding.

Paragraphs are a text's lines; long lines are cut where the hash of a word pair is the smallest of its neighbourhood, so
the same words are cut alike wherever they stand. A paragraph is the set of its 5-word shingles. Equal paragraphs are
one node; bands of MinHash values (BANDS of ROWS, which find 97.8 % of the pairs just at the threshold and more of closer
ones) bring the others together, pairs that collide are verified by exact Jaccard, and components of the links are the
clusters.

What equal copies leave is searched for passages inside unlike lines: every `least_words` words in a row that two
documents still share are found. Anchors (runs of ANCHOR words, the smallest hash of every `least_words` words) are
alike wherever the same words stand; around the anchors of several texts, all windows of `least_words` words are nodes, of
equal words only. So after all removals no `least_words` words in a row are left in two documents, other than in parts
of removals that are too short to go.

The document with the smallest id of a cluster keeps its words, the others' are removals. Runs of words with the same
decision, also over edits of up to GAP words, are the repeated spans.

Defined results: null and wordless texts, and those of fewer than `least_words` words, have no spans; repeats within one
document alone are no repeats across documents; ids may be of any simple type; rows of equal id, and all of a null id, count as one document (null is
after every other id); equal rows give equal spans each; other columns are not carried; an empty table gives no rows.
Words are compared by 32-bit and whole windows and paragraphs by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import batch_words, cut, fields, join_keyed, lists, map_batches, map_lists, mix64, sequence_hashes, shingles, sieved, sliding, spent
from .links import SOME, clusters, meeting
from .ngram_join import sketch

#: Words to each side of a cut in a long line, MinHash bands and rows of a band, words of a span that is reported, words
#: of an anchor, words of an edit inside a span.
REACH, BANDS, ROWS, LEAST_WORDS, ANCHOR, GAP = 32, 7, 3, 25, 8, 3
_NONE = np.uint64((1 << 64) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def cuts(pairs: np.ndarray, part: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Marks words at which a new paragraph starts, by the hash of each word and the next; `reach` words to both sides
    are of the same part, and no pair there is smaller (nor equal, if it comes before)."""
    n = len(pairs)
    out = np.zeros(n, dtype=bool)
    if n > 2 * reach + 1:
        low = sliding(pairs, reach, np.minimum)  # of reach pairs from each
        here = np.arange(reach, n - reach)
        out[here] = (pairs[here] < low[here - reach]) & (pairs[here] <= low[here + 1]) & (part[here - reach] == part[here + reach])
    return out


def chosen_windows(words: np.ndarray, owner: np.ndarray, first: np.ndarray, least_words: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the windows of least_words words that are chosen; a text of under `window` words has one at least."""
    n = len(words) - least_words + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    grams = sequence_hashes(words, np.arange(n), np.full(n, least_words))
    grams[owner[:n] != owner[least_words - 1 :]] = _NONE
    wide = window - least_words + 1
    chosen = grams == _NONE
    if wide > 1 and n >= wide:
        lowest = sliding(grams, wide, np.minimum)
        lowest[owner[: len(lowest)] != owner[window - 1 :]] = 0  # windows that reach beyond their text choose none
        padded = np.concatenate((np.zeros(wide - 1, dtype=np.uint64), lowest, np.zeros(wide - 1, dtype=np.uint64)))
        chosen |= sliding(padded, wide, np.maximum) == grams
    elif wide <= 1:
        chosen[:] = True
    sizes = np.diff(first)
    for text in np.flatnonzero((sizes >= least_words) & (sizes < window)).tolist() if wide > 1 else ():
        a, b = first[text], first[text + 1] - least_words + 1
        chosen[a + int(grams[a:b].argmin())] = True
    at = np.flatnonzero(chosen & (grams != _NONE))
    return at, mix64(grams[at] + np.uint64(1))


def band_keys(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A line of band keys for each paragraph (of five words at least; they start at starts)."""
    inside = np.repeat(starts, sizes - 4) + (np.arange((sizes - 4).sum()) - np.repeat(np.cumsum(sizes - 4) - (sizes - 4), sizes - 4))
    found = shingles(words)[inside]
    at = np.cumsum(sizes - 4) - (sizes - 4)
    keys = np.empty((len(starts), bands), dtype=np.uint64)
    for b in range(bands):
        key = np.full(len(starts), b + 1, dtype=np.uint64)
        for r in range(rows):
            salt = np.uint64((((b * rows + r) * 2 + 1) * 0xD1B54A32D192ED03) & ((1 << 64) - 1))
            turned = found * salt
            turned ^= turned >> np.uint64(32)
            turned *= _ODD
            key = mix64(key ^ np.minimum.reduceat(turned, at))
        keys[:, b] = key
    return keys


def _pieces(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, least_words: int) -> DataFrame:
    """A row for each document: doc_id (of its own type), words (32-bit hashes), paragraphs (start, end, node), bands (key, node)."""
    kind = docs.schema[id_col].dataType
    schema = StructType([StructField("doc_id", kind), *fields("words binary, paragraphs array<struct<start int, end int, node long>>, bands array<struct<key long, node long>>").fields])
    least = max(5, least_words)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = batch_words(batch.column(1))
        owner, n = w.owner, len(w.hashes)
        words = w.hashes & np.uint64(0xFFFFFFFF)
        part = np.cumsum(np.concatenate(([0], (owner[1:] != owner[:-1]) | (w.line[1:] != w.line[:-1]))))[:n]
        new = np.ones(n, dtype=bool)
        new[1:] = part[1:] != part[:-1]
        if n > 1:
            new[:-1] |= cuts(shingles(words, 2), part[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, n))
        starts, sizes = starts[sizes >= least], sizes[sizes >= least]
        nodes = sequence_hashes(words, starts, sizes)
        count = lambda x: np.bincount(x.astype(np.int64), minlength=batch.num_rows)

        def placed(begin: np.ndarray, end: np.ndarray, node: np.ndarray) -> pa.Array:
            of = owner[begin] if n else begin
            head = w.first[:-1][of]
            ints = [pa.array((x - head).astype(np.int32)) for x in (begin, end)]
            return lists(pa.StructArray.from_arrays([*ints, pa.array(node.view(np.int64))], ["start", "end", "node"]), count(of))

        held, one = np.unique(nodes, return_index=True)  # equal paragraphs of a batch give their keys once
        keys = band_keys(words, starts[one], sizes[one], bands, rows) if len(one) else np.empty((0, bands), dtype=np.uint64)
        owners = owner[starts[one]] if n else one
        turn = np.argsort(owners, kind="stable")
        given = pa.StructArray.from_arrays([pa.array(keys[turn].ravel().view(np.int64)), pa.array(np.repeat(held[turn], bands).view(np.int64))], ["key", "node"])
        raw = pa.array(words.astype("<u4")).buffers()[1] if n else pa.py_buffer(b"")
        binary = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((w.first * 4).astype(np.int32)), raw])
        return pa.RecordBatch.from_arrays([batch.column(0), binary, placed(starts, starts + sizes, nodes), lists(given, count(owners) * bands)], names=schema.names)

    return map_batches(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`")), lambda: step, schema, rows=500)


def paragraph_set(words: bytes) -> np.ndarray:
    """The distinct 5-word shingles of a paragraph from its words' 32-bit hashes."""
    return np.unique(shingles(np.frombuffer(words, dtype="<u4").astype(np.uint64)))


def _sets(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, words, n, sketch of the paragraphs that wanted (row, start, end, node) names."""
    schema = fields("node long, words binary, n long, sketch array<long>")
    refs = wanted.groupBy("row").agg(F.collect_list(F.struct("start", "end", "node")).alias("refs"))  # of one document

    def step(batch: dict[str, list]) -> dict[str, list]:
        parts = [(x["node"], words[4 * x["start"] : 4 * x["end"]]) for words, refs in zip(batch["words"], batch["refs"]) for x in refs]
        sets = [paragraph_set(p) for _, p in parts]
        return {"node": [n for n, _ in parts], "words": [p for _, p in parts], "n": [len(s) for s in sets], "sketch": [sketch(s) for s in sets]}

    needed = sieved(table.select("row", "words"), "row", refs)
    return map_lists(needed.join(refs.hint("merge"), "row").select("words", "refs"), lambda: step, schema, rows=100)


def _left(spans: list[tuple[int, int]], n: int, margin: int) -> list[tuple[int, int]]:
    """What spans leave of n words, with `margin` words of the spans around it; parts that then touch are one."""
    out: list[list[int]] = []
    at = 0
    for start, end in [*sorted(spans), (n, n)]:
        if start > at:
            a, b = max(0, at - margin), min(n, start + margin)
            if out and a <= out[-1][1]:
                out[-1][1] = b
            else:
                out.append([a, b])
        at = max(at, end)
    return [(a, b) for a, b in out]


def _anchors(table: DataFrame, gone: DataFrame, least_words: int) -> DataFrame:
    """gram, row, start: anchors of the words that gone (row, spans; written) leaves; a written table."""
    schema = fields("gram long, row long, start int")
    size = min(ANCHOR, least_words)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts, rows, begins = [], [], []
        spans_of = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
        for row, raw, spans in zip(batch.column(0).to_pylist(), batch.column(1), spans_of):
            words = np.frombuffer(raw.as_buffer() or b"", dtype="<u4")
            for a, b in _left([(x["start"], x["end"]) for x in spans or ()], len(words), least_words - 1):
                if b - a >= least_words:
                    parts.append(words[a:b])
                    rows.append(row)
                    begins.append(a)
        if not parts:
            return pa.RecordBatch.from_pydict({"gram": [], "row": [], "start": []}, schema=to_arrow_schema(schema))
        first = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        part = np.repeat(np.arange(len(parts)), np.diff(first))
        at, grams = chosen_windows(np.concatenate(parts).astype(np.uint64), part, first, size, least_words)
        of = part[at]
        return pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(np.array(rows, dtype=np.int64)[of]), pa.array((np.array(begins)[of] + at - first[of]).astype(np.int32))], schema=to_arrow_schema(schema))

    words = table.select("row", "words")
    whole = sieved(words, "row", gone, held=False, then=step, schema=schema, rows=500)
    cut_up = sieved(words, "row", gone).join(gone.hint("merge"), "row", "left").select("row", "words", "spans")
    return cut(whole.union(map_batches(cut_up, lambda: step, schema, rows=500)))


def _windows(table: DataFrame, gone: DataFrame, least_words: int) -> DataFrame:
    """row, doc_id, start, end, node: all windows of least_words words around anchors that several rows share; a written table."""
    anchors = _anchors(table, gone, least_words)
    shared = anchors.groupBy("gram").agg(F.min("row").alias("lo"), F.max("row").alias("hi"), F.count(F.lit(1)).alias("rows")).where("lo != hi")
    shared = cut(shared.select("gram", "rows"))
    hits = join_keyed(sieved(anchors, "gram", shared), shared, "gram", "rows")
    refs = cut(hits.groupBy("row").agg(F.collect_list("start").alias("starts")))  # of one document
    spent(anchors, shared)
    schema = StructType([*fields("row long").fields, table.schema["doc_id"], *fields("start int, end int, node long").fields])
    size = min(ANCHOR, least_words)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list[np.ndarray]] = [[], [], []]  # number in the batch, start, node
        for i, (raw, starts) in enumerate(zip(batch.column(2), batch.column(3))):
            words = np.frombuffer(raw.as_buffer() or b"", dtype="<u4").astype(np.uint64)
            marks = np.zeros(len(words) + 1, dtype=np.int64)
            begins = starts.values.to_numpy()
            np.add.at(marks, np.maximum(begins + size - least_words, 0), 1)
            np.add.at(marks, np.minimum(begins + 1, len(words)), -1)
            at = np.flatnonzero(np.cumsum(marks)[: max(0, len(words) - least_words + 1)])
            out[0].append(np.full(len(at), i))
            out[1].append(at)
            out[2].append(sequence_hashes(words, at, np.full(len(at), least_words)))
        of, at, nodes = (np.concatenate(x) for x in out)
        took = pa.array(of)
        ends = [pa.array(x.astype(np.int32)) for x in (at, at + least_words)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(took), batch.column(1).take(took), *ends, pa.array(nodes.astype(np.uint64).view(np.int64))], schema=to_arrow_schema(schema))

    rows = sieved(table.select("row", "doc_id", "words"), "row", refs).join(refs.hint("merge"), "row")
    out = cut(map_batches(rows.select("row", "doc_id", "words", "starts"), lambda: step, schema, rows=100))
    spent(refs)
    return out


def _several(lo: str, hi: str, known: str, rows: str):
    """Whether these are of several documents; all rows of a null id are one."""
    return (F.col(lo) < F.col(hi)) | ((F.col(known) > 0) & (F.col(known) < F.col(rows)))


def _marked(placed: DataFrame, shared: DataFrame) -> DataFrame:
    """row, start, end, first, removed, same: pieces of placed whose nodes shared (node, first, same, rows; written) holds."""
    rows = join_keyed(placed, shared, "node", "rows").withColumn("removed", ~F.col("first").eqNullSafe(F.col("doc_id")))
    return rows.select("row", "start", "end", "first", "removed", "same")


def _nodes(placed: DataFrame) -> DataFrame:
    """node, and the smallest and largest id, known ids and rows of its pieces; a written table."""
    return cut(placed.groupBy("node").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("doc_id").alias("known"), F.count(F.lit(1)).alias("rows")))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, bands: int = BANDS, rows: int = ROWS, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row for each repeated span: id, start_word, end_word, n_words, first_doc_id (the smallest id that shares any of it), removed."""
    table = cut(_pieces(docs, id_col, text_col, bands, rows, least_words).withColumn("row", F.monotonically_increasing_id()))
    placed = table.select("row", "doc_id", F.inline("paragraphs"))
    nodes = _nodes(placed)

    def sets_of(needed: DataFrame) -> DataFrame:
        """Of each node, one paragraph's."""
        held = join_keyed(table.select("row", F.inline("paragraphs")), cut(nodes.join(needed, "node", "left_semi").select("node", "rows")), "node", "rows")
        return _sets(table, held.groupBy("node").agg(F.min(F.struct("row", "start", "end")).alias("x")).select("node", "x.*"))

    keys = table.select(F.inline("bands"))
    multi = meeting(keys, keys.where(F.pmod(F.xxhash64(F.lit("some"), "node"), F.lit(SOME)) == 0))
    labels, tables = clusters(multi, cut(sets_of(multi.select("node").distinct())), paragraph_set, percent)
    joined = nodes.join(labels, "node", "left").where(F.col("label").isNotNull() | _several("lo", "hi", "known", "rows"))
    joined = cut(joined.withColumn("label", F.coalesce("label", "node")))
    spent(nodes, multi, labels, *tables)
    found = joined.groupBy("label").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("known").alias("known"), F.sum("rows").alias("rows"))
    found = found.where(_several("lo", "hi", "known", "rows")).select("label", F.col("lo").alias("first"))
    # Each piece is decided by its own cluster, so that the smallest id of every cluster keeps its copy.
    marked = cut(_marked(placed, cut(joined.join(found, "label").select("node", "first", F.col("lo").eqNullSafe(F.col("first")).alias("same"), "rows"))))
    spent(joined)
    # Words of near copies are searched too: what they share with others may go on beyond the paragraph there.
    gone = cut(marked.where("removed and same").groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans")))  # of one document
    windows = _windows(table, gone, least_words)
    nodes = _nodes(windows)
    more = _marked(windows, cut(nodes.where(_several("lo", "hi", "known", "rows")).select("node", F.col("lo").alias("first"), F.lit(True).alias("same"), "rows")))
    spent(gone)
    spans = marked.union(more).groupBy("row").agg(F.collect_list(F.struct("start", "end", "first", "removed")).alias("spans"))  # of one document
    spans = spans.join(table.select("row", "doc_id"), "row")
    kind = docs.schema[id_col].dataType
    schema = StructType([StructField("doc_id", kind), *fields("start_word int, end_word int, n_words int").fields, StructField("first_doc_id", kind), StructField("removed", BooleanType())])

    step = lambda batch: decided_batch(batch, schema.names, least_words)
    return map_batches(spans.select("doc_id", "spans"), lambda: step, schema, rows=200).select(F.col("doc_id").alias(id_col), "start_word", "end_word", "n_words", "first_doc_id", "removed")


def decided_batch(batch: pa.RecordBatch, names: list[str], least_words: int) -> pa.RecordBatch:
    """decided() for each row of batch (doc_id, spans): doc_id, start, end, words, first, removed. Most spans overlap, so
    they are joined as arrays, and only what is apart then becomes Python's objects."""
    row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
    start, end, first, removed = batch.column(1).flatten().flatten()
    coded = first.dictionary_encode()
    known = coded.dictionary.to_pylist()
    turn = sorted(range(len(known)), key=lambda i: (known[i] != known[i], known[i]))  # NaN is after all numbers, as in Spark
    rank = np.empty(len(known) + 1, dtype=np.int64)
    rank[[*turn, len(known)]] = np.arange(len(known) + 1)  # null is last
    code = rank[pc.fill_null(coded.indices, len(known)).to_numpy()]
    group = row * 2 + removed.to_numpy(zero_copy_only=False)
    places, begins, ends, leads, lows = joined(group, start.to_numpy().astype(np.int64), end.to_numpy().astype(np.int64), code)
    runs: dict[int, list] = {}
    for place, run in zip(places.tolist(), zip(begins.tolist(), ends.tolist(), leads.tolist(), lows.tolist())):
        runs.setdefault(place, []).append(run)
    out = [(i, *r) for i in sorted({g >> 1 for g in runs}) for r in _disjoint(_runs(runs.get(2 * i + 1, [])), _runs(runs.get(2 * i, [])), least_words)]
    of, begins, ends, low, gone = np.array(out, dtype=np.int64).reshape(-1, 5).T
    firsts = coded.dictionary.take(pa.array(np.array([*turn, 0], dtype=np.int64)[low], mask=low == len(known)))
    ints = [pa.array(x.astype(np.int32)) for x in (begins, ends, ends - begins)]
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *ints, firsts, pa.array(gone.astype(bool))], names=names)


def joined(group: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """group, start, end, first of the leading span and smallest first of what spans that overlap or touch make; in order of group and start."""
    if not len(group):
        return group, start, end, first, first
    order = np.lexsort((first, end, start, group))
    group, start, end, first = (x[order] for x in (group, start, end, first))
    far = group << 32  # beyond all spans of the groups before
    reach = np.maximum.accumulate(end + far)
    new = np.ones(len(start), dtype=bool)
    new[1:] = start[1:] + far[1:] > reach[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(start)) - 1
    return group[at], start[at], reach[last] - far[at], first[at], np.minimum.reduceat(first, at)


def decided(spans: list[tuple[int, int, int | None, bool]], least_words: int) -> list[tuple[int, int, int | None, bool]]:
    """Disjoint (start, end, smallest first, removed) from spans that overlap; what any span removes is removed.

    Removals that don't make least_words words in a row stay, and are part of what is kept around them."""
    gone, kept = ([(a, b, f, f) for a, b, f, removed in spans if removed == which] for which in (True, False))
    return _disjoint(_runs(gone), _runs(kept), least_words)


def _disjoint(gone: list[tuple], kept: list[tuple], least_words: int) -> list[tuple[int, int, int | None, bool]]:
    """decided() from the _runs of removals and of what is kept."""
    gone = [r for r in gone if r[1] - r[0] >= least_words]
    out, at = [(*r, True) for r in gone], 0
    for start, end, first in kept:
        while at < len(gone) and gone[at][1] <= start:
            at += 1
        here = at
        while start < end:
            stop = min(end, gone[here][0]) if here < len(gone) else end
            if stop - start >= least_words:
                out.append((start, stop, first, False))
            if here == len(gone) or stop == end:
                break
            start, here = gone[here][1], here + 1
    return sorted(out)


def _runs(spans: list[tuple[int, int, int | None, int | None]], gap: int = GAP) -> list[tuple[int, int, int | None]]:
    """(start, end, smallest first) of spans that overlap or touch, or that are of one first document and up to gap words apart.

    A span has two firsts: one that is compared with what is before it, and the smallest."""
    out: list[list] = []
    for start, end, lead, first in sorted(spans, key=lambda s: s[:2]):
        if out and start <= out[-1][1] + (gap if lead == out[-1][2] else 0):
            out[-1][1] = max(out[-1][1], end)
            if out[-1][2] is None or (first is not None and first < out[-1][2]):
                out[-1][2] = first
        else:
            out.append([start, end, first])
    return [tuple(r) for r in out]
