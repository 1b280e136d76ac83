"""Line dedup by a log-template tree of fixed depth.

A line falls by its number of tokens and its first DEPTH tokens (tokens with digits read as <*>) into a leaf. Within a leaf, a
token is constant at its place if lines of enough classes have it there; all others generalise to <*>, which gives the
line's template. Templates that recur across documents are dropped, with all their lines.

What counts as a document is a class of near copies, so that the lines of one document and its copies don't recur, and
that many copies of one document don't hide the others: texts whose MinHash signatures (HASHES values over 5-word shingles)
agree in a band and in at least NEAR of all values are linked with a leading text of that band; components are the
classes. A template recurs that `recurs` classes have; lines of fewer than SHORT tokens, which say little, in `short_recurs`.

Texts are read three times: for facts of lines and signatures; for the tokens of leaves that enough classes have (known by
a bitmap of fixed size, then exactly); and to leave out the lines, when each text moves once to meet its lines' numbers.

Defined results: null and empty texts have no lines to drop and stay as they are; lines without tokens are never dropped;
a text may become empty, its row stays; equal rows lose equal lines; columns other than the text (and n_chars, if there) are
left alone, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BITS, batch_words, bitmap, cut, fields, join_keyed, lists, map_batches, mix64, packed, sequence_hashes, shingles, spent
from .links import components

#: Leading tokens of a leaf; classes of near copies that make a line recur; constant tokens' (never <*>) least share of
#: a template; tokens under which a line is short, and the classes that make such a line recur.
DEPTH, RECURS, CONSTANT, SHORT, SHORT_RECURS = 3, 3, 0.5, 4, 6
#: Values of a signature, rows of a band, and the share of equal values that makes near copies.
HASHES, ROWS, NEAR = 64, 4, 0.7
#: What a token with digits is read as.
ANY = np.uint64(0x2545F4914F6CDD1D)


def signatures(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """HASHES 32-bit MinHash values of each text's 5-word shingles (of the words, if there are fewer than five)."""
    out = np.zeros((len(first) - 1, HASHES), dtype=np.uint32)
    sizes = np.diff(first)
    for short in (False, True):
        rows = np.flatnonzero((sizes > 0) & ((sizes < 5) == short))
        if not len(rows):
            continue
        many = sizes[rows] if short else sizes[rows] - 4
        at = np.cumsum(many) - many
        inside = np.repeat(first[rows] - at, many) + np.arange(many.sum())
        found = mix64(words[inside]) if short else shingles(words)[inside]
        for k in range(HASHES):
            turned = found * np.uint64(((2 * k + 1) * 0xD1B54A32D192ED03) & ((1 << 64) - 1))
            out[rows, k] = np.minimum.reduceat((turned >> np.uint64(32)).astype(np.uint32) ^ turned.astype(np.uint32), at)
    return out


class Lines:
    """The lines with tokens of a batch of texts: where each starts, its tokens, text, number in the text, leaf and masked hash."""

    def __init__(self, texts: pa.Array, depth: int):
        w = batch_words(texts, fold=False)
        self.words, owner, n = w, w.owner, len(w.hashes)
        self.tokens = np.where(w.digits, ANY, w.hashes)
        new = np.ones(n, dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (w.line[1:] != w.line[:-1])
        self.starts = np.flatnonzero(new)
        self.sizes = np.diff(np.append(self.starts, n))
        self.owner = owner[self.starts]
        self.number = w.line[self.starts] - w.first_line[self.owner]
        head = sequence_hashes(self.tokens, self.starts, np.minimum(self.sizes, depth))
        self.leaf = mix64(head ^ mix64(self.sizes.astype(np.uint64)))
        self.masked = sequence_hashes(self.tokens, self.starts, self.sizes)


def _facts(keyed: DataFrame, depth: int) -> DataFrame:
    """Of each row its k1, k2, doc (a hash of the text's words), signature, bands and lines."""
    schema = fields("k1 long, k2 long, doc long, signature array<int>, bands array<long>, lines array<struct<line int, leaf long, masked long, size int>>")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, n = Lines(batch.column(2), depth), batch.num_rows
        first = x.words.first
        folded = batch_words(batch.column(2)).hashes
        signed = signatures(folded, first)
        doc = sequence_hashes(x.words.hashes, first[:-1], np.diff(first))
        salted = np.arange(HASHES // ROWS, dtype=np.uint64) + np.uint64(1)
        bands = sequence_hashes(signed.ravel().astype(np.uint64), np.arange(0, signed.size, ROWS), np.full(signed.size // ROWS, ROWS)).reshape(n, -1) if n else np.empty((0, 1), dtype=np.uint64)
        bands = mix64(bands ^ mix64(salted)) if n else bands
        some = np.diff(first) > 0  # texts without words have no bands
        long = lambda v: pa.array(v.view(np.int64))
        lines = pa.StructArray.from_arrays([pa.array(x.number.astype(np.int32)), long(x.leaf), long(x.masked), pa.array(x.sizes.astype(np.int32))], ["line", "leaf", "masked", "size"])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), long(doc), lists(pa.array(signed[some].ravel().view(np.int32)), some * HASHES), lists(long(bands[some].ravel()), some * (HASHES // ROWS)), lists(lines, np.bincount(x.owner, minlength=n))], names=schema.names)

    return map_batches(keyed.select("k1", "k2", "text"), lambda: step, schema, rows=500)


def near_classes(facts: DataFrame) -> DataFrame:
    """node, label: the near-copy class of texts (facts.doc) that have near copies; texts alone are left out."""
    keys = facts.select("doc", F.explode("bands").alias("key"))
    lead = cut(keys.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("z"), F.count(F.lit(1)).alias("rows")).where("a < z").select("key", "a", "rows"))
    pairs = cut(join_keyed(keys, lead, "key", "rows").where("a != doc").select("a", "doc").distinct())
    needed = pairs.select(F.col("a").alias("doc")).union(pairs.select("doc")).distinct()
    signed = cut(facts.select("doc", "signature").join(needed, "doc", "left_semi").dropDuplicates(["doc"]))
    # A leader's pairs are dealt to as many parts as its signature is sent to.
    deal = pairs.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(32)))
    heads = deal.select("a", "part").distinct().join(signed.withColumnsRenamed({"doc": "a", "signature": "other"}), "a")
    both = deal.join(signed, "doc").join(heads, ["a", "part"])
    same = F.aggregate(F.zip_with("signature", "other", lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)
    labels = components(both.where(same >= int(HASHES * NEAR)).select("a", F.col("doc").alias("b")))
    spent(lead, pairs, signed)
    return labels


def _tokens(keyed: DataFrame, leaves: DataFrame, depth: int) -> DataFrame:
    """leaf, masked, place, token of the lines whose leaf is in leaves, and of few others (for equal bits)."""
    schema = fields("leaf long, masked long, place int, token long")
    marks = keyed.sparkSession.sparkContext.broadcast(bitmap(leaves, "leaf"))  # of BITS bits, whatever the number of leaves

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = Lines(batch.column(0), depth)
        spot = x.leaf.astype(np.int64) & (BITS - 1)
        held = np.flatnonzero(marks.value[spot >> 3] >> (spot & 7).astype(np.uint8) & 1)
        _, one = np.unique(x.masked[held], return_index=True)
        held = held[one]
        sizes = x.sizes[held]
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        token = x.tokens[np.repeat(x.starts[held], sizes) + place]
        columns = [np.repeat(x.leaf[held], sizes).view(np.int64), np.repeat(x.masked[held], sizes).view(np.int64), place.astype(np.int32), token.view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=schema.names)

    return map_batches(keyed.select("text"), lambda: step, schema, rows=500).distinct()


def recurring(keyed: DataFrame, facts: DataFrame, depth: int = DEPTH, recurs: int = RECURS, constant: float = CONSTANT, short: int = SHORT, short_recurs: int = SHORT_RECURS) -> DataFrame:
    """masked and rows of the lines to drop. keyed: k1, k2, text; facts: theirs."""
    labels = near_classes(facts)
    once = facts.select("doc", "lines").dropDuplicates(["doc"])
    classed = once.join(labels.withColumnRenamed("node", "doc"), "doc", "left").select(F.coalesce("label", "doc").alias("class"), F.inline("lines"))
    lines = cut(classed.select("class", "leaf", "masked", "size").distinct())
    need = F.when(F.col("size") < short, short_recurs).otherwise(recurs)
    spread = lambda df, *by: df.select(*by, "class", "size").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("classes"), F.first("size").alias("size")).where(F.col("classes") >= need)
    leaves = cut(spread(lines, "leaf"))
    held = cut(join_keyed(lines, leaves.select("leaf", "classes"), "leaf", "classes"))
    weights = cut(held.groupBy("leaf", "masked", "size").agg(F.count(F.lit(1)).alias("n")))
    tokens = _tokens(keyed, leaves, depth).where(F.col("token") != int(ANY.astype(np.int64))).join(weights, ["leaf", "masked"])
    tokens = cut(tokens.select("leaf", "masked", "size", "n", F.xxhash64("leaf", "place", "token").alias("spot")))
    support = cut(tokens.groupBy("spot").agg(F.sum("n").alias("s")).where(F.col("s") >= min(recurs, short_recurs)))
    fixed = join_keyed(tokens, support, "spot", "s").groupBy("leaf", "masked", "size", "n").agg(F.sum(F.col("spot").cast("decimal(38,0)")).alias("t"), F.count(F.lit(1)).alias("c"))
    templates = cut(fixed.where(F.col("c") >= F.col("size") * constant).select("masked", F.xxhash64("leaf", "t").alias("template"), "n"))
    of = cut(join_keyed(held.select("masked", "class", "size"), templates, "masked", "n"))
    dropped = cut(spread(of, "template"))
    gone = cut(templates.join(dropped, "template").select("masked", "n"))
    spent(lines, leaves, held, weights, tokens, support, templates, of, dropped)
    return gone


def drop_lines(docs: DataFrame, text_col: str = "text", dropped_col: str | None = None, depth: int = DEPTH, **options) -> DataFrame:
    """docs without their recurring lines; n_chars, if there, follows. dropped_col: adds the dropped lines' numbers from 0."""
    keyed = packed(docs, text_col)
    facts = cut(_facts(keyed, depth))
    gone = recurring(keyed, facts, depth, **options)
    numbers = facts.select("k1", "k2", F.inline("lines"))
    refs = join_keyed(numbers, gone.withColumnRenamed("n", "count"), "masked", "count").groupBy("k1", "k2").agg(F.sort_array(F.collect_set("line")).alias("gone"))
    refs = cut(refs)  # of one text each
    spent(facts)
    # The texts move, whatever the size: a plan that is the same for every size.
    rows = keyed.join(refs.hint("merge"), ["k1", "k2"], "left").select("doc", "gone", F.when(F.col("gone").isNotNull(), F.col("text")).alias("text"))
    kept = fields("doc string, gone array<int>, text string")
    kept["doc"].dataType = rows.schema["doc"].dataType

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        left = []
        for text, numbers in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist()):
            if numbers is not None:
                out = set(numbers)
                text = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in out)
            left.append(text)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(left, type=pa.string())], names=["doc", "gone", "text"])

    found = map_batches(rows, lambda: step, kept)
    changed = F.col("gone").isNotNull()
    columns = []
    for f in docs.schema.fields:
        value = F.col("doc").getField(f.name)
        if f.name == text_col:
            value = F.when(changed, F.col("text")).otherwise(value)
        elif f.name == "n_chars":
            value = F.when(changed, F.length("text").cast(f.dataType)).otherwise(value)
        columns.append(value.alias(f.name))
    return found.select(*columns, *([F.col("gone").alias(dropped_col)] if dropped_col else []))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each document: id, n_lines, dropped_lines, n_chars and text_sha256 of what is left."""
    found = drop_lines(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).cast("long").alias("n_lines")), "text", "gone", **options)
    kept = F.coalesce(F.col("text"), F.lit(""))
    return found.select(F.col("id").alias(id_col), "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("dropped_lines"), F.length(kept).cast("long").alias("n_chars"), F.sha2(kept, 256).alias("text_sha256"))
