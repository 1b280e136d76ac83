"""Connected components over links, as Spark jobs; and clusters of nodes that share keys, by an exact test of pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import HEAVY, cut, fields, join_keyed, map_batches, mix64, spent


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for each node of links (a, b: long); a written table.

    Each pass hooks every node to its smallest neighbour and contracts: links between hooked nodes alone are left, so
    a star, however large, goes in one pass and only counts and tables move on."""
    links = cut(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not links.isEmpty():
        both = links.select(F.col("b").alias("node"), F.col("a").alias("other")).union(links.select("a", "b"))
        hooks = cut(both.groupBy("node").agg(F.least("node", F.min("other")).alias("to")))
        hook = lambda c: hooks.select(F.col("node").alias(c), F.col("to").alias(f"__{c}"))
        left = links.join(hook("a"), "a").join(hook("b"), "b").where("__a != __b")
        before, links = links, cut(left.select(F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b")).distinct())
        spent(before)
        if labels is None:
            labels = hooks.select("node", F.col("to").alias("label"))  # reads hooks, which stays
            continue
        moved = labels.join(hooks.withColumnsRenamed({"node": "label", "to": "__to"}), "label", "left")
        before, labels = labels, cut(moved.select("node", F.coalesce("__to", "label").alias("label")))
        spent(before, hooks)
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    spent(links)
    return labels


def joined_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label), written, after more links (a, b): components are contracted, so only new links are gone through."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"__{c}"))
    ends = [F.coalesce(f"__{c}", c) for c in "ab"]
    moved = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(ends[0].alias("a"), ends[1].alias("b"))
    more = components(moved)
    every = labels.union(more.select("node", F.col("node").alias("label"))).distinct()
    out = cut(every.join(more.select(F.col("node").alias("label"), F.col("label").alias("__to")), "label", "left").select("node", F.coalesce("__to", "label").alias("label")))
    spent(labels, more)
    return out


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """For sets as sorted arrays: 100 * intersection >= percent * union."""
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


#: Parts that a leader's pairs are dealt to; each part is sent the leader's set once.
PARTS = 32
#: Leaders of a key in a round, and rounds of them. They make no difference to the links that are found.
LEADERS, ROUNDS = 16, 2
#: Nodes of a key that meet each other under it; those of larger keys meet under their rarest shingles.
SMALL = 32
#: Nodes of a key that one task gets at once; counters by which shingles are called rare, and tasks that add them up.
BLOCK, COUNTERS, DEALT = 1024, 1 << 20, 16


def tested(pairs: DataFrame, sets: DataFrame, set_of: Callable[[bytes], np.ndarray], percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets reach percent; sets: node, words. Each pair is tested in full.

    A leader's (a's) pairs are dealt to PARTS, so neither its pairs meet in one task nor its words travel with each pair."""
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS)))
    words = sets.select("node", "words")
    heads = dealt.select("a", "part").distinct().join(words.withColumnRenamed("node", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "words")
    others = dealt.join(words.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "words")
    rows = heads.union(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def make():
        mine: list = [None, None]  # the leader at hand and its set

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            kept: list[tuple[int, int]] = []
            for a, b, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                found = set_of(words.as_py())
                if b is None:
                    mine[:] = a, found
                elif mine[0] == a and jaccard_at_least(mine[1], found, percent):
                    kept.append((a, b))
            return pa.RecordBatch.from_pydict({"a": [a for a, _ in kept], "b": [b for _, b in kept]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

        return step

    return map_batches(rows.select("a", "b", "words"), make, fields("a long, b long"))


#: Bits of a parity sketch, and the columns of 64 bits that hold it in joins.
SKETCH = 512
_WORDS = [f"w{i}" for i in range(SKETCH // 64)]


def _near(percent: int, other: Callable[[str], Column] = lambda c: F.col(f"other_{c}")) -> Column:
    """Of two rows (n, w0.. and other("n"), other("w0")..): whether their sets could reach percent by their sizes and sketches.

    The Hamming distance of two parity sketches is at most the symmetric difference of their sets."""
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.col(w).bitwiseXOR(other(w))) for w in _WORDS))
    return (F.least("n", other("n")) * 100 >= F.greatest("n", other("n")) * percent) & (apart * (100 + percent) <= (F.col("n") + other("n")) * (100 - percent))


#: One of so many nodes is looked at to find keys of very many nodes, and nodes among these that make such a key; parts
#: that such a key's nodes are dealt to.
SOME, MANY, SALTS = 64, 64, 64


def meeting(keys: DataFrame, some: DataFrame, merge: bool = False) -> DataFrame:
    """keys (key, node) under which several nodes meet, with lo, the smallest of them; some: the keys of one of SOME nodes.

    Keys of very many nodes, which some shows, are dealt to SALTS parts, and their sums come together by themselves (of
    HEAVY keys at most); so no task gets one key's nodes. Which way a key goes makes no difference to the rows.
    merge: keys that bring together the same nodes become one, named by a hash of these nodes. (Should two hashes be
    equal, groups merge and lose none.)"""
    sizes = cut(some.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("rows")))
    least = max(MANY, (sizes.agg(F.sum("rows")).first()[0] or 0) // HEAVY)
    hot = [r[0] for r in sizes.where(F.col("rows") > least).orderBy(F.desc("rows"), "key").limit(HEAVY).collect()]
    spent(sizes)
    is_hot = F.col("key").isin(hot) if hot else F.lit(False)
    dealt = keys.withColumns({"hot": is_hot, "salt": F.when(is_hot, F.pmod(F.xxhash64(F.lit("salt"), "node"), F.lit(SALTS))).otherwise(0)})
    group = Window.partitionBy("key", "salt")
    multi = dealt.withColumns({"lo": F.min("node").over(group), "hi": F.max("node").over(group)}).where("hot or lo != hi").select("key", "salt", "hot", "node", "lo").distinct()
    if merge:
        multi = multi.withColumn("name", F.bit_xor(F.xxhash64("node")).over(group))
    multi = cut(multi.drop("salt"))
    rest = multi.where("not hot") if hot else multi
    out = rest.select(F.col("name" if merge else "key").alias("key"), "node", "lo")
    if hot:
        whole = multi.where("hot").groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("name")).where("lo != hi")
        many = multi.where("hot").select("key", "node").join(F.broadcast(whole), "key")  # HEAVY keys at most
        out = out.union(many.select(F.col("name" if merge else "key").alias("key"), "node", "lo"))
    if not merge:
        return out
    merged = cut(out.distinct())
    spent(multi)
    return merged


def crossed(rows: DataFrame, keys: DataFrame, fits: Column) -> DataFrame:
    """a, b: pairs of different components under a key that fit. rows: key, node, label and others; keys (key, rows,
    main: the component with the most nodes), written. In fits, the other node's columns are other_...

    Only nodes outside a key's main component look for partners, so what is tried is at most twice the open pairs; the
    partners are dealt to blocks, each of which meets the lookers by itself."""
    told = rows if "main" in rows.columns else join_keyed(rows, keys.withColumn("times", F.col("rows")), "key", "times")
    told = told.withColumn("blocks", F.ceil(F.col("rows") / BLOCK))
    partners = told.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    lookers = told.where("label != main").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    lookers = lookers.select("key", "block", *[F.col(c).alias(f"other_{c}") for c in rows.columns if c not in ("key", "rows", "main")])
    apart = (F.col("label") != F.col("other_label")) & ((F.col("label") == F.col("main")) | (F.col("label") < F.col("other_label")))
    met = partners.join(lookers, ["key", "block"]).where(apart & fits)
    return met.select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b"))


def spread(rows: DataFrame) -> DataFrame:
    """key, rows, main of the keys (key, node, label) whose nodes are of several components; a written table."""
    sizes = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    parts = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("c").alias("rows"), F.max_by("label", F.struct("c", "label")).alias("main"))
    return cut(parts.where("parts > 1").select("key", "rows", "main"))


def sifted(pairs: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b; written) that sizes and sketches don't rule out."""
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("rows"))
    heads = cut(sizes.join(sketched.withColumnRenamed("node", "a"), "a").select("a", "rows", *[F.col(c).alias(f"other_{c}") for c in ("n", *_WORDS)]))
    return join_keyed(pairs.join(sketched.withColumnRenamed("node", "b"), "b"), heads, "a", "rows").where(_near(percent)).select("a", "b")


def _rarity(sets: DataFrame, set_of: Callable[[bytes], np.ndarray]) -> np.ndarray:
    """For each of COUNTERS hash values, how often sets (node, words, label) hold shingles of it: never less than a shingle's
    own number. Tasks add up their own, and DEALT tasks what all give for their share of the counters."""
    schema, share = fields("share int, spots array<int>, counts array<long>"), COUNTERS // DEALT

    def told(total: np.ndarray, which: int) -> pa.RecordBatch:
        part = total[which * share : (which + 1) * share]
        at = np.flatnonzero(part)
        return pa.RecordBatch.from_pydict({"share": [which], "spots": [at], "counts": [part[at]]}, schema=to_arrow_schema(schema))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int64)
        for batch in batches:
            for words in batch.column(0):
                np.add.at(total, _spot(set_of(words.as_py())), 1)
        for which in np.flatnonzero(total.reshape(DEALT, -1).any(axis=1)).tolist():
            yield told(total, which)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros(COUNTERS, dtype=np.int64), set()
        for batch in batches:
            for which, spots, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                held.add(which)
                total[which * share + spots.values.to_numpy()] += counts.values.to_numpy()
        for which in held:
            yield told(total, which)

    out = np.zeros(COUNTERS, dtype=np.int64)
    sums = sets.select("words").mapInArrow(own, schema).repartition(DEALT, "share").mapInArrow(together, schema)
    for r in sums.collect():  # DEALT rows, COUNTERS numbers at most
        out[r["share"] * share + np.array(r["spots"], dtype=np.int64)] = r["counts"]
    return out


def _spot(hashes: np.ndarray) -> np.ndarray:
    return (mix64(hashes + np.uint64(7)) & np.uint64(COUNTERS - 1)).astype(np.int64)


def rare_keys(sets: DataFrame, set_of: Callable[[bytes], np.ndarray], percent: int) -> DataFrame:
    """key, node, label, n, at: so many of each set's shingles, the rarest first, that two sets which reach percent share
    one of them for sure; those that no other set holds are left out. at: the shingle's place in that order."""
    rarity = sets.sparkSession.sparkContext.broadcast(_rarity(sets, set_of))  # of COUNTERS numbers
    schema = fields("key long, node long, label long, n long, at long")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list[np.ndarray]] = [[] for _ in schema.names]
        for node, label, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            found = set_of(words.as_py())
            count = rarity.value[_spot(found)]
            order = np.lexsort((found, count))[: len(found) + (-len(found) * percent) // 100 + 1]
            at = np.flatnonzero(count[order] > 1)
            for column, values in zip(out, (found[order[at]].view(np.int64), np.full(len(at), node), np.full(len(at), label), np.full(len(at), len(found)), at)):
                column.append(values)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), type=pa.int64()) for c in out], names=schema.names)

    return map_batches(sets.select("node", "label", "words"), lambda: step, schema, rows=200)


def rare_pairs(nodes: DataFrame, sets: DataFrame, set_of: Callable[[bytes], np.ndarray], percent: int) -> DataFrame:
    """a, b: pairs of nodes (node, label) of different components that share a shingle of rare_keys, and could reach percent by its places."""
    mine = cut(sets.select("node", "words").join(nodes, "node"))
    rows = cut(rare_keys(mine, set_of, percent))
    keys = spread(rows)
    left = F.least(F.col("n") - F.col("at"), F.col("other_n") - F.col("other_at"))
    could = (left * (100 + percent) >= (F.col("n") + F.col("other_n")) * percent) & (F.least("n", "other_n") * 100 >= F.greatest("n", "other_n") * percent)
    pairs = cut(crossed(rows, keys, could).distinct())
    spent(mine, rows, keys)
    return pairs


def clusters(multi: DataFrame, sets: DataFrame, set_of: Callable[[bytes], np.ndarray], percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """(labels (node, label; written), tables that may go after use) from multi (key, node, lo) and sets (node, words, n, sketch), both
    written tables: nodes that share a key and whose sets reach percent are linked; label is the smallest node of a component.

    The smallest node of each key is tested with the key's others, each pair once however many keys it shares; pairs within
    one component need no test any more. Of the keys that still span components, ROUNDS times LEADERS nodes are tested
    with the nodes of other components. Then the nodes of a key of at most SMALL meet each other under it; those of larger
    keys meet under their rarest shingles, without loss. All pairs are sifted by sizes and sketches and tested in full."""
    sketched = sets.select("node", "n", *[F.col("sketch")[i].alias(w) for i, w in enumerate(_WORDS)])
    stars = cut(multi.where("lo != node").select(F.col("lo").alias("a"), F.col("node").alias("b")).distinct())
    links = cut(tested(sifted(stars, sketched, percent), sets, set_of, percent))
    labels = components(links)
    spent(stars, links)
    known = cut(multi.select("key", "node").join(sketched, "node"))
    for turn in range(ROUNDS + 1):
        rest = cut(known.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
        keys = spread(rest)
        done = keys.isEmpty()
        spent(known)
        if done:
            spent(rest, keys)
            break
        known = cut(join_keyed(rest, keys.withColumn("times", F.col("rows")), "key", "times"))
        spent(rest)
        if turn < ROUNDS:
            slot = F.xxhash64(F.lit(turn), "node")
            some = known.groupBy("key", F.pmod(slot, F.lit(LEADERS)).alias("slot")).agg(F.min_by(F.struct("label", "node", "n", *_WORDS), slot).alias("l"), F.count(F.lit(1)).alias("c"))
            leaders = cut(some.groupBy("key").agg(F.collect_list("l").alias("leaders"), F.sum("c").alias("many")))  # LEADERS of each at most
            fit = F.filter("leaders", lambda l: (F.col("label") != l["label"]) & _near(percent, lambda c: l[c]))  # noqa: E741
            met = join_keyed(known, leaders, "key", "many").select("node", F.explode(F.transform(fit, lambda l: l["node"])).alias("other"))  # noqa: E741
            pairs = met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
            made = [leaders]
        else:
            rare = rare_pairs(known.where(F.col("rows") > SMALL).select("node", "label").distinct(), sets, set_of, percent)
            few = crossed(known.where(F.col("rows") <= SMALL), keys, _near(percent))
            pairs = few.union(sifted(rare, sketched, percent)).distinct()
            made = [rare]
        found = cut(tested(pairs, sets, set_of, percent))
        labels = joined_components(labels, found)
        spent(found, keys, *made)
        known = known.drop("label", "rows", "main")
    else:
        spent(known)
    return labels, [sets]
