import random

import pytest
from pyspark.sql import functions as F

from spanforge.functions import compile
from spanforge.functions.patterns import rows_of
from spanforge.streaming import chunks

PATTERNS = [r"ab?c{1,3}", r"\b\w{2}\b", r"(?<=a)b|^a|c$", r"a??b?", r"\d{1,3}\.\d(?!\d)", r"(a|bc)\1", r"(?m)^[a-c]{1,2}$", r"\Aa|b\z", r"(?:ab|a)(?=c)", r"é{1,2}x?", r"", r"(?=(?<!a)bc)\w"]


def test_reach():
    of = lambda p: chunks.reach(compile(p).node)
    assert of("abc") == (3, 0, 0) and of("a{2,5}|b") == (5, 0, 0) and of(r"(ab)\1") == (4, 0, 0)
    assert of(r"\bab$") == (2, 1, 2) and of(r"\bab\z") == (2, 1, 1) and of("(?<=abc)d(?!ef)") == (1, 3, 3)
    for p in ("a+", r"(a{2,})b", r"a(?=b*)", r"\X"):
        assert of(p) is None, p


@pytest.mark.parametrize("pattern", PATTERNS)
def test_any_cutting_gives_the_matches_of_the_whole(pattern):
    rng = random.Random(pattern)
    p = compile(pattern)
    bounds, spelled = chunks.reach(p.node), p._spelled(set(), python=True).text
    for _ in range(150):
        text = "".join(rng.choices("aabbcc1. é\nx😀", k=rng.randint(0, 30)))
        cuts = sorted(rng.randint(0, len(text)) for _ in range(rng.randint(0, 8)))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        saved, got = None, []
        for i, part in enumerate(parts):
            left = chunks.Undecided(saved)
            got += left.more(spelled, bounds, part, i == len(parts) - 1)
            saved = left.saved()
            assert len(left.text) <= sum(bounds) + max(bounds[1], 1) + 1
        assert got == [(k, m["start"], m["end"], m["text"]) for k, m in enumerate(rows_of(pattern, text), 1)], (text, parts)


def test_stream_of_chunks_over_a_restart(spark, tmp_path):
    spark.conf.set(*chunks.STORE)
    rng, rows, texts = random.Random(9), [], {}
    for key in range(12):
        text = "".join(rng.choices("aabbc1. é\n", k=rng.randint(0, 80)))
        texts[key] = text if key else None
        cuts = sorted(rng.randint(0, len(text)) for _ in range(6))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])] if key else [None]
        rows += [(key, i, part, i == len(parts) - 1) for i, part in enumerate(parts)]
    rows += [(1, 3, "comes again", False), (2, 99, "after the last", False), (3, None, "no number", None)]
    rng.shuffle(rows)
    rows.sort(key=lambda r: r[2] in ("comes again", "after the last"))  # what comes again comes later
    schema = "id long, seq int, part string, final boolean"
    thirds = [rows[i * len(rows) // 3 : (i + 1) * len(rows) // 3] for i in range(3)]
    p = compile(r"[ab]{1,4}c?|\d\.")
    source, sink, saved = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for part in thirds:  # each run starts anew from the checkpoint of the one before
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        found = chunks.chunk_matches(stream, ["id"], "seq", "part", "final", p)
        found.writeStream.format("parquet").option("checkpointLocation", saved).trigger(availableNow=True).start(sink).awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(sink).collect())
    assert got == sorted((k, i, m["start"], m["end"], m["text"]) for k, t in texts.items() if t for i, m in enumerate(rows_of(p.pattern, t), 1))
    with pytest.raises(ValueError, match="no greatest width"):
        chunks.chunk_matches(stream, ["id"], "seq", "part", "final", compile("a+"))


def test_sessions_of_matches(spark, tmp_path):
    at = "timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,{},0)"
    rows = spark.sql(f"SELECT id % 2 AS k, {at.format('CAST(if(id < 20, id, id + 60) AS int)')} AS ts, if(id % 5 = 0, 'no', 'hit hit') AS t FROM range(40) UNION ALL SELECT 0, null, 'hit'")
    p = compile("hit")
    batch = {tuple(r) for r in chunks.match_sessions(rows, "ts", ["k"], "t", p, "15 minutes").collect()}
    assert sorted((k, n, m) for k, _, _, n, m in batch) == [(0, 8, 16), (0, 8, 16), (1, 8, 16), (1, 8, 16)]
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.sql(f"SELECT 5L AS k, {at.format('1000')} AS ts, 'hit' AS t").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = chunks.match_sessions(stream, "ts", ["k"], "t", p, "15 minutes").writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("sessions").where("k < 5").collect()} <= batch
