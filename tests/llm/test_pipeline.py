import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from spanforge.llm import mixing, ngram_join
from spanforge.llm.common import row_key
from spanforge.llm.queries import TOKENIZER

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder, docs = tmp_path_factory.mktemp("steps"), spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], DATA).write.parquet(str(folder / name))
        out.append(spark.read.parquet(str(folder / name)))
    return out


def test_stages_take_effect(steps):
    docs, spoken, stripped, single, mixed, packed = steps
    for s in steps[1:5]:
        assert s.columns == docs.columns
    assert spoken.count() == docs.count()  # all have a language
    assert stripped.count() == spoken.count() and stripped.agg(F.sum("n_chars")).first() < spoken.agg(F.sum("n_chars")).first()
    groups = ngram_join.ngram_join(stripped)
    assert single.count() == groups.select("component_id").distinct().count() < stripped.count()
    assert single.join(groups.where("doc_id = component_id"), "doc_id", "left_anti").count() == 0
    assert mixed.count() == mixing.mix_report(single).agg(F.sum("copies")).first()[0]
    assert packed.where("piece = 0").count() == mixed.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024


def test_run_gives_the_last_stage(spark, steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "mixing", "packing"]
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got, want = corpus_pipeline.run(spark, DATA).select(columns), steps[-1].select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert entry.queries()["pipeline"] is corpus_pipeline.run and TOKENIZER.endswith(".json")


def test_stages_take_odd_rows(spark, odd):
    docs, before = odd, None
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA).cache()
        assert docs.count() > 0, name
        if name != "packing":
            assert docs.schema == odd.schema, name
            # every column but those of the text is as it was
            same = lambda df: {repr(tuple(r[c] for c in odd.columns if c not in ("text", "n_chars"))) for r in df.collect()}
            assert same(docs) <= (before or same(odd)), name
            before = same(docs)


def test_rows_are_told_apart_by_where_nulls_are(spark):
    df = spark.createDataFrame([(5, None, "x", {"a": 1}), (5, "x", None, {"a": 1}), (5, "x", None, {"a": None}), (5, "x", None, None), (5, "x", None, None)], "doc_id long, lang string, source string, m map<string,int>")
    keys = [tuple(r) for r in df.select(*row_key(df)).collect()]
    assert len(set(keys)) == 4 and keys[3] == keys[4]


def test_operator_queries_are_registered():
    numbers = [int(m[1]) for n in entry.queries() if (m := re.match(r"op(\d+)_", n))]
    assert sorted(numbers) == list(range(1, 14))
