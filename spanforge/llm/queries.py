"""The operators' queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary, exact, langid, lines, media, mixing, ngram_join, packing, paragraphs, quality, resample, warc, whiten
from .common import held_out, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, ~held_out(F.col("doc_id")))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.payload_features(media.store(media.encode_text(table(spark, sf_dir, "documents"))))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), lambda c: ~held_out(c))
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_spans(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.read(binary.write(table(spark, sf_dir, "documents"), TOKENIZER))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.revisit_report(table(spark, sf_dir, "pages"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampling_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whitening_report(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_language_id, op3_packing, op4_media, op5_quality, op6_exact_dedup, op7_line_dedup, op8_substring_dedup, op9_ngram_join, op10_token_output, op11_warc, op12_resampling, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": r"""
            WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
            s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
            c AS (SELECT *, 3.0::DOUBLE * source_size AS cap FROM s),
            o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source IS NULL, source) AS k FROM c),
            l AS (SELECT *, ((SELECT sum(size) FROM d) - (sum(cap) OVER (ORDER BY k) - cap)) / sum(weight) OVER (ORDER BY k DESC) AS level FROM o),
            v AS (SELECT coalesce(min_by(level, k), 0) AS level FROM l WHERE cap > level * weight),
            t AS (SELECT source, source_size, least(cap, v.level * weight) AS target,
                         CASE WHEN source_size = 0 THEN 0 WHEN cap <= v.level * weight THEN 3.0::DOUBLE ELSE least(cap, v.level * weight) / source_size END AS rate,
                         CAST('0x' || substr(md5('7:' || coalesce(source, '')), 1, 7) AS BIGINT) / 268435456.0::DOUBLE AS turn FROM c, v),
            p AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) - 1 AS place FROM d),
            x AS (SELECT doc_id, size, source_size, target, CAST(least(floor(rate * (place + 1) + turn) - floor(rate * place + turn), 3) AS BIGINT) AS copies FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
            SELECT *, copies * size AS taken FROM x""",
        "op6_exact_dedup": """
            WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   coalesce(doc_id = max(doc_id) OVER w, false) AS kept, sha256(t) AS text_sha256
            FROM n WINDOW w AS (PARTITION BY t)""",
        "op11_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
            k AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS kept FROM p)
            SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
                   array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(sha1(html), CAST(i // 8 * 10 + 1 AS BIGINT), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
                   CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to
            FROM k""",
        "op12_resampling": r"""
            WITH bits AS (SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
            d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
            b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
            f AS (SELECT doc_id, word, count(*) AS c FROM (SELECT doc_id, unnest(words) AS word FROM d) GROUP BY ALL),
            w AS (SELECT word, CAST(sum(s) AS BIGINT) AS s, CAST(sum(t) AS BIGINT) AS t FROM (SELECT word, c AS s, 0 AS t FROM f UNION ALL SELECT unnest(words), 0, 1 FROM b) GROUP BY word),
            h AS (SELECT word, s, t, xor(list_reduce(list_transform(range(octet_length(encode(word))), lambda p: CAST('0x' || substr(hex(encode(word)), CAST(2 * p + 1 AS BIGINT), 2) AS BIGINT)), lambda x, y: xor(x >> 8, crc[(xor(x, y) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM w, bits),
            g AS (SELECT bucket, floor(1000 * ln((CAST(sum(t) AS DOUBLE) + 1) * ((SELECT sum(s) FROM w)::DOUBLE + 10000) / ((CAST(sum(s) AS DOUBLE) + 1) * ((SELECT sum(t) FROM w)::DOUBLE + 10000)))) AS gain FROM h GROUP BY bucket),
            m AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS n_features, CAST(floor(sum(c * gain) / sum(c)) AS BIGINT) AS weight FROM f JOIN h USING (word) JOIN g USING (bucket) GROUP BY doc_id),
            x AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN m USING (doc_id)),
            r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x WHERE n_features >= 20 QUALIFY rank <= count(*) OVER () * 10 // 100)
            SELECT doc_id, n_features, weight, score, CAST(rank AS BIGINT) AS rank FROM x LEFT JOIN r USING (doc_id)""",
    }
