"""The registered queries of the corpus operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import decontam, dedup, langid, licenses, linecrf, mixing, preference, quality, sharding, spelling, statements, urlfilter, vectors, warc
from .common import Workspace, crc_mod, table


def op1_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = linecrf.judge(docs, linecrf.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages")).where("kind = 'record'")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2).select("doc_id", "n_shingles", "component_id", "kept")


def op6_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = preference.preferences(preference.neighbours(table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return found.withColumns({c: spans(F.col(c)) for c in ("chosen_loss", "rejected_loss")})


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs, Workspace(spark, "langid")))
    return found.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "question_overlap", "answer_overlap")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents")).drop("text_key")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.labelled(licenses.scan(table(spark, sf_dir, "documents")))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.compressed(table(spark, sf_dir, "embeddings")).drop("label")


QUERIES = {
    "op1_line_crf": op1_line_crf,
    "op2_mixing": op2_mixing,
    "op3_warc": op3_warc,
    "op4_quality": op4_quality,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_preferences": op6_preferences,
    "op7_language_id": op7_language_id,
    "op8_decontamination": op8_decontamination,
    "op9_sharding": op9_sharding,
    "op10_url_filter": op10_url_filter,
    "op11_licenses": op11_licenses,
    "op12_spelling": op12_spelling,
    "op13_vector_codes": op13_vector_codes,
}

SQL = {
    "op11_licenses": statements.licenses(),
    "op12_spelling": statements.SPELLING,
    "op13_vector_codes": statements.vector_codes(),
    "op5_near_duplicates": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
classes AS (SELECT min(doc_id) AS c, s, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM sets) GROUP BY s HAVING len(s) > 0),
member AS (SELECT doc_id, min(c) AS c FROM (SELECT doc_id, list_sort(s) AS s FROM sets) JOIN classes USING (s) GROUP BY doc_id),
tokens AS (SELECT c, n, unnest(s) AS t FROM classes),
links AS (
  SELECT a.c AS a, b.c AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
comp AS (SELECT a AS c, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(comp.component_id, s.doc_id) AS component_id,
  s.doc_id = coalesce(comp.component_id, s.doc_id) AS kept
FROM sets s LEFT JOIN member m USING (doc_id) LEFT JOIN comp ON comp.c = m.c
""",
    "op6_preferences": r"""
WITH t AS (
  SELECT conv_id, floor(conv_id / 2)::BIGINT AS pair_id, conv_id % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)),
lengths AS (SELECT pair_id, min(conv_id) FILTER (side = 0) AS chosen_id, min(conv_id) FILTER (side = 1) AS rejected_id, count(*) FILTER (side = 0) AS nc, count(*) FILTER (side = 1) AS nr FROM t GROUP BY pair_id),
differs AS (SELECT a.pair_id, min(a.pos) AS d FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.pos = b.pos AND a.side = 0 AND b.side = 1 WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.pair_id),
cut AS (SELECT l.*, coalesce(d - 1, least(nc, nr)) AS prompt_turns FROM lengths l LEFT JOIN differs USING (pair_id)),
r AS (
  SELECT t.*, prompt_turns, pos > prompt_turns AS after, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body FROM t JOIN cut USING (pair_id)),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, after ORDER BY pos) AS fin FROM r),
side AS (
  SELECT pair_id, side, coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (NOT after), '') AS prompt, coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (after), '') AS completion,
    coalesce(string_agg((fin - length(body))::VARCHAR || '-' || fin::VARCHAR, ',' ORDER BY pos) FILTER (after AND role = 'assistant'), '') AS loss FROM o GROUP BY pair_id, side)
SELECT c.pair_id, chosen_id, rejected_id, CASE WHEN c.prompt_turns = 0 THEN '' ELSE coalesce(x.prompt, '') END AS prompt, c.prompt_turns::INT AS prompt_turns, x.completion AS chosen_completion, x.loss AS chosen_loss, y.completion AS rejected_completion, y.loss AS rejected_loss
FROM cut c LEFT JOIN side x ON x.pair_id = c.pair_id AND x.side = 0 LEFT JOIN side y ON y.pair_id = c.pair_id AND y.side = 1
""",
}
