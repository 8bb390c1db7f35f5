"""Registered queries of the training-data operators and their DuckDB forms."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, embeddings, langid, linecrf, mixing, negatives, packing, rules, search, sharding,
               simhash, token_files, warc)
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"),
                      F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                      F.col("component").alias("component_id"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    got = sharding.histogram_shard(docs.withColumn("text_crc32", F.crc32(text)), 8)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix_counts(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", "taken", F.size("shard_words").alias("n_shards"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.apply_policy(rules.stored_ledger(table(spark, sf_dir, "documents")),
                              rules.POLICIES[rules.CURRENT])
    base = rules.POLICIES["base"].mask
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (F.col("failed").bitwiseAND(F.lit(base).cast("long")) != 0).alias("base_failed"),
                       "kept")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = linecrf.fit_from(docs, table(spark, sf_dir, "labels"))
    return linecrf.score_quality(docs, model)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit_from(docs))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_round_trip(table(spark, sf_dir, "documents"),
                                        public_tokenizers.path("byte_bpe_50k.json"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"),
                              public_tokenizers.path("word_bpe_49k.json"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_hard_negatives(rows.withColumn("label", moved))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"),
                                  public_tokenizers.path("byte_bpe_50k.json"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = (op1_simhash, op2_warc, op3_sharding, op4_mixing, op5_embeddings, op6_rules, op7_quality,
           op8_langid, op9_tokens, op10_bpe, op11_negatives, op12_packing, op13_search, pipeline)
    return {f.__name__: f for f in ops}


_WARC_SQL = r"""
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest,
             CASE WHEN octet_length(body) >= 1000
                   AND page_id IS DISTINCT FROM max(page_id) OVER (PARTITION BY body)
                  THEN max(page_id) OVER (PARTITION BY body) END AS refers_to
      FROM (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages))
"""

_RULES_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, grams) AS seen
  FROM (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS grams
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM texts WHERE len(w) >= 8))),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM windows WHERE seen > 1) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
facts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines
  FROM texts LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)),
judged AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM facts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT 10 * n_symbols > n_words
       AND NOT (n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines)
       AND NOT word_chars < 2 * n_words AND NOT word_chars > 20 * n_words AS kept
FROM judged
"""

_EMBEDDINGS_SQL = r"""
WITH RECURSIVE units AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM units a JOIN units b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a)
SELECT vec_id, (SELECT count(*) FROM pairs WHERE a = vec_id)::BIGINT AS n_links,
       min(b) AS component_id, vec_id = min(b) AS kept
FROM embeddings JOIN reach ON reach.a = vec_id GROUP BY vec_id
"""


_NEGATIVES_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS c
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same,
         list_sum(list_transform(list_zip(a.c, b.c), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id,
       row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b)::INTEGER AS rank,
       n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""

_SEARCH_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
i AS (
  SELECT item_id, unnest(list_distinct(
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
total AS (SELECT count(*)::BIGINT AS docs, sum(len(words))::BIGINT AS terms FROM d WHERE len(words) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) GROUP BY r, term),
w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
gain AS (
  SELECT tf.r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(words) * docs) // terms))) AS g
  FROM tf JOIN w USING (term) JOIN d ON d.r = tf.r, total)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(g)::BIGINT AS score FROM i JOIN gain USING (term) GROUP BY item_id, r)
WHERE score > 0 QUALIFY rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": _WARC_SQL, "op5_embeddings": _EMBEDDINGS_SQL, "op6_rules": _RULES_SQL,
            "op11_negatives": _NEGATIVES_SQL, "op13_search": _SEARCH_SQL}
