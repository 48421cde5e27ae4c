"""Queries of the training-data operators, with production parameters, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, classlm, decontaminate, flac, langid, licenses, mixing, repair, simhash, toxicity, urls, whitening
from .common import is_fold, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: A text is rejected as toxic from this score on.
TOXIC = 0.3


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.samples(docs, ~is_fold("doc_id", 4, 2))
    return langid.identify(docs, model).select("doc_id", is_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "entropy")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.blocks(table(spark, sf_dir, "conversations"))
    model = chat.fit(found.filter(~is_fold("conv_id", 4, 2)))
    parsed = chat.rendered(chat.roles(found, model))
    return parsed.select("conv_id", "turn", "block", is_fold("conv_id", 4, 2).alias("held_out"), "role_pred", "opens", "rendered")


def op3_classlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, vocabulary = classlm.train(docs, ~is_fold("doc_id", 10, 0))
    scored = classlm.score(docs, model, vocabulary)
    return scored.select("doc_id", is_fold("doc_id", 10, 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), path, pattern))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"), ~is_fold("doc_id", 4, 2))
    scored = toxicity.scores(docs, machine)
    return scored.select("doc_id", is_fold("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op8_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digests(flac.decode_column(flac.encode_column(table(spark, sf_dir, "documents"))))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(docs))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(repair.damaged(table(spark, sf_dir, "conversations")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _digest(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', 'mix', {', '.join(f"coalesce(CAST({p} AS VARCHAR), '')" for p in parts)})), 1, 12) AS BIGINT)"


#: All quotients are listed and ranked; documents stand and give words as in the operator.
MIXING = f"""WITH counted AS (
    SELECT doc_id, source, size, count(*) AS copies FROM (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents) GROUP BY ALL),
  totals AS (SELECT source, CAST(sum(size * copies) AS BIGINT) AS source_size, CAST(sum(copies) AS BIGINT) AS docs FROM counted GROUP BY source),
  placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM totals),
  weighed AS (SELECT *, (place - 1) % 3 + 1 AS weight, 3 * source_size AS bound, sum(source_size) OVER () AS t FROM placed),
  filled AS (SELECT *, sum(weight) OVER () AS w, coalesce(sum(bound) OVER b, 0) AS cut_bound, coalesce(sum(weight) OVER b, 0) AS cut_weight FROM weighed WINDOW b AS (ORDER BY bound / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  level AS (SELECT CAST(max(t) - coalesce(sum(bound) FILTER (bound * (w - cut_weight) < weight * (t - cut_bound)), 0) AS DOUBLE) AS open_words, CAST(max(w) - coalesce(sum(weight) FILTER (bound * (w - cut_weight) < weight * (t - cut_bound)), 0) AS DOUBLE) AS open_weight FROM filled),
  aimed AS (SELECT source, place, docs, source_size, least(CAST(bound AS DOUBLE), weight * open_words / open_weight) AS target FROM filled, level),
  blocks AS (SELECT CAST(round(sum(target) / 32) AS BIGINT) AS n FROM aimed),
  source_quotas AS (SELECT place, count(*) AS quota FROM (
    SELECT place, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, place, k) AS r FROM (SELECT place, target, unnest(range(0, n)) AS k FROM aimed, blocks) WHERE target > 0), blocks WHERE r <= n GROUP BY place),
  dealt AS (SELECT c.*, a.place, a.source_size, a.target, {_digest("a.place", "c.doc_id")} % CAST(ceil(a.docs / 4096) AS BIGINT) AS shard FROM counted c JOIN aimed a ON c.source IS NOT DISTINCT FROM a.source),
  shards AS (SELECT d.place, shard, CAST(sum(size * copies) AS BIGINT) AS shard_size, any_value(coalesce(q.quota, 0)) AS source_quota FROM dealt d LEFT JOIN source_quotas q ON d.place = q.place GROUP BY d.place, shard),
  won AS (SELECT place, shard, count(*) AS quota FROM (
    SELECT place, shard, source_quota, row_number() OVER (PARTITION BY place ORDER BY shard_size / (2 * k + 1) DESC, shard, k) AS r FROM (SELECT *, unnest(range(0, source_quota)) AS k FROM shards) WHERE shard_size > 0) WHERE r <= source_quota GROUP BY place, shard),
  quotas AS (SELECT s.place, s.shard, s.shard_size, least(coalesce(w.quota, 0), s.shard_size * 3 // 32) * 32 AS words,
    CASE WHEN s.shard_size > 0 THEN {_digest("s.place", "s.shard", "'start'")} % greatest(CAST(ceil(s.shard_size / 32) AS BIGINT), 1) * 32 % s.shard_size ELSE 0 END AS start FROM shards s LEFT JOIN won w ON s.place = w.place AND s.shard = w.shard),
  stood AS (SELECT d.*, q.shard_size, q.words, q.start, coalesce(sum(size * copies) OVER (PARTITION BY d.place, d.shard ORDER BY {_digest("d.doc_id", "'order'")}, d.doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM dealt d JOIN quotas q ON d.place = q.place AND d.shard = q.shard),
  each AS (SELECT doc_id, size, source_size, target, shard_size, start, before + copy * size AS a, CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END AS rounds, CASE WHEN shard_size > 0 THEN words % shard_size ELSE 0 END AS over
    FROM (SELECT *, unnest(range(0, copies)) AS copy FROM stood))
  SELECT doc_id, size, source_size, target,
    CAST(rounds * size + greatest(least(a + size, least(start + over, shard_size)) - greatest(a, start), 0) + greatest(least(a + size, start + over - shard_size) - greatest(a, 0), 0) AS BIGINT) AS taken FROM each"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_langid, op2_chat, op3_classlm, op4_bpe, op5_decontaminate, op6_toxicity, op7_urls, op8_flac, op9_licenses, op10_simhash, op11_repair, op12_whitening, op13_mixing)}
ORACLE_SQL: dict[str, str] = {"op13_mixing": MIXING}
