"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprint, langid, mixing, near_dedup, pii, quality, secret_scan, sharding, toxicity
from .common import held_out, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.classify(documents.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.learn_and_identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", held_out(found["doc_id"]).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    likely = secret_scan.transitions(documents)
    return secret_scan.scan(documents, secret_scan.fit(secret_scan.findings(spark), likely), likely)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.cluster(table(spark, sf_dir, "documents"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=1)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op3_language_id": op3_language_id,
    "op4_secret_scan": op4_secret_scan,
    "op5_near_dedup": op5_near_dedup,
    "op6_fingerprint": op6_fingerprint,
    "op7_sharding": op7_sharding,
    "op8_decontamination": op8_decontamination,
    "op9_pii": op9_pii,
    "op10_quality": op10_quality,
}

OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap,
    1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM sources
), levels AS (  -- the water level, were all sources with a lower cap a weight full
  SELECT a.source, a.cap, a.weight,
    (a.budget - coalesce(sum(b.cap) FILTER (WHERE b.cap / b.weight < a.cap / a.weight), 0.0))
      / sum(b.weight) FILTER (WHERE b.cap / b.weight >= a.cap / a.weight) AS level
  FROM weighed a, weighed b GROUP BY a.source, a.cap, a.weight, a.budget
), targets AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM levels WHERE cap >= level * weight ORDER BY cap / weight LIMIT 1), 'infinity'::DOUBLE) * weight) AS target
  FROM weighed
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole, floor(target + 1e-6)::BIGINT AS words FROM targets
), ordered AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('5:' || coalesce(doc_id || ':', '') || size)[1:15], doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized
)
SELECT o.doc_id, o.size::BIGINT AS size, p.source_size, p.target,
  (p.whole * o.size + greatest(0, least(o.size, p.words - p.whole * p.source_size - o.before)))::BIGINT AS taken
FROM ordered o JOIN plan p ON o.source IS NOT DISTINCT FROM p.source
"""

#: Learnt models, iterations and the ring have no SQL twin; tests hold them against brute force or held-out labels.
ORACLES: dict[str, str] = {"op2_mixing": OP2_SQL}
