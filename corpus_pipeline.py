"""From documents to a training corpus: language, near copies, benchmark leaks, mixture, shards.

Every stage takes the documents that its predecessor kept, with all their columns, and its decision
takes effect on the rows that it returns. Between the stages the documents are written as Parquet,
so a lost executor costs no more than the stage that runs.

Defined results: an empty table gives no rows; null, blank and letterless texts go with the first stage,
whose language cannot be told; rows that share a doc_id, or have none, are compared by their texts, and equal
rows are one from the second stage on; very long texts are read whole in every stage; other columns are kept,
but for shard and slot, which the last stage names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import decontaminate, langid, mixing, near_dedup, sharding
from lexweave.llm.common import held_out, shared_folder, table

SHARDS = 24


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart clearly; those without a letter or with a narrow margin go."""
    model = langid.learn(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return docs.where(~langid.rejection(docs["text"], model))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id."""
    return near_dedup.representatives(docs, k=5, percent=80)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), least=1)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, whole or in part, until their sources have the target weights."""
    return mixing.materialised(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its place there."""
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    placed = sharding.assign(docs, shards=SHARDS, keep=tuple(c for c in columns if c != "doc_id"))
    return placed.select(*columns, "shard", "slot")


STAGES = [
    ("language_id", identified),
    ("near_dedup", distinct),
    ("decontamination", uncontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs


#: Language models and near-copy joins have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
