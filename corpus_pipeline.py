"""From raw documents to a training mix: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from smilegrid.llm import decontaminate, minhash, mixing, quality, secrets
from smilegrid.llm.words import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return minhash.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redact_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to meet the targets, with their weights; columns of the documents with the new ones' names are replaced."""
    rows = mixing.mix_sources(docs).where("mix_kept")
    new = {"topic": F.col("mix_topic"), "n_tokens": F.col("mix_tokens")} | {c: F.round(f"mix_{c}", 6) for c in ("weight", "prob", "repeat")}
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new], *[v.alias(c) for c, v in new.items()])


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("benchmark", benchmark_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
]

#: A fitted classifier and hashed sampling can't be said in SQL: a test holds what each stage of the chain writes against a plain version
#: over all that the stage before kept (the classifier's fitted model is given to both).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
