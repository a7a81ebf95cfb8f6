"""A corpus from raw documents to token files: five stages, each over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from daymosaic.llm import decontam, mixing, nearcopies, tokenout, toxicity
from daymosaic.llm.common import stored


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier rejects; it learns from `labels`."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: SimHash candidates with at least 0.8 of their five-word shingles in common."""
    return nearcopies.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold any window of `benchmark`."""
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and select documents so that sources reach their targets."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token files, read them back: doc_id, start, n_tokens, ids_crc32 of each document of the mix."""
    # Executors still hold what earlier stages made them take, so workers remember less than op2's.
    return tokenout.token_output(docs, tokenout.default_tokenizer(), remember=100_000)


STAGES = [
    ("toxicity", toxic),
    ("simhash", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mixture),
    ("tokens", tokens),
]
#: SQL expresses neither the first nor the second nor the last stage; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
