"""A training-data pipeline: each stage reads all that the one before kept, written as Parquet between them.

Toxic documents go, one document of each near-duplicate group stays, strings that repeat across
or within documents are taken out, documents holding benchmark passages go, and the rest is
packed into token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm import decontaminate, packing, similar, suffix, toxicity
from stemma.llm.queries import tokenizer_path
from stemma.storage import stored, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.strip(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", toxic), ("simhash_dedup", near_duplicates), ("suffix_dedup", repeated_strings), ("decontamination", benchmark_passages), ("packing", packed)]

#: The classifier, fingerprints and tokenizer are beyond SQL; tests hold the stages' operators, not yet run() as a whole, against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return stored(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
