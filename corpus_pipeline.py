"""A training-data pipeline over ``documents``: five stages, each written and read again before the next.

1. quality_classifier: documents that co-training holds to be of low quality or toxic go;
2. near_dedup: one document of each near-duplicate class stays;
3. decontamination: documents with a passage of the benchmark go;
4. secret_scan: secrets in the texts are replaced by a mark;
5. byte_bpe: texts become token ids, decoded again as proof.

All but the last return the columns of documents. Null and empty texts pass all stages (they have no words, hits, secrets or
ids), rows with null ids are rows like any other, null columns are values, very long texts count whole, repeated rows and rows of equal words are one
class of which one row stays, ties go to the least id, then the least text, extra columns come back as they were from every
stage but the last whatever their names, and an empty table gives an empty one. The first stage is a trained model, so SQL cannot express
the rows of ``run``; tests hold each stage against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bagminhash, byte_bpe, cotraining, decontaminate, secrets
from quern.plans.shared import stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cotraining.kept(docs, *(spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in ("labels", "pages")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def byte_bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    got = byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return got.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_classifier", quality_classifier), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("byte_bpe", byte_bpe_ids)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
