"""From raw documents to token ids: five stages, each a DataFrame that is written and read again.

1. documents the compression classifier rejects go;
2. lines of recurring templates go, every document stays;
3. one document of each near-duplicate class stays;
4. sources are mixed to their target weights, documents repeated up to three times;
5. texts become token ids, checked by decoding them.
Stages 1 to 4 keep the columns of documents. A stage that is written is never computed again, so a lost
executor costs tasks of the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echofold.llm import bpe, line_templates, mixing, near_dups, quality_classifier
from echofold.llm.common import fresh_dir, table


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.good_documents(docs, table(spark, sf_dir, "labels"))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shorter = line_templates.without_recurring_lines(docs)
    if "n_chars" not in docs.columns:
        return shorter
    return shorter.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dups.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, keep_ids=True)


STAGES = [
    ("quality_classifier", reject_low_quality),
    ("line_dedup", drop_recurring_lines),
    ("near_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

#: Stages 1, 3 and 5 are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage: doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
