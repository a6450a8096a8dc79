"""From raw documents to packed training sequences, in stages of the operators in saldo.llm.

Each stage reads what the one before it kept, as Parquet, and all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from saldo.llm import jaccard_join, language_id, packing, pii, quality_rules
from saldo.session import new_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Rows that go to Python at once. Documents are large rows, and workers keep the memory of their largest batch.
BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def language_identification(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language cannot be told: without a letter, or with a narrow margin."""
    small_batches(spark)
    model = language_id.fit(docs)
    verdict = language_id.prediction(model)
    return docs.select(*COLUMNS).withColumn("_verdict", verdict).where("NOT _verdict.rejected").drop("_verdict")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that fail the base rules or are outliers of their language and source."""
    small_batches(spark)
    return quality_rules.keep_sound(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of linked documents the one with the smallest doc_id; all without an id or a shingle."""
    small_batches(spark)
    return jaccard_join.first_of_each(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts marks in place of personal data; n_chars follows."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    return pii.redact(docs, pii.fit(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    small_batches(spark)
    return packing.packed(docs)


STAGES = [
    ("language_identification", language_identification),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Compression, robust estimates and boosted trees have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
