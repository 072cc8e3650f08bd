"""The corpus pipeline over ``documents``: five stages, each over all that the one before kept.

Toxic documents go; of near-duplicates one document stays; documents that hold a benchmark
passage go; personal data is replaced by its kind; the texts that are left are encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakframe.llm.common import give_back
from cloakframe.llm.decontam import decontaminate
from cloakframe.llm.pii import redact
from cloakframe.llm.sentencepiece_nbest import encode_texts
from cloakframe.llm.simhash import keep_one
from cloakframe.llm.toxicity import drop_toxic
from cloakframe.operators.graph import cut, trim_driver


def short_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch than by default: texts may be long, and a batch stands in the JVM and in Python at once."""
    if int(spark.conf.get(BATCH)) > ROWS:
        spark.conf.set(BATCH, ROWS)


def begin(spark: SparkSession) -> None:
    """Before a stage: short batches, and a driver without what the stages before left in its memory (plans, references to
    shuffles that nothing needs, freed native memory)."""
    short_batches(spark)
    give_back()
    spark._jvm.java.lang.System.gc()
    trim_driver(spark)


BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    begin(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    begin(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    begin(spark)
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    begin(spark)
    return redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    begin(spark)
    return encode_texts(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]
#: The stages can't be put into SQL; tests/llm/test_pipeline.py holds them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)  # later stages read their input more than once
    return docs
