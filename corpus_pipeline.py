"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes what its predecessor wrote, whole; its decisions take effect, and all but the last return the columns
of ``documents``:

1. quality classifier: documents outside the trusted perplexity quantiles of their language go;
2. n-gram Jaccard join (five words, 0.8): one document of each group of near duplicates stays;
3. benchmark decontamination: documents that hold a benchmark item go;
4. secret scan: secret values are replaced in the texts;
5. packing: the texts' token ids in sequences, a row each, with the documents whose pieces they hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ctxspark.llm.common import scratch, table
from ctxspark.llm.decontaminate import without_leaks
from ctxspark.llm.jaccard import keep_one_per_group
from ctxspark.llm.packing import pack, sequences
from ctxspark.llm.quality import reject_low_quality
from ctxspark.llm.secret_scan import redact
from ctxspark.llm.tokens import default_vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_low_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_per_group(docs, k=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sequences(pack(docs, default_vocabulary(), end_id=1, capacity=2048))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: Perplexities, latent spaces and tokenizers have no SQL twin; tests hold the stages against plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``; each result is stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
