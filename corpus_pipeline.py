"""Corpus pipeline: quality filter, line dedup, near-dedup, decontamination, piece encoding.

Each stage takes all that the one before it kept, as the columns of ``documents``, and is written
as Parquet to the shared folder before the next reads it. Null and empty texts pass through the
stages under the rules that their operators state; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doorstep.llm.common import shipped, small_batches, staged, table
from doorstep.llm.decontam import decontamination_stage
from doorstep.llm.lines import line_dedup_stage
from doorstep.llm.neardup import neardup_stage
from doorstep.llm.pieces import encoded, model_path
from doorstep.llm.quality import quality_stage


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its ids and the text decoded from them."""
    return encoded(docs, model_path()).withColumn("exact", F.col("decoded") == F.coalesce("text", F.lit("")))


def _shipping(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shipped(spark)
        small_batches(spark)
        return stage(spark, docs, sf_dir)
    return run


STAGES = [
    ("quality_classifier", _shipping(quality_stage)),
    ("line_dedup", _shipping(line_dedup_stage)),
    ("minhash_neardup", _shipping(neardup_stage)),
    ("benchmark_decontamination", _shipping(decontamination_stage)),
    ("sentencepiece", _shipping(encoding_stage)),
]

#: A classifier's scores and consistent samples are no matter of SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir).select(
        "doc_id", "lang", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "exact")
