"""A cleaned and mixed corpus from ``documents``: five stages, each on all that the one before kept.

quality -> line_dedup -> near_copies -> decontamination -> mix. Every stage takes ``(spark, docs, sf_dir)``; its
result is written as Parquet and read again as the next one's ``docs``. All but the last return the columns of
``documents``; the last returns the mix, one row per copy of a document, with ``copy`` from 1.

The stages keep their operators' defined cases: rows without words go with the first stage, a document whose lines
all repeat earlier ones with the second, null ids are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sentinelweave.llm.common import scratch_path
from sentinelweave.llm.decontamination import without_leaks
from sentinelweave.llm.line_dedup import without_repeats
from sentinelweave.llm.mixing import mixed_copies
from sentinelweave.llm.near_copies import one_per_group
from sentinelweave.llm.quality import good_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return good_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match earlier lines; ``n_chars`` follows the text."""
    out = without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies: five-word shingles, similarity 0.8."""
    return one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights: every document as many times as the mix takes it."""
    return mixed_copies(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("mix", mix),
]
#: Learnt scores and verified joins of whole texts have no SQL twin; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
        # Spark deletes shuffles and broadcasts once the driver's JVM finds their handles unused, which it seldom looks for.
        spark.sparkContext._jvm.System.gc()
    return STAGES[-1][1](spark, docs, sf_dir)
