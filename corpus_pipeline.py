"""The training-corpus pipeline: quality, line dedup, near duplicates, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last
return the columns that they got.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import decontaminate, jaccard_join, line_dedup, mixing, quality
from textmill.llm.common import fold, table
from textmill.llm.queries import MIX_WEIGHTS
from textmill.session import ensure_checkpoint_dir


def judged(docs: DataFrame, judge: Callable[[DataFrame, list[str], str], DataFrame], verdict: Column) -> DataFrame:
    """The rows of ``docs`` for which ``judge(rows, columns, text)`` gives the verdict; columns have other names meanwhile."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    out = judge(docs.toDF(*names), names, names[docs.columns.index("text")]).where(verdict)
    return out.select(*names).toDF(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more; it learns from ``documents``, as in op2, whatever ``docs`` are."""
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    model = quality.fit(table(spark, sf_dir, "documents"), labels)
    return judged(docs, lambda rows, keep, text: quality.score(rows, model, keep, text), F.col("score") >= 0.3)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates; those of which only blank lines are left go."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    key, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    out = line_dedup.dedup_lines(docs.toDF(*names), key, text).where("n_dropped = 0 OR n_left > 0")
    if "n_chars" in docs.columns:
        size = names[docs.columns.index("n_chars")]
        out = out.withColumn(size, F.when(F.col("n_dropped") > 0, F.length(text)).otherwise(F.col(size)).cast(docs.schema["n_chars"].dataType))
    return out.select(*names).toDF(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by similar shingle sets."""
    return jaccard_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    benchmark = table(spark, sf_dir, "benchmark")
    return judged(docs, lambda rows, keep, text: decontaminate.contamination(rows, benchmark, keep, text), ~F.col("contaminated"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their positions in the mixture of sources."""
    return mixing.mix(docs, MIX_WEIGHTS)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: A learned classifier and a template tree have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written in the checkpoint folder and read again.

    A stage's folder goes once the next one is written; the last one's stays, for the result is read from it.
    """
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            files.delete(path(f"{folder}/{before}"), True)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
