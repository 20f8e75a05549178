"""The thin opN queries over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, language_id, line_dedup, lm_score, media, mixing, quality, toxicity, url_filter
from .common import fold, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold("doc_id", 3) == 1).alias("held_out"))
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.identify(docs, model, ["doc_id", "held_out"])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    model = quality.fit(docs, labels)
    return quality.score(docs, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 4) == 2).alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2)
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS)
    return mixed.select("doc_id", "source", "mix_position", "mix_phase", "mix_block")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, min_tokens=1)
    return out.select("doc_id", "n_lines", "n_dropped", "n_left", F.sha2(F.col("text"), 256).alias("text_sha256"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.CONTRACT_RULES, ["page_id"]).drop("blame")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, benchmark, ["doc_id"]).drop("items")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 5) == 1).alias("held_out"))
    model = lm_score.fit(docs.where(~F.col("held_out")))
    return lm_score.score(docs, model, ["doc_id", "held_out"])


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"), ["doc_id"])


#: Target weights of the production mixture; sources that aren't named weigh 1.
MIX_WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 2.0, "src3": 0.5}

_QUERIES = (
    op1_language_id, op2_quality, op3_mixing, op4_line_dedup, op5_url_filter, op6_decontamination,
    op7_jaccard_join, op8_lm_score, op9_media, op10_toxicity,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_url_filter": url_filter.judge_sql(url_filter.CONTRACT_RULES),
        "op6_decontamination": decontaminate.SQL,
    }
