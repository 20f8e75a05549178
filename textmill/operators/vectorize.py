"""Bags of words: vocabularies, counts, TF-IDF and keywords in long form (doc, term, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def term_counts(df: DataFrame, key: str, terms: Column, binary: bool = False) -> DataFrame:
    """Rows (key, term, tf)."""
    at = df.select(key, F.explode(terms).alias("term"))
    counts = at.groupBy(key, "term").agg(F.count("*").alias("tf"))
    return counts.withColumn("tf", F.lit(1).cast("long")) if binary else counts


def vocabulary(counts: DataFrame, n_docs: Column, min_df: int | float = 1, max_df: int | float = 1.0, most: int | None = None) -> DataFrame:
    """Rows (term, df, total, id): terms within the document-frequency bounds, the commonest
    ``most`` of them, numbered alphabetically.  Shares of documents are cut to whole numbers.
    """
    stats = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    low = F.lit(min_df) if isinstance(min_df, int) else F.floor(n_docs * min_df)
    high = F.lit(max_df) if isinstance(max_df, int) else F.floor(n_docs * max_df)
    kept = stats.where((F.col("df") >= low) & (F.col("df") <= high))
    if most is not None:
        kept = kept.orderBy(F.col("total").desc(), "term").limit(most)
    return kept.withColumn("id", F.row_number().over(Window.orderBy("term")) - 1) if most is not None else kept


def tf_idf(counts: DataFrame, vocab: DataFrame, n_docs: Column, key: str, smooth: bool = True, sublinear: bool = False, norm: str | None = "l2") -> DataFrame:
    """Rows (key, term, weight); idf is ln((1 + n) / (1 + df)) + 1, or unsmoothed ln(n / df) + 1."""
    idf = F.log((1 + n_docs) / (1 + F.col("df"))) + 1 if smooth else F.log(n_docs / F.greatest(F.col("df"), F.lit(1))) + 1
    tf = 1 + F.log(F.col("tf").cast("double")) if sublinear else F.col("tf")
    raw = counts.join(vocab.select("term", "df"), "term").select(key, "term", (tf * idf).alias("w"))
    if norm is None:
        return raw.withColumnRenamed("w", "weight")
    size = raw.groupBy(key).agg((F.sqrt(F.sum(F.col("w") * F.col("w"))) if norm == "l2" else F.sum(F.abs("w"))).alias("size"))
    return raw.join(size, key).select(key, "term", (F.col("w") / F.greatest("size", F.lit(1e-12))).alias("weight"))


def hashed(counts: DataFrame, key: str, n: int, signed: bool = True) -> DataFrame:
    """Rows (key, cell, value) by hashing; the sign is another bit of the same hash."""
    h = F.xxhash64("term")
    sign = F.when(signed & (F.shiftright(h, 62).bitwiseAND(1) == 1), -1).otherwise(1) if signed else F.lit(1)
    return counts.select(key, F.pmod(h, F.lit(n)).alias("cell"), (sign * F.col("tf")).alias("v")).groupBy(key, "cell").agg(F.sum("v").alias("value"))


def keywords(df: DataFrame, cluster: str, terms: Column, k: int) -> DataFrame:
    """The k commonest terms of every cluster, noise (-1) left out."""
    at = df.where(F.col(cluster) != -1).select(cluster, F.explode(terms).alias("term")).groupBy(cluster, "term").agg(F.count("*").alias("n"))
    return at.withColumn("rank", F.row_number().over(Window.partitionBy(cluster).orderBy(F.col("n").desc(), "term"))).where(F.col("rank") <= k)


def dict_vectorize(df: DataFrame, key: str, entries: Column, separator: str = "=") -> DataFrame:
    """Rows (key, feature, value) of a map of strings: numerals add up, others become indicators."""
    at = df.select(key, F.explode(entries).alias("k", "v"))
    number = F.col("v").try_cast("double")
    feature = F.when(number.isNotNull(), F.col("k")).otherwise(F.concat("k", F.lit(separator), "v"))
    return at.where("v is not null").select(key, feature.alias("feature"), F.coalesce(number, F.lit(1.0)).alias("value")).groupBy(key, "feature").agg(F.sum("value").alias("value"))
