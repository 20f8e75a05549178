"""Profiles, counts and classification metrics, each one lazy aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from .ranking import sum_before


def count_by(df: DataFrame, column: str, null: str = "__null__") -> DataFrame:
    """Rows of each trimmed value, nulls under a name of their own."""
    return df.groupBy(F.coalesce(F.trim(F.col(column)), F.lit(null)).alias(column)).agg(F.count("*").alias("n"))


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each column: nulls (NaN among them), range and mean, distinct strings."""
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for c in columns:
        number = isinstance(types[c], T.NumericType)
        missing = F.col(c).isNull() | (F.isnan(c) if isinstance(types[c], (T.DoubleType, T.FloatType)) else F.lit(False))
        value = F.when(~missing, F.col(c).cast("double")) if number else F.lit(None).cast("double")
        parts.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count_if(missing).alias("null_count"),
                F.min(value).alias("min"),
                F.max(value).alias("max"),
                F.round(F.avg(value), 6).alias("mean"),
                (F.lit(None).cast("long") if number else F.count_distinct(F.col(c))).alias("n_unique"),
            )
        )
    wide = df.agg(F.count("*").alias("n"), F.array(*parts).alias("p"))
    return wide.select("n", F.explode("p").alias("p")).select("p.*", F.round(F.try_divide("p.null_count", "n"), 6).alias("null_rate"))


def length_profile(df: DataFrame, text: str) -> DataFrame:
    """Character and word lengths: range, mean, sample deviation, linear quantiles, empties."""
    t = F.coalesce(F.col(text), F.lit(""))
    lengths = df.select(F.length(t).alias("c"), F.size(tx.words(t)).alias("w"))
    q = F.percentile("c", F.array(*(F.lit(x) for x in (0.5, 0.9, 0.95, 0.99))))
    return lengths.agg(
        F.min("c").alias("char_min"), F.max("c").alias("char_max"), F.round(F.avg("c"), 6).alias("char_mean"),
        F.round(F.stddev_samp("c"), 6).alias("char_std"), q.alias("q"), F.round(F.avg("w"), 6).alias("word_mean"),
        F.max("w").cast("long").alias("word_max"), F.count_if(F.col("c") == 0).alias("n_empty"),
    ).select("*", *(F.round(F.col("q")[i], 6).alias(f"char_p{p}") for i, p in enumerate((50, 90, 95, 99)))).drop("q")


def duplicate_rate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """1 - distinct / rows over the columns joined by NUL."""
    key = F.concat_ws("\x00", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return df.agg(F.count("*").alias("n"), F.round(1 - F.try_divide(F.count_distinct(key), F.count("*")), 6).alias("rate"))


def confusion(df: DataFrame, truth: str, predicted: str, classes: int) -> DataFrame:
    """All cells (truth, predicted, n), zeros too."""
    side = df.sparkSession.range(classes)
    grid = side.select(F.col("id").cast("int").alias(truth)).crossJoin(side.select(F.col("id").cast("int").alias(predicted)))
    cells = df.groupBy(F.col(truth).cast("int").alias(truth), F.col(predicted).cast("int").alias(predicted)).agg(F.count("*").alias("n"))
    return grid.join(cells, [truth, predicted], "left").select(truth, predicted, F.coalesce("n", F.lit(0)).alias("n"))


def metric_bundle(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy, balanced accuracy, MCC, kappa, Hamming loss, and precision, recall, F1 and
    Jaccard as macro, micro and weighted means over the labels of either column.

    One aggregation to confusion cells; all else works on these.  Divisions by zero give 0.
    """
    cells = df.groupBy(F.col(truth).alias("y"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    per = cells.select(F.explode(F.array_distinct(F.array("y", "p"))).alias("k"), "y", "p", "n").groupBy("k").agg(
        F.sum(F.when((F.col("y") == F.col("k")) & (F.col("p") == F.col("k")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("y") == F.col("k"), F.col("n")).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("p") == F.col("k"), F.col("n")).otherwise(0)).alias("q"),
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    tp, t, q = F.col("tp"), F.col("t"), F.col("q")
    per = per.select(
        "*", ratio(tp, q).alias("precision"), ratio(tp, t).alias("recall"), ratio(2 * tp, t + q).alias("f1"), ratio(tp, t + q - tp).alias("jaccard")
    )
    names = ("precision", "recall", "f1", "jaccard")
    totals = per.agg(
        F.sum("tp").alias("tp"), F.sum("t").alias("n"), F.sum("q").alias("nq"), F.sum(t * q).alias("tq"), F.sum(t * t).alias("tt"), F.sum(q * q).alias("qq"),
        F.avg(F.when(t > 0, F.col("recall"))).alias("balanced_accuracy"),
        *(F.avg(m).alias(f"{m}_macro") for m in names),
        *(F.try_divide(F.sum(F.col(m) * t), F.sum(t)).alias(f"{m}_weighted") for m in names),
    )
    n, hit = F.col("n").cast("double"), F.col("tp").cast("double")
    accuracy = ratio(hit, n)
    chance = ratio(F.col("tq"), n * n)
    spread = F.sqrt((n * n - F.col("tt")) * (n * n - F.col("qq")))
    out = {
        "accuracy": accuracy, "balanced_accuracy": F.col("balanced_accuracy"), "hamming_loss": 1 - accuracy,
        "kappa": ratio(accuracy - chance, 1 - chance), "mcc": ratio(hit * n - F.col("tq"), spread),
        **{f"{m}_{k}": F.col(f"{m}_{k}") for m in names for k in ("macro", "weighted")},
        **{f"{m}_micro": accuracy for m in names[:3]}, "jaccard_micro": ratio(hit, 2 * n - hit),
    }
    return totals.select(F.col("n").cast("long").alias("n_samples"), *(F.round(e, 6).alias(k) for k, e in out.items()))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by rank sums with mean ranks of ties; null if a class is missing.

    Ties are combined before ranks are summed, and ranks come from ranges of the scores.
    """
    cells = df.groupBy(score).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    ranked = sum_before(cells, score, "n", "before").select("n", "pos", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))
    sums = ranked.agg(F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    p, q = F.col("p").cast("double"), F.col("q").cast("double")
    return sums.select(F.round(F.try_divide(F.col("r") - p * (p + 1) / 2, p * q), 6).alias("auc"), F.col("p").alias("n_pos"), F.col("q").alias("n_neg"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """1 / count for every id from 0 to the largest, 0 for absent ones."""
    counts = df.groupBy(F.col(label).cast("long").alias("id")).agg(F.count("*").alias("n"))
    ids = counts.agg(F.max("id").alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("id"))
    return ids.join(counts, "id", "left").select("id", F.coalesce(F.round(1 / F.col("n"), 9), F.lit(0.0)).alias("weight"))


def regression_fit(df: DataFrame, y: str, x: str) -> DataFrame:
    """Least squares of one feature."""
    return df.agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))
