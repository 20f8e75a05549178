"""A fitted preparation of tables: fill, flag, scale and one-hot encode, kept as plain parameters that can be saved."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


@dataclass
class Preparation:
    """Fitted parameters; codes of categories are those of the fit, whatever table is transformed."""

    numbers: list[str]
    fill: dict[str, float]
    mean: dict[str, float]
    deviation: dict[str, float]
    flagged: list[str]
    categories: dict[str, list[str]]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds <number>_scaled, <number>_missing for numbers that had gaps in the fit, and <category>_<i>.

        Unknown and null categories give zeros in all columns; two categories give one column, of the second.
        """
        added: dict[str, Column] = {}
        for c in self.numbers:
            spread = self.deviation[c] or 1.0
            added[f"{c}_scaled"] = (F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(self.fill[c])) - self.mean[c]) / spread
        for c in self.flagged:
            added[f"{c}_missing"] = F.nanvl(F.col(c).cast("double"), F.lit(None)).isNull().cast("int")
        for c, values in self.categories.items():
            for i, v in enumerate(values):
                if len(values) != 2 or i == 1:
                    added[f"{c}_{i}"] = F.coalesce(F.col(c).cast("string") == F.lit(v), F.lit(False)).cast("int")
        return df.withColumns(added)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Preparation:
    return Preparation(**json.loads(spark.read.text(path).first()[0]))


def fit(df: DataFrame, numbers: Sequence[str], categories: Sequence[str], strategy: str = "median", widest: int = 10_000) -> Preparation:
    """Two aggregations for numbers and one for categories, which are sorted.

    The median is the lower one, by ranks to within a millionth.  Null and NaN are missing; a column without any value is filled with 0.  A category column of more
    than ``widest`` values is an error, since each becomes a column.
    """
    missing = [c for c in (*numbers, *categories) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    fill, mean, deviation, flagged = {}, {}, {}, []
    if numbers:
        x = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in numbers}
        center = (lambda c: F.percentile_approx(c, 0.5, 1_000_000)) if strategy == "median" else F.avg
        first = df.agg(*(center(x[c]).alias(f"f{i}") for i, c in enumerate(numbers)), *(F.count_if(x[c].isNull()).alias(f"n{i}") for i, c in enumerate(numbers))).first()
        fill = {c: float(first[f"f{i}"] or 0.0) for i, c in enumerate(numbers)}
        flagged = [c for i, c in enumerate(numbers) if first[f"n{i}"]]
        filled = {c: F.coalesce(x[c], F.lit(fill[c])) for c in numbers}
        second = df.agg(*(F.avg(filled[c]).alias(f"m{i}") for i, c in enumerate(numbers)), *(F.stddev_pop(filled[c]).alias(f"d{i}") for i, c in enumerate(numbers))).first()
        mean = {c: second[f"m{i}"] or 0.0 for i, c in enumerate(numbers)}
        deviation = {c: second[f"d{i}"] or 0.0 for i, c in enumerate(numbers)}
    values: dict[str, list[str]] = {}
    for c in categories:
        seen = [r[0] for r in df.select(F.col(c).cast("string").alias("v")).where("v is not null").distinct().orderBy("v").limit(widest + 1).collect()]
        if len(seen) > widest:
            raise ValueError(f"column {c!r} has more than {widest} categories")
        values[c] = seen
    return Preparation(list(numbers), fill, mean, deviation, flagged, values)


def load_or_fit(df: DataFrame, path: str, numbers: Sequence[str], categories: Sequence[str], strategy: str = "median") -> Preparation:
    """The preparation saved under ``path``; where there is none, one is fitted on ``df`` and saved."""
    spark = df.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return load(spark, path)
    made = fit(df, numbers, categories, strategy)
    made.save(spark, path)
    return made


def iterative_impute(df: DataFrame, columns: Sequence[str], rounds: int = 10, tolerance: float = 1e-3, ridge: float = 1e-6, low: float | None = None, high: float | None = None) -> DataFrame:
    """Missing numbers (null or NaN) predicted from the other columns by ridge regressions in turn.

    Gaps begin as means.  In each round the columns with gaps, those of fewest first, are fitted on the rows
    that have them and their gaps predicted, clamped to ``low`` and ``high``; rounds end when no filled value moves by
    more than ``tolerance`` times the largest observed value.  A fit is one aggregation of sums of products, as many as
    columns squared; rows never come to the driver.  Columns without any value become 0; an empty table stays empty.
    """
    ensure_checkpoint_dir(df.sparkSession)
    at = range(len(columns))
    names = [f"__x{i}" for i in at]
    x = [F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns]
    first = df.agg(*(F.avg(x[i]).alias(f"m{i}") for i in at), *(F.count_if(x[i].isNull()).alias(f"n{i}") for i in at), *(F.max(F.abs(x[i])).alias(f"a{i}") for i in at)).first()
    start = [first[f"m{i}"] or 0.0 for i in at]
    scale = max([first[f"a{i}"] or 0.0 for i in at] + [1e-10])
    order = sorted((i for i in at if first[f"n{i}"] and first[f"m{i}"] is not None), key=lambda i: (first[f"n{i}"], i))
    state = df.select("*", *(x[i].isNull().alias(f"__g{i}") for i in at), *(F.coalesce(x[i], F.lit(start[i])).alias(names[i]) for i in at)).checkpoint()
    for _ in range(rounds if len(columns) > 1 else 0):
        before = state.select("*", *(F.col(names[i]).alias(f"__b{i}") for i in order))
        for i in order:
            others = [j for j in at if j != i]
            model = _ridge(state.where(~F.col(f"__g{i}")), names, others, i, start, ridge)
            guess = F.lit(model[0])
            for j, w in zip(others, model[1]):
                guess = guess + F.lit(w) * (F.col(names[j]) - start[j])
            guess = guess if low is None else F.greatest(guess, F.lit(float(low)))
            guess = guess if high is None else F.least(guess, F.lit(float(high)))
            fill = F.when(F.col(f"__g{i}"), guess).otherwise(F.col(names[i]))
            before, state = before.withColumn(names[i], fill), state.withColumn(names[i], fill)
        before = before.checkpoint()
        moved = before.agg(*(F.max(F.abs(F.col(names[i]) - F.col(f"__b{i}"))).alias(f"d{i}") for i in order)).first() if order else None
        state = before.drop(*(f"__b{i}" for i in order))
        if moved is None or max((v or 0.0) for v in moved) <= tolerance * scale:
            break
    kept = {c: F.col(names[i]) for i, c in enumerate(columns)}
    return state.withColumns(kept).select(df.columns)


def _ridge(rows: DataFrame, names: Sequence[str], others: Sequence[int], target: int, shift: Sequence[float], ridge: float) -> tuple[float, list[float]]:
    """Intercept and weights over shifted columns, from sums of products alone."""
    used = [*others, target]
    z = [F.col(names[j]) - shift[j] for j in used]
    k = len(used)
    sums = rows.agg(
        F.count("*").alias("n"), *(F.coalesce(F.sum(z[a]), F.lit(0.0)).alias(f"s{a}") for a in range(k)),
        *(F.coalesce(F.sum(z[a] * z[b]), F.lit(0.0)).alias(f"p{a}_{b}") for a in range(k) for b in range(a, k)),
    ).first()
    n = max(1, sums["n"])
    mean = np.array([sums[f"s{a}"] for a in range(k)]) / n
    cov = np.array([[sums[f"p{min(a, b)}_{max(a, b)}"] for b in range(k)] for a in range(k)]) / n - np.outer(mean, mean)
    inner = cov[:-1, :-1]
    weight = np.linalg.solve(inner + (ridge * max(1e-12, np.trace(inner) / max(1, k - 1))) * np.eye(k - 1), cov[:-1, -1])
    return float(shift[target] + mean[-1] - weight @ mean[:-1]), [float(w) for w in weight]
