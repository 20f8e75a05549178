"""Fit and transform of features as one lazy plan: statistics are scalars or small joined tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import nan_distance


def _stats(df: DataFrame, **exprs: Column) -> dict[str, Column]:
    """Aggregates over the whole table, as columns of one scalar struct."""
    s = df.agg(F.struct(*(e.alias(n) for n, e in exprs.items())).alias("s")).scalar()
    return {n: s[n] for n in exprs}


def _nonzero(c: Column) -> Column:
    return F.when(c == 0, F.lit(1.0)).otherwise(c)


def standard(df: DataFrame, column: str, name: str, with_mean: bool = True, with_std: bool = True) -> DataFrame:
    """Population standardisation; a deviation of 0 counts as 1."""
    s = _stats(df, m=F.avg(column), d=F.stddev_pop(column))
    x = F.col(column) - s["m"] if with_mean else F.col(column)
    return df.withColumn(name, x / _nonzero(s["d"]) if with_std else x)


def min_max(df: DataFrame, column: str, name: str, low: float = 0.0, high: float = 1.0, clip: bool = False) -> DataFrame:
    """Scaled to a range; a constant column gives ``low``."""
    s = _stats(df, lo=F.min(column).cast("double"), hi=F.max(column).cast("double"))
    x = (F.col(column) - s["lo"]) / _nonzero(s["hi"] - s["lo"]) * (high - low) + low
    return df.withColumn(name, F.greatest(F.lit(low), F.least(F.lit(high), x)) if clip else x)


def max_abs(df: DataFrame, column: str, name: str) -> DataFrame:
    s = _stats(df, m=F.max(F.abs(F.col(column).cast("double"))))
    return df.withColumn(name, F.col(column) / _nonzero(s["m"]))


def robust(df: DataFrame, column: str, name: str, low: float = 0.25, high: float = 0.75, unit_variance: bool = False) -> DataFrame:
    """Centred on the median and scaled by an exact quantile range; a range of 0 counts as 1."""
    s = _stats(df, q=F.percentile(column, F.array(F.lit(low), F.lit(0.5), F.lit(high))))
    spread = s["q"][2] - s["q"][0]
    spread = spread / 1.34898 if unit_variance else spread
    return df.withColumn(name, (F.col(column) - s["q"][1]) / _nonzero(spread))


def winsorise(df: DataFrame, column: str, name: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    s = _stats(df, q=F.percentile(column, F.array(F.lit(low), F.lit(high))))
    return df.withColumn(name, F.when(F.col(column).isNotNull(), F.greatest(s["q"][0], F.least(s["q"][1], F.col(column)))))


def binarize(c: Column, threshold: float = 0.0) -> Column:
    """1 at the threshold and above."""
    return F.when(c.isNotNull(), (c >= threshold).cast("int"))


def yeo_johnson(c: Column, lam: float) -> Column:
    """Power transform of a given exponent, all four branches."""
    up = F.log1p(c) if abs(lam) < 1e-12 else (F.pow(c + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-c) if abs(lam - 2) < 1e-12 else -(F.pow(1 - c, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(c >= 0, up).otherwise(down)


def quantile_uniform(df: DataFrame, column: str, name: str, n: int = 100) -> DataFrame:
    """Piecewise-linear position among ``n`` exact quantiles, 0 to 1."""
    grid = F.array(*(F.lit(i / (n - 1)) for i in range(n)))
    df = df.withColumn("__q", _stats(df, q=F.percentile(column, grid))["q"])
    q, x = F.col("__q"), F.col(column).cast("double")
    below = F.size(F.filter(q, lambda v: v <= x))
    lo, hi = F.get(q, below - 1), F.get(q, below)
    inside = (below - 1 + F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(0.0)) / (n - 1)
    return df.withColumn(name, F.when(below == 0, 0.0).when(below >= n, 1.0).otherwise(inside)).drop("__q")


def polynomial(columns: Sequence[str], interaction_only: bool = False, bias: bool = True) -> dict[str, Column]:
    """Degree-2 terms in graded lexicographic order."""
    out: dict[str, Column] = {"1": F.lit(1.0)} if bias else {}
    out |= {c: F.col(c).cast("double") for c in columns}
    for i, a in enumerate(columns):
        for b in columns[i + interaction_only :]:
            out[f"{a} {b}"] = F.col(a).cast("double") * F.col(b)
    return out


def impute(df: DataFrame, column: str, strategy: str = "mean", fill: float | None = None, indicator: bool = False) -> DataFrame:
    """Nulls filled by the mean, the lower median, the least mode or a constant; 0 for an empty column."""
    x = F.col(column)
    if strategy == "mean":
        value = _stats(df, v=F.avg(x))["v"]
    elif strategy == "median":
        value = _stats(df, v=F.percentile_disc(0.5, x) if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}`)"))["v"]
    elif strategy == "mode":
        value = df.where(x.isNotNull()).groupBy(column).agg(F.count("*").alias("n")).agg(F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias("v")).scalar()
    else:
        value = F.lit(fill)
    out = df.withColumn(f"{column}_missing", x.isNull().cast("int")) if indicator else df
    return out.withColumn(column, F.coalesce(x, value.cast("double"), F.lit(0.0)))


def missing_marks_to_null(c: Column) -> Column:
    """Strings that stand for missing values become null."""
    return F.when(~F.trim(c).isin("-999", "-9999", "999", "N/A", "NA", "n/a", ""), F.trim(c))


def ordinal_codes(df: DataFrame, column: str) -> DataFrame:
    """Codes from 0 in the values' order (a row for each value)."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    return values.select(column, (F.row_number().over(Window.orderBy(column)) - 1).alias("code"))


def ordinal(df: DataFrame, column: str, codes: DataFrame, unknown: int = -1) -> DataFrame:
    return df.join(codes, column, "left").withColumn("code", F.coalesce("code", F.lit(unknown)))


def frequent_categories(df: DataFrame, column: str, least: int = 1, most: int | None = None, other: str = "infrequent") -> DataFrame:
    """Rows (value, n, bucket): values seen ``least`` times, of these the ``most`` - 1 commonest."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    keep = F.col("n") >= least
    if most is not None:
        counts = counts.withColumn("__r", F.row_number().over(Window.orderBy(F.col("n").desc(), column)))
        keep = keep & (F.col("__r") <= most - 1)
    return counts.withColumn("bucket", F.when(keep, F.col(column)).otherwise(other)).drop("__r")


def one_hot(df: DataFrame, column: str, values: Sequence[str], drop_first: bool = False) -> DataFrame:
    """A 0/1 column for each value; unknown values have none."""
    shown = list(values)[1:] if drop_first else list(values)
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in shown})


def target_means(df: DataFrame, column: str, target: str, smooth: float | None = None) -> DataFrame:
    """Rows (value, n, encoding): class means drawn to the mean of all.

    The weight of that mean is ``smooth``, or by default n times the ratio of the variance of
    all to that within the class (n where the class has next to none).
    """
    s = _stats(df, m=F.avg(target), v=F.var_samp(target))
    by = df.groupBy(column).agg(F.count("*").alias("n"), F.avg(target).alias("m"), F.var_samp(target).alias("v"))
    auto = F.when(F.coalesce("v", F.lit(0.0)) < 1e-10, F.col("n").cast("double")).otherwise(F.col("n") * s["v"] / F.col("v"))
    weight = F.lit(smooth) if smooth is not None else auto
    return by.select(column, "n", ((F.col("n") * F.col("m") + weight * s["m"]) / (F.col("n") + weight)).alias("encoding"))


def bins_uniform(df: DataFrame, column: str, name: str, n: int) -> DataFrame:
    s = _stats(df, lo=F.min(column).cast("double"), hi=F.max(column).cast("double"))
    at = F.floor((F.col(column) - s["lo"]) / _nonzero((s["hi"] - s["lo"]) / n))
    return df.withColumn(name, F.greatest(F.lit(0), F.least(F.lit(n - 1), at)).cast("int"))


def bins_quantile(df: DataFrame, column: str, name: str, n: int) -> DataFrame:
    """Bins between exact quantiles; edges within 1e-8 of the one before are left out."""
    df = df.withColumn("__q", _stats(df, q=F.percentile(column, F.array(*(F.lit(i / n) for i in range(n + 1)))))["q"])
    q = F.col("__q")
    first = F.array(q[0])
    edges = F.aggregate(F.slice(q, 2, n), first, lambda acc, e: F.when(e - F.element_at(acc, -1) > 1e-8, F.concat(acc, F.array(e))).otherwise(acc))
    inner = F.when(F.size(edges) > 2, F.slice(edges, 2, F.size(edges) - 2)).otherwise(F.array().cast("array<double>"))
    return df.withColumn(name, F.size(F.filter(inner, lambda e: e <= F.col(column)))).drop("__q")


def merge_close(df: DataFrame, column: str, eps: float) -> DataFrame:
    """Rows (island, n, mean): runs of distinct sorted values with gaps of at most ``eps``."""
    values = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("c"))
    order = Window.orderBy(column)
    gap = F.coalesce((F.col(column) - F.lag(column).over(order) > eps).cast("int"), F.lit(0))
    island = F.sum("g").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return values.withColumn("g", gap).withColumn("island", island).groupBy("island").agg(F.sum("c").alias("n"), F.avg(column).alias("mean"))


def moments_long(df: DataFrame, vector: str) -> DataFrame:
    """Rows (pos, n, mean, var_pop) of every element of a vector column."""
    at = df.select(F.posexplode(vector).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    return at.groupBy("pos").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var_pop"))


def anova_f(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Rows (pos, f): between over within mean squares of every element by class."""
    at = df.select(label, F.posexplode(vector).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    by = at.groupBy("pos", label).agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    all_ = by.groupBy("pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.count("*").alias("k"))
    between = (F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1)
    within = (F.col("q") - F.col("b")) / (F.col("n") - F.col("k"))
    return all_.select("pos", (between / within).alias("f"))


def pearson(df: DataFrame, vector: str, target: str) -> DataFrame:
    at = df.select(F.col(target).cast("double").alias("y"), F.posexplode(vector).alias("pos", "x"))
    return at.groupBy("pos").agg(F.corr(F.col("x").cast("double"), "y").alias("r"))


def chi2(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Rows (pos, chi2) of non-negative elements against class shares."""
    at = df.select(label, F.posexplode(vector).alias("pos", "x")).withColumn("x", F.greatest(F.col("x").cast("double"), F.lit(0.0)))
    seen = at.groupBy("pos", label).agg(F.sum("x").alias("o"), F.count("*").alias("c"))
    by = Window.partitionBy("pos")
    expected = F.sum("o").over(by) * F.col("c") / F.sum("c").over(by)
    return seen.withColumn("e", expected).groupBy("pos").agg(F.sum((F.col("o") - F.col("e")) ** 2 / F.col("e")).alias("chi2"))


def select_top(scores: DataFrame, score: str, k: int) -> DataFrame:
    return scores.orderBy(F.col(score).desc_nulls_last(), "pos").limit(k)


def covariance(df: DataFrame, vector: str, width: int) -> DataFrame:
    """Rows (i, j, cov), i <= j: population covariances of the first ``width`` elements."""
    v = F.col(vector)
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    cells = [F.covar_pop(v[i].cast("double"), v[j].cast("double")) for i, j in pairs]
    wide = df.agg(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), c.alias("cov")) for (i, j), c in zip(pairs, cells))).alias("p"))
    return wide.select(F.explode("p").alias("p")).select("p.*")


def shrunk(cov: DataFrame, width: int, shrinkage: float = 0.1) -> DataFrame:
    """Convex mix of a covariance with the mean variance on its diagonal."""
    mu = cov.where("i = j").agg((F.sum("cov") / width).alias("m")).scalar()
    return cov.withColumn("cov", (1 - shrinkage) * F.col("cov") + F.when(F.col("i") == F.col("j"), shrinkage * mu).otherwise(0.0))


def ordinal_encode(df: DataFrame, column: str, categories: DataFrame | None = None, unknown: float = -1.0, missing: float = float("nan"), name: str = "code") -> DataFrame:
    """Codes from 0 in the order of the categories (by default the table's own); null and unknown values have codes of their own."""
    codes = ordinal_codes(df if categories is None else categories, column).withColumnRenamed("code", "__c")
    code = F.when(F.col(column).isNull(), F.lit(missing)).otherwise(F.coalesce(F.col("__c").cast("double"), F.lit(unknown)))
    return df.join(codes, column, "left").withColumn(name, code).drop("__c")


def nan_distances(queries: DataFrame, points: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (query, key, distance, vector of the point) of a stated query set against all rows; missing places are left out."""
    q = queries.select(F.col(key).alias("query"), F.col(vector).alias("__q"))
    return points.select(key, vector).crossJoin(q).select("query", key, nan_distance(F.col("__q"), F.col(vector)).alias("distance"), vector)


def knn_impute(queries: DataFrame, points: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """Rows (query, pos, value): each missing place of a query is the mean over its ``k`` nearest rows, of those that have it.

    The nearest are taken among all rows, itself included at distance 0.  A place that none of them has stays missing.
    """
    near = nan_distances(queries, points, key, vector)
    ranked = near.withColumn("__r", F.row_number().over(Window.partitionBy("query").orderBy("distance", key))).where(F.col("__r") <= k)
    at = ranked.select("query", F.posexplode(vector).alias("pos", "x"))
    means = at.groupBy("query", "pos").agg(F.avg("x").alias("value"))
    gaps = queries.select(F.col(key).alias("query"), F.posexplode(vector).alias("pos", "x")).where("x is null").drop("x")
    return gaps.join(means, ["query", "pos"], "left")


def center_kernel(df: DataFrame, row: str, column: str, value: str, name: str = "centered") -> DataFrame:
    """A matrix in rows (row, column, value) less the means of its columns and rows, plus that of all."""
    rows = df.groupBy(row).agg(F.avg(value).alias("__rm"))
    columns = df.groupBy(column).agg(F.avg(value).alias("__cm"))
    mean = df.agg(F.avg(value).alias("m")).scalar()
    return df.join(rows, row).join(columns, column).withColumn(name, F.col(value) - F.col("__cm") - F.col("__rm") + mean).drop("__rm", "__cm")


def pca(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """Rows (key, reduced): the first ``k`` principal components, fitted over all rows; vectors must have one width."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("__v"))
    return PCA(k=k, inputCol="__v", outputCol="__p").fit(data).transform(data).select(key, vector_to_array("__p").alias("reduced"))


def spline_basis(c: Column, knots: Sequence[float], degree: int = 3) -> Column:
    """Values of all B-splines over uniform knots, padded by ``degree`` steps on both sides; x is clamped to the knots.

    The recursion over half-open intervals is spelled out as one expression, so nothing leaves the JVM.
    """
    step = knots[1] - knots[0]
    t = [knots[0] - step * i for i in range(degree, 0, -1)] + list(knots) + [knots[-1] + step * i for i in range(1, degree + 1)]
    x = F.least(F.greatest(c.cast("double"), F.lit(float(knots[0]))), F.lit(float(knots[-1]) - 1e-12))
    basis = [F.when((x >= a) & (x < b), 1.0).otherwise(0.0) for a, b in zip(t, t[1:])]
    for d in range(1, degree + 1):
        basis = [
            (x - t[i]) / (t[i + d] - t[i]) * basis[i] + (t[i + d + 1] - x) / (t[i + d + 1] - t[i + 1]) * basis[i + 1]
            for i in range(len(basis) - 1)
        ]
    return F.array(*basis)
