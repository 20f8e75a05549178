"""Row numbers, ranks, top-k, folds and samples without a single-task sort."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bytes read for a range, and the most ranges that are cut.
RANGE_BYTES, MOST_RANGES = 64 << 20, 16_384


def _ranges(df: DataFrame) -> int:
    """Ranges for a table, by the planner's estimates of what it reads, which run nothing; 64 at least.

    Its estimate of a join is the product of both sides, so the leaves are added up instead.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(64, min(MOST_RANGES, size // RANGE_BYTES))


def _ranged(df: DataFrame, key: str, buckets: int | None) -> DataFrame:
    """Adds __b, the range of a numeric or time key between approximate quantiles; null keys are in -1.

    A value is placed among every ``step``-th cut first and then among the cuts from there, so a row
    looks at about twice the root of their number.
    """
    buckets = _ranges(df) if buckets is None else buckets
    step = max(1, math.isqrt(buckets))
    value = F.col(key).cast("double")
    shares = F.array(*(F.lit(i / buckets) for i in range(1, buckets)))
    cuts = F.coalesce(F.percentile_approx(value, shares, F.lit(max(1000, 16 * buckets))), F.array().cast("array<double>"))
    both = df.agg(cuts.alias("c")).select(F.struct("c", F.filter("c", lambda x, i: i % step == step - 1).alias("f")).alias("s")).scalar()
    passed = F.size(F.filter("__cuts.f", lambda c: c < value)) * step
    bucket = F.when(value.isNull(), -1).otherwise(passed + F.size(F.filter(F.slice("__cuts.c", passed + 1, F.lit(step)), lambda c: c < value)))
    return df.withColumn("__cuts", both).withColumn("__b", bucket).drop("__cuts")


def _before(totals: DataFrame, value: str) -> DataFrame:
    """Rows (__b, __before) of the sums of earlier ranges; there are few ranges."""
    before = F.coalesce(F.sum(value).over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return totals.select("__b", before.alias("__before"))


def row_index(df: DataFrame, key: str, ties: Sequence[str] = (), name: str = "row_index", buckets: int | None = None) -> DataFrame:
    """Adds positions from 0 in the order of a numeric or time key, then of ``ties``.

    Approximate quantiles of the key, one aggregation, cut the rows into ranges, more of them for a larger
    table; row numbers are taken within ranges and shifted by the counts of those before, of which
    there are ``buckets`` at most.  Rows with a null key come first.
    """
    cut = _ranged(df, key, buckets)
    shift = _before(cut.groupBy("__b").agg(F.count("*").alias("__n")), "__n")
    inside = Window.partitionBy("__b").orderBy(F.col(key).asc_nulls_first(), *ties)
    numbered = cut.withColumn("__rn", F.row_number().over(inside) - 1).join(F.broadcast(shift), "__b")
    return numbered.withColumn(name, (F.col("__before") + F.col("__rn")).cast("long")).drop("__b", "__rn", "__before")


def sum_before(df: DataFrame, key: str, value: str, name: str, buckets: int | None = None) -> DataFrame:
    """Adds the sum of a value over all rows of smaller key, by ranges as in ``row_index``; keys are distinct."""
    cut = _ranged(df, key, buckets)
    shift = _before(cut.groupBy("__b").agg(F.sum(value).alias("__n")), "__n")
    inside = Window.partitionBy("__b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(F.broadcast(shift), "__b")
    return summed.withColumn(name, F.col("__before") + F.col("__in")).drop("__b", "__in", "__before")


def with_count(df: DataFrame, name: str = "n_rows") -> DataFrame:
    """Adds the number of rows, as a scalar, not a window."""
    return df.withColumn(name, df.agg(F.count("*").alias("n")).scalar())


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark prunes to k in every task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def terciles(df: DataFrame, key: str, ties: Sequence[str], name: str = "tercile") -> DataFrame:
    """Equal-frequency thirds of ranks with the bounds of quantile cuts, not of NTILE."""
    ranked = with_count(row_index(df, key, ties, "__i"), "__n")
    last = F.col("__n") - 1
    return ranked.withColumn(
        name, F.when(F.col("__i") < F.ceil(last / 3), "negative").when(F.col("__i") < F.ceil(2 * last / 3), "neutral").otherwise("positive")
    ).drop("__i", "__n")


def kfold(df: DataFrame, key: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    """Contiguous folds; the first n mod k have one row more."""
    rows = with_count(row_index(df, key, ties, "__i"), "__n")
    small, extra = F.floor(F.col("__n") / k), F.col("__n") % k
    edge = extra * (small + 1)
    fold = F.when(F.col("__i") < edge, F.floor(F.col("__i") / (small + 1))).otherwise(extra + F.floor((F.col("__i") - edge) / F.greatest(small, F.lit(1))))
    return rows.withColumn("fold", fold.cast("int")).drop("__i", "__n")


def stratified_kfold(df: DataFrame, label: str, key: str, k: int) -> DataFrame:
    """Contiguous folds within each class; classes with more rows than a task should sort are for ``kfold`` of each."""
    by = Window.partitionBy(label)
    rows = df.withColumn("__i", F.row_number().over(by.orderBy(key)) - 1).withColumn("__n", F.count("*").over(by))
    small, extra = F.floor(F.col("__n") / k), F.col("__n") % k
    edge = extra * (small + 1)
    fold = F.when(F.col("__i") < edge, F.floor(F.col("__i") / (small + 1))).otherwise(extra + F.floor((F.col("__i") - edge) / F.greatest(small, F.lit(1))))
    return rows.withColumn("fold", fold.cast("int")).drop("__i", "__n")


def group_kfold(df: DataFrame, group: str, k: int) -> DataFrame:
    """Sorted distinct groups in contiguous runs, whatever their sizes."""
    groups = kfold(df.select(group).distinct(), group, k)
    return df.join(groups, group)


def time_series_split(df: DataFrame, key: str, splits: int, gap: int = 0, max_train: int | None = None, test_size: int | None = None) -> DataFrame:
    """Rows (split, part, row) of an expanding window; part is train or test."""
    rows = with_count(row_index(df, key, (), "__i"), "__n")
    size = F.lit(test_size) if test_size else F.floor(F.col("__n") / (splits + 1))
    split = rows.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    begin = F.col("__n") - (splits - F.col("split")) * size
    i = F.col("__i")
    first = F.greatest(F.lit(0), begin - gap - max_train) if max_train else F.lit(0)
    part = F.when((i >= begin) & (i < begin + size), "test").when((i < begin - gap) & (i >= first), "train")
    return split.withColumn("part", part).where("part is not null").drop("__i", "__n")


def leave_group_out(df: DataFrame, group: str) -> DataFrame:
    """Every group once as the test part of all rows; the groups are the small side."""
    held = df.select(F.col(group).alias("held_out")).distinct()
    return df.crossJoin(held).withColumn("part", F.when(F.col(group) == F.col("held_out"), "test").otherwise("train"))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a seeded hash of the key."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def shuffle_split(df: DataFrame, key: str, splits: int, test: float = 0.1, seed: int = 42) -> DataFrame:
    """Independent random test parts of about a share of the rows."""
    unit = F.pmod(F.xxhash64(F.col(key), F.col("split"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return df.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))).withColumn("part", F.when(unit < test, "test").otherwise("train"))


def ring_buffer(df: DataFrame, key: str, capacity: int, value: Sequence[str]) -> DataFrame:
    """What a ring of ``capacity`` slots holds after all rows: the last of each slot."""
    slots = row_index(df, key, (), "__i").withColumn("slot", F.col("__i") % capacity)
    return slots.groupBy("slot").agg(*(F.max_by(c, "__i").alias(c) for c in value))


def last_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """What a queue of bounded length keeps."""
    return df.orderBy(F.col(key).desc()).limit(n)
