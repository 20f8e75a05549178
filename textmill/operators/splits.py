"""Train and test parts beyond plain folds, and grids of parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import kfold


def leave_p_out(df: DataFrame, key: str, p: int = 1) -> DataFrame:
    """Rows (split keys k1 < ... < kp), one for each test part.

    The parts are what is asked for, so there are n over p of them; it is for small tables.
    """
    ids = df.select(key).distinct()
    out = ids.withColumnRenamed(key, "k1")
    for i in range(2, p + 1):
        out = out.join(ids.withColumnRenamed(key, f"k{i}"), F.col(f"k{i - 1}") < F.col(f"k{i}"))
    return out


def _unit(*columns):
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def group_shuffle_split(df: DataFrame, group: str, splits: int = 5, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Whole groups in the test part: the ceil(test * groups) of the smallest seeded hash, in every split."""
    groups = df.select(group).distinct().withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    order = Window.partitionBy("split").orderBy(F.xxhash64(F.col(group), F.col("split"), F.lit(seed)), group)
    n = F.count("*").over(Window.partitionBy("split"))
    chosen = groups.withColumn("part", F.when(F.row_number().over(order) <= F.ceil(n * test), "test").otherwise("train"))
    return df.join(chosen, group)


def stratified_shuffle_split(df: DataFrame, label: str, key: str, splits: int = 10, test: float = 0.1, seed: int = 42) -> DataFrame:
    """int(test rows * share of the class) rows of every class in the test part, the rest in the train part.

    A class's threshold on the hash is that of its wanted rank: rows near it alone are ranked, so no task sorts a class.
    """
    total = df.agg(F.count("*").alias("n")).scalar()
    shares = df.groupBy(label).agg(F.count("*").alias("c")).withColumn("want", F.floor(F.round(total * test) * F.col("c") / total))
    unit = _unit(F.col(key), F.col("split"), F.lit(seed))
    rows = df.join(F.broadcast(shares), label).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))).withColumn("u", unit)
    mean, slack = F.col("want") / F.col("c"), 6 * F.sqrt(F.col("want") + 1) / F.col("c")
    near = rows.where(F.abs(F.col("u") - mean) <= slack)
    below = rows.where(F.col("u") < mean - slack).groupBy(label, "split").agg(F.count("*").alias("below"))
    rank = F.row_number().over(Window.partitionBy(label, "split").orderBy("u", key))
    ranked = near.withColumn("r", rank).join(below, [label, "split"], "left")
    part = F.when(F.col("r") + F.coalesce("below", F.lit(0)) <= F.col("want"), "test").otherwise("train")
    sure = rows.where(F.abs(F.col("u") - mean) > slack).withColumn("part", F.when(F.col("u") < mean, "test").otherwise("train"))
    names = [*df.columns, "split", "part"]
    return ranked.withColumn("part", part).select(*names).union(sure.select(*names))


def repeated_kfold(df: DataFrame, key: str, k: int, repeats: int, seed: int = 42) -> DataFrame:
    """Rows with (repeat, fold): ``kfold`` of the order of a hash seeded by seed + repeat."""
    out = None
    for r in range(repeats):
        shuffled = df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed + r)))
        one = kfold(shuffled, "__h", k, [key]).drop("__h").withColumn("repeat", F.lit(r))
        out = one if out is None else out.unionByName(one)
    return out


def grid(spark, parameters: Mapping[str, Sequence]) -> DataFrame:
    """One row for each combination, numbered in the order of the sorted names."""
    names = sorted(parameters)
    out = spark.range(1).select(F.lit(0).cast("long").alias("candidate"))
    for name in names:
        values = list(parameters[name])
        at = F.posexplode(F.array(*map(F.lit, values))).alias("__i", name)
        out = out.select("*", at).withColumn("candidate", F.col("candidate") * len(values) + F.col("__i")).drop("__i")
    return out


def random_candidates(spark, parameters: Mapping[str, Sequence], n: int, seed: int = 42) -> DataFrame:
    """``n`` combinations of the grid, without repeats, in the order of a seeded hash."""
    return grid(spark, parameters).orderBy(F.xxhash64("candidate", F.lit(seed)), "candidate").limit(n)
