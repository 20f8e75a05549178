"""Samples, replay and oversampling by seeded hashes, so that a sample depends on the rows alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import joins
from .ranking import hash_sample


def _unit(*columns):
    return (F.pmod(F.xxhash64(*columns), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def fraction_sample(df: DataFrame, key: str, share: float, most: int | None = None, seed: int = 42) -> DataFrame:
    """Rows whose hash is below ``share``; the ``most`` of the smallest hash."""
    u = _unit(F.col(key), F.lit(seed))
    out = df.where(u < share)
    return out if most is None else out.orderBy(u, key).limit(most)


def balanced_draws(df: DataFrame, key: str, label: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` draws (draw, key, label) with replacement, each row of a class as likely as 1 over the class's size.

    A draw picks a class evenly and then a place among the class's rows, which row numbers in hash slices find.
    """
    spark = df.sparkSession
    slices = 256
    rows = df.select(key, label).withColumn("slice", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(slices)))
    cells = rows.groupBy(label, "slice").agg(F.count("*").alias("c"))
    by = Window.partitionBy(label).orderBy("slice")
    cells = cells.withColumn("from", F.sum("c").over(by) - F.col("c")).withColumn("size", F.sum("c").over(Window.partitionBy(label)))
    at = rows.join(cells, [label, "slice"]).withColumn("place", F.row_number().over(Window.partitionBy(label, "slice").orderBy(F.xxhash64(F.col(key), F.lit(seed + 1)), key)) - 1 + F.col("from"))
    sizes = cells.groupBy(label).agg(F.first("size").alias("size"))
    listed = sizes.agg(F.sort_array(F.collect_list(F.struct(label, "size"))).alias("classes"))  # one entry for each class
    draws = spark.range(n).withColumnRenamed("id", "draw").crossJoin(F.broadcast(listed))
    which = F.floor(_unit(F.col("draw"), F.lit(seed + 2)) * F.size("classes")).cast("int")
    picked = draws.withColumn("c", F.get("classes", which)).select("draw", F.col(f"c.{label}").alias(label), F.floor(_unit(F.col("draw"), F.lit(seed + 3)) * F.col("c.size")).alias("place"))
    return picked.join(at.select(label, "place", key), [label, "place"]).select("draw", key, label)


def replay(df: DataFrame, key: str, capacity: int, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement of the last ``capacity`` by key."""
    return df.orderBy(F.col(key).desc()).limit(capacity).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def smote(df: DataFrame, key: str, vector: str, label: str, minority, k: int = 5, n: int = 200, seed: int = 42) -> DataFrame:
    """``n`` synthetic vectors of the minority class, or as many as it has rows, each on the way from a row to one of its ``k`` nearest.

    Rows (key, neighbour, vector).  The rows to begin from are a stated set, those of the smallest hash; all others of the class are searched.
    """
    rows = df.where(F.col(label) == minority).select(key, vector)
    near = joins.knn(hash_sample(rows, key, n, seed), rows, key, vector, k, skip_self=True)
    found = near.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "point"))).alias("near"))
    pick = F.pmod(F.xxhash64("query", F.lit(seed + 2)), F.size("near")).cast("int")
    chosen = found.select("query", F.get("near", pick)["point"].alias("neighbour"))
    a = rows.select(F.col(key).alias("query"), F.col(vector).cast("array<double>").alias("a"))
    b = rows.select(F.col(key).alias("neighbour"), F.col(vector).cast("array<double>").alias("b"))
    both = chosen.join(a, "query").join(b, "neighbour").withColumn("step", _unit(F.col("query"), F.lit(seed + 1)))
    return both.select(F.col("query").alias(key), "neighbour", F.zip_with("a", "b", lambda x, y: x + F.col("step") * (y - x)).alias(vector))


def discounted(df: DataFrame, reward: str, done: str, group: str, order: Sequence[str], gamma: float = 0.99, name: str = "ret") -> DataFrame:
    """The running discounted return of each step, begun anew where ``done`` is set: ret = reward + gamma * ret * (1 - done).

    Episodes are cut by the number of resets up to a step; within one, a fold over its steps in order.
    """
    by = Window.partitionBy(group).orderBy(*order)
    part = F.sum(F.col(done).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    steps = df.withColumn("__e", part)
    listed = steps.groupBy(group, "__e").agg(F.sort_array(F.collect_list(F.struct(*order, F.col(reward).cast("double").alias("__r")))).alias("s"))
    start = F.struct(F.lit(0.0).alias("v"), F.array().cast("array<double>").alias("out"))
    folded = F.aggregate("s", start, lambda a, x: F.struct((x["__r"] + gamma * a["v"]).alias("v"), F.concat(a["out"], F.array(x["__r"] + gamma * a["v"])).alias("out")), lambda a: a["out"])
    at = listed.select(group, F.explode(F.arrays_zip("s", folded.alias("ret"))).alias("z"))
    return at.select(group, *(F.col(f"z.s.{o}").alias(o) for o in order), F.col("z.s.__r").alias(reward), F.col("z.ret").alias(name))


def scaled_rewards(df: DataFrame, reward: str, done: str, group: str, order: Sequence[str], gamma: float = 0.99, clip: float = 10.0) -> DataFrame:
    """Rewards over the running population standard deviation of the discounted return, clipped."""
    steps = discounted(df, reward, done, group, order, gamma)
    var = F.var_pop("ret").over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    scaled = F.col(reward) / F.sqrt(var + 1e-8)
    return steps.withColumn("scaled", F.greatest(F.lit(-clip), F.least(F.lit(clip), scaled)))


def fifo(df: DataFrame, group: str, key: str, capacity: int) -> DataFrame:
    """The last ``capacity`` rows of every group by key: what a bounded first-in, first-out memory holds at the end.

    Spark prunes each group to ``capacity`` rows in every task before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.col(key).desc()))
    return df.withColumn("__r", rank).where(F.col("__r") <= capacity).drop("__r")
