"""Ordered-frame operators within groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import bound
from .ranking import sum_before


def lags(df: DataFrame, value: str, steps: Sequence[int], group: str, order: Sequence[str]) -> DataFrame:
    """A column for each positive lag; lags of zero or less are skipped."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumns({f"{value}_lag{k}": F.lag(value, k).over(w) for k in steps if k > 0})


def rolling_mean(df: DataFrame, value: str, width: int, group: str, order: Sequence[str], name: str = "rolling_mean") -> DataFrame:
    """Causal mean over up to ``width`` rows."""
    return df.withColumn(name, F.avg(value).over(Window.partitionBy(group).orderBy(*order).rowsBetween(1 - width, 0)))


def frame_stack(df: DataFrame, value: str, n: int, group: str, order: Sequence[str]) -> DataFrame:
    """The last n values, the group's first repeated in front."""
    w = Window.partitionBy(group).orderBy(*order)
    recent = F.collect_list(value).over(w.rowsBetween(1 - n, 0))
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("frames", F.concat(F.array_repeat(first, F.lit(n) - F.size(recent)), recent))


def clips(arr: Column, size: int, stride: int) -> Column:
    """Windows of an array as an array of arrays; none where it is too short."""

    def cut(a: Column) -> Column:
        at = F.when(F.size(a) >= size, F.sequence(F.lit(0), F.size(a) - size, F.lit(stride))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.get(a, i + j)))  # a slice would go through all of it

    return bound(arr, cut)


def drop_repeats(df: DataFrame, line: str, group: str, order: str, least: int = 8) -> DataFrame:
    """Without lines equal to the last non-blank line before, if longer than ``least``."""
    key = F.trim(F.col(line))
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(key != "", key), ignorenulls=True).over(before)
    return df.withColumn("__last", last).where(F.col("__last").isNull() | (key != F.col("__last")) | (F.length(key) <= least)).drop("__last")


def frequent_lines(df: DataFrame, line: Column, least: int = 3) -> DataFrame:
    return df.select(line.alias("line")).where("line <> ''").groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def first_of_frequent(df: DataFrame, line: str, key: Sequence[str], least: int = 3) -> DataFrame:
    """Lines seen ``least`` times or more kept once, at their first place; others all kept.

    Counts and first places come from one aggregation, so a very frequent line is no hot window.
    """
    place = F.struct(*key)
    seen = df.groupBy(line).agg(F.count("*").alias("__n"), F.min(place).alias("__first"))
    joined = df.join(seen, line)
    return joined.where((F.col("__n") < least) | (place == F.col("__first"))).drop("__n", "__first")


def pack(df: DataFrame, ids: str, key: str, length: int, separator: int) -> DataFrame:
    """Ids of all rows, each followed by a separator, in blocks of ``length``; the tail is dropped.

    Rows are located by counts within key ranges, so no task holds the whole sequence.
    """
    sized = df.select(key, F.concat(ids, F.array(F.lit(separator).cast("int"))).alias("__ids"))
    span = F.floor(F.col(key) / 1024)
    by_span = sized.groupBy(span.alias("__g")).agg(F.sum(F.size("__ids")).alias("__len"))
    starts = sum_before(by_span, "__g", "__len", "__s").select("__g", "__s")
    inside = Window.partitionBy("__g").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("__g", span).withColumn("__o", F.coalesce(F.sum(F.size("__ids")).over(inside), F.lit(0))).join(starts, "__g")
    flat = placed.select((F.col("__s") + F.col("__o")).alias("__at"), F.posexplode("__ids").alias("__p", "id"))
    spot = F.col("__at") + F.col("__p")
    blocks = flat.select(F.floor(spot / length).alias("block"), (spot % length).alias("i"), "id").groupBy("block")
    packed = blocks.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "id"))), lambda x: x["id"]).alias("ids")).where(F.size("ids") == length)
    return packed.select("block", F.slice("ids", 1, length - 1).alias("inputs"), F.slice("ids", 2, length - 1).alias("labels"))


def welford(df: DataFrame, value: str, group: str, order: Sequence[str], least: int = 100) -> DataFrame:
    """Value scaled by the running mean and sample deviation; as it is before ``least`` rows."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.count(value).over(w)
    variance = F.when(n < 2, F.lit(1.0)).otherwise(F.var_samp(value).over(w))
    scaled = (F.col(value) - F.avg(value).over(w)) / F.sqrt(variance + 1e-8)
    return df.withColumn("scaled", F.when(n < least, F.col(value)).otherwise(scaled))


def running_normal(df: DataFrame, value: str, group: str, order: Sequence[str], clip: float = 10.0) -> DataFrame:
    """Value standardised by the running population moments and clipped."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    z = (F.col(value) - F.avg(value).over(w)) / F.sqrt(F.var_pop(value).over(w) + 1e-8)
    return df.withColumn("normal", F.greatest(F.lit(-clip), F.least(F.lit(clip), z)))


def sliding_scaler(df: DataFrame, value: str, group: str, order: Sequence[str], width: int, every: int) -> DataFrame:
    """Value scaled by moments over the last ``width`` rows, taken anew every ``every`` rows."""
    w = Window.partitionBy(group).orderBy(*order)
    frame = w.rowsBetween(1 - width, 0)
    at = F.row_number().over(w) % every == 0
    held = df.withColumn("__m", F.when(at, F.avg(value).over(frame))).withColumn("__s", F.when(at, F.stddev_samp(value).over(frame)))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    m, s = F.last("__m", ignorenulls=True).over(upto), F.last("__s", ignorenulls=True).over(upto)
    return held.withColumn("scaled", F.when(m.isNull(), F.col(value)).otherwise((F.col(value) - m) / F.when(s > 0, s).otherwise(1.0))).drop("__m", "__s")


def first_seen_codes(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Codes from 1 in the order of first appearance; 0 is kept for what was never seen."""
    first = df.groupBy(column).agg(F.min(F.struct(*order)).alias("f"))
    return first.select(column, F.row_number().over(Window.orderBy("f")).alias("code"))


def ema_scaler(df: DataFrame, value: str, group: str, order: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Running scaling by exponential means; the first value of a group gives 0.

    A fold over the group's ordered values; groups are meant to be series, not the table.
    """
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("__x"))))
    listed = df.groupBy(group).agg(rows.alias("r"))
    seed = F.struct(F.col("r")[0]["__x"].alias("m"), F.lit(1.0).alias("v"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, r: Column) -> Column:
        x = r["__x"]
        mean = (1 - alpha) * s["m"] + alpha * x
        var = (1 - alpha) * s["v"] + alpha * (x - mean) * (x - mean)
        return F.struct(mean.alias("m"), var.alias("v"), F.concat(s["out"], F.array((x - mean) / F.sqrt(var + 1e-8))).alias("out"))

    scaled = F.aggregate("r", seed, step, lambda s: s["out"])
    zipped = listed.select(group, F.explode(F.arrays_zip(F.col("r"), scaled.alias("s"))).alias("z"))
    return zipped.select(group, *(F.col(f"z.r.{c}").alias(c) for c in order), F.col("z.r.__x").alias(value), F.col("z.s").alias("ema_scaled"))


def ddm_levels(df: DataFrame, error: str, group: str, order: Sequence[str], warn: float = 2.0, drift: float = 3.0, least: int = 30) -> DataFrame:
    """Drift detection on error rates up to the first drift: stable, warning or drift for each row."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.count("*").over(w)
    p = F.avg(F.col(error).cast("double")).over(w)
    rows = df.withColumn("__n", n).withColumn("__p", p).withColumn("__s", F.sqrt(F.col("__p") * (1 - F.col("__p")) / F.col("__n")))
    live = F.when(F.col("__n") >= least, F.struct((F.col("__p") + F.col("__s")).alias("t"), F.col("__p").alias("p"), F.col("__s").alias("s")))
    rows = rows.withColumn("__low", F.min(live).over(w))
    now = F.col("__p") + F.col("__s")
    low_p, low_s = F.col("__low.p"), F.col("__low.s")
    level = F.when(F.col("__low").isNull(), "stable").when(now > low_p + drift * low_s, "drift").when(now > low_p + warn * low_s, "warning").otherwise("stable")
    return rows.withColumn("level", level).drop("__n", "__p", "__s", "__low")
