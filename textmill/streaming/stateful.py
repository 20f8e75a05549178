"""Stateful operators over streams; each has a batch twin in ``operators.windows``.

State is a few numbers for each key.  Every function takes a stream with the key, an order
column and a value, and gives a stream in append mode.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _stateful(df: DataFrame, group: str, order: str, value: str, out: str, state: str, step: Callable[[tuple, float], tuple[tuple, float | str]], start: tuple, kind: str = "double") -> DataFrame:
    """Runs ``step`` over each key's values in their order within a batch."""
    name = df.schema[group].dataType.simpleString()
    when = df.schema[order].dataType.simpleString()

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else start
        rows = pd.concat(list(batches)).sort_values(order)
        results = []
        for x in rows[value]:
            now, y = step(now, float(x))
            results.append(y)
        held.update(now)
        yield pd.DataFrame({group: key[0], order: rows[order].to_numpy(), value: rows[value].to_numpy(), out: results})

    schema = f"{group} {name}, {order} {when}, {value} double, {out} {kind}"
    return df.select(group, order, value).groupBy(group).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.NoTimeout)


def welford_stream(df: DataFrame, group: str, order: str, value: str, least: int = 100) -> DataFrame:
    """Scaled by running sample moments; as it is before ``least`` rows."""

    def step(s: tuple, x: float) -> tuple[tuple, float]:
        n, mean, m2 = s[0] + 1, s[1], s[2]
        delta = x - mean
        mean += delta / n
        m2 += delta * (x - mean)
        variance = m2 / (n - 1) if n > 1 else 1.0
        return (n, mean, m2), (x - mean) / float(np.sqrt(variance + 1e-8)) if n >= least else x

    return _stateful(df, group, order, value, "scaled", "n long, mean double, m2 double", step, (0, 0.0, 0.0))


def ema_stream(df: DataFrame, group: str, order: str, value: str, alpha: float = 0.05) -> DataFrame:
    def step(s: tuple, x: float) -> tuple[tuple, float]:
        mean, var = (x, 1.0) if s[2] == 0 else (s[0], s[1])
        mean = (1 - alpha) * mean + alpha * x
        var = (1 - alpha) * var + alpha * (x - mean) ** 2
        return (mean, var, s[2] + 1), (x - mean) / float(np.sqrt(var + 1e-8))

    return _stateful(df, group, order, value, "ema_scaled", "mean double, var double, n long", step, (0.0, 1.0, 0))


def page_hinkley_stream(df: DataFrame, group: str, order: str, value: str, delta: float = 0.005, limit: float = 50.0, alpha: float = 0.9999) -> DataFrame:
    """Alarms where the sum of deviations above the forgetting mean rises ``limit`` over its least.

    With alpha 1 the mean is the value itself and nothing can be found.
    """

    def step(s: tuple, x: float) -> tuple[tuple, str]:
        mean, total, low, n = s
        mean = x if n == 0 else (1 - alpha) * mean + alpha * x
        total += x - mean - delta
        low = min(low, total)
        if total - low > limit:
            return (0.0, 0.0, 0.0, 0), "drift"
        return (mean, total, low, n + 1), "stable"

    return _stateful(df, group, order, value, "level", "mean double, total double, low double, n long", step, (0.0, 0.0, 0.0, 0), "string")


def ddm_stream(df: DataFrame, group: str, order: str, value: str, least: int = 30) -> DataFrame:
    """Error-rate drift: warning at two, drift and a new start at three deviations above the least."""

    def step(s: tuple, x: float) -> tuple[tuple, str]:
        n, p, low_p, low_s = s[0] + 1, s[1] + (x - s[1]) / (s[0] + 1), s[2], s[3]
        dev = float(np.sqrt(max(p * (1 - p), 0.0) / n))
        if n < least:
            return (n, p, low_p, low_s), "stable"
        if p + dev < low_p + low_s:
            low_p, low_s = p, dev
        if p + dev > low_p + 3 * low_s:
            return (0, 0.0, 1e9, 1e9), "drift"
        return (n, p, low_p, low_s), "warning" if p + dev > low_p + 2 * low_s else "stable"

    return _stateful(df, group, order, value, "level", "n long, p double, low_p double, low_s double", step, (0, 0.0, 1e9, 1e9), "string")


def adwin_stream(df: DataFrame, group: str, order: str, value: str, delta: float = 0.001, most: int = 512) -> DataFrame:
    """Adaptive window of up to ``most`` values: cut where the means of two parts differ too much."""

    def step(s: tuple, x: float) -> tuple[tuple, str]:
        window = [*s[0], x][-most:]
        a = np.array(window)
        n = len(a)
        if n >= 2:
            i = np.arange(1, n)
            left, total = np.cumsum(a)[:-1], a.sum()
            harmonic = 1 / (1 / i + 1 / (n - i))
            bound = np.sqrt(np.log(4 * n / delta) / (2 * harmonic))
            hit = np.flatnonzero(np.abs(left / i - (total - left) / (n - i)) > bound)
            if len(hit):
                return (window[int(hit[0]) + 1 :],), "drift"
        return (window,), "stable"

    return _stateful(df, group, order, value, "level", "window array<double>", step, ([],), "string")


def windowed_counts(df: DataFrame, time: str, group: str, value: str, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Event-time windows with a watermark; the same expression runs in batch."""
    at = df.withColumn(time, F.col(time).cast("timestamp"))
    at = at.withWatermark(time, late) if df.isStreaming else at
    out = at.groupBy(F.window(time, size).alias("w"), group).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), group, "n", "total")


def sessions(df: DataFrame, time: str, group: str, gap: str = "1 hour", late: str = "2 days") -> DataFrame:
    at = df.withColumn(time, F.col(time).cast("timestamp"))
    at = at.withWatermark(time, late) if df.isStreaming else at
    out = at.groupBy(F.session_window(time, gap).alias("w"), group).agg(F.count("*").alias("n"))
    return out.select(group, F.col("w.start").alias("start"), "n")
