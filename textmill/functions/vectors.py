"""Expressions over arrays of numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it, also inside other lambdas."""
    return F.element_at(F.transform(F.array(c), f), 1)


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def l2(c: Column) -> Column:
    return F.sqrt(dot(c, c))


def normalized(c: Column, norm: str = "l2", least: float = 1e-12) -> Column:
    """A row divided by its l1, l2 or max norm; a zero row stays."""
    size = {"l1": lambda v: total(F.transform(v, F.abs)), "l2": l2, "max": lambda v: F.array_max(F.transform(v, F.abs))}[norm]
    return bound(c, lambda v: bound(F.greatest(size(v), F.lit(least)), lambda n: F.transform(v, lambda x: x / n)))


def resized(c: Column, width: int) -> Column:
    """Cut or filled with zeros to a width; null for an empty vector."""
    full = F.slice(F.concat(c, F.array_repeat(F.lit(0.0), width)), 1, width)
    return F.when(F.size(c) > 0, full)


def distance(a: Column, b: Column, metric: str = "euclidean", p: float = 2.0) -> Column:
    """Distance of two vectors by a named metric."""
    diff = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    if metric == "euclidean":
        return F.sqrt(total(F.transform(diff, lambda d: d * d)))
    if metric == "sqeuclidean":
        return total(F.transform(diff, lambda d: d * d))
    if metric == "manhattan":
        return total(diff)
    if metric == "chebyshev":
        return F.array_max(diff)
    if metric == "minkowski":
        return F.pow(total(F.transform(diff, lambda d: F.pow(d, F.lit(p)))), F.lit(1 / p))
    if metric == "cosine":
        return 1 - dot(a, b) / F.greatest(l2(a) * l2(b), F.lit(1e-12))
    if metric == "canberra":
        size = F.zip_with(a, b, lambda x, y: F.abs(x) + F.abs(y))
        return total(F.zip_with(diff, size, lambda d, s: F.when(s == 0, F.lit(0.0)).otherwise(d / s)))
    if metric == "braycurtis":
        return total(diff) / total(F.zip_with(a, b, lambda x, y: F.abs(x + y)))
    raise ValueError(f"no metric {metric!r}")


def _shares(c: Column) -> Column:
    """Elements as shares of their sum."""
    return bound(c, lambda v: bound(total(v), lambda n: F.transform(v, lambda x: x / n)))


def softmax(c: Column) -> Column:
    return _shares(bound(c, lambda v: bound(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))))


def argmax(c: Column) -> Column:
    """Position from 0 of the first largest element."""
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def top_k_gate(c: Column, k: int) -> Column:
    """Softmax over the k largest logits, 0 elsewhere."""
    def gate(v: Column) -> Column:
        ends = F.struct(F.element_at(F.sort_array(v, asc=False), k).alias("least"), F.array_max(v).alias("top"))
        return bound(ends, lambda s: F.transform(v, lambda x: F.when(x >= s["least"], F.exp(x - s["top"])).otherwise(F.lit(0.0))))

    return _shares(bound(c, gate))


def interactions(c: Column) -> Column:
    """Products of all pairs i < j, in order."""
    n = F.size(c)
    rows = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.slice(c, i + 1, n), lambda y: y * F.element_at(c, i)))
    return F.when(n > 1, F.flatten(rows)).otherwise(F.array().cast("array<double>"))


def running_product(c: Column) -> Column:
    start = F.struct(F.lit(1.0).alias("p"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(c, start, lambda s, x: F.struct((s["p"] * x).alias("p"), F.concat(s["out"], F.array(s["p"] * x)).alias("out")), lambda s: s["out"])


def noise_schedule(steps: int, low: float = 1e-4, high: float = 0.02) -> Column:
    """Cumulative products of 1 - beta for ``steps`` betas evenly from low to high."""
    step = (high - low) / max(1, steps - 1)
    return running_product(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: 1 - (F.lit(low) + i * F.lit(step))))


def log1p_relu(c: Column) -> Column:
    """ln(1 + max(0, x)); null stays null."""
    return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))


def nan_distance(a: Column, b: Column) -> Column:
    """Euclidean distance over the places that both vectors have, scaled up to all; infinite where there are none."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    shared = F.filter(squares, lambda d: d.isNotNull() & ~F.isnan(d))
    n = F.size(shared)
    return F.when(n > 0, F.sqrt(total(shared) * F.size(a) / n)).otherwise(F.lit(float("inf")))


def scalar_cell(c: Column) -> Column:
    """The one element of an array of one; null for an empty one."""
    return F.when(F.size(c) == 1, F.get(c, F.lit(0)))


def padded(c: Column, length: Column, fill: int) -> Column:
    """An array filled up to a length at its right end."""
    return F.concat(c, F.array_repeat(F.lit(fill), F.greatest(length - F.size(c), F.lit(0)).cast("int")))
