"""Joins by position, preference, similarity and distance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..session import ensure_checkpoint_dir
from .ranking import row_index


def zip_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, strict: bool = False) -> DataFrame:
    """Row i with row i, in the order of each side's key; the longer side's rest is left out.

    ``strict`` raises where the sides differ in length.
    """
    if strict and left.count() != right.count():
        raise ValueError("the two sides have different numbers of rows")
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    return row_index(left, left_key).join(row_index(right, right_key), "row_index")


def prefer_first(df: DataFrame, first: DataFrame, second: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """The value of the first lookup, else of the second, else null."""
    a = first.select(*on, F.col(value).alias("__a"))
    b = second.select(*on, F.col(value).alias("__b"))
    joined = df.join(a, list(on), "left").join(b, list(on), "left")
    return joined.withColumn(value, F.coalesce("__a", "__b")).drop("__a", "__b")


def pending(jobs: DataFrame, stems: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every config with every stem but the pairs done; both are small lists of names."""
    return jobs.crossJoin(F.broadcast(stems)).join(done, list(on), "left_anti")


def audit(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys whose counts differ between two tables."""
    a = left.groupBy(key).agg(F.count("*").alias("n_left"))
    b = right.groupBy(key).agg(F.count("*").alias("n_right"))
    return a.join(b, key, "full").where(~F.col("n_left").eqNullSafe(F.col("n_right")))


def encode_lookup(df: DataFrame, column: str, codes: DataFrame, unknown: int = -1) -> DataFrame:
    """Codes (column, code) joined; unknown values get ``unknown``."""
    return df.join(codes, column, "left").withColumn("code", F.coalesce("code", F.lit(unknown)))


def distances(queries: DataFrame, points: DataFrame, key: str, vector: str, metric: str = "euclidean") -> DataFrame:
    """Rows (query, point, d): a stated query set against all rows."""
    q = queries.select(F.col(key).alias("query"), vx.doubles(F.col(vector)).alias("__q"))
    p = points.select(F.col(key).alias("point"), vx.doubles(F.col(vector)).alias("__p"))
    return p.crossJoin(q).select("query", "point", vx.distance(F.col("__q"), F.col("__p"), metric).alias("d"))


def knn(queries: DataFrame, points: DataFrame, key: str, vector: str, k: int, metric: str = "euclidean", skip_self: bool = False) -> DataFrame:
    """The k nearest points of each query; ties by point id."""
    d = distances(queries, points, key, vector, metric)
    d = d.where("query != point") if skip_self else d
    nearest = Window.partitionBy("query").orderBy("d", "point")
    return d.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def radius(queries: DataFrame, points: DataFrame, key: str, vector: str, r: float, metric: str = "euclidean") -> DataFrame:
    return distances(queries, points, key, vector, metric).where(F.col("d") <= r)


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector of each label, element by element."""
    at = df.select(label, F.posexplode(vector).alias("pos", "x")).groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return at.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))


def nearest_centroid(df: DataFrame, key: str, vector: str, centers: DataFrame, label: str, cosine: bool = False) -> DataFrame:
    """Rows (key, predicted, score): the centroid of least distance, or of largest cosine."""
    v, unit = vx.doubles(F.col(vector)), vx.normalized if cosine else (lambda x: x)
    # The centers are one row; both sides are brought to length once, below the join, and the best is found in place.
    listed = centers.select(F.struct(unit(F.col("centroid")).alias("c"), F.col(label).alias("l")).alias("s")).agg(F.collect_list("s").alias("centers"))
    rows = df.select(key, unit(v).alias("v")).crossJoin(F.broadcast(listed))
    score = (lambda s: vx.dot(F.col("v"), s["c"])) if cosine else (lambda s: -vx.distance(F.col("v"), s["c"]))
    best = F.array_max(F.transform("centers", lambda s: F.struct(score(s).alias("s"), (-s["l"]).alias("o"))))
    return rows.select(key, best.alias("b")).select(key, (-F.col("b.o")).alias("predicted"), F.col("b.s").alias("score"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _schemes(threshold: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Least sizes of the bands, the differences that a pair whose smaller set is in one may have, and the largest ratio of sizes."""
    ratio = 1 / (threshold - 1e-9)
    least = [next((n for n in range(1, 1 << 20) if int(n * (ratio - 1)) > 0), 1 << 31)]
    while least[-1] < 1 << 31:
        least.append(int(least[-1] * max(1.5, ratio)) + 2)
    most = [int((n - 1) * (ratio - 1)) for n in least[1:]]
    return np.array(least, np.int64), np.array([*most, 0], np.int64), ratio


def _classed(sets: DataFrame) -> DataFrame:
    """Adds cid, a hash of the set h, and its size n; null sets are left out. In a batch, so that h is computed once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("h").is_valid())
            column = batch.column("h")
            n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            value = _mixed(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
            end = np.cumsum(n)
            cid = _mixed(before[end] - before[end - n] + n.astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), column, pa.array(cid), pa.array(n.astype(np.int32))], ["id", "h", "cid", "n"])

    return sets.mapInArrow(run, f"id {sets.schema['id'].dataType.simpleString()}, h array<bigint>, cid long, n int")


def _segment_signatures(sets: DataFrame, threshold: float) -> DataFrame:
    """Rows (cid, n, sig): two sets that similar share one, unless they are equal.

    Sets that may be the smaller of a pair with d differences at most have their tokens dealt to more than
    d segments by hash.  Differences spoil d of these, so a set with more than d that aren't empty shares a whole
    segment with its partner.  Only sets with fewer also send the empty ones.
    """
    least, most, ratio = _schemes(threshold)
    segments = most + 2 + most // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                cid, column = batch.slice(at, 1000).columns
                n = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                h = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                band = np.searchsorted(least, n, "right") - 1
                below = np.where((band > 0) & (n <= (least[band] - 1) * ratio), band - 1, -1)
                value, row = _mixed(h), np.repeat(np.arange(len(n)), n)
                for scheme in (band, below):
                    of = segments[scheme]
                    part = (h % of.astype(np.uint64)[row]).astype(np.int64)
                    taken = scheme[row] >= 0
                    first = np.cumsum(np.where(scheme >= 0, of, 0)) - np.where(scheme >= 0, of, 0)
                    total, filled = np.zeros((2, int(np.where(scheme >= 0, of, 0).sum())), np.uint64)
                    place = first[row[taken]] + part[taken]
                    np.add.at(total, place, value[taken])
                    np.add.at(filled, place, np.uint64(1))
                    owner = np.repeat(np.arange(len(n)), np.where(scheme >= 0, of, 0))
                    some = np.bincount(owner[filled > 0], minlength=len(n)) <= most[scheme]
                    sent = np.flatnonzero((filled > 0) | some[owner])
                    owner, which = owner[sent], sent - first[owner[sent]]
                    tag = which.astype(np.uint64) * np.uint64(64) + scheme[owner].astype(np.uint64)
                    sig = _mixed(total[sent] + _mixed(tag ^ np.uint64(0x9E3779B97F4A7C15)))
                    yield pa.RecordBatch.from_arrays([cid.take(pa.array(owner)), pa.array(n[owner].astype(np.int32)), pa.array(sig.view(np.int64))], ["cid", "n", "sig"])

    return sets.select("cid", "h").mapInArrow(run, "cid long, n int, sig long")


def jaccard_pairs(df: DataFrame, key: str, tokens: Column, threshold: float) -> DataFrame:
    """Pairs (a, b, jaccard), a < b, of token sets at or above a threshold; null tokens have none, two empty sets NaN.

    Equal sets are one class; classes meet by whole segments of their sets (``_segment_signatures``), so a
    common token brings nothing together, and only sets with a candidate are moved.  Tokens are compared by 64-bit hashes.
    For thresholds from 0.8; below that segments would be too short to tell sets apart.
    """
    if not 0.8 <= threshold <= 1:
        raise ValueError("the threshold must be from 0.8 to 1")
    ensure_checkpoint_dir(df.sparkSession)
    hashed = F.sort_array(F.array_distinct(F.transform(tokens, lambda w: F.xxhash64(w))))
    sets = _classed(df.select(F.col(key).alias("id"), hashed.alias("h")))
    members = sets.select("id", "cid", "n").where("id is not null").checkpoint()  # used four times
    sent = _segment_signatures(sets, threshold)
    # Signatures of one class alone are dropped; those with the same classes count once.
    met = sent.groupBy("sig").agg(F.sort_array(F.collect_set(F.struct("n", "cid"))).alias("c")).where(F.size("c") > 1).select("c").distinct()
    one = met.select("c", F.explode("c").alias("x"))
    fits = F.filter("c", lambda y: (y["cid"] > F.col("x.cid")) & (F.least(y["n"], F.col("x.n")) >= F.lit(threshold) * F.greatest(y["n"], F.col("x.n")) - 1e-9))
    pairs = one.select(F.col("x.cid").alias("c1"), F.explode(F.transform(fits, lambda y: y["cid"])).alias("c2")).distinct().checkpoint()
    wanted = pairs.select(F.explode(F.array("c1", "c2")).alias("cid")).distinct()
    moved = sets.select("cid", "h").join(wanted, "cid", "left_semi").groupBy("cid").agg(F.first("h").alias("h")).checkpoint()
    both = pairs.join(moved.select(F.col("cid").alias("c1"), F.col("h").alias("h1")), "c1").join(moved.select(F.col("cid").alias("c2"), F.col("h").alias("h2")), "c2")
    common = F.size(F.array_intersect("h1", "h2"))
    judged = both.select("c1", "c2", (common / (F.size("h1") + F.size("h2") - common)).alias("jaccard")).where(F.col("jaccard") >= threshold - 1e-9)
    first, second = (members.select(F.col("cid").alias(f"c{i}"), F.col("id").alias(f"id{i}")) for i in (1, 2))
    linked = judged.join(first, "c1").join(second, "c2").where("id1 != id2").select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b"), "jaccard")
    copies = members.select("cid", "n", F.col("id").alias("a")).join(members.select("cid", F.col("id").alias("b")), "cid").where("a < b")
    return linked.unionByName(copies.select("a", "b", F.when(F.col("n") > 0, F.lit(1.0)).otherwise(F.lit(float("nan"))).alias("jaccard")))


def as_of(left: DataFrame, right: DataFrame, on: str, time: str, value: str) -> DataFrame:
    """The latest right value at or before each left row's time, by one sort of the union."""
    a = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(1).alias("__left"))
    b = right.select(on, time, F.col(value).alias("__v"), F.lit(0).alias("__left"))
    both = a.unionByName(b, allowMissingColumns=True)
    upto = Window.partitionBy(on).orderBy(time, "__left").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(f"{value}_as_of", F.last("__v", ignorenulls=True).over(upto)).where("__left = 1").drop("__v", "__left")
