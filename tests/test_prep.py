"""Scans, splits, samples and the caller's functions against plain Python."""

import math
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textmill.functions import text as tx
from textmill.operators import callables, features, ranking, sampling, splits
from textmill.sources import scans


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("g"), F.when(F.col("id") % 10 == 0, "a").otherwise("b").alias("y"))


def test_clean_by_hand(spark):
    cases = {
        "see ftp://a.b/c and WWW.x.org/y": "see and",
        "ünï@exämple.com wrote @jürgen #größe": "wrote",
        "a\x07b\x7fc": "a b c",
        "x &lt;b&gt;bold&lt;/b&gt; y": "x bold y",
        "what?!?! ok...": "what! ok.",
        "ﬁne １２": "fine 12",
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert [(r["t"], r["c"]) for r in df.select("t", tx.clean_full(F.col("t")).alias("c")).collect()] == list(cases.items())


def test_shards_part_the_rows(spark, rows):
    parts = [{r["k"] for r in scans.shard(rows, "k", i, 3).collect()} for i in range(3)]
    assert sorted(map(len, parts)) == [333, 333, 334] and set().union(*parts) == set(range(1000))
    even = [{r["k"] for r in scans.shard(rows, "k", i, 7, contiguous=False).collect()} for i in range(7)]
    assert {len(p) for p in even} == {142} and set().union(*even) == set(range(994))


def test_same_columns_refuses_others(spark):
    with pytest.raises(ValueError):
        scans.same_columns(spark.range(1), ["id", "x"])


def test_group_shuffle_keeps_groups_whole(rows):
    got = splits.group_shuffle_split(rows, "g", 4).collect()
    by = {}
    for r in got:
        by.setdefault((r["split"], r["g"]), set()).add(r["part"])
    assert len(got) == 4000 and all(len(v) == 1 for v in by.values())
    assert Counter(s for (s, _), v in by.items() if v == {"test"}) == {i: 2 for i in range(4)}


def test_stratified_shuffle_has_the_shares(rows):
    got = Counter((r["split"], r["y"], r["part"]) for r in splits.stratified_shuffle_split(rows, "y", "k", 3, 0.2).collect())
    assert got == {(s, y, p): n for s in range(3) for y, t, n_ in (("a", 20, 100), ("b", 180, 900)) for p, n in (("test", t), ("train", n_ - t))}


def test_repeated_kfold_parts_the_rows(rows):
    got = Counter((r["repeat"], r["fold"]) for r in splits.repeated_kfold(rows, "k", 4, 2).collect())
    assert got == {(r, f): 250 for r in range(2) for f in range(4)}


def test_balanced_draws_are_even(rows):
    got = Counter(r["y"] for r in sampling.balanced_draws(rows, "k", "y", 2000).collect())
    assert sum(got.values()) == 2000 and abs(got["a"] - 1000) < 120


def test_samples_depend_on_rows_alone(rows):
    a, b = (sorted(r["k"] for r in sampling.fraction_sample(d, "k", 0.3).collect()) for d in (rows, rows.repartition(7)))
    assert a == b and 230 < len(a) < 370
    kept = [r["k"] for r in sampling.replay(rows, "k", 100, 20).collect()]
    assert len(set(kept)) == 20 and min(kept) >= 900


def test_smote_lies_between(spark):
    points = [(i, [float(i % 5), float(i // 5)], 1) for i in range(25)] + [(100, [50.0, 50.0], 0)]
    df = spark.createDataFrame(points, "k long, v array<double>, y int")
    made = sampling.smote(df, "k", "v", "y", 1, 3, n=10).collect()
    where = {k: v for k, v, _ in points}
    assert len(made) == 10
    for r in made:
        a, b = np.array(where[r["k"]]), np.array(where[r["neighbour"]])
        t = np.array(r["v"]) - a
        assert r["neighbour"] != r["k"] and abs(np.cross(np.append(t, 0), np.append(b - a, 0))).max() < 1e-9 and 0 <= t @ (b - a) <= (b - a) @ (b - a)


def test_scaled_rewards(spark):
    steps = [(0, i, float(i % 4) - 1, i % 5 == 4) for i in range(30)]
    df = spark.createDataFrame(steps, "g int, i int, r double, done boolean")
    got = {r["i"]: r["scaled"] for r in sampling.scaled_rewards(df, "r", "done", "g", ["i"]).collect()}
    ret, seen = 0.0, []
    for _, i, r, done in steps:
        ret = r + 0.99 * ret * (1 - done)
        seen.append(ret)
        assert got[i] == pytest.approx(max(-10.0, min(10.0, r / math.sqrt(np.var(seen) + 1e-8))))


def test_spline_basis(spark):
    x = [0.0, 0.3, 1.0, 2.5, 4.0, -1.0, 9.0]
    df = spark.createDataFrame([(v,) for v in x], "x double").select(features.spline_basis(F.col("x"), [0.0, 1.0, 2.0, 3.0, 4.0], 3).alias("b"))
    for v, r in zip(x, df.collect()):
        assert len(r["b"]) == 7 and sum(r["b"]) == pytest.approx(1) and min(r["b"]) >= 0
        if v == 1.0:
            assert r["b"][1:4] == pytest.approx([1 / 6, 2 / 3, 1 / 6])


def test_sums_before(spark):
    df = spark.range(5000).select((F.col("id") * 3 % 5003).alias("k"), F.lit(2).alias("v"))
    got = {r["k"]: r["s"] for r in ranking.sum_before(df, "k", "v", "s").collect()}
    assert all(got[k] == 2 * i for i, k in enumerate(sorted(got)))


def test_callers_functions(spark, rows):
    with pytest.raises(Exception):
        callables.transform_columns(rows.select("k"), ["k"], lambda x: x * 2, lambda x: x, check=True).collect()
    spread = rows.groupBy("y").agg(callables.merge(lambda s: s.max() - s.min())(F.col("k")).alias("s")).collect()
    assert {r["y"]: r["s"] for r in spread} == {"a": 990.0, "b": 998.0}
    with pytest.raises(ValueError):
        callables.read_by_prefix(spark, "nowhere")


def signed64(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def test_hashed_terms_equal_brute_force(spark):
    from textmill.operators import vectorize

    texts = [(i, [f"w{(i * j) % 23}" for j in range(30)]) for i in range(20)]
    counts = vectorize.term_counts(spark.createDataFrame(texts, "k long, t array<string>"), "k", F.col("t"))
    want = Counter()
    for k, terms in texts:
        for term in terms:
            h = xxhash.xxh64(term.encode(), seed=42).intdigest()
            want[k, signed64(h) % 16] += -1 if (signed64(h) >> 62) & 1 else 1
    got = {(r["k"], r["cell"]): r["value"] for r in vectorize.hashed(counts, "k", 16).collect()}
    assert {c: v for c, v in got.items() if v} == {c: v for c, v in want.items() if v}


def test_hash_sample_equals_brute_force(rows):
    hashes = {r["k"]: r["h"] for r in rows.select("k", F.xxhash64(F.col("k"), F.lit(42)).alias("h")).collect()}
    got = {r["k"] for r in ranking.hash_sample(rows, "k", 25).collect()}
    assert got == set(sorted(hashes, key=lambda k: (hashes[k], k))[:25])


def test_shuffle_split_parts(rows):
    got = Counter((r["split"], r["part"]) for r in ranking.shuffle_split(rows, "k", 3, 0.1).collect())
    assert all(got[s, "test"] + got[s, "train"] == 1000 and 60 < got[s, "test"] < 140 for s in range(3))
