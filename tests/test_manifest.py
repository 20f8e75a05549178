"""Manifests, configurations, saved preparations and resumed reading against plain Python."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.operators import callables, ranking, sampling, tables, tabular
from textmill.sources import files


def test_manifest_finds_changes(spark, tmp_path):
    for name, content in (("a.bin", b"one"), ("b.bin", b"two"), ("c.bin", b"three")):
        (tmp_path / name).write_bytes(content)
    stored = files.manifest(spark, str(tmp_path)).checkpoint()
    by = {r["path"].rpartition("/")[2]: (r["size"], r["sha512"]) for r in stored.collect()}
    assert by == {n: (len(c), hashlib.sha512(c).hexdigest()) for n, c in (("a.bin", b"one"), ("b.bin", b"two"), ("c.bin", b"three"))}
    assert files.check_manifest(stored, str(tmp_path)).count() == 0
    (tmp_path / "a.bin").write_bytes(b"eno")
    (tmp_path / "b.bin").unlink()
    assert {(r[0].rpartition("/")[2], r[1]) for r in files.check_manifest(stored, str(tmp_path)).collect()} == {("a.bin", "changed"), ("b.bin", "missing")}


def test_wait_gives_up(spark, tmp_path):
    with pytest.raises(TimeoutError):
        files.wait_stable(spark, str(tmp_path), 0.1, 0.05, most=0.3)


def test_metrics_nest(spark, tmp_path):
    rows = spark.createDataFrame([("m", "d1", 0.5), ("m", "d2", 0.25), ("n", None, 1.0), ("o", "d1", None)], "model string, dataset string, f1 double")
    files.write_metrics(rows, str(tmp_path / "out"), "model", "dataset")
    got = {}
    for part in (tmp_path / "out").glob("*.json"):
        for line in part.read_text().splitlines():
            row = json.loads(line)
            got[row["model"]] = row["items"]
    assert got == {"m": {"d1": {"f1": 0.5}, "d2": {"f1": 0.25}}, "o": {"d1": {}}}


def test_shallow_extract_by_hand(spark):
    cases = ['{"Net": {"hidden_size": 8, "x": "}"}}', '{"Net": "{}"}', '{"a": {}, "b": {}}', "[1, 2]", '[{"k": 1, "l": 2}]', "[]", "{}", "{bad", "", None]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, raw string")
    got = {r["i"]: r.asDict() for r in tables.shallow_extract(df, "raw").collect()}
    shown = {i: {k: v for k, v in r.items() if k not in ("i", "raw") and v is not None} for i, r in got.items()}
    assert shown[0] == {"model_class": "Net", "hidden_size": "8"}
    assert shown[1] == {"top_keys": ["Net"]} and shown[2] == {"top_keys": ["a", "b"]}
    assert shown[3] == {"list_length": 2} and shown[4] == {"list_length": 1, "list_item_keys": ["k", "l"]} and shown[5] == {"list_length": 0}
    assert shown[6] == shown[7] == shown[8] == shown[9] == {}


def test_preparation_keeps_codes(spark):
    rows = spark.createDataFrame([(1.0, "b", "x"), (None, "a", "y"), (float("nan"), "c", "x"), (5.0, None, "x")], "v double, k string, two string")
    made = tabular.fit(rows, ["v"], ["k", "two"])
    assert made.categories == {"k": ["a", "b", "c"], "two": ["x", "y"]} and made.flagged == ["v"] and made.fill == {"v": 1.0}
    other = made.transform(spark.createDataFrame([(3.0, "c", "z"), (None, "new", "y")], "v double, k string, two string")).collect()
    assert [(r["k_0"], r["k_1"], r["k_2"], r["two_1"], r["v_missing"]) for r in other] == [(0, 0, 1, 0, 0), (0, 0, 0, 1, 1)]
    x = np.array([1.0, 1.0, 1.0, 5.0])
    assert other[0]["v_scaled"] == pytest.approx((3 - x.mean()) / x.std()) and other[1]["v_scaled"] == pytest.approx((1 - x.mean()) / x.std())
    with pytest.raises(ValueError):
        tabular.fit(rows, ["w"], [])
    with pytest.raises(ValueError):
        tabular.fit(rows, [], ["k"], widest=2)
    empty = tabular.fit(rows.limit(0), ["v"], ["k"])
    assert empty.transform(rows).count() == 4 and empty.categories == {"k": []}


def test_iterative_impute_finds_a_linear_rule(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=400), rng.normal(size=400)
    c = 2 * a - 3 * b + 1
    full = np.stack([a, b, c], axis=1)
    gaps = np.zeros(full.shape, dtype=bool)
    gaps[np.arange(0, 400, 5), 2] = True
    gaps[np.arange(1, 400, 9), 0] = True
    rows = [(i, *(None if gaps[i, j] else float(full[i, j]) for j in range(3))) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double")
    got = tabular.iterative_impute(df, ["a", "b", "c"], rounds=15, tolerance=1e-5)
    assert got.columns == df.columns
    out = np.array([list(r)[1:] for r in got.orderBy("i").collect()])
    determined = gaps & (gaps.sum(axis=1) == 1)[:, None]  # two of three missing leave a line of values
    assert np.array_equal(out[~gaps], full[~gaps]) and determined.sum() > 100 and np.abs(out - full)[determined].max() < 0.02
    low = tabular.iterative_impute(df, ["a", "b", "c"], rounds=2, low=0.0, high=0.5).where("i % 5 = 0").collect()
    assert all(0.0 <= r["c"] <= 0.5 for r in low)
    assert tabular.iterative_impute(df.limit(0), ["a", "b"]).count() == 0
    none = tabular.iterative_impute(df.select("i", "a", F.lit(None).cast("double").alias("z")), ["a", "z"])
    assert {r["z"] for r in none.collect()} == {0.0}


def test_resume_and_fifo(spark):
    rows = spark.range(100).select("id", (F.col("id") % 3).alias("g"))
    whole, rest = callables.resume(rows, 16, "id").collect(), callables.resume(rows, 16, "id", 4).collect()
    assert sorted(r["batch"] for r in whole) == [i // 16 for i in range(100)]
    assert {tuple(r) for r in rest} == {tuple(r) for r in whole if r["batch"] >= 4}
    assert {r["id"] for r in sampling.fifo(rows, "g", "id", 2).collect()} == {94, 95, 96, 97, 98, 99}


@pytest.mark.parametrize("buckets", [1, 2, 7, 64, 1000])
def test_row_numbers_by_any_number_of_ranges(spark, buckets):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 50 != 0, (F.col("id") * 7919) % 997).alias("k"))
    got = {r["id"]: r["row_index"] for r in ranking.row_index(rows, "k", ["id"], buckets=buckets).collect()}
    order = sorted(rows.collect(), key=lambda r: (r["k"] is not None, r["k"] or 0, r["id"]))
    assert got == {r["id"]: i for i, r in enumerate(order)}
    cells = rows.where("k is not null").groupBy("k").agg(F.sum("id").alias("v"))
    before = {r["k"]: r["s"] for r in ranking.sum_before(cells, "k", "v", "s", buckets=buckets).collect()}
    total = 0
    for k, v in sorted(tuple(r) for r in cells.collect()):
        assert before[k] == total
        total += v


def test_larger_tables_have_more_ranges(spark, sf):
    assert ranking._ranges(spark.range(10)) == 64 < ranking._ranges(spark.range(10**9)) < ranking._ranges(spark.range(10**10)) <= ranking.MOST_RANGES
