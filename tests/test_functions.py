"""Worked values of the expressions and edge cases of the operators."""

import pytest
from pyspark.sql import functions as F

from textmill.functions import labels as lb
from textmill.functions import text as tx
from textmill.functions import vectors as vx
from textmill.operators import estimators, features, joins, ranking, stats, tables, windows
from textmill.sources import files


def values(df, column="x"):
    return [r[column] for r in df.collect()]


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,want", [(None, 0), ("Positive", 1), ("NEG", 0), ("neu", 2), ("7", 7), ("abc", 0), (" yes ", 1), ("2.9", 2), ("inf", 0)])
def test_coerce_string(spark, raw, want):
    assert one(spark, lb.coerce_string(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw,want", [(None, 0), (2.0, 2), (2.5, 0), (float("nan"), 0), (float("inf"), 0), (-1.0, -1)])
def test_coerce_number(spark, raw, want):
    assert one(spark, lb.coerce_number(F.lit(raw).cast("double"))) == want


@pytest.mark.parametrize("raw,want", [("pos", 1), ("yes", None), ("2", 2), ("x", None), (None, None)])
def test_sentiment_id(spark, raw, want):
    assert one(spark, lb.sentiment_id(F.lit(raw).cast("string"))) == want


def test_normalize(spark):
    plain = [one(spark, lb.normalize(F.lit(y), 3)) for y in (-1, 0, 2, 3, 6, 7, 13, 14)]
    assert plain == [None, 0, 2, 0, 0, 1, 1, 2]
    star = [one(spark, lb.normalize(F.lit(y), 3, F.lit("yelp_review"))) for y in (1, 2, 3, 4, 5, 6, 7, 10, 11)]
    assert star[:8] == [1, 2, 1, 2, 2, 1, 2, 2] and star[8] is None
    two = [one(spark, lb.normalize(F.lit(y), 2)) for y in (0, 1, 2, 5, 10, 15)]
    assert two == [0, 1, None, 0, 1, None]


def test_column_inference():
    assert lb.text_column(["id", "Tweet", "review_text"]) == "Tweet"
    assert lb.text_column(["id", "my_review"]) == "my_review"
    assert lb.label_column(["x", "sentiment_value", "label"]) == "label"
    assert lb.feature_column(["a", "embedding"]) == "embedding"
    assert lb.text_column(["a"]) is None


def test_clean(spark):
    assert one(spark, tx.clean(F.lit("<b>WOW!!!</b> ok?! see http://a.b/c @me é"))) == "wow! ok! see"
    assert one(spark, tx.clean(F.lit(None).cast("string"))) == ""
    assert one(spark, tx.clean_full(F.lit("A &amp; B"))) == "a & b"
    assert one(spark, tx.clean_code(F.lit("a ```x\ny``` b `c` d"))) == "a b d"


def test_words_of_blank(spark):
    assert one(spark, F.size(tx.words(F.lit("  ")))) == 0
    assert one(spark, tx.ngrams(tx.words(F.lit("a b c")), 1, 2)) == ["a", "b", "c", "a b", "b c"]
    assert one(spark, tx.ngrams(tx.words(F.lit("a")), 2, 3)) == []
    assert one(spark, tx.char_ngrams(F.lit("abcd"), 3, 3)) == ["abc", "bcd"]


def test_slug(spark):
    assert one(spark, tx.slug(F.lit(" a/b c! "))) == "a_b_c"
    assert one(spark, tx.slug(F.lit("***"))) == "unknown"


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vx.distance(a, b)) == 5.0
    assert one(spark, vx.distance(a, b, "manhattan")) == 7.0
    assert one(spark, vx.normalized(b)) == [0.0, 0.0]
    assert one(spark, vx.resized(a, 3)) == [3.0, 4.0, 0.0]
    assert one(spark, vx.resized(F.array().cast("array<double>"), 3)) is None
    assert one(spark, vx.argmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0)))) == 1
    assert one(spark, vx.top_k_gate(F.array(F.lit(0.0), F.lit(1.0), F.lit(1.0)), 2)) == [0.0, 0.5, 0.5]
    with pytest.raises(ValueError):
        vx.distance(a, b, "none")


def test_scalers(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (4.0,)], "v double")
    assert [round(x, 4) for x in values(features.standard(df, "v", "x").orderBy("v"))] == [-1.2247, 0.0, 1.2247]
    flat = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert values(features.min_max(flat, "v", "x", 1.0, 2.0)) == [1.0, 1.0]
    assert values(features.standard(flat, "v", "x")) == [0.0, 0.0]


def test_impute(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "v double")
    assert sorted(values(features.impute(df, "v", "median"), "v")) == [1.0, 2.0, 2.0, 3.0, 10.0]
    empty = spark.createDataFrame([(None,)], "v double")
    assert values(features.impute(empty, "v", "mean"), "v") == [0.0]


def test_terciles(spark):
    df = spark.range(8).select(F.col("id").alias("k"), F.col("id").alias("v"))
    found = values(ranking.terciles(df, "v", ["k"]).orderBy("v"), "tercile")
    assert found == ["negative"] * 3 + ["neutral"] * 2 + ["positive"] * 3


def test_row_index_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(None, 9), (1.0, 2), (1.0, 1), (5.0, 0)], "k double, t int")
    got = ranking.row_index(df, "k", ["t"]).orderBy("row_index").collect()
    assert [(r["k"], r["t"]) for r in got] == [(None, 9), (1.0, 1), (1.0, 2), (5.0, 0)]
    assert ranking.row_index(df.limit(0), "k").count() == 0


def test_zip_join_rejects(spark):
    a, b = spark.range(3).toDF("a"), spark.range(4).toDF("b")
    assert joins.zip_join(a, b, "a", "b").count() == 3
    with pytest.raises(ValueError):
        joins.zip_join(a, b, "a", "b", strict=True)
    with pytest.raises(ValueError):
        joins.zip_join(a, a, "a", "a")


def test_metrics_with_one_class(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "y int, p int")
    row = stats.metric_bundle(df, "y", "p").first()
    assert row["accuracy"] == 1.0 and row["mcc"] == 0.0 and row["kappa"] == 0.0
    assert stats.auc(df.withColumn("s", F.lit(0.5)), "y", "s").first()["auc"] is None


def test_union_wants_same_columns(spark):
    with pytest.raises(ValueError):
        tables.union_all([spark.range(1).toDF("a"), spark.range(1).toDF("b")])


def test_numeric_if_parsed(spark):
    df = spark.createDataFrame([("1",), ("2",), ("x",)], "v string")
    assert tables.numeric_if_parsed(df, "v")[1] is False
    assert tables.numeric_if_parsed(df.where("v != 'x'"), "v")[1] is True


def test_best_threshold_separates(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, s double")
    row = estimators.best_threshold(df, "y", "s").first()
    assert row["f1"] == 1.0 and 0.2 < row["threshold"] <= 0.8


def test_first_of_frequent_keeps_one(spark):
    df = spark.createDataFrame([(1, 0, "a"), (2, 0, "a"), (3, 0, "a"), (3, 1, "b")], "d int, n int, line string")
    assert sorted(values(windows.first_of_frequent(df, "line", ["d", "n"]), "line")) == ["a", "b"]


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, " a "), (2, "b/c"), (3, None)], "i int, s string")
    path = str(tmp_path / "t.parquet")
    assert files.write_checked(df, path) == 3
    assert files.write_checked(df.limit(2), path) == 2
    assert files.load(spark, path).count() == 2
    stems = files.write_split(df, str(tmp_path / "split"), "s")
    assert {(r["slug"], r["original"]) for r in stems.collect()} == {("a", "a"), ("b_c", "b/c")}
    with pytest.raises(ValueError):
        files.write_split(spark.createDataFrame([("a b",), ("a_b",)], "s string"), str(tmp_path / "clash"), "s")
    with pytest.raises(ValueError):
        files.load_named(spark, "nowhere", path)
    df.coalesce(1).write.option("header", True).csv(str(tmp_path / "t.csv"))
    assert files.load(spark, str(tmp_path / "t.csv")).columns == ["i", "s"]
    assert files.discover(spark, str(tmp_path / "t.parquet")).count() >= 1
