"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from textmill.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf, t)}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return round(float(v), 6) if type(v).__name__ == "Decimal" else v


def rows_of(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    assert len(set(names)) == len(names)
    cursor = duck.execute(SQL[name])
    order = [c[0] for c in cursor.description]
    assert sorted(order) == names
    expected = rows_of([r[order.index(c)] for c in names] for r in cursor.fetchall())
    assert rows_of([r[c] for c in names] for r in df.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nulls_come_last_in_the_whole_table(spark, sf):
    x = [r["x"] for r in QUERIES["sl01_nulls_last"](spark, sf).collect()]
    values = [v for v in x if v is not None]
    assert len(x) == spark.read.parquet(f"{sf}/lineitem.parquet").count() and len(values) < len(x)
    assert x == sorted(values, reverse=True) + [None] * (len(x) - len(values))


def test_every_embedding_has_an_outlier_factor(spark, sf):
    ids = {r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    assert {r["query"] for r in QUERIES["ex04_outlier_factor"](spark, sf).collect()} == ids and len(ids) > 300


def test_summaries_keep_quotes_at_their_ends(spark, tmp_path):
    texts = ["", '"', '""', '"a', 'he said "no"', 'two ""', '""', 'a\n"b"', "é" * 299 + '""', "x\r\n \u0301\U0001f600", 'no """ here', None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = rows_of(QUERIES["hp13_doc_summary"](spark, str(tmp_path)).collect())
    assert got == rows_of(con.execute(SQL["hp13_doc_summary"]).fetchall()) and len(got) == len(texts) - 2


def odd_vectors(spark, folder, width=8):
    """Copies, ties, zeros, missing elements and vectors, other widths, no numbers."""
    plain_ = [[((i * 37 + j * 11) % 23 - 11) / 8 for j in range(width)] for i in range(150)]
    odd = [plain_[0]] * 15 + [[0.0] * width, [0.0] * width, None, None, [], plain_[3][:5], [None] * width, [None, *plain_[4][1:]], [float("nan"), *plain_[5][1:]], [1e30] * width, [1000.0 + x for x in plain_[7]]]
    rows = list(enumerate(odd + plain_))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5).write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet')")
    return con


@pytest.mark.parametrize("name", ["cv21_distances", "ex04_outlier_factor"])
def test_odd_vectors_match_duckdb(name, spark, tmp_path):
    con = odd_vectors(spark, tmp_path)
    df = QUERIES[name](spark, str(tmp_path))
    cursor = con.execute(SQL[name])
    assert [c[0] for c in cursor.description] == df.columns
    assert rows_of(df.collect()) == rows_of(cursor.fetchall())


def test_odd_token_sets_match_duckdb(spark, tmp_path):
    """Sets at the threshold and just below, of all small sizes; copies, blanks and a common word."""
    word = lambda i, j: f"w{i}x{j}"
    texts = ["", " \t", None, "a", "A a", "the b"]
    for n in [*range(8, 48), 100, 190, 400]:
        base = ["the", *(word(n, j) for j in range(n - 1))]
        d = max(1, n // 9)
        texts += [" ".join(base), " ".join(reversed(base)), " ".join(base[d:]), " ".join([*base, *(word("y", j) for j in range(d))]), " ".join(base[:-1] + ["other"]), " ".join(base[d + 1 :])]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = rows_of(QUERIES["jn17_jaccard_pairs"](spark, str(tmp_path)).collect())
    assert got == rows_of(con.execute(SQL["jn17_jaccard_pairs"]).fetchall()) and len(got) > 200
