"""Queries: feature preprocessing, vectorisation, selection and estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import blocks, estimators, features, joins, vectorize
from .base import read
from .catalog import register

_KEY = "l_orderkey, l_linenumber"


def _scaled(spark, d, f, *args, **kw):
    out = f(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", "x", *args, **kw)
    return out.select("l_orderkey", "l_linenumber", F.round("x", 6).alias("x"))


def _over(expr: str) -> str:
    return f"""SELECT {_KEY}, round({expr}, 6) AS x FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS sd, CAST(min(l_quantity) AS DOUBLE) AS lo,
    CAST(max(l_quantity) AS DOUBLE) AS hi, max(abs(l_quantity)) AS ma, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS q2,
    quantile_cont(l_quantity, 0.75) AS q3, quantile_cont(l_quantity, 0.05) AS q05, quantile_cont(l_quantity, 0.95) AS q95 FROM lineitem)"""


@register("fp01_standard", _over("(l_quantity - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END"))
def fp01(spark, d):
    return _scaled(spark, d, features.standard)


@register("fp02_min_max", _over("(l_quantity - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END * 3 - 1"))
def fp02(spark, d):
    return _scaled(spark, d, features.min_max, -1.0, 2.0)


@register("fp03_max_abs", _over("l_quantity / CASE WHEN ma = 0 THEN 1 ELSE ma END"))
def fp03(spark, d):
    return _scaled(spark, d, features.max_abs)


@register("fp04_robust", _over("(l_quantity - q2) / CASE WHEN q3 = q1 THEN 1 ELSE q3 - q1 END"))
def fp04(spark, d):
    return _scaled(spark, d, features.robust)


@register("sc28_winsorise", _over("greatest(q05, least(q95, l_quantity))"))
def sc28(spark, d):
    return _scaled(spark, d, features.winsorise)


@register("fp05_row_normalize", "SELECT vec_id, round(list_max(list_transform(e, lambda x: x / greatest(list_sum(list_transform(e, lambda y: abs(y))), 1e-12))), 6) AS top FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def fp05(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.round(F.array_max(vx.normalized(vx.doubles(F.col("embedding")), "l1")), 6).alias("top"))


@register("fp06_binarize", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END AS x FROM lineitem")
def fp06(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", features.binarize(F.col("l_quantity"), 25.0).alias("x"))


@register("fp07_yeo_johnson", "SELECT o_orderkey, round(CASE WHEN v >= 0 THEN (pow(v + 1, 0.5) - 1) / 0.5 ELSE -(pow(1 - v, 1.5) - 1) / 1.5 END, 5) AS x FROM (SELECT o_orderkey, o_totalprice / 1000 - 100 AS v FROM orders)")
def fp07(spark, d):
    v = F.col("o_totalprice") / 1000 - 100
    return read(spark, d, "orders").select("o_orderkey", F.round(features.yeo_johnson(v, 0.5), 5).alias("x"))


@register("fp08_quantile_uniform", """WITH q AS (SELECT quantile_cont(o_totalprice, list_transform(range(11), lambda i: i / 10)) AS q FROM orders),
    b AS (SELECT o_orderkey, o_totalprice AS x, q, len(list_filter(q, lambda v: v <= o_totalprice)) AS b FROM orders, q)
    SELECT o_orderkey, round(CASE WHEN b = 0 THEN 0.0 WHEN b >= 11 THEN 1.0 ELSE (b - 1 + CASE WHEN q[b + 1] > q[b] THEN (x - q[b]) / (q[b + 1] - q[b]) ELSE 0 END) / 10 END, 6) AS x FROM b""")
def fp08(spark, d):
    out = features.quantile_uniform(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "x", 11)
    return out.select("o_orderkey", F.round("x", 6).alias("x"))


@register("fp09_polynomial", """SELECT l_orderkey, l_linenumber, 1.0 AS one, l_quantity AS a, l_tax AS b, round(l_quantity * l_quantity, 6) AS aa, round(l_quantity * l_tax, 6) AS ab, round(l_tax * l_tax, 6) AS bb FROM lineitem""")
def fp09(spark, d):
    terms = features.polynomial(["l_quantity", "l_tax"])
    names = dict(zip(terms, ("one", "a", "b", "aa", "ab", "bb")))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.round(e, 6).alias(names[t]) for t, e in terms.items()))


_HOLES = "holes AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_quantity END AS x FROM lineitem)"


def _holes(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity")).alias("x"))


@register("fp13_impute_median", f"WITH {_HOLES} SELECT l_orderkey, l_linenumber, coalesce(x, (SELECT quantile_disc(x, 0.5) FROM holes)) AS x FROM holes")
def fp13(spark, d):
    return features.impute(_holes(spark, d), "x", "median")


@register("fp13_impute_mean", f"WITH {_HOLES} SELECT l_orderkey, l_linenumber, round(coalesce(x, (SELECT avg(x) FROM holes)), 6) AS x FROM holes")
def fp13_mean(spark, d):
    return features.impute(_holes(spark, d), "x", "mean").withColumn("x", F.round("x", 6))


@register("fp13_impute_mode", f"WITH {_HOLES} SELECT l_orderkey, l_linenumber, coalesce(x, (SELECT x FROM holes WHERE x IS NOT NULL GROUP BY x ORDER BY count(*) DESC, x LIMIT 1)) AS x FROM holes")
def fp13_mode(spark, d):
    return features.impute(_holes(spark, d), "x", "mode")


@register("fp14_missing_indicator", f"WITH {_HOLES} SELECT l_orderkey, l_linenumber, coalesce(x, 0.0) AS x, CAST(x IS NULL AS INT) AS x_missing FROM holes")
def fp14(spark, d):
    return features.impute(_holes(spark, d), "x", "constant", 0.0, indicator=True)


@register("fp18_label_encode", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_type) - 1 AS code FROM part")
def fp18(spark, d):
    part = read(spark, d, "part").select("p_partkey", "p_type")
    return features.ordinal(part, "p_type", features.ordinal_codes(part, "p_type")).select("p_partkey", F.col("code").cast("long").alias("code"))


@register("fp19_binarize_labels", "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS F, CAST(o_orderstatus = 'O' AS INT) AS O, CAST(o_orderstatus = 'P' AS INT) AS P FROM orders")
def fp19(spark, d):
    out = features.one_hot(read(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s")), "s", ["F", "O", "P"])
    return out.select("o_orderkey", F.col("s_F").alias("F"), F.col("s_O").alias("O"), F.col("s_P").alias("P"))


@register("fp20_multi_label", "SELECT o_custkey, CAST(count(*) FILTER (o_orderstatus = 'F') > 0 AS INT) AS F, CAST(count(*) FILTER (o_orderstatus = 'O') > 0 AS INT) AS O FROM orders GROUP BY 1")
def fp20(spark, d):
    sets = read(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"))
    return sets.select("o_custkey", *(F.array_contains("s", v).cast("int").alias(v) for v in ("F", "O")))


@register("fp22_frequent_categories", """WITH c AS (SELECT p_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY 1)
    SELECT p_type, n, CASE WHEN n >= 10 AND r <= 5 THEN p_type ELSE 'infrequent' END AS bucket FROM c""")
def fp22(spark, d):
    return features.frequent_categories(read(spark, d, "part"), "p_type", 10, 6)


@register("fp24_target_encode", """WITH s AS (SELECT avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders), g AS (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v FROM orders GROUP BY 1)
    SELECT o_orderpriority, n, round((n * g.m + n * s.v / g.v * s.m) / (n + n * s.v / g.v), 4) AS encoding FROM g, s""")
def fp24(spark, d):
    out = features.target_means(read(spark, d, "orders"), "o_orderpriority", "o_totalprice")
    return out.withColumn("encoding", F.round("encoding", 4))


@register("ag21_target_means_fixed", "SELECT o_orderpriority, count(*) AS n, round((sum(o_totalprice) + 10 * (SELECT avg(o_totalprice) FROM orders)) / (count(*) + 10), 4) AS encoding FROM orders GROUP BY 1")
def ag21(spark, d):
    out = features.target_means(read(spark, d, "orders"), "o_orderpriority", "o_totalprice", 10.0)
    return out.withColumn("encoding", F.round("encoding", 4))


@register("fp25_bins_uniform", "SELECT o_orderkey, CAST(greatest(0, least(4, floor((o_totalprice - lo) / ((hi - lo) / 5)))) AS INT) AS bin FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)")
def fp25(spark, d):
    return features.bins_uniform(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "bin", 5).select("o_orderkey", "bin")


@register("fp25_bins_quantile", "SELECT l_orderkey, l_linenumber, CAST(len(list_filter(list_distinct(q), lambda e: e <= l_quantity)) AS INT) AS bin FROM lineitem, (SELECT quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS q FROM lineitem)")
def fp25_quantile(spark, d):
    return _scaled(spark, d, features.bins_quantile, 4).select("l_orderkey", "l_linenumber", F.col("x").cast("int").alias("bin"))


@register("fp26_merge_close", """WITH v AS (SELECT p_retailprice AS x, count(*) AS c FROM part GROUP BY 1), g AS (SELECT *, CASE WHEN x - lag(x) OVER (ORDER BY x) > 0.5 THEN 1 ELSE 0 END AS g FROM v)
    SELECT island, sum(c) AS n, round(avg(x), 6) AS mean FROM (SELECT *, sum(g) OVER (ORDER BY x) AS island FROM g) GROUP BY 1""")
def fp26(spark, d):
    return features.merge_close(read(spark, d, "part"), "p_retailprice", 0.5).withColumn("mean", F.round("mean", 6))


@register("fp31_standardise_rows", "SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / greatest(sqrt(list_sum(list_transform(e, lambda y: y * y))), 1e-12))), 5) AS total FROM (SELECT vec_id, list((x - m) / CASE WHEN s = 0 THEN 1 ELSE s END ORDER BY pos) AS e FROM (SELECT vec_id, pos, CAST(embedding[pos] AS DOUBLE) AS x, avg(CAST(embedding[pos] AS DOUBLE)) OVER (PARTITION BY pos) AS m, stddev_pop(CAST(embedding[pos] AS DOUBLE)) OVER (PARTITION BY pos) AS s FROM embeddings, range(1, 65) t(pos)) GROUP BY 1)")
def fp31(spark, d):
    df = read(spark, d, "embeddings").select("vec_id", "embedding")
    stats = features.moments_long(df, "embedding").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "mean", F.sqrt("var_pop").alias("sd")))), lambda s: F.struct(s["mean"].alias("m"), s["sd"].alias("sd"))).alias("s"))
    z = F.zip_with(vx.doubles(F.col("embedding")), F.col("s"), lambda x, s: (x - s["m"]) / F.when(s["sd"] == 0, 1.0).otherwise(s["sd"]))
    scaled = df.crossJoin(F.broadcast(stats)).select("vec_id", z.alias("z"))
    return scaled.select("vec_id", F.round(vx.total(vx.normalized(F.col("z"))), 5).alias("total"))


# ---------------------------------------------------------------- text vectors

_TOK = "regexp_extract_all(lower(text), '[A-Za-z0-9_][A-Za-z0-9_]+')"
_TF = f"tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM documents) GROUP BY 1, 2)"
_VOC = "voc AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM tf GROUP BY 1 HAVING count(*) >= 5 AND count(*) <= floor((SELECT count(*) FROM documents) * 0.5))"


def _counts(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    counts = vectorize.term_counts(docs, "doc_id", tx.tokens(F.col("text")))
    n = docs.agg(F.count("*").alias("n")).scalar()
    return counts, n, vectorize.vocabulary(counts, n, 5, 0.5)


@register("ag22_document_frequency", f"WITH {_TF}, {_VOC} SELECT term, df, total FROM voc")
def ag22(spark, d):
    return _counts(spark, d)[2]


@register("tx05_count_vectorizer", f"WITH {_TF}, {_VOC} SELECT doc_id, term, tf FROM tf WHERE term IN (SELECT term FROM voc)")
def tx05(spark, d):
    counts, _, vocab = _counts(spark, d)
    return counts.join(vocab.select("term"), "term", "left_semi")


@register("tx06_tf_idf", f"""WITH {_TF}, {_VOC}, w AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN voc USING (term))
    SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def tx06(spark, d):
    counts, n, vocab = _counts(spark, d)
    return vectorize.tf_idf(counts, vocab, n, "doc_id").withColumn("weight", F.round("weight", 6))


@register("tx02_word_ngrams", f"SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM (SELECT {_TOK} AS w FROM documents)) GROUP BY 1 HAVING count(*) >= 10")
def tx02(spark, d):
    grams = read(spark, d, "documents").select(F.explode(tx.ngrams(tx.tokens(F.col("text")), 2, 2)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n")).where("n >= 10")


@register("tx03_char_ngrams", "SELECT gram, count(*) AS n FROM (SELECT unnest(list_concat(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3)), list_transform(range(1, length(t) - 2), lambda i: substring(t, i, 4)))) AS gram FROM (SELECT text AS t FROM benchmark)) GROUP BY 1")
def tx03(spark, d):
    grams = read(spark, d, "benchmark").select(F.explode(tx.char_ngrams(F.col("text"), 3, 4)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


@register("tx07_hashing")
def tx07(spark, d):
    return vectorize.hashed(_counts(spark, d)[0], "doc_id", 1 << 12)


@register("tx11_dict_vectorize", "SELECT event_id, CASE k WHEN 'value' THEN 'value' ELSE 'type=' || event_type END AS feature, CASE k WHEN 'value' THEN value ELSE 1.0 END AS value FROM events, (SELECT unnest(['value', 'type']) AS k)")
def tx11(spark, d):
    entries = F.create_map(F.lit("value"), F.col("value").cast("string"), F.lit("type"), F.col("event_type"))
    return vectorize.dict_vectorize(read(spark, d, "events"), "event_id", entries)


@register("ag24_class_keywords", f"SELECT lang, term, n, rank FROM (SELECT lang, term, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, term) AS rank FROM (SELECT lang, unnest({_TOK}) AS term FROM documents) GROUP BY 1, 2) WHERE rank <= 5")
def ag24(spark, d):
    langs = F.when(F.col("lang") == "", -1).otherwise(F.xxhash64("lang").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)))
    docs = read(spark, d, "documents").withColumn("cluster", langs)
    names = docs.select("cluster", "lang").distinct()
    top = vectorize.keywords(docs, "cluster", tx.tokens(F.col("text")), 5)
    return top.join(names, "cluster").select("lang", "term", "n", F.col("rank").cast("long").alias("rank"))


# ---------------------------------------------------------------- selection and estimators

_LONG = "v AS (SELECT vec_id, label, CAST(pos - 1 AS INT) AS pos, CAST(embedding[pos] AS DOUBLE) AS x FROM embeddings, range(1, 65) t(pos))"


@register("cv16_anova_f", f"""WITH {_LONG}, g AS (SELECT pos, label, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM v GROUP BY 1, 2),
    a AS (SELECT pos, sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b, count(*) AS k FROM g GROUP BY 1) SELECT pos, round(((b - s * s / n) / (k - 1)) / ((q - b) / (n - k)), 5) AS f FROM a""")
def cv16(spark, d):
    return features.anova_f(read(spark, d, "embeddings"), "embedding", "label").withColumn("f", F.round("f", 5))


@register("cv16_pearson", f"WITH {_LONG} SELECT pos, round(corr(x, CAST(label AS DOUBLE)), 6) AS r FROM v GROUP BY 1")
def cv16_r(spark, d):
    return features.pearson(read(spark, d, "embeddings"), "embedding", "label").withColumn("r", F.round("r", 6))


@register("cv16_chi2", f"""WITH {_LONG}, o AS (SELECT pos, label, sum(greatest(x, 0.0)) AS o, count(*) AS c FROM v GROUP BY 1, 2), e AS (SELECT *, sum(o) OVER (PARTITION BY pos) * c / sum(c) OVER (PARTITION BY pos) AS e FROM o)
    SELECT pos, round(sum((o - e) * (o - e) / e), 5) AS chi2 FROM e GROUP BY 1""")
def cv16_chi2(spark, d):
    return features.chi2(read(spark, d, "embeddings"), "embedding", "label").withColumn("chi2", F.round("chi2", 5))


@register("cv18_select_k_best", f"""WITH {_LONG} SELECT pos, round(abs(corr(x, CAST(label AS DOUBLE))), 6) AS r FROM v GROUP BY 1 ORDER BY r DESC, pos LIMIT 10""")
def cv18(spark, d):
    r = features.pearson(read(spark, d, "embeddings"), "embedding", "label").select("pos", F.round(F.abs("r"), 6).alias("r"))
    return features.select_top(r, "r", 10)


@register("cv19_variance_threshold", f"WITH {_LONG} SELECT pos, count(x) AS n, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var_pop FROM v GROUP BY 1 HAVING var_pop(x) >= 0.02")
def cv19(spark, d):
    m = features.moments_long(read(spark, d, "embeddings"), "embedding").where("var_pop >= 0.02")
    return m.select("pos", "n", F.round("mean", 6).alias("mean"), F.round("var_pop", 6).alias("var_pop"))


@register("ex05_covariance", f"WITH {_LONG} SELECT a.pos AS i, b.pos AS j, round(covar_pop(a.x, b.x), 6) AS cov FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.pos <= b.pos WHERE a.pos < 6 AND b.pos < 6 GROUP BY 1, 2")
def ex05(spark, d):
    return features.covariance(read(spark, d, "embeddings"), "embedding", 6).withColumn("cov", F.round("cov", 6))


@register("ex06_shrunk_covariance", f"""WITH {_LONG}, c AS (SELECT a.pos AS i, b.pos AS j, covar_pop(a.x, b.x) AS cov FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.pos <= b.pos WHERE a.pos < 6 AND b.pos < 6 GROUP BY 1, 2)
    SELECT i, j, round(0.9 * cov + CASE WHEN i = j THEN 0.1 * (SELECT sum(cov) / 6 FROM c WHERE i = j) ELSE 0 END, 6) AS cov FROM c""")
def ex06(spark, d):
    return features.shrunk(features.covariance(read(spark, d, "embeddings"), "embedding", 6), 6).withColumn("cov", F.round("cov", 6))


_D = "sqrt(list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
_NEAR = f"near AS (SELECT * FROM (SELECT a.vec_id AS query, b.vec_id AS point, b.label, {_D} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_D}, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND b.vec_id % 50 <> 0) WHERE r <= 7)"


def _split(spark, d):
    e = read(spark, d, "embeddings")
    return e.where("vec_id % 50 = 0"), e.where("vec_id % 50 != 0")


@register("ex01_knn_classify", f"WITH {_NEAR}, t AS (SELECT query, label, count(*) AS n FROM near GROUP BY 1, 2) SELECT query, label AS predicted FROM t QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, label) = 1")
def ex01(spark, d):
    return estimators.knn_classify(*_split(spark, d), "vec_id", "embedding", "label", 7)


@register("ex01_knn_regress", f"WITH {_NEAR} SELECT query, round(avg(label), 6) AS predicted FROM near GROUP BY 1")
def ex01_r(spark, d):
    return estimators.knn_regress(*_split(spark, d), "vec_id", "embedding", "label", 7).withColumn("predicted", F.round("predicted", 6))


@register("ex02_radius_regress", f"SELECT a.vec_id AS query, round(avg(b.label), 6) AS predicted, count(*) AS n FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND b.vec_id % 50 <> 0 AND {_D} <= 1.3 GROUP BY 1")
def ex02(spark, d):
    return estimators.radius_regress(*_split(spark, d), "vec_id", "embedding", "label", 1.3).withColumn("predicted", F.round("predicted", 6))


@register("ex03_nearest_centroid", """WITH c AS (SELECT label, list(x ORDER BY pos) AS embedding FROM (SELECT label, pos, avg(CAST(embedding[pos] AS DOUBLE)) AS x FROM embeddings, range(1, 65) t(pos) GROUP BY 1, 2) GROUP BY 1)
    SELECT a.vec_id, arg_min(b.label, """ + _D + """) AS predicted FROM embeddings a, c b GROUP BY 1""")
def ex03(spark, d):
    df = read(spark, d, "embeddings")
    return joins.nearest_centroid(df, "vec_id", "embedding", joins.centroids(df, "label", "embedding"), "label").select("vec_id", "predicted")


@register("ex04_outlier_factor", f"""WITH nn AS (SELECT * FROM (SELECT a.vec_id AS q, b.vec_id AS p, {_D} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_D}, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id) WHERE r <= 10),
    k AS (SELECT q, max(d) AS kd FROM nn GROUP BY 1), l AS (SELECT nn.q, 1 / (avg(greatest(kd, d)) + 1e-10) AS lrd FROM nn JOIN k ON k.q = nn.p GROUP BY 1)
    SELECT nn.q AS query, round(avg(o.lrd) / any_value(l.lrd), 5) AS lof FROM nn JOIN l o ON o.q = nn.p JOIN l ON l.q = nn.q GROUP BY 1""")
def ex04(spark, d):
    return estimators.outlier_factor(read(spark, d, "embeddings"), "vec_id", "embedding", 10).select("query", F.round("lof", 5).alias("lof"))


@register("ex07_majority", "SELECT label, round(n / sum(n) OVER (), 6) AS share FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) QUALIFY row_number() OVER (ORDER BY n DESC, label) = 1")
def ex07(spark, d):
    return estimators.majority(read(spark, d, "embeddings"), "label").withColumn("share", F.round("share", 6))


@register("ex08_best_threshold", """WITH p AS (SELECT quality AS y, CAST(floor(least(length(text), 4999) / 5000.0 * 100) AS INT) AS c FROM labels JOIN documents USING (doc_id)),
    g AS (SELECT t, coalesce(2.0 * sum(y) FILTER (c >= t) / (count(*) FILTER (c >= t) + sum(y)), 0) AS f1 FROM p, range(101) r(t) GROUP BY 1)
    SELECT t / 100 AS threshold, round(f1, 6) AS f1 FROM g ORDER BY f1 DESC, t LIMIT 1""")
def ex08(spark, d):
    docs = read(spark, d, "documents").select("doc_id", (F.least(F.length("text"), F.lit(4999)) / 5000.0).alias("s"))
    rows = read(spark, d, "labels").select("doc_id", F.col("quality").alias("y")).join(docs, "doc_id")
    return estimators.best_threshold(rows, "y", "s").withColumn("f1", F.round("f1", 6))


@register("ex09_isotonic", """WITH a AS (SELECT CAST(l_quantity AS INT) AS x, sum(l_extendedprice) AS s, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT *, sum(s) OVER (ORDER BY x) AS cs, sum(n) OVER (ORDER BY x) AS cn FROM a),
    m AS (SELECT a.x AS i, b.x AS j, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS m FROM p a JOIN p b ON b.x >= a.x), l AS (SELECT i, j, min(m) OVER (PARTITION BY i ORDER BY j DESC) AS low FROM m)
    SELECT j AS x, round(max(low), 3) AS fit FROM l GROUP BY 1""")
def ex09(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_quantity").cast("int").alias("x"), "l_extendedprice")
    return estimators.isotonic(rows, "x", "l_extendedprice").withColumn("fit", F.round("fit", 3))


@register("ex10_core_points", f"SELECT a.vec_id AS query, count(*) AS n, count(*) >= 5 AS core FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND {_D} <= 1.2 GROUP BY 1")
def ex10(spark, d):
    points = read(spark, d, "embeddings")
    return estimators.core_points(points.where("vec_id % 50 = 0"), points, "vec_id", "embedding", 1.2, 5)


@register("ex11_kmeans_step", """WITH c AS (SELECT label, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
    g AS (SELECT a.vec_id, arg_min(b.label, """ + _D + """) AS cluster FROM embeddings a, c b GROUP BY 1)
    SELECT cluster, CAST(pos - 1 AS INT) AS pos, round(avg(CAST(embedding[pos] AS DOUBLE)), 6) AS x FROM g JOIN embeddings USING (vec_id), range(1, 65) t(pos) GROUP BY 1, 2""")
def ex11(spark, d):
    df = read(spark, d, "embeddings")
    start = df.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c")).select("label", vx.doubles(F.col("c")).alias("centroid"))
    step = estimators.kmeans_step(df, "vec_id", "embedding", start)
    return step.select("cluster", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


_METRICS = {
    "manhattan": "list_sum(list_transform(z, lambda p: abs(p[1] - p[2])))",
    "chebyshev": "list_max(list_transform(z, lambda p: abs(p[1] - p[2])))",
    "canberra": "list_sum(list_transform(z, lambda p: CASE WHEN abs(p[1]) + abs(p[2]) = 0 THEN 0 ELSE abs(p[1] - p[2]) / (abs(p[1]) + abs(p[2])) END))",
    "cosine": "1 - list_sum(list_transform(z, lambda p: p[1] * p[2])) / sqrt(list_sum(list_transform(z, lambda p: p[1] * p[1]))) / sqrt(list_sum(list_transform(z, lambda p: p[2] * p[2])))",
    "braycurtis": "list_sum(list_transform(z, lambda p: abs(p[1] - p[2]))) / list_sum(list_transform(z, lambda p: abs(p[1] + p[2])))",
}


@register("cv21_distances", f"SELECT query, point, {', '.join(f'round({e}, 5) + 0.0 AS {m}' for m, e in _METRICS.items())} FROM (SELECT a.vec_id AS query, b.vec_id AS point, list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS z FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)")
def cv21(spark, d):
    e = read(spark, d, "embeddings")
    return blocks.metric_table(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", list(_METRICS))
