"""Queries: profiles, counts, metrics and whole-table operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import text as tx
from ..operators import stats, tables
from .base import SPACE, read
from .catalog import register

_WORDS = f"len(list_filter(string_split(trim(regexp_replace(text, '{SPACE}', ' ', 'g')), ' '), lambda w: w <> ''))"


@register("ag01_count_by_stem", "SELECT coalesce(trim(source), '__null__') AS source, count(*) AS n FROM documents GROUP BY 1")
def ag01(spark, d):
    return stats.count_by(read(spark, d, "documents"), "source")


_AG02 = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS null_count, {f'CAST(min({c}) AS DOUBLE)' if num else 'CAST(NULL AS DOUBLE)'} AS "min",
    {f'CAST(max({c}) AS DOUBLE)' if num else 'CAST(NULL AS DOUBLE)'} AS "max", {f'round(avg({c}), 6)' if num else 'CAST(NULL AS DOUBLE)'} AS mean,
    {'CAST(NULL AS BIGINT)' if num else f'count(DISTINCT {c})'} AS n_unique, round((count(*) - count({c})) / count(*), 6) AS null_rate FROM customer"""
    for c, num in (("c_custkey", True), ("c_name", False), ("c_nationkey", True), ("c_acctbal", True), ("c_mktsegment", False))
)


@register("ag02_null_profile", _AG02)
def ag02(spark, d):
    return stats.null_profile(read(spark, d, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])


@register(
    "ag03_text_length_stats",
    f"""SELECT min(c) AS char_min, max(c) AS char_max, round(avg(c), 6) AS char_mean, round(stddev_samp(c), 6) AS char_std,
    round(avg(w), 6) AS word_mean, max(w) AS word_max, count(*) FILTER (c = 0) AS n_empty, round(quantile_cont(c, 0.5), 6) AS char_p50,
    round(quantile_cont(c, 0.9), 6) AS char_p90, round(quantile_cont(c, 0.95), 6) AS char_p95, round(quantile_cont(c, 0.99), 6) AS char_p99
    FROM (SELECT length(text) AS c, {_WORDS} AS w FROM documents)""",
)
def ag03(spark, d):
    return stats.length_profile(read(spark, d, "documents"), "text")


def _star(spark, d):
    """Quantities as star-like scores under three stems."""
    stem = F.when(F.col("l_linenumber") % 3 == 0, "yelp_review").when(F.col("l_linenumber") % 3 == 1, "tweets").otherwise("imdb")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") % 18 - 1).alias("score"), stem.alias("stem"))


_STAR = """star AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) % 18 - 1 AS score,
  CASE l_linenumber % 3 WHEN 0 THEN 'yelp_review' WHEN 1 THEN 'tweets' ELSE 'imdb' END AS stem FROM lineitem)"""
_REMAP = "CASE WHEN score <= 2 THEN score WHEN score = 3 THEN 1 WHEN score BETWEEN 4 AND 5 THEN 2 WHEN score = 6 THEN 1 WHEN score BETWEEN 7 AND 10 THEN 2 END"
_THREE = f"""three AS (SELECT *, CASE WHEN y < 0 THEN NULL WHEN y <= 2 THEN y WHEN y < 7 THEN 0 WHEN y < 14 THEN 1 WHEN y >= 14 THEN 2 END AS y3
  FROM (SELECT *, CASE WHEN stem = 'yelp_review' THEN {_REMAP} ELSE score END AS y FROM star))"""
_TWO = "CASE WHEN score IN (0, 1) THEN score WHEN score = 2 THEN NULL WHEN y3 IN (0, 1) THEN y3 END"


@register("pf08_normalize_3", f"WITH {_STAR}, {_THREE} SELECT l_orderkey, l_linenumber, CAST(y3 AS INT) AS label FROM three WHERE y3 IS NOT NULL")
def pf08(spark, d):
    rows = _star(spark, d)
    return rows.select("l_orderkey", "l_linenumber", lb.normalize(F.col("score"), 3, F.col("stem")).alias("label")).where("label is not null")


@register("pf08_normalize_2", f"WITH {_STAR}, {_THREE} SELECT l_orderkey, l_linenumber, CAST({_TWO} AS INT) AS label FROM three WHERE ({_TWO}) IS NOT NULL")
def pf08_two(spark, d):
    rows = _star(spark, d)
    return rows.select("l_orderkey", "l_linenumber", lb.normalize(F.col("score"), 2, F.col("stem")).alias("label")).where("label is not null")


@register("pf07_star_remap", f"WITH {_STAR} SELECT l_orderkey, l_linenumber, {_REMAP} AS remapped FROM star WHERE stem = 'yelp_review'")
def pf07(spark, d):
    return _star(spark, d).where("stem = 'yelp_review'").select("l_orderkey", "l_linenumber", lb.star_remap(F.col("score")).cast("int").alias("remapped"))


_RAW = "['Positive','NEG','neu',' yes ','No','7','2.5','abc','-3','1e2']"


def _raw(spark, d):
    names = F.array(*(F.lit(x) for x in ("Positive", "NEG", "neu", " yes ", "No", "7", "2.5", "abc", "-3", "1e2")))
    value = F.when(F.col("l_linenumber") == 7, None).otherwise(F.get(names, ((F.col("l_orderkey") + F.col("l_linenumber")) % 10).cast("int")))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", value.alias("raw"))


_RAWSQL = f"raw AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE {_RAW}[(l_orderkey + l_linenumber) % 10 + 1] END AS raw FROM lineitem)"


@register(
    "pf05_coerce_label",
    f"""WITH {_RAWSQL} SELECT l_orderkey, l_linenumber, CAST(CASE WHEN lower(trim(raw)) IN ('positive','pos','1','yes') THEN 1
    WHEN lower(trim(raw)) IN ('negative','neg','0','no') THEN 0 WHEN lower(trim(raw)) IN ('neutral','neu','2') THEN 2
    WHEN TRY_CAST(trim(raw) AS DOUBLE) IS NOT NULL THEN trunc(TRY_CAST(trim(raw) AS DOUBLE)) ELSE 0 END AS BIGINT) AS label FROM raw""",
)
def pf05(spark, d):
    return _raw(spark, d).select("l_orderkey", "l_linenumber", lb.coerce_string(F.col("raw")).alias("label"))


@register(
    "pf06_sentiment_id",
    f"""WITH {_RAWSQL} SELECT l_orderkey, l_linenumber, CAST(CASE WHEN lower(trim(raw)) IN ('positive','pos','1') THEN 1
    WHEN lower(trim(raw)) IN ('negative','neg','0') THEN 0 WHEN lower(trim(raw)) IN ('neutral','neu','2') THEN 2
    WHEN TRY_CAST(trim(raw) AS DOUBLE) = trunc(TRY_CAST(trim(raw) AS DOUBLE)) THEN TRY_CAST(trim(raw) AS DOUBLE) END AS BIGINT) AS label FROM raw""",
)
def pf06(spark, d):
    return _raw(spark, d).select("l_orderkey", "l_linenumber", lb.sentiment_id(F.col("raw")).alias("label"))


@register("pf09_negative_rows", f"WITH {_RAWSQL} SELECT l_orderkey, l_linenumber FROM raw WHERE lower(trim(raw)) IN ('positive','pos','1','negative','neg','0')")
def pf09(spark, d):
    return _raw(spark, d).where(lb.sentiment_id(F.col("raw")).isin(0, 1)).select("l_orderkey", "l_linenumber")


@register("ag04_label_histogram", f"WITH {_STAR}, {_THREE} SELECT CAST(coalesce(y3, -1) AS INT) AS label, count(*) AS n FROM three GROUP BY 1")
def ag04(spark, d):
    return tables.normalized_histogram(_star(spark, d), F.col("score"), 3, F.col("stem"))


@register("ag05_top_values", "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 20")
def ag05(spark, d):
    return tables.value_counts(read(spark, d, "documents"), "source", 20)


@register("ag06_label_by_stem", "SELECT d.source, l.quality, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1, 2")
def ag06(spark, d):
    joined = read(spark, d, "documents").select("doc_id", "source").join(read(spark, d, "labels"), "doc_id", "left")
    return tables.label_counts(joined, "source", "quality")


@register("label_profile_by_source", """SELECT d.source, count(*) AS n, count(l.quality) AS labelled, round(1 - count(l.quality) / count(*), 6) AS null_rate,
    round(avg(length(text)), 6) AS char_mean, round(quantile_cont(length(text), 0.5), 6) AS char_p50 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""")
def label_profile(spark, d):
    joined = read(spark, d, "documents").select("doc_id", "source", F.length("text").alias("c")).join(read(spark, d, "labels"), "doc_id", "left")
    n = F.count("*")
    return joined.groupBy("source").agg(
        n.alias("n"), F.count("quality").alias("labelled"), F.round(1 - F.count("quality") / n, 6).alias("null_rate"),
        F.round(F.avg("c"), 6).alias("char_mean"), F.round(F.percentile("c", F.lit(0.5)), 6).alias("char_p50"),
    )


@register("ag07_duplicate_rate", "SELECT count(*) AS n, round(1 - count(DISTINCT concat_ws(chr(0), text, lang)) / count(*), 6) AS rate FROM documents")
def ag07(spark, d):
    return stats.duplicate_rate(read(spark, d, "documents"), ["text", "lang"])


@register("ag08_pivot_sum", "SELECT l_returnflag, coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0) AS F, coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0) AS O FROM lineitem GROUP BY 1")
def ag08(spark, d):
    return tables.pivot_sum(read(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"], "l_quantity")


@register("ag09_count_sum_by_segment", "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def ag09(spark, d):
    return read(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@register("ag10_conditional_sum", "SELECT event_type, count(*) AS n, round(sum(CASE WHEN value > 50 THEN value ELSE 0 END), 3) AS big FROM events GROUP BY 1")
def ag10(spark, d):
    big = F.when(F.col("value") > 50, F.col("value")).otherwise(0.0)
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(big), 3).alias("big"))


@register("ag11_conditional_counts", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus <> 'F') AS other FROM orders GROUP BY 1")
def ag11(spark, d):
    ok = F.col("o_orderstatus") == "F"
    return read(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("other"))


@register("ag12_row_min", "SELECT l_orderkey, l_linenumber, least(l_discount, l_tax) AS low FROM lineitem")
def ag12(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.least("l_discount", "l_tax").alias("low"))


_PRED = """pred AS (SELECT l.doc_id, l.quality AS y, CASE WHEN length(d.text) > 1000 THEN 1 ELSE 0 END AS p, least(length(d.text), 5000) / 5000.0 AS s
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def _pred(spark, d):
    """Labels with a rule's prediction and score: longer texts are better."""
    n = F.length("text")
    docs = read(spark, d, "documents").select("doc_id", (n > 1000).cast("int").alias("p"), (F.least(n, F.lit(5000)) / 5000.0).alias("s"))
    return read(spark, d, "labels").select("doc_id", F.col("quality").alias("y")).join(docs, "doc_id")


@register("ag13_confusion", f"""WITH {_PRED} SELECT CAST(a.r AS INT) AS y, CAST(b.r AS INT) AS p, count(pred.y) AS n FROM range(2) a(r) CROSS JOIN range(2) b(r)
    LEFT JOIN pred ON pred.y = a.r AND pred.p = b.r GROUP BY 1, 2""")
def ag13(spark, d):
    return stats.confusion(_pred(spark, d), "y", "p", 2)


_AG14 = f"""WITH {_PRED}, k AS (SELECT DISTINCT unnest([y, p]) AS k FROM pred),
  per AS (SELECT k, count(*) FILTER (y = k AND p = k) AS tp, count(*) FILTER (y = k) AS t, count(*) FILTER (p = k) AS q FROM pred, k GROUP BY k),
  m AS (SELECT *, CASE WHEN q > 0 THEN tp / q ELSE 0 END AS pr, CASE WHEN t > 0 THEN tp / t ELSE 0 END AS re, 2 * tp / (t + q) AS f1, tp / (t + q - tp) AS ja FROM per),
  s AS (SELECT sum(t) AS n, sum(tp) AS tp, sum(t * q) AS tq, sum(t * t) AS tt, sum(q * q) AS qq, avg(re) FILTER (t > 0) AS ba,
    avg(pr) AS prm, avg(re) AS rem, avg(f1) AS f1m, avg(ja) AS jam, sum(pr * t) / sum(t) AS prw, sum(re * t) / sum(t) AS rew, sum(f1 * t) / sum(t) AS f1w, sum(ja * t) / sum(t) AS jaw FROM m)
  SELECT CAST(n AS BIGINT) AS n_samples, round(tp / n, 6) AS accuracy, round(ba, 6) AS balanced_accuracy, round(1 - tp / n, 6) AS hamming_loss,
    round(CASE WHEN tq = n * n THEN 0 ELSE (tp / n - tq / (n * n)) / (1 - tq / (n * n)) END, 6) AS kappa,
    round(coalesce((tp * n - tq) / nullif(sqrt((n * n - tt) * (n * n - qq)), 0), 0), 6) AS mcc,
    round(prm, 6) AS precision_macro, round(prw, 6) AS precision_weighted, round(rem, 6) AS recall_macro, round(rew, 6) AS recall_weighted,
    round(f1m, 6) AS f1_macro, round(f1w, 6) AS f1_weighted, round(jam, 6) AS jaccard_macro, round(jaw, 6) AS jaccard_weighted,
    round(tp / n, 6) AS precision_micro, round(tp / n, 6) AS recall_micro, round(tp / n, 6) AS f1_micro, round(tp / (2 * n - tp), 6) AS jaccard_micro
  FROM (SELECT CAST(n AS DOUBLE) AS n, CAST(tp AS DOUBLE) AS tp, CAST(tq AS DOUBLE) AS tq, CAST(tt AS DOUBLE) AS tt, CAST(qq AS DOUBLE) AS qq, * EXCLUDE (n, tp, tq, tt, qq) FROM s)"""


@register("ag14_metric_bundle", _AG14)
def ag14(spark, d):
    return stats.metric_bundle(_pred(spark, d), "y", "p")


@register("ag15_auc", f"""WITH {_PRED}, r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS rk FROM pred),
  t AS (SELECT sum(rk) FILTER (y = 1) AS r, CAST(count(*) FILTER (y = 1) AS DOUBLE) AS p, CAST(count(*) FILTER (y = 0) AS DOUBLE) AS q FROM r)
  SELECT round((r - p * (p + 1) / 2) / (p * q), 6) AS auc, p AS n_pos, q AS n_neg FROM t""")
def ag15(spark, d):
    return stats.auc(_pred(spark, d), "y", "s")


@register("ag16_token_stats", f"SELECT max(w) AS max_tokens, round(avg(w), 6) AS mean_tokens FROM (SELECT {_WORDS} AS w FROM documents)")
def ag16(spark, d):
    n = F.size(tx.words(F.col("text")))
    return read(spark, d, "documents").agg(F.max(n).cast("long").alias("max_tokens"), F.round(F.avg(n), 6).alias("mean_tokens"))


@register("ag17_class_weights", """WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
    SELECT CAST(r AS BIGINT) AS id, coalesce(round(1 / n, 9), 0.0) AS weight FROM range((SELECT max(label) + 1 FROM c)) t(r) LEFT JOIN c ON c.label = r""")
def ag17(spark, d):
    return stats.class_weights(read(spark, d, "embeddings"), "label")


@register("ex12_linear_regression", "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def ex12(spark, d):
    return stats.regression_fit(read(spark, d, "lineitem"), "l_extendedprice", "l_quantity")


@register("un01_union_all", """SELECT text, CAST(0 AS BIGINT) AS sentiment_value, source AS source_stem FROM documents UNION ALL
    SELECT text, 0, 'benchmark' FROM benchmark UNION ALL SELECT text, CASE WHEN role = 'user' THEN 1 ELSE 0 END, 'conversations' FROM conversations""")
def un01(spark, d):
    user = F.when(F.col("role") == "user", 1).otherwise(0)
    return tables.union_all([
        tables.processed(read(spark, d, "documents"), "text", None, F.col("source")),
        tables.processed(read(spark, d, "benchmark"), "text", None, "benchmark"),
        tables.processed(read(spark, d, "conversations"), "text", user, "conversations"),
    ])


@register("un02_labels_by_file", """SELECT doc_id, lang, CASE WHEN ks = ['0','1'] THEN CASE y WHEN '0' THEN 'negative' WHEN '1' THEN 'positive' ELSE y END
    WHEN ks = ['0','1','2'] THEN CASE y WHEN '0' THEN 'negative' WHEN '1' THEN 'neutral' WHEN '2' THEN 'positive' ELSE y END ELSE y END AS label
    FROM (SELECT *, list_sort(list_distinct(list(y) OVER (PARTITION BY lang))) AS ks FROM (
      SELECT doc_id, lang, CAST(CASE lang WHEN 'en' THEN doc_id % 3 WHEN 'de' THEN doc_id % 2 ELSE doc_id % 4 END AS VARCHAR) AS y FROM documents))""")
def un02(spark, d):
    i = F.col("doc_id")
    label = F.when(F.col("lang") == "en", i % 3).when(F.col("lang") == "de", i % 2).otherwise(i % 4)
    return tables.map_labels_by_file(read(spark, d, "documents").select("doc_id", "lang", label.alias("label")), "lang", "label")


@register("un04_row_count", "SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM benchmark) AS n")
def un04(spark, d):
    both = tables.union_all([read(spark, d, n).select("text") for n in ("documents", "benchmark")])
    return both.agg(F.count("*").alias("n"))


@register("un05_exact_dedup", "SELECT DISTINCT text, lang FROM documents")
def un05(spark, d):
    return read(spark, d, "documents").select("text", "lang").dropDuplicates()


@register("un06_first_by_key", "SELECT source, arg_min(doc_id, doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY 1")
def un06(spark, d):
    return tables.first_by_priority(read(spark, d, "documents").select("source", "doc_id", "lang"), ["source"], ["doc_id"])


@register("un07_distinct_stems", "SELECT DISTINCT source FROM documents WHERE source IS NOT NULL")
def un07(spark, d):
    return read(spark, d, "documents").select("source").where("source is not null").distinct()


@register("un08_intersect", "SELECT text FROM documents INTERSECT SELECT text FROM benchmark")
def un08(spark, d):
    return read(spark, d, "documents").select("text").intersect(read(spark, d, "benchmark").select("text"))


@register("un09_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def un09(spark, d):
    return read(spark, d, "documents").select("doc_id").exceptAll(read(spark, d, "labels").select("doc_id"))


@register("hp02_log_histogram", """WITH x AS (SELECT log10(length(text) + 1) AS x FROM documents), s AS (SELECT min(x) AS lo, max(x) AS hi FROM x)
    SELECT CAST(least(floor((x - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS n FROM x, s GROUP BY 1""")
def hp02(spark, d):
    return tables.log_histogram(read(spark, d, "documents").select(F.length("text").alias("c")), "c")


@register("hp04_melt", "SELECT l_orderkey, l_linenumber, 'l_discount' AS metric, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem")
def hp04(spark, d):
    return tables.melt(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"])


@register("hp05_drop_all_null", "SELECT o_orderkey, a, b FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS a, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_custkey END AS b FROM orders) WHERE a IS NOT NULL OR b IS NOT NULL")
def hp05(spark, d):
    k = F.col("o_orderkey")
    rows = read(spark, d, "orders").select(k, F.when(k % 3 != 0, F.col("o_totalprice")).alias("a"), F.when(k % 2 != 0, F.col("o_custkey")).alias("b"))
    return rows.dropna(how="all", subset=["a", "b"])


@register("hp06_export", r"""SELECT replace(replace(p_name, '#', '\#'), '_', '\_') AS p_name, printf('%.4f', p_retailprice) AS p_retailprice, printf('%.4f', CAST(p_size AS DOUBLE)) AS p_size
    FROM part WHERE p_retailprice IS NOT NULL AND p_size IS NOT NULL""")
def hp06(spark, d):
    return tables.export_rows(read(spark, d, "part"), "p_name", ["p_retailprice", "p_size"])


@register("hp08_agreed", "SELECT o_custkey, CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN min(o_orderstatus) END AS status FROM orders GROUP BY 1")
def hp08(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg(lb.agreed(F.collect_set("o_orderstatus")).alias("status"))


@register("hp11_category", "SELECT page_id, CASE WHEN contains(url, '/en/') THEN 'english' WHEN contains(url, 'blog.') THEN 'blog' WHEN contains(url, '?') THEN 'query' ELSE 'other' END AS category FROM pages")
def hp11(spark, d):
    u = F.col("url")
    category = F.when(u.contains("/en/"), "english").when(u.contains("blog."), "blog").when(u.contains("?"), "query").otherwise("other")
    return read(spark, d, "pages").select("page_id", category.alias("category"))


@register("hp12_nearest_ancestor", """WITH p AS (SELECT DISTINCT split_part(regexp_replace(url, '^[a-z]+://', ''), '?', 1) AS path FROM pages),
    r AS (SELECT DISTINCT regexp_extract(path, '^[^/]+/[a-z]+') AS root FROM p WHERE regexp_extract(path, '^[^/]+/[a-z]+') LIKE '%/en')
    SELECT p.path, arg_max(r.root, length(r.root)) AS root FROM p LEFT JOIN r ON p.path = r.root OR starts_with(p.path, r.root || '/') GROUP BY 1""")
def hp12(spark, d):
    path = F.split_part(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("?"), F.lit(1))
    paths = read(spark, d, "pages").select(path.alias("path")).distinct()
    roots = paths.select(F.regexp_extract("path", "^[^/]+/[a-z]+", 0).alias("root")).where("root like '%/en'")
    return tables.longest_ancestor(paths, "path", roots, "root")
