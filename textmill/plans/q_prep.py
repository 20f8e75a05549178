"""Queries: scans, shards, text and number helpers, encoders, splits, samples and the caller's functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import callables, features, joins, sampling, splits, tables
from ..sources import files, scans
from .base import read
from .catalog import register

# ---------------------------------------------------------------- scans


@register("io10_parquet_metadata", "SELECT count(*) AS n_rows, CAST(6 AS INT) AS n_columns FROM orders")
def io10(spark, d):
    return scans.parquet_metadata(read(spark, d, "orders")).agg(F.sum("n_rows").alias("n_rows"), F.max("n_columns").alias("n_columns"))


_E = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings)"


@register("io11_feature_shard", f"SELECT vec_id, label, round(list_sum(e), 6) AS total FROM {_E} WHERE i >= n // 3 AND i < 2 * n // 3 AND label BETWEEN 0 AND 9")
def io11(spark, d):
    mine = scans.shard(read(spark, d, "embeddings"), "vec_id", 1, 3)
    rows = scans.feature_rows(mine, 10, 64, ["vec_id"])
    return rows.select("vec_id", "label", F.round(vx.total(F.col("features")), 6).alias("total"))


@register("io12_text_rows", "SELECT text, quality AS label FROM (SELECT d.doc_id, text, quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id ORDER BY d.doc_id LIMIT 300) WHERE quality IS NOT NULL")
def io12(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "text").join(read(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return scans.text_rows(rows, 2, 300, "doc_id")


@register("io13_feature_rows", "SELECT vec_id, label, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings WHERE len(embedding) > 0 AND label BETWEEN 0 AND 4")
def io13(spark, d):
    rows = scans.feature_rows(read(spark, d, "embeddings"), 5, 64, ["vec_id"])
    return rows.select("vec_id", "label", F.round(vx.total(F.col("features")), 6).alias("total"))


@register("io15_merged_scan", """SELECT part, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT 0 AS part, text FROM (SELECT text FROM documents ORDER BY doc_id LIMIT 150)
    UNION ALL SELECT 1, text FROM (SELECT text FROM benchmark ORDER BY item_id LIMIT 150) UNION ALL SELECT 2, html FROM (SELECT html FROM pages ORDER BY page_id LIMIT 150)) WHERE trim(text) <> '' GROUP BY 1""")
def io15(spark, d):
    parts = [(read(spark, d, n), c, k) for n, c, k in (("documents", "text", "doc_id"), ("benchmark", "text", "item_id"), ("pages", "html", "page_id"))]
    return scans.merged(parts, 150).groupBy("part").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))


@register("io16_even_shard", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) WHERE i % 7 = 3 AND i < n // 7 * 7")
def io16(spark, d):
    return scans.shard(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 3, 7, contiguous=False)


@register("io17_label_batches", "SELECT text, CAST(quality AS INT) AS label FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality IN (0, 1)")
def io17(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "text").join(read(spark, d, "labels"), "doc_id")
    return files.label_batches(rows, "text", lb.normalize(lb.coerce_number(F.col("quality")), 2))


@register("io20_mapped_columns", "SELECT c_name AS text, c_nationkey AS label FROM customer")
def io20(spark, d):
    return scans.mapped_columns(read(spark, d, "customer"), {"text": 1, "label": 2})


@register("io21_file_name", "SELECT n_nationkey, 'nation.parquet' AS source FROM nation")
def io21(spark, d):
    return scans.with_file_name(read(spark, d, "nation").select("n_nationkey", "_metadata")).select("n_nationkey", "source")


# ---------------------------------------------------------------- schemas and lines


@register("pf01_text_column", "SELECT doc_id, length(text) AS n FROM documents")
def pf01(spark, d):
    df = read(spark, d, "documents")
    return df.select("doc_id", F.length(lb.text_column(df.columns)).cast("long").alias("n"))


@register("pf03_label_column", "SELECT label AS y, count(*) AS n FROM embeddings GROUP BY 1")
def pf03(spark, d):
    df = read(spark, d, "embeddings")
    return df.groupBy(F.col(lb.label_column(df.columns)).alias("y")).agg(F.count("*").alias("n"))


@register("pf04_feature_column", "SELECT vec_id, CAST(len(embedding) AS INT) AS width FROM embeddings")
def pf04(spark, d):
    df = read(spark, d, "embeddings")
    return df.select("vec_id", F.size(lb.feature_column(df.columns)).alias("width"))


@register("pf13_same_columns", "SELECT n_name, n_nationkey FROM nation")
def pf13(spark, d):
    df = read(spark, d, "nation").select("n_nationkey", "n_name").withColumn("__index_level_0__", F.lit(1))
    return scans.same_columns(df, ["n_name", "n_nationkey"])


@register("pf21_key_values", "SELECT 'k' || p_partkey AS key, p_name || '=' || p_size AS value FROM part WHERE p_partkey % 3 = 0")
def pf21(spark, d):
    k = F.col("p_partkey")
    line = F.when(k % 3 == 0, F.concat(F.lit(" k"), k, F.lit(" = "), "p_name", F.lit("="), "p_size")).when(k % 3 == 1, F.concat(F.lit("# a="), k)).otherwise("  ")
    return scans.key_values(read(spark, d, "part").select(line.alias("line")), "line")


@register("jn03_star_rewrite", """SELECT vec_id, CASE WHEN source IN ('src1', 'src2') THEN label % 3 ELSE CAST(n_chars % 3 AS INT) END AS y FROM
    (SELECT source, n_chars, row_number() OVER (ORDER BY doc_id) AS i FROM documents) a JOIN (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings) b USING (i)""")
def jn03(spark, d):
    both = joins.zip_join(read(spark, d, "documents").select("doc_id", "source", "n_chars"), read(spark, d, "embeddings").select("vec_id", "label"), "doc_id", "vec_id")
    return both.select("vec_id", F.when(F.col("source").isin("src1", "src2"), F.col("label") % 3).otherwise((F.col("n_chars") % 3).cast("int")).alias("y"))


@register("jn04_dual_rows", """SELECT doc_id, vec_id, quality FROM (SELECT d.doc_id, quality, row_number() OVER (ORDER BY d.doc_id) AS i FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NOT NULL) a
    JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings) b USING (i)""")
def jn04(spark, d):
    labelled = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id").where("quality is not null")
    return joins.zip_join(labelled, read(spark, d, "embeddings").select("vec_id"), "doc_id", "vec_id").select("doc_id", "vec_id", "quality")


@register("jn10_paired_paths", "SELECT DISTINCT regexp_extract(url, '://[^/]*(/[^?#]*)', 1) AS path FROM pages WHERE page_id % 2 = 0 INTERSECT SELECT regexp_extract(url, '://[^/]*(/[^?#]*)', 1) FROM pages WHERE page_id % 2 = 1")
def jn10(spark, d):
    rows = read(spark, d, "pages").select("page_id", F.regexp_extract("url", "://[^/]*(/[^?#]*)", 1).alias("path"))
    return scans.paired(rows.where("page_id % 2 = 0"), rows.where("page_id % 2 = 1"))


# ---------------------------------------------------------------- text and numbers


@register("sc10_line_key", r"SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\x0B\x{85}\x{1C}-\x{1F}\p{Z}]+', ' ', 'g')) AS k FROM documents")
def sc10(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.line_key(F.col("text")).alias("k"))


_LINE = "CASE turn % 4 WHEN 0 THEN ' ' || turn || ' ' WHEN 1 THEN 'December 3, 2025' ELSE text END"


@register("sc12_footer_strip", f"SELECT conv_id, turn FROM (SELECT conv_id, turn, trim({_LINE}) AS t FROM conversations) WHERE NOT regexp_matches(t, '^[0-9]{{1,2}}$') AND NOT regexp_matches(t, '^[A-Z][a-z]+ [0-9]{{1,2}}, [0-9]{{4}}$')")
def sc12(spark, d):
    t = F.col("turn") % 4
    line = F.when(t == 0, F.concat(F.lit(" "), F.col("turn").cast("string"), F.lit(" "))).when(t == 1, "December 3, 2025").otherwise(F.col("text"))
    return scans.clean_lines(read(spark, d, "conversations").withColumn("line", line), "line").select("conv_id", "turn")


@register("sc13_page_bodies", """SELECT doc_id, CAST(2 * len(l) AS INT) AS n, CAST(2 * coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS BIGINT) AS chars FROM
    (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(x, '^(## Page [0-9]+\\s*$|!\\[|---\\s*$)')) AS l FROM documents)""")
def sc13(spark, d):
    page = [F.lit("## Page 1 \nhead\n![i](u.png)\n"), F.col("text"), F.lit("\n---\nfoot\n")]
    rows = read(spark, d, "documents").select("doc_id", tx.page_bodies(F.concat(F.lit("before\n"), *page, *page, F.lit("## Page 3\nno image\n"))).alias("l"))
    chars = F.aggregate(F.transform("l", lambda x: F.length(x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc_id", F.size("l").alias("n"), chars.alias("chars"))


@register("sc14_tex_escape", r"SELECT page_id, regexp_replace(replace(url, '\', '/'), '([#_%&])', '\\\1', 'g') AS t FROM pages")
def sc14(spark, d):
    return read(spark, d, "pages").select("page_id", tx.tex_escape(F.col("url")).alias("t"))


@register("sc15_fixed_or_dash", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN '---' ELSE printf('%.4f', l_extendedprice) END AS t FROM lineitem")
def sc15(spark, d):
    x = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_extendedprice"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", tx.fixed_or_dash(x).alias("t"))


@register("sc16_safe_name", r"SELECT page_id, substring(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.\-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 100) AS name FROM pages")
def sc16(spark, d):
    return read(spark, d, "pages").select("page_id", tx.slug(F.col("url"), 100).alias("name"))


@register("sc18_basename", "SELECT page_id, string_split(url, '/')[-1] AS base FROM pages")
def sc18(spark, d):
    return read(spark, d, "pages").select("page_id", tx.basename(F.col("url")).alias("base"))


@register("sc19_top_segment", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '_root' ELSE split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) END AS top FROM pages")
def sc19(spark, d):
    path = F.when(F.col("page_id") % 5 == 0, "./x").otherwise(F.regexp_replace("url", "^[a-z]+://", ""))
    return read(spark, d, "pages").select("page_id", tx.top_segment(path).alias("top"))


@register("sc21_numeric_if_parsed", "SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS a, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE CAST(o_custkey AS VARCHAR) END AS b FROM orders")
def sc21(spark, d):
    text = F.col("o_custkey").cast("string")
    df = read(spark, d, "orders").select("o_orderkey", text.alias("a"), F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(text).alias("b"))
    df, _ = tables.numeric_if_parsed(df, "a")
    return tables.numeric_if_parsed(df, "b")[0]


@register("sc22_trim_all", "SELECT n_nationkey, n_name, 'a b' AS other FROM nation")
def sc22(spark, d):
    df = read(spark, d, "nation").select("n_nationkey", F.concat(F.lit(" \t "), "n_name", F.lit(" \n ")).alias("n_name"), F.lit(" a b\r").alias("other"))
    return df.select(*(tx.trimmed(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


@register("sc26_log1p_relu", "SELECT vec_id, round(CASE WHEN vec_id % 5 <> 0 THEN ln(1 + greatest(CAST(embedding[1] AS DOUBLE), 0)) END, 6) AS x FROM embeddings")
def sc26(spark, d):
    x = F.when(F.col("vec_id") % 5 != 0, F.get("embedding", F.lit(0)).cast("double"))
    return read(spark, d, "embeddings").select("vec_id", F.round(vx.log1p_relu(x), 6).alias("x"))


@register("sc27_heavy_tail", "SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 6) AS y, round(greatest(c_acctbal, 0), 4) AS back FROM customer")
def sc27(spark, d):
    y = vx.log1p_relu(F.col("c_acctbal"))
    return read(spark, d, "customer").select("c_custkey", F.round(y, 6).alias("y"), F.round(F.expm1(y), 4).alias("back"))


@register("sc29_outlier_null", "SELECT o_orderkey, CASE WHEN o_totalprice <= 300000 THEN o_totalprice END AS x FROM orders")
def sc29(spark, d):
    mark = F.when(F.col("o_totalprice") > 300000, -1).otherwise(1)
    return read(spark, d, "orders").select("o_orderkey", F.when(mark != -1, F.col("o_totalprice")).alias("x"))


@register("sc32_scalar_cell", "SELECT vec_id, CASE vec_id % 3 WHEN 1 THEN round(CAST(embedding[1] AS DOUBLE), 6) END AS x FROM embeddings")
def sc32(spark, d):
    cell = vx.doubles(F.slice("embedding", F.lit(1), (F.col("vec_id") % 3).cast("int")))
    return read(spark, d, "embeddings").select("vec_id", F.round(vx.scalar_cell(cell), 6).alias("x"))


@register("sc34_flatten_metrics", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, coalesce(json_extract_string(props, '$.gate_path'), '') AS weight_path FROM events")
def sc34(spark, d):
    return tables.flatten_metrics(read(spark, d, "events").select("event_id", "props"), "props", {"k": "k", "weight_path": "gate_path"})


@register("sc35_path_stem", "SELECT page_id, 's' || page_id % 9 AS stem FROM pages")
def sc35(spark, d):
    path = F.concat(F.lit("/runs/3label/s"), F.col("page_id") % 9, F.lit("/x/metrics.json"))
    return read(spark, d, "pages").select("page_id", F.regexp_extract(path, "/3label/([^/]+)/", 1).alias("stem"))


@register("sc37_pad_collate", """SELECT conv_id, turn, CAST(n AS INT) AS n_real, CAST(m - n AS INT) AS n_pad, CAST(m AS INT) AS width FROM (SELECT conv_id, turn, n, max(n) OVER (PARTITION BY conv_id // 4) AS m FROM
    (SELECT conv_id, turn, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS n FROM conversations))""")
def sc37(spark, d):
    ids = F.transform(F.filter(F.split("text", " "), lambda x: x != ""), lambda x: F.length(x))
    rows = read(spark, d, "conversations").select("conv_id", "turn", ids.alias("ids"), F.floor(F.col("conv_id") / 4).alias("batch"))
    widest = rows.groupBy("batch").agg(F.max(F.size("ids")).alias("m"))
    both = rows.join(widest, "batch").select("conv_id", "turn", vx.padded(F.col("ids"), F.col("m"), -100).alias("labels"))
    pads = F.size(F.filter("labels", lambda x: x == -100))
    return both.select("conv_id", "turn", (F.size("labels") - pads).alias("n_real"), pads.alias("n_pad"), F.size("labels").alias("width"))


@register("sc40_uniform_mixture", "SELECT vec_id, i AS pos, round((CAST(embedding[i + 1] AS DOUBLE) + embedding[i + 17] + embedding[i + 33]) / 3, 6) AS logit FROM embeddings, range(0, 16) t(i)")
def sc40(spark, d):
    experts = F.array(*(vx.doubles(F.slice("embedding", 1 + 16 * e, 16)) for e in range(3)))
    at = read(spark, d, "embeddings").select("vec_id", F.explode(experts).alias("logits")).select("vec_id", F.posexplode("logits").alias("pos", "x"))
    return at.groupBy("vec_id", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg("x"), 6).alias("logit"))


@register("sc43_stage_hours", "SELECT source, CAST(ceil(ceil(count(*) / 2.0) / 64) AS BIGINT) AS steps, round(ceil(ceil(count(*) / 2.0) / 64) * 0.5 / 3600 * 2, 8) AS hours FROM documents GROUP BY 1")
def sc43(spark, d):
    rows = read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    steps = F.ceil(F.ceil(F.col("n") / 2) / 64)
    return rows.select("source", steps.cast("long").alias("steps"), F.round(steps * 0.5 / 3600 * 2, 8).alias("hours"))


# ---------------------------------------------------------------- statistics and encoders


@register("ag18_vector_moments", "SELECT CAST(i AS INT) AS pos, count(*) AS n, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var_pop FROM (SELECT CAST(embedding[i + 1] AS DOUBLE) AS x, i FROM embeddings, range(0, 64) t(i)) GROUP BY 1")
def ag18(spark, d):
    m = features.moments_long(read(spark, d, "embeddings"), "embedding")
    return m.select("pos", "n", F.round("mean", 6).alias("mean"), F.round("var_pop", 6).alias("var_pop"))


@register("ag19_scaler_stats", "SELECT round(avg(l_tax), 8) AS mean, round(stddev_pop(l_tax), 8) AS scale FROM lineitem")
def ag19(spark, d):
    sd = F.stddev_pop("l_tax")
    return read(spark, d, "lineitem").agg(F.round(F.avg("l_tax"), 8).alias("mean"), F.round(F.when(sd == 0, 1.0).otherwise(sd), 8).alias("scale"))


@register("ag20_quantile_stats", "SELECT quantile_cont(o_totalprice, 0.5) AS center, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS scale FROM orders")
def ag20(spark, d):
    q = read(spark, d, "orders").agg(F.percentile("o_totalprice", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    spread = F.get("q", F.lit(2)) - F.get("q", F.lit(0))
    return q.select(F.get("q", F.lit(1)).alias("center"), F.when(spread == 0, 1.0).otherwise(spread).alias("scale"))


@register("ag23_idf", """SELECT w, count(*) AS df, round(ln((1 + any_value(n)) / (1.0 + count(*))) + 1, 8) AS idf FROM (SELECT unnest(list_distinct(list_filter(string_split(text, ' '), lambda x: x <> ''))) AS w,
    (SELECT count(*) FROM conversations) AS n FROM conversations) GROUP BY 1""")
def ag23(spark, d):
    rows = read(spark, d, "conversations")
    n = rows.agg(F.count("*").alias("n")).scalar()
    terms = F.array_distinct(F.filter(F.split("text", " "), lambda x: x != ""))
    counted = rows.select(F.explode(terms).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    return counted.select("w", "df", F.round(F.log((1 + n) / (1 + F.col("df"))) + 1, 8).alias("idf"))


@register("fp12_center_kernel", """WITH k AS (SELECT c_nationkey, c_mktsegment, sum(c_acctbal) AS v FROM customer GROUP BY 1, 2)
    SELECT c_nationkey, c_mktsegment, round(v - avg(v) OVER (PARTITION BY c_mktsegment) - avg(v) OVER (PARTITION BY c_nationkey) + avg(v) OVER (), 4) AS centered FROM k""")
def fp12(spark, d):
    k = read(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.sum("c_acctbal").alias("v"))
    return features.center_kernel(k, "c_nationkey", "c_mktsegment", "v").select("c_nationkey", "c_mktsegment", F.round("centered", 4).alias("centered"))


def _with_gaps(spark, d):
    holes = F.transform(vx.doubles(F.col("embedding")), lambda x, i: F.when((F.col("vec_id") + i) % 11 != 0, x))
    return read(spark, d, "embeddings").select("vec_id", holes.alias("v"))


_GAPS = """v AS (SELECT vec_id, i, CASE WHEN (vec_id + i) % 11 <> 0 THEN CAST(embedding[i + 1] AS DOUBLE) END AS x FROM embeddings, range(0, 64) t(i)),
    dist AS (SELECT q.vec_id AS query, p.vec_id, sqrt(sum((q.x - p.x) * (q.x - p.x)) * 64 / count(q.x - p.x)) AS distance FROM v q JOIN v p ON p.i = q.i WHERE q.vec_id % 50 = 0 GROUP BY 1, 2)"""


@register("fp15_knn_impute", f"""WITH {_GAPS}, near AS (SELECT query, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), vec_id) AS r FROM dist) WHERE r <= 5)
    SELECT g.vec_id AS query, CAST(g.i AS INT) AS pos, round(avg(p.x), 6) AS value FROM v g JOIN near n ON n.query = g.vec_id JOIN v p ON p.vec_id = n.vec_id AND p.i = g.i WHERE g.vec_id % 50 = 0 AND g.x IS NULL GROUP BY 1, 2""")
def fp15(spark, d):
    rows = _with_gaps(spark, d)
    return features.knn_impute(rows.where("vec_id % 50 = 0"), rows, "vec_id", "v", 5).select("query", "pos", F.round("value", 6).alias("value"))


@register("fp17_nan_distance", f"WITH {_GAPS} SELECT query, vec_id, round(distance, 6) AS distance FROM dist")
def fp17(spark, d):
    rows = _with_gaps(spark, d)
    return features.nan_distances(rows.where("vec_id % 50 = 0"), rows, "vec_id", "v").select("query", "vec_id", F.round("distance", 6).alias("distance"))


@register("fp21_one_hot", "SELECT doc_id, CAST(lang = 'en' AS INT) AS lang_en, CAST(lang = 'es' AS INT) AS lang_es, CAST(lang = 'fr' AS INT) AS lang_fr FROM (SELECT doc_id, coalesce(lang, '') AS lang FROM documents)")
def fp21(spark, d):
    return features.one_hot(read(spark, d, "documents").select("doc_id", "lang"), "lang", ["de", "en", "es", "fr"], drop_first=True).drop("lang")


@register("fp23_ordinal", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN -2.0 WHEN o_orderstatus IN ('F', 'O') THEN CAST(ascii(o_orderstatus) > ascii('F') AS DOUBLE) ELSE -1.0 END AS code FROM orders")
def fp23(spark, d):
    df = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("s"))
    known = spark.createDataFrame([("F",), ("O",)], "s string")
    return features.ordinal_encode(df, "s", known, missing=-2.0).select("o_orderkey", "code")


@register("fp10_spline_total", "SELECT l_orderkey, l_linenumber, CAST(7 AS INT) AS n, 1.0 AS total FROM lineitem")
def fp10(spark, d):
    basis = features.spline_basis(F.col("l_quantity"), [0.0, 15.0, 30.0, 45.0, 60.0])
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.size(basis).alias("n"), F.round(vx.total(basis), 6).alias("total"))


@register("fp32_pca")
def fp32(spark, d):
    return features.pca(read(spark, d, "embeddings"), "vec_id", "embedding", 4)


# ---------------------------------------------------------------- splits, grids, samples


@register("cv05_leave_two_out", "SELECT a.n_nationkey AS k1, b.n_nationkey AS k2 FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def cv05(spark, d):
    return splits.leave_p_out(read(spark, d, "nation"), "n_nationkey", 2)


@register("cv09_group_shuffle")
def cv09(spark, d):
    return splits.group_shuffle_split(read(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey")


@register("cv10_stratified_shuffle")
def cv10(spark, d):
    return splits.stratified_shuffle_split(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", 3)


@register("cv11_repeated_kfold")
def cv11(spark, d):
    return splits.repeated_kfold(read(spark, d, "customer").select("c_custkey"), "c_custkey", 5, 3)


@register("cv15_grid", "SELECT CAST((ia * 2 + ib) * 3 + ic AS BIGINT) AS candidate, [0.1, 1.0][ia + 1] AS alpha, ['l1', 'l2'][ib + 1] AS norm, CAST([3, 5, 7][ic + 1] AS INT) AS size FROM range(0, 2) a(ia), range(0, 2) b(ib), range(0, 3) c(ic)")
def cv15(spark, d):
    return splits.grid(spark, {"size": [3, 5, 7], "alpha": [0.1, 1.0], "norm": ["l1", "l2"]})


@register("cv15_random_candidates")
def cv15_random(spark, d):
    return splits.random_candidates(spark, {"size": [3, 5, 7], "alpha": [0.1, 1.0]}, 4)


@register("sl09_fraction_sample")
def sl09(spark, d):
    return sampling.fraction_sample(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.2)


@register("sl10_balanced_draws")
def sl10(spark, d):
    return sampling.balanced_draws(read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 3000)


@register("sl11_replay")
def sl11(spark, d):
    return sampling.replay(read(spark, d, "events").select("event_id", "value"), "event_id", 500, 50)


@register("sl13_smote")
def sl13(spark, d):
    return sampling.smote(read(spark, d, "embeddings").select("vec_id", "embedding", "label"), "vec_id", "embedding", "label", 1)


@register("st09_scaled_rewards", """WITH RECURSIVE o AS (SELECT user_id, event_id, value AS r, (event_id % 17 = 0) AS done, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
    f AS (SELECT user_id, event_id, i, r, r AS ret FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.event_id, o.i, o.r, o.r + 0.99 * f.ret * (1 - CAST(o.done AS INT)) FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
    SELECT user_id, event_id, round(ret, 6) AS ret FROM f""")
def st09(spark, d):
    steps = read(spark, d, "events").select("user_id", "event_id", "value", (F.col("event_id") % 17 == 0).alias("done"))
    return sampling.discounted(steps, "value", "done", "user_id", ["event_id"]).select("user_id", "event_id", F.round("ret", 6).alias("ret"))


@register("st09_clipped_rewards")
def st09_scaled(spark, d):
    steps = read(spark, d, "events").select("user_id", "event_id", "value", (F.col("event_id") % 17 == 0).alias("done"))
    return sampling.scaled_rewards(steps, "value", "done", "user_id", ["event_id"])


# ---------------------------------------------------------------- the caller's functions


@register("ud01_function_transform", "SELECT l_orderkey, l_linenumber, l_tax * 2 + 1 AS l_tax FROM lineitem")
def ud01(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_tax")
    return callables.transform_columns(rows, ["l_tax"], lambda x, by: x * by + 1, lambda x, by: (x - 1) / by, check=True, by=2)


@register("ud02_analyzer", "SELECT conv_id, turn, CAST(len(string_split(lower(text), 'e')) AS INT) AS n FROM conversations")
def ud02(spark, d):
    parts = callables.analyzer(lambda t: t.split("e"), str.lower)
    return read(spark, d, "conversations").select("conv_id", "turn", F.size(parts(F.col("text"))).alias("n"))


@register("ud03_aggregate", "SELECT l_returnflag, max(l_tax) - min(l_tax) AS spread, round(sqrt(avg(l_tax * l_tax)), 8) AS rms FROM lineitem GROUP BY 1")
def ud03(spark, d):
    rows = read(spark, d, "lineitem")
    spread = rows.groupBy("l_returnflag").agg(callables.merge(lambda s: s.max() - s.min())(F.col("l_tax")).alias("spread"))
    rms = rows.groupBy("l_returnflag").agg(F.round(callables.merge("rms")(F.col("l_tax")), 8).alias("rms"))
    return spread.join(rms, "l_returnflag")


@register("ud04_metric", "SELECT a.vec_id AS query, b.vec_id, round(CAST(list_max(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(CAST(z[1] AS DOUBLE) - z[2]))) AS DOUBLE), 5) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0")
def ud04(spark, d):
    import numpy as np

    rows = read(spark, d, "embeddings").select("vec_id", vx.doubles(F.col("embedding")).alias("v"))
    chebyshev = callables.metric(lambda a, b: np.abs(np.stack(a) - np.stack(b)).max(axis=1) if len(a) else [])
    pairs = rows.crossJoin(rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("v").alias("q")))
    return pairs.select("query", "vec_id", F.round(chebyshev(F.col("q"), F.col("v")), 5).alias("distance"))


@register("ud06_batches", "SELECT count(*) AS n FROM orders")
def ud06(spark, d):
    sized = callables.batches(read(spark, d, "orders").select("o_orderkey"), 100, "o_orderkey").groupBy(F.spark_partition_id().alias("p"), "batch").agg(F.count("*").alias("c"))
    return sized.agg(F.sum("c").alias("n"))


@register("ud08_reader_registry", "SELECT r_regionkey FROM region")
def ud08(spark, d):
    callables.register_reader("", files.load)
    callables.register_reader("/", files.load)
    return callables.read_by_prefix(spark, f"{d}/region.parquet").select("r_regionkey")


# ---------------------------------------------------------------- chart feeds and manifests


@register("hp01_preferred_counts", "SELECT source, k, n FROM (SELECT source, 'en' AS k, count(*) FILTER (lang = 'en') AS n FROM documents GROUP BY 1 UNION ALL SELECT source, 'de', count(*) FILTER (lang = 'de') FROM documents GROUP BY 1)")
def hp01(spark, d):
    lang = lambda v: F.count_if(F.coalesce(F.col("lang"), F.lit("")) == v)
    rows = read(spark, d, "documents").groupBy("source").agg(F.create_map(F.lit("en"), lang("en"), F.lit("de"), lang("de"), F.lit("_all"), F.count("*")).alias("m"))
    kept = F.map_filter(F.coalesce("m", F.create_map().cast("map<string,bigint>")), lambda k, v: ~k.startswith("_"))
    return rows.select("source", F.explode(kept).alias("k", "n"))


@register("hp03_path_feed", "SELECT split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) AS top, count(*) AS n, CAST(sum(length(html)) AS BIGINT) AS size FROM pages GROUP BY 1")
def hp03(spark, d):
    rows = read(spark, d, "pages").select(tx.top_segment(F.regexp_replace("url", "^[a-z]+://", "")).alias("top"), F.length("html").cast("long").alias("size"))
    return rows.groupBy("top").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


@register("hp07_stem_map", "SELECT key, value FROM (VALUES ('a', 'A b'), ('c', 'C')) t(key, value)")
def hp07(spark, d):
    return spark.range(1).select(F.explode(F.from_json(F.lit('{"a": "A b", "c": "C"}'), "map<string,string>")).alias("key", "value"))


@register("hp09_manifest_summary", "SELECT conv_id, count(*) AS n, array_to_string(list_slice(list(role ORDER BY turn), 1, 3), ',') AS first FROM conversations GROUP BY 1")
def hp09(spark, d):
    listed = read(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("l"))
    return listed.select("conv_id", F.size("l").cast("long").alias("n"), F.array_join(F.slice(F.transform("l", lambda x: x["role"]), 1, 3), ",").alias("first"))


@register("hp13_doc_summary", "SELECT doc_id, substring(text, 1, 300) AS summary FROM documents WHERE text IS NOT NULL AND NOT contains(text, '\"\"\"')")
def hp13(spark, d):
    rows = read(spark, d, "documents").where(~F.col("text").contains('"""'))
    source = F.concat(F.lit('import x\n"""'), "text", F.lit('"""\n'))
    # The docstring ends at the last of a run of quotes, so a text that ends with quotes keeps them.
    return rows.select("doc_id", F.substring(F.regexp_extract(source, r'(?s)"""(.*?)"""(?!")', 1), 1, 300).alias("summary"))
