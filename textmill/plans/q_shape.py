"""Queries: filters, joins, windows, ranking, splits, text and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import joins, ranking, tables, windows
from .base import SPACE, read
from .catalog import register

_SQUEEZE = f"trim(regexp_replace(%s, '{SPACE}', ' ', 'g'))"

# ---------------------------------------------------------------- filters and names


@register("pf10_drop_blank", "SELECT doc_id FROM documents WHERE trim(CASE WHEN doc_id % 7 = 0 THEN '  ' WHEN doc_id % 11 = 0 THEN NULL ELSE text END) <> ''")
def pf10(spark, d):
    i = F.col("doc_id")
    t = F.when(i % 7 == 0, "  ").when(i % 11 == 0, None).otherwise(F.col("text"))
    return tables.drop_blank(read(spark, d, "documents").withColumn("text", t), "text").select("doc_id")


@register("pf11_drop_empty_pairs", """SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS t, CASE WHEN doc_id % 2 = 0 THEN 'nan' ELSE lang END AS l FROM documents)
    WHERE NOT (coalesce(t, '') = '' AND coalesce(l, '') IN ('', 'nan', 'None', 'NaN'))""")
def pf11(spark, d):
    i = F.col("doc_id")
    rows = read(spark, d, "documents").select("doc_id", F.when(i % 3 == 0, "").otherwise(F.col("text")).alias("t"), F.when(i % 2 == 0, "nan").otherwise(F.col("lang")).alias("l"))
    return tables.drop_empty_pairs(rows, "t", "l").select("doc_id")


@register("pf12_drop_by_suffix", "SELECT * EXCLUDE (o_orderkey, o_custkey) FROM orders")
def pf12(spark, d):
    df = read(spark, d, "orders")
    return df.drop(*(c for c in df.columns if c.endswith("key")))


@register("pf14_row_head", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50")
def pf14(spark, d):
    return read(spark, d, "documents").select("doc_id", "lang").orderBy("doc_id").limit(50)


@register("pf15_numeric_coercion", "SELECT page_id, TRY_CAST(regexp_extract(url, '/([a-z0-9]+)[^/]*$', 1) AS DOUBLE) AS x FROM pages")
def pf15(spark, d):
    return read(spark, d, "pages").select("page_id", F.regexp_extract("url", "/([a-z0-9]+)[^/]*$", 1).try_cast("double").alias("x"))


@register("pf16_not_null_either", "SELECT l_orderkey, l_linenumber FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN l_tax END AS a, CASE WHEN l_linenumber % 3 = 0 THEN l_tax END AS b FROM lineitem) WHERE a IS NOT NULL OR b IS NOT NULL")
def pf16(spark, d):
    n = F.col("l_linenumber")
    rows = read(spark, d, "lineitem").withColumn("a", F.when(n % 2 == 0, F.col("l_tax"))).withColumn("b", F.when(n % 3 == 0, F.col("l_tax")))
    return rows.where("a is not null or b is not null").select("l_orderkey", "l_linenumber")


@register("pf17_family", "SELECT p_partkey, CASE WHEN starts_with(p_type, 'STANDARD') THEN 'plain' WHEN starts_with(p_type, 'SMALL') THEN 'sized' WHEN starts_with(p_type, 'LARGE') THEN 'sized' ELSE 'other' END AS family FROM part")
def pf17(spark, d):
    families = [("STANDARD", "plain"), ("SMALL", "sized"), ("LARGE", "sized")]
    return read(spark, d, "part").select("p_partkey", lb.majority_family(F.col("p_type"), families, "other").alias("family"))


@register("pf18_model_key", "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(p_name, '^part[ _]*', '', 'i'), '[0-9]+$', ''), ' +', '_', 'g') AS k FROM part")
def pf18(spark, d):
    k = F.regexp_replace(F.regexp_replace(F.regexp_replace("p_name", "(?i)^part[ _]*", ""), "[0-9]+$", ""), " +", "_")
    return read(spark, d, "part").select("p_partkey", k.alias("k"))


_SLUG = r"regexp_replace(regexp_replace(trim(%s), '[^A-Za-z0-9_.\-]+', '_', 'g'), '^_+|_+$', '', 'g')"


@register("pf19_slug", f"SELECT page_id, substring(CASE WHEN {_SLUG % 'url'} = '' THEN 'unknown' ELSE {_SLUG % 'url'} END, 1, 200) AS slug FROM pages")
def pf19(spark, d):
    return read(spark, d, "pages").select("page_id", tx.slug(F.col("url")).alias("slug"))


@register("pf20_path_mode", "SELECT page_id, CASE WHEN contains(url, '/en/') THEN 2 WHEN contains(url, '/de/') THEN 3 END AS k FROM pages")
def pf20(spark, d):
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", F.when(u.contains("/en/"), 2).when(u.contains("/de/"), 3).alias("k"))


@register("pf22_quality_filter", f"""SELECT doc_id FROM documents WHERE length(text) > 0 AND len(list_distinct(string_split(text, ''))) / length(text) > 0.05
    AND (length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) / length(text) < 0.5
    AND len(list_filter(string_split({_SQUEEZE % 'text'}, ' '), lambda w: w <> '')) > 20""")
def pf22(spark, d):
    return read(spark, d, "documents").where(tx.quality_ok(F.col("text"))).select("doc_id")


# ---------------------------------------------------------------- joins


@register("jn01_zip_join", """SELECT a.row_index, doc_id, vec_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM documents) a
    JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS row_index FROM embeddings) b USING (row_index)""")
def jn01(spark, d):
    return joins.zip_join(read(spark, d, "documents").select("doc_id"), read(spark, d, "embeddings").select("vec_id"), "doc_id", "vec_id")


@register("jn02_zip_rewrite", """SELECT vec_id, coalesce(quality, 0) AS label FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings) a
    JOIN (SELECT quality, row_number() OVER (ORDER BY d.doc_id) - 1 AS i FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) b USING (i)""")
def jn02(spark, d):
    docs = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    both = joins.zip_join(docs, read(spark, d, "embeddings").select("vec_id"), "doc_id", "vec_id")
    return both.select("vec_id", F.coalesce("quality", F.lit(0)).alias("label"))


@register("jn05_inner_join", "SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey")
def jn05(spark, d):
    customer = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    nation = read(spark, d, "nation").select("n_nationkey", "n_name")
    return read(spark, d, "orders").select("o_orderkey", "o_custkey").join(customer, "o_custkey").join(nation, "n_nationkey").select("o_orderkey", "c_name", "n_name")


@register("jn06_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def jn06(spark, d):
    big = read(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, d, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@register("jn07_allow_list", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2', 'src3')")
def jn07(spark, d):
    return read(spark, d, "documents").where(F.col("source").isin("src1", "src2", "src3")).select("doc_id")


@register("jn08_pending", """SELECT r_name, lang FROM region CROSS JOIN (SELECT DISTINCT lang FROM documents)
    WHERE (r_name, lang) NOT IN (SELECT DISTINCT r_name, CASE WHEN r_regionkey % 2 = 0 THEN 'en' ELSE 'de' END FROM region)""")
def jn08(spark, d):
    region = read(spark, d, "region")
    done = region.select("r_name", F.when(F.col("r_regionkey") % 2 == 0, "en").otherwise("de").alias("lang"))
    return joins.pending(region.select("r_name"), read(spark, d, "documents").select("lang").distinct(), done, ["r_name", "lang"])


@register("jn09_cross_join", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def jn09(spark, d):
    return read(spark, d, "region").select("r_name").crossJoin(F.broadcast(read(spark, d, "nation").select("n_name")))


@register("jn11_prefer_first", """SELECT d.doc_id, coalesce(a.v, b.v) AS v FROM documents d LEFT JOIN (SELECT doc_id, 'label' AS v FROM labels) a ON a.doc_id = d.doc_id
    LEFT JOIN (SELECT doc_id, 'long' AS v FROM documents WHERE length(text) > 2000) b ON b.doc_id = d.doc_id""")
def jn11(spark, d):
    docs = read(spark, d, "documents")
    first = read(spark, d, "labels").select("doc_id", F.lit("label").alias("v"))
    second = docs.where(F.length("text") > 2000).select("doc_id", F.lit("long").alias("v"))
    return joins.prefer_first(docs.select("doc_id"), first, second, ["doc_id"], "v")


@register("jn12_audit", """SELECT coalesce(a.source, b.source) AS source, n_left, n_right FROM (SELECT source, count(*) AS n_left FROM documents GROUP BY 1) a
    FULL JOIN (SELECT source, count(*) AS n_right FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1) b ON a.source = b.source WHERE n_left IS DISTINCT FROM n_right""")
def jn12(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source")
    return joins.audit(docs, docs.join(read(spark, d, "labels"), "doc_id", "left_semi"), "source")


@register("jn13_lookup_encode", """SELECT p_partkey, coalesce(code, -1) AS code FROM part LEFT JOIN
    (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part WHERE p_size > 25)) USING (p_brand)""")
def jn13(spark, d):
    from ..operators import features

    part = read(spark, d, "part")
    codes = features.ordinal_codes(part.where("p_size > 25"), "p_brand")
    return joins.encode_lookup(part.select("p_partkey", "p_brand"), "p_brand", codes).select("p_partkey", F.col("code").cast("long").alias("code"))


_DIST = "sqrt(list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


@register("jn14_knn", f"""SELECT query, point, rank, round(d, 6) AS d FROM (SELECT a.vec_id AS query, b.vec_id AS point, {_DIST} AS d,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DIST}, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 5""")
def jn14(spark, d):
    points = read(spark, d, "embeddings")
    near = joins.knn(points.where("vec_id % 50 = 0"), points, "vec_id", "embedding", 5, skip_self=True)
    return near.select("query", "point", F.col("rank").cast("long").alias("rank"), F.round("d", 6).alias("d"))


@register("jn15_radius", f"SELECT a.vec_id AS query, count(*) AS n FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND {_DIST} <= 1.2 GROUP BY 1")
def jn15(spark, d):
    points = read(spark, d, "embeddings")
    return joins.radius(points.where("vec_id % 50 = 0"), points, "vec_id", "embedding", 1.2).groupBy("query").agg(F.count("*").alias("n"))


_CENTERS = """c AS (SELECT label, list(x ORDER BY pos) AS c FROM (SELECT label, pos, avg(CAST(embedding[pos] AS DOUBLE)) AS x FROM embeddings, range(1, 65) t(pos) GROUP BY 1, 2) GROUP BY 1)"""
_COS = "list_sum(list_transform(list_zip(CAST(e.embedding AS DOUBLE[]), c.c), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(c.c, lambda x: x * x))) / sqrt(list_sum(list_transform(CAST(e.embedding AS DOUBLE[]), lambda x: x * x)))"


@register("jn16_cosine_pseudo_labels", f"WITH {_CENTERS}, s AS (SELECT e.vec_id, c.label, {_COS} AS s FROM embeddings e, c) SELECT vec_id, arg_max(label, s) AS predicted, round(max(s), 6) AS score, max(s) > 0.3 AS confident FROM s GROUP BY 1")
def jn16(spark, d):
    df = read(spark, d, "embeddings")
    near = joins.nearest_centroid(df, "vec_id", "embedding", joins.centroids(df, "label", "embedding"), "label", cosine=True)
    return near.select("vec_id", "predicted", F.round("score", 6).alias("score"), (F.col("score") > 0.3).alias("confident"))


@register("jn17_jaccard_pairs", f"""WITH t AS (SELECT doc_id, list_distinct(list_filter(string_split({_SQUEEZE % 'lower(text)'}, ' '), lambda w: w <> '')) AS t FROM documents)
    SELECT a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 6) AS jaccard FROM t a, t b
    WHERE a.doc_id < b.doc_id AND least(len(a.t), len(b.t)) >= 0.9 * greatest(len(a.t), len(b.t)) - 1e-9
      AND len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) >= 0.9 - 1e-9""")
def jn17(spark, d):
    pairs = joins.jaccard_pairs(read(spark, d, "documents"), "doc_id", F.when(F.col("text").isNotNull(), tx.words(F.lower("text"))), 0.9)
    return pairs.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@register("jn18_as_of", "SELECT e.event_id, o.event_id AS event_id_as_of FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1) o ON e.user_id = o.user_id AND e.ts >= o.ts WHERE e.event_type = 'view'")
def jn18(spark, d):
    e = read(spark, d, "events")
    left = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("bought")).select("user_id", "ts", "bought")
    return joins.as_of(left, right, "user_id", "ts", "bought").select("event_id", F.col("bought_as_of").alias("event_id_as_of"))


# ---------------------------------------------------------------- windows

_EV = "OVER (PARTITION BY user_id ORDER BY ts, event_id%s)"


@register("wn01_lags", f"SELECT event_id, lag(value, 1) {_EV % ''} AS value_lag1, lag(value, 3) {_EV % ''} AS value_lag3 FROM events")
def wn01(spark, d):
    return windows.lags(read(spark, d, "events"), "value", [0, 1, 3], "user_id", ["ts", "event_id"]).select("event_id", "value_lag1", "value_lag3")


@register("wn02_rolling_mean", f"SELECT event_id, round(avg(value) {_EV % ' ROWS BETWEEN 4 PRECEDING AND CURRENT ROW'}, 6) AS rolling_mean FROM events")
def wn02(spark, d):
    rolled = windows.rolling_mean(read(spark, d, "events"), "value", 5, "user_id", ["ts", "event_id"])
    return rolled.select("event_id", F.round("rolling_mean", 6).alias("rolling_mean"))


@register("wn03_terciles", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, CASE WHEN rn <= ceil((n - 1) / 3) THEN 'negative' WHEN rn <= ceil(2 * (n - 1) / 3) THEN 'neutral' ELSE 'positive' END AS tercile FROM r""")
def wn03(spark, d):
    return ranking.terciles(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"]).select("o_orderkey", "tercile")


_LINES = "lines AS (SELECT doc_id, CAST(u.i AS INT) - 1 AS line_no, u.line FROM (SELECT doc_id, unnest(list_zip(range(1, len(string_split(text, chr(10))) + 1), string_split(text, chr(10)))) AS z FROM documents) , LATERAL (SELECT z[1] AS i, z[2] AS line) u)"


def _lines(spark, d):
    return read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@register("wn04_drop_repeats", f"""WITH {_LINES} SELECT doc_id, line_no FROM (SELECT *, last_value(CASE WHEN trim(line) <> '' THEN trim(line) END IGNORE NULLS)
    OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM lines) WHERE prev IS NULL OR trim(line) <> prev OR length(trim(line)) <= 8""")
def wn04(spark, d):
    return windows.drop_repeats(_lines(spark, d), "line", "doc_id", "line_no").select("doc_id", "line_no")


@register("wn05_first_of_frequent", f"""WITH {_LINES}, s AS (SELECT line, count(*) AS n, min(doc_id * 1000000 + line_no) AS f FROM lines GROUP BY 1)
    SELECT doc_id, line_no FROM lines JOIN s USING (line) WHERE n < 3 OR doc_id * 1000000 + line_no = f""")
def wn05(spark, d):
    return windows.first_of_frequent(_lines(spark, d), "line", ["doc_id", "line_no"]).select("doc_id", "line_no")


@register("wn06_frequent_lines", f"WITH {_LINES} SELECT {_SQUEEZE % 'line'} AS line, count(*) AS n FROM lines WHERE {_SQUEEZE % 'line'} <> '' GROUP BY 1 HAVING count(*) >= 3")
def wn06(spark, d):
    return windows.frequent_lines(_lines(spark, d), tx.squeeze(F.col("line")))


@register("wn07_frame_stack", f"""SELECT event_id, array_to_string(list_concat(list_transform(range(4 - len(l)), lambda i: f), l), ',') AS frames
    FROM (SELECT event_id, list(CAST(value AS INT)) {_EV % ' ROWS BETWEEN 3 PRECEDING AND CURRENT ROW'} AS l, first_value(CAST(value AS INT)) {_EV % ''} AS f FROM (SELECT * REPLACE (floor(value) AS value) FROM events))""")
def wn07(spark, d):
    e = read(spark, d, "events").withColumn("value", F.floor("value").cast("int"))
    return windows.frame_stack(e, "value", 4, "user_id", ["ts", "event_id"]).select("event_id", F.array_join("frames", ",").alias("frames"))


@register("wn08_clips", "SELECT vec_id, CAST(s / 8 AS INT) AS clip, round(list_sum(CAST(embedding[s + 1 : s + 16] AS DOUBLE[])), 6) AS total FROM embeddings, range(0, 49, 8) t(s)")
def wn08(spark, d):
    at = read(spark, d, "embeddings").select("vec_id", F.posexplode(windows.clips(vx.doubles(F.col("embedding")), 16, 8)).alias("clip", "c"))
    return at.select("vec_id", "clip", F.round(vx.total(F.col("c")), 6).alias("total"))


@register("wn09_pack", """WITH f AS (SELECT i, t, row_number() OVER (ORDER BY doc_id, i) - 1 AS p FROM (SELECT doc_id, unnest(range(1, n + 2)) AS i, unnest(list_append(list_transform(ws, lambda w: length(w)), -1)) AS t
      FROM (SELECT doc_id, ws, len(ws) AS n FROM (SELECT doc_id, list_filter(string_split(text, ' '), lambda w: w <> '') AS ws FROM documents)))),
    b AS (SELECT CAST(floor(p / 512) AS BIGINT) AS block, list(t ORDER BY p) AS ids FROM f GROUP BY 1 HAVING count(*) = 512)
    SELECT block, array_to_string(ids[1:511], ',') AS inputs, array_to_string(ids[2:512], ',') AS labels FROM b""")
def wn09(spark, d):
    ids = F.transform(F.filter(F.split("text", " "), lambda w: w != ""), F.length)
    packed = windows.pack(read(spark, d, "documents").select("doc_id", ids.alias("ids")), "ids", "doc_id", 512, -1)
    return packed.select("block", F.array_join(F.col("inputs").cast("array<string>"), ",").alias("inputs"), F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))


@register("wn10_noise_schedule", "SELECT CAST(t AS INT) AS t, round(exp(sum(ln(1 - (0.0001 + t * 0.0199 / 99))) OVER (ORDER BY t)), 9) AS alpha_bar FROM range(100) r(t)")
def wn10(spark, d):
    return spark.range(1).select(F.posexplode(vx.noise_schedule(100)).alias("t", "a")).select("t", F.round("a", 9).alias("alpha_bar"))


# ---------------------------------------------------------------- order, folds, samples


@register("sl01_nulls_last", "SELECT l_orderkey, l_linenumber, x FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS x FROM lineitem) ORDER BY x DESC NULLS LAST, l_orderkey, l_linenumber")
def sl01(spark, d):
    x = F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("x")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", x).orderBy(F.col("x").desc_nulls_last(), "l_orderkey", "l_linenumber")


@register("sl03_top_per_group", "SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def sl03(spark, d):
    top = ranking.top_per_group(read(spark, d, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)
    return top.select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@register("sl04_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sl04(spark, d):
    return read(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@register("sl05_top_categories", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 25")
def sl05(spark, d):
    return tables.value_counts(read(spark, d, "part"), "p_brand", 25)


@register("sl08_hash_sample")
def sl08(spark, d):
    return ranking.hash_sample(read(spark, d, "documents").select("doc_id", "lang"), "doc_id", 50)


@register("sl12_ring_buffer", "SELECT (rn - 1) % 100 AS slot, arg_max(event_id, rn) AS event_id, arg_max(value, rn) AS value FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS rn FROM events) GROUP BY 1")
def sl12(spark, d):
    return ranking.ring_buffer(read(spark, d, "events"), "event_id", 100, ["event_id", "value"])


_FOLD = "CASE WHEN i < (n % {k}) * (n // {k} + 1) THEN i // (n // {k} + 1) ELSE n % {k} + (i - (n % {k}) * (n // {k} + 1)) // greatest(n // {k}, 1) END"


@register("cv01_kfold", f"SELECT o_orderkey, CAST({_FOLD.format(k=7)} AS INT) AS fold FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)")
def cv01(spark, d):
    return ranking.kfold(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7)


@register("cv02_group_kfold", f"""WITH g AS (SELECT o_custkey, CAST({_FOLD.format(k=5)} AS INT) AS fold FROM (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders)))
    SELECT o_orderkey, fold FROM orders JOIN g USING (o_custkey)""")
def cv02(spark, d):
    return ranking.group_kfold(read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 5).select("o_orderkey", "fold")


@register("cv03_stratified_kfold", f"SELECT o_orderkey, CAST({_FOLD.format(k=5)} AS INT) AS fold FROM (SELECT o_orderkey, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey))")
def cv03(spark, d):
    return ranking.stratified_kfold(read(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 5).select("o_orderkey", "fold")


@register("cv04_time_series_split", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
    s AS (SELECT *, CAST(k AS INT) AS split, n - (4 - k) * (n // 5) AS b, n // 5 AS size FROM r, range(4) t(k))
    SELECT o_orderkey, split, CASE WHEN i >= b AND i < b + size THEN 'test' ELSE 'train' END AS part FROM s WHERE (i >= b AND i < b + size) OR i < b - 10""")
def cv04(spark, d):
    return ranking.time_series_split(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 4, gap=10)


@register("cv06_leave_group_out", "SELECT c_custkey, r AS held_out, CASE WHEN c_mktsegment = r THEN 'test' ELSE 'train' END AS part FROM customer, (SELECT DISTINCT c_mktsegment AS r FROM customer)")
def cv06(spark, d):
    return ranking.leave_group_out(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment").select("c_custkey", "held_out", "part")


@register("cv07_predefined_split", "SELECT event_id, CAST(user_id % 4 - 1 AS INT) AS fold FROM events WHERE user_id % 4 <> 0")
def cv07(spark, d):
    return read(spark, d, "events").select("event_id", (F.col("user_id") % 4 - 1).cast("int").alias("fold")).where("fold >= 0")


@register("cv08_shuffle_split")
def cv08(spark, d):
    return ranking.shuffle_split(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 3)


# ---------------------------------------------------------------- text and scalars

_CLEAN = "coalesce(html, '')"
for _p, _r in ((tx.TAG, " "), (tx.ADDRESS, " "), (r"\b[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[a-zA-Z]{2,}\b", " "), (r"[@#][\p{L}\p{N}_]+", " "), (tx.UNPRINTABLE, " "), (tx.MARKS, r"\1")):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '{_r}', 'g')"


@register("sc01_clean_text", f"SELECT page_id, lower({_SQUEEZE % _CLEAN}) AS cleaned FROM pages")
def sc01(spark, d):
    return read(spark, d, "pages").select("page_id", tx.clean(F.col("html")).alias("cleaned"))


@register("sc01_clean_full")
def sc01_full(spark, d):
    return read(spark, d, "pages").select("page_id", tx.clean_full(F.col("html")).alias("cleaned"))


_CODE = "html || ' ```' || chr(10) || 'x = 1 ``` and `y` end'"


@register("sc03_clean_code", f"SELECT page_id, {_SQUEEZE % ('regexp_replace(regexp_replace(' + _CODE + ', %s, %s, %s), %s, %s, %s)' % (chr(39) + '(?s)```.*?```' + chr(39), chr(39) + ' ' + chr(39), chr(39) + 'g' + chr(39), chr(39) + '`[^`]+`' + chr(39), chr(39) + ' ' + chr(39), chr(39) + 'g' + chr(39)))} AS cleaned FROM pages")
def sc03(spark, d):
    code = F.concat("html", F.lit(" ```\nx = 1 ``` and `y` end"))
    return read(spark, d, "pages").select("page_id", tx.clean_code(code).alias("cleaned"))


_STOP = ",".join(f"'{w}'" for w in tx.STOP_WORDS)


@register("sc04_nlp_tokens", rf"""SELECT page_id, array_to_string(list_filter(string_split({_SQUEEZE % ("regexp_replace(lower(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), 'https?://[^ \t\n\x0B\f\r]+', ' ', 'g')), '[^a-z0-9 \t\n\x0B\f\r]', ' ', 'g')")}, ' '),
    lambda w: length(w) > 2 AND w NOT IN ({_STOP})), ' ') AS tokens FROM pages""")
def sc04(spark, d):
    return read(spark, d, "pages").select("page_id", F.array_join(tx.nlp_tokens(F.col("html")), " ").alias("tokens"))


@register("sc05_concat_columns", "SELECT c_custkey, 'c_name: ' || c_name || ', c_mktsegment: ' || c_mktsegment || ', c_nationkey: ' || CAST(c_nationkey AS VARCHAR) AS text FROM customer")
def sc05(spark, d):
    df = read(spark, d, "customer")
    return df.select("c_custkey", tables.concat_columns(df, ["c_name", "c_mktsegment", "c_nationkey"]).alias("text"))


@register("sc06_star_bucket", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity / 10 <= 2.5 THEN 'negative' WHEN l_quantity / 10 < 4.0 THEN 'neutral' ELSE 'positive' END AS bucket FROM lineitem")
def sc06(spark, d):
    s = F.col("l_quantity") / 10
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(s <= 2.5, "negative").when(s < 4.0, "neutral").otherwise("positive").alias("bucket"))


@register("sc07_score", "SELECT l_orderkey, l_linenumber, round(l_quantity * l_extendedprice, 4) AS score FROM lineitem")
def sc07(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") * F.col("l_extendedprice"), 4).alias("score"))


@register("sc11_skip_line", f"""WITH {_LINES} SELECT doc_id, line_no FROM lines WHERE length(trim(line)) < 22 OR starts_with(trim(line), '|')
    OR regexp_matches(trim(line), '^(?i:figure|table) ?[0-9]+') OR (regexp_matches(trim(line), '^[0-9]+[.)]') AND length(trim(line)) < 40)""")
def sc11(spark, d):
    return _lines(spark, d).where(tx.skip_line(F.col("line"))).select("doc_id", "line_no")


@register("sc17_path_parts", "SELECT page_id, substring(url, 1, 40) AS head, list_last(string_split(url, '/')) AS base, CASE WHEN split_part(url, '/', 1) = '.' THEN '_root' ELSE split_part(url, '/', 1) END AS top FROM pages")
def sc17(spark, d):
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", F.substring(u, 1, 40).alias("head"), tx.basename(u).alias("base"), tx.top_segment(u).alias("top"))


@register("sc20_date_parts", """WITH s AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE 'bad' END AS s, o_orderdate AS t FROM orders)
    SELECT o_orderkey, CASE WHEN s <> 'bad' THEN CAST(year(t) AS INT) END AS s_year, CASE WHEN s <> 'bad' THEN CAST(month(t) AS INT) END AS s_month, CASE WHEN s <> 'bad' THEN CAST(day(t) AS INT) END AS s_day FROM s""")
def sc20(spark, d):
    k, t = F.col("o_orderkey") % 3, F.col("o_orderdate")
    s = F.when(k == 0, F.date_format(t, "yyyy-MM-dd")).when(k == 1, F.date_format(t, "MM/dd/yyyy")).otherwise("bad")
    return tables.date_parts(read(spark, d, "orders").select("o_orderkey", s.alias("s")), "s")


@register("sc23_missing_marks", "SELECT doc_id, CASE WHEN trim(s) NOT IN ('-999','-9999','999','N/A','NA','n/a','') THEN trim(s) END AS s FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' N/A ' WHEN 1 THEN '-999' WHEN 2 THEN ' ok' ELSE source END AS s FROM documents)")
def sc23(spark, d):
    from ..operators import features

    i = F.col("doc_id") % 4
    s = F.when(i == 0, " N/A ").when(i == 1, "-999").when(i == 2, " ok").otherwise(F.col("source"))
    return read(spark, d, "documents").select("doc_id", features.missing_marks_to_null(s).alias("s"))


@register("sc24_ratio_log", "SELECT l_orderkey, l_linenumber, round(l_tax / (l_discount + 1e-8), 2) AS ratio, round(ln(1 + greatest(l_extendedprice - 30000, 0)), 6) AS logged FROM lineitem")
def sc24(spark, d):
    ratio = F.col("l_tax") / (F.col("l_discount") + F.lit(1e-8))
    logged = F.log1p(F.greatest(F.col("l_extendedprice") - 30000, F.lit(0.0)))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(ratio, 2).alias("ratio"), F.round(logged, 6).alias("logged"))


@register("sc25_interactions", "SELECT vec_id, count(*) AS n, round(sum(CAST(embedding[i] AS DOUBLE) * embedding[j]), 4) AS total FROM embeddings, range(1, 65) a(i), range(1, 65) b(j) WHERE i < j GROUP BY 1")
def sc25(spark, d):
    rows = read(spark, d, "embeddings").select("vec_id", vx.interactions(vx.doubles(F.col("embedding"))).alias("x"))
    return rows.select("vec_id", F.size("x").cast("long").alias("n"), F.round(vx.total(F.col("x")), 4).alias("total"))


@register("sc30_l2_normalize", "SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / greatest(sqrt(list_sum(list_transform(e, lambda y: y * y))), 1e-12))), 6) AS total FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def sc30(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.round(vx.total(vx.normalized(vx.doubles(F.col("embedding")))), 6).alias("total"))


@register("io14_vector_width", "SELECT vec_id, CAST(len(v) AS INT) AS n, round(list_sum(v), 6) AS total FROM (SELECT vec_id, list_concat(CAST(embedding AS DOUBLE[]), list_transform(range(80), lambda i: 0.0))[1:80] AS v FROM embeddings)")
def io14(spark, d):
    v = vx.resized(vx.doubles(F.col("embedding")), 80)
    return read(spark, d, "embeddings").select("vec_id", F.size(v).alias("n"), F.round(vx.total(v), 6).alias("total"))


@register("sc33_json_cells", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def sc33(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@register("sc36_mask_prompt", "SELECT conv_id, turn, array_to_string(list_transform(list_zip(range(len(w)), w), lambda z: CASE WHEN z[1] < 3 THEN -100 ELSE length(z[2]) END), ',') AS labels FROM (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM conversations)")
def sc36(spark, d):
    w = F.filter(F.split("text", " "), lambda x: x != "")
    masked = F.transform(w, lambda x, i: F.when(i < 3, -100).otherwise(F.length(x)))
    return read(spark, d, "conversations").select("conv_id", "turn", F.array_join(masked.cast("array<string>"), ",").alias("labels"))


_E = "(SELECT vec_id, CAST(embedding[1:10] AS DOUBLE[]) AS e FROM embeddings)"


@register("sc38_softmax_argmax", f"SELECT vec_id, CAST(list_position(e, list_max(e)) - 1 AS INT) AS top, round(1 / list_sum(list_transform(e, lambda x: exp(x - list_max(e)))), 6) AS p FROM {_E}")
def sc38(spark, d):
    e = vx.doubles(F.slice("embedding", 1, 10))
    return read(spark, d, "embeddings").select("vec_id", vx.argmax(e).alias("top"), F.round(F.array_max(vx.softmax(e)), 6).alias("p"))


@register("sc39_top_k_gate", f"""SELECT vec_id, round(list_sum(list_transform(list_zip(g, range(len(g))), lambda z: z[1] * z[2])) / list_sum(g), 6) AS mixed FROM (SELECT vec_id,
    list_transform(e, lambda x: CASE WHEN x >= list_reverse_sort(e)[2] THEN exp(x - list_max(e)) ELSE 0.0 END) AS g FROM {_E})""")
def sc39(spark, d):
    gate = vx.top_k_gate(vx.doubles(F.slice("embedding", 1, 10)), 2)
    mixed = vx.dot(gate, F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: i.cast("double")))
    return read(spark, d, "embeddings").select("vec_id", F.round(mixed, 6).alias("mixed"))


@register("ag10_stem_counts_zero", "SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY 1")
def ag10_lang(spark, d):
    return read(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@register("duplicate_rate_by_source", "SELECT source, count(*) AS n, count(DISTINCT text) AS n_unique FROM documents GROUP BY 1")
def dup_by_source(spark, d):
    return read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("text").alias("n_unique"))


