"""Queries: configurations, manifests, saved preparations, resumed and bounded reading."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import callables, joins, sampling, tables, tabular
from ..session import ensure_checkpoint_dir
from ..sources import files
from .base import read
from .catalog import register


def _folder(spark, name: str) -> str:
    """A new folder among the shared ones."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- sources and sinks


@register("io07_load_split", "SELECT o_orderkey, o_orderstatus FROM orders")
def io07(spark, d):
    return files.load_split(spark, "val", {"data": {"source": "nas", "val_path": f"{d}/orders.parquet"}}, source="local").select("o_orderkey", "o_orderstatus")


@register("io28_append_rows", "SELECT l_returnflag AS k, count(*) * 2 AS n FROM lineitem GROUP BY 1")
def io28(spark, d):
    path = _folder(spark, "appended")
    rows = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.count("*").alias("n"))
    files.append_rows(rows, path)
    files.append_rows(rows, path)
    return spark.read.schema("k string, n long").option("header", True).csv(path).groupBy("k").agg(F.sum("n").alias("n"))


@register("io29_metrics_json", "SELECT source AS model, lang AS dataset, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2")
def io29(spark, d):
    path = _folder(spark, "metrics")
    rows = read(spark, d, "documents").groupBy(F.col("source").alias("model"), F.col("lang").alias("dataset"))
    files.write_metrics(rows.agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars")), path, "model", "dataset")
    back = spark.read.schema("model string, items map<string, struct<n: bigint, chars: bigint>>").json(path)
    return back.select("model", F.explode("items").alias("dataset", "m")).select("model", "dataset", "m.n", "m.chars")


@register("io33_inventory", "SELECT '.parquet' AS suffix, true AS has_bytes")
def io33(spark, d):
    return files.inventory(spark, d).where("suffix = '.parquet'").groupBy("suffix").agg((F.sum("size") > 0).alias("has_bytes"))


@register("hp18_manifest")
def hp18(spark, d):
    return files.manifest(spark, f"{d}/region.parquet")


@register("st15_stable_folder", "SELECT true AS stable")
def st15(spark, d):
    return files.wait_stable(spark, f"{d}/region.parquet", 0.2, 0.1, most=60).agg((F.count("*") > 0).alias("stable"))


# ---------------------------------------------------------------- configurations

_PATH = "CASE doc_id % 5 WHEN 0 THEN '/c/2_labels/' WHEN 1 THEN '/c/3_labels/' WHEN 2 THEN '/c/moe/2_labels/experts' WHEN 3 THEN '/c/old/3_labels/' ELSE '/c/none/' END || source || '.' || doc_id || '.json'"


def _configs(spark, d):
    """Documents as configurations: wrapped, wide, lists and broken ones, under paths of several kinds."""
    raw = (
        F.when(F.col("doc_id") % 7 < 3, F.to_json(F.create_map(F.coalesce("source", F.lit("none")), F.struct(F.col("doc_id").alias("hidden_size"), F.lit("m").alias("model_name")))))
        .when(F.col("doc_id") % 7 == 3, F.to_json(F.struct(F.col("doc_id").alias("a"), F.lit(2).alias("b"))))
        .when(F.col("doc_id") % 7 == 4, F.to_json(F.array(F.struct(F.col("doc_id").alias("k")), F.struct(F.lit(1).cast("long").alias("k")))))
        .when(F.col("doc_id") % 7 == 5, F.lit("{broken"))
        .otherwise(F.lit("{}"))
    )
    return read(spark, d, "documents").select("doc_id", F.expr(_PATH).alias("path"), raw.alias("raw"))


@register("hp10_shallow_extract", """SELECT doc_id, CASE WHEN doc_id % 7 < 3 THEN coalesce(source, 'none') END AS model_class, CASE WHEN doc_id % 7 < 3 THEN CAST(doc_id AS VARCHAR) END AS hidden_size,
    CASE WHEN doc_id % 7 < 3 THEN 'm' END AS model_name, CASE WHEN doc_id % 7 = 3 THEN 'a,b' END AS top_keys,
    CASE WHEN doc_id % 7 = 4 THEN 2 END AS list_length, CASE WHEN doc_id % 7 = 4 THEN 'k' END AS list_item_keys FROM documents""")
def hp10(spark, d):
    out = tables.shallow_extract(_configs(spark, d), "raw")
    joined = {c: F.array_join(c, ",") for c in ("top_keys", "list_item_keys")}
    return out.select("doc_id", "model_class", "hidden_size", "model_name", "list_length", *(j.alias(c) for c, j in joined.items()))


@register("un10_config_targets", f"""SELECT path, CASE doc_id % 5 WHEN 0 THEN 2 ELSE 3 END AS n_classes, source || '.' || doc_id AS stem, replace(substring(path, 2, length(path) - 6), '/', '_') AS model_id,
    CASE WHEN doc_id % 7 = 3 THEN 'a' ELSE source END AS model_class FROM (SELECT *, {_PATH} AS path FROM documents) WHERE doc_id % 5 IN (0, 1) AND doc_id % 7 <= 3 AND CASE WHEN doc_id % 7 = 3 THEN 'a' ELSE source END <> 'src0'""")
def un10(spark, d):
    return tables.config_targets(_configs(spark, d), "path", "raw", {"2_labels": 2, "3_labels": 3}, (r"/moe/(.*/)?experts[^/]*$", "/old/"), ("src0",))


# ---------------------------------------------------------------- preparations

_TABLE = "SELECT l_orderkey, l_linenumber, CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN NULL ELSE l_quantity END AS q, l_tax AS t, l_returnflag AS f, l_linestatus AS s FROM lineitem"
_PREPARED = f"""WITH holes AS ({_TABLE}), filled AS (SELECT *, coalesce(q, (SELECT quantile_disc(q, 0.5) FROM holes)) AS x FROM holes)
    SELECT l_orderkey, l_linenumber, round((x - (SELECT avg(x) FROM filled)) / (SELECT stddev_pop(x) FROM filled), 6) AS q_scaled, CAST(q IS NULL AS INT) AS q_missing,
    round((t - (SELECT avg(t) FROM filled)) / (SELECT stddev_pop(t) FROM filled), 6) AS t_scaled, CAST(f = 'A' AS INT) AS f_0, CAST(f = 'N' AS INT) AS f_1, CAST(f = 'R' AS INT) AS f_2, CAST(s = 'O' AS INT) AS s_1 FROM filled"""


def _holes(spark, d):
    gap = (F.col("l_orderkey") + F.col("l_linenumber")) % 7 == 0
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(~gap, F.col("l_quantity")).alias("q"), F.col("l_tax").alias("t"), F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"))


def _shown(prepared):
    return prepared.select("l_orderkey", "l_linenumber", F.round("q_scaled", 6).alias("q_scaled"), "q_missing", F.round("t_scaled", 6).alias("t_scaled"), "f_0", "f_1", "f_2", "s_1")


@register("fp27_tabular", _PREPARED)
def fp27(spark, d):
    rows = _holes(spark, d)
    return _shown(tabular.fit(rows, ["q", "t"], ["f", "s"]).transform(rows))


@register("fp29_saved_preparation", _PREPARED)
def fp29(spark, d):
    path, rows = _folder(spark, "preparation"), _holes(spark, d)
    tabular.load_or_fit(rows, path, ["q", "t"], ["f", "s"])
    again = tabular.load_or_fit(rows.limit(0), path, ["q", "t"], ["f", "s"])  # read, not fitted anew
    return _shown(again.transform(rows))


@register("fp16_iterative_impute")
def fp16(spark, d):
    gap = lambda k: F.pmod(F.xxhash64("l_orderkey", "l_linenumber", F.lit(k)), F.lit(9)) == 0
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(~gap(1), F.col("l_quantity")).alias("q"), F.when(~gap(2), F.col("l_extendedprice")).alias("p"), "l_tax")
    return tabular.iterative_impute(rows, ["q", "p", "l_tax"])


# ---------------------------------------------------------------- bounded and resumed reading


@register("st10_fifo", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 5")
def st10(spark, d):
    return sampling.fifo(read(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id", 5)


@register("st14_resume", "SELECT o_orderkey, CAST(i // 32 AS BIGINT) AS batch FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i // 32 >= 3")
def st14(spark, d):
    return callables.resume(read(spark, d, "orders").select("o_orderkey"), 32, "o_orderkey", 3)


@register("hp20_small_pairs", """SELECT doc_id, text, vec_id FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS i FROM documents) a
    JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings) b USING (i) WHERE i <= 200""")
def hp20(spark, d):
    left = files.first_rows(read(spark, d, "documents").select("doc_id", "text"), "doc_id", 200)
    right = files.first_rows(read(spark, d, "embeddings").select("vec_id"), "vec_id", 200)
    return joins.zip_join(left, right, "doc_id", "vec_id").select("doc_id", "text", "vec_id")
