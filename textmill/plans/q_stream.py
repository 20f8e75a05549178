"""Queries: stateful operators in batch form and their streaming twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import windows
from ..session import ensure_checkpoint_dir
from ..sources import files
from ..streaming import stateful
from .base import read
from .catalog import register

_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@register("st01_welford", f"""SELECT event_id, round(CASE WHEN n < 20 THEN value ELSE (value - m) / sqrt(v + 1e-8) END, 5) AS scaled FROM
    (SELECT event_id, value, count(*) {_W} AS n, avg(value) {_W} AS m, var_samp(value) {_W} AS v FROM events)""")
def st01(spark, d):
    out = windows.welford(read(spark, d, "events"), "value", "user_id", ["ts", "event_id"], 20)
    return out.select("event_id", F.round("scaled", 5).alias("scaled"))


@register("st02_ema", """WITH RECURSIVE r AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    e AS (SELECT event_id, user_id, rn, value AS m, CAST(0.95 AS DOUBLE) AS v, CAST(0 AS DOUBLE) AS s FROM r WHERE rn = 1 UNION ALL
    SELECT r.event_id, r.user_id, r.rn, 0.95 * e.m + 0.05 * r.value, 0.95 * e.v + 0.05 * (r.value - (0.95 * e.m + 0.05 * r.value)) * (r.value - (0.95 * e.m + 0.05 * r.value)),
      (r.value - (0.95 * e.m + 0.05 * r.value)) / sqrt(0.95 * e.v + 0.05 * (r.value - (0.95 * e.m + 0.05 * r.value)) * (r.value - (0.95 * e.m + 0.05 * r.value)) + 1e-8)
    FROM e JOIN r ON r.user_id = e.user_id AND r.rn = e.rn + 1) SELECT event_id, round(s, 5) + 0.0 AS ema_scaled FROM e""")
def st02(spark, d):
    out = windows.ema_scaler(read(spark, d, "events"), "value", "user_id", ["ts", "event_id"])
    return out.select("event_id", (F.round("ema_scaled", 5) + F.lit(0.0)).alias("ema_scaled"))


@register("st03_sliding_scaler", """WITH r AS (SELECT *, row_number() OVER w AS rn, avg(value) OVER f AS m, stddev_samp(value) OVER f AS s FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
    h AS (SELECT event_id, value, last_value(CASE WHEN rn % 10 = 0 THEN m END IGNORE NULLS) OVER u AS m, last_value(CASE WHEN rn % 10 = 0 THEN s END IGNORE NULLS) OVER u AS s FROM r
      WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT event_id, round(CASE WHEN m IS NULL THEN value ELSE (value - m) / CASE WHEN s > 0 THEN s ELSE 1 END END, 5) AS scaled FROM h""")
def st03(spark, d):
    out = windows.sliding_scaler(read(spark, d, "events"), "value", "user_id", ["ts", "event_id"], 50, 10)
    return out.select("event_id", F.round("scaled", 5).alias("scaled"))


@register("st04_first_seen_codes", "SELECT event_type, row_number() OVER (ORDER BY f) AS code FROM (SELECT event_type, min(event_id) AS f FROM events GROUP BY 1)")
def st04(spark, d):
    return windows.first_seen_codes(read(spark, d, "events"), "event_type", ["event_id"]).select("event_type", F.col("code").cast("long").alias("code"))


_DDM = """r AS (SELECT event_id, user_id, ts, n, p, sqrt(p * (1 - p) / n) AS s FROM (SELECT event_id, user_id, ts, count(*) OVER w AS n, avg(CASE WHEN value > 60 THEN 1.0 ELSE 0.0 END) OVER w AS p FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))),
  l AS (SELECT *, min(CASE WHEN n >= 30 THEN {'t': p + s, 'p': p, 's': s} END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low FROM r)"""


@register("st07_ddm_levels", f"WITH {_DDM} SELECT event_id, CASE WHEN low IS NULL THEN 'stable' WHEN p + s > low.p + 3.0 * low.s THEN 'drift' WHEN p + s > low.p + 2.0 * low.s THEN 'warning' ELSE 'stable' END AS level FROM l")
def st07(spark, d):
    e = read(spark, d, "events").withColumn("error", (F.col("value") > 60).cast("int"))
    return windows.ddm_levels(e, "error", "user_id", ["ts", "event_id"]).select("event_id", "level")


@register("st08_running_normal", f"SELECT event_id, round(greatest(-10, least(10, (value - m) / sqrt(v + 1e-8))), 4) + 0.0 AS normal FROM (SELECT event_id, value, avg(value) {_W} AS m, var_pop(value) {_W} AS v FROM events)")
def st08(spark, d):
    out = windows.running_normal(read(spark, d, "events"), "value", "user_id", ["ts", "event_id"])
    return out.select("event_id", (F.round("normal", 4) + F.lit(0.0)).alias("normal"))


@register("st16_windowed_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def st16(spark, d):
    out = stateful.windowed_counts(read(spark, d, "events"), "ts", "event_type", "value")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("st16_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def st16_sessions(spark, d):
    out = stateful.sessions(read(spark, d, "events"), "ts", "user_id")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


def run_to_table(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all files there are, into Parquet in the checkpoint folder."""
    place = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{place}/{folder}").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/{folder}")


def _events(spark: SparkSession, d: str) -> DataFrame:
    batch = read(spark, d, "events")
    return spark.readStream.schema(batch.schema).option("pathGlobFilter", "events*").parquet(d)


@register("st01_welford_stream", f"""SELECT event_id, round(CASE WHEN n < 20 THEN value ELSE (value - m) / sqrt(v + 1e-8) END, 5) AS scaled FROM
    (SELECT event_id, value, count(*) {_W.replace('ts, ', '')} AS n, avg(value) {_W.replace('ts, ', '')} AS m, var_samp(value) {_W.replace('ts, ', '')} AS v FROM events)""")
def st01_stream(spark, d):
    out = run_to_table(spark, stateful.welford_stream(_events(spark, d), "user_id", "event_id", "value", 20), "welford")
    return out.select("event_id", F.round("scaled", 5).alias("scaled"))


@register("st02_ema_stream")
def st02_stream(spark, d):
    return run_to_table(spark, stateful.ema_stream(_events(spark, d), "user_id", "event_id", "value"), "ema")


@register("st05_page_hinkley_stream")
def st05(spark, d):
    return run_to_table(spark, stateful.page_hinkley_stream(_events(spark, d), "user_id", "event_id", "value", alpha=0.1), "page_hinkley")


@register("st06_adwin_stream")
def st06(spark, d):
    return run_to_table(spark, stateful.adwin_stream(_events(spark, d), "user_id", "event_id", "value"), "adwin")


@register("st07_ddm_stream")
def st07_stream(spark, d):
    errors = _events(spark, d).withColumn("value", (F.col("value") > 60).cast("double"))
    return run_to_table(spark, stateful.ddm_stream(errors, "user_id", "event_id", "value"), "ddm")


@register("io22_parse_messages", "SELECT count(*) AS n, sum(CAST(round(value) AS BIGINT) % 3) AS labels FROM events WHERE event_id % 5 <> 0")
def io22(spark, d):
    e = read(spark, d, "events")
    message = F.when(F.col("event_id") % 5 == 0, F.lit('{"label": 1}')).otherwise(F.to_json(F.struct(F.array("value").alias("features"), (F.round("value").cast("long") % 3).alias("label"))))
    parsed = files.parse_features(e.select(message.alias("value")))
    return parsed.agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("labels"))


@register("io06_features_and_target", "SELECT c_custkey, c_acctbal, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer")
def io06(spark, d):
    return files.features_and_target(read(spark, d, "customer"), "c_nationkey")


@register("io08_first_rows", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def io08(spark, d):
    return files.first_rows(read(spark, d, "documents"), "doc_id", 100, ["doc_id", "lang"])


@register("io01_load_by_extension", "SELECT n_nationkey, n_name FROM nation")
def io01(spark, d):
    return files.load(spark, f"{d}/nation.parquet").select("n_nationkey", "n_name")
