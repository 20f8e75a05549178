"""Readers and writers chosen by URI, extension or name, all through Spark."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence
from urllib.parse import urlsplit

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx

#: Spark's readers by extension; what is not listed reads as CSV with a header.
FORMATS = {"parquet": "parquet", "csv": "csv", "txt": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "orc": "orc"}
DATABASES = ("sqlite", "postgres", "postgresql", "mysql")
#: Schemes of object stores as the reader expects them.
STORES = {"s3": "s3a", "gs": "gs", "az": "abfss", "azure": "abfss", "gcs": "gs"}


def load(spark: SparkSession, source: str, schema: T.StructType | str | None = None, table: str = "data", **options: str) -> DataFrame:
    """A table from a URI: databases by JDBC, stores and files by extension.

    Text formats are read without inference where a schema is given.
    """
    parts = urlsplit(source)
    if parts.scheme in DATABASES:
        return spark.read.jdbc(f"jdbc:{source}", table, properties=options)
    path = source
    if parts.scheme in STORES:
        path = source.replace(f"{parts.scheme}://", f"{STORES[parts.scheme]}://", 1)
    extension = parts.path.rstrip("/").rpartition(".")[2].lower()
    reader = spark.read.format(FORMATS.get(extension, "csv")).options(**options)
    if FORMATS.get(extension, "csv") == "csv":
        reader = reader.option("header", True).option("sep", "\t" if extension == "tsv" else options.get("sep", ","))
        reader = reader if schema else reader.option("inferSchema", True)
    return (reader.schema(schema) if schema else reader).load(path)


def load_named(spark: SparkSession, source: str, path: str, **options: str) -> DataFrame:
    """A table from a named kind of source; unknown names are an error."""
    if source in ("local", "nas"):
        return load(spark, path, **options)
    if source in ("s3", "azure", "gcs"):
        return load(spark, f"{STORES[source]}://{path.split('://')[-1]}", **options)
    raise ValueError(f"unknown source {source!r}")


def discover(spark: SparkSession, root: str, pattern: str = "*.parquet", without: str | None = None) -> DataFrame:
    """Rows (path, size, modified) of the files under a folder, listed by Spark, contents not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    listed = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return listed if without is None else listed.where(~F.col("path").contains(f"/{without}/"))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Files by their extension and first folder."""
    relative = F.regexp_replace("path", f"^(file:)?/*{root.strip('/')}/", "")
    suffix = F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1)
    return discover(spark, root, "*").select(relative.alias("relative_path"), "size", "modified", suffix.alias("suffix"), tx.top_segment(relative).alias("top"))


def features_and_target(df: DataFrame, target: str = "label", shuffle_seed: int | None = None) -> DataFrame:
    """Numeric columns and the target as a long; shuffled by a seeded hash for training."""
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != target]
    out = df.select(*numbers, F.col(target).cast("long").alias(target))
    return out if shuffle_seed is None else out.orderBy(F.xxhash64(*numbers, F.lit(shuffle_seed)))


def first_rows(df: DataFrame, key: str, n: int, columns: Sequence[str] | None = None) -> DataFrame:
    """The first ``n`` rows by a key: a heap in every task, no sort of all."""
    return (df.select(*columns) if columns else df).orderBy(key).limit(n)


def label_batches(df: DataFrame, text: str, label: Column) -> DataFrame:
    """Pruned to text and a mapped label; rows whose label can't be mapped are left out."""
    return df.select(F.col(text).alias("text"), label.alias("label")).where("label is not null")


def write_checked(df: DataFrame, path: str) -> int:
    """Parquet written beside the target, counted, then moved into place; returns the rows.

    An error leaves the target as it was.
    """
    spark = df.sparkSession
    temporary = f"{path}.tmp-{uuid.uuid4().hex}"
    df.write.option("compression", "snappy").parquet(temporary)
    rows = spark.read.parquet(temporary).count()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hadoop.Path(path), True)
    if not fs.rename(hadoop.Path(temporary), hadoop.Path(path)):
        raise OSError(f"could not move {temporary} to {path}")
    return rows


def write_split(df: DataFrame, path: str, column: str) -> DataFrame:
    """Parquet partitioned by a slug of a column; returns the map of slugs to values.

    Two values with one slug are an error, found before anything is written.
    """
    named = df.where(F.col(column).isNotNull()).withColumn("slug", tx.slug(F.trim(F.col(column))))
    stems = named.select("slug", F.trim(F.col(column)).alias("original")).distinct()
    clash = stems.groupBy("slug").count().where("count > 1").limit(1).collect()
    if clash:
        raise ValueError(f"several values share the name {clash[0]['slug']!r}")
    named.write.partitionBy("slug").mode("overwrite").parquet(path)
    return stems


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def kafka_features(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A stream of (features, label) from JSON messages; messages without features are left out."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "latest").load()
    return parse_features(raw.select(F.col("value").cast("string").alias("value")))


def parse_features(messages: DataFrame, column: str = "value") -> DataFrame:
    parsed = F.from_json(column, "features array<float>, label int", {"mode": "PERMISSIVE"})
    return messages.select(parsed.alias("m")).select("m.*").where("features is not null")


def lines_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder as a stream of trimmed lines."""
    return spark.readStream.text(folder).select(F.trim("value").alias("line"))


def load_split(spark: SparkSession, split: str, config: Mapping[str, Mapping[str, str]] | None = None, source: str | None = None, **options: str) -> DataFrame:
    """The table of a split: kind and ``<split>_path`` from the section ``data`` of a configuration.

    ``source`` overrides the configured kind; without a path the split is ``data/<split>.csv``.
    """
    data = (config or {}).get("data", {})
    return load_named(spark, source or data.get("source", "local"), data.get(f"{split}_path", f"data/{split}.csv"), **options)


def write_metrics(df: DataFrame, path: str, group: str, item: str) -> None:
    """One JSON object for each ``group``: its ``item``s with the other columns nested beneath; null items are left out."""
    fields = F.struct(*(c for c in df.columns if c not in (group, item)))
    nested = df.where(F.col(item).isNotNull()).groupBy(group).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(item).cast("string"), fields)))).alias("items"))
    nested.write.mode("overwrite").json(path)


def manifest(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Rows (path, size, sha512) of the files under a folder, each file hashed where it is read.

    Files without bytes are not listed, as Spark's readers leave them out.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return found.select("path", F.col("length").alias("size"), F.sha2("content", 512).alias("sha512"))


def check_manifest(stored: DataFrame, root: str, pattern: str = "*") -> DataFrame:
    """Rows (path, problem) of files that are ``missing``, or ``changed`` since the manifest was made."""
    now = manifest(stored.sparkSession, root, pattern).select("path", F.col("sha512").alias("now"))
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha512"), "changed")
    return stored.join(now, "path", "left").select("path", problem.alias("problem")).where("problem is not null")


def wait_stable(spark: SparkSession, root: str, stable: float, poll: float = 1.0, pattern: str = "*.parquet", most: float | None = None) -> DataFrame:
    """Waits until the files under a folder, at least one, keep names, sizes and times for ``stable`` seconds; returns their list.

    Beyond ``most`` seconds of waiting it is an error.  Only a digest of the list comes to the driver.
    """
    begun, since, last = time.monotonic(), time.monotonic(), None
    while True:
        try:
            found = discover(spark, root, pattern)
            seen = tuple(found.agg(F.count("*"), F.sum(F.xxhash64("path", "size", "modified").cast("decimal(38,0)"))).first())
        except AnalysisException:  # the folder isn't there yet
            found, seen = None, (0, None)
        now = time.monotonic()
        if seen != last:
            last, since = seen, now
        elif seen[0] and now - since >= stable:
            return found
        if most is not None and now - begun > most:
            raise TimeoutError(f"{root} was not stable within {most} seconds")
        time.sleep(poll)
