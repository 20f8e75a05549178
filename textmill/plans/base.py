"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: DuckDB's lower-casing of everything and white-space squeezing, as in functions.text.squeeze.
SPACE = r"[ \t\n\x0B\f\r]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
