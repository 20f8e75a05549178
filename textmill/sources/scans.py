"""Scans that a training run asks for: pruned, sharded, merged, and what the files' own metadata say."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels as lb
from ..functions import text as tx
from ..functions import vectors as vx
from ..operators.ranking import row_index, with_count


def coerced(df: DataFrame, column: str):
    """A label column as a whole number, by its type."""
    kind = df.schema[column].dataType
    return lb.coerce_string(F.col(column)) if isinstance(kind, T.StringType) else lb.coerce_number(F.col(column))


def text_rows(df: DataFrame, classes: int, most: int | None = None, key: str | None = None, text: str | None = None, label: str | None = None, without_neutral: bool = False) -> DataFrame:
    """Rows (text, label) of a table whose columns are told by their names; ``most`` rows are taken before labels are looked at.

    Labels that can't be mapped are left out, and so is class 2 where ``without_neutral`` is set.
    """
    text, label = text or lb.text_column(df.columns), label or lb.label_column(df.columns)
    if text is None or label is None:
        raise ValueError(f"no text or label among {df.columns}")
    if most is not None:
        df = df.orderBy(key).limit(most) if key else df.limit(most)
    out = df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), lb.normalize(coerced(df, label), classes).alias("label")).where("label is not null")
    return out.where("label <> 2") if without_neutral else out


def feature_rows(df: DataFrame, classes: int, width: int, keep: Sequence[str] = (), features: str | None = None, label: str | None = None) -> DataFrame:
    """Rows (*keep, features, label): vectors brought to one width; empty vectors and unmapped labels are left out."""
    features, label = features or lb.feature_column(df.columns), label or lb.label_column(df.columns)
    if features is None or label is None:
        raise ValueError(f"no features or label among {df.columns}")
    out = df.select(*keep, vx.resized(vx.doubles(F.col(features)), width).alias("features"), lb.normalize(coerced(df, label), classes).alias("label"))
    return out.where("features is not null and label is not null")


def shard(df: DataFrame, key: str, rank: int, world: int, contiguous: bool = True) -> DataFrame:
    """The rows of one of ``world`` readers: a run [rank N / W, (rank + 1) N / W) in key order.

    Otherwise every W-th row, and the last N mod W rows go to nobody, so that all readers have as many.
    """
    rows = with_count(row_index(df, key, (), "__i"), "__n")
    i, n = F.col("__i"), F.col("__n")
    if contiguous:
        mine = (i >= F.floor(F.lit(rank) * n / world)) & (i < F.floor(F.lit(rank + 1) * n / world))
    else:
        mine = (i % world == rank) & (i < F.floor(n / world) * world)
    return rows.where(mine).drop("__i", "__n")


def merged(parts: Sequence[tuple[DataFrame, str, str]], most_each: int | None = None) -> DataFrame:
    """Rows (text, part) of several tables (table, text column, key), the first ``most_each`` of each, without blank texts."""
    taken = [(df.orderBy(key).limit(most_each) if most_each is not None else df).select(F.col(text).alias("text"), F.lit(i).alias("part")) for i, (df, text, key) in enumerate(parts)]
    return reduce(DataFrame.unionByName, taken).where(F.trim("text") != "")


def mapped_columns(df: DataFrame, positions: dict[str, int]) -> DataFrame:
    """Columns picked by their place and named anew, for raw files whose headers can't be trusted."""
    columns = df.columns
    return df.select(*(F.col(f"`{columns[i]}`").alias(name) for name, i in positions.items()))


def with_file_name(df: DataFrame, name: str = "source") -> DataFrame:
    """Adds the name of the file that a row was read from."""
    return df.withColumn(name, F.col("_metadata.file_name"))


def parquet_metadata(df: DataFrame) -> DataFrame:
    """Rows (path, n_rows, n_row_groups, n_columns, bytes) from the footers of a table's files, read by executors."""
    files = df.select(F.col("_metadata.file_path").alias("path")).distinct()

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs
        import pyarrow.parquet

        for batch in batches:
            out = []
            for path in batch["path"]:
                fs, inner = pyarrow.fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
                meta = pyarrow.parquet.read_metadata(inner, filesystem=fs)
                out.append((path, meta.num_rows, meta.num_row_groups, meta.num_columns, fs.get_file_info(inner).size))
            yield pd.DataFrame(out, columns=["path", "n_rows", "n_row_groups", "n_columns", "bytes"])

    return files.mapInPandas(footers, "path string, n_rows long, n_row_groups int, n_columns int, bytes long")


def key_values(lines: DataFrame, line: str) -> DataFrame:
    """Rows (key, value) of lines ``key=value``; blank lines and those that begin with # are skipped."""
    t = F.trim(F.col(line))
    kept = lines.where((t != "") & ~t.startswith("#") & t.contains("="))
    return kept.select(F.trim(F.substring_index(t, "=", 1)).alias("key"), F.trim(F.expr(f"substring(trim({line}), locate('=', trim({line})) + 1)")).alias("value"))


def same_columns(df: DataFrame, reference: Sequence[str], junk: Sequence[str] = ("__index_level_0__",)) -> DataFrame:
    """The columns of a reference in its order; junk columns go, others that are missing or too many are an error."""
    rest = [c for c in df.columns if c not in junk]
    if set(rest) != set(reference):
        raise ValueError(f"missing {sorted(set(reference) - set(rest))}, too many {sorted(set(rest) - set(reference))}")
    return df.select(*reference)


def paired(left: DataFrame, right: DataFrame, path: str = "path") -> DataFrame:
    """Rows (path) that two listings have in common, each once."""
    return left.select(path).distinct().join(right.select(path).distinct(), path)


def clean_lines(df: DataFrame, line: str) -> DataFrame:
    """Lines without page footers."""
    return df.where(~tx.is_footer(F.col(line)))
