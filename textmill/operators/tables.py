"""Whole-table operators: unions with a common schema, dedup, pivots, cleaning, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import text as tx
from ..functions.vectors import bound


def processed(df: DataFrame, text: str, label: Column | None, stem: Column | str) -> DataFrame:
    """The common schema: text, sentiment_value (0 without labels) and source_stem."""
    value = F.lit(0) if label is None else label
    name = F.lit(stem) if isinstance(stem, str) else stem
    return df.select(F.coalesce(F.col(text).cast("string"), F.lit("None")).alias("text"), value.cast("bigint").alias("sentiment_value"), name.alias("source_stem"))


def union_all(parts: Sequence[DataFrame], strict: bool = True) -> DataFrame:
    """All rows, columns by name; ``strict`` wants the same set of columns everywhere."""
    out = parts[0]
    for p in parts[1:]:
        if strict and set(p.columns) != set(out.columns):
            raise ValueError(f"columns differ: {sorted(set(p.columns) ^ set(out.columns))}")
        out = out.unionByName(p, allowMissingColumns=not strict)
    return out


def map_labels_by_file(df: DataFrame, file: str, label: str) -> DataFrame:
    """Numeric labels named by the label set of their file: 0, 1, 2 or 0, 1; others as they are."""
    sets = df.where(F.col(label).isNotNull()).groupBy(file).agg(F.array_sort(F.collect_set(F.col(label).cast("string"))).alias("__set"))
    value = F.col(label).cast("string")

    def named(names: Sequence[str]) -> Column:
        out = value
        for i, n in enumerate(names):
            out = F.when(value == str(i), n).otherwise(out)
        return out

    three, two = F.array(*map(F.lit, "012")), F.array(*map(F.lit, "01"))
    mapped = F.when(F.col("__set") == three, named(("negative", "neutral", "positive"))).when(F.col("__set") == two, named(("negative", "positive"))).otherwise(value)
    return df.where(F.col(label).isNotNull()).join(sets, file).withColumn(label, mapped).drop("__set")


def drop_blank(df: DataFrame, text: str) -> DataFrame:
    return df.where(F.trim(F.col(text)) != "")


def drop_empty_pairs(df: DataFrame, text: str, label: str) -> DataFrame:
    """Rows go only if both the text and the label are empty."""
    empty = (F.coalesce(F.col(text), F.lit("")) == "") & F.coalesce(F.col(label).cast("string"), F.lit("")).isin("", "nan", "None", "NaN")
    return df.where(~empty)


def concat_columns(df: DataFrame, columns: Sequence[str], null: str = "nan") -> Column:
    """``name: value`` of all columns, in order."""
    return F.concat_ws(", ", *(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(null))) for c in columns))


def first_by_priority(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row of each key: the first by ``order``, by one aggregation."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(*key, "__r.*")


def pivot_sum(df: DataFrame, index: str, column: str, values: Sequence, value: str) -> DataFrame:
    """Sums of a value for stated columns; the list spares a pass over the data."""
    return df.groupBy(index).pivot(column, list(values)).agg(F.sum(value)).na.fill(0)


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def numeric_if_parsed(df: DataFrame, column: str, share: float = 0.9) -> tuple[DataFrame, bool]:
    """The column as numbers where more than ``share`` of all rows parse; one pass decides."""
    parsed = df.agg(F.avg(F.col(column).try_cast("double").isNotNull().cast("int"))).first()[0] or 0.0
    return (df.withColumn(column, F.col(column).try_cast("double")), True) if parsed > share else (df, False)


def date_parts(df: DataFrame, column: str, formats: Sequence[str] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy")) -> DataFrame:
    """Year, month and day in place of a date string; null where no format fits."""
    at = F.coalesce(*(F.try_to_timestamp(F.col(column), F.lit(f)) for f in formats))
    return df.withColumns({f"{column}_year": F.year(at), f"{column}_month": F.month(at), f"{column}_day": F.dayofmonth(at)}).drop(column)


def flatten_metrics(df: DataFrame, payload: str, fields: Mapping[str, str]) -> DataFrame:
    """Columns from the paths of a JSON string; missing ones are empty strings."""
    return df.select("*", *(F.coalesce(F.get_json_object(payload, f"$.{p}"), F.lit("")).alias(n) for n, p in fields.items())).drop(payload)


def label_counts(df: DataFrame, group: str, label: str) -> DataFrame:
    return df.groupBy(group, label).agg(F.count("*").alias("n"))


def normalized_histogram(df: DataFrame, label: Column, classes: int, stem: Column | None = None) -> DataFrame:
    """Rows of each normalised class; what can't be mapped is counted under -1."""
    y = F.coalesce(lb.normalize(label, classes, stem), F.lit(-1))
    return df.groupBy(y.alias("label")).agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column).limit(k)


def export_rows(df: DataFrame, name: str, metrics: Sequence[str]) -> DataFrame:
    """Report rows: escaped names, numbers of four decimals; all metrics must be there."""
    kept = df.dropna(how="any", subset=list(metrics))
    return kept.select(tx.tex_escape(F.col(name)).alias(name), *(tx.fixed_or_dash(F.col(m)).alias(m) for m in metrics))


def log_histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Counts of log10(x + 1) in equal bins from its least to its largest value."""
    x = df.select(F.log10(F.col(column) + 1).alias("x"))
    s = x.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi")).alias("s")).scalar()
    at = F.floor((F.col("x") - s["lo"]) / F.when(s["hi"] > s["lo"], (s["hi"] - s["lo"]) / bins).otherwise(1.0))
    return x.groupBy(F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def longest_ancestor(paths: DataFrame, path: str, roots: DataFrame, root: str) -> DataFrame:
    """For each path the nearest of its directories that is listed: directories are exploded and joined."""
    ancestors = lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, 1, i), "/"))
    dirs = paths.select(path, F.explode(bound(F.split(path, "/"), ancestors)).alias(root))
    best = dirs.join(roots.select(root).distinct(), root).groupBy(path).agg(F.max_by(root, F.length(root)).alias(root))
    return paths.select(path).join(best, path, "left")


#: Fields of a model's configuration that reports show; fixed values.
CONFIG_FIELDS = ("n_classes", "model_name", "tokenizer_name", "hidden_size", "num_labels", "embed_dim")
_WRAPPED = r'^\s*\{\s*"(?:[^"\\]|\\.)*"\s*:\s*\{'


def shallow_extract(df: DataFrame, raw: str, fields: Sequence[str] = CONFIG_FIELDS) -> DataFrame:
    """Adds what a report shows of a JSON text; what doesn't apply, and all of an invalid text, is null.

    An object of one key over an object gives model_class and ``fields``; any other object top_keys, its first 20;
    a list list_length and, where its first element is an object, list_item_keys.
    """
    keys = F.json_object_keys(raw)
    one = (F.size(keys) == 1) & F.col(raw).rlike(_WRAPPED)
    name = F.when(one, keys[0])
    inner = F.get(F.map_values(F.from_json(raw, "map<string,string>")), F.lit(0))
    listed = F.col(raw).rlike(r"^\s*\[")
    first = F.get_json_object(raw, "$[0]")
    return df.select(
        "*", name.alias("model_class"), *(F.when(one, F.get_json_object(inner, f"$.{f}")).alias(f) for f in fields),
        F.when((F.size(keys) > 0) & ~one, F.slice(keys, 1, 20)).alias("top_keys"),
        F.when(listed, F.json_array_length(raw)).alias("list_length"),
        F.when(listed, F.json_object_keys(first)).alias("list_item_keys"),
    )


def config_targets(df: DataFrame, path: str, raw: str, classes: Mapping[str, int], without: Sequence[str] = (), without_class: Sequence[str] = ()) -> DataFrame:
    """Rows (path, n_classes, stem, model_id, model_class) of the configurations to scan.

    Left out are paths that fit a pattern of ``without``, texts that aren't a JSON object with a key, root classes in
    ``without_class``, and paths without a folder of ``classes``, the first of which gives the number of classes.
    """
    p = F.col(path)
    number = F.coalesce(*(F.when(p.contains(f"/{folder}/"), F.lit(n)) for folder, n in classes.items()))
    root = F.get(F.json_object_keys(raw), F.lit(0))
    plain = F.regexp_replace(p, r"\.[^./]*$", "")
    kept = df.where(F.coalesce(F.size(F.json_object_keys(raw)) > 0, F.lit(False)) & number.isNotNull() & ~root.isin(*without_class))
    for pattern in without:
        kept = kept.where(~p.rlike(pattern))
    return kept.select(p.alias("path"), number.alias("n_classes"), F.regexp_extract(plain, r"([^/]*)$", 1).alias("stem"), F.translate(F.ltrim(plain, F.lit("/")), "/", "_").alias("model_id"), root.alias("model_class"))
