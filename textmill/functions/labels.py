"""Label expressions: coercion, normalisation to two or three classes, names and keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names and the tables that results depend on.
POSITIVE = ("positive", "pos", "1", "yes")
NEGATIVE = ("negative", "neg", "0", "no")
NEUTRAL = ("neutral", "neu", "2")
STAR_STEMS = ("amazon_reviews", "yelp_review", "yelp_business")
TEXT_COLUMNS = ("text", "review", "statement", "tweet", "sentence", "body")
LABEL_COLUMNS = ("label", "sentiment", "target", "sentiment_value", "class")
FEATURE_COLUMNS = ("features_100d", "features", "embedding", "vector")


def _by_name(columns: Sequence[str], names: Sequence[str], parts: Sequence[str]) -> str | None:
    lowered = {c.strip().lower(): c for c in reversed(columns)}
    exact = next((lowered[n] for n in names if n in lowered), None)
    return exact or next((c for c in columns if any(p in c.lower() for p in parts)), None)


def text_column(columns: Sequence[str]) -> str | None:
    """The text column of a schema: an exact name first, else the first that contains one."""
    return _by_name(columns, TEXT_COLUMNS, TEXT_COLUMNS[:3])


def label_column(columns: Sequence[str]) -> str | None:
    return _by_name(columns, LABEL_COLUMNS, LABEL_COLUMNS)


def feature_column(columns: Sequence[str]) -> str | None:
    return _by_name(columns, FEATURE_COLUMNS[:1], FEATURE_COLUMNS[1:])


def coerce_number(c: Column) -> Column:
    """A whole number as it is; null, NaN, infinite and fractional values are 0."""
    whole = (c == F.floor(c)) & (F.abs(c) < 9e15)
    return F.when(c.isNull() | F.isnan(c.cast("double")), 0).when(whole, c.cast("bigint")).otherwise(0).cast("bigint")


def coerce_string(c: Column) -> Column:
    """Sentiment words to 0, 1 and 2; numerals truncated; anything else 0."""
    s = F.lower(F.trim(c))
    number = s.try_cast("double")
    return (
        F.when(s.isin(*POSITIVE), 1).when(s.isin(*NEGATIVE), 0).when(s.isin(*NEUTRAL), 2)
        .when(F.abs(number) < 9e15, number.cast("bigint")).otherwise(0).cast("bigint")
    )


def sentiment_id(c: Column) -> Column:
    """Strict form: what is no known sentiment is null; yes and no aren't known."""
    s = F.lower(F.trim(c))
    number = s.try_cast("double")
    return (
        F.when(s.isin(*POSITIVE[:3]), 1).when(s.isin(*NEGATIVE[:3]), 0).when(s.isin(*NEUTRAL), 2)
        .when((F.abs(number) < 9e15) & (number == F.floor(number)), number.cast("bigint")).cast("bigint")
    )


def star_remap(y: Column) -> Column:
    """Star ratings, of five or ten, to three classes; two stars and fewer stay."""
    return F.when(y <= 2, y).when(y == 3, 1).when(y.between(4, 5), 2).when(y == 6, 1).when(y.between(7, 10), 2)


def three_class(y: Column, stem: Column | None = None) -> Column:
    if stem is not None:
        y = F.when(stem.isin(*STAR_STEMS), star_remap(y)).otherwise(y)
    return F.when(y < 0, None).when(y <= 2, y).when(y < 7, 0).when(y < 14, 1).when(y >= 14, 2)


def normalize(y: Column, classes: int, stem: Column | None = None) -> Column:
    """A label in 0..classes-1, or null where it can't be mapped."""
    if classes == 3:
        return three_class(y, stem).cast("int")
    if classes == 2:
        three = three_class(y, stem)
        return F.when(y.isin(0, 1), y).when(y == 2, None).when(three.isin(0, 1), three).cast("int")
    return F.when((y >= 0) & (y < classes), y).cast("int")


def majority_family(name: Column, families: Sequence[tuple[str, str]], default: str) -> Column:
    """The family of the first prefix that a name starts with."""
    out = F.lit(default)
    for prefix, family in reversed(list(families)):
        out = F.when(name.startswith(prefix), F.lit(family)).otherwise(out)
    return out


def agreed(values: Column) -> Column:
    """The one value of an array, or null where its values differ."""
    return F.when(F.array_min(values) == F.array_max(values), F.array_min(values))
