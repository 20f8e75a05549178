"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of ASCII white space: space and tab to carriage return.
SPACE_BYTES = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids fall in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def lower_ascii(text: str) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else changed."""
    return text.encode("utf-8", "replace").translate(_LOWER)


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def map_texts(
    df: DataFrame,
    keep: list[str],
    text: str,
    fields: str,
    build: Callable[[], Callable[[list[str | None]], dict[str, object]]],
) -> DataFrame:
    """Maps the whole texts of ``df`` in bounded slices and keeps the columns ``keep``.

    ``build`` runs once in each task and returns a function from a list of texts (``None``
    for null) to a dict of equally long columns, named as in the DDL string ``fields``.
    """
    schema = T.StructType([*(df.schema[c] for c in keep), *T.StructType.fromDDL(fields).fields])
    added = [f.name for f in T.StructType.fromDDL(fields).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = build()
        for batch in batches:
            for piece in slices(batch, text):
                out = call([None if t is None else t for t in piece[text]])
                frame = piece[keep].reset_index(drop=True)
                for name in added:
                    frame[name] = out[name]
                yield frame

    return df.select(*dict.fromkeys([*keep, text])).mapInPandas(run, schema)


def slices(batch: pd.DataFrame, text: str, rows: int = 256, chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Splits a batch so that the work arrays of one slice stay small; a long text goes alone."""
    lengths = batch[text].map(lambda t: 0 if t is None else len(t)).to_numpy()
    begin, total = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and (i - begin >= rows or total + n > chars):
            yield batch.iloc[begin:i]
            begin, total = i, 0
        total += int(n)
    if begin < len(batch):
        yield batch.iloc[begin:]


def spread_sample(df: DataFrame, key: str, by: str, cap: int) -> DataFrame:
    """At most ``cap`` rows for each value of ``by``: those of smallest hash of ``key``.

    Repeated rows count once.  Group sizes are counted over all rows; a threshold on the hash, uniform over its range,
    thins each group to little more than ``cap`` before any rows are brought together.
    Ties are broken by ``key``, so the sample depends on the rows alone.
    """
    df = df.select(key, by).where(F.col(key).isNotNull() & F.col(by).isNotNull()).distinct()
    counts = {r[0]: r[1] for r in df.groupBy(by).count().collect()}
    unit = F.xxhash64(F.col(key).cast("string")).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    keep = F.lit(0.0)
    for value, n in sorted(counts.items(), key=lambda kv: str(kv[0])):
        share = min(1.1, (cap + 6 * cap**0.5 + 20) / n)
        keep = F.when(F.col(by) == F.lit(value), F.lit(share)).otherwise(keep)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(unit, F.col(key)))
    return df.where(unit < keep).withColumn("__rank", rank).where(F.col("__rank") <= cap).drop("__rank")


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, cap: int) -> DataFrame:
    """Whole texts of a bounded sample of labelled rows: at most ``cap`` for each label.

    Only the sampled keys and labels, of bounded size, are broadcast.  A key with several labels has the
    greatest; of several texts of one key, the one of the smallest hash is taken.
    """
    chosen = spread_sample(labels, key, label, cap).groupBy(key).agg(F.max(label).alias("__label"))
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(chosen), F.col("__key") == F.col(key))
    one = rows.groupBy("__key").agg(F.min(F.struct(F.xxhash64("__text").alias("h"), "__text", "__label")).alias("r"))
    return one.select(F.col("__key").alias(key), F.col("r.__text").alias(text), F.col("r.__label").alias(label))


_IS_SPACE = np.isin(np.arange(256), list(SPACE_BYTES))
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (xor-shifts and odd multipliers)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_PLACE = mixed(np.arange(64, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(1)) | _U(1)
_BYTE = mixed(np.arange(256, dtype=np.uint64) + _U(0x1234567))


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of a byte string: its runs of anything but white space.

    A word's hash is the sum over its bytes of a random word of the byte times an odd number
    of its place, scrambled once more, so it depends on bytes and places alone.
    """
    b = np.frombuffer(raw, dtype=np.uint8)
    solid = ~_IS_SPACE[b]
    first = np.flatnonzero(solid & np.concatenate(([True], ~solid[:-1]))) if len(b) else np.zeros(0, dtype=np.int64)
    if not len(first):
        return np.zeros(0, dtype=np.uint64)
    begin = first[0]
    place = np.arange(begin, len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
    part = _BYTE[b[begin:]] * (_PLACE[place & 63] + (place >> 6).astype(np.uint64) * _U(2))
    part[~solid[begin:]] = 0
    return mixed(np.add.reduceat(part, first - begin))


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of ``size`` consecutive words; of all words where they are fewer."""
    n = min(size, len(words))
    if not n:
        return words
    total = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        total += words[i : len(words) - n + 1 + i] * _PLACE[i + 7]
    return np.unique(mixed(total))


def bit_of(column: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(column, F.lit(3)), F.lit(bits))


def bloom(hashes: DataFrame, column: str, bits: int) -> DataFrame:
    """One row: an array of ``bits`` bits in longs, one set for every hash; its size is fixed."""
    at = hashes.select(bit_of(F.col(column), bits).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("id")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("b"))
    every = hashes.sparkSession.range(bits // 64).join(words, "id", "left").select("id", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "b"))), lambda x: x["b"]).alias("words"))


def maybe(words: Column, column: Column, bits: int) -> Column:
    """Whether a hash may be among those of the bit array ``words``."""
    at = bit_of(column, bits)
    word = F.get(words, F.shiftright(at, 6).cast("int"))
    return word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))) != 0


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))
