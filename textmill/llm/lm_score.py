"""Language-model scoring by a probabilistic suffix tree, beside a word-unigram base.

Tokens are the words of a text (A-Z lower-cased, runs of anything but white space) and one end.
The model reads them as bytes: every word and a blank, then a line feed for the end, so it
gives each sequence of tokens one probability.  Texts begin after line feeds.

Training counts all ``depth`` + 1 byte grams of all training texts, in packed arrays that are
combined in every task and merged in ranges of their contexts read backwards, so contexts of one
ending lie together; the ranges have about equally many positions of a sample (``range_sample``, which
affects nothing but the ranges).  The few contexts that cross a range's end are summed afterwards.  The tree's
candidates are the contexts of up to ``depth`` bytes whose share of all positions is at least
``p_min``; there are at most 1 / ``p_min`` of each length, so the tree has a size bound that
does not depend on the corpus.  From short to long, a context is retained if its distribution
diverges by ``divergence`` nats or more (Kullback-Leibler) from that of its longest retained
suffix.  Distributions are smoothed towards that suffix's with the weight of ``kappa``
observations for each symbol seen in the context, at the root with half an observation for
each of 256 bytes.  A position is
scored in the state of its longest retained suffix.

The base needs exact counts of all words.  Words whose share is at least ``word_share`` (at
most 1 / ``word_share`` of them) are broadcast; the occurrences of others are sent, packed, to
the bucket of their count, and come back as sums for each text.  Words are told apart by
64-bit hashes.

Defined results: a null text counts as empty, which is the end alone; repeated rows are
scored alike, and count as often as they occur in training; without training rows all counts
are 0 and the tree is a uniform root; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .common import lower_ascii, slices, word_hashes

_U = np.uint64
END = np.uint64(0xE7D5_0A0A_0A0A_E7D5)
WORDS, GRAMS = 0, 1


def content(text: str | None) -> bytes:
    """Words parted by one blank, each with a blank behind it, then a line feed."""
    words = lower_ascii(text or "").split()
    return b" ".join(words) + b" \n" if words else b"\n"


def stream(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, each after ``depth`` line feeds; positions to predict; index of their text."""
    pad = b"\n" * depth
    data = np.frombuffer(b"".join(part for t in texts for part in (pad, t)), dtype=np.uint8)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    which = np.repeat(np.arange(len(texts)), lengths)
    return data, np.arange(len(which)) + (which + 1) * depth, which


def contexts(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` bytes before each position, the nearest lowest."""
    out = np.zeros(len(data) - depth, dtype=np.uint64)
    for j in range(depth, 0, -1):
        out = out << _U(8) | data[depth - j : len(data) - j]
    return out[at - depth]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[begin], np.add.reduceat(counts, begin) if len(begin) else counts


def packed(values: np.ndarray, rising: bool = False) -> bytes:
    """64-bit values as planes of equal bytes, which compress well; rising ones as differences."""
    values = values.astype(np.uint64)
    if rising and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(data: bytes, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(8, -1)
    values = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return np.cumsum(values, dtype=np.uint64) if rising else values.astype(np.int64)


class Tally:
    """Counts of 64-bit keys, compacted as they come."""

    def __init__(self, most: int = 2_000_000):
        self.keys, self.counts, self.size, self.most = [], [], 0, most

    def add(self, values: np.ndarray) -> None:
        keys, counts = np.unique(values, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > self.most:
            keys, counts = self.total()
            self.keys, self.counts, self.size = [keys], [counts], len(keys)
            self.most = max(self.most, 2 * len(keys))

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        return summed(np.concatenate(self.keys), np.concatenate(self.counts))


#: Grams are many more than words, and go to so many times as many buckets.
GRAM_BUCKETS = 12


def backwards(context: np.ndarray, depth: int) -> np.ndarray:
    """Contexts as numbers whose highest byte is the nearest."""
    out = np.zeros(len(context), dtype=np.uint64)
    for j in range(depth):
        out = out << _U(8) | (context >> _U(8 * j)) & _U(255)
    return out


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys * _U(0x9E3779B97F4A7C15) >> _U(33)) % _U(buckets)).astype(np.int64)


def range_ends(train: DataFrame, text: str, depth: int, chars: int, ranges: int, range_sample: int) -> np.ndarray:
    """Ends of ranges of backward contexts, from all positions of texts chosen by their hash and one in 64 of them."""
    share = min(1.0, 64.0 * range_sample / max(1, chars))
    some = train.where(F.pmod(F.xxhash64(F.col(text), F.lit(11)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).select(text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for piece in slices(batch, text):
                data, at, _ = stream([content(t) for t in piece[text]], depth)
                yield pd.DataFrame({"c": backwards(contexts(data, at, depth)[::64], depth).astype(np.int64)})

    seen = np.sort(some.mapInPandas(run, "c long").toArrow()["c"].to_numpy())
    return np.unique(seen[np.linspace(0, len(seen) - 1, ranges + 1).astype(np.int64)[1:-1]]).astype(np.uint64) if len(seen) else seen.astype(np.uint64)


def count(train: DataFrame, text: str, depth: int, buckets: int, ends: np.ndarray) -> DataFrame:
    """Rows (kind, bucket, keys, counts): merged counts of words and grams, packed."""
    fields = "kind int, bucket long, keys binary, counts binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tallies = {WORDS: Tally(), GRAMS: Tally()}
        for batch in batches:
            for piece in slices(batch, text, rows=4096, chars=2_000_000):
                texts = [content(t) for t in piece[text]]
                tallies[WORDS].add(np.append(word_hashes(b"".join(texts)), np.full(len(texts), END)))
                data, at, _ = stream(texts, depth)
                tallies[GRAMS].add(contexts(data, at, depth) << _U(8) | data[at])
        for kind, tally in tallies.items():
            keys, counts = tally.total()
            bucket = bucket_of(keys, buckets) if kind == WORDS else np.searchsorted(ends, backwards(keys >> _U(8), depth), side="right")
            order = np.argsort(bucket, kind="stable")
            keys, counts, bucket = keys[order], counts[order], bucket[order]
            for b, part in parts_of(bucket):
                yield pd.DataFrame({"kind": [kind], "bucket": [b], "keys": [packed(keys[part], True)], "counts": [packed(counts[part])]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([unpacked(x, True) for x in group["keys"]])
        counts = np.concatenate([unpacked(x) for x in group["counts"]])
        keys, counts = summed(keys, counts)
        return pd.DataFrame({"kind": group["kind"].iloc[:1], "bucket": group["bucket"].iloc[:1], "keys": [packed(keys, True)], "counts": [packed(counts)]})

    return train.select(text).mapInPandas(run, fields).groupBy("kind", "bucket").applyInPandas(merge, fields)


def parts_of(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values in a sorted array."""
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else []
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(bucket[a]), slice(a, b)


class Lookup:
    """A hash table from 64-bit keys to their indices, probed for whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.shift = max(4, int(len(keys) * 4).bit_length())
        self.slot_key = np.zeros(1 << self.shift, dtype=np.uint64)
        self.slot_index = np.full(1 << self.shift, -1, dtype=np.int32)
        left, probe = np.arange(len(keys)), 0
        while len(left):
            slot = self.slots(keys[left], probe)
            free = self.slot_index[slot] < 0
            first = np.unique(slot[free], return_index=True)[1]
            took = np.flatnonzero(free)[first]
            self.slot_key[slot[took]], self.slot_index[slot[took]] = keys[left[took]], left[took]
            left = np.delete(left, took)
            probe += 1
        self.probes = max(1, probe)

    def slots(self, keys: np.ndarray, probe: int) -> np.ndarray:
        h = (keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.shift)
        return (h + _U(probe)).astype(np.int64) & ((1 << self.shift) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1."""
        slot = self.slots(keys, 0)
        out = self.slot_index[slot]
        wrong = np.flatnonzero((out >= 0) & (self.slot_key[slot] != keys))
        for probe in range(1, self.probes):
            if not len(wrong):
                return out
            slot = self.slots(keys[wrong], probe)
            got = self.slot_index[slot]
            miss = (got >= 0) & (self.slot_key[slot] != keys[wrong])
            out[wrong] = got
            wrong = wrong[miss]
        out[wrong] = -1
        return out


@dataclass
class SuffixTree:
    """States of retained contexts; ``log10p`` has a column for each known byte and a last one for others."""

    depth: int
    keys: np.ndarray  # length << 56 | context
    log10p: np.ndarray
    code: np.ndarray  # column of each byte

    def scorer(self):
        table = Lookup(self.keys)
        lengths = sorted({int(k) >> 56 for k in self.keys}, reverse=True)
        columns = self.log10p.shape[1]
        flat = self.log10p.ravel()

        def score(texts: list[bytes]) -> np.ndarray:
            data, at, which = stream(texts, self.depth)
            context = contexts(data, at, self.depth)
            state = np.zeros(len(at), dtype=np.int64)
            left = np.arange(len(at))
            for n in lengths:
                if n == 0:
                    break
                found = table.find((context[left] & _U((1 << 8 * n) - 1)) | _U(n << 56))
                hit = found >= 0
                state[left[hit]] = found[hit]
                left = left[~hit]
            return np.bincount(which, weights=flat[state * columns + self.code[data[at]]], minlength=len(texts))

        return score


def candidates(counted: DataFrame, depth: int, least: float) -> DataFrame:
    """Rows (len, context, symbol, n) of the contexts seen ``least`` times or more."""

    def run(group: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in group:
            for keys, counts in zip(batch["keys"], batch["counts"]):
                keys, counts = unpacked(keys, True), unpacked(counts)
                order = np.argsort(backwards(keys >> _U(8), depth))
                ends = (keys >> _U(8))[order[[0, -1]]]
                for n in range(depth, -1, -1):
                    keys, counts = summed(keys & _U((1 << 8 * (n + 1)) - 1), counts)
                    context = keys >> _U(8)
                    begin = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
                    size = np.diff(np.append(begin, len(context)))
                    # A range has all grams of a context but of the first and the last, which others may share.
                    crosses = np.isin(context, ends & _U((1 << 8 * n) - 1))
                    kept = np.repeat(np.add.reduceat(counts, begin) >= least, size) | crosses
                    yield pd.DataFrame({"len": np.int32(n), "context": context[kept].astype(np.int64), "symbol": (keys[kept] & _U(255)).astype(np.int32), "n": counts[kept]})

    rows = counted.where(F.col("kind") == GRAMS).select("keys", "counts").mapInPandas(run, "len int, context long, symbol int, n long")
    return rows.groupBy("len", "context", "symbol").agg(F.sum("n").alias("n"))


def grow(rows: pd.DataFrame, depth: int, least: float, divergence: float, kappa: float, chunk: int = 8192) -> SuffixTree:
    """The tree, from the candidate contexts' next-symbol counts."""
    rows = rows.sort_values(["len", "context", "symbol"])
    symbols = np.unique(rows["symbol"].to_numpy())
    code = np.full(256, len(symbols), dtype=np.int64)
    code[symbols] = np.arange(len(symbols))
    width = len(symbols) + 1
    root = np.full(width, 0.5)
    top = rows[rows["len"] == 0]
    root[code[top["symbol"]]] += top["n"].to_numpy()
    keys, probs = np.zeros(1, dtype=np.uint64), (root / (top["n"].sum() + 128.0))[None, :].astype(np.float32)
    for n in range(1, depth + 1):
        part = rows[rows["len"] == n]
        context, symbol, seen_n = part["context"].to_numpy().astype(np.uint64), part["symbol"].to_numpy(), part["n"].to_numpy()
        if not len(context):
            continue
        begin = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        edges = np.append(begin, len(context))
        known, new_keys, new_probs = Lookup(keys), [], []
        for first in range(0, len(begin), chunk):  # a dense matrix of ``chunk`` contexts at a time
            last = min(first + chunk, len(begin))
            own = slice(edges[first], edges[last])
            row = np.repeat(np.arange(last - first), np.diff(edges[first : last + 1]))
            seen = np.zeros((last - first, width))
            seen[row, code[symbol[own]]] = seen_n[own]
            total = seen.sum(axis=1)
            enough = total >= least
            seen, total, name = seen[enough], total[enough], context[begin[first:last]][enough]
            parent = np.zeros(len(name), dtype=np.int64)
            for m in range(n - 1, 0, -1):
                open_ = np.flatnonzero(parent == 0)
                found = known.find((name[open_] & _U((1 << 8 * m) - 1)) | _U(m << 56))
                parent[open_] = np.maximum(found, 0)
            before = probs[parent].astype(np.float64)
            mass = kappa * (seen > 0).sum(axis=1)  # as many pseudo-observations as symbols were seen
            p = (seen + mass[:, None] * before) / (total + mass)[:, None]
            weight = p * np.concatenate([np.ones(width - 1), [256.0 - len(symbols)]])  # the last column stands for many bytes
            far = (weight * np.log(p / before)).sum(axis=1) >= divergence
            new_keys.append(name[far] | _U(n << 56))
            new_probs.append(p[far].astype(np.float32))
        keys, probs = np.concatenate([keys, *new_keys]), np.concatenate([probs, *new_probs])
    return SuffixTree(depth, keys, np.log10(probs), code)


@dataclass
class Model:
    tree: SuffixTree
    counted: DataFrame
    tokens: int
    vocabulary: int
    frequent: np.ndarray
    frequent_counts: np.ndarray
    buckets: int


def fit(
    train: DataFrame, text: str = "text", depth: int = 6, p_min: float = 4e-6, divergence: float = 0.01,
    kappa: float = 6.0, word_share: float = 2e-6, bucket_chars: int = 100_000_000,
    range_sample: int = 500_000,
) -> Model:
    """Counts all of ``train`` and grows the tree."""
    ensure_checkpoint_dir(train.sparkSession)
    chars = train.agg(F.sum(F.length(text))).first()[0] or 0
    buckets = max(8, math.ceil(chars / bucket_chars))
    ends = range_ends(train, text, depth, chars, buckets * GRAM_BUCKETS, range_sample)
    counted = count(train, text, depth, buckets, ends).checkpoint()

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums = [unpacked(c) for c in batch["counts"]]
            yield pd.DataFrame({"kind": batch["kind"], "n": [int(c.sum()) for c in sums], "v": [len(c) for c in sums]})

    sums = {r["kind"]: r for r in counted.mapInPandas(totals, "kind int, n long, v long").groupBy("kind").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    tokens, vocabulary = (int(sums[WORDS]["n"]), int(sums[WORDS]["v"])) if WORDS in sums else (0, 0)
    positions = int(sums[GRAMS]["n"]) if GRAMS in sums else 0

    def common(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, counts in zip(batch["keys"], batch["counts"]):
                keys, counts = unpacked(keys, True), unpacked(counts)
                many = counts >= word_share * tokens
                yield pd.DataFrame({"key": keys[many].astype(np.int64), "n": counts[many]})

    words = counted.where(F.col("kind") == WORDS).select("keys", "counts").mapInPandas(common, "key long, n long").toArrow()
    least = p_min * positions
    rows = candidates(counted, depth, least).toArrow().to_pandas()
    tree = grow(rows, depth, least, divergence, kappa)
    return Model(tree, counted, tokens, vocabulary, words["key"].to_numpy().astype(np.uint64), words["n"].to_numpy(), buckets)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep``, then n_tokens, n_known, train_tokens, base_score and score."""
    ensure_checkpoint_dir(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.tree, model.frequent, model.frequent_counts))
    floor = model.tokens + 0.5 * (model.vocabulary + 1)
    buckets = model.buckets
    added = T.StructType.fromDDL("n_tokens long, n_known long, base_score double, score double, rid long, bucket long, rids binary, sizes binary, keys binary")
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in keep] + added.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, frequent, counts = shared.value
        value, table, tree_score = np.log10((counts + 0.5) / floor), Lookup(frequent), tree.scorer()
        serial = TaskContext.get().partitionId() << 40  # a task run anew gives its rows the same ids
        for batch in batches:
            for piece in slices(batch, text, rows=1024, chars=1_000_000):
                texts = [content(t) for t in piece[text]]
                n = np.array([t.count(b" ") for t in texts], dtype=np.int64)
                words = word_hashes(b"".join(texts))
                which = np.repeat(np.arange(len(texts)), n)
                words, which = np.append(words, np.full(len(texts), END)), np.append(which, np.arange(len(texts)))
                found = table.find(words) if len(frequent) else np.full(len(words), -1)
                hit = found >= 0
                rid = np.arange(serial, serial + len(texts))
                serial += len(texts)
                frame = piece[list(keep)].reset_index(drop=True).assign(
                    n_tokens=n + 1,
                    n_known=np.bincount(which[hit], minlength=len(texts)),
                    base_score=np.bincount(which[hit], weights=value[found[hit]], minlength=len(texts)),
                    score=tree_score(texts), rid=rid, bucket=pd.Series([None] * len(texts), dtype="Int64"), rids=None, sizes=None, keys=None,
                )
                yield frame
                rare, of = words[~hit], which[~hit]
                bucket = bucket_of(rare, buckets)
                order = np.lexsort((of, bucket))
                rare, of, bucket = rare[order], of[order], bucket[order]
                rows = []
                for b, part in parts_of(bucket):
                    own, size = np.unique(of[part], return_counts=True)
                    rows.append((b, rid[own].tobytes(), size.astype(np.int32).tobytes(), rare[part].tobytes()))
                if rows:
                    out = pd.DataFrame(rows, columns=["bucket", "rids", "sizes", "keys"])
                    for c in schema.names:
                        if c not in out:
                            out[c] = pd.Series([None] * len(out), dtype=object)
                    yield out[schema.names]

    done = docs.select(*dict.fromkeys([*keep, text])).mapInPandas(run, schema).checkpoint()

    def settle(sent: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        if not len(sent):
            return pd.DataFrame({"rid": [], "known": [], "base": []})
        keys = np.concatenate([unpacked(x, True) for x in table["keys"]] or [np.zeros(0, dtype=np.uint64)])
        counts = np.concatenate([unpacked(x) for x in table["counts"]] or [np.zeros(0, dtype=np.int64)])
        wanted = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in sent["keys"]])
        rids = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in sent["rids"]])
        sizes = np.concatenate([np.frombuffer(x, dtype=np.int32) for x in sent["sizes"]])
        seen = np.zeros(len(wanted), dtype=np.int64)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            seen = np.where(keys[at] == wanted, counts[at], 0)
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        return pd.DataFrame({"rid": rids, "known": np.add.reduceat((seen > 0).astype(np.int64), begin), "base": np.add.reduceat(np.log10((seen + 0.5) / floor), begin)})

    sent = done.where("bucket is not null").select("bucket", "rids", "sizes", "keys")
    counts = model.counted.where(F.col("kind") == WORDS).select("bucket", "keys", "counts")
    settled = sent.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInPandas(settle, "rid long, known long, base double")
    sums = settled.groupBy("rid").agg(F.sum("known").alias("known"), F.sum("base").alias("base"))
    out = done.where("bucket is null").join(sums, "rid", "left")
    return out.select(
        *keep,
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
        "score",
    )


