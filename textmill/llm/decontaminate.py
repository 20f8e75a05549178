"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Texts become sequences of words: A-Z lower-cased, then runs of digits, letters a-z and all
non-ASCII characters.  A pattern is a window: ``window`` consecutive words of a benchmark
item, or all words of a shorter item.  Patterns of one length are searched together.  A shift
table, keyed by the block of the last two words under the search position, says how far the
position can move without passing any pattern; where it says zero, the block selects a bucket
of patterns, which are compared directly.

The benchmark is the query set.  It is read in blocks of at most ``block_chars``
characters, chosen by a hash of the item; a block's texts are broadcast, and a task builds its tables
from them, so what driver and tasks hold has a fixed bound.  All documents are searched for every block.  Where
there are several blocks, documents are numbered and written once, and each block gives (number, spans, items) alone.

Defined results: null and empty texts have no words, no hits and are clean; repeated items
count once; repeated documents get equal rows; an empty benchmark leaves all clean; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .common import slices

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "replace").translate(_WORD_BYTES).split()


class WuManber:
    """Searches a word sequence for patterns of one length.

    Words are numbered from 1 in the order they are met, 0 is any other word; a pattern is a row of
    such numbers, so comparing rows compares words.
    """

    def __init__(self, patterns: Iterable[tuple[bytes, ...]]):
        self.ids: dict[bytes, int] = {}
        self.shift: dict[int, int] = {}
        self.where: dict[int, list[int]] = {}
        self.rows, self.length, self.block = array("I"), 0, 1
        for p in patterns:
            self.add(p)

    def add(self, pattern: tuple[bytes, ...]) -> int:
        """The pattern's number; a pattern that is there already keeps its own."""
        ids, shift = self.ids, self.shift
        length = self.length = len(pattern)
        self.block = min(2, length)
        row = [ids.setdefault(w, len(ids) + 1) for w in pattern]
        known = self.where.setdefault(hash(tuple(row)), [])
        for r in known:
            if self.rows[r * length : (r + 1) * length].tolist() == row:
                return r
        for end in range(self.block, length + 1):
            key = row[end - 2] << 32 | row[end - 1] if self.block == 2 else row[end - 1]
            if shift.get(key, length) > length - end:
                shift[key] = length - end
        known.append(len(self.rows) // length)
        self.rows.extend(row)
        return known[-1]

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """Start and number of the pattern of each occurrence."""
        get = self.ids.get
        row = [get(w, 0) for w in words]
        length, far, shift = self.length, self.length - self.block + 1, self.shift.get
        at, stop, two = length, len(row), self.block == 2
        while at <= stop:
            step = shift(row[at - 2] << 32 | row[at - 1] if two else row[at - 1], far)
            if step:
                at += step
                continue
            candidate = row[at - length : at]
            for r in self.where.get(hash(tuple(candidate)), ()):
                if self.rows[r * length : (r + 1) * length].tolist() == candidate:
                    yield at - length, r
            at += 1

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """Start and pattern of each occurrence."""
        for begin, _ in self.occurrences(words):
            yield begin, tuple(words[begin : begin + self.length])


class Machines:
    """A machine for each length of window of some items, and the items of each pattern."""

    def __init__(self, items: Iterable[tuple[str, str | None]], window: int):
        self.machines: dict[int, WuManber] = {}
        self.items: dict[int, list] = defaultdict(list)  # by length: the items of each pattern
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            length = min(window, len(words))
            machine, owners = self.machines.setdefault(length, WuManber(())), self.items[length]
            for i in range(len(words) - length + 1):
                r = machine.add(tuple(words[i : i + length]))
                if r == len(owners):
                    owners.append(item)
                elif isinstance(owners[r], set):
                    owners[r].add(item)
                elif owners[r] != item:
                    owners[r] = {owners[r], item}

    def search(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, spans of the occurrences and the items that they are from."""
        words, hits, of = words_of(text), [], set()
        for length, machine in self.machines.items():
            for begin, r in machine.occurrences(words):
                hits.append((begin, begin + length))
                owner = self.items[length][r]
                of.update(owner if isinstance(owner, set) else (owner,))
        return len(words), hits, of


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    block_chars: int = 4_000_000,
) -> DataFrame:
    """Columns ``keep``, then n_words, n_hit, n_items, items_sha256, items and contaminated."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("t")).where("item is not null and t is not null").distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(1.25 * chars / block_chars)) if chars > block_chars else 1
    parts = [items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == b) for b in range(blocks)]
    added = "n_words long, n_hit long, n_items long, items_sha256 string, items array<string>"
    result = T.StructType([*(docs.schema[c] for c in keep), *T.StructType.fromDDL(added).fields])
    if blocks == 1:
        block = spark.sparkContext.broadcast(sorted(map(tuple, parts[0].collect())))

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            machines = Machines(block.value, window)
            for batch in batches:
                for piece in slices(batch, text):
                    found = [machines.search(t) for t in piece[text]]
                    yield digest(piece[list(keep)], [n for n, _, _ in found], [merged(hits) for _, hits, _ in found], [sorted(of) for _, _, of in found])

        out = docs.select(*dict.fromkeys([*keep, text])).mapInPandas(whole, result)
    else:
        ensure_checkpoint_dir(spark)
        numbered = docs.select(*dict.fromkeys([*keep, text])).withColumn("__n", F.monotonically_increasing_id()).checkpoint()
        slim = "n long, n_words long, spans array<struct<begin:long,end:long>>, items array<string>"
        found = None
        for b, part in enumerate(parts):
            one = numbered.select("__n", F.col(text).alias("t")).mapInPandas(searcher(spark.sparkContext.broadcast(sorted(map(tuple, part.collect()))), window, b == 0), slim)
            found = one if found is None else found.union(one)
        each = found.groupBy("n").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

        joined = numbered.drop(*([] if text in keep else [text])).join(each.withColumnRenamed("n", "__n").select("__n", F.struct("n_words", "spans", "items").alias("__f")), "__n")
        flat = joined.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), "__f.*").toDF(*(f"k{i}" for i in range(len(keep))), "n_words", "spans", "items")

        def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                names = [list(v) for v in batch["items"]]
                kept = batch[[f"k{i}" for i in range(len(keep))]].set_axis(list(keep), axis=1)
                yield digest(kept, batch["n_words"].tolist(), [merged(pairs(s)) for s in batch["spans"]], names)

        out = flat.mapInPandas(named, result)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def searcher(block, window: int, all_rows: bool):
    """Rows (n, n_words, spans, items) of the documents that hold items of the block, or of all documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machines = Machines(block.value, window)
        for batch in batches:
            for piece in slices(batch, "t"):
                found = [(n, *machines.search(t)) for n, t in zip(piece["__n"], piece["t"])]
                rows = [(n, words, merged(hits), sorted(of)) for n, words, hits, of in found if all_rows or hits]
                yield pd.DataFrame(rows, columns=["n", "n_words", "spans", "items"])

    return run


def pairs(spans) -> list[tuple[int, int]]:
    return [(s["begin"], s["end"]) for s in spans]


def digest(frame: pd.DataFrame, n_words: list[int], spans: list, names: list[list[str]]) -> pd.DataFrame:
    return frame.reset_index(drop=True).assign(
        n_words=n_words,
        n_hit=[sum(end - begin for begin, end in s) for s in spans],
        n_items=[len(v) for v in names],
        items_sha256=[hashlib.sha256(",".join(v).encode()).hexdigest() for v in names],
        items=pd.Series(names, dtype=object),
    )


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans that cover the same words."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


#: DuckDB SQL of the rows that the operator must give over ``documents`` and ``benchmark``.
SQL = r"""
WITH w AS (
  SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT 'b', CAST(item_id AS VARCHAR), NULL,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
),
items AS (SELECT id, ws, least(len(ws), 13) AS l FROM w WHERE kind = 'b' AND len(ws) > 0),
pats AS (SELECT DISTINCT id, l, array_to_string(list_slice(ws, s, s + l - 1), ' ') AS p
         FROM (SELECT id, ws, l, unnest(range(1, len(ws) - l + 2)) AS s FROM items)),
docs AS (SELECT doc_id, ws FROM w WHERE kind = 'd'),
starts AS (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS s
           FROM docs, (SELECT DISTINCT l FROM pats) WHERE len(ws) >= l),
hits AS (SELECT t.doc_id, t.s, t.l, p.id FROM
           (SELECT doc_id, s, l, array_to_string(list_slice(ws, s, s + l - 1), ' ') AS p FROM starts) t
         JOIN pats p ON p.l = t.l AND p.p = t.p),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS pos FROM hits) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
  coalesce(n.n_hit, 0) > 0 AND 20 * coalesce(n.n_hit, 0) >= len(d.ws) AS contaminated
FROM docs d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id
"""
