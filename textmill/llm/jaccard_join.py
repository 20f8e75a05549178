"""Set-similarity self-join on word shingles by universe partition and the pigeonhole principle.

Sets are the distinct ``size``-word shingles of texts; two sets link when their Jaccard
similarity is at least num / den (3 / 4 by default).  Then their symmetric difference has at
most H = floor(n / 3) elements, as seen from either of sizes n (in general n (den - num) / num).

1. *Classes.*  Equal sets are one class, named by a 64-bit hash of the set.  All that follows
   works on classes, so copies cost nothing beyond their own row.
2. *Universe partition.*  Sizes fall in bands (hi/2, hi].  A band's scheme cuts the universe
   into 2 ** b segments by the first bits of the elements' hashes; a set takes part in the scheme of its own band, and in the one below if
   it is within den / num of that band's end, so any two that can link meet in a scheme.  A
   set's subset in a segment has a signature.  H differences spoil at most H segments, so a
   set with more than H non-empty segments shares the signature of one of them.
3. *One-deletion neighbourhoods.*  A set with H non-empty segments or fewer is short.  In a
   share of its segments a scheme also indexes every subset less one element of a short set;
   there a single difference does not spoil a segment with two elements or more: it counts
   twice.  Other sets need none, since one side's unspoiled segment is enough for both.
4. *Cost-based allocation.*  For every band, the numbers of segments and the shares of
   segments with deletions are tried on all sets; of those that give every set more than H,
   the one with the fewest signatures in all is used.  With as many segments as it takes,
   every set has more than H, so there always is one.
5. *Rarest first.*  Signatures are counted in hash buckets.  Of a set's non-empty segments,
   the H + 1 rarest suffice on both sides (one order for all sets), and those that only it
   has come first; a set with H + 1 of these has no partner and is done.  Short sets use all.
6. *Pivots.*  Candidates that share a signature are verified, on the whole sets, with the most
   central of them: the one whose signatures are the most frequent.  In a group of near copies
   that is the original or what is nearest to it.
7. *Differences.*  What still shares a signature across components is partitioned again, by its
   differences from its pivot q, with a segment for each element.  Let d be the size of x's symmetric difference with q and B = (n_x + n_y) (den - num) / (den + num),
   the most that two sets that link may differ.  Then x and y link only if their differences
   from q share (d_x + d_y - B) / 2 elements or more, and at least one, since one of them is not linked with
   q.  So they share one among the rarest of each, and all of this is known of a pair before
   it is made.  Elements of the original that a large group shares are in no difference, and
   edits that only one copy has are in no signature that is shared.  So components are exact,
   while a group of near copies takes a few pairs a member.

A bucket holds a range of one scheme's segments, or of one pivot's elements, and there are more of them for a larger
table.  So a set goes to the buckets of its bands alone and has several signatures in each, and its name is sent once for them.

A signature that many sets of a task have overflows: but for the first ``most``, its holders go to
buckets of their own, by task, and learn its count later, so no bucket gets all of them.

Shingles are compared by 64-bit hashes.

Defined results: a null text, or one without words, has an empty set and links with nothing;
a text of fewer words is one shingle; repeated rows, and rows of equal sets, are in one
component; a null key counts as larger than any other; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import bloom, lower_ascii, maybe, mixed, shingle_hashes, slices, word_hashes
from .components import connected_components

_U = np.uint64
#: What is tried for a scheme: doublings of its least number of segments, and the share of segments with deletions.
OPTIONS = [(0, 0.0), (0, 1 / 8), (0, 1 / 4), (0, 1 / 2), (0, 1.0), (1, 0.0), (1, 1 / 2), (1, 1.0), (2, 0.0), (5, 0.0), (24, 0.0)]


class Measure:
    """The similarity num / den and what follows from it."""

    def __init__(self, num: int = 3, den: int = 4, size: int = 5):
        self.num, self.den, self.size = num, den, size

    def most_differences(self, n: int) -> int:
        return n * (self.den - self.num) // self.num

    def bands(self, n: int) -> list[int]:
        """Exponents k of the schemes (hi = 2 ** k) that a set of n elements is in."""
        if self.most_differences(n) == 0 and n * self.den // self.num <= n:
            return []  # links with equal sets alone
        k = max(0, (n - 1).bit_length())
        below = [k - 1] if k and n * self.num <= self.den << (k - 1) else []
        return [*below, k]

    def segments(self, k: int, option: int) -> tuple[int, float]:
        """Exponent of the number of segments of a scheme, and the share of them that has deletions."""
        finer, share = OPTIONS[option]
        return max(1, k - 1) + finer, share

    def elements(self, text: str | None) -> np.ndarray:
        return shingle_hashes(word_hashes(lower_ascii(text or "")), self.size)


def class_id(elements: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(elements.tobytes(), digest_size=8).digest(), "little", signed=True)


def runs(elements: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-empty segments of a sorted set of hashes, which the first ``bits`` bits name: name, first element, size."""
    segment = elements >> _U(64 - bits)
    begin = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    return segment[begin], begin, np.diff(np.append(begin, len(elements)))


def gain_and_cost(elements: np.ndarray, bits: int, share: float, most: int, known: dict | None = None) -> tuple[int, int]:
    """How many differences the signatures outlast, plus one; and the number of signatures.

    ``most`` is the number of differences to outlast; ``known`` keeps segments between calls.
    """
    known = {} if known is None else known
    segment, _, size = known[bits] if bits in known else known.setdefault(bits, runs(elements, bits))
    wide = size[(size > 1) & (segment < _U(int(share * (1 << bits))))] if share and len(size) <= most else size[:0]
    return len(size) + len(wide), len(size) + int(wide.sum())


def signatures(elements: np.ndarray, k: int, bits: int, share: float, most: int) -> tuple[np.ndarray, int, np.ndarray]:
    """64-bit signatures of the non-empty segments, deletions last; the number of those segments; and the segment of every signature."""
    segment, begin, size = runs(elements, bits)
    value = mixed(elements ^ _U(0x5851F42D4C957F2D))
    total = np.add.reduceat(value, begin)
    tag = segment * _U(0x9E3779B97F4A7C15) + _U(k)
    out = mixed(total + mixed(tag))
    if share and len(begin) <= most:
        wide = np.repeat((size > 1) & (segment < _U(int(share * (1 << bits)))), size)
        less = (np.repeat(total, size) - value)[wide]
        out = np.concatenate([out, mixed(less + mixed(np.repeat(tag, size)[wide]))])
        segment = np.concatenate([segment, np.repeat(segment, size)[wide]])
    return out, len(begin), segment


def places(segment: np.ndarray, bits: int, sig: np.ndarray, buckets: int) -> np.ndarray:
    """Which of a scheme's buckets signatures go to: ranges of segments; where those are few, hashes part a segment."""
    at = (segment + (sig & _U(0xFFFFFFFF)) / 2.0**32) * (buckets / 2.0**bits)
    return np.minimum(at.astype(np.int64), buckets - 1)


def describe(docs: DataFrame, key: str, text: str, measure: Measure) -> DataFrame:
    """Rows (key, n, cid, bands, gains, costs, fills): what allocation needs to know of every set, and its numbers of non-empty segments."""
    fields = f"{key} {docs.schema[key].dataType.simpleString()}, n long, cid long, bands array<int>, gains array<int>, costs array<int>, fills array<int>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, tuple] = {}
        for batch in batches:
            for piece in slices(batch, text):
                rows = []
                for t in piece[text]:
                    e = measure.elements(t)
                    cid = class_id(e)
                    if cid not in seen:
                        if len(seen) > 100_000:
                            seen.clear()
                        bands = measure.bands(len(e))
                        known: dict = {}
                        most = measure.most_differences(len(e))
                        tried = [gain_and_cost(e, *measure.segments(k, o), most, known) for k in bands for o in range(len(OPTIONS))]
                        fills = [len(known[measure.segments(k, o)[0]][0]) for k in bands for o in range(len(OPTIONS))]
                        seen[cid] = (len(e), cid, bands, [g - most - 1 for g, _ in tried], [c for _, c in tried], fills)
                    rows.append(seen[cid])
                frame = pd.DataFrame(rows, columns=["n", "cid", "bands", "gains", "costs", "fills"])
                frame.insert(0, key, piece[key].to_numpy())
                yield frame

    return docs.select(key, text).mapInPandas(run, fields)


def allocate(described: DataFrame, measure: Measure) -> tuple[dict[int, int], dict[int, int]]:
    """The cheapest option that suffices, for every band; and its number of signatures."""
    tried = described.select(F.posexplode("bands").alias("at", "k"), "gains", "costs")
    n = len(OPTIONS)
    tried = tried.select("k", F.slice("gains", F.col("at") * n + 1, n).alias("g"), F.slice("costs", F.col("at") * n + 1, n).alias("c"))
    least = [F.min(F.col("g")[o]).alias(f"g{o}") for o in range(n)]
    cost = [F.sum(F.col("c")[o]).alias(f"c{o}") for o in range(n)]
    chosen, totals = {}, {}
    for row in tried.groupBy("k").agg(*least, *cost).collect():  # a row for each band
        fit = [(row[f"c{o}"], o) for o in range(n) if row[f"g{o}"] >= 0]
        if not fit:
            raise ValueError(f"no allocation outlasts the differences in band {row['k']}")
        totals[row["k"]], chosen[row["k"]] = min(fit)
    return chosen, totals


def units_of(described: DataFrame, chosen: dict[int, int]) -> DataFrame:
    """Rows (cid, k, n, filled) of the classes in their schemes."""
    option = F.create_map(*(F.lit(x) for pair in chosen.items() for x in pair))
    tried = described.select("cid", "n", F.posexplode("bands").alias("at", "k"), "fills").where(F.col("k").isin(*chosen))
    filled = F.get("fills", F.col("at") * len(OPTIONS) + option[F.col("k")])
    return tried.select("cid", "k", "n", filled.alias("filled")).groupBy("cid", "k").agg(F.first("n").alias("n"), F.first("filled").alias("filled"))


def bucket_ranges(totals: dict[int, int], signatures_a_bucket: int) -> tuple[dict[int, tuple[int, int]], int]:
    """First bucket and number of buckets of every band, and the number of all."""
    ranges, at = {}, 0
    for k in sorted(totals):
        ranges[k] = at, max(1, math.ceil(totals[k] / signatures_a_bucket))
        at += ranges[k][1]
    return ranges, at


class Packer:
    """Packs the signatures of units (tuples of longs) by bucket, for one task.

    Rows are (bucket, part, who, counts, keys).  Part 0 has the first ``most`` units of a slice for a signature;
    from then on the task sends its units to a part of its own.
    """

    schema = "bucket long, part long, who binary, counts binary, keys binary"

    def __init__(self, buckets: int, most: int):
        self.buckets, self.most, self.hot = buckets, most, np.zeros(0, dtype=np.uint64)
        self.part = 1 + TaskContext.get().partitionId()

    def late(self, sig: np.ndarray) -> np.ndarray:
        """Indices of signatures beyond the first ``most`` of their kind, or of a kind that was beyond before."""
        bin_ = (sig & _U(0xFFFFF)).astype(np.int64)
        full = np.bincount(bin_, minlength=1 << 20) > self.most
        full[(self.hot & _U(0xFFFFF)).astype(np.int64)] = True
        some = np.flatnonzero(full[bin_])
        if not len(some):
            return some
        some = some[np.argsort(sig[some], kind="stable")]
        kind = sig[some]
        begin = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
        size = np.diff(np.append(begin, len(kind)))
        first = np.where(np.isin(kind[begin], self.hot), 0, self.most)
        self.hot = np.union1d(self.hot, kind[begin][size > self.most])
        return some[np.arange(len(kind)) - np.repeat(begin, size) >= np.repeat(first, size)]

    def pack(self, units: list[tuple], parts: list[np.ndarray], buckets: list[np.ndarray]) -> pd.DataFrame:
        sig = np.concatenate(parts)
        unit = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        place = np.concatenate(buckets) << 1
        place[self.late(sig)] |= 1
        order = np.argsort(place.astype(np.uint16 if self.buckets < 1 << 15 else np.int64), kind="stable")
        place, unit, key = place[order], unit[order], (sig >> _U(32)).astype(np.uint32)[order]
        who = np.array(units, dtype=np.int64)
        edges = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1], [True]))) if len(sig) else [0]
        rows = []
        for a, b in zip(edges[:-1], edges[1:]):
            begin = np.flatnonzero(np.concatenate(([True], unit[a + 1 : b] != unit[a : b - 1])))
            count = np.diff(np.append(begin, b - a)).astype(np.int32)
            rows.append((int(place[a]) >> 1, self.part * int(place[a] & 1), who[unit[a:b][begin]].tobytes(), count.tobytes(), key[a:b].tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "part", "who", "counts", "keys"])


def shared(packed: DataFrame, names: list[str], buckets: int, most: int, differ: str | None = None) -> DataFrame:
    """Rows (*names, sig, freq) of the signatures that several units have; cut by a checkpoint.

    With ``differ``, the units of a signature must not all have the same value of that column, which then is left out.
    The count is that of part 0, which is one order for all; an overflowed signature has ``most`` there or more.
    """
    width, kept_names = len(names), [c for c in names if c != differ]
    fields = ", ".join(f"{c} long" for c in kept_names) + ", sig long, freq long"

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        who = np.concatenate([np.frombuffer(x, dtype=np.int64).reshape(-1, width) for x in group["who"]])
        count = np.concatenate([np.frombuffer(x, dtype=np.int32) for x in group["counts"]])
        key = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in group["keys"]])
        # A unit that several tasks sent becomes one again.
        name = mixed(who.astype(np.uint64).dot(_PRIME[:width]))
        _, first, same = np.unique(name, return_index=True, return_inverse=True)
        both = np.unique(key.astype(np.uint64) << _U(32) | np.repeat(same.astype(np.uint64), count))
        key, unit = (both >> _U(32)).astype(np.int64), first[(both & _U(0xFFFFFFFF)).astype(np.int64)]
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(begin, len(key)))
        late = group["part"].iloc[0] > 0
        kept = (size > 1) | late
        if differ and not late:  # what overflows elsewhere has most holders here, and is kept
            value = who[unit, names.index(differ)]
            kept &= (np.minimum.reduceat(value, begin) != np.maximum.reduceat(value, begin)) | (size >= most)
        many = np.repeat(kept, size)
        out = pd.DataFrame(who[unit[many]], columns=names)[kept_names]
        sig = (key[many].astype(np.uint64) << _U(32)) | _U(group["bucket"].iloc[0])
        return out.assign(sig=sig.astype(np.int64), freq=0 if late else np.repeat(size, size)[many])

    found = packed.repartition(buckets, "bucket", "part").groupBy("bucket", "part").applyInPandas(merge, fields).checkpoint()
    late = found.where("freq = 0")
    if late.isEmpty():
        return found
    hot = found.where(F.col("freq") >= most).groupBy("sig").agg(F.max("freq").alias("f"))
    return found.where("freq > 0").union(late.drop("freq").distinct().join(hot, "sig").select(*kept_names, "sig", F.col("f").alias("freq"))).distinct()


_PRIME = mixed(np.arange(1, 9, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


def emit(docs: DataFrame, text: str, measure: Measure, chosen: dict[int, int], ranges: dict[int, tuple[int, int]], buckets: int, most: int) -> DataFrame:
    """Packed signatures of the classes, whose bucket tells the scheme; equal sets of a task once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, packer = set(), Packer(buckets, most)
        for batch in batches:
            for piece in slices(batch, text, rows=2048, chars=8_000_000):
                units, parts, at = [], [], []
                for t in piece[text]:
                    e = measure.elements(t)
                    bands = measure.bands(len(e))
                    if not bands or (cid := class_id(e)) in seen:
                        continue
                    seen.add(cid)
                    for k in bands:
                        if k in chosen:
                            bits, share = measure.segments(k, chosen[k])
                            sig, _, segment = signatures(e, k, bits, share, measure.most_differences(len(e)))
                            units.append((cid,))
                            parts.append(sig)
                            at.append(ranges[k][0] + places(segment, bits, sig, ranges[k][1]))
                if parts:
                    yield packer.pack(units, parts, at)

    return docs.select(text).mapInPandas(run, Packer.schema)


def rarest(found: DataFrame, units: DataFrame, ranges: dict[int, tuple[int, int]], measure: Measure) -> DataFrame:
    """Rows (sig, cid, n, central) of the signatures through which a class needs to look for partners."""
    bucket = F.col("sig").bitwiseAND(F.lit(0xFFFFFFFF))
    k = F.coalesce(*(F.when(bucket >= begin, k) for k, (begin, _) in sorted(ranges.items(), reverse=True)))
    listed = found.withColumn("k", k).groupBy("cid", "k").agg(F.sort_array(F.collect_list(F.struct("freq", "sig"))).alias("sigs"), F.sum(F.log2("freq")).alias("heard"))
    listed = listed.join(units, ["cid", "k"]).withColumn("central", F.col("heard") / F.col("filled"))  # a segment that no other class shares adds nothing
    own = F.col("filled") - F.size("sigs")  # segments that no other class shares come first
    outlast = F.floor(F.col("n") * (measure.den - measure.num) / measure.num)
    need = F.when(F.col("filled") > outlast, outlast + 1 - own).otherwise(F.size("sigs"))
    listed = listed.withColumn("need", need.cast("int")).where("need > 0")
    return listed.select("cid", "n", "central", F.explode(F.slice("sigs", 1, F.greatest(F.lit(1), "need"))).alias("s")).select(F.col("s.sig").alias("sig"), "cid", "n", "central")


def sets_of(docs: DataFrame, key: str, text: str, measure: Measure, named: DataFrame, wanted: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """Rows (cid, elements) of the wanted classes, from one text of each.

    A bit array of fixed size over the keys of these texts keeps most others from being read
    into sets; the join settles the rest.
    """
    keys = named.join(wanted, "cid", "left_semi").groupBy("cid").agg(F.min(key).alias("key"))
    words = bloom(keys.where("key is not null").select(F.xxhash64("key").alias("h")), "h", bits).scalar()
    some = docs.select(key, text).where(F.col(key).isNull() | maybe(words, F.xxhash64(F.col(key)), bits))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            for piece in slices(batch, text):
                rows = []
                for t in piece[text]:
                    e = measure.elements(t)
                    if len(e) and (cid := class_id(e)) not in seen:
                        seen.add(cid)
                        rows.append((cid, e.tobytes()))
                if rows:
                    yield pd.DataFrame(rows, columns=["cid", "elements"])

    sent = some.select(text).mapInPandas(run, "cid long, elements binary")
    return sent.join(wanted, "cid", "left_semi").groupBy("cid").agg(F.first("elements").alias("elements"))


def verified(pairs: DataFrame, sets: DataFrame, measure: Measure) -> DataFrame:
    """Rows (a, b, d, linked) of pairs (a, b) of classes, judged on their whole sets, which differ in d elements."""
    num, den = measure.num, measure.den
    left = pairs.join(sets.select(F.col("cid").alias("a"), F.col("elements").alias("ea")), "a")
    both = left.join(sets.select(F.col("cid").alias("b"), F.col("elements").alias("eb")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d, linked = [], []
            for x, y in zip(batch["ea"], batch["eb"]):
                p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both_ = np.sort(np.concatenate([p, q]))
                common = int((both_[1:] == both_[:-1]).sum())
                d.append(len(p) + len(q) - 2 * common)
                linked.append(den * common >= num * (len(p) + len(q) - common))
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "d": d, "linked": linked})

    return both.select("a", "b", "ea", "eb").mapInPandas(run, "a long, b long, d long, linked boolean")


def with_pivots(prefix: DataFrame) -> DataFrame:
    """Prefix rows with the pivot of the signature (order, pivot, pivot_n) and the class's top: its most central pivot."""
    order = F.struct("central", F.col("cid").alias("pivot"), F.col("n").alias("pivot_n"))
    pivots = prefix.groupBy("sig").agg(F.max(order).alias("p"), F.count("*").alias("m")).where("m > 1").select("sig", "p")
    met = prefix.join(pivots, "sig")
    top = met.groupBy("cid").agg(F.max("p").alias("t")).select("cid", F.col("t.pivot").alias("top"))
    return met.select("sig", "cid", "n", "p.pivot", "p.pivot_n").join(top, "cid")


def star_pairs(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of each class with the pivots of its signatures."""
    return met.where("cid != pivot").select(F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")).distinct()


def comparable(df: DataFrame, n1: str, n2: str, measure: Measure) -> DataFrame:
    """Rows whose two sizes allow a link."""
    return df.where(F.greatest(n1, n2) * measure.num <= F.least(n1, n2) * measure.den)


def unsettled(met: DataFrame, roots: DataFrame, judged: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """Units (u, q, cid, n, d, root, apart): what signatures still join across components, with a pivot q for each.

    Classes of a signature that have the same top use that, others the signature's own pivot; either way all of
    them have been compared with it, and differ from it in d elements.  ``apart`` says that the class isn't in the pivot's component.
    """
    joined = met.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    by = joined.groupBy("sig").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.min("top").alias("t1"), F.max("top").alias("t2"), F.first("pivot").alias("pivot"))
    by = by.where("r1 != r2").select("sig", F.when(F.col("t1") == F.col("t2"), F.col("t1")).otherwise(F.col("pivot")).alias("q")).checkpoint()
    words = bloom(by, "sig", bits).scalar()  # keeps most settled signatures from being moved
    rows = met.where(maybe(words, F.col("sig"), bits)).select("sig", "cid", "n").join(by, "sig").where("cid != q").select("q", "cid", "n").distinct()
    rows = rows.withColumn("a", F.least("cid", "q")).withColumn("b", F.greatest("cid", "q")).join(judged.select("a", "b", "d"), ["a", "b"])
    rows = rows.join(roots.withColumnRenamed("node", "cid"), "cid", "left").join(roots.select(F.col("node").alias("q"), F.col("root").alias("q_root")), "q", "left")
    root = F.coalesce("root", "cid")
    return rows.select(F.xxhash64("cid", "q").alias("u"), "q", "cid", "n", "d", root.alias("root"), (root != F.coalesce("q_root", "q")).alias("apart"))


def differences(units: DataFrame, sets: DataFrame, buckets: int, signatures_a_bucket: int, most: int) -> DataFrame:
    """Packed signatures of the units (u, root): the elements that are in one of cid and q.

    Those of one pivot go to one bucket, or to as many by ranges of elements as they fill quarters of one.
    """
    spread = F.least(F.lit(buckets), F.ceil(4 * F.sum("d") / signatures_a_bucket)).alias("spread")
    pivots = units.groupBy(F.col("q").alias("cid")).agg(spread).join(sets, "cid").select(F.col("cid").alias("q"), "spread", F.col("elements").alias("eq"))
    both = units.select("u", "root", "cid", "q").join(sets, "cid").join(pivots, "q")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(buckets, most)
        for batch in batches:
            for begin in range(0, len(batch), 1024):
                names, parts, at = [], [], []
                for r in batch.iloc[begin : begin + 1024].itertuples():
                    e = np.setxor1d(np.frombuffer(r.elements, dtype=np.uint64), np.frombuffer(r.eq, dtype=np.uint64), assume_unique=True)
                    names.append((r.u, r.root))
                    pivot = mixed(np.array([r.q], dtype=np.int64).astype(np.uint64))
                    parts.append(mixed(e + pivot))
                    at.append((int(pivot[0]) % buckets + places(e, 64, parts[-1], r.spread)) % buckets)
                yield packer.pack(names, parts, at)

    return both.select("u", "root", "q", "spread", "elements", "eq").mapInPandas(run, Packer.schema)


def settling_pairs(found: DataFrame, units: DataFrame, measure: Measure) -> DataFrame:
    """Pairs (a, b) of different components whose differences from a pivot may share enough.

    Of d differences, c are shared with other components.  A pair shares c at most, so one side's d less the
    other's 2c - d is at most ``bound`` of both sizes.
    """
    most_apart = F.lit((measure.den - measure.num) / (measure.den + measure.num) + 1e-9)
    counted = units.join(found.groupBy("u").agg(F.count("*").alias("c")), "u").withColumn("gain", 2 * F.col("c") - F.col("d"))
    least_apart = F.min(F.when(F.col("apart"), F.col("d")))
    groups = counted.groupBy("q").agg(F.max("gain").alias("most_gain"), F.max("n").alias("most_n"), F.min("d").alias("least_d"), least_apart.alias("least_apart"))
    counted = counted.join(groups, "q")
    bound = (F.col("n") + F.least(F.col("most_n"), F.col("n") * F.lit(measure.den / measure.num))) * most_apart
    seeks = F.col("apart") & (F.col("d") - F.col("most_gain") <= bound)
    sought = F.col("least_apart") - F.col("gain") <= bound
    need = F.greatest(F.lit(1.0), (F.col("d") + F.greatest(F.col("least_d"), F.col("d") - bound) - bound) / 2)
    counted = counted.where((seeks | sought) & (F.col("c") >= need)).select("u", "cid", "n", "root", "d", "c", need.alias("need"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy("freq", "sig"))
    rows = found.join(counted, "u").withColumn("i", rank - 1 + F.col("d") - F.col("c")).where(F.col("d") - F.col("i") >= F.col("need"))
    rows = rows.select("sig", "cid", "n", "root", "d", "c", "i").checkpoint()
    other = rows.select("sig", *(F.col(c).alias(f"{c}2") for c in ("cid", "n", "root", "d", "c", "i")))
    enough = F.greatest(F.lit(1.0), (F.col("d") + F.col("d2") - (F.col("n") + F.col("n2")) * most_apart) / 2)
    met = rows.join(other, "sig").where("cid < cid2 and root != root2").where(F.least(F.col("d") - F.col("i"), F.col("d2") - F.col("i2"), "c", "c2") >= enough)
    return comparable(met, "n", "n2", measure).select(F.col("cid").alias("a"), F.col("cid2").alias("b")).distinct()


def link_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", measure: Measure | None = None, signatures_a_bucket: int = 1_500_000, most: int = 64
) -> DataFrame:
    """Rows (key, n_shingles, component_id); component_id is the least key of those reachable by links."""
    measure = measure or Measure()
    ensure_checkpoint_dir(docs.sparkSession)
    described = describe(docs, key, text, measure).checkpoint()
    named = described.select(key, "n", "cid")
    chosen, totals = allocate(described, measure)
    if not chosen:
        return with_ids(named, None, key)
    ranges, buckets = bucket_ranges(totals, signatures_a_bucket)
    found = shared(emit(docs, text, measure, chosen, ranges, buckets, most), ["cid"], buckets, most)
    prefix = rarest(found, units_of(described, chosen), ranges, measure).checkpoint()
    sets = sets_of(docs, key, text, measure, named, prefix.select("cid").distinct()).checkpoint()

    met = with_pivots(prefix).checkpoint()
    judged = verified(star_pairs(met), sets, measure).checkpoint()
    roots = connected_components(judged.where("linked"))
    units = unsettled(met, roots, judged).checkpoint()
    if not units.isEmpty():
        buckets = max(8, math.ceil(units.agg(F.sum("d")).first()[0] / signatures_a_bucket))
        apart = shared(differences(units, sets, buckets, signatures_a_bucket, most), ["u", "root"], buckets, most, differ="root")
        pairs = settling_pairs(apart, units, measure).join(judged.select("a", "b"), ["a", "b"], "left_anti")
        final = verified(pairs, sets, measure).checkpoint()
        roots = connected_components(judged.union(final).where("linked"))
    return with_ids(named, roots, key)


def with_ids(named: DataFrame, roots: DataFrame | None, key: str) -> DataFrame:
    """Adds the least key of each component; empty sets stay alone."""
    if roots is None:
        joined = named.withColumn("root", F.col("cid"))
    else:
        joined = named.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = joined.where("n > 0").groupBy("root").agg(F.min(key).alias("least"))
    out = joined.join(least, "root", "left")
    return out.select(key, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col(key)).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", measure: Measure | None = None) -> DataFrame:
    """The rows of ``docs`` whose key is the least of its component.

    Rows that repeat a kept key stay, and so do rows without a key, which nothing tells apart.
    """
    ids = link_components(docs, key, text, measure).where(F.col(key) == F.col("component_id")).select(key).distinct()
    kept = docs.join(ids.hint("shuffle_hash"), key, "left_semi").select(*docs.columns)
    return kept.union(docs.where(F.col(key).isNull())) if docs.schema[key].nullable else kept
