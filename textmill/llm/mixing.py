"""Mixing sources to target weights by Pfair scheduling of blocks.

Rows of a source are put into a fixed pseudo-random order (md5 of the key) and cut into
blocks of ``block_rows``.  A source of weight w is a task whose j-th block (from 1) is
released at slot floor((j - 1) / w) and due by slot ceil(j / w); each slot goes to the
released block of the earliest deadline, so after every slot every source has had within one
block of its share.  Weights are exact: a decimal weight is the fraction that it is written as, so
the schedule repeats after as many slots as the weights are units of their greatest common
measure (19 for 4, 2, 2, 0.5 and 1).  A phase is a run of such periods during which the same
sources have rows.  When one runs out, the weights of the others are scaled up and the next
phase begins.  All rows are kept, so the mixture matches the targets until the first source
runs out, and the targets among those left from then on.

What the driver holds is the row count of each source and, for each phase, one period or all its
slots, whichever are fewer: at most ``longest`` entries, whatever the number of rows.  Weights whose
period is longer than that, for more blocks than that, raise an error rather than drift; ``slots``
rounds them to multiples of 1 / ``slots`` instead, whose deviation from the unrounded targets
grows with the rows.  Ranks within a
source come from counts by (source, first hex digits of md5), so no task gets a whole source.

Defined results: a null source is a source of its own, written as null; sources without a
target weight get the weight ``default_weight``; weights of absent sources are ignored;
a weight of zero or less puts a source after all others; ties in md5 (equal or null keys)
are ordered by the text's hash, and rows that are equal in both keep some order among
themselves; an empty table gives an empty result; all other columns are kept as they are,
but those called like the added ones are replaced.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ADDED = ("mix_position", "mix_phase", "mix_block")


def quantised(weights: Mapping[str, float | Fraction], slots: int) -> dict[str, int]:
    """Whole shares of ``slots``, at least one each, by largest remainder; ties by name."""
    total = sum(map(Fraction, weights.values()))
    slots = max(slots, len(weights))
    exact = {s: Fraction(w) / total * slots for s, w in weights.items()}
    share = {s: max(1, math.floor(x)) for s, x in exact.items()}
    order = sorted(weights, key=lambda s: (exact[s] - share[s], s), reverse=True)
    while (gap := slots - sum(share.values())) != 0:
        for s in order if gap > 0 else reversed(order):
            if gap == 0:
                break
            if gap > 0 or share[s] > 1:
                share[s] += 1 if gap > 0 else -1
                gap += -1 if gap > 0 else 1
    return share


def whole_shares(weights: Mapping[str, Fraction]) -> dict[str, int]:
    """The weights in units of their greatest common measure."""
    unit = math.lcm(*(w.denominator for w in weights.values()))
    units = {s: int(w * unit) for s, w in weights.items()}
    common = math.gcd(*units.values())
    return {s: u // common for s, u in units.items()}


def earliest_deadline_first(share: Mapping[str, int], length: int | None = None) -> list[str]:
    """The source of every slot of one period, or of the first ``length`` slots.

    Block j of a source with q of n slots is released at floor((j - 1) n / q) and due by
    ceil(j n / q).  Unit blocks on one resource with whole release times: earliest deadline
    first meets all deadlines whenever that can be done.  One block of each source is in play.
    """
    n = sum(share.values())
    waiting = [(0, s, 1) for s in share]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    period = []
    for slot in range(n if length is None else min(n, length)):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * n // share[s]), s, j))
        due, s, j = heapq.heappop(ready)
        assert due > slot, "a deadline was missed"
        period.append(s)
        heapq.heappush(waiting, (j * n // share[s], s, j + 1))
    return period


def phases(blocks: Mapping[str, int], weights: Mapping[str, Fraction], slots: int | None, longest: int) -> list[dict]:
    """Phases in order: the period, its shares, each source's first and end block, and the slots.

    A phase ends with the slot in which a source runs out.
    """
    left, begun, out = {s: b for s, b in blocks.items() if b > 0}, dict.fromkeys(blocks, 0), []
    while left:
        live = {s: weights[s] for s in left if weights[s] > 0} or dict.fromkeys(left, Fraction(1))
        share = whole_shares(live) if slots is None else quantised(live, slots)
        needed = min(sum(share.values()), sum(left[s] for s in share))
        if needed > longest:
            raise ValueError(f"the weights repeat after {sum(share.values())} slots only; write them with fewer digits, or give slots to round them")
        order = earliest_deadline_first(share, needed)
        where: dict[str, list[int]] = {s: [] for s in share}
        for at, s in enumerate(order):
            where[s].append(at)
        # Where the slots are fewer than a period, some sources don't run out within them.
        ends = [(left[s] - 1) // len(w) * len(order) + w[(left[s] - 1) % len(w)] for s, w in where.items() if w and (len(order) == sum(share.values()) or left[s] <= len(w))]
        length = min(ends) + 1
        whole, rest = divmod(length, len(order))
        took = {s: whole * len(w) + bisect_left(w, rest) for s, w in where.items()}
        out.append({"where": where, "span": {s: (begun[s], begun[s] + took[s]) for s in share}, "period": len(order), "length": length})
        for s, n in took.items():
            begun[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
    return out


def tables(counts: Mapping[str, int], weights: Mapping[str, Fraction], block_rows: int, slots: int | None, longest: int) -> tuple[list[tuple], list[tuple]]:
    """What places a block without seeing any other: rows for phases and rows for slots.

    Phase rows: source, phase, first and end block, share, slots of a period, rows before the
    phase.  Slot rows: source, phase, block within the period, slot within the period.  Only a
    source's last block can be short, and that ends its phase, so within a phase slot t
    begins t * ``block_rows`` rows after the phase does.
    """
    phase_rows, slot_rows, before = [], [], 0
    for p, phase in enumerate(phases({s: -(-n // block_rows) for s, n in counts.items()}, weights, slots, longest)):
        for s, (first, end) in phase["span"].items():
            phase_rows.append((s, p, first, end, max(1, len(phase["where"][s])), phase["period"], before))
            slot_rows += [(s, p, k, at) for k, at in enumerate(phase["where"][s])]
        before += sum(min(end * block_rows, counts[s]) - first * block_rows for s, (first, end) in phase["span"].items() if end > first)
    return phase_rows, slot_rows


def mix(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    block_rows: int = 16,
    slots: int | None = None,
    default_weight: float = 1.0,
    cell_rows: int = 10_000,
    longest: int = 1_000_000,
) -> DataFrame:
    """All rows with mix_position (from 0, without gaps), mix_phase and mix_block.

    Each source is ranked in cells by the first hex digits of md5, as many as bring a cell of
    a source with all rows down to about ``cell_rows``.
    """
    spark = docs.sparkSession
    digits = max(1, math.ceil(math.log(max(1, docs.count() / cell_rows), 16)))
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    hashed = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))  # out of the way of the columns below
    rows = docs.select(row.alias("row"), name.alias("s"), hashed.alias("h"), F.xxhash64(text).alias("tie")).withColumn("cell", F.conv(F.substring("h", 1, digits), 16, 10).cast("long"))
    cells = rows.groupBy("s", "cell").count()
    counts = {r["s"]: r["n"] for r in cells.groupBy("s").agg(F.sum("count").alias("n")).collect()}
    target = {s: default_weight for s in counts} | {f"={s}": w for s, w in (weights or {}).items() if f"={s}" in counts}
    exact = {s: w if isinstance(w, Fraction) else Fraction(str(w)) for s, w in target.items()}
    phase_rows, slot_rows = tables(counts, exact, block_rows, slots, longest)

    earlier = F.sum("count").over(Window.partitionBy("s").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("s", "cell", F.coalesce(earlier, F.lit(0)).alias("before"))
    phase_table = spark.createDataFrame(phase_rows, T.StructType.fromDDL("s string, mix_phase int, begin long, end long, q long, n long, base long"))
    slot_table = spark.createDataFrame(slot_rows, T.StructType.fromDDL("s string, mix_phase int, k long, at long"))
    in_cell = Window.partitionBy("s", "cell").orderBy("h", "tie")
    block = F.col("mix_block")
    placed = (
        rows.withColumn("in", F.row_number().over(in_cell) - 1)
        .join(bounded_broadcast(cells, len(counts) * 16**digits), ["s", "cell"])
        .withColumn("rank", (F.col("before") + F.col("in")).cast("long"))
        .withColumn("mix_block", F.floor(F.col("rank") / block_rows).cast("long"))
        .join(bounded_broadcast(phase_table, len(phase_rows)), "s")
        .where((block >= F.col("begin")) & (block < F.col("end")))
        .withColumn("period", F.floor((block - F.col("begin")) / F.col("q")).cast("long"))
        .withColumn("k", (block - F.col("begin")) % F.col("q"))
        .join(bounded_broadcast(slot_table, len(slot_rows)), ["s", "mix_phase", "k"])
    )
    position = F.col("base") + (F.col("period") * F.col("n") + F.col("at")) * block_rows + F.col("rank") % block_rows
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ADDED]
    return placed.select(*kept, position.cast("long").alias("mix_position"), "mix_phase", "mix_block")


def bounded_broadcast(df: DataFrame, rows: int, most: int = 500_000) -> DataFrame:
    """A hint to broadcast a table whose row count is known and small."""
    return F.broadcast(df) if rows <= most else df
