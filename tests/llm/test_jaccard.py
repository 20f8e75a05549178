"""The shingle-set join against brute force, and its parts."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.llm import jaccard_join as jj
from textmill.llm import queries
from textmill.llm.common import bloom, maybe, table
from textmill.llm.components import connected_components


def shingles(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", lowered) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """Component ids by comparing all pairs of texts."""
    sets = [(k, shingles(t)) for k, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    out = {}
    for i, (k, s) in enumerate(sets):
        same = [sets[j][0] for j in range(len(sets)) if find(j) == find(i) and sets[j][0] is not None]
        out.setdefault(k, set()).add((len(s), min(same) if same else k))
    return out


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"]))
    return out


def test_documents_equal_brute_force(spark, sf, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(queries.op7_jaccard_join(spark, sf)) == brute(rows)


@pytest.mark.parametrize("seed", [0, 1])
def test_near_copies_equal_brute_force(spark, seed):
    """Groups with edits around the threshold, short texts, a passage that all share, exact copies."""
    random = np.random.default_rng(seed)
    word = lambda: f"w{random.integers(0, 5000)}"
    passage = " ".join(word() for _ in range(30))
    texts = []
    for size in (3, 5, 6, 7, 8, 9, 12, 20, 40, 90, 150):
        base = [word() for _ in range(size)]
        for _ in range(9):
            copy = list(base)
            for _ in range(int(random.integers(0, max(2, size // 14)))):
                at = int(random.integers(0, len(copy)))
                how = random.integers(0, 3)
                copy[at : at + (how != 1)] = [word()] if how != 2 else []
            texts.append(" ".join(copy) if random.random() < 0.7 else passage + " " + " ".join(copy))
    texts += texts[:10]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jj.link_components(df, signatures_a_bucket=200)) == brute(rows)
    assert got(jj.link_components(df, signatures_a_bucket=200, most=2)) == brute(rows)


def test_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = got(jj.link_components(odd))
    assert found == brute(rows)
    assert found[1] == {(0, 1)} and found[5] == found[6] and found[7] == {(1, 7)}
    assert jj.link_components(empty).count() == 0
    kept = [r["doc_id"] for r in jj.one_of_each(odd).collect()]
    assert 6 not in kept and {1, 2, 3, 5, 7, None} <= set(kept)
    assert jj.one_of_each(empty).count() == 0


def test_signatures_outlast_differences():
    """Any two sets within the bound share a signature of the cheapest sufficient option."""
    measure, random = jj.Measure(), np.random.default_rng(2)
    for n in (3, 4, 7, 10, 33, 64, 200):
        for _ in range(20):
            a = np.unique(random.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
            out = int(random.integers(0, n // 7 + 1))
            b = np.unique(np.concatenate([a[out:], random.integers(0, 1 << 63, out, dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 4 * common < 3 * (len(a) + len(b) - common):
                continue
            shared = set(measure.bands(len(a))) & set(measure.bands(len(b)))
            assert shared
            k = min(shared)
            for option in range(len(jj.OPTIONS)):
                bits, share = measure.segments(k, option)
                most = {len(s): measure.most_differences(len(s)) for s in (a, b)}
                if all(jj.gain_and_cost(s, bits, share, most[len(s)])[0] > most[len(s)] for s in (a, b)):
                    x, y = (set(jj.signatures(s, k, bits, share, most[len(s)])[0].tolist()) for s in (a, b))
                    assert x & y


def test_bands_meet():
    measure = jj.Measure()
    for x in range(1, 400):
        for y in range(x, x * 4 // 3 + 1):
            if y != x or measure.bands(x):
                assert set(measure.bands(x)) & set(measure.bands(y)), (x, y)


def test_bloom_has_all_it_was_given(spark):
    ids = spark.range(500).selectExpr("id * 1000003 - 7 as h")
    words = bloom(ids, "h", 1 << 12).scalar()
    assert ids.where(maybe(words, F.col("h"), 1 << 12)).count() == 500
    assert spark.range(10_000, 20_000).where(maybe(words, F.col("id"), 1 << 12)).count() < 3000


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(31)} == {0} and {found[i] for i in range(100, 130)} == {100}


def near_group(random, copies, words=120, edits=40):
    """Copies of one text, each with up to ``edits`` random edits, and copies of some of these."""
    base = [f"b{i}" for i in range(words)]
    out = []
    for i in range(copies):
        copy = list(out[int(random.integers(0, len(out)))].split() if out and i % 5 == 0 else base)
        for _ in range(int(random.integers(0, edits if i % 3 else 4))):
            at = int(random.integers(0, len(copy)))
            how = random.integers(0, 3)
            copy[at : at + (how != 1)] = [f"e{random.integers(0, 100_000)}"] if how != 2 else []
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("rows_a_partition", [10, 200_000])
def test_components_by_rounds_and_by_one_task(spark, rows_a_partition):
    random = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in random.integers(-(2**62), 2**62, 150)[random.integers(0, 150, (110, 2))]]
    least = {n: n for edge in edges if edge[0] != edge[1] for n in edge}
    for _ in least:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), rows_a_partition=rows_a_partition).collect()
    assert {r["node"]: r["root"] for r in found} == least and len(found) == len(least)
    assert not connected_components(spark.createDataFrame([], "a long, b long"), rows_a_partition=rows_a_partition).collect()


def test_few_edges_take_no_rounds(spark):
    """A long path of few edges: every round would cost each partition a task and a file for each of its shuffles."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    context = spark.sparkContext
    context.setJobGroup("few edges", "")
    try:
        assert {r["root"] for r in connected_components(edges).collect()} == {0}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("few edges")) <= 6


@pytest.mark.parametrize("most", [4, 64])
def test_large_group_of_near_copies_equals_brute_force(spark, most):
    random = np.random.default_rng(11)
    rows = list(enumerate(near_group(random, 500)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(jj.link_components(df, most=most, signatures_a_bucket=2000)) == brute(rows)


def test_deletions_are_chosen(spark, sf_mid):
    """On the documents, deletions for the few short sets are cheaper than twice the segments for all, in some bands."""
    described = jj.describe(table(spark, sf_mid, "documents"), "doc_id", "text", jj.Measure())
    chosen, _ = jj.allocate(described, jj.Measure())
    assert any(jj.OPTIONS[o][1] > 0 for o in chosen.values())


def test_deletions_alone_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jj, "OPTIONS", [(0, 0.5), (0, 1.0), (24, 1.0)])
    random = np.random.default_rng(6)
    rows = list(enumerate(near_group(random, 60) + near_group(random, 30, words=40, edits=8)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    chosen, _ = jj.allocate(jj.describe(df, "doc_id", "text", jj.Measure()), jj.Measure())
    assert all(jj.OPTIONS[o][1] > 0 for o in chosen.values())
    assert got(jj.link_components(df)) == brute(rows)


def test_names_are_few_beside_signatures(spark, monkeypatch):
    """A table of many buckets sends a set's name to few of them, in both partitions of the universe."""
    random = np.random.default_rng(4)
    words = lambda n: " ".join(f"w{x}" for x in random.integers(0, 1 << 40, n))
    rows = list(enumerate(f"{half} {words(75)}" for half in [words(75) for _ in range(40)] for _ in range(6)))
    sent, inner = [], jj.shared

    def spy(packed, names, buckets, *rest, **named):
        sums = packed.agg(F.sum(F.length("who")), F.sum(F.length("keys"))).first()
        sent.append((buckets, *sums))
        return inner(packed, names, buckets, *rest, **named)

    monkeypatch.setattr(jj, "shared", spy)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jj.link_components(df, signatures_a_bucket=2000)) == brute(rows)
    assert len(sent) == 2 and all(buckets > 10 and 3 * who < keys for buckets, who, keys in sent), sent


def test_places_part_segments_and_hold_equal_signatures():
    random = np.random.default_rng(5)
    sig = random.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2)
    for bits, buckets in ((1, 9), (7, 9), (7, 1), (40, 5), (64, 6)):
        segment = random.integers(0, (1 << bits) - 1, len(sig), dtype=np.uint64, endpoint=True)
        at = jj.places(segment, bits, sig, buckets)
        counts = np.bincount(at, minlength=buckets)
        assert len(counts) == buckets and counts.min() * 2 > counts.max()
        assert (jj.places(segment[::-1], bits, sig[::-1], buckets)[::-1] == at).all()
