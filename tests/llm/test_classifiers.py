"""Language, quality and toxicity: held-out accuracy, their parts, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.llm import language_id, quality, queries, toxicity
from textmill.llm.common import fold, labelled_sample, shingle_hashes, slices, spread_sample, table, word_hashes


def test_fold_matches_zlib(spark):
    import zlib

    got = {r["id"]: r["f"] for r in spark.range(50).select("id", fold("id", 5).alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 for i in range(50)}


def test_spread_sample_is_bounded_and_stable(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 3).cast("int").alias("y"))
    a = spread_sample(df, "k", "y", 40).collect()
    b = spread_sample(df.repartition(7), "k", "y", 40).collect()
    assert sorted(a) == sorted(b) and len(a) == 120


def test_repeated_keys_keep_the_sample_bounded(spark):
    docs = spark.createDataFrame([(1, f"t{i}") for i in range(500)] + [(2, "b"), (2, None), (3, "c")], "k long, t string")
    labels = spark.createDataFrame([(1, 0)] * 300 + [(2, 1), (2, 0), (3, 1)], "k long, y int")
    a, b = (sorted(labelled_sample(d, l, "k", "t", "y", 5).collect(), key=str) for d, l in ((docs, labels), (docs.repartition(5), labels.repartition(3))))
    assert a == b and [(r["k"], r["y"]) for r in a] == [(1, 0), (2, 1), (3, 1)]


def test_word_hashes_tell_words_apart():
    words = [b"a", b"b", b"ab", b"ba", b"a" * 63, b"a" * 64, b"a" * 65, b"a" * 200]
    h = word_hashes(b" \t".join(words))
    assert len(h) == len(words) and len(set(h.tolist())) == len(words)
    assert word_hashes(b"\n  ").size == 0
    again = word_hashes(b"ab x ab")
    assert again[0] == again[2] == h[2]
    assert len(shingle_hashes(again, 5)) == 1 and len(shingle_hashes(word_hashes(b"a b c d e f g"), 5)) == 3


def test_slices_keep_every_row():
    import pandas as pd

    batch = pd.DataFrame({"t": ["x" * n for n in (1, 50, 2, 300, 4)] + [None]})
    parts = list(slices(batch, "t", rows=2, chars=100))
    assert sum(map(len, parts)) == 6 and max(map(len, parts)) <= 2


def test_language_held_out(spark, sf_mid):
    rows = queries.op1_language_id(spark, sf_mid).join(table(spark, sf_mid, "documents").select("doc_id", "lang"), "doc_id")
    share = rows.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share > 0.98
    assert rows.count() == 1000
    low, high = rows.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low <= high <= 1


def test_language_odd_rows(spark, odd, docs):
    model = language_id.fit(docs.limit(150))
    got = language_id.identify(odd, model, ["doc_id"]).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert by[1] == by[2] == by[3] == by[4] == "und"
    assert by[9] in model.langs
    assert by[5] == by[6]


def test_language_without_training(spark, odd, empty):
    model = language_id.fit(empty)
    assert {r["lang_pred"] for r in language_id.identify(odd, model, ["doc_id"]).collect()} == {"und"}
    assert language_id.identify(empty, model, ["doc_id"]).count() == 0


def test_kmeans_separates():
    x = np.array([[1, 0], [0.99, 0.1], [0, 1], [0.1, 0.99]], dtype=np.float32)
    _, owner = language_id.spherical_kmeans(x, 2)
    assert owner[0] == owner[1] != owner[2] == owner[3]


def test_far_text_is_rejected(docs):
    model = language_id.fit(docs)
    out = model.predict(["qqqq zzzz xxxx jjjj qqqq", "the of and the of and"])
    assert out["rejected"][0] and 0 <= out["score"][0] < 0.5


def test_quality_held_out(spark, sf_mid):
    rows = queries.op2_quality(spark, sf_mid).join(table(spark, sf_mid, "labels"), "doc_id").where("held_out")
    share = rows.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0]
    assert share > 0.9


def test_quality_odd_rows(spark, odd, empty, sf_mid):
    model = quality.fit(table(spark, sf_mid, "documents"), table(spark, sf_mid, "labels"))
    got = quality.score(odd, model, ["doc_id"]).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (5, 6)}) == 1
    assert quality.score(empty, model, ["doc_id"]).count() == 0
    none = quality.fit(empty, table(spark, sf_mid, "labels"))
    assert {round(r["score"], 6) for r in quality.score(odd, none, ["doc_id"]).collect()} == {0.5}


def test_dual_coordinate_descent_meets_the_optimum():
    """The dual solution satisfies the optimality conditions of the primal."""
    random = np.random.default_rng(1)
    x = [np.flatnonzero(random.random(12) < 0.4) for _ in range(60)]
    y = np.array([1 if 3 in c else -1 for c in x])
    scale = np.linspace(0.5, 2, 12)
    w, bias = quality.dual_coordinate_descent(x, y, scale, 1.0, 400, 1e-9)

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + sum(max(0.0, 1 - yi * (w[c] @ scale[c] + b)) for c, yi in zip(x, y))

    best = loss(w, bias)
    for _ in range(200):
        assert best <= loss(w + random.normal(0, 0.05, 12), bias + random.normal(0, 0.05)) + 1e-6


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op10_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out")
    agree = rows.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int")), F.avg(F.when(F.col("toxic") == 1, F.col("predicted")))).first()
    assert agree[0] > 0.95 and agree[1] > 0.8


@pytest.fixture(scope="module")
def matcher():
    return toxicity.Matcher(toxicity.Lexicon({"idiot": 5.0}, {"lowei": 4.0}))


@pytest.mark.parametrize(
    "clause,want",
    [
        ("you are an idiot", {"aimed_insult": 5.0}),
        ("what an idiot", {"insult": 5.0}),
        ("idiots everywhere", {}),
        ("not an idiot", {"negated_insult": 5.0}),
        ("not one of all of these an idiot", {"insult": 5.0}),
        ("the man said what an idiot", {"reported_insult": 5.0}),
        ('the word "idiot" here', {"reported_insult": 5.0}),
        ("loweiisch so", {"insult": 4.0}),
        ("i will kill you", {"threat": 1.0}),
        ("you i kill", {"aimed_threat": 1.0}),
    ],
)
def test_grammar(matcher, clause, want):
    assert dict(matcher.clause(clause)) == want


def test_clauses_do_not_touch(matcher):
    x = dict(zip(toxicity.EVENTS, matcher.events("You there. An idiot; not this. Never! idiot")))
    assert x["insult"] == pytest.approx(np.log1p(10.0)) and x["aimed_insult"] == x["negated_insult"] == 0


def test_long_texts_take_time_in_proportion(matcher):
    """Ten megabytes of clauses, of which only one mark parts, each matched once."""
    x = dict(zip(toxicity.EVENTS, matcher.events("what an idiot. " * 700_000)))
    assert x["insult"] == pytest.approx(np.log1p(5.0 * 700_000))


def test_composition_equals_cascade():
    plain = [(k, "") for k in range(7)]
    first = toxicity.window_transducer(plain, toxicity.NEGATION, "n", 3)
    second = toxicity.reported_transducer(plain + [(k, "n") for k in (toxicity.INSULT, toxicity.THREAT)])
    both, random = first.compose(second), np.random.default_rng(0)
    for _ in range(200):
        symbols = [(int(k), "") for k in random.integers(0, 7, 12)]
        assert both.run(symbols) == second.run(first.run(symbols))


def test_toxicity_odd_rows(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    model = toxicity.fit(table(spark, sf, "documents"), table(spark, sf, "labels"))
    got = toxicity.score(odd, model, ["doc_id"]).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    none = toxicity.fit(empty, table(spark, sf, "labels"))
    assert all(r["score"] < 0.3 for r in toxicity.score(odd, none, ["doc_id"]).collect())


def brute_indicators(text, bits):
    """Cells by loops over characters and words, in plain whole numbers."""
    raw = (text or "").encode("utf-8", "replace")
    mask = (1 << 32) - 1

    def kind(b, coarse):
        if 97 <= b <= 122 or b >= 128:
            return 1
        if 65 <= b <= 90:
            return 2
        if 48 <= b <= 57:
            return 3
        if b in b" \t\r\x0b\x0c":
            return 4
        return 5 if coarse and 33 <= b <= 126 else b + 5

    def cells(code, space):
        out = set()
        for n in (1, 2, 3, 4):
            for i in range(len(code) - n + 1):
                h = code[i]
                for c in code[i + 1 : i + n]:
                    h = (h * 0x01000193 + c) & mask
                out.add((((h + space * 0x9E37 + n * 0x51ED27) & mask) * 2654435761 & mask) >> (32 - bits))
        return out

    found = set()
    for space, coarse in ((1, False), (3, True)):
        runs = []
        for b in raw:
            k = kind(b, coarse)
            if runs and runs[-1][0] == k:
                runs[-1][1] += 1
            else:
                runs.append([k, 1])
        found |= cells([k * 4 + (0 if k <= 3 else min(n, 3)) for k, n in runs], space)
    words = raw.split()
    marks = [(i >= 1 and words[i] == words[i - 1]) + 2 * (i >= 2 and words[i] == words[i - 2]) for i in range(len(words))]
    return found | cells(marks, 2)


def test_quality_equals_brute_force(spark, sf):
    """Scores of the registered query from the fitted weights, by plain sums over brute-force cells."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").where(fold("doc_id", 5) != 0)
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in queries.op2_quality(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(rows) == len(got)
    for r in rows:
        cells = sorted(brute_indicators(r["text"], model.bits))
        assert cells == quality.indicators(r["text"], model.bits).tolist()
        length = sum(model.square[c] for c in cells) ** 0.5
        margin = (sum(model.weight[c] for c in cells) / length if length else 0.0) + model.bias
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-(model.slope * margin + model.offset))), rel=1e-9)


def test_toxicity_equals_brute_force(spark, sf_mid):
    """Events of every document by clause after clause, without the search for entries that comes before."""
    docs = table(spark, sf_mid, "documents")
    model = toxicity.fit(docs, table(spark, sf_mid, "labels").where(fold("doc_id", 4) != 2))
    assert model.lexicon.words or model.lexicon.stems
    machine = toxicity.Matcher(model.lexicon)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    for r in docs.select("doc_id", "text").collect():
        total = dict.fromkeys(toxicity.EVENTS, 0.0)
        for clause in toxicity._CLAUSE.findall((r["text"] or "").lower()):
            for event, weight in machine.clause(clause).items():
                total[event] += weight
        x = np.log1p(np.array(list(total.values())))
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-(x @ model.scale + model.offset))), rel=1e-9)
