"""The pipeline: each stage on its own input, planted cases, and the whole run."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from textmill.llm.common import table

PROSE = [
    "Thonst a loser the ndston eres tion to and the heat of reer was enough for thing and other in a there",
    "Every other river bends at the old mill before it reaches the quiet harbour beyond the northern hill",
    "Seven small boats were painted green last winter because the paint was cheap and the days were long",
    "Nobody in the village remembers who planted the orchard although everyone has eaten from its trees",
]


def document(i, n=40):
    letters = str.maketrans("0123456789", "abcdefghij")  # a token with a digit is a variable field
    return " ".join(f"{w}{(i * 7 + k) % 97}q{i}".translate(letters) for k, w in enumerate((PROSE[i % 4] * 3).split()[:n]))


def names():
    return [n for n, _ in corpus_pipeline.STAGES]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages():
    assert names() == ["quality", "line_dedup", "near_duplicates", "decontamination", "mixing"]


def test_stages_keep_columns_and_shrink(spark, sf, docs):
    before = docs
    for name, f in corpus_pipeline.STAGES:
        after = f(spark, before, sf).cache()
        if name != "mixing":
            assert after.columns == docs.columns and after.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        ids = [r[0] for r in after.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= {r[0] for r in before.select("doc_id").collect()}
        before = after
    assert sorted(r[0] for r in before.select("mix_position").collect()) == list(range(before.count()))


def test_run_equals_stages(spark, sf, docs):
    by_hand = docs
    for _, f in corpus_pipeline.STAGES:
        by_hand = f(spark, by_hand, sf).cache()
    got = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, by_hand.collect()), key=str)


def test_quality_stage_rejects_junk(spark, sf_mid):
    good = table(spark, sf_mid, "documents").join(table(spark, sf_mid, "labels").where("quality = 1"), "doc_id", "left_semi").where("doc_id < 300")
    junk = good.withColumn("text", F.regexp_replace("text", "([^ ]+)", "$1###")).withColumn("doc_id", F.col("doc_id") + 100_000)
    kept = {r[0] for r in stage("quality")(spark, good.union(junk), sf_mid).select("doc_id").collect()}
    n = good.count()
    assert sum(i < 100_000 for i in kept) >= 0.97 * n and sum(i >= 100_000 for i in kept) <= 0.05 * n


def test_line_stage_drops_repeated_passages(spark, sf):
    passage = " ".join(f"passage{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    docs = frame(spark, [(i, document(i) + "\n" + passage) for i in range(12)] + [(50, document(50)), (51, document(0) + "\n" + passage)])
    out = {r["doc_id"]: r for r in stage("line_dedup")(spark, docs, sf).collect()}
    assert sum("passageeb" in r["text"] for r in out.values()) == 1
    assert set(range(12)) | {50} <= out.keys() and 51 not in out
    assert out[50]["text"] == document(50)
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())


def test_line_stage_keeps_documents_of_short_lines(spark, sf):
    passage = "every document of these has the same long line at its end"
    verse = [f"{w}\nand {w}a\n\nnot {w}b" for w in ("one", "two", "three")]
    docs = frame(spark, [(i, v + "\n" + passage) for i, v in enumerate(verse)] + [(7, passage + "\n \t\n")])
    out = {r["doc_id"]: r["text"] for r in stage("line_dedup")(spark, docs, sf).collect()}
    assert out == {0: verse[0] + "\n" + passage, 1: verse[1], 2: verse[2]}


def test_near_duplicate_stage_keeps_one_of_each(spark, sf):
    rows = [(i, document(i, 60)) for i in range(8)]
    copies = [(100 + i, t) for i, t in rows[:4]] + [(200 + i, t.replace(t.split()[5], "changed", 1)) for i, t in rows[:4]]
    kept = [r[0] for r in stage("near_duplicates")(spark, frame(spark, rows + copies), sf).select("doc_id").collect()]
    assert sorted(kept) == list(range(8))


def test_decontamination_stage(spark, sf):
    item = max((r["text"] for r in table(spark, sf, "benchmark").collect()), key=len)
    docs = frame(spark, [(1, document(1)), (2, item), (3, document(3) + " " + item), (4, document(4))])
    kept = sorted(r[0] for r in stage("decontamination")(spark, docs, sf).select("doc_id").collect())
    assert kept == [1, 4]


@pytest.mark.parametrize("name", ["line_dedup", "near_duplicates", "decontamination", "mixing", "quality"])
def test_odd_rows(spark, sf, odd, empty, name):
    clash = odd
    for c in ("score", "n_hit", "n_words", "contaminated", "n_dropped", "n_left", "row", "c0", "s", "sig"):
        clash = clash.withColumn(c, F.lit(f"own {c}"))
    out = stage(name)(spark, clash, sf)
    assert out.columns[: len(clash.columns)] == clash.columns
    rows = out.collect()
    assert len(rows) <= clash.count() and all(r[c] == f"own {c}" for r in rows for c in clash.columns[5:])
    assert stage(name)(spark, empty, sf).count() == 0
