"""Mixing, line dedup, URL filters, decontamination and language-model scoring."""

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textmill.llm import decontaminate, line_dedup, lm_score, mixing, queries, url_filter
from textmill.llm.common import table

# ---------------------------------------------------------------- mixing


def test_every_period_keeps_deadlines():
    for share in ({"a": 1}, {"a": 3, "b": 2, "c": 5}, {f"s{i}": i % 4 + 1 for i in range(17)}):
        period = mixing.earliest_deadline_first(share)
        n = sum(share.values())
        assert Counter(period) == share
        for s, q in share.items():
            had = np.cumsum([p == s for p in period])
            assert all(abs(h - (t + 1) * q / n) < 1 for t, h in enumerate(had))


def brute_mix(rows, weights, block_rows, slots):
    """Positions by scheduling block after block with a heap."""
    by = defaultdict(list)
    for key, source in rows:
        by[source].append(key)
    for s in by:
        by[s].sort(key=lambda k: hashlib.md5(str(k).encode()).hexdigest())
    queue = {s: [v[i : i + block_rows] for i in range(0, len(v), block_rows)] for s, v in by.items()}
    out = []
    while queue:
        share = mixing.quantised({s: weights.get(s, 1.0) for s in queue}, slots)
        n, taken, slot, ended = sum(share.values()), dict.fromkeys(queue, 0), 0, False
        while not ended:
            ready = [(-(-(taken[s] + 1) * n // q), s) for s, q in share.items() if taken[s] * n // q <= slot]
            heapq.heapify(ready)
            s = heapq.heappop(ready)[1]
            out += queue[s][taken[s]]
            taken[s] += 1
            slot += 1
            ended = taken[s] == len(queue[s])
        queue = {s: b[taken[s] :] for s, b in queue.items() if b[taken[s] :]}
    return out


def test_mix_equals_brute_force(spark, sf_mid):
    docs = table(spark, sf_mid, "documents").where("doc_id < 400")
    weights = {"src0": 5.0, "src1": 2.5, "src9": 0.2}
    mixed = mixing.mix(docs, weights, block_rows=4, slots=60, cell_rows=3)
    got = [r["doc_id"] for r in mixed.orderBy("mix_position").select("doc_id").collect()]
    assert got == brute_mix([(r["doc_id"], r["source"]) for r in docs.select("doc_id", "source").collect()], weights, 4, 60)


def test_mix_stays_within_a_block(spark, sf_mid):
    rows = mixing.mix(table(spark, sf_mid, "documents"), {"src0": 5.0}, block_rows=2, slots=100).where("mix_phase = 0").orderBy("mix_position").toPandas()
    share = mixing.quantised({s: 5.0 if s == "src0" else 1.0 for s in rows.source.unique()}, 100)
    for s, q in share.items():
        had = (rows.source == s).cumsum().to_numpy()[1::2]
        assert np.abs(had / 2 - np.arange(1, len(had) + 1) * q / 100).max() < 1


@pytest.mark.parametrize("weights", [{"a": 4.0, "b": 2.0, "c": 2.0, "d": 0.5, "e": 1.0}, {"a": 1.0, "b": 1e-5, "c": 0.3}, {"a": 0.1234567, "b": 7.0, "c": 3.3333}])
def test_blocks_stay_within_one_of_the_targets(weights):
    """100,000 blocks and more, against the weights as given; a source of weight 1e-5 has about one of them."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    total, blocks = sum(exact.values()), 60_000
    phase = mixing.phases({s: math.ceil(blocks * w / min(1, total)) + 9 for s, w in exact.items()}, exact, None, 1_000_000)[0]
    slots, names = phase["length"], list(exact)
    order = np.zeros(slots, dtype=int)
    for i, s in enumerate(names):
        where = np.array(phase["where"][s], dtype=np.int64)
        at = (where[None, :] + phase["period"] * np.arange(-(-slots // phase["period"]))[:, None]).ravel()
        order[at[at < slots]] = i
    assert slots >= 60_000
    for i, s in enumerate(names):
        had = np.cumsum(order == i)
        assert np.abs(had - np.arange(1, slots + 1) * float(exact[s] / total)).max() < 1
        assert phase["span"][s] == (0, had[-1])


def test_endless_weights_are_refused_for_many_blocks():
    weights = {"a": Fraction(1, 3), "b": Fraction("0.14159265358979")}
    assert len(mixing.phases({"a": 500, "b": 500}, weights, None, 1000)) == 2
    with pytest.raises(ValueError):
        mixing.phases({"a": 5000, "b": 5000}, weights, None, 1000)


def test_mix_odd_rows(spark, odd, empty):
    clash = odd.withColumn("mix_block", F.lit("clash")).withColumn("s", F.lit("own")).withColumn("k.at", F.lit(1))
    got = mixing.mix(clash, block_rows=2).collect()
    assert sorted(r["mix_position"] for r in got) == list(range(odd.count()))
    assert {(r["s"], r["k.at"]) for r in got} == {("own", 1)}
    assert mixing.mix(empty).count() == 0


# ---------------------------------------------------------------- line dedup


def brute_lines(rows, depth=3, similarity=0.7, least=5):
    """The template tree on plain lists: kept texts by (key, text)."""
    mask = lambda line: re.sub(r"(?<![^ ])(?=[^ ]*(?:[0-9@]|://))[^ ]+", "<*>", line)
    who = lambda key, text: (key is not None, key or 0, text)
    leaves, docs = defaultdict(lambda: defaultdict(set)), {who(k, t): t for k, t in rows if t is not None}

    def seen_as(line):
        line = re.sub(r"[ \t\x0b-\r]+", " ", line).strip(" ")
        return line if line.count(" ") + 1 < least else mask(line)

    for w, t in docs.items():
        for line in t.split("\n"):
            m = seen_as(line)
            if m:
                tokens = m.split(" ")
                leaves[len(tokens), tuple(tokens[:depth]) if len(tokens) >= least else m][m].add(w)
    owner = {}

    def place(lines, of):
        """Puts the lines of a group into templates, sets of the documents that have their lines."""
        while lines:
            count = Counter(p for m in lines for p in enumerate(m.split(" ")))
            common = {p for p, c in count.items() if 2 * c > len(lines)}
            fits = [m for m in lines if len(lines) > 1 and len(common & set(enumerate(m.split(" ")))) >= similarity * len(m.split(" "))]
            template = set().union(*(of[m] for m in fits))
            owner.update(dict.fromkeys(fits, template))
            lines = [m for m in lines if m not in set(fits)]
            count = Counter(p for m in lines for p in enumerate(m.split(" ")))
            parts = defaultdict(list)
            for m in lines:
                own = [p for p in enumerate(m.split(" ")) if count[p] > 1]
                if len(lines) < 2 or len(own) < similarity * len(m.split(" ")):
                    owner[m] = of[m]
                    continue
                rare = [(count[p], f"{p[0]} {p[1]}") for p in own if p[0] >= depth and 2 * count[p] <= len(lines)]
                most = [p for p in own if 2 * count[p] > len(lines)]
                parts["" if len(most) >= similarity * len(m.split(" ")) else max(rare)[1]].append(m)
            for part in parts.values():
                place(part, of)
            return

    for lines in leaves.values():
        if len(set.union(*lines.values())) > 1:
            place(list(lines), lines)
    first = {m: min(w[:2] for w in of) for m, of in owner.items() if len(of) > 1}
    return {w: "\n".join(x for x in t.split("\n") if first.get(seen_as(x), w[:2]) == w[:2]) for w, t in docs.items()}


def test_lines_equal_brute_force(spark, sf_mid):
    docs = table(spark, sf_mid, "documents").select("doc_id", "text")
    got = {(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(docs).select("doc_id", "text").collect()}
    want = brute_lines([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got == {(w[1], t) for w, t in want.items()}


def test_template_with_variable_fields(spark):
    own = [f"unique line number words of document {x} which nothing else is like" for x in ("one", "two", "three", "four")]
    rows = [(i, f"Order 1{i}7 was shipped to the customer at 0{i}:15 by a{'bcde'[i]}@example.com\n{own[i]}") for i in range(4)]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0]["n_dropped"] == 0 and out[0]["text"] == rows[0][1]
    assert all("Order" not in out[i]["text"] for i in (1, 2, 3))


def test_several_templates_in_a_leaf(spark):
    """Two and more templates with variable words, which a leaf shares; known by planting."""
    names = [f"{a}{b}" for a in ("an", "be", "cor", "da", "el") for b in ("na", "rik", "ta", "mir")]
    a = "The mail of {} was sent to all members of the club".format
    b = "The mail of {} is full please remove some of your letters".format
    c = "The mail of {} may be read by every one of us".format
    two = [(i, f"{a(n)}\n{b(n)}") for i, n in enumerate(names)]
    out = line_dedup.dedup_lines(spark.createDataFrame(two, "doc_id long, text string")).agg(F.sum("n_dropped")).first()[0]
    assert out == 38
    one = [(i, a(n)) for i, n in enumerate(names)]
    assert line_dedup.dedup_lines(spark.createDataFrame(one, "doc_id long, text string")).agg(F.sum("n_dropped")).first()[0] == 19
    same = [(i, "All rights reserved.") for i in range(20)]
    assert line_dedup.dedup_lines(spark.createDataFrame(same, "doc_id long, text string")).agg(F.sum("n_dropped")).first()[0] == 19
    noise = [(100 + i, f"The mail of {n} " + " ".join(f"{n}{k}x"[::-1].replace("0", "o") for k in "abcdefgh")) for i, n in enumerate(names)]
    many = [(i, f"{a(n)}\n{b(n)}\n{c(n)}") for i, n in enumerate(names)] + noise
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(spark.createDataFrame(many, "doc_id long, text string")).collect()}
    assert got == {i: 3 * (0 < i < 20) for i, _ in many}


def test_lines_odd_rows(spark, odd, empty):
    out = line_dedup.dedup_lines(odd.withColumn("n_lines", F.lit("clash")).withColumn("__key", F.lit("own")).withColumn("drop", F.lit(1))).collect()
    assert {(r["__key"], r["drop"]) for r in out} == {("own", 1)}
    assert len(out) == odd.count()
    by = defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
    assert by[1][0]["text"] is None and by[2][0]["text"] == ""
    assert by[5][0]["n_dropped"] == 0 and [r["n_dropped"] for r in by[6]] == [1, 1]
    assert line_dedup.dedup_lines(empty).count() == 0


def test_leaves_need_the_leading_tokens_alone(spark):
    """A line's leaf is that of its whole masked line, and a filter on leaves needs no pattern over whole lines."""
    lines = ["a1 b http://x/y c d e", "one two three four 5 six", "  http://a b@c 7 x y z w", "x\ty  z\u00a0q r s", "a 1 b", "", "   ", "\u4f60\u597d 3 a b c d"]
    docs = spark.createDataFrame([(1, 1, "\n".join(lines)), (2, 2, None)], "__key long, __id long, text string")
    out = line_dedup.lines_of(docs, "text", 3, 1, 5)
    n = line_dedup.n_tokens(F.col("masked"))
    whole = F.xxhash64(n, F.when(n < 5, F.col("masked")).otherwise(F.substring_index("masked", " ", 3)))
    got = {r["line_no"]: (r["masked"], r["leaf"] == r["whole"]) for r in out.withColumn("whole", whole).collect()}
    masked = {0: "<*> b <*> c d e", 1: "one two three four <*> six", 2: "<*> <*> <*> x y z w", 3: "x y z q r s", 4: "a 1 b", 7: "\u4f60 \u597d <*> a b c d"}
    assert got == {k: (v, True) for k, v in masked.items()}
    plan = out.select("leaf")._jdf.queryExecution().optimizedPlan().toString()
    assert "substring_index(line" in plan and "transform(" not in plan and "regexp_replace(line" not in plan


def test_short_lines_and_other_white_space(spark):
    own = [" ".join(w + x for w in "words of a line that no other document has".split()) for x in "abc"]
    dense, thai = "\u6b22\u8fce\u6765\u5230\u6211\u4eec\u7684\u7f51\u7ad9", "\u0e22\u0e34\u0e19\u0e14\u0e35\u0e15\u0e49\u0e2d\u0e19\u0e23\u0e31\u0e1a"
    same = ["All rights reserved.", "Menu", dense, thai, "one\ttab parts\u00a0all of these"]
    rows = [(i, "\n".join([own[i], *same, "", f"Chapter {i}", ""])) for i in range(3)]
    rows[2] = (2, rows[2][1].replace("\t", "  ").replace("\u00a0", "\t").replace(dense, dense[:4] + "\u4f60" + dense[5:]))
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_tokens=1).collect()}
    assert out[0]["text"] == rows[0][1] and out[0]["n_left"] == 7
    for i in (1, 2):
        assert out[i]["text"] == f"{own[i]}\n\nChapter {i}\n" and (out[i]["n_dropped"], out[i]["n_left"]) == (5, 2)


def test_query_drops_short_repeats(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs, min_tokens=1).select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    assert sorted(map(tuple, queries.op4_line_dedup(spark, sf).select("doc_id", "text_sha256").collect())) == sorted(map(tuple, kept.collect()))
    lines = line_dedup.dedup_lines(docs, min_tokens=1).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) != ''")
    assert lines.groupBy("line").agg(F.count_distinct("doc_id").alias("n")).where("n > 1").count() == 0


# ---------------------------------------------------------------- url filters


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("HTTP://Www.Example.COM/en/71", "www.example.com", "/en/71", "example.com/en/7", "allow"),
        ("https://example.com/en/8?x#y", "example.com", "/en/8", "com/en/", "block"),
        ("x://notexample.com", "notexample.com", "", None, "allow"),
        ("https://a.example.net/de/8", "a.example.net", "/de/8", "example.net/de/8", "block"),
        ("ftp://b.net/de/8#f?", "b.net", "/de/8", "net/de/", "block"),
        ("https://org/es/", "org", "/es/", "org/es/", "block"),
        ("https://fakecom/en/1", "fakecom", "/en/1", None, "allow"),
        ("https://h.com?/en/1", "h.com", "", None, "allow"),
        ("//no.scheme/en/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    page = spark.createDataFrame([(1, url, None)], "page_id long, url string, html string")
    r = url_filter.judge(page, url_filter.CONTRACT_RULES, ["page_id"]).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


LINKED = [
    (1, "http://bad.com/en/1", ""), (2, "http://bad.com/en/2", None),
    (3, "http://fan.info/x", '<a href="http://bad.com/en/1">'), (4, "http://fan.info/y", "<a href='//BAD.com/z'>"),
    (5, "http://good.info/x", '<a href="http://example.com/en/7">'), (6, "http://example.com/en/7", '<a href="http://good.info/">'),
    (7, "http://alone.info/", "<a href=/en/>"),
]


def test_distrust_flows_against_links(spark):
    pages = spark.createDataFrame(LINKED * 3, "page_id long, url string, html string")
    out = {r["page_id"]: r for r in url_filter.judge(pages, url_filter.CONTRACT_RULES, ["page_id"], threshold=0.4).collect()}
    assert out[3]["verdict"] == "block" and out[3]["blame"] > 0.4
    assert out[5]["verdict"] == out[6]["verdict"] == out[7]["verdict"] == "allow"


def test_url_sql_on_linked_pages(spark):
    pages = spark.createDataFrame(LINKED, "page_id long, url string, html string")
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = con.execute(url_filter.judge_sql(url_filter.CONTRACT_RULES, threshold=0.4)).fetchall()
    got = url_filter.judge(pages, url_filter.CONTRACT_RULES, ["page_id"], threshold=0.4).drop("blame").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_distrust_reaches_along_chains(spark):
    """Ranks equal the solution of the linear equations, also far from any seed and round a cycle."""
    names = [f"h{i}.info" for i in range(40)]
    links = [(i, i - 1) for i in range(1, 40)] + [(5, 9), (20, 30)]
    edges = spark.createDataFrame([(names[a], names[b], 1 + a % 3) for a, b in links], "src string, dst string, weight long")
    seeds = spark.createDataFrame([("distrust", names[0], 5), ("trust", names[39], 2)], "kind string, host string, seed long")
    got = {(r["kind"], r["host"]): r["rank"] for r in url_filter.propagate(seeds, edges, 0.85, 1e-6).collect()}
    flow = np.zeros((40, 40))
    for a, b in links:
        flow[a, b] = 1 + a % 3
    for kind, f, at, n in (("distrust", flow.T, 0, 5.0), ("trust", flow, 39, 2.0)):
        share = np.divide(f, f.sum(axis=1, keepdims=True), out=np.zeros_like(f), where=f.sum(axis=1, keepdims=True) > 0)
        seed = np.zeros(40)
        seed[at] = 0.15 * n
        want = np.linalg.solve(np.eye(40) - 0.85 * share.T, seed)
        assert np.allclose([got.get((kind, h), 0.0) for h in names], want, atol=1e-5)
    assert got["distrust", names[30]] > 0


def test_url_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.judge(pages, url_filter.CONTRACT_RULES, ["page_id"]).count() == 0


# ---------------------------------------------------------------- decontamination


@pytest.mark.parametrize("name", ["op5_url_filter", "op6_decontamination"])
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.queries()[name](spark, sf)
    names = sorted(df.columns)
    cursor = con.execute(queries.oracle_sql()[name])
    order = [c[0] for c in cursor.description]
    want = sorted((tuple(r[order.index(c)] for c in names) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=str) == want


def test_search_equals_brute_force():
    random = np.random.default_rng(3)
    for length in (1, 2, 3, 5):
        for _ in range(60):
            words = [b"%d" % w for w in random.integers(0, 4, 60)]
            patterns = {tuple(b"%d" % w for w in random.integers(0, 4, length)) for _ in range(4)}
            want = [(i, tuple(words[i : i + length])) for i in range(len(words) - length + 1) if tuple(words[i : i + length]) in patterns]
            assert list(decontaminate.WuManber(patterns).find(words)) == want


def test_contamination_rule_blocks_and_odd_rows(spark, odd, empty):
    item = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(3, item), (3, item), (10, "SAME words"), (11, None), (12, "?!")], "item_id long, text string")
    docs = spark.createDataFrame([(100, item.upper(), "", "", 0), (101, "w0 " + " ".join("x" for _ in range(400)), "", "", 0)], odd.schema).union(odd).withColumn("n_hit", F.lit("clash"))
    for chars in (1 << 24, 40):  # one block, and several
        out = decontaminate.contamination(docs, bench, ["doc_id"], block_chars=chars).collect()
        by = {r["doc_id"]: r for r in out}
        assert len(out) == docs.count()
        assert (by[100]["n_words"], by[100]["n_hit"], by[100]["items"], by[100]["contaminated"]) == (20, 20, ["3"], True)
        assert by[101]["n_hit"] == 0 and not by[101]["contaminated"]
        assert by[5]["n_hit"] == 2 and by[5]["items"] == ["10"] and by[1]["n_words"] == 0
        assert by[1]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert not any(r["contaminated"] for r in decontaminate.contamination(odd, bench.limit(0), ["doc_id"]).collect())
    assert decontaminate.contamination(empty, bench, ["doc_id"]).count() == 0


# ---------------------------------------------------------------- language-model scoring


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", lowered) if w] + [None]


def test_base_equals_brute_force(spark, sf):
    rows = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    counts = Counter(w for i, t in rows.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in words(t))
    n, v = sum(counts.values()), len(counts)
    got = queries.op8_lm_score(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        own = words(rows[r["doc_id"]])
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel=1e-9)
        assert r["score"] < 0


def small_tree(texts, depth=3, least=2.0, divergence=0.0, kappa=2.0):
    counts = Counter()
    for t in texts:
        s = b"\n" * depth + lm_score.content(t)
        for i in range(depth, len(s)):
            for n in range(depth + 1):
                counts[n, int.from_bytes(s[i - n : i], "big"), s[i]] += 1
    rows = pd.DataFrame([(n, c, x, k) for (n, c, x), k in counts.items()], columns=["len", "context", "symbol", "n"])
    return lm_score.grow(rows, depth, least, divergence, kappa)


def test_tree_states_are_distributions():
    tree = small_tree(["a b a b a b", "abc abc abd"])
    known = tree.log10p.shape[1] - 1
    total = (10.0 ** tree.log10p[:, :known]).sum(axis=1) + (256 - known) * 10.0 ** tree.log10p[:, known]
    assert np.allclose(total, 1, atol=1e-4)


def test_tree_scores_equal_walk():
    texts = ["a b a b a b", "abc abc abd"]
    tree = small_tree(texts, divergence=0.02)
    index = {int(k): i for i, k in enumerate(tree.keys)}
    for t in (*texts, "zzz", "", None, "b a c"):
        s, total = b"\n" * 3 + lm_score.content(t), 0.0
        for i in range(3, len(s)):
            state = next(index[n << 56 | int.from_bytes(s[i - n : i], "big")] for n in (3, 2, 1, 0) if (n << 56 | int.from_bytes(s[i - n : i], "big")) in index)
            total += tree.log10p[state, tree.code[s[i]]]
        assert tree.scorer()([lm_score.content(t)])[0] == pytest.approx(total, rel=1e-6)


def test_fit_equals_brute_force(spark, docs):
    """Counts over ranges and tasks, and the contexts that pass, against a plain count of all grams."""
    texts = [r["text"] for r in docs.limit(60).collect()]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    model = lm_score.fit(frame, depth=3, p_min=1e-3, bucket_chars=20_000)
    positions = sum(len(lm_score.content(t)) for t in texts)
    want = small_tree(texts, least=1e-3 * positions, divergence=0.01, kappa=6.0)
    a, b = ({int(k): tuple(p) for k, p in zip(t.keys, t.log10p.round(4))} for t in (model.tree, want))
    assert len(a) > 100 and a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=2e-4) for k in a)


def test_ids_are_the_same_when_a_task_runs_anew(spark, docs):
    model = lm_score.fit(docs)
    once, again = (sorted(lm_score.score(docs, model, ["doc_id"]).collect()) for _ in range(2))
    assert once == again and len(once) == docs.count()


def test_lookup_finds_all():
    keys = np.random.default_rng(5).integers(0, 1 << 62, 5000).astype(np.uint64)
    table_ = lm_score.Lookup(np.unique(keys))
    assert (np.unique(keys)[table_.find(keys)] == keys).all()
    assert (table_.find(keys + np.uint64(1 << 63)) == -1).all()


def test_lm_odd_rows(spark, odd, empty):
    model = lm_score.fit(odd)
    got = lm_score.score(odd, model, ["doc_id"]).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == odd.count() and by[1]["n_tokens"] == by[2]["n_tokens"] == 1
    assert by[1]["base_score"] == by[2]["base_score"] and by[7]["n_tokens"] == 60_001
    nothing = lm_score.fit(empty)
    assert {r["n_known"] for r in lm_score.score(odd, nothing, ["doc_id"]).collect()} == {0}
    assert lm_score.score(empty, model, ["doc_id"]).count() == 0
