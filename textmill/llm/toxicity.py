"""Toxicity by a weighted finite-state pattern grammar over clauses.

Deterministic letter-to-letter transducers are composed into one machine that reads the
classes of a clause's tokens and writes events:

* the lexical transducer reads a token and writes its class: insult, threat, target,
  negation, report, quotation mark or other;
* the negation transducer rewrites an insult or threat up to three tokens after a negation;
* the reported-speech transducer rewrites one that follows a reporting verb, or stands
  between quotation marks, in the same clause;
* the target transducer marks one that stands up to three tokens after a target.

Every event carries the weight of its lexical entry, and the arcs of the grammar scale it.
A document's score is a logistic function of the event weights of its matched clauses, so
isolated words count only through the clause they are matched in.

Insult entries (words, or stems that any letters may follow) are learned from labelled rows:
candidates are words and stems that are much more frequent in toxic documents, and a greedy
cover keeps those that explain toxic documents which others explain little, so that words
which merely came along with a copied document are passed over.  Event scales are learned too, with the
grammar's prior scales as the centre of the ridge penalty.

Learning uses at most ``sample`` labelled rows (the bound is a parameter), half for each
class, chosen by a hash of the key.

Defined results: null and empty texts match nothing and get the score of no match; repeated
rows get equal rows; without labels of both classes the lexicon is empty and every score is
the share of label 1, or 0 without labels; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, map_texts, sigmoid

THREATS = "kill murder hurt destroy strangle stab shoot töten umbringen erschießen tuer massacrer matar asesinar".split()
TARGETS = "you your yours he she they him them u du ihr euch dich tu toi vous vos usted ustedes vosotros".split()
NEGATIONS = "not never no isn't aren't don't nicht kein keine nie pas jamais ne nunca jamás".split()
REPORTS = "said says wrote quoted called claimed reported sagte schrieb dit écrit dijo escribió".split()

_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|[\"“”«»„]")
_CLAUSE = re.compile(r"[^.!?;:\n]+")
_WORD = re.compile(r"[^\W\d_]+")

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
#: Events that the composed grammar writes, and the prior scale of each.
EVENTS = {
    "insult": 1.0, "aimed_insult": 1.5, "negated_insult": 0.3, "reported_insult": 0.4,
    "threat": 0.1, "aimed_threat": 0.3, "negated_threat": 0.0, "reported_threat": 0.0,
}


class Transducer:
    """A deterministic transducer: ``arcs[state][symbol] = (next state, written symbol)``."""

    def __init__(self, arcs: list[dict], start: int = 0):
        self.arcs, self.start = arcs, start

    def compose(self, other: Transducer) -> Transducer:
        """What ``other`` writes when it reads what this one writes."""
        index, queue, arcs = {(self.start, other.start): 0}, [(self.start, other.start)], []
        for a, b in queue:
            row = {}
            for symbol, (a2, between) in self.arcs[a].items():
                b2, out = other.arcs[b][between]
                if (a2, b2) not in index:
                    index[a2, b2] = len(queue)
                    queue.append((a2, b2))
                row[symbol] = (index[a2, b2], out)
            arcs.append(row)
        return Transducer(arcs)

    def run(self, symbols: list) -> list:
        state, out = self.start, []
        for s in symbols:
            state, o = self.arcs[state][s]
            out.append(o)
        return out


def window_transducer(alphabet: list[tuple[int, str]], opener: int, mark: str, reach: int) -> Transducer:
    """Adds ``mark`` to insults and threats up to ``reach`` tokens after an ``opener``."""
    arcs = []
    for left in range(reach + 1):
        row = {}
        for kind, marks in alphabet:
            if kind == opener:
                row[kind, marks] = (reach, (kind, marks))
            else:
                row[kind, marks] = (max(0, left - 1), (kind, marks + mark if left and kind in (INSULT, THREAT) else marks))
        arcs.append(row)
    return Transducer(arcs)


def reported_transducer(alphabet: list[tuple[int, str]]) -> Transducer:
    """Marks what follows a reporting verb, to the clause's end, and what stands in quotation marks."""
    arcs = []
    for state in range(4):  # bit 0: reporting verb seen; bit 1: inside quotation marks
        row = {}
        for kind, marks in alphabet:
            after = state | 1 if kind == REPORT else state ^ 2 if kind == QUOTE else state
            row[kind, marks] = (after, (kind, marks + "r" if state and kind in (INSULT, THREAT) else marks))
        arcs.append(row)
    return Transducer(arcs)


def grammar() -> Transducer:
    """Reads token classes and writes (class, marks); marks are drawn from ``n``, ``r`` and ``t``."""
    kinds = range(7)
    lift = Transducer([{k: (0, (k, "")) for k in kinds}])
    plain = [(k, "") for k in kinds]
    hot = (INSULT, THREAT)
    with_n = plain + [(k, "n") for k in hot]
    with_r = with_n + [(k, m + "r") for k in hot for m in ("", "n")]
    machine = lift.compose(window_transducer(plain, NEGATION, "n", 3))
    machine = machine.compose(reported_transducer(with_n))
    return machine.compose(window_transducer(with_r, TARGET, "t", 3))


def event_of(kind: int, marks: str) -> str | None:
    if kind not in (INSULT, THREAT):
        return None
    name = "insult" if kind == INSULT else "threat"
    how = "negated_" if "n" in marks else "reported_" if "r" in marks else "aimed_" if "t" in marks else ""
    return how + name


@dataclass
class Lexicon:
    """Weights of insult words and stems; a stem may be followed by any letters."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    def weight(self, token: str) -> float:
        best = self.words.get(token, 0.0)
        for n in self.lengths:
            best = max(best, self.stems.get(token[:n], 0.0)) if len(token) >= n else best
        return best

    @property
    def lengths(self) -> list[int]:
        return sorted({len(s) for s in self.stems})


class Matcher:
    """Finds clauses that hold a lexical entry and runs the composed grammar over them."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.machine = lexicon, grammar()
        self.fixed = {w: k for k, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
        self.fixed |= {q: QUOTE for q in '"“”«»„'}
        self.names = list(EVENTS)
        self.trie = ahocorasick.Automaton()
        for entry in {*lexicon.words, *lexicon.stems, *THREATS}:
            self.trie.add_word(entry, len(entry))
        self.trie.make_automaton()
        self.lengths = lexicon.lengths
        self.cache: dict[str, tuple[int, float]] = {}

    def classify(self, token: str) -> tuple[int, float]:
        got = self.cache.get(token)
        if got is None:
            weight = self.lexicon.weight(token)
            got = (INSULT, weight) if weight else (self.fixed.get(token, OTHER), 1.0)
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[token] = got
        return got

    def clause(self, text: str) -> dict[str, float]:
        """Events of one clause and the summed lexical weights of each."""
        classes = [self.classify(t) for t in _TOKEN.findall(text)]
        out: dict[str, float] = defaultdict(float)
        for (kind, marks), (_, weight) in zip(self.machine.run([k for k, _ in classes]), classes):
            if event := event_of(kind, marks):
                out[event] += weight
        return out

    def events(self, text: str | None) -> np.ndarray:
        """ln(1 + weight) of each event over the whole text, in the order of ``EVENTS``."""
        total = np.zeros(len(self.names))
        if text:
            lower = text.lower()
            done, begin, scanned = -1, 0, 0  # no part is searched for a clause's begin twice
            for end, n in self.trie.iter(lower):
                at = end - n + 1
                if at < done or (at and lower[at - 1].isalpha()):
                    continue
                begin = max(begin, max(lower.rfind(c, scanned, at) for c in ".!?;:\n") + 1)
                scanned = at
                found = _CLAUSE.match(lower, begin)
                done = found.end()
                for event, weight in self.clause(found.group()).items():
                    total[self.names.index(event)] += weight
        return np.log1p(total)


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    scale: np.ndarray
    offset: float

    def build(self):
        matcher = Matcher(self.lexicon)

        def call(texts: list[str | None]) -> dict[str, object]:
            x = np.array([matcher.events(t) for t in texts]).reshape(len(texts), len(EVENTS))
            return {"score": sigmoid(x @ self.scale + self.offset), "n_events": (x > 0).sum(axis=1).astype("int64")}

        return call


def candidates(text: str, stem_lengths: tuple[int, ...]) -> set[str]:
    """Distinct words of three letters or more, and their stems marked by an asterisk."""
    words = {w for w in set(_WORD.findall(text.lower())) if len(w) >= 3}
    return words | {w[:n] + "*" for w in words for n in stem_lengths if len(w) >= n}


def greedy_cover(docs: list[list[str]], weight: dict[str, float], support: float, decay: float = 0.6) -> list[str]:
    """Entries in the order of the log-odds that each adds; longer ones win ties.

    A document counts ``decay`` times as much with every entry that it has got, so an entry needs
    documents that others explain little; copies of one document add little besides.
    """
    where: dict[str, list[int]] = defaultdict(list)
    for i, found in enumerate(docs):
        for c in found:
            where[c].append(i)
    need = np.ones(len(docs))
    index = {c: np.array(v) for c, v in where.items()}
    left, chosen = {c: float(len(v)) for c, v in index.items()}, []
    while left:
        best = max(left, key=lambda c: (left[c] * weight[c], len(c), c))
        now = float(need[index[best]].sum())
        if now < left[best] - 1e-9:  # others have explained some since; needs only fall
            left[best] = now
            if now < support:
                del left[best]
            continue
        if now < support:
            break
        chosen.append(best)
        need[index[best]] *= decay
        del left[best]
    return chosen


def fit_scales(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 0.5, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Logistic regression whose ridge penalty draws the scales to ``prior``; scales stay at 0 or more."""
    n = max(1, len(x))
    design = np.column_stack([x, np.ones(len(x))])
    beta = np.append(prior, float(np.log((y.mean() + 0.01) / (1.01 - y.mean()))))
    centre, penalty = np.append(prior, 0.0), np.append(np.full(len(prior), ridge), 1e-4)
    for _ in range(rounds):
        p = sigmoid(design @ beta)
        grad = design.T @ (p - y) + penalty * (beta - centre)
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty) + 1e-9 * n * np.eye(len(beta))
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        beta = beta - step
        beta[:-1] = np.maximum(beta[:-1], 0)
        if abs(step).max() < 1e-6:
            break
    return beta[:-1], float(beta[-1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample: int = 8000,
    support: int = 4,
    ratio: float = 3.0,
    stem_lengths: tuple[int, ...] = (4, 5, 6, 7, 8),
) -> ToxicityModel:
    """Learns the lexicon and the event scales from at most ``sample`` labelled rows."""
    labels = labels.where(F.col(label).isin(0, 1))
    rows = labelled_sample(docs, labels, key, text, label, sample // 2).where(F.col(text).isNotNull())
    rows = rows.withColumn(label, F.col(label).cast("int"))
    n = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if len(n) < 2:
        share = float(n.get(1, 0) > 0)
        return ToxicityModel(Lexicon(), np.zeros(len(EVENTS)), 4.0 * (2 * share - 1))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for t, y in zip(batch[text], batch[label]):
                seen[y].update(candidates(t, stem_lengths))
        names = list(seen[0] | seen[1])
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pd.DataFrame({"c": pd.Series(part, dtype=object), "pos": [seen[1][c] for c in part], "neg": [seen[0][c] for c in part]})

    odds = F.log((F.col("pos") + 0.5) / F.lit(n[1] + 1.0)) - F.log((F.col("neg") + 0.5) / F.lit(n[0] + 1.0))
    counted = (
        rows.select(text, label).mapInPandas(count, "c string, pos long, neg long")
        .groupBy("c").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        .where(F.col("pos") >= support).withColumn("odds", odds).where(F.col("odds") >= ratio)
    )
    weight = {r["c"]: r["odds"] for r in counted.select("c", "odds").collect()}  # bounded by the sample

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"found": [sorted(c for c in candidates(t, stem_lengths) if c in weight) for t in batch[text]]})

    toxic = [r[0] for r in rows.where(F.col(label) == 1).select(text).mapInPandas(present, "found array<string>").collect()]
    chosen = greedy_cover(sorted(toxic), weight, support)
    lexicon = Lexicon({c: weight[c] for c in chosen if c[-1] != "*"}, {c[:-1]: weight[c] for c in chosen if c[-1] == "*"})

    def events(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(lexicon)
        for batch in batches:
            yield pd.DataFrame({"x": [matcher.events(t).tolist() for t in batch[text]], "y": batch[label]})

    got = sorted((r[0], r[1]) for r in rows.select(text, label).mapInPandas(events, "x array<double>, y int").collect())
    scale, offset = fit_scales(np.array([x for x, _ in got]), np.array([float(y) for _, y in got]), np.array(list(EVENTS.values())))
    return ToxicityModel(lexicon, scale, offset)


def score(df: DataFrame, model: ToxicityModel, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep``, score (probability of label 1) and n_events (kinds of event matched)."""
    return map_texts(df, keep, text, "score double, n_events long", model.build)
