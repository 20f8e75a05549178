"""Quality classification by a linear hinge-loss model over Naive Bayes scaled indicators.

A text becomes a set of n-gram indicators, hashed to ``2 ** bits`` cells:

* n-grams of orders 1 to 4 over runs of character classes.  Letters are lower case, upper
  case or capitalised words by their bytes, digits are one class, every other ASCII character
  is its own, and a run carries its length up to three (for all but letters and digits);
* the same n-grams with all printable ASCII characters but letters and digits as one class, so that what is
  learned of one sign holds for others;
* n-grams of orders 1 to 4 over the repetition marks of words: whether a word equals the one
  before it or the one two before it.

Each cell is scaled by the log-count ratio of the two classes, with add-``alpha`` smoothing,
a text's scaled vector is brought to unit length, so that it is judged by the evidence it has and not by how
much it has, and a linear model with hinge loss is fitted on these vectors by dual coordinate descent.
Its margins become probabilities by a one-dimensional logistic fit on the training margins.

Learning uses at most ``sample`` labelled rows (the bound is a parameter), half for each
class where there are so many, chosen by a hash of the key.

Defined results: null and empty texts have no indicators but the bias and are scored all the
same; ties and repeated rows get equal scores; without labels of both classes every score is
the share of label 1, or 0.5 without labels; columns besides the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, labelled_sample, map_texts, sigmoid, slices, word_hashes

_CLASS = np.array([1 if 97 <= b <= 122 or b >= 128 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4 if b in SPACE_BYTES and b != 10 else b + 5 for b in range(256)], dtype=np.uint32)


#: The same with one class for all signs.
_COARSE = np.array([5 if 33 <= b <= 126 and c > 4 else c for b, c in enumerate(_CLASS)], dtype=np.uint32)


def _hashed(code: np.ndarray, order: int, bits: int, space: int) -> np.ndarray:
    gram = code[: len(code) - order + 1]
    for i in range(1, order):
        gram = gram * np.uint32(0x01000193) + code[i : len(code) - order + 1 + i]
    return ((gram + np.uint32(space * 0x9E37 + order * 0x51ED27)) * np.uint32(2654435761)) >> np.uint32(32 - bits)


def indicators(text: str | None, bits: int) -> np.ndarray:
    """Sorted cells that a text sets."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.int64)
    out = []
    for space, classes in ((1, _CLASS), (3, _COARSE)):
        kind = classes[raw]
        starts = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
        length = np.diff(np.append(starts, len(raw)))
        code = kind[starts] * np.uint32(4) + np.where(kind[starts] <= 3, 0, np.minimum(length, 3)).astype(np.uint32)
        out += [_hashed(code, n, bits, space) for n in (1, 2, 3, 4) if len(code) >= n]
    word = word_hashes(raw.tobytes())
    if len(word):
        mark = np.zeros(len(word), dtype=np.uint32)
        mark[1:] += (word[1:] == word[:-1]).astype(np.uint32)
        mark[2:] += np.uint32(2) * (word[2:] == word[:-2]).astype(np.uint32)
        out += [_hashed(mark, n, bits, 2) for n in (1, 2, 3, 4) if len(mark) >= n]
    seen = np.zeros(1 << bits, dtype=bool)
    for cells in out:
        seen[cells] = True
    return np.flatnonzero(seen)


@dataclass
class HingeModel:
    """``weight`` already holds the log-count ratios, ``square`` their squares; slope and offset map margins to log-odds."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    offset: float
    bits: int

    def margin(self, cells: np.ndarray) -> float:
        return float(self.weight[cells].sum() * inverse_length(self.square, cells)) + self.bias

    def scores(self, texts: list[str | None]) -> dict[str, object]:
        m = np.array([self.margin(indicators(t, self.bits)) for t in texts])
        return {"score": sigmoid(self.slope * m + self.offset)}


def inverse_length(square: np.ndarray, cells: np.ndarray) -> float:
    """One over the length of the scaled vector; 0 for a vector of zeros."""
    total = float(square[cells].sum())
    return total**-0.5 if total > 0 else 0.0


def log_count_ratio(x: list[np.ndarray], y: np.ndarray, dim: int, alpha: float) -> np.ndarray:
    p, q = np.full(dim, alpha), np.full(dim, alpha)
    for cells, label in zip(x, y):
        (p if label > 0 else q)[cells] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(
    x: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float, epochs: int, tolerance: float = 1e-3, seed: int = 7, factor: np.ndarray | None = None
) -> tuple[np.ndarray, float]:
    """Minimises |w|^2 / 2 + cost * sum of hinge losses over the rows scaled by ``scale``, and each row by its ``factor``.

    One dual variable per row, clipped to [0, cost]; the bias is a constant feature of one.
    """
    w, bias = np.zeros(len(scale)), 0.0
    value = [scale[c] if factor is None else scale[c] * factor[i] for i, c in enumerate(x)]
    square = np.array([float(v @ v) + 1 for v in value])
    alpha, random = np.zeros(len(x)), np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in random.permutation(len(x)):
            slope = y[i] * (float(w[x[i]] @ value[i]) + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[x[i]] += step * value[i]
                bias += step
                worst = max(worst, abs(step) * square[i] ** 0.5)
        if worst < tolerance:
            break
    return w, bias


def logistic_1d(m: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of P(y = 1) by Newton steps on smoothed targets (as in Platt scaling)."""
    pos, neg = max(1, int((y > 0).sum())), max(1, int((y <= 0).sum()))
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * m + b)
        g = np.array([((p - target) * m).sum() + 1e-6 * a, (p - target).sum()])
        h = p * (1 - p)
        hess = np.array([[(h * m * m).sum() + 1e-6, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, g)
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
        if abs(step).max() < 1e-9:
            break
    return a, b


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample: int = 8000,
    bits: int = 13,
    alpha: float = 1.0,
    cost: float = 1.0,
    epochs: int = 20,
) -> HingeModel:
    """Fits on at most ``sample`` rows with label 0 or 1."""
    dim = 1 << bits
    labels = labels.where(F.col(label).isin(0, 1))
    rows = labelled_sample(docs, labels, key, text, label, sample // 2)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for piece in slices(batch, text):
                packed = []
                for t in piece[text]:
                    bit = np.zeros(dim, dtype=bool)
                    bit[indicators(t, bits)] = True
                    packed.append(np.packbits(bit).tobytes())
                yield pd.DataFrame({key: piece[key], label: piece[label], "x": packed})

    schema = f"{key} {rows.schema[key].dataType.simpleString()}, {label} int, x binary"
    got = sorted(rows.withColumn(label, F.col(label).cast("int")).mapInPandas(pack, schema).collect(), key=lambda r: (str(r[0]), r[1], r[2]))
    x = [np.flatnonzero(np.unpackbits(np.frombuffer(r[2], dtype=np.uint8))) for r in got]
    y = np.array([1 if r[1] == 1 else -1 for r in got])
    if len(set(y.tolist())) < 2:
        share = float((y > 0).mean()) if len(y) else 0.5
        odds = float(np.log((share + 1e-3) / (1 - share + 1e-3))) if len(y) else 0.0
        return HingeModel(np.zeros(dim), np.zeros(dim), 0.0, 1.0, odds, bits)
    ratio = log_count_ratio(x, y, dim, alpha)
    square = ratio * ratio
    factor = np.array([inverse_length(square, c) for c in x])
    w, bias = dual_coordinate_descent(x, y, ratio, cost, epochs, factor=factor)
    model = HingeModel(w * ratio, square, bias, 1.0, 0.0, bits)
    model.slope, model.offset = logistic_1d(np.array([model.margin(c) for c in x]), y)
    model.slope = max(model.slope, 1e-6)
    return model


def score(df: DataFrame, model: HingeModel, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and score, the probability of label 1."""
    return map_texts(df, keep, text, "score double", lambda: model.scores)
