"""Language identification by nearest centroid.

A text becomes a vector of hashed byte n-grams (orders 1 to 3 of the lower-cased text, runs
of anything but letters read as one blank), weighted 1 + ln(tf) times a smoothed inverse
document frequency and scaled to length one.  The training vectors of each language are
clustered by spherical k-means, so that a language may have several centroids (registers,
scripts, code-switching).  A text gets the language of the centroid of largest cosine; it is
also *rejected* when its distance exceeds the radius that the training vectors of that
centroid reach at a given quantile, times a slack.

Document frequencies are counted over all training rows; clusters are fitted on at most
``sample_per_lang`` rows of each language, chosen by a hash of the key.

Defined results: a null text, or one without any letter, is ``und`` with score 0; ties go to
the language that sorts first; repeated rows get equal rows; an empty training set makes
every row ``und``; columns besides the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, map_texts, slices

UNDETERMINED = "und"
_BLANKED = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], dtype=np.uint8)


def ngram_counts(text: str, bits: int = 12, orders: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """Counts of the byte n-grams of a text, hashed to ``2 ** bits`` cells."""
    b = _BLANKED[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)]
    solid = b != 32
    b = b[solid | np.concatenate(([True], solid[:-1]))].astype(np.uint32)
    out = np.zeros(1 << bits, dtype=np.int64)
    gram = b
    for n in range(1, max(orders) + 1):
        if n > 1:
            if len(b) < n:
                break
            gram = gram[:-1] * np.uint32(257) + b[n - 1 :]
        if n in orders:
            cell = ((gram + np.uint32(n * 0x51ED27)) * np.uint32(2654435761)) >> np.uint32(32 - bits)
            out += np.bincount(cell, minlength=1 << bits)
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class CentroidModel:
    """Clustered centroids; row ``i`` of ``centroids`` belongs to ``langs[i]``."""

    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    radius: np.ndarray
    bits: int
    orders: tuple[int, ...]

    def vectors(self, texts: list[str]) -> np.ndarray:
        return weighted(np.stack([ngram_counts(t, self.bits, self.orders) for t in texts]), self.idf)

    def predict(self, texts: list[str | None]) -> dict[str, object]:
        n = len(texts)
        lang, score, rejected = [UNDETERMINED] * n, np.zeros(n), np.ones(n, dtype=bool)
        known = [i for i, t in enumerate(texts) if has_letter(t)]
        if known and len(self.langs):
            cosine = self.vectors([texts[i] for i in known]) @ self.centroids.T
            best = cosine.argmax(axis=1)
            top = np.clip(cosine[np.arange(len(known)), best], 0, 1)
            for i, k, c in zip(known, best, top):
                lang[i], score[i], rejected[i] = self.langs[k], float(c), bool(1 - c > self.radius[k])
        return {"lang_pred": lang, "score": score, "rejected": rejected}


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """1 + ln(tf) times idf, scaled to length one; all-zero rows stay zero."""
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and assignment; seeds are the farthest points from those before, so no chance enters."""
    mean = x.mean(axis=0)
    seeds = [int(np.argmax(x @ mean))]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        far = int(np.argmin(near))
        if near[far] > 1 - 1e-6:
            break
        seeds.append(far)
        near = np.maximum(near, x @ x[far])
    centers, owner = x[seeds].copy(), np.zeros(len(x), dtype=int)
    for step in range(rounds):
        now = (x @ centers.T).argmax(axis=1)
        if step and (now == owner).all():
            break
        owner = now
        for j in range(len(centers)):
            if (owner == j).any():
                centers[j] = x[owner == j].sum(axis=0)
                centers[j] /= max(np.linalg.norm(centers[j]), 1e-12)
    return centers, owner


def fit(
    train: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    clusters: int = 4,
    sample_per_lang: int = 600,
    bits: int = 12,
    orders: tuple[int, ...] = (1, 2, 3),
    quantile: float = 0.999,
    slack: float = 1.25,
) -> CentroidModel:
    """Fits centroids on rows with a label and a text that has a letter."""
    rows = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(key, text, lang)
    dim = 1 << bits

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(dim, dtype=np.int64), 0
        for batch in batches:
            for t in batch[text]:
                df += ngram_counts(t, bits, orders) > 0
                n += 1
        cells = np.flatnonzero(df)
        yield pd.DataFrame({"cell": np.append(cells, -1), "df": np.append(df[cells], n)})

    counted = rows.select(text).mapInPandas(count, "cell int, df long").groupBy("cell").agg(F.sum("df").alias("df"))
    found = {r["cell"]: r["df"] for r in counted.collect()}  # at most 2 ** bits + 1 rows
    n = found.pop(-1, 0)
    df = np.zeros(dim)
    df[list(found)] = list(found.values())
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def vectorize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for piece in slices(batch, text):
                lettered = piece[[has_letter(t) for t in piece[text]]]
                if len(lettered):
                    x = weighted(np.stack([ngram_counts(t, bits, orders) for t in lettered[text]]), idf)
                    yield pd.DataFrame({key: lettered[key], lang: lettered[lang], "x": [v.astype(np.float16).tobytes() for v in x]})

    sample = labelled_sample(rows, rows, key, text, lang, sample_per_lang)
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, {lang} string, x binary"
    got = sorted(sample.mapInPandas(vectorize, schema).collect(), key=lambda r: (r[1], str(r[0])))
    centroids, langs, radius = [], [], []
    for name in sorted({r[1] for r in got}):
        x = np.stack([np.frombuffer(r[2], dtype=np.float16) for r in got if r[1] == name]).astype(np.float32)
        centers, owner = spherical_kmeans(x, clusters)
        for j, c in enumerate(centers):
            if (owner == j).any():
                centroids.append(c)
                langs.append(name)
                radius.append(min(1.0, slack * float(np.quantile(1 - x[owner == j] @ c, quantile))))
    return CentroidModel(idf, np.array(centroids, dtype=np.float32).reshape(-1, dim), langs, np.array(radius), bits, orders)


def identify(df: DataFrame, model: CentroidModel, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep``, then lang_pred, score (cosine, 0 to 1) and rejected."""
    return map_texts(df, keep, text, "lang_pred string, score double, rejected boolean", lambda: model.predict)
