"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character 1- to 3-grams of the lower-cased text, log term frequency times inverse
document frequency, scaled to unit length. The classes' weights are trained by follow-the-regularised-
leader with elastic-net penalties (the L1 part makes them sparse); a temperature is then fitted on rows
set aside from training, so that scores are calibrated probabilities.

The classifier is fitted on at most ``MAX_ROWS`` labelled rows, those with the smallest hash of doc_id;
features are counted on the executors and only bounded vectors reach the driver. Prediction reads the
whole text of every row and nothing else of it.

Edge cases: null texts and texts without a letter are ``und`` with score 0; without labelled rows every
text is ``und``; with one language its score is 1; of equally likely languages the first by name is predicted; repeated
rows predict alike, each by itself; null doc_ids are predicted and never trained on; very long texts are counted whole, piece
by piece; an empty table gives no rows; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import functools
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rows that the classifier is fitted on at most; a fifth of them are for the temperature.
MAX_ROWS = 3000
BUCKETS = 1 << 15
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 1e-3, 1e-4
#: Characters counted at a time; longer texts are counted in overlapping pieces.
PIECE = 1 << 20


def counts(text: str) -> np.ndarray:
    """Occurrences of the hashed 1- to 3-grams of the whole text, by bucket."""
    total = None
    lower = text.lower()
    for start in range(0, max(len(lower), 1), PIECE):
        c = np.frombuffer(lower[max(0, start - 2) : start + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        skip = 2 if start else 0
        c1 = c * np.uint32(0x9E3779B1)
        c2 = (c1[:-1] ^ (c1[1:] >> np.uint32(7))) * np.uint32(0x85EBCA6B)
        c3 = (c2[:-1] ^ (c1[2:] >> np.uint32(5))) * np.uint32(0xC2B2AE35)
        grams = np.concatenate([c1[skip:], c2[max(0, skip - 1) :], c3])
        found = np.bincount(grams >> np.uint32(17), minlength=BUCKETS)
        total = found if total is None else total + found
    return total


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (BUCKETS + 1) x languages; the last row is the bias
    temperature: float

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, langs=np.array(self.langs, dtype=str), idf=self.idf, weights=self.weights, t=self.temperature)
        return out.getvalue()

    @staticmethod
    @functools.lru_cache(2)
    def from_bytes(data: bytes) -> Model:
        z = np.load(io.BytesIO(data), allow_pickle=False)
        return Model([str(x) for x in z["langs"]], z["idf"], z["weights"], float(z["t"]))

    @functools.cached_property
    def scoring(self) -> tuple[np.ndarray, np.ndarray]:
        """idf squared, and weights times idf."""
        return (self.idf**2).astype(np.float32), (self.weights[:-1] * self.idf[:, None]).astype(np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        n = counts(text)
        at = np.flatnonzero(n)
        tf = np.log1p(n[at]).astype(np.float32)
        square, scaled = self.scoring
        z = tf @ scaled[at] / max(1e-12, float(np.sqrt(tf * tf @ square[at]))) + self.weights[-1]
        p = softmax(z / self.temperature)
        k = int(np.argmax(p))
        return self.langs[k], float(min(1.0, p[k]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, seed: int = 7) -> np.ndarray:
    """Per-coordinate FTRL-proximal over sparse unit vectors with elastic-net penalties; bias as last coordinate."""
    z, n = np.zeros((BUCKETS + 1, n_langs)), np.zeros((BUCKETS + 1, n_langs))
    rng = np.random.default_rng(seed)

    def weights(at) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for r in rng.permutation(len(rows)):
            at, x, y = rows[r]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            old = n[at]
            n[at] = old + g * g
            z[at] += g - (np.sqrt(n[at]) - np.sqrt(old)) / ALPHA * w
    return weights(np.arange(BUCKETS + 1))


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least log loss, by a search over a fixed grid."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 93))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, trainable: Column, max_rows: int = MAX_ROWS) -> Model:
    """Fits on the labelled rows for which ``trainable`` holds, at most ``max_rows`` of them."""
    usable = docs.where(trainable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = materialize(usable.select("doc_id").orderBy(*order).limit(max_rows).distinct(), "lang-sample")
    rows = usable.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id", "left_semi")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [counts(t) for t in b.column(2).to_pylist()]
            at = [np.flatnonzero(c) for c in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(at, pa.list_(pa.int32())), pa.array([np.log1p(c[a]).astype(np.float32) for c, a in zip(found, at, strict=True)], pa.list_(pa.float32()))],
                ["doc_id", "lang", "at", "tf"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = rows.mapInArrow(vectors, f"doc_id {kind}, lang string, at array<int>, tf array<float>").orderBy(*order, "lang").limit(max_rows).toArrow()
    langs = sorted(set(sample["lang"].to_pylist()))
    if not langs:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS + 1, 0)), 1.0)
    data = [(np.asarray(a.values), np.asarray(t.values, dtype=float), langs.index(g)) for a, t, g in zip(sample["at"], sample["tf"], sample["lang"].to_pylist(), strict=True)]
    df = np.zeros(BUCKETS)
    for at, _, _ in data:
        df[at] += 1
    idf = np.log((1 + len(data)) / (1 + df)) + 1
    unit = [(at, (x := tf * idf[at]) / max(1e-12, np.linalg.norm(x)), y) for at, tf, y in data]
    aside = unit[::5] if len(unit) >= 10 else unit
    weights = ftrl([r for k, r in enumerate(unit) if k % 5 or len(unit) < 10], len(langs))
    logits = np.array([x @ weights[at] + weights[-1] for at, x, _ in aside])
    return Model(langs, idf, weights, fit_temperature(logits, np.array([y for *_, y in aside])))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, lang_pred, score. Reads text only."""
    data = docs.sparkSession.sparkContext.broadcast(model.to_bytes())  # bounded by the number of buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.from_bytes(data.value)
        for b in batches:
            out = [m.predict(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
