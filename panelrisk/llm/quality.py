"""Quality: Bradley-Terry pairwise ranking with a quantile threshold.

A text's measures (character classes, word shapes, repetition of words, word
pairs and lines) are spread over piecewise-linear features. Every row labelled 1
is preferred to every row labelled 0; weights minimise the logistic loss of the
feature differences of such pairs. A text's strength is its weighted sum. The
threshold is a quantile of the strengths of all documents: of their quantiles in
steps of 1 / ``LEVELS``, the one that parts the learning rows' labels best; scores
are strengths on a logistic scale on which the threshold lies at 0.7. The weights
alone come from a bounded sample, the quantiles from every document.

Cases: null and empty texts have all-zero measures and are scored as such. Rows
with null ids or labels, other labels, or contradicting labels teach nothing;
without a pair to learn from every score is 0.7 (nothing is rejected). Repeated
rows count each; other columns are ignored; an empty table gives no rows, and a
model whose documents are none keeps the threshold of its learning rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy

#: Labelled rows to learn from, preference pairs drawn, ridge.
LEARN_ROWS, PAIRS, RIDGE = 12_000, 120_000, 1.0
THRESHOLD = 0.7
#: Quantiles of all documents' strengths that the threshold is chosen from.
LEVELS = 2000
#: Quantiles of each measure at which a piecewise-linear feature bends.
BENDS = (0.02, 0.1, 0.5, 0.9, 0.98)

_UPPER, _LOWER, _DIGIT = range(65, 91), range(97, 123), range(48, 58)
_MARKS = b".,;:'\"()?-"
_CLASS = np.full(256, 5, np.int64)  # other symbols
for _kind, _bytes_of in enumerate((_UPPER, _LOWER, _DIGIT, _MARKS, range(9, 33))):
    _CLASS[list(_bytes_of)] = _kind
_CLASS[32] = 4
_CLASS[128:] = 6  # parts of characters beyond ASCII
_CLASS[ord("!")] = 7
_CLASS[ord("|")] = 8


def measures(text: str | None) -> list[float]:
    """Measures of a whole text; all zero for one without words."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 17
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_CLASS, np.bincount(data, minlength=256), 9)
    size = len(data)
    letters = max(1.0, kinds[0] + kinds[1] + kinds[6])
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lengths = np.fromiter(map(len, words), np.int64, n)
    return [
        math.log1p(n),
        float(lengths.mean()),
        float(lengths.std()),
        float((lengths == 1).mean()),
        kinds[0] / letters,
        kinds[2] / size,
        kinds[3] / n,
        kinds[5] / size,
        kinds[7] / n,
        kinds[8] / n,
        kinds[4] / size,
        len(counts) / n,
        len(counts) / math.sqrt(n),
        max(counts.values()) / n,
        pairs / max(1, n - 1),
        repeated / max(1, n - 1),
        len(set(lines)) / max(1, len(lines)),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    bends: np.ndarray  # (measures, bends)
    weight: np.ndarray
    edge: float = 0.0
    spread: float = 1.0
    level: float | None = None  # share of all documents below the edge
    learnt: tuple[np.ndarray, np.ndarray] | None = None  # the learning rows' strengths and labels

    def expand(self, m: np.ndarray) -> np.ndarray:
        """Standardised measures, clipped, and their parts beyond each bend."""
        z = np.clip((m - self.mean) / self.scale, -8, 8)
        return np.hstack([z, np.maximum(0, z[:, :, None] - self.bends).reshape(len(z), -1)])

    def strength(self, m: np.ndarray) -> np.ndarray:
        return self.expand(m) @ self.weight

    def score(self, m: np.ndarray) -> np.ndarray:
        if not len(self.weight):
            return np.full(len(m), THRESHOLD)
        z = (self.strength(m) - self.edge) / self.spread
        return 1 / (1 + np.exp(-np.clip(z + math.log(THRESHOLD / (1 - THRESHOLD)), -30, 30)))


def fit_pairs(x: np.ndarray, better: np.ndarray, worse: np.ndarray) -> np.ndarray:
    """Bradley-Terry weights: Newton's method on log(1 + exp(-w.(x[better] -
    x[worse]))), the pairs taken in blocks."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        grad, hess = RIDGE * w, RIDGE * np.eye(len(w))
        for a in range(0, len(better), 4096):
            d = x[better[a : a + 4096]] - x[worse[a : a + 4096]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            grad -= d.T @ p
            hess += (d * (p * (1 - p) + 1e-9)[:, None]).T @ d
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def best_quantile(edges: np.ndarray, strength: np.ndarray, y: np.ndarray) -> int:
    """Which of the ascending ``edges`` parts the labelled strengths with the
    fewest errors per label (below it label 0); of equal ones the middle."""
    good, bad = np.sort(strength[y == 1]), np.sort(strength[y == 0])
    gain = np.searchsorted(bad, edges) / len(bad) - np.searchsorted(good, edges) / len(good)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return int(best[len(best) // 2])


def fit(sample: DataFrame, seed: int = 11) -> Model:
    """Model of a bounded sample (text, label); the driver gets its measures."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [measures(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.list_(pa.float64())), batch.column(1)], names=["m", "label"])

    rows = sample.select("text", "label").mapInArrow(run, "m array<double>, label int").collect()
    y = np.array([r.label for r in rows], np.int64)
    if not len(y) or y.min() == y.max():
        zero = np.zeros(0)
        return Model(zero, zero, zero, zero)
    rows = sorted(((tuple(r.m), r.label) for r in rows))  # the drawn pairs don't depend on the order of tasks
    m, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    mean, scale = m.mean(axis=0), m.std(axis=0) + 1e-9
    bends = np.quantile(np.clip((m - mean) / scale, -8, 8), BENDS, axis=0).T[None]
    model = Model(mean, scale, bends, np.zeros(0))
    x = model.expand(m)
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    n = min(PAIRS, len(good) * len(bad))
    model.weight = fit_pairs(x, rng.choice(good, n), rng.choice(bad, n))
    model.learnt = (model.strength(m), y)
    return _at_edge(model, np.sort(model.learnt[0]))


def _at_edge(model: Model, quantiles: np.ndarray) -> Model:
    """The model with its edge at the least of ``quantiles`` or midway between two."""
    edges = np.append(quantiles[:1], (quantiles[1:] + quantiles[:-1]) / 2)
    at = best_quantile(edges, *model.learnt)
    edge = float(edges[at])
    spread = max(1e-6, float(np.abs(model.learnt[0] - edge).mean()) / 2)
    return replace(model, edge=edge, spread=spread, level=at / max(1, len(edges) - 1))


def strengths(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Strength of every whole text (0 where nothing was learnt)."""
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, learnt=None))

    @F.pandas_udf("double")
    @tidy
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            m = np.array([measures(t) for t in texts]).reshape(len(texts), -1)
            found = shared.value.strength(m) if len(m) and len(shared.value.weight) else np.zeros(len(texts))
            yield pd.Series(found, dtype="float64")

    return measured(F.col(text_col))


def with_threshold(model: Model, strength: DataFrame) -> Model:
    """The model with its threshold at a quantile of all ``strength.strength``.

    The quantiles are one mergeable aggregate; the driver gets ``LEVELS`` numbers.
    """
    if not len(model.weight):
        return model
    levels = ", ".join(f"{i / LEVELS}D" for i in range(LEVELS + 1))
    quantiles = strength.agg(F.expr(f"percentile_approx(strength, array({levels}), {10 * LEVELS})").alias("q")).first().q
    return _at_edge(model, np.array(quantiles)) if quantiles else model


def score_of(strength: Column, model: Model) -> Column:
    """Scores, 0 to 1, of strengths: 0.7 at the model's threshold."""
    if not len(model.weight):
        return F.lit(THRESHOLD)
    z = (strength - F.lit(model.edge)) / F.lit(model.spread) + F.lit(math.log(THRESHOLD / (1 - THRESHOLD)))
    # At the edge itself the logistic may fall short of 0.7 by its rounding.
    return F.when(strength == model.edge, F.lit(THRESHOLD)).otherwise(1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document; each text is measured once, for the
    quantiles and the scores."""
    rows = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), strengths(docs, model, text_col).alias("strength")))
    return rows.select("doc_id", score_of(F.col("strength"), with_threshold(model, rows)).alias("score"))


def quality(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Score of every whole text, 0 to 1, by a model that has its threshold."""
    return score_of(strengths(docs, model, text_col), model)
