"""Toxicity: a counterfactual-regularised logistic classifier.

Features are the words of a text and the 4 and 5 letter pieces of its words, their
ends marked, present or absent anywhere in the whole text; so a word that no
learning row holds is known by its parts. All features that speak for or against
label 1 beyond three standard errors, in a bounded sample of labelled rows, are
kept. The weights minimise logistic loss, a ridge term, and the squared score change
under identity swaps: in all labelled sentences that mention a group, the term is
swapped for the others of its group, and every group's terms are swapped in a
neutral sentence besides. So mentioning one group rather than another, or rather
than ``people``, moves no score.

Scores are shifted so that ``THRESHOLD`` lies where the learning rows part best. Cases: a null or empty text has no feature and gets the model's base
score; rows with null ids or labels, labels other than 0 and 1, or contradicting
labels teach nothing; if either label is missing, all scores are 0. Repeated rows
count each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy

#: Labelled rows to learn from, rows a feature needs, and the standard errors by
#: which it has to speak.
LEARN_ROWS, LEAST_ROWS, ERRORS = 6_000, 3, 3.0
#: Most steps of the solver, and within each of them.
NEWTON_STEPS, CG_STEPS = 15, 40
#: Weight of a swap's squared score change, ridge, score from which it is toxic.
SWAP_PENALTY, RIDGE, THRESHOLD = 10.0, 0.5, 0.7
#: Distinct features a task counts before it hands them on, words whose features it
#: remembers while it learns, and words that a model remembers while it scores
#: (nearly all of them without a kept feature, which all share one empty set).
COUNT_CACHE, WORD_CACHE, SCORE_CACHE = 400_000, 50_000, 250_000
_NONE: frozenset[int] = frozenset()

#: Groups of terms that may stand for one another; the first is the neutral one.
IDENTITY_GROUPS = [
    ["people", "women", "men", "girls", "boys", "transgender", "nonbinary"],
    ["people", "gay", "lesbian", "straight", "bisexual", "queer", "homosexual", "heterosexual"],
    ["people", "muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "catholics", "atheists"],
    ["person", "muslim", "christian", "jew", "jewish", "hindu", "buddhist", "sikh", "catholic", "atheist"],
    ["people", "black", "white", "asian", "african", "latino", "hispanic", "arab", "indian", "european"],
    ["people", "immigrants", "refugees", "migrants", "foreigners", "natives", "citizens"],
    ["people", "disabled", "blind", "deaf", "autistic", "old", "young", "elderly"],
    ["person", "woman", "man", "girl", "boy", "immigrant", "refugee", "foreigner"],
]

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?\n])\s+")


@functools.lru_cache(WORD_CACHE)
def word_features(word: str) -> tuple[str, ...]:
    """The word, and the pieces of ``<word>``."""
    marked = f"<{word}>"
    return (word, *{f"~{marked[i : i + n]}" for n in (4, 5) for i in range(len(marked) - n + 1)})


def features(text: str | None) -> set[str]:
    return {f for w in set(_WORD.findall((text or "").lower())) for f in word_features(w)}


class Model:
    def __init__(self, index: dict[str, int], weight: np.ndarray, base: float):
        self.index, self.weight, self.base = index, weight, base
        self.known: dict[str, frozenset[int]] = {}

    def __reduce__(self):
        return Model, (self.index, self.weight, self.base)

    def of_word(self, word: str) -> frozenset[int]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= SCORE_CACHE:
                self.known.clear()
            marked, index = f"<{word}>", self.index
            kept = {index[word]} if word in index else set()
            for n in (4, 5):
                for i in range(len(marked) - n + 1):
                    if (f := index.get("~" + marked[i : i + n])) is not None:
                        kept.add(f)
            found = self.known[word] = frozenset(kept) or _NONE
        return found

    def score(self, text: str | None) -> float:
        if not len(self.weight):
            return 0.0
        held: set[int] = set()
        known, words = self.known, set(_WORD.findall((text or "").lower()))
        for w in words:
            found = known.get(w)
            if found is None:
                found = self.of_word(w)
            if found:
                held |= found
        z = self.base + float(self.weight[sorted(held)].sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z + _EDGE))))


#: A text on the dividing point (z = 0) gets just less than the threshold.
_EDGE = math.log(THRESHOLD / (1 - THRESHOLD)) - 1e-6


def informative_features(sample: DataFrame) -> list[str]:
    """All features whose log-odds ratio for label 1 is beyond ``ERRORS`` standard errors."""
    rows = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = rows.get(0, 0), rows.get(1, 0)
    if not n0 or not n1:
        return []

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = sorted(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in seen)], names=["f", "n0", "n1"]
            )
            seen[0].clear(), seen[1].clear()
            return out

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                seen[label.as_py()].update(features(text.as_py()))
                if len(seen[0]) + len(seen[1]) > COUNT_CACHE:
                    yield flush()
        yield flush()

    a1, a0 = F.col("n1") + 0.5, F.col("n0") + 0.5
    b1, b0 = F.lit(n1 + 0.5) - F.col("n1"), F.lit(n0 + 0.5) - F.col("n0")
    ratio = F.log(a1) - F.log(b1) - F.log(a0) + F.log(b0)
    error = F.sqrt(1 / a1 + 1 / a0 + 1 / b1 + 1 / b0)
    top = (
        sample.select("text", "label")
        .mapInArrow(run, "f string, n0 long, n1 long")
        .groupBy("f")
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .where(F.col("n0") + F.col("n1") >= LEAST_ROWS)
        .where(F.abs(ratio) > ERRORS * error)
    )
    return sorted(r.f for r in top.select("f").collect())


Swap = tuple[tuple[int, int], ...]


def swap_differences(sentences: Iterable[str], index: dict[str, int]) -> set[Swap]:
    """Distinct feature differences, (feature, +1 or -1), between sentences and
    their identity-swapped forms."""
    partners: dict[str, set[str]] = {}
    for group in IDENTITY_GROUPS:
        for term in group:
            partners.setdefault(term, set()).update(x for x in group if x != term)
    rows: set[Swap] = set()
    for sentence in sentences:
        low = sentence.lower()
        before = features(low)
        for term in sorted(before & partners.keys()):
            for other in sorted(partners[term]):
                after = features(re.sub(rf"\b{term}\b", other, low))
                gone = [(index[f], 1) for f in before - after if f in index]
                if diff := gone + [(index[f], -1) for f in after - before if f in index]:
                    rows.add(tuple(sorted(diff)))
    return rows


def neutral_sentences() -> list[str]:
    return [f"they are {term} here" for term in sorted({t for g in IDENTITY_GROUPS for t in g})]


class Sparse:
    """Entries (row, column, value), by row; products with vectors take time with
    them. ``value`` is None where all are one. Indices have 32 bits."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray | None, shape: tuple[int, int]):
        self.row, self.column = row.astype(np.int32, copy=False), column.astype(np.int32, copy=False)
        self.value, self.shape = value, shape
        order = np.argsort(self.column, kind="stable")
        self.rows_by_column = self.row[order]
        self.values_by_column = None if value is None else value[order]
        held = np.bincount(self.row, minlength=shape[0]), np.bincount(self.column, minlength=shape[1])
        self.filled = [np.flatnonzero(h) for h in held]
        self.starts = [(np.cumsum(h) - h)[f] for h, f in zip(held, self.filled, strict=True)]

    @classmethod
    def of(cls, rows: Iterable[Iterable[tuple[int, float]]], width: int) -> Sparse:
        rows = [list(r) for r in rows]
        flat = [x for r in rows for x in r]
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        return cls(row, np.array([c for c, _ in flat], np.int64), np.array([v for _, v in flat], np.float64), (len(rows), width))

    def merged(self, apart: np.ndarray) -> tuple[Sparse, np.ndarray]:
        """Columns that stand in the same rows as one column, those in ``apart`` but
        for themselves; and each column's new number."""
        draws = np.random.default_rng(5).integers(1, 1 << 63, self.shape[0], dtype=np.uint64)
        mark = np.zeros(self.shape[1], np.uint64)
        np.add.at(mark, self.column, draws[self.row])
        mark[apart] = np.arange(len(apart), dtype=np.uint64)  # sums of draws aren't that small
        _, first, number = np.unique(mark, return_index=True, return_inverse=True)
        keep = first[number[self.column]] == self.column
        shape = (self.shape[0], len(first))
        value = None if self.value is None else self.value[keep]
        return Sparse(self.row[keep], number[self.column[keep]], value, shape), number

    def _summed(self, side: int, terms: np.ndarray, values: np.ndarray | None) -> np.ndarray:
        out = np.zeros(self.shape[side])
        if len(terms):
            out[self.filled[side]] = np.add.reduceat(terms if values is None else terms * values, self.starts[side])
        return out

    def dot(self, v: np.ndarray) -> np.ndarray:
        return self._summed(0, v[self.column], self.value)

    def back(self, r: np.ndarray) -> np.ndarray:
        return self._summed(1, r[self.rows_by_column], self.values_by_column)


def _solved(product, right: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Conjugate gradients with a diagonal scale."""
    x, r = np.zeros_like(right), right.copy()
    z = r / scale
    p, rz = z.copy(), float(r @ z)
    for _ in range(CG_STEPS):
        if np.abs(r).max() <= 1e-3 * np.abs(right).max():
            break
        q = product(p)
        step = rz / float(p @ q)
        x += step * p
        r -= step * q
        z = r / scale
        rz, old = float(r @ z), rz
        p = z + rz / old * p
    return x


def fit_weights(x: Sparse, y: np.ndarray, d: Sparse) -> tuple[np.ndarray, float]:
    """Newton's method on logistic loss with balanced labels, ridge and swaps; its
    steps by conjugate gradients, so that no matrix of all features is made.

    Equal columns get equal weights, so m of them are fitted as one with an m-th of
    the ridge, which then is dealt out.
    """
    x, number = x.merged(np.unique(d.column))
    d = Sparse(d.row, number[d.column], d.value, (d.shape[0], x.shape[1]))
    members = np.bincount(number, minlength=x.shape[1])
    n, k = x.shape
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * n
    ridge = np.append(RIDGE / members, 1e-6)

    def fixed(v: np.ndarray) -> np.ndarray:
        return ridge * v + np.append(SWAP_PENALTY * d.back(d.dot(v[:k])), 0.0)

    def forward(v: np.ndarray) -> np.ndarray:
        return x.dot(v[:k]) + v[k]

    def backward(r: np.ndarray) -> np.ndarray:
        return np.append(x.back(r), r.sum())

    swap_scale = SWAP_PENALTY * np.bincount(d.column, minlength=k)  # all values are 1 or -1
    w = np.zeros(k + 1)
    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + np.exp(-np.clip(forward(w), -30, 30)))
        curve = share * p * (1 - p) + 1e-9
        scale = ridge + np.append(x.back(curve) + swap_scale, curve.sum())
        step = _solved(lambda v, c=curve: fixed(v) + backward(c * forward(v)), fixed(w) + backward(share * (p - y)), scale)
        w -= step
        if np.abs(step).max() < 1e-3:
            break
    return (w[:k] / members)[number], float(w[k])


def dividing_point(z: np.ndarray, y: np.ndarray) -> float:
    """Where the labels part with the fewest errors per label; of equally good
    points the middle one."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    below = np.cumsum(1 - y)[:-1] / (1 - y).sum() - np.cumsum(y)[:-1] / y.sum()
    below = np.where(z[1:] > z[:-1], below, -np.inf)
    if not np.isfinite(below).any():
        return 0.0
    best = np.flatnonzero(below >= below.max() - 1e-12)
    at = best[len(best) // 2]
    return float((z[at] + z[at + 1]) / 2)


def fit(sample: DataFrame) -> Model:
    """Model of a bounded sample (text, label); the driver gets, of each row, the
    kept features, and the distinct swap differences of all its sentences."""
    sample = materialize(sample)
    terms = {t for g in IDENTITY_GROUPS for t in g}
    names = sorted({*informative_features(sample), *terms})
    index = {f: i for i, f in enumerate(names)}

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, swapped = [], []
            for text in batch.column(0):
                found = features(text.as_py())
                held.append(sorted(index[f] for f in found if f in index))
                said = _SENTENCE.split(text.as_py() or "") if found & terms else []
                diffs = swap_differences((s for s in said if features(s) & terms), index)
                swapped.append([[c if v > 0 else -1 - c for c, v in diff] for diff in sorted(diffs)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(held, pa.list_(pa.int32())), pa.array(swapped, pa.list_(pa.list_(pa.int32()))), batch.column(1)],
                names=["held", "swapped", "label"],
            )

    seen = materialize(sample.select("text", "label").mapInArrow(run, "held array<int>, swapped array<array<int>>, label int"))
    rows = seen.select("held", "label").orderBy(F.xxhash64("held", "label")).toArrow()  # whatever the order of tasks
    y = rows["label"].to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        return Model({}, np.zeros(0), 0.0)
    held = rows["held"].combine_chunks()
    row = np.repeat(np.arange(len(y), dtype=np.int32), held.value_lengths().to_numpy())
    x = Sparse(row, held.flatten().to_numpy(), None, (len(y), len(names)))
    diffs = seen.select(F.explode("swapped").alias("d")).distinct().collect()
    swaps = swap_differences(neutral_sentences(), index) | {tuple((c, 1) if c >= 0 else (-1 - c, -1) for c in r.d) for r in diffs}
    weight, base = fit_weights(x, y, Sparse.of(sorted(swaps), len(names)))
    return Model(index, weight, base - dividing_point(x.dot(weight) + base, y))


def toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Score of every whole text, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    @tidy
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return scored(F.col(text_col))
