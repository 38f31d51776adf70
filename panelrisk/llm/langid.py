"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, every run of non-letters becomes one blank, and its n-grams
(1 to ``MAX_N`` characters) are hashed into ``BUCKETS``. Counts per language come
from a bounded, documented sample of the labelled rows, each of whole texts; the
(bucket, language) matrix of log-probabilities is broadcast. A batch is scored
sparsely: the matrix rows of the n-grams that occur are gathered and summed text
by text, in blocks of bounded size, so long texts need no more memory.

Cases: a null text, or one without a letter, is ``und`` with score 0. Rows with a
null id or a null language teach nothing. Equal scores go to the language that
sorts first. With nothing to learn from every text is ``und``. Repeated rows
count each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drawn_share, tidy

BUCKETS, MAX_N = 1 << 15, 3
#: Labelled rows drawn of each language, about.
ROWS_PER_LANGUAGE = 4000
#: Add-alpha smoothing; characters scored at once.
ALPHA, SPAN = 0.1, 1 << 19

UNKNOWN = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        table = np.zeros(0x110000, bool)
        table[[c for c in range(0x110000) if chr(c).isalpha()]] = True
        _LETTER.append(table)
    return _LETTER[0]


def letter_codes(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text, each run of non-letters one blank."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(c):
        return c
    is_letter = _letters()[c]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    return np.where(is_letter, c, 32)[keep].astype(np.uint32)


def buckets_of(codes: np.ndarray, start: int, stop: int, n: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each place; blanks follow the end."""
    part = np.full(stop - start + n - 1, 32, np.uint64)
    have = codes[start : stop + n - 1]
    part[: len(have)] = have
    h = np.full(stop - start, n, np.uint64)
    for j in range(n):
        h = (h ^ part[j : j + stop - start]) * _MIX
        h ^= h >> np.uint64(29)
    return (h % np.uint64(BUCKETS)).astype(np.int32)


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray  # (languages,)
    weight: np.ndarray  # (BUCKETS, languages), log-probabilities

    def score(self, text: str | None) -> tuple[str, float]:
        codes = letter_codes(text)
        if not self.languages or not (codes != 32).any():
            return UNKNOWN, 0.0
        total = self.prior.astype(np.float64)
        for a in range(0, len(codes), SPAN):
            b = min(a + SPAN, len(codes))
            for n in range(1, MAX_N + 1):
                seen = np.bincount(buckets_of(codes, a, b, n), minlength=1)
                at = np.flatnonzero(seen)
                total = total + seen[at] @ self.weight[at]
        p = np.exp(total - total.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def fit(rows: DataFrame) -> Model:
    """Model of rows (text, lang). The driver gets counts, at most one for each
    bucket and language, never texts."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                codes = letter_codes(text.as_py())
                into = counts.setdefault(lang.as_py(), np.zeros(BUCKETS, np.int64))
                for a in range(0, len(codes), SPAN):
                    for n in range(1, MAX_N + 1):
                        into += np.bincount(buckets_of(codes, a, min(a + SPAN, len(codes)), n), minlength=BUCKETS)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], names=["lang", "b", "n"]
            )

    counts = rows.select("text", "lang").mapInArrow(run, "lang string, b int, n long").groupBy("lang", "b").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    table = np.zeros((BUCKETS, len(languages)))
    table[counts["b"].to_numpy(int), counts["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int)] = counts["n"]
    weight = np.log(table + ALPHA) - np.log(table.sum(axis=0) + ALPHA * BUCKETS)
    return Model(list(languages), np.zeros(len(languages)), weight.astype(np.float32))


def learning_sample(docs: DataFrame, learn: Column, rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """About ``rows_per_language`` rows (text, lang) of each language, drawn by a
    hash of the id among those that ``learn`` admits."""
    known = docs.where(learn).where("doc_id is not null and lang is not null").select("doc_id", "text", "lang")
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    drawn = F.lit(False)
    for lang, n in sorted(counts.items()):
        drawn = drawn | ((F.col("lang") == lang) & drawn_share(F.col("doc_id"), rows_per_language / n, "lang"))
    return known.where(drawn)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Struct (lang_pred, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    @tidy
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([shared.value.score(t) for t in texts], columns=["lang_pred", "score"])

    return scored(F.col(text_col))
