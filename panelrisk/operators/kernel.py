"""Kernel regression that outliers don't pull.

The RBF kernel is stood for by random Fourier features of z-scored columns:
z(x) = sqrt(2/D) cos(W x + b), W from N(0, 2γ), and a constant. The loss is
quadratic up to ``EPSILON`` and linear beyond (as the surveyed ε-insensitive loss
is), with penalty 1/C on all weights but the constant. It is minimised by
iteratively reweighted least squares: a step gives every row the weight
1 / max(|residual|, EPSILON) and solves the normal equations, whose matrices have
a fixed size. Every (C, γ, fold) of the search is one candidate; a step sums the
weighted matrices of all candidates in one pass over the rows, with partial sums
per task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread
from .evaluate import cv_folds

# The surveyed grid and the width of the loss's quadratic part.
C_GRID = (0.1, 1.0, 10.0, 100.0)
GAMMA_GRID = ("scale", "auto")
EPSILON = 0.1
#: Random features that stand for the kernel; most steps of a fit, and the
#: relative change of the weights that ends it.
FOURIER_DIM, STEPS, TOLERANCE = 64, 30, 1e-4
LOSSES = ("robust", "squared")


@dataclass(frozen=True)
class Candidate:
    c: float
    gamma: float
    fold: int  # held out; -1: none


def column_stats(df: DataFrame, cols) -> dict:
    """Mean and population deviation (1 for a constant) of each column."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return {c: (float(row[f"m_{c}"]), float(row[f"s_{c}"]) or 1.0) for c in cols}


def gamma_of(df: DataFrame, stats: dict, name: str | float) -> float:
    """``auto``: 1/p; ``scale``: 1/(p · variance of all z-scored values); or a number."""
    if not isinstance(name, str):
        return float(name)
    if name == "auto":
        return 1.0 / len(stats)
    squares = [((F.col(c) - m) / s) * ((F.col(c) - m) / s) for c, (m, s) in stats.items()]
    spread = df.agg(*[F.avg(x).alias(f"v{i}") for i, x in enumerate(squares)]).first()
    variance = float(np.mean([v or 0.0 for v in spread]))
    return 1.0 / (len(stats) * variance) if variance > 0 else 1.0


def fourier(batch: pa.RecordBatch, stats: dict, gamma: float, seed: int = 42) -> np.ndarray:
    """The constant and the features of the columns, scaled by the *training*
    means and deviations."""
    cols = sorted(stats)
    x = np.column_stack([(batch.column(c).to_numpy(zero_copy_only=False) - stats[c][0]) / stats[c][1] for c in cols])
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, 1.0, size=(FOURIER_DIM, len(cols))) * math.sqrt(2.0 * gamma)
    b = rng.uniform(0.0, 2.0 * math.pi, size=FOURIER_DIM)
    return np.hstack([np.ones((len(x), 1)), math.sqrt(2.0 / FOURIER_DIM) * np.cos(x @ w.T + b)])


def _sums(rows: DataFrame, stats: dict, target: str, weights: list, candidates: list[Candidate], loss: str) -> np.ndarray:
    """Z'WZ | Z'Wy of every candidate over the rows outside its fold; without
    weights yet, and for the squared loss, W is the identity."""
    width = FOURIER_DIM + 1

    def part(batches):
        total = np.zeros((len(candidates), width, width + 1))
        for batch in batches:
            y = batch.column(target).to_numpy(zero_copy_only=False)
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            for gamma in {c.gamma for c in candidates}:
                z = fourier(batch, stats, gamma)
                zy = np.hstack([z, y[:, None]])
                for i, c in enumerate(candidates):
                    if c.gamma == gamma:
                        own = (fold != c.fold).astype(float)
                        if weights is not None and loss == "robust":
                            own /= np.maximum(np.abs(y - z @ weights[i]), EPSILON)
                        total[i] += (z * own[:, None]).T @ zy
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(candidates)), pa.int32()), pa.array(list(total.reshape(len(candidates), -1)), pa.list_(pa.float64()))],
            names=["i", "sums"],
        )

    def total_of(group: pa.Table) -> pa.Table:
        summed = pc.list_flatten(group["sums"]).to_numpy().reshape(len(group), -1).sum(axis=0)
        return pa.table({"i": group["i"][:1], "sums": pa.array([summed], pa.list_(pa.float64()))})

    schema = "i int, sums array<double>"
    summed = rows.mapInArrow(part, schema).groupBy("i").applyInArrow(total_of, schema)
    out = np.zeros((len(candidates), width, width + 1))
    for r in summed.collect():  # one row of a fixed size for each candidate
        out[r.i] = np.array(r.sums).reshape(width, width + 1)
    return out


def _solved(sums: np.ndarray, c: float) -> np.ndarray:
    penalty = np.eye(len(sums)) / c
    penalty[0, 0] = 1e-9
    return np.linalg.solve(sums[:, :-1] + penalty, sums[:, -1])


def weights_of(rows: DataFrame, stats: dict, target: str, candidates: list[Candidate], loss: str = "robust") -> list[np.ndarray]:
    """Weights of every candidate. Candidates that have settled leave the passes."""
    found: list = [None] * len(candidates)
    live = list(range(len(candidates)))
    for step in range(STEPS + 1):
        held = None if step == 0 else [found[i] for i in live]
        sums = _sums(rows, stats, target, held, [candidates[i] for i in live], loss)
        moving = []
        for i, s in zip(live, sums, strict=True):
            new = _solved(s, candidates[i].c)
            if loss == "robust" and (found[i] is None or np.abs(new - found[i]).max() > TOLERANCE * max(1.0, np.abs(new).max())):
                moving.append(i)
            found[i] = new
        live = moving
        if not live:
            break
    return found


def search(
    train: DataFrame, target: str, features, key: str, order: str, loss: str = "robust", cs=C_GRID, gammas=GAMMA_GRID
) -> tuple[dict, list[float], float, list[tuple]]:
    """(stats, weights, gamma, scores) of the best (C, γ) by the mean absolute error
    over min(3, n // 2) contiguous folds, refitted on all rows. ``scores`` has
    (C, γ's name, γ, error) of every pair of the grid."""
    if loss not in LOSSES:
        raise ValueError(f"loss must be one of {LOSSES}")
    stats = column_stats(train, features)
    n = train.count()
    folds = max(2, min(3, n // 2))
    # Dealt to folds once: every pass of the search reads these rows.
    dealt = spread(cv_folds(train, key, order, folds).select("fold", target, *sorted(stats)), n).persist()
    try:
        return stats, *_searched(dealt, stats, target, folds, loss, cs, [(x, gamma_of(train, stats, x)) for x in gammas])
    finally:
        dealt.unpersist()


def _searched(rows: DataFrame, stats: dict, target: str, folds: int, loss: str, cs, gammas) -> tuple[list[float], float, list[tuple]]:
    """(weights, gamma, scores) of ``search``, over rows dealt to folds."""
    named = [(name if isinstance(name, str) else repr(name), g) for name, g in gammas]
    candidates = [Candidate(c, g, f) for c in cs for g in dict.fromkeys(g for _, g in named) for f in range(folds)]
    tries = dict(zip(candidates, weights_of(rows, stats, target, candidates, loss), strict=True))
    pairs = list(dict.fromkeys((c.c, c.gamma) for c in candidates))

    def errors(batches):
        for batch in batches:
            y = batch.column(target).to_numpy(zero_copy_only=False)
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            e = np.zeros((len(y), len(pairs)))
            z = {g: fourier(batch, stats, g) for _, g in pairs}
            for c, w in tries.items():
                held = fold == c.fold
                e[held, pairs.index((c.c, c.gamma))] = np.abs(z[c.gamma][held] @ w - y[held])
            yield pa.RecordBatch.from_arrays([pa.array(list(e), pa.list_(pa.float64()))], names=["e"])

    each = rows.mapInArrow(errors, "e array<double>")
    maes = each.agg(*[F.avg(F.col("e")[i]).alias(f"e{i}") for i in range(len(pairs))]).first()
    mae = dict(zip(pairs, (float(x) for x in maes), strict=True))
    best = min(pairs, key=lambda p: mae[p])
    (weights,) = weights_of(rows, stats, target, [Candidate(*best, -1)], loss)
    scores = [(c, name, g, mae[(c, g)]) for c in cs for name, g in named]
    return weights.tolist(), best[1], scores


def predicted(df: DataFrame, stats: dict, weights: list[float], gamma: float) -> DataFrame:
    """``df`` with the column ``prediction``."""
    w = np.array(weights)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(fourier(batch, stats, gamma) @ w)], names=[*batch.schema.names, "prediction"]
            )

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("prediction", T.DoubleType())]))
