"""Evaluation and SQL-expressible statistics: metrics, baselines, backtest,
CV folds, exponential decline fit (M3, M4, M6, M10, M11, B2, B4).
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, spread
from .segments import positions
from .stats import as_list, same_keys


def regression_metrics(pred: DataFrame, y: str = "y_true", p: str = "y_pred", by=None) -> DataFrame:
    """MAE, RMSE, R² = 1 - SSE/SST, MAPE over rows with y != 0 (0 when
    none), n — per group, in one aggregate with map-side partials (SST is the
    population variance times n, which Spark merges stably). With a constant y
    R² is 1 for a perfect fit, else 0."""
    keys = as_list(by)
    t = F.col(y).cast("double")
    e = t - F.col(p)
    sse = F.sum(e * e)
    ape = F.when(t != 0, F.abs(e / t))
    constant = F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    aggs = [
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(F.min(t) == F.max(t), constant).otherwise(F.lit(1.0) - sse / (F.var_pop(t) * F.count(t))).alias("r2"),
        F.coalesce(F.avg(ape) * F.lit(100.0), F.lit(0.0)).alias("mape"),
        F.count(F.lit(1)).alias("n"),
    ]
    return pred.groupBy(*keys).agg(*aggs)


def report_rounding(metrics: DataFrame) -> DataFrame:
    """B2 at the surveyed digits: MAE, RMSE, R² 4, MAPE 2."""
    digits = {"mae": 4, "rmse": 4, "r2": 4, "mape": 2}
    return metrics.withColumns({c: F.round(c, d) for c, d in digits.items() if c in metrics.columns})


def naive_forecasts(df: DataFrame, y: str, by, order, split: str = "split") -> DataFrame:
    """SQL baseline forecasters for the test split, per key:
    ``last_value`` (last train observation) and ``train_mean``."""
    keys = as_list(by)
    w = Window.partitionBy(*keys)
    train = F.when(F.col(split) == "train", F.col(y))
    last_train = F.max_by(train, F.when(F.col(split) == "train", F.col(order))).over(w)
    base = df.withColumn("__last", last_train).withColumn("__mean", F.avg(train).over(w))
    test = base.where(F.col(split) == "test")
    out = test.select(
        *keys,
        order,
        F.col(y).cast("double").alias("y_true"),
        F.inline(
            F.array(
                F.struct(F.lit("last_value").alias("model"), F.col("__last").cast("double").alias("y_pred")),
                F.struct(F.lit("train_mean").alias("model"), F.col("__mean").cast("double").alias("y_pred")),
            )
        ),
    )
    return out


def backtest_series(pred: DataFrame, band: float = 0.1) -> DataFrame:
    """True vs predicted with signed error and a ±band relative envelope."""
    return pred.withColumns(
        {
            "error": F.col("y_pred") - F.col("y_true"),
            "lower": F.col("y_pred") * F.lit(1.0 - band),
            "upper": F.col("y_pred") * F.lit(1.0 + band),
        }
    )


def cv_folds(df: DataFrame, by, order, k: int = 3, block: float | None = None) -> DataFrame:
    """Contiguous, unshuffled folds over time per key: k runs of equal length,
    the first ones longer by a row where k doesn't divide. ``block`` scans long
    series by time block, else a key is one window."""
    keys = as_list(by)
    if block is not None:
        work = positions(df, keys, order, block)
        i, size, longer = F.col("__pos") - 1, F.floor(F.col("__n") / k), F.col("__n") % k
        early = F.floor(i / (size + 1))
        late = longer + F.floor((i - longer * (size + 1)) / F.greatest(size, F.lit(1)))
        fold = F.when(i < longer * (size + 1), early).otherwise(late).cast("int")
        return work.withColumn("fold", fold).select(*df.columns, "fold")
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("fold", (F.ntile(k).over(w) - F.lit(1)).cast("int"))


def component_errors(pred: DataFrame, by=None) -> DataFrame:
    """M6: MAE, RMSE, R² of a combined prediction and the MAE of its two parts
    alone (``mae_ml``, ``mae_decline``), in one aggregate."""
    keys = as_list(by)
    e = F.col("y_true") - F.col("y_pred")
    sse = F.sum(e * e)
    constant = F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return pred.groupBy(*keys).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(F.min("y_true") == F.max("y_true"), constant)
        .otherwise(F.lit(1.0) - sse / (F.var_pop("y_true") * F.count("y_true")))
        .alias("r2"),
        F.avg(F.abs(F.col("y_true") - F.col("y_ml"))).alias("mae_ml"),
        F.avg(F.abs(F.col("y_true") - F.col("y_decline"))).alias("mae_decline"),
    )


def decline_fit(
    df: DataFrame,
    y: str,
    by,
    order,
    q_bounds=(100.0, 1000.0),
    lam_bounds=(0.001, 0.2),
    points: int = 41,
    rounds: int = 6,
    fallback_lambda: float = 0.035,
    block: float | None = None,
) -> DataFrame:
    """M3: least-squares fit of y ≈ q·exp(-λ t), t = 0, 1, … by position.

    Profile least squares: for each λ the optimal q has the closed form
    clip(Σ y e / Σ e², q bounds) with e = exp(-λ t); SSE(λ) = Σ y² - 2 q Σ y e +
    q² Σ e². λ is searched from coarse to fine: each round spreads ``points``
    values over the last round's best value and its neighbours, so six rounds
    place λ to about 1e-9. A round is one aggregate by key of the sums of all its
    λ, with partial sums on the map side, joined to the rows for the next one; no
    series is ever gathered. ``block`` finds the positions of long series by time
    block. As surveyed, a series whose first value lies outside the q bounds falls
    back to (y0, fallback_lambda). Missing values don't count in the sums.
    Output: keys, q, lam, fitted, n (length of the series).
    """
    keys = as_list(by)
    lo, hi = (float(x) for x in lam_bounds)
    ql, qh = (float(x) for x in q_bounds)
    if block is not None:
        placed = positions(df, keys, order, block).withColumn("__t", F.col("__pos") - 1)
    else:
        placed = df.withColumn("__t", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    rows = materialize(placed.select(*keys, F.col("__t").cast("double").alias("t"), F.col(y).cast("double").alias("y")))
    rows = spread(rows, rows.count())
    firsts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("t") == 0, F.col("y"))).alias("y0"))
    named = [F.col(k).alias(f"__k_{k}") for k in keys]
    state = firsts.select(*named, F.lit(lo).alias("start"), F.lit((hi - lo) / (points - 1)).alias("width"))
    grid = F.sequence(F.lit(0), F.lit(points - 1))
    known = rows.where(F.col("y").isNotNull())

    def lam(j):
        return F.col("start") + j * F.col("width")

    terms = F.concat(
        F.transform(grid, lambda j: F.col("y") * F.exp(-lam(j) * F.col("t"))), F.transform(grid, lambda j: F.exp(-2 * lam(j) * F.col("t")))
    )

    def tried(j):
        a, b = F.col("sums")[j], F.col("sums")[j + points]
        q = F.least(F.greatest(a / b, F.lit(ql)), F.lit(qh))
        return F.struct((q * q * b - 2 * q * a).alias("sse"), lam(j).alias("lam"), q.alias("q"))

    for _ in range(rounds):
        met = known.join(state, same_keys(keys, "__k_")).groupBy(*named, "start", "width")
        summed = met.agg(vector_to_array(Summarizer.sum(array_to_vector(terms))).alias("sums"))
        best = summed.select(*[f"__k_{k}" for k in keys], "width", F.array_min(F.transform(grid, tried)).alias("best"))
        # The next round covers one step to either side of the best.
        start = F.least(F.greatest(F.col("best.lam") - F.col("width"), F.lit(lo)), F.lit(hi) - 2 * F.col("width"))
        state = best.select(*[f"__k_{k}" for k in keys], start.alias("start"), (2 * F.col("width") / (points - 1)).alias("width"), "best")
    inside = F.col("y0").between(*q_bounds)
    return firsts.join(state, same_keys(keys, "__k_"), "left").select(
        *keys,
        F.when(inside, F.col("best.q")).otherwise(F.col("y0")).alias("q"),
        F.when(inside, F.col("best.lam")).otherwise(F.lit(fallback_lambda)).alias("lam"),
        inside.alias("fitted"),
        F.col("n").cast("int").alias("n"),
    )


def decline_curve(params: DataFrame, by, origin: str = "reference", steps: Column | None = None) -> DataFrame:
    """M4: q·exp(-λ t) per key over as many steps as its series has values.

    ``origin="reference"`` starts at t = n (t = n … 2n-1), as surveyed;
    ``"train"`` gives the in-sample curve (t = 0 … n-1). ``steps`` overrides the
    number of steps.
    """
    if origin not in ("reference", "train"):
        raise ValueError("origin must be 'reference' or 'train'")
    keys = as_list(by)
    start = F.col("n") if origin == "reference" else F.lit(0)
    n = F.col("n") if steps is None else steps
    return params.select(*keys, "q", "lam", F.explode(F.sequence(start, start + n - 1)).alias("t")).select(
        *keys, "t", (F.col("q") * F.exp(-F.col("lam") * F.col("t").cast("double"))).alias("y_decline")
    )
