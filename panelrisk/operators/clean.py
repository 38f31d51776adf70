"""Cleaning operators (C1–C6): interpolation, fills, IQR winsorising, reports.

Interpolation and fills come in two forms. For panels whose keys hold one row per
period of a calendar, windows by key share one exchange and one sort. For series of
any length, ``block`` names a stretch of time: the scan then runs within (key,
block) and over one carry row per block (see ``segments``).

Quartiles are exact by rank selection (see ``quantiles``), with a bounded state
whatever a group's size; ``quartiles="series"`` takes them as a window over a key's
short series, ``"approx"`` by ``percentile_approx``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip
from .quantiles import exact_quantiles
from .segments import scanned
from .stats import as_list, same_keys, stat_columns, unpivot_metrics


def _windows(by, order):
    base = Window.partitionBy(*as_list(by)).orderBy(*as_list(order))
    pre = base.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    post = base.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return base, pre, post


def position(by, order) -> Column:
    """1-based row position within each key, by time."""
    base, _, _ = _windows(by, order)
    return F.row_number().over(base)


def interpolate_linear(df: DataFrame, cols, by, order, pos: str | None = None, block: float | None = None) -> DataFrame:
    """Linear interpolation by row position, both directions.

    Inner gaps are interpolated between the neighbouring observations;
    leading and trailing gaps take the nearest observation; an all-null
    series stays null. ``pos`` names an existing position column (e.g. a
    calendar index); by default the row position within the key is used.
    """
    if block is not None:
        known = df.withColumns({c: F.col(c).cast("double") for c in as_list(cols)})
        work, i, out = scanned(known, cols, by, order, block, pos), F.col("__pos").cast("double"), {}
        for c in as_list(cols):
            last, following = F.col(f"__last_{c}"), F.col(f"__next_{c}")
            slope = (following["v"] - last["v"]) * (i - last["i"]) / (following["i"] - last["i"])
            out[c] = F.coalesce(F.col(c), last["v"] + slope, last["v"], following["v"])
        return work.withColumns(out).select(*df.columns)
    _, pre, post = _windows(by, order)
    tmp = "__pos"
    work = df.withColumn(tmp, F.col(pos) if pos else position(by, order))
    i = F.col(tmp).cast("double")
    out = {}
    for c in as_list(cols):
        x = F.col(c).cast("double")
        at = F.when(x.isNotNull(), i)
        lv, li = F.last(x, True).over(pre), F.last(at, True).over(pre)
        nv, ni = F.first(x, True).over(post), F.first(at, True).over(post)
        inner = lv + (nv - lv) * (i - li) / (ni - li)
        out[c] = F.coalesce(x, inner, lv, nv)
    return work.withColumns(out).drop(tmp)


def fill_forward_back(df: DataFrame, cols, by, order, block: float | None = None) -> DataFrame:
    """Forward fill, then backward fill for leading gaps."""
    if block is not None:
        work = scanned(df, cols, by, order, block)
        filled = {c: F.coalesce(F.col(c), F.col(f"__last_{c}.v"), F.col(f"__next_{c}.v")) for c in as_list(cols)}
        return work.withColumns(filled).select(*df.columns)
    _, pre, post = _windows(by, order)
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.last(c, True).over(pre), F.first(c, True).over(post)) for c in as_list(cols)}
    )


QUARTILES = (0.25, 0.75)


def _fence(q: Column, k: float) -> tuple[Column, Column]:
    iqr = q[1] - q[0]
    return q[0] - F.lit(k) * iqr, q[1] + F.lit(k) * iqr


def iqr_fences(df: DataFrame, cols, by=None, k: float = 1.5) -> DataFrame:
    """(keys, column, lower, upper) = Q1 - k·IQR and Q3 + k·IQR, exact quartiles."""
    lower, upper = _fence(F.col("q"), k)
    return exact_quantiles(df, cols, QUARTILES, by).select(*as_list(by), "column", lower.alias("lower"), upper.alias("upper"))


def iqr_winsorize(df: DataFrame, cols, by=None, k: float = 1.5, quartiles: str = "select") -> DataFrame:
    """Clip each column to its IQR fence (per key with ``by``).

    ``quartiles="select"`` runs jobs (see ``exact_quantiles``); ``"series"`` and
    ``"approx"`` are lazy.
    """
    keys, cols = as_list(by), as_list(cols)
    if quartiles == "select":
        fences = iqr_fences(df, cols, by, k)
        wide = [F.max(F.when(F.col("column") == c, F.struct("lower", "upper"))).alias(f"__f_{c}") for c in cols]
        held = fences.groupBy(*[F.col(x).alias(f"__k_{x}") for x in keys]).agg(*wide)
        bounds = {c: (F.col(f"__f_{c}.lower"), F.col(f"__f_{c}.upper")) for c in cols}
        if keys:
            work = df.join(held, same_keys(keys, "__k_"), "left")
        else:
            work = df.withColumns({f"__f_{c}": held.select(f"__f_{c}").scalar() for c in cols})
    else:
        work, bounds = df, {}
        how = {
            "series": lambda x: F.percentile(x, F.array(*map(F.lit, QUARTILES))),
            "approx": lambda x: F.percentile_approx(x, list(QUARTILES), 10000),
        }[quartiles]
        stats = stat_columns(df, {c: how(F.col(c).cast("double")) for c in cols}, by)
        bounds = {c: _fence(stats[c], k) for c in cols}
    clipped = {c: clip_cols(F.col(c).cast("double"), *bounds[c]) for c in cols}
    return work.withColumns(clipped).select(*df.columns)


def clip_cols(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(F.least(F.greatest(x, lo), hi))


def iqr_outlier_report(df: DataFrame, cols, by=None, k: float = 1.5) -> DataFrame:
    """C4: per (key, column): fence and count of values outside it."""
    keys = [*as_list(by), "column"]
    long = unpivot_metrics(df, as_list(by), as_list(cols), "column", "value")
    fences = iqr_fences(df, cols, by, k).select(*[F.col(x).alias(f"__k_{x}") for x in keys], "lower", "upper")
    return (
        long.join(fences, same_keys(keys, "__k_"))
        .groupBy(*keys, "lower", "upper")
        .agg(F.count_if((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))).alias("n_outliers"))
    )


def null_counts(df: DataFrame, cols=None) -> DataFrame:
    """Null count per column (long form) in one pass."""
    cols = as_list(cols) or df.columns
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "n_null")


def clean(df: DataFrame, cols, by, order, k: float = 1.5) -> DataFrame:
    """One cleaning pass: interpolate, fill, winsorise per key (C1+C2+C3), for
    panels of one row per key and period."""
    step = interpolate_linear(df, cols, by, order)
    step = fill_forward_back(step, cols, by, order)
    return iqr_winsorize(step, cols, by=by, k=k, quartiles="series")


def clip_bounds(df: DataFrame, bounds: dict) -> DataFrame:
    """Clip columns to fixed bounds {col: (lower|None, upper|None)}."""
    return df.withColumns({c: clip(c, lo, hi) for c, (lo, hi) in bounds.items()})
