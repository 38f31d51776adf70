"""Feature operators: risk orientation, scaling, composite indices.

All operators are lazy ``DataFrame -> DataFrame`` column expressions.
Scaling statistics are whole-table by default (the surveyed behaviour for a
single series) or per key with ``by=``; see ``stats.stat_columns``.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col, round_half_even, sum_columns
from ..specs import REFERENCE_INDEX, FixedTerm, IndexSpec, IndexTerm
from .stats import as_list, stat_columns


def orient_expr(term: IndexTerm) -> Column:
    """Risk-oriented transform of one metric (higher = riskier)."""
    x = F.col(term.column).cast("double")
    if term.scale != 1.0:
        x = x * F.lit(float(term.scale))
    d = term.direction
    if d == "direct":
        return x
    if d == "inverse":
        return F.lit(1.0) / F.greatest(x, F.lit(0.1))
    if d == "complement":
        return F.lit(100.0) - x
    if d == "complement_capped":
        return F.lit(100.0) - F.least(x, F.lit(100.0))
    raise ValueError(f"unknown direction {d!r}")


def _guard(x: Column, e: Column) -> Column:
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(e)


def risk_orient(df: DataFrame, spec: IndexSpec = REFERENCE_INDEX, suffix: str = "_risk") -> DataFrame:
    """Add one risk-oriented column per index term (``<column><suffix>``)."""
    return df.withColumns(
        {t.column + suffix: _guard(F.col(t.column), orient_expr(t)) for t in spec.terms}
    )


def minmax_scale(df: DataFrame, cols, by=None, suffix: str = "_mm") -> DataFrame:
    """(x - min) / (max - min) into [0, 1]; constant column -> 0."""
    cols = as_list(cols)
    aggs = {}
    for c in cols:
        aggs[f"__min_{c}"] = F.min(F.col(c).cast("double"))
        aggs[f"__max_{c}"] = F.max(F.col(c).cast("double"))
    st = stat_columns(df, aggs, by)
    out = {}
    for c in cols:
        lo, hi = st[f"__min_{c}"], st[f"__max_{c}"]
        rng = hi - lo
        out[c + suffix] = _guard(
            F.col(c),
            F.when(rng == 0, F.lit(0.0)).otherwise((F.col(c).cast("double") - lo) / rng),
        )
    return df.withColumns(out)


def zscore(df: DataFrame, cols, by=None, suffix: str = "_z") -> DataFrame:
    """E5: (x - mean) / population std; std = 0 divides by 1."""
    cols = as_list(cols)
    aggs = {}
    for c in cols:
        aggs[f"__avg_{c}"] = F.avg(F.col(c).cast("double"))
        aggs[f"__sd_{c}"] = F.stddev_pop(F.col(c).cast("double"))
    st = stat_columns(df, aggs, by)
    out = {}
    for c in cols:
        sd = st[f"__sd_{c}"]
        denom = F.when(sd == 0, F.lit(1.0)).otherwise(sd)
        out[c + suffix] = (F.col(c).cast("double") - st[f"__avg_{c}"]) / denom
    return df.withColumns(out)


def risk_index(df: DataFrame, spec: IndexSpec = REFERENCE_INDEX, by=None, keep_parts: bool = False) -> DataFrame:
    """Weighted min-max composite of risk-oriented metrics, × multiplier.

    ``by`` None scales over the whole table (surveyed behaviour); with keys
    each entity is scaled on its own history.
    """
    oriented = risk_orient(df, spec, suffix="__o")
    ocols = [t.column + "__o" for t in spec.terms]
    scaled = minmax_scale(oriented, ocols, by=by, suffix="__n")
    parts = [F.lit(float(t.weight)) * F.col(t.column + "__o__n") for t in spec.terms]
    score = sum_columns(parts) * F.lit(float(spec.multiplier))
    if spec.round_digits is not None:
        score = round_half_even(score, spec.round_digits)
    out = scaled.withColumn(spec.out, score)
    drop = [c for c in out.columns if c.endswith("__o") or c.endswith("__o__n")]
    if keep_parts:
        renames = {t.column + "__o__n": t.column + "_norm" for t in spec.terms}
        out = out.withColumnsRenamed(renames)
        drop = [c for c in drop if c not in renames]
    return out.drop(*drop)


def risk_index_stats(df: DataFrame, column: str = "risk_index", by=None) -> DataFrame:
    """Mean, sample std, min, max of the index (per key or whole table)."""
    c = F.col(column)
    aggs = [
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
        F.count(c).alias("n"),
    ]
    keys = as_list(by)
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def fixed_term_expr(t: FixedTerm) -> Column:
    x = F.col(t.column)
    n = F.lit(float(t.norm))
    one = F.lit(1.0)
    if t.kind == "capped":
        v = F.least(x / n, one)
    elif t.kind == "capped_pos":
        v = F.least(F.greatest(x, F.lit(0.0)) / n, one)
    elif t.kind == "shortfall":
        v = F.greatest(one - x / n, F.lit(0.0))
    else:
        raise ValueError(f"unknown kind {t.kind!r}")
    return F.lit(float(t.weight)) * v


def fixed_index_expr(terms, multiplier: float = 100.0) -> Column:
    """Composite with fixed normalisers (no data-dependent scaling)."""
    return sum_columns([fixed_term_expr(t) for t in terms]) * F.lit(float(multiplier))


def fixed_index(df: DataFrame, terms, out: str = "risk_index", multiplier: float = 100.0) -> DataFrame:
    return df.withColumn(out, fixed_index_expr(terms, multiplier))


def corr_matrix(df: DataFrame, cols, by=None) -> DataFrame:
    """Pearson correlation for every pair (a < b by list order), long form.

    One aggregate pass computes all pairs; output (keys…, feature_a,
    feature_b, corr).
    """
    cols = as_list(cols)
    keys = as_list(by)
    pairs = list(combinations(cols, 2))
    aggs = [
        F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}")
        for i, (a, b) in enumerate(pairs)
    ]
    wide = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    stack = F.explode(
        F.array(
            *[
                F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"{i}").alias("corr"))
                for i, (a, b) in enumerate(pairs)
            ]
        )
    ).alias("p")
    return wide.select(*keys, stack).select(*keys, "p.feature_a", "p.feature_b", "p.corr")
