"""Temporal disaggregation annual -> quarterly under a sum constraint.

The surveyed estimator is Chow-Lin with identity covariance. With an
aggregation matrix C whose rows sum four consecutive quarters, C·Cᵀ = 4I,
so the generalised-least-squares machinery collapses to closed forms:

* trend regressors (constant + quarter index), n >= 2 years::

      q_{i,k} = Y_i / 4 + b · (k - 2.5),   b = regr_slope(Y, pos) / 16

  and for one year the minimum-norm solution gives b = 10·Y / 116.
* one indicator x without intercept (used when the indicator has at least
  4·n rows; the first 4·n indicator rows are used, by position)::

      S_i = Σ_k x_{i,k},   β = Σ S_i Y_i / Σ S_i²  (0 when Σ S_i² = 0)
      q_{i,k} = β·x_{i,k} + (Y_i - β·S_i) / 4

Both are window aggregates over the key plus an ``explode`` of the four
quarters — O(n) per key instead of dense n×4n matrices, and every key is
solved in the same pass. ``agg="mean"`` keeps levels (no division by 4)
for stock/ratio series; ``"sum"`` is the surveyed behaviour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import as_list


def _quarter_date(year, quarter):
    return F.make_date(year, (quarter - F.lit(1)) * F.lit(3) + F.lit(1), F.lit(1))


def disaggregate_trend(annual: DataFrame, metrics, by, year: str = "year", agg: str = "sum") -> DataFrame:
    """D1 (trend branch) for every metric and key at once.

    Output: keys, year, quarter, period_start, metrics (quarterly values).
    """
    keys = as_list(by)
    metrics = as_list(metrics)
    w_key = Window.partitionBy(*keys)
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy(year)).cast("double")
    work = annual.select(*keys, year, *[F.col(m).cast("double").alias(m) for m in metrics]).withColumn("__pos", pos)
    slopes = {}
    for m in metrics:
        n = F.count(F.col(m)).over(w_key)
        slope = F.regr_slope(F.col(m), F.col("__pos")).over(w_key) / F.lit(16.0)
        single = F.lit(10.0) * F.col(m) / F.lit(116.0)
        slopes[f"__b_{m}"] = F.when(n == 1, single).otherwise(slope)
    work = work.withColumns(slopes)
    q = F.explode(F.array(*[F.lit(i) for i in range(1, 5)])).alias("quarter")
    exploded = work.select("*", q)
    k = F.col("quarter").cast("double") - F.lit(2.5)
    scale = F.lit(4.0) if agg == "sum" else F.lit(1.0)
    mult = F.lit(1.0) if agg == "sum" else F.lit(4.0)
    vals = {m: F.col(m) / scale + mult * F.col(f"__b_{m}") * k for m in metrics}
    return exploded.select(
        *keys,
        F.col(year).cast("int").alias(year),
        F.col("quarter").cast("int").alias("quarter"),
        _quarter_date(F.col(year), F.col("quarter")).alias("period_start"),
        *[vals[m].alias(m) for m in metrics],
    )


def disaggregate_indicator(
    annual: DataFrame,
    indicator: DataFrame,
    metrics,
    by,
    year: str = "year",
    order: str = "period_start",
    indicator_cols: dict | None = None,
    agg: str = "sum",
) -> DataFrame:
    """D2 (indicator branch) for keys whose indicator has >= 4·n rows.

    ``indicator`` is a quarterly panel (keys, ``order``, columns); by default
    each metric is its own indicator (``indicator_cols`` maps metric ->
    indicator column). Keys with too short an indicator are not returned;
    ``disaggregate`` routes them to the trend branch.
    """
    keys = as_list(by)
    metrics = as_list(metrics)
    icols = indicator_cols or {m: m for m in metrics}
    w_key = Window.partitionBy(*keys)
    a = annual.select(
        *keys,
        F.col(year).cast("int").alias(year),
        *[F.col(m).cast("double").alias(m) for m in metrics],
    )
    a = a.withColumn("__pos", F.row_number().over(Window.partitionBy(*keys).orderBy(year))).withColumn(
        "__n_a", F.count(F.lit(1)).over(w_key)
    )
    ind = indicator.select(*keys, order, *[F.col(icols[m]).cast("double").alias(f"__x_{m}") for m in metrics])
    ind = ind.withColumn("__qpos", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).withColumn(
        "__n_i", F.count(F.lit(1)).over(w_key)
    )
    ind = ind.withColumn("__block", F.floor((F.col("__qpos") - 1) / 4).cast("int") + 1).withColumn(
        "quarter", ((F.col("__qpos") - 1) % 4 + 1).cast("int")
    )
    joined = ind.alias("i").join(
        a.alias("a"),
        [F.col(f"i.{k}") == F.col(f"a.{k}") for k in keys] + [F.col("i.__block") == F.col("a.__pos")],
    )
    joined = joined.where(F.col("i.__n_i") >= F.lit(4) * F.col("a.__n_a")).select(
        *[F.col(f"a.{k}").alias(k) for k in keys],
        F.col(f"a.{year}").alias(year),
        "quarter",
        *[F.col(f"a.{m}").alias(m) for m in metrics],
        *[F.col(f"i.__x_{m}").alias(f"__x_{m}") for m in metrics],
    )
    w_year = Window.partitionBy(*keys, year)
    # S_i per year, then Σ S·Y = Σ_rows x·Y and Σ S² = Σ_rows x·S per key.
    joined = joined.withColumns({f"__s_{m}": F.sum(F.col(f"__x_{m}")).over(w_year) for m in metrics})
    betas = {}
    for m in metrics:
        x, y, s = F.col(f"__x_{m}"), F.col(m), F.col(f"__s_{m}")
        num = F.sum(x * y).over(w_key)
        den = F.sum(x * s).over(w_key)
        betas[f"__beta_{m}"] = F.when(den == 0, F.lit(0.0)).otherwise(num / den)
    joined = joined.withColumns(betas)
    factor = F.lit(1.0) if agg == "sum" else F.lit(4.0)
    vals = {}
    for m in metrics:
        x, y, s, b = F.col(f"__x_{m}"), F.col(m), F.col(f"__s_{m}"), F.col(f"__beta_{m}")
        vals[m] = factor * (b * x + (y - b * s) / F.lit(4.0))
    return joined.select(
        *keys,
        year,
        "quarter",
        _quarter_date(F.col(year), F.col("quarter")).alias("period_start"),
        *[vals[m].alias(m) for m in metrics],
    )


def disaggregate(
    annual: DataFrame,
    metrics,
    by,
    indicator: DataFrame | None = None,
    method: str = "trend",
    year: str = "year",
    order: str = "period_start",
    agg: str = "sum",
) -> DataFrame:
    """Disaggregate every metric by the named method.

    ``"trend"`` and ``"indicator"`` (which takes the indicator's whole series;
    keys with fewer than 4·n indicator rows have no result) are explicit
    choices; ``"by_length"`` is the surveyed rule, per key the indicator where
    its series is long enough, else the trend — one left join, in which the
    indicator is evaluated once.
    """
    keys, metrics = as_list(by), as_list(metrics)
    if method not in ("trend", "indicator", "by_length"):
        raise ValueError("method must be 'trend', 'indicator' or 'by_length'")
    if method == "trend":
        return disaggregate_trend(annual, metrics, keys, year, agg)
    ind = disaggregate_indicator(annual, indicator, metrics, keys, year, order, agg=agg)
    if method == "indicator":
        return ind
    trend = disaggregate_trend(annual, metrics, keys, year, agg)
    cells = [*keys, year, "quarter"]
    found = ind.select(*cells, F.lit(True).alias("__found"), *[F.col(m).alias(f"__i_{m}") for m in metrics])
    pick = [F.when(F.col("__found"), F.col(f"__i_{m}")).otherwise(F.col(m)).alias(m) for m in metrics]
    return trend.join(found, cells, "left").select(*cells, "period_start", *pick)


def aggregation_check(annual: DataFrame, quarterly: DataFrame, metrics, by, year: str = "year", agg: str = "sum") -> DataFrame:
    """D3: max |Σ quarters − annual| per key and metric (≈ 0 by construction)."""
    keys = as_list(by)
    f = F.sum if agg == "sum" else F.avg
    q = quarterly.groupBy(*keys, year).agg(*[f(m).alias(f"__q_{m}") for m in metrics])
    j = q.join(annual.select(*keys, year, *metrics), [*keys, year])
    diffs = j.select(
        *keys,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric"), F.abs(F.col(f"__q_{m}") - F.col(m)).alias("diff"))
                    for m in metrics
                ]
            )
        ),
    )
    return diffs.groupBy(*keys, "metric").agg(F.max("diff").alias("max_abs_diff"))


def harmonize(disaggregated: DataFrame, quarterly: DataFrame, columns) -> DataFrame:
    """H1: disaggregated ∪ true quarterly rows (by name). Sorting is left to
    the sink — a global sort is a range shuffle nobody downstream needs."""
    cols = as_list(columns)
    return disaggregated.select(*cols).unionByName(quarterly.select(*cols))
