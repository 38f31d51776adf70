"""Chart- and KPI-ready tables (V1–V9): the queries behind each chart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import bands
from ..specs import (
    BADGE_COLORS,
    DEBT_ALERT,
    DEBT_EDGES,
    DEBT_LABELS,
    INDEX_ALERT,
    INDEX_CUTS,
    PROB_CUTS,
    PRODUCTION_ALERT,
    R2_CUTS,
    R2_LABELS,
    REFERENCE_RULES,
    SCORE_EDGES,
    SCORE_LABELS,
    SPLIT_LABELS,
    ZONE_EDGES,
    ZONE_LABELS,
    RuleSet,
)
from .rules import badge_expr
from .stats import as_list


def risk_zones(df: DataFrame, index: str = "risk_index") -> DataFrame:
    """V1: index with its zone and the alert-line flag."""
    return df.withColumns(
        {"zone": bands(index, ZONE_EDGES, ZONE_LABELS), "above_alert": F.col(index) >= F.lit(INDEX_ALERT)}
    )


def debt_bands(df: DataFrame, debt: str = "debt_ratio") -> DataFrame:
    """V7: debt path with its band and the critical-line flag."""
    return df.withColumns(
        {"band": bands(debt, DEBT_EDGES, DEBT_LABELS), "above_critical": F.col(debt) > F.lit(DEBT_ALERT)}
    )


def score_classes(hist: DataFrame, ruleset: RuleSet = REFERENCE_RULES) -> DataFrame:
    """V4: histogram bucket class (< 3 / < 5 / >= 5) and collapse/stable."""
    return hist.withColumns(
        {
            "class": bands("score", SCORE_EDGES, SCORE_LABELS),
            "outcome": F.when(F.col("score") >= ruleset.breach_at, F.lit(SPLIT_LABELS[0])).otherwise(F.lit(SPLIT_LABELS[1])),
        }
    )


def scenario_long(proj: DataFrame, by, indicators=("production", "debt_ratio", "reserves", "risk_index")) -> DataFrame:
    """V5: indicator × scenario × year, long."""
    keys = as_list(by)
    return proj.select(*keys, "scenario", "year", *indicators).unpivot(
        [*keys, "scenario", "year"], list(indicators), "indicator", "value"
    )


def production_timeline(history: DataFrame, proj: DataFrame, by, value: str = "production") -> DataFrame:
    """V3: historical ∪ projected production with a series label and the
    reference-line flag."""
    keys = as_list(by)
    hist = history.select(*keys, "year", F.lit("history").alias("series"), F.col(value).alias("production"))
    fut = proj.select(*keys, "year", F.col("scenario").alias("series"), F.col(value).alias("production"))
    out = hist.unionByName(fut)
    return out.withColumn("below_reference", F.col("production") < F.lit(PRODUCTION_ALERT))


def kpi_badges(df: DataFrame, index_mean: str = "risk_index_mean", prob_pct: str = "p_collapse_pct") -> DataFrame:
    """V8: badge colours with strict '>' cut points."""
    return df.withColumns(
        {
            "index_badge": badge_expr(index_mean, INDEX_CUTS, tuple(reversed(BADGE_COLORS))),
            "prob_badge": badge_expr(prob_pct, PROB_CUTS, tuple(reversed(BADGE_COLORS))),
        }
    )


def r2_badges(df: DataFrame, r2: str = "r2") -> DataFrame:
    """V8: the label of a model's R² (strict '>' cut points, best first)."""
    return df.withColumn("r2_badge", badge_expr(r2, R2_CUTS, R2_LABELS))
