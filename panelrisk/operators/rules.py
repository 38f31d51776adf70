"""Rule tables, bands, lights and badges.

A rule set is data, not code: ``RuleSet((Rule(col, op, threshold), …),
breach_at)`` compiles to one sum of 0/1 integer columns evaluated inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import bands, compare, flag, sum_columns
from ..specs import (
    BADGE_COLORS,
    LIGHT_CUTS,
    LIGHT_LABELS,
    REFERENCE_RULES,
    RuleSet,
)


def score_expr(ruleset: RuleSet = REFERENCE_RULES, colmap: dict | None = None) -> Column:
    """Number of rules breached (strict comparisons; null -> not breached)."""
    colmap = colmap or {}
    return sum_columns([flag(compare(colmap.get(r.column, r.column), r.op, r.threshold)) for r in ruleset.rules])


def breach_score(
    df: DataFrame,
    ruleset: RuleSet = REFERENCE_RULES,
    score: str = "score",
    breach: str = "breach",
    colmap: dict | None = None,
) -> DataFrame:
    """score = Σ rule flags, breach = score >= breach_at."""
    s = score_expr(ruleset, colmap)
    return df.withColumn(score, s.cast("int")).withColumn(breach, F.col(score) >= F.lit(ruleset.breach_at))


def traffic_light_expr(p, cuts=LIGHT_CUTS, labels=LIGHT_LABELS) -> Column:
    """P < cuts[0] -> labels[0]; < cuts[1] -> labels[1]; else labels[2]."""
    return bands(p, cuts, labels)


def badge_expr(x, cuts, labels=BADGE_COLORS) -> Column:
    """V8: strict '>' cut points, highest first (x > c0 -> labels[0] …)."""
    c = F.col(x) if isinstance(x, str) else x
    out = None
    for cut, label in zip(cuts, labels):
        cond = c > F.lit(float(cut))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(labels[len(cuts)]))
