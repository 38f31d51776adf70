"""Column-expression helpers (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c, lower: float | None = None, upper: float | None = None) -> Column:
    """Clip to [lower, upper]; a null stays null (greatest/least skip nulls)."""
    x = col(c)
    out = x
    if lower is not None:
        out = F.greatest(out, F.lit(float(lower)))
    if upper is not None:
        out = F.least(out, F.lit(float(upper)))
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(out)


def round_half_even(c, digits: int) -> Column:
    """NumPy rounding rule: rint(x * 10^d) / 10^d (ties to even on x*10^d)."""
    p = float(10**digits)
    return F.rint(col(c) * F.lit(p)) / F.lit(p)


def round_to(c, digits: int = 6) -> Column:
    """Edge rounding used by every registered query and its SQL oracle.

    rint-based (ties to even on x * 10^d), so Spark and the SQL oracle
    produce the same bits; decimal HALF_UP rounding of the shortest repr
    would disagree on exact decimal ties.
    """
    return round_half_even(c, digits)


def flag(cond: Column) -> Column:
    """Boolean condition as 0/1 int (null condition -> 0)."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def sum_columns(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def compare(c, op: str, threshold: float) -> Column:
    x = col(c)
    t = F.lit(float(threshold))
    if op == ">":
        return x > t
    if op == "<":
        return x < t
    if op == ">=":
        return x >= t
    if op == "<=":
        return x <= t
    raise ValueError(f"unsupported comparison {op!r}")


def bands(c, edges, labels) -> Column:
    """Label x by the first edge it is strictly below; last label otherwise."""
    x = col(c)
    out = None
    for edge, label in zip(edges, labels):
        cond = x < F.lit(float(edge))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(labels[len(edges)]))
