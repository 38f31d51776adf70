"""Registered queries: one per operator of the inventory.

Each query takes ``(spark, sf_dir)``, reads the supplied tables (whole
tables — no id subsets or row caps), binds them to the operator's panel
shape and returns a lazy DataFrame. Computed columns are aliased to the
names used by the SQL oracle in ``oracle.py`` and rounded at the edge
(``round(x, 6)``) on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import round_to
from ..operators import features as feat
from ..sources import panels
from ..specs import FIXED_INDEX_A, FIXED_INDEX_B, REFERENCE_INDEX

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

KEY = panels.NATION_KEY
PANEL_METRICS = list(panels.PANEL_METRICS)


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn

    return deco


def queries() -> dict:
    # importing the query modules fills the registry
    from . import queries_more  # noqa: F401

    return dict(REGISTRY)


def rounded(df: DataFrame, keep=(), digits: int = 6) -> DataFrame:
    """Round every double column not in ``keep``."""
    out = []
    for f in df.schema.fields:
        if f.dataType.simpleString() == "double" and f.name not in keep:
            out.append(round_to(f.name, digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# ---------------------------------------------------------------- bindings


def quarter_panel(spark, sf_dir) -> DataFrame:
    return panels.nation_panel(spark, sf_dir, "quarter")


def year_panel(spark, sf_dir) -> DataFrame:
    return panels.nation_panel(spark, sf_dir, "year")


def risk_panel(spark, sf_dir) -> DataFrame:
    return panels.risk_roles(quarter_panel(spark, sf_dir))


# ---------------------------------------------------------------- sources


@register("panel_quarter")
def q_panel_quarter(spark, sf_dir):
    return rounded(quarter_panel(spark, sf_dir))


@register("panel_year")
def q_panel_year(spark, sf_dir):
    return rounded(year_panel(spark, sf_dir))


# ---------------------------------------------------------------- features


@register("risk_index")
def q_risk_index(spark, sf_dir):
    df = feat.risk_index(risk_panel(spark, sf_dir), REFERENCE_INDEX)
    return df.select(KEY, "period_start", "year", "quarter", "risk_index")


@register("risk_orient")
def q_risk_orient(spark, sf_dir):
    df = feat.risk_orient(risk_panel(spark, sf_dir), REFERENCE_INDEX, suffix="_risk")
    cols = [t.column + "_risk" for t in REFERENCE_INDEX.terms]
    return rounded(df.select(KEY, "period_start", *cols))


@register("minmax_scale")
def q_minmax_scale(spark, sf_dir):
    df = feat.minmax_scale(quarter_panel(spark, sf_dir), PANEL_METRICS, by=KEY, suffix="_mm")
    return rounded(df.select(KEY, "period_start", *[m + "_mm" for m in PANEL_METRICS]))


@register("risk_index_stats")
def q_risk_index_stats(spark, sf_dir):
    df = feat.risk_index(risk_panel(spark, sf_dir), REFERENCE_INDEX)
    return rounded(feat.risk_index_stats(df, "risk_index", by=KEY))


@register("zscore")
def q_zscore(spark, sf_dir):
    df = feat.zscore(quarter_panel(spark, sf_dir), PANEL_METRICS, by=KEY, suffix="_z")
    return rounded(df.select(KEY, "period_start", *[m + "_z" for m in PANEL_METRICS]))


@register("corr_matrix")
def q_corr_matrix(spark, sf_dir):
    return rounded(feat.corr_matrix(quarter_panel(spark, sf_dir), PANEL_METRICS))


@register("risk_index_fixed_a")
def q_risk_index_fixed_a(spark, sf_dir):
    df = feat.fixed_index(risk_panel(spark, sf_dir), FIXED_INDEX_A, out="risk_index_a")
    return rounded(df.select(KEY, "period_start", "risk_index_a"))


@register("risk_index_fixed_b")
def q_risk_index_fixed_b(spark, sf_dir):
    df = feat.fixed_index(risk_panel(spark, sf_dir), FIXED_INDEX_B, out="risk_index_b")
    return rounded(df.select(KEY, "period_start", "risk_index_b"))
