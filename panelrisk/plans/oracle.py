"""DuckDB SQL oracles, one per registered query that SQL can express."""

from __future__ import annotations

from ..specs import FIXED_INDEX_A, FIXED_INDEX_B, REFERENCE_INDEX
from .sqlparts import D, PANEL_QUARTER, PANEL_YEAR, RISK_PANEL, cte, fixed_index_sql, index_terms_sql, r6

ORACLES: dict[str, str] = {}

PANEL_METRICS = ["volume", "unit_price", "disc_pct", "ret_pct", "open_pct", "tax_take", "n_orders"]


def oracle(name: str):
    def deco(fn):
        ORACLES[name] = fn
        return fn

    return deco


def oracle_sql() -> dict:
    from . import oracle_more  # noqa: F401

    return {k: fn() for k, fn in ORACLES.items()}


def round_cols(cols, exclude=()) -> str:
    return ", ".join(c if c in exclude else f"{r6(c)} AS {c}" for c in cols)


PANEL_Q_COLS = ["volume", "unit_price", "disc_pct", "ret_pct", "open_pct", "tax_take"]


@oracle("panel_quarter")
def o_panel_quarter():
    return f"""{cte(PANEL_QUARTER)}
SELECT nation_key, period_start, year, quarter, {round_cols(PANEL_Q_COLS)}, n_orders
FROM panel_quarter"""


@oracle("panel_year")
def o_panel_year():
    return f"""{cte(PANEL_YEAR)}
SELECT nation_key, year, {round_cols(PANEL_Q_COLS)}, n_orders FROM panel_year"""


def risk_index_cte(spec=REFERENCE_INDEX, by=None, name="ri") -> str:
    """CTE ``name`` = risk_panel + risk_index (whole-table scaling unless ``by``)."""
    exprs = index_terms_sql(spec)
    o_cols = ", ".join(f"{e} AS t{i}" for i, e in enumerate(exprs))
    if by:
        stats = ", ".join(
            f"min(t{i}) OVER (PARTITION BY {by}) AS mn{i}, max(t{i}) OVER (PARTITION BY {by}) AS mx{i}"
            for i in range(len(exprs))
        )
        src = f"(SELECT *, {stats} FROM {name}_o)"
    else:
        stats = ", ".join(f"min(t{i}) AS mn{i}, max(t{i}) AS mx{i}" for i in range(len(exprs)))
        src = f"{name}_o CROSS JOIN (SELECT {stats} FROM {name}_o)"
    norm = [
        f"CASE WHEN t{i} IS NULL THEN NULL WHEN mx{i} - mn{i} = 0 THEN {D(0)} "
        f"ELSE (t{i} - mn{i}) / (mx{i} - mn{i}) END"
        for i in range(len(exprs))
    ]
    score = " + ".join(f"{D(t.weight)} * {n}" for t, n in zip(spec.terms, norm))
    score = f"({score}) * {D(spec.multiplier)}"
    if spec.round_digits is not None:
        p = D(10**spec.round_digits)
        score = f"round_even(({score}) * {p}, 0) / {p}"
    return f"""{name}_o AS (SELECT *, {o_cols} FROM risk_panel),
{name} AS (SELECT *, {score} AS {spec.out} FROM {src})"""


@oracle("risk_index")
def o_risk_index():
    return f"""{cte(PANEL_QUARTER, RISK_PANEL, risk_index_cte())}
SELECT nation_key, period_start, year, quarter, risk_index FROM ri"""


@oracle("risk_orient")
def o_risk_orient():
    exprs = index_terms_sql(REFERENCE_INDEX)
    cols = ", ".join(
        f"{r6(e)} AS {t.column}_risk" for t, e in zip(REFERENCE_INDEX.terms, exprs)
    )
    return f"""{cte(PANEL_QUARTER, RISK_PANEL)}
SELECT nation_key, period_start, {cols} FROM risk_panel"""


@oracle("minmax_scale")
def o_minmax_scale():
    parts = []
    for m in PANEL_METRICS:
        x = f"CAST({m} AS DOUBLE)"
        mn = f"min({x}) OVER (PARTITION BY nation_key)"
        mx = f"max({x}) OVER (PARTITION BY nation_key)"
        e = f"CASE WHEN {mx} - {mn} = 0 THEN {D(0)} ELSE ({x} - {mn}) / ({mx} - {mn}) END"
        parts.append(f"{r6(e)} AS {m}_mm")
    return f"""{cte(PANEL_QUARTER)}
SELECT nation_key, period_start, {", ".join(parts)} FROM panel_quarter"""


@oracle("risk_index_stats")
def o_risk_index_stats():
    return f"""{cte(PANEL_QUARTER, RISK_PANEL, risk_index_cte())}
SELECT nation_key, {r6("avg(risk_index)")} AS mean, {r6("stddev_samp(risk_index)")} AS std,
       {r6("min(risk_index)")} AS min, {r6("max(risk_index)")} AS max, count(risk_index) AS n
FROM ri GROUP BY nation_key"""


@oracle("zscore")
def o_zscore():
    parts = []
    for m in PANEL_METRICS:
        x = f"CAST({m} AS DOUBLE)"
        sd = f"stddev_pop({x}) OVER (PARTITION BY nation_key)"
        e = f"({x} - avg({x}) OVER (PARTITION BY nation_key)) / (CASE WHEN {sd} = 0 THEN {D(1)} ELSE {sd} END)"
        parts.append(f"{r6(e)} AS {m}_z")
    return f"""{cte(PANEL_QUARTER)}
SELECT nation_key, period_start, {", ".join(parts)} FROM panel_quarter"""


@oracle("corr_matrix")
def o_corr_matrix():
    sel = []
    ms = PANEL_METRICS
    for i in range(len(ms)):
        for j in range(i + 1, len(ms)):
            a, b = ms[i], ms[j]
            sel.append(
                f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, "
                f"{r6(f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))')} AS corr FROM panel_quarter"
            )
    return f"""{cte(PANEL_QUARTER)}
{" UNION ALL ".join(sel)}"""


@oracle("risk_index_fixed_a")
def o_risk_index_fixed_a():
    return f"""{cte(PANEL_QUARTER, RISK_PANEL)}
SELECT nation_key, period_start, {r6(fixed_index_sql(FIXED_INDEX_A))} AS risk_index_a FROM risk_panel"""


@oracle("risk_index_fixed_b")
def o_risk_index_fixed_b():
    return f"""{cte(PANEL_QUARTER, RISK_PANEL)}
SELECT nation_key, period_start, {r6(fixed_index_sql(FIXED_INDEX_B))} AS risk_index_b FROM risk_panel"""
