"""Shared DuckDB-SQL building blocks for the oracles.

The oracle SQL is written independently of the Spark code path: plain
SQL over the raw tables, composed from these CTEs. Numeric literals are
always cast to DOUBLE (a bare ``0.3`` is DECIMAL in both engines).
"""

from __future__ import annotations


def D(x) -> str:
    """DOUBLE literal."""
    return f"CAST({float(x)!r} AS DOUBLE)"


def cte(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


def _nation_panel(name: str, grain: str) -> str:
    p = f"date_trunc('{grain}', l.l_shipdate)"
    qcol = f"CAST(quarter({p}) AS INTEGER) AS quarter," if grain == "quarter" else ""
    pcol = f"CAST({p} AS DATE) AS period_start," if grain == "quarter" else ""
    return f"""{name} AS (
  SELECT CAST(c.c_nationkey AS INTEGER) AS nation_key,
         {pcol}
         CAST(year({p}) AS INTEGER) AS year,
         {qcol}
         sum(l.l_quantity) AS volume,
         CAST(sum(CAST(round_even(l.l_extendedprice * {D(100)}, 0) AS BIGINT)) AS DOUBLE)
           / ({D(100)} * sum(l.l_quantity)) AS unit_price,
         CAST(sum(CAST(round_even(l.l_extendedprice * {D(100)}, 0) AS BIGINT)
                  * CAST(round_even(l.l_discount * {D(100)}, 0) AS BIGINT)) AS DOUBLE)
           / CAST(sum(CAST(round_even(l.l_extendedprice * {D(100)}, 0) AS BIGINT)) AS DOUBLE) AS disc_pct,
         {D(100)} * count(*) FILTER (WHERE l.l_returnflag = 'R') / count(*) AS ret_pct,
         {D(100)} * count(*) FILTER (WHERE l.l_linestatus = 'O') / count(*) AS open_pct,
         sum(CAST(CAST(round_even(l.l_extendedprice * {D(100)}, 0) AS BIGINT)
                  * (100 - CAST(round_even(l.l_discount * {D(100)}, 0) AS BIGINT))
                  * CAST(round_even(l.l_tax * {D(100)}, 0) AS BIGINT) AS DOUBLE)) / {D(1e6)} AS tax_take,
         CAST(count(DISTINCT l.l_orderkey) AS BIGINT) AS n_orders
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  GROUP BY ALL)"""


PANEL_QUARTER = _nation_panel("panel_quarter", "quarter")
PANEL_YEAR = _nation_panel("panel_year", "year")

RISK_PANEL = f"""risk_panel AS (
  SELECT *, volume AS production, unit_price AS price, ret_pct AS debt_ratio,
         disc_pct AS deficit, {D(100)} - open_pct AS employment,
         CAST(n_orders AS DOUBLE) AS rp_ratio, unit_price / {D(100)} AS revenue_share,
         tax_take AS vat_take
  FROM panel_quarter)"""

EVENTS_DAILY = """ev_bounds AS (
  SELECT min(CAST(ts AS DATE)) AS d0, max(CAST(ts AS DATE)) AS d1 FROM events),
ev_users AS (SELECT DISTINCT user_id FROM events),
ev_cal AS (
  SELECT u.user_id, CAST(g.day AS DATE) AS day
  FROM ev_users u, ev_bounds b, LATERAL generate_series(b.d0, b.d1, INTERVAL 1 DAY) AS g(day)),
ev_agg AS (
  SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n_events, sum(value) AS value,
         avg(value) AS avg_value
  FROM events GROUP BY ALL),
events_daily AS (
  SELECT c.user_id, c.day, CAST(datediff('day', b.d0, c.day) + 1 AS INTEGER) AS pos,
         CAST(coalesce(a.n_events, 0) AS BIGINT) AS n_events, a.value, a.avg_value
  FROM ev_cal c CROSS JOIN ev_bounds b
  LEFT JOIN ev_agg a ON a.user_id = c.user_id AND a.day = c.day)"""


def index_terms_sql(spec, src_alias: str = "") -> list:
    """Risk-oriented expression per index term."""
    out = []
    for t in spec.terms:
        x = f"CAST({src_alias}{t.column} AS DOUBLE)"
        if t.scale != 1.0:
            x = f"({x} * {D(t.scale)})"
        if t.direction == "direct":
            e = x
        elif t.direction == "inverse":
            e = f"({D(1)} / greatest({x}, {D(0.1)}))"
        elif t.direction == "complement":
            e = f"({D(100)} - {x})"
        elif t.direction == "complement_capped":
            e = f"({D(100)} - least({x}, {D(100)}))"
        else:
            raise ValueError(t.direction)
        out.append(e)
    return out


def fixed_index_sql(terms, multiplier: float = 100.0) -> str:
    parts = []
    for t in terms:
        x, n = t.column, D(t.norm)
        if t.kind == "capped":
            v = f"least({x} / {n}, {D(1)})"
        elif t.kind == "capped_pos":
            v = f"least(greatest({x}, {D(0)}) / {n}, {D(1)})"
        else:
            v = f"greatest({D(1)} - {x} / {n}, {D(0)})"
        parts.append(f"{D(t.weight)} * {v}")
    return "(" + " + ".join(parts) + f") * {D(multiplier)}"


def rules_sql(ruleset, colmap=None) -> str:
    colmap = colmap or {}
    parts = []
    for r in ruleset.rules:
        c = colmap.get(r.column, r.column)
        parts.append(f"coalesce(CAST({c} {r.op} {D(r.threshold)} AS INTEGER), 0)")
    return "(" + " + ".join(parts) + ")"


def r1(x: str) -> str:
    return f"(round_even(({x}) * {D(10)}, 0) / {D(10)})"


def r2(x: str) -> str:
    """Two digits, as the surveyed tables show them."""
    return f"(round_even(({x}) * {D(100)}, 0) / {D(100)})"


def r4(x: str) -> str:
    """Four digits: components and errors."""
    return f"(round_even(({x}) * {D(1e4)}, 0) / {D(1e4)})"


def r6(x: str) -> str:
    """Edge rounding, bit-identical to Spark's rint(x * 1e6) / 1e6."""
    return f"(round_even(({x}) * {D(1e6)}, 0) / {D(1e6)})"
