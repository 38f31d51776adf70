"""More SQL oracles."""

from __future__ import annotations

from .oracle import PANEL_METRICS, oracle, round_cols
from .sqlparts import D, EVENTS_DAILY, PANEL_QUARTER, PANEL_YEAR, RISK_PANEL, cte, r1, r2, r4, r6

CUT_YEAR = 1997
FIRST_ROWS = 16
LINEITEM_COLS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
EV = ["value", "avg_value"]
PQ_DOUBLE = """pq AS (SELECT * REPLACE (CAST(n_orders AS DOUBLE) AS n_orders) FROM panel_quarter),
py AS (SELECT * REPLACE (CAST(n_orders AS DOUBLE) AS n_orders) FROM panel_year)"""
M = PANEL_METRICS


def all_r6(cols):
    return ", ".join(f"{r6(c)} AS {c}" for c in cols)


@oracle("profile_table")
def o_profile_table():
    nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in LINEITEM_COLS)
    return f"""SELECT CAST(count(*) AS BIGINT) AS n_rows, {len(LINEITEM_COLS)} AS n_cols,
  CAST({nulls} AS BIGINT) AS n_nulls, '{",".join(LINEITEM_COLS)}' AS columns, CAST(min(l_shipdate) AS DATE) AS min_date,
  CAST(max(l_shipdate) AS DATE) AS max_date FROM lineitem"""


@oracle("profile_sample")
def o_profile_sample():
    first = "l_orderkey, l_linenumber, "
    rest = ", ".join(c for c in LINEITEM_COLS if c not in ("l_orderkey", "l_linenumber"))
    return f"SELECT * FROM lineitem ORDER BY {first}{rest} LIMIT 5"


@oracle("parse_period")
def o_parse_period():
    return f"""{cte(PANEL_QUARTER)},
lab AS (SELECT nation_key, CAST(year AS VARCHAR) || ' T' || CAST(quarter AS VARCHAR) AS period FROM panel_quarter),
p AS (SELECT nation_key, period,
        CAST(regexp_extract(period, '^\\s*(\\d{{4}})', 1) AS INTEGER) AS year,
        CAST(regexp_extract(period, '[Tt]\\s*([1-4])\\s*$', 1) AS INTEGER) AS quarter FROM lab)
SELECT nation_key, period, year, quarter, make_date(year, (quarter - 1) * 3 + 1, 1) AS period_start FROM p"""


@oracle("year_slice")
def o_year_slice():
    cols = ["volume", "unit_price", "disc_pct", "ret_pct", "open_pct", "tax_take"]
    return f"""{cte(PANEL_YEAR)}
SELECT nation_key, year, {round_cols(cols)}, n_orders FROM panel_year WHERE year BETWEEN 1996 AND 1999"""


@oracle("complete_rows")
def o_complete_rows():
    return f"""{cte(EVENTS_DAILY)}
SELECT user_id, day, n_events, {all_r6(EV)} FROM events_daily
WHERE value IS NOT NULL AND avg_value IS NOT NULL"""


@oracle("temporal_split")
def o_temporal_split():
    return f"""{cte(PANEL_QUARTER)}
SELECT nation_key, period_start, split FROM (
  SELECT nation_key, period_start,
         CASE WHEN coalesce(year, year(period_start)) <= 1999 THEN 'train'
              WHEN coalesce(year, year(period_start)) >= 2000 THEN 'test' END AS split
  FROM panel_quarter) WHERE split IS NOT NULL"""


@oracle("min_sample_gate")
def o_min_sample_gate():
    return f"""{cte(EVENTS_DAILY)},
ed AS (SELECT floor(max(pos) * 2 / 3) AS edge FROM events_daily),
ct AS (SELECT user_id, count(*) FILTER (WHERE pos <= edge) AS n_train, count(*) FILTER (WHERE pos > edge) AS n_test
       FROM events_daily CROSS JOIN ed WHERE value IS NOT NULL GROUP BY user_id)
SELECT * FROM ct WHERE n_train >= 10 AND n_test >= 2"""


INITIAL = f"""init_m AS (
  SELECT nation_key, period_start,
         {D(4.7)} * volume / n_orders AS production,
         {D(45)} + {D(0.5)} * ret_pct AS debt_ratio,
         {D(4.7)} * volume / n_orders * ({D(1.5)} + open_pct / {D(30)}) AS reserves,
         disc_pct AS deficit,
         {D(15)} + {D(0.5)} * open_pct AS employment,
         revenue_share, vat_take,
         row_number() OVER (PARTITION BY nation_key ORDER BY period_start DESC) AS rn
  FROM risk_panel),
init AS (SELECT * EXCLUDE (rn) FROM init_m WHERE rn = 1)"""
INITIAL_COLS = ["production", "debt_ratio", "reserves", "deficit", "employment", "revenue_share", "vat_take"]


@oracle("last_observation")
def o_last_observation():
    return f"""{cte(PANEL_QUARTER, RISK_PANEL, INITIAL)}
SELECT nation_key, period_start, {all_r6(INITIAL_COLS)} FROM init"""


@oracle("quarter_calendar")
def o_quarter_calendar():
    return f"""{cte(PANEL_QUARTER)},
b AS (SELECT nation_key, min(period_start) AS d0, max(period_start) AS d1 FROM panel_quarter GROUP BY 1)
SELECT b.nation_key, CAST(g.d AS DATE) AS period_start
FROM b, LATERAL generate_series(b.d0, b.d1, INTERVAL 3 MONTH) AS g(d)"""


@oracle("first_n")
def o_first_n():
    cols = ["volume", "unit_price", "disc_pct", "ret_pct", "open_pct", "tax_take"]
    return f"""{cte(PANEL_QUARTER)}
SELECT nation_key, period_start, year, quarter, {round_cols(cols)}, n_orders FROM (
  SELECT *, row_number() OVER (PARTITION BY nation_key ORDER BY period_start) AS rn FROM panel_quarter)
WHERE rn <= {FIRST_ROWS}"""


@oracle("clip_bounds")
def o_clip_bounds():
    return f"""{cte(PANEL_QUARTER, RISK_PANEL)}
SELECT nation_key, period_start,
  {r6(f"least(debt_ratio, {D(40)})")} AS debt_ratio,
  {r6(f"greatest(rp_ratio, {D(25)})")} AS rp_ratio,
  {r6(f"least(greatest(deficit, {D(4)}), {D(6)})")} AS deficit
FROM risk_panel"""


# ---------------------------------------------------------------- cleaning SQL


def interp_sql(src: str, name: str, key: str, order: str, cols, pos: str | None = None) -> str:
    """CTE ``name``: position-based linear interpolation of ``cols``."""
    i = f"CAST({pos} AS DOUBLE)" if pos else f"CAST(row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS DOUBLE)"
    helpers = []
    for c in cols:
        at = f"CASE WHEN {c} IS NOT NULL THEN __i END"
        helpers.append(
            f"last_value({c} IGNORE NULLS) OVER pre AS __lv_{c}, last_value({at} IGNORE NULLS) OVER pre AS __li_{c}, "
            f"first_value({c} IGNORE NULLS) OVER post AS __nv_{c}, first_value({at} IGNORE NULLS) OVER post AS __ni_{c}"
        )
    repl = ", ".join(
        f"coalesce({c}, __lv_{c} + (__nv_{c} - __lv_{c}) * (__i - __li_{c}) / (__ni_{c} - __li_{c}), __lv_{c}, __nv_{c}) AS {c}"
        for c in cols
    )
    excl = ", ".join(["__i"] + [f"__{p}_{c}" for c in cols for p in ("lv", "li", "nv", "ni")])
    return f"""{name}_p AS (SELECT *, {i} AS __i FROM {src}),
{name}_h AS (SELECT *, {", ".join(helpers)} FROM {name}_p
  WINDOW pre AS (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         post AS (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{name} AS (SELECT * EXCLUDE ({excl}) REPLACE ({repl}) FROM {name}_h)"""


def fill_sql(src: str, name: str, key: str, order: str, cols) -> str:
    repl = ", ".join(
        f"coalesce({c}, last_value({c} IGNORE NULLS) OVER pre, first_value({c} IGNORE NULLS) OVER post) AS {c}"
        for c in cols
    )
    return f"""{name} AS (SELECT * REPLACE ({repl}) FROM {src}
  WINDOW pre AS (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         post AS (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def winsor_sql(src: str, name: str, key: str, cols, k: float = 1.5) -> str:
    qs = ", ".join(
        f"quantile_cont({c}, 0.25) OVER w AS __q1_{c}, quantile_cont({c}, 0.75) OVER w AS __q3_{c}" for c in cols
    )
    repl = ", ".join(
        f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest({c}, __q1_{c} - {D(k)} * (__q3_{c} - __q1_{c})), "
        f"__q3_{c} + {D(k)} * (__q3_{c} - __q1_{c})) END AS {c}"
        for c in cols
    )
    excl = ", ".join(f"__q{j}_{c}" for c in cols for j in (1, 3))
    return f"""{name}_q AS (SELECT *, {qs} FROM {src} WINDOW w AS (PARTITION BY {key})),
{name} AS (SELECT * EXCLUDE ({excl}) REPLACE ({repl}) FROM {name}_q)"""


def clean_sql(src: str, name: str, key: str, order: str, cols) -> str:
    return ",\n".join(
        [
            interp_sql(src, f"{name}_c1", key, order, cols),
            fill_sql(f"{name}_c1", f"{name}_c2", key, order, cols),
            winsor_sql(f"{name}_c2", name, key, cols),
        ]
    )


@oracle("interpolate_linear")
def o_interpolate_linear():
    return f"""{cte(EVENTS_DAILY, interp_sql("events_daily", "ip", "user_id", "day", EV, pos="pos"))}
SELECT user_id, day, {all_r6(EV)} FROM ip"""


@oracle("fill_forward_back")
def o_fill_forward_back():
    return f"""{cte(EVENTS_DAILY, fill_sql("events_daily", "ff", "user_id", "day", EV))}
SELECT user_id, day, {all_r6(EV)} FROM ff"""


@oracle("iqr_winsorize")
def o_iqr_winsorize():
    return f"""{cte(PANEL_QUARTER, PANEL_YEAR, PQ_DOUBLE, winsor_sql("pq", "wz", "nation_key", M))}
SELECT nation_key, period_start, {all_r6(M)} FROM wz"""


@oracle("iqr_outlier_report")
def o_iqr_outlier_report():
    return f"""{cte(PANEL_QUARTER, PANEL_YEAR, PQ_DOUBLE)},
lng AS (UNPIVOT (SELECT nation_key, {", ".join(M)} FROM pq) ON {", ".join(M)} INTO NAME "column" VALUE value),
qq AS (SELECT *, quantile_cont(value, 0.25) OVER w AS q1, quantile_cont(value, 0.75) OVER w AS q3
       FROM lng WINDOW w AS (PARTITION BY nation_key, "column")),
bb AS (SELECT *, q1 - {D(1.5)} * (q3 - q1) AS lower, q3 + {D(1.5)} * (q3 - q1) AS upper FROM qq)
SELECT nation_key, "column", {r6("first(lower)")} AS lower, {r6("first(upper)")} AS upper,
       count(*) FILTER (WHERE value < lower OR value > upper) AS n_outliers
FROM bb GROUP BY nation_key, "column\""""


@oracle("null_counts")
def o_null_counts():
    cols = ["user_id", "day", "pos", "n_events", "value", "avg_value"]
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM events_daily" for c in cols
    )
    return f"""{cte(EVENTS_DAILY)}
{parts}"""


# ---------------------------------------------------------------- disaggregation SQL


def trend_sql(src: str, name: str, cols) -> str:
    bs = ", ".join(
        f"CASE WHEN count({c}) OVER w = 1 THEN {D(10)} * {c} / {D(116)} "
        f"ELSE regr_slope({c}, __pos) OVER w / {D(16)} END AS __b_{c}"
        for c in cols
    )
    vals = ", ".join(f"{c} / {D(4)} + {D(1)} * __b_{c} * (CAST(t.q AS DOUBLE) - {D(2.5)}) AS {c}" for c in cols)
    return f"""{name}_a AS (SELECT nation_key, year, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)},
    CAST(row_number() OVER (PARTITION BY nation_key ORDER BY year) AS DOUBLE) AS __pos FROM {src}),
{name}_b AS (SELECT *, {bs} FROM {name}_a WINDOW w AS (PARTITION BY nation_key)),
{name} AS (SELECT nation_key, year, CAST(t.q AS INTEGER) AS quarter,
    make_date(year, (CAST(t.q AS INTEGER) - 1) * 3 + 1, 1) AS period_start, {vals}
  FROM {name}_b, range(1, 5) AS t(q))"""


def indicator_sql(annual: str, ind: str, name: str, cols) -> str:
    xs = ", ".join(f"CAST({c} AS DOUBLE) AS __x_{c}" for c in cols)
    ss = ", ".join(f"sum(__x_{c}) OVER (PARTITION BY nation_key, year) AS __s_{c}" for c in cols)
    bs = ", ".join(
        f"CASE WHEN sum(__x_{c} * __s_{c}) OVER w = 0 THEN {D(0)} "
        f"ELSE sum(__x_{c} * {c}) OVER w / sum(__x_{c} * __s_{c}) OVER w END AS __beta_{c}"
        for c in cols
    )
    vals = ", ".join(
        f"{D(1)} * (__beta_{c} * __x_{c} + ({c} - __beta_{c} * __s_{c}) / {D(4)}) AS {c}" for c in cols
    )
    return f"""{name}_a AS (SELECT nation_key, year, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)},
    row_number() OVER (PARTITION BY nation_key ORDER BY year) AS __pos,
    count(*) OVER (PARTITION BY nation_key) AS __n_a FROM {annual}),
{name}_i AS (SELECT nation_key, period_start, {xs},
    row_number() OVER (PARTITION BY nation_key ORDER BY period_start) AS __qpos,
    count(*) OVER (PARTITION BY nation_key) AS __n_i FROM {ind}),
{name}_j AS (SELECT a.nation_key, a.year, CAST((i.__qpos - 1) % 4 + 1 AS INTEGER) AS quarter,
    {", ".join(f"a.{c}" for c in cols)}, {", ".join(f"i.__x_{c}" for c in cols)}
  FROM {name}_i i JOIN {name}_a a ON i.nation_key = a.nation_key AND (i.__qpos - 1) // 4 + 1 = a.__pos
  WHERE i.__n_i >= 4 * a.__n_a),
{name}_s AS (SELECT *, {ss} FROM {name}_j),
{name}_b AS (SELECT *, {bs} FROM {name}_s WINDOW w AS (PARTITION BY nation_key)),
{name} AS (SELECT nation_key, year, quarter, make_date(year, (quarter - 1) * 3 + 1, 1) AS period_start, {vals}
  FROM {name}_b)"""


DIS_COLS = ["nation_key", "year", "quarter", "period_start"]


@oracle("disaggregate_trend")
def o_disaggregate_trend():
    return f"""{cte(PANEL_QUARTER, PANEL_YEAR, PQ_DOUBLE, trend_sql("py", "tr", M))}
SELECT {", ".join(DIS_COLS)}, {all_r6(M)} FROM tr"""


@oracle("disaggregate_indicator")
def o_disaggregate_indicator():
    return f"""{cte(PANEL_QUARTER, PANEL_YEAR, PQ_DOUBLE, indicator_sql("py", "pq", "di", M))}
SELECT {", ".join(DIS_COLS)}, {all_r6(M)} FROM di"""


def check_sql(name: str, branch: str) -> str:
    diffs = " UNION ALL ".join(
        f"SELECT s.nation_key, '{c}' AS metric, abs(s.{c} - a.{c}) AS diff FROM {name}_sum s "
        f"JOIN py a ON s.nation_key = a.nation_key AND s.year = a.year"
        for c in M
    )
    return f"""{name}_sum AS (SELECT nation_key, year, {", ".join(f"sum({c}) AS {c}" for c in M)} FROM {name} GROUP BY ALL),
{name}_chk AS (SELECT nation_key, metric, {r6("max(diff)")} AS max_abs_diff, '{branch}' AS branch
  FROM ({diffs}) GROUP BY ALL)"""


@oracle("disaggregate_check")
def o_disaggregate_check():
    return f"""{cte(PANEL_QUARTER, PANEL_YEAR, PQ_DOUBLE, trend_sql("py", "tr", M), indicator_sql("py", "pq", "di", M),
          check_sql("tr", "trend"), check_sql("di", "indicator"))}
SELECT * FROM tr_chk UNION ALL SELECT * FROM di_chk"""


def auto_sql(annual: str, quarterly: str, name: str) -> str:
    """Per-key branch: indicator (the whole quarterly series) when long enough, else trend."""
    return ",\n".join(
        [
            indicator_sql(annual, quarterly, f"{name}_di", M),
            trend_sql(annual, f"{name}_tr", M),
            f"""{name} AS (SELECT * FROM {name}_di UNION ALL
  SELECT * FROM {name}_tr WHERE nation_key NOT IN (SELECT nation_key FROM {name}_di))""",
        ]
    )


ANNUAL = f"ann AS (SELECT * FROM py WHERE year <= {CUT_YEAR})"
QUARTERLY = f"qtr AS (SELECT * FROM pq WHERE year > {CUT_YEAR})"


@oracle("disaggregate_all")
def o_disaggregate_all():
    return f"""{cte(PANEL_QUARTER, PANEL_YEAR, PQ_DOUBLE, ANNUAL, QUARTERLY, auto_sql("ann", "qtr", "da"))}
SELECT {", ".join(DIS_COLS)}, {all_r6(M)} FROM da"""


@oracle("disaggregate_trend_all")
def o_disaggregate_trend_all():
    return f"""{cte(PANEL_QUARTER, PANEL_YEAR, PQ_DOUBLE, ANNUAL, trend_sql("ann", "da", M))}
SELECT {", ".join(DIS_COLS)}, {all_r6(M)} FROM da"""


@oracle("disaggregate_indicator_all")
def o_disaggregate_indicator_all():
    return f"""{cte(PANEL_QUARTER, PANEL_YEAR, PQ_DOUBLE, ANNUAL, QUARTERLY, indicator_sql("ann", "qtr", "da", M))}
SELECT {", ".join(DIS_COLS)}, {all_r6(M)} FROM da"""


MASTER_SEL = f"{', '.join(DIS_COLS)}, {', '.join(M)}"


@oracle("harmonize_panel")
def o_harmonize_panel():
    return f"""{cte(PANEL_QUARTER, PANEL_YEAR, PQ_DOUBLE, ANNUAL, QUARTERLY, trend_sql("ann", "da", M))},
h AS (SELECT {MASTER_SEL} FROM da UNION ALL SELECT {MASTER_SEL} FROM qtr)
SELECT {", ".join(DIS_COLS)}, {all_r6(M)} FROM h"""


def master_sql(branch: str) -> str:
    return cte(
        PANEL_QUARTER,
        PANEL_YEAR,
        PQ_DOUBLE,
        ANNUAL,
        QUARTERLY,
        clean_sql("ann", "ann_c", "nation_key", "year", M),
        clean_sql("qtr", "qtr_c", "nation_key", "period_start", M),
        trend_sql("ann_c", "mda", M) if branch == "trend" else indicator_sql("ann_c", "qtr_c", "mda", M),
        f"mh AS (SELECT {MASTER_SEL} FROM mda UNION ALL SELECT {MASTER_SEL} FROM qtr_c)",
        clean_sql("mh", "master", "nation_key", "period_start", M),
    )


@oracle("clean_two_pass")
def o_clean_two_pass():
    return f"""{master_sql("indicator")}
SELECT {", ".join(DIS_COLS)}, {all_r6(M)} FROM master"""


@oracle("master_panel")
def o_master_panel():
    return f"""{master_sql("trend")}
SELECT {", ".join(DIS_COLS)}, {all_r6(M)} FROM master"""


# ---------------------------------------------------------------- rules / projections SQL

from ..specs import FIXED_INDEX_B, REFERENCE_RULES, REFERENCE_SCENARIOS, Horizon  # noqa: E402
from .oracle import risk_index_cte  # noqa: E402
from .sqlparts import fixed_index_sql, rules_sql  # noqa: E402

H = Horizon()


PANEL_RULES = [("ret_pct", ">", 36.0), ("open_pct", ">", 52.0), ("disc_pct", ">", 5.2),
               ("unit_price", "<", 2100.0), ("n_orders", "<", 60.0), ("risk_index", ">", 60.0)]


def scored_cte() -> str:
    """CTE ``sp``: every nation-quarter with its rule score (breach at 3)."""
    s = " + ".join(f"coalesce(CAST(CAST({c} AS DOUBLE) {op} {D(v)} AS INTEGER), 0)" for c, op, v in PANEL_RULES)
    return f"""{cte(PANEL_QUARTER, RISK_PANEL, risk_index_cte())},
sp AS (SELECT *, CAST({s} AS INTEGER) AS score, ({s}) >= 3 AS breach FROM ri)"""


@oracle("breach_score")
def o_breach_score():
    return f"""{scored_cte()}
SELECT nation_key, period_start, score, breach FROM sp"""


SCEN_VALUES = "scen(scenario, price, growth, decline, trend) AS (VALUES " + ", ".join(
    f"('{s.name}', {D(s.price)}, {D(s.growth)}, {D(s.decline)}, {D(s.deficit_trend)})" for s in REFERENCE_SCENARIOS
) + ")"


@oracle("scenario_grid")
def o_scenario_grid():
    return f"""{cte(PANEL_QUARTER, RISK_PANEL, INITIAL, SCEN_VALUES)}
SELECT i.nation_key, s.scenario, CAST(y.year AS INTEGER) AS year
FROM init i, scen s, range({H.start_year}, {H.end_year + 1}) AS y(year)"""


def scenario_sql() -> str:
    """CTE ``proj``: unrolled deterministic scenario recurrence."""
    steps = [
        f"""sc0 AS (SELECT i.nation_key, s.scenario, s.price, s.growth, s.decline, s.trend,
    i.production AS q, i.debt_ratio AS d, i.reserves AS r, i.deficit AS def FROM init i, scen s)"""
    ]
    outs = []
    for t in range(1, H.years + 1):
        p = f"sc{t - 1}"
        steps.append(
            f"""sc{t}a AS (SELECT *, greatest(q * ({D(1)} + decline), {D(50)}) AS nq FROM {p}),
sc{t}b AS (SELECT nation_key, scenario, price, growth, decline, trend, nq AS q,
    greatest(r - nq * {D(365)} / {D(1000)}, {D(0)}) AS r,
    greatest(d * {D(1.0 + 0.05)} / ({D(1)} + growth / {D(100)}) + def * {D(0.5)}, {D(10)}) AS d,
    def + trend AS def FROM sc{t}a),
sc{t}c AS (SELECT *, CASE WHEN q > 0 THEN r / (q * {D(365)} / {D(1000)}) ELSE {D(0)} END AS rp_ratio,
    least(greatest({D(11)} * (price / {D(65)}) * (q / {D(470)}) * {D(0.85)}, {D(2)}), {D(25)}) AS revenue_share,
    {D(8300)} * ({D(1)} + growth / {D(100)}) AS vat_take,
    {D(38)} + growth * {D(2)} AS employment FROM sc{t}b),
sc{t}d AS (SELECT *, {fixed_index_sql(FIXED_INDEX_B).replace("debt_ratio", "d").replace("deficit", "def")} AS risk_index FROM sc{t}c),
sc{t}e AS (SELECT *, CAST({rules_sql(REFERENCE_RULES, {"debt_ratio": "d", "deficit": "def", "production": "q", "reserves": "r"})} AS INTEGER) AS collapse_score FROM sc{t}d),
sc{t} AS (SELECT nation_key, scenario, price, growth, decline, trend, q, d, r, def FROM sc{t}e)"""
        )
        outs.append(
            f"""SELECT nation_key, scenario, {H.start_year + t - 1} AS year, q AS production, price, growth AS gdp_growth,
    d AS debt_ratio, r AS reserves, revenue_share, vat_take, def AS deficit, employment, rp_ratio,
    q * price * {D(365)} / {D(1000)} * {D(0.65)} AS exports, {D(14.3)} * (revenue_share / {D(11)}) AS investment,
    risk_index, collapse_score, collapse_score >= {REFERENCE_RULES.breach_at} AS collapse FROM sc{t}e"""
        )
    return ",\n".join(steps) + ",\nproj AS (" + "\nUNION ALL\n".join(outs) + ")"


PROJ_D = ["production", "price", "gdp_growth", "debt_ratio", "reserves", "revenue_share", "vat_take", "deficit",
          "employment", "rp_ratio", "exports", "investment", "risk_index"]


@oracle("scenario_projection")
def o_scenario_projection():
    return f"""{cte(PANEL_QUARTER, RISK_PANEL, INITIAL, SCEN_VALUES, scenario_sql())}
SELECT nation_key, scenario, year, {r6("price")} AS price, {r6("gdp_growth")} AS gdp_growth,
  {", ".join(f"{r2(c)} AS {c}" for c in PROJ_D if c not in ("price", "gdp_growth"))}, collapse_score, collapse FROM proj"""


@oracle("scenario_collapse_share")
def o_scenario_collapse_share():
    return f"""{cte(PANEL_QUARTER, RISK_PANEL, INITIAL, SCEN_VALUES, scenario_sql())}
SELECT nation_key, scenario, {r6("avg(CAST(collapse AS DOUBLE))")} AS collapse_share FROM proj GROUP BY ALL"""


@oracle("scenario_comparison")
def o_scenario_comparison():
    return f"""{cte(PANEL_QUARTER, RISK_PANEL, INITIAL, SCEN_VALUES, scenario_sql())}
SELECT nation_key, upper(substr(scenario, 1, 1)) || lower(substr(scenario, 2)) AS scenario, year,
  {", ".join(f"{r2(c)} AS {c}" for c in ("production", "debt_ratio", "reserves", "risk_index"))}, collapse_score,
  CASE WHEN collapse THEN 'SÍ' ELSE 'NO' END AS collapse
FROM proj WHERE year = {H.end_year}"""


# ---- summaries of the scored panel


@oracle("collapse_probability")
def o_collapse_probability():
    return f"""{scored_cte()}
SELECT nation_key, count(*) AS n_obs, {r6("avg(CAST(breach AS DOUBLE))")} AS p_collapse FROM sp GROUP BY ALL"""


@oracle("yearly_collapse_rate")
def o_yearly_collapse_rate():
    return f"""{scored_cte()}
SELECT nation_key, year, {r6("avg(CAST(breach AS DOUBLE))")} AS collapse_rate FROM sp GROUP BY ALL"""


def histogram_sql() -> str:
    return f"""{scored_cte()},
keys AS (SELECT DISTINCT nation_key FROM sp),
cnt AS (SELECT nation_key, score, count(*) AS n FROM sp GROUP BY ALL),
hg AS (SELECT k.nation_key, CAST(s.score AS INTEGER) AS score, coalesce(c.n, 0) AS n_obs
  FROM keys k CROSS JOIN range(0, {len(PANEL_RULES) + 1}) AS s(score)
  LEFT JOIN cnt c ON c.nation_key = k.nation_key AND c.score = s.score)"""


@oracle("score_histogram")
def o_score_histogram():
    return f"""{histogram_sql()}
SELECT * FROM hg"""


@oracle("path_summary")
def o_path_summary():
    s = "CAST(score AS DOUBLE)"
    means = ", ".join(f"{r1(f'avg(CAST({c} AS DOUBLE))')} AS mean_{c}" for c in ("production", "debt_ratio", "rp_ratio"))
    return f"""{scored_cte()}
SELECT nation_key, count(*) AS n_obs, {r2(f"avg(CAST(breach AS DOUBLE)) * {D(100)}")} AS collapse_pct,
  {r2(f"avg({s})")} AS mean_score, {r2(f"median({s})")} AS median_score, {r2(f"stddev_pop({s})")} AS std_score,
  {means}
FROM sp GROUP BY ALL"""


@oracle("traffic_light")
def o_traffic_light():
    return f"""{scored_cte()},
pc AS (SELECT nation_key, count(*) AS n_obs, avg(CAST(breach AS DOUBLE)) AS p FROM sp GROUP BY ALL)
SELECT nation_key, n_obs, {r6("p")} AS p_collapse,
  CASE WHEN p < {D(0.3)} THEN 'VERDE' WHEN p < {D(0.6)} THEN 'AMARILLO' ELSE 'ROJO' END AS light FROM pc"""


# ---------------------------------------------------------------- evaluation SQL

SPLIT = f"""sp AS (SELECT *, CASE WHEN coalesce(year, year(period_start)) <= 1999 THEN 'train'
                             WHEN coalesce(year, year(period_start)) >= 2000 THEN 'test' END AS split FROM pq),
nb AS (SELECT nation_key, arg_max(volume, period_start) FILTER (WHERE split = 'train') AS last_v,
              avg(volume) FILTER (WHERE split = 'train') AS mean_v FROM sp GROUP BY nation_key),
fc AS (SELECT s.nation_key, s.period_start, CAST(s.volume AS DOUBLE) AS y_true, m.model, m.y_pred
       FROM sp s JOIN nb USING (nation_key),
       LATERAL (VALUES ('last_value', CAST(nb.last_v AS DOUBLE)), ('train_mean', CAST(nb.mean_v AS DOUBLE))) AS m(model, y_pred)
       WHERE s.split = 'test')"""


def metrics_sql(src: str, keys: str) -> str:
    return f"""SELECT {keys}, {r6("avg(abs(y_true - y_pred))")} AS mae,
  {r6("sqrt(avg((y_true - y_pred) * (y_true - y_pred)))")} AS rmse,
  {r6(f"CASE WHEN min(y_true) = max(y_true) THEN CASE WHEN sum(abs(y_true - y_pred)) = 0 THEN {D(1)} ELSE {D(0)} END ELSE {D(1)} - sum((y_true - y_pred) * (y_true - y_pred)) / sum(pow(y_true - ybar, 2)) END")} AS r2,
  {r6(f"coalesce(avg(CASE WHEN y_true <> 0 THEN abs((y_true - y_pred) / y_true) END) * {D(100)}, {D(0)})")} AS mape,
  count(*) AS n
FROM (SELECT *, avg(y_true) OVER (PARTITION BY {keys}) AS ybar FROM {src}) GROUP BY {keys}"""


@oracle("regression_metrics")
def o_regression_metrics():
    return f"""{cte(PANEL_QUARTER, PANEL_YEAR, PQ_DOUBLE, SPLIT)}
{metrics_sql("fc", "model, nation_key")}"""


@oracle("backtest_metrics")
def o_backtest_metrics():
    return f"""{cte(PANEL_QUARTER, PANEL_YEAR, PQ_DOUBLE, SPLIT)},
mm AS ({metrics_sql("fc", "model")})
SELECT model, mae, rmse, r2, mape,
  (SELECT count(*) FROM sp WHERE split = 'train') AS n_train, (SELECT count(*) FROM sp WHERE split = 'test') AS n_test
FROM mm"""


@oracle("backtest_series")
def o_backtest_series():
    return f"""{cte(PANEL_QUARTER, PANEL_YEAR, PQ_DOUBLE, SPLIT)}
SELECT nation_key, period_start, model, {r6("y_true")} AS y_true, {r6("y_pred")} AS y_pred,
  {r6("y_pred - y_true")} AS error, {r6(f"y_pred * {D(0.9)}")} AS lower, {r6(f"y_pred * {D(1.1)}")} AS upper FROM fc"""


@oracle("cv_folds")
def o_cv_folds():
    return f"""{cte(PANEL_QUARTER)}
SELECT nation_key, period_start, CAST(ntile(3) OVER (PARTITION BY nation_key ORDER BY period_start) - 1 AS INTEGER) AS fold
FROM panel_quarter"""


# The fit is found here by a recursive search: λ is halved around the better
# side of the profile error's slope, from the best of 400 starting cells.
PROD = f"""prod AS (SELECT nation_key, period_start, {D(4.7)} * volume / n_orders AS production FROM panel_quarter),
pts AS (SELECT nation_key, CAST(row_number() OVER w - 1 AS DOUBLE) AS t, production AS y,
   first_value(production) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS y0
   FROM prod WINDOW w AS (PARTITION BY nation_key ORDER BY period_start)),
ser AS (SELECT nation_key, list(y ORDER BY t) AS ys, list(t ORDER BY t) AS ts, first(y0) AS y0, count(*) AS n FROM pts GROUP BY nation_key),
cell AS (SELECT p.nation_key, g.j, {D(0.001)} + CAST(g.j AS DOUBLE) * {D(0.199 / 400)} AS lam,
   sum(y * exp(-({D(0.001)} + CAST(g.j AS DOUBLE) * {D(0.199 / 400)}) * t)) AS a,
   sum(exp({D(-2)} * ({D(0.001)} + CAST(g.j AS DOUBLE) * {D(0.199 / 400)}) * t)) AS b
   FROM pts p, range(0, 401) AS g(j) GROUP BY ALL),
start AS (SELECT nation_key, arg_min(lam, least(greatest(a / b, {D(100)}), {D(1000)}) * least(greatest(a / b, {D(100)}), {D(1000)}) * b
   - {D(2)} * least(greatest(a / b, {D(100)}), {D(1000)}) * a) AS lam0 FROM cell GROUP BY nation_key),
fit0 AS (SELECT nation_key, 0 AS i, greatest(lam0 - {D(0.199 / 400)}, {D(0.001)}) AS lo, least(lam0 + {D(0.199 / 400)}, {D(0.2)}) AS hi FROM start),
step AS (
  WITH RECURSIVE r AS (
    SELECT * FROM fit0
    UNION ALL
    SELECT nation_key, i + 1, CASE WHEN e1 <= e2 THEN lo ELSE m1 END, CASE WHEN e1 <= e2 THEN m2 ELSE hi END
    FROM (SELECT nation_key, i, lo, hi, m1, m2,
        q1 * q1 * b1 - 2 * q1 * a1 AS e1, q2 * q2 * b2 - 2 * q2 * a2 AS e2
      FROM (SELECT *, least(greatest(a1 / b1, 100), 1000) AS q1, least(greatest(a2 / b2, 100), 1000) AS q2
        FROM (SELECT r.nation_key, r.i, r.lo, r.hi, r.lo + (r.hi - r.lo) / 3 AS m1, r.hi - (r.hi - r.lo) / 3 AS m2,
            sum(p.y * exp(-(r.lo + (r.hi - r.lo) / 3) * p.t)) AS a1, sum(exp(-2 * (r.lo + (r.hi - r.lo) / 3) * p.t)) AS b1,
            sum(p.y * exp(-(r.hi - (r.hi - r.lo) / 3) * p.t)) AS a2, sum(exp(-2 * (r.hi - (r.hi - r.lo) / 3) * p.t)) AS b2
          FROM r JOIN pts p USING (nation_key) WHERE r.i < 36 GROUP BY r.nation_key, r.i, r.lo, r.hi))))
  SELECT nation_key, (lo + hi) / 2 AS lam FROM r WHERE i = 36),
best AS (SELECT s.nation_key, s.lam, least(greatest(sum(p.y * exp(-s.lam * p.t)) / sum(exp(-2 * s.lam * p.t)), 100), 1000) AS q
  FROM step s JOIN pts p USING (nation_key) GROUP BY s.nation_key, s.lam),
dfit AS (SELECT nation_key, n,
   CASE WHEN y0 >= 100 AND y0 <= 1000 THEN q ELSE y0 END AS q,
   CASE WHEN y0 >= 100 AND y0 <= 1000 THEN lam ELSE {D(0.035)} END AS lam,
   y0 >= 100 AND y0 <= 1000 AS fitted FROM best JOIN ser USING (nation_key))"""


@oracle("decline_fit")
def o_decline_fit():
    return f"""{cte(PANEL_QUARTER, PROD)}
SELECT nation_key, round(q, 2) AS q, round(lam, 5) AS lam, fitted FROM dfit"""


@oracle("decline_curve")
def o_decline_curve():
    return f"""{cte(PANEL_QUARTER, PROD)}
SELECT nation_key, CAST(g.t AS INTEGER) AS t, round(q * exp(-lam * CAST(g.t AS DOUBLE)), 1) AS y_decline
FROM dfit, LATERAL range(n, 2 * n) AS g(t)"""


@oracle("component_errors")
def o_component_errors():
    return f"""{cte(PANEL_QUARTER, PROD)},
s AS (SELECT nation_key, production AS y_true, CAST(row_number() OVER w - 1 AS DOUBLE) AS t,
   coalesce(lag(production) OVER w, production) AS y_ml FROM prod WINDOW w AS (PARTITION BY nation_key ORDER BY period_start)),
p AS (SELECT s.*, d.q * exp(-d.lam * s.t) AS y_decline FROM s JOIN dfit d USING (nation_key)),
pp AS (SELECT *, {D(0.5)} * y_ml + {D(0.5)} * y_decline AS y_pred, avg(y_true) OVER (PARTITION BY nation_key) AS ybar FROM p)
SELECT nation_key, round(avg(abs(y_true - y_pred)), 3) AS mae, round(sqrt(avg((y_true - y_pred) * (y_true - y_pred))), 3) AS rmse,
  round({D(1)} - sum((y_true - y_pred) * (y_true - y_pred)) / sum(pow(y_true - ybar, 2)), 3) AS r2,
  round(avg(abs(y_true - y_ml)), 3) AS mae_ml, round(avg(abs(y_true - y_decline)), 3) AS mae_decline
FROM pp GROUP BY nation_key"""


# ---------------------------------------------------------------- regimes SQL

PTS = """pl AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x,
         unnest(generate_series(0, len(embedding) - 1)) AS d FROM embeddings),
px AS (SELECT vec_id, label, sum(x * x) AS xx FROM pl GROUP BY ALL),
cs AS (SELECT label AS c, d, sum(x) AS s FROM pl GROUP BY ALL),
cn AS (SELECT label AS c, count(*) AS n, sum(xx) AS q FROM px GROUP BY label),
cq AS (SELECT c, sum(s * s) AS ss FROM cs GROUP BY c)"""

NAME_CASE = (
    "CASE {c} "
    + " ".join(f"WHEN {k} THEN '{v}'" for k, v in __import__("panelrisk.specs", fromlist=["REGIME_NAMES"]).REGIME_NAMES.items())
    + " ELSE 'Clúster ' || CAST({c} AS VARCHAR) END"
)


@oracle("silhouette")
def o_silhouette():
    # Mean squared distance to a cluster: to its centroid, plus the cluster's own spread.
    return f"""{cte(PTS)},
ce AS (SELECT label AS c, d, avg(x) AS m FROM pl GROUP BY ALL),
far AS (SELECT p.vec_id, p.label, ce.c, sum((p.x - ce.m) * (p.x - ce.m)) AS sq FROM pl p JOIN ce ON p.d = ce.d GROUP BY ALL),
own AS (SELECT c, count(*) AS n, avg(sq) AS spread FROM far WHERE c = label GROUP BY c),
md AS (SELECT f.vec_id, f.label, f.c, o.n, f.sq + o.spread AS mean_sq FROM far f JOIN own o USING (c)),
ab AS (SELECT vec_id, label,
         max(CASE WHEN c = label THEN n END) AS n_own,
         max(CASE WHEN c = label AND n > 1 THEN mean_sq * n / (n - 1) END) AS a,
         min(CASE WHEN c <> label THEN mean_sq END) AS b FROM md GROUP BY vec_id, label)
SELECT vec_id, label, {r6(f"CASE WHEN n_own <= 1 OR b IS NULL THEN {D(0)} ELSE (b - a) / greatest(a, b) END")} AS silhouette FROM ab"""


@oracle("silhouette_score")
def o_silhouette_score():
    # In the mean of all points, from whole pairwise distances (not the centroid form).
    return f"""{cte(PTS)},
pr AS (SELECT a.vec_id, a.label, b.label AS c, sum((a.x - b.x) * (a.x - b.x)) AS sq
       FROM pl a JOIN pl b ON a.d = b.d AND a.vec_id <> b.vec_id GROUP BY a.vec_id, a.label, b.vec_id, b.label),
mn AS (SELECT vec_id, label, c, avg(sq) AS m FROM pr GROUP BY ALL),
ab AS (SELECT vec_id, label, max(CASE WHEN c = label THEN m END) AS a, min(CASE WHEN c <> label THEN m END) AS b FROM mn GROUP BY vec_id, label)
SELECT {r6(f"avg(CASE WHEN a IS NULL OR b IS NULL THEN {D(0)} ELSE (b - a) / greatest(a, b) END)")} AS silhouette FROM ab"""


# Every pair of points, with the distance itself.
EUCLIDEAN = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
me AS (SELECT p.vec_id, p.label, q.label AS c, sum(list_distance(p.x, q.x)) AS total, count(*) AS n
  FROM e p JOIN e q ON p.vec_id <> q.vec_id GROUP BY p.vec_id, p.label, q.label),
ae AS (SELECT vec_id, label, max(CASE WHEN c = label THEN total / n END) AS a, min(CASE WHEN c <> label THEN total / n END) AS b
  FROM me GROUP BY vec_id, label),
se AS (SELECT vec_id, label, CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ae)"""


@oracle("silhouette_euclidean")
def o_silhouette_euclidean():
    return f"{cte(EUCLIDEAN)} SELECT vec_id, label, {r6('s')} AS silhouette FROM se"


@oracle("silhouette_score_euclidean")
def o_silhouette_score_euclidean():
    return f"{cte(EUCLIDEAN)} SELECT {r6('avg(s)')} AS silhouette FROM se"


@oracle("cluster_inertia")
def o_cluster_inertia():
    return f"""{cte(PTS)},
ce AS (SELECT label, d, avg(x) AS c FROM pl GROUP BY ALL),
dd AS (SELECT p.label, p.vec_id, sum((p.x - ce.c) * (p.x - ce.c)) AS sq FROM pl p JOIN ce USING (label, d) GROUP BY ALL)
SELECT label, count(*) AS n, {r6("sum(sq)")} AS inertia FROM dd GROUP BY label"""


@oracle("cluster_centroids")
def o_cluster_centroids():
    return f"""{cte(PTS)}
SELECT label, CAST(d AS INTEGER) AS dim, {r6("avg(x)")} AS value FROM pl GROUP BY ALL"""


@oracle("cluster_sizes")
def o_cluster_sizes():
    return f"""SELECT label, count(*) AS n, {NAME_CASE.format(c="label")} AS regime_name FROM embeddings GROUP BY label"""


@oracle("regime_names")
def o_regime_names():
    return f"""SELECT vec_id, label, {NAME_CASE.format(c="label")} AS regime_name FROM embeddings"""


@oracle("regime_summary")
def o_regime_summary():
    return f"""{cte(PTS)}
SELECT {NAME_CASE.format(c="label")} AS regime_name, CAST(d AS INTEGER) AS dim, {r2("avg(x)")} AS mean,
  {r2("stddev_samp(x)")} AS std FROM pl GROUP BY 1, 2"""


@oracle("feature_metadata")
def o_feature_metadata():
    return f"""{cte(PANEL_QUARTER, RISK_PANEL, risk_index_cte())}
SELECT count(risk_index) AS n_rows, 7 AS n_features_original, 20 AS n_features_final,
  {r6("avg(risk_index)")} AS risk_index_mean, {r6("stddev_samp(risk_index)")} AS risk_index_std, {r6("min(risk_index)")} AS risk_index_min,
  {r6("max(risk_index)")} AS risk_index_max FROM ri"""


# ---------------------------------------------------------------- principal components SQL


def pca_cte(k: int = 4, squarings: int = 45) -> str:
    """Components by powers of the correlation matrix and deflation.

    Squaring a symmetric matrix and dividing by its trace leads to v v' of its
    leading eigenvector; v is the row of the largest diagonal entry, which makes
    that entry positive. The matrix less its component gives the next one.
    """
    p = len(M)
    z = ", ".join(f"(CAST({m} AS DOUBLE) - avg({m}) OVER ()) / stddev_pop({m}) OVER () AS z{i}" for i, m in enumerate(M))
    rows = ", ".join("[" + ", ".join(f"avg(z{i} * z{j})" for j in range(p)) + "]" for i in range(p))
    parts = [
        PANEL_QUARTER,
        PQ_DOUBLE,
        f"z AS (SELECT nation_key, period_start, {z} FROM pq)",
        f"c1 AS (SELECT [{rows}] AS c FROM z)",
    ]
    trace = f"list_sum(list_transform(range(1, {p + 1}), lambda i: m[i][i]))"
    for n in range(1, k + 1):
        parts.append(f"""p{n}(i, b) AS (
  SELECT 0, c FROM c{n}
  UNION ALL
  SELECT i + 1, list_transform(m, lambda r: list_transform(r, lambda x: x / {trace}))
  FROM (SELECT i, list_transform(b, lambda r: list_transform(b, lambda q: list_dot_product(r, q))) AS m FROM p{n} WHERE i < {squarings}))""")
        parts.append(f"""d{n} AS (SELECT b, list_transform(range(1, {p + 1}), lambda i: b[i][i]) AS d FROM p{n} WHERE i = {squarings})""")
        parts.append(f"""v{n} AS (SELECT {n} AS k, list_transform(b[list_position(d, list_max(d))], lambda x: x / sqrt(list_max(d))) AS v FROM d{n})""")
        parts.append(f"""e{n} AS (SELECT k, v, list_dot_product(v, list_transform(c, lambda r: list_dot_product(r, v))) AS lam FROM v{n}, c{n})""")
        parts.append(f"""c{n + 1} AS (SELECT list_transform(range(1, {p + 1}), lambda i: list_transform(range(1, {p + 1}), lambda j: c[i][j] - lam * v[i] * v[j])) AS c
  FROM c{n}, e{n})""")
    parts.append("pc AS (" + " UNION ALL ".join(f"SELECT * FROM e{n}" for n in range(1, k + 1)) + ")")
    return "WITH RECURSIVE " + ",\n".join(parts)


PCA_VARIANCE = f"""SELECT 'PC' || k AS component, {D(100)} * lam / {len(M)} AS variance_pct,
  {D(100)} * sum(lam) OVER (ORDER BY k) / {len(M)} AS cumulative_pct, sum(lam) OVER (ORDER BY k) / {len(M)} >= {D(0.8)} AS meets_target FROM pc"""


@oracle("pca_variance")
def o_pca_variance():
    return f"{pca_cte()} SELECT component, {r4('variance_pct')} AS variance_pct, {r4('cumulative_pct')} AS cumulative_pct, meets_target FROM ({PCA_VARIANCE})"


@oracle("feature_metadata_pca")
def o_feature_metadata_pca():
    return f"""{pca_cte()} SELECT count(*) AS n_components, {r4('max(cumulative_pct)')} AS variance_pct, bool_or(meets_target) AS meets_target
FROM ({PCA_VARIANCE})"""


@oracle("pca_loadings")
def o_pca_loadings():
    names = ", ".join(f"'{m}'" for m in M)
    return f"""{pca_cte()} SELECT 'PC' || k AS component, unnest([{names}]) AS feature,
  unnest(list_transform(v, lambda x: {r4('x')})) AS loading, unnest(list_transform(v, lambda x: abs(x) > {D(0.4)})) AS significant FROM pc"""


@oracle("pca_scores")
def o_pca_scores():
    scores = ", ".join(
        r4(" + ".join(f"z{i} * (SELECT v[{i + 1}] FROM e{n})" for i in range(len(M)))) + f" AS PC{n}" for n in range(1, 5)
    )
    return f"{pca_cte()} SELECT nation_key, period_start, {scores} FROM z"


# ---------------------------------------------------------------- marts SQL


@oracle("risk_zones")
def o_risk_zones():
    return f"""{cte(PANEL_QUARTER, RISK_PANEL, risk_index_cte())}
SELECT nation_key, period_start, risk_index,
  CASE WHEN risk_index < {D(35)} THEN 'Bajo Riesgo' WHEN risk_index < {D(65)} THEN 'Riesgo Moderado' ELSE 'Riesgo Crítico' END AS zone,
  risk_index >= {D(75)} AS above_alert FROM ri"""


@oracle("debt_bands")
def o_debt_bands():
    return f"""{cte(PANEL_QUARTER, RISK_PANEL, INITIAL, SCEN_VALUES, scenario_sql())}
SELECT nation_key, scenario, year, {r6("debt_ratio")} AS debt_ratio,
  CASE WHEN debt_ratio < {D(50)} THEN 'low' WHEN debt_ratio < {D(80)} THEN 'elevated' ELSE 'critical' END AS band,
  debt_ratio > {D(80)} AS above_critical FROM proj"""


@oracle("score_classes")
def o_score_classes():
    return f"""{histogram_sql()}
SELECT *, CASE WHEN score < 3 THEN 'low' WHEN score < 5 THEN 'warning' ELSE 'collapse' END AS class,
  CASE WHEN score >= 3 THEN 'Colapso' ELSE 'Estable' END AS outcome FROM hg"""


@oracle("scenario_long")
def o_scenario_long():
    parts = " UNION ALL ".join(
        f"SELECT nation_key, scenario, year, '{c}' AS indicator, {r6(f'CAST({c} AS DOUBLE)')} AS value FROM proj"
        for c in ("production", "debt_ratio", "reserves", "risk_index")
    )
    return f"""{cte(PANEL_QUARTER, RISK_PANEL, INITIAL, SCEN_VALUES, scenario_sql())}
{parts}"""


@oracle("production_timeline")
def o_production_timeline():
    return f"""{cte(PANEL_QUARTER, RISK_PANEL, INITIAL, SCEN_VALUES, scenario_sql())},
prod AS (SELECT nation_key, period_start, {D(4.7)} * volume / n_orders AS production FROM panel_quarter),
hist AS (SELECT nation_key, CAST(year(period_start) AS INTEGER) AS year, 'history' AS series, avg(production) AS production
         FROM prod GROUP BY ALL),
tl AS (SELECT * FROM hist UNION ALL SELECT nation_key, year, scenario AS series, production FROM proj)
SELECT nation_key, year, series, {r6("production")} AS production, production < {D(300)} AS below_reference FROM tl"""


def kpis_sql() -> str:
    return f"""{scored_cte()},
k AS (SELECT nation_key, count(*) AS n_quarters, avg(risk_index) AS risk_index_mean, avg(CAST(breach AS DOUBLE)) AS p,
  avg(CAST(breach AS DOUBLE)) * {D(100)} AS p_collapse_pct FROM sp GROUP BY nation_key)"""


@oracle("kpi_badges")
def o_kpi_badges():
    return f"""{kpis_sql()}
SELECT nation_key, {r6("risk_index_mean")} AS risk_index_mean, {r6("p_collapse_pct")} AS p_collapse_pct,
  CASE WHEN risk_index_mean > {D(65)} THEN 'red' WHEN risk_index_mean > {D(40)} THEN 'yellow' ELSE 'green' END AS index_badge,
  CASE WHEN p_collapse_pct > {D(60)} THEN 'red' WHEN p_collapse_pct > {D(30)} THEN 'yellow' ELSE 'green' END AS prob_badge
FROM k"""


@oracle("run_summary")
def o_run_summary():
    shares = ", ".join(
        f"{r6(f'avg(CAST(collapse AS DOUBLE)) FILTER (WHERE scenario = {chr(39)}{s.name}{chr(39)})')} AS share_{s.name}"
        for s in REFERENCE_SCENARIOS
    )
    return f"""{kpis_sql()},
{INITIAL},
{SCEN_VALUES},
{scenario_sql()},
sh AS (SELECT nation_key, {shares} FROM proj GROUP BY nation_key)
SELECT nation_key, n_quarters, {r6("risk_index_mean")} AS risk_index_mean, {r6("p_collapse_pct")} AS p_collapse_pct,
  CASE WHEN p < {D(0.3)} THEN 'VERDE' WHEN p < {D(0.6)} THEN 'AMARILLO' ELSE 'ROJO' END AS light,
  share_optimistic, share_base, share_pessimistic, (SELECT count(*) FROM panel_quarter) AS panel_rows,
  (SELECT len(list(column_name)) FROM (DESCRIBE SELECT * FROM panel_quarter)) AS panel_columns
FROM k JOIN sh USING (nation_key)"""
