"""Forward projections (deterministic scenarios, N1–N14) and the summaries of
scored rows (T6–T10).

Scenarios are a recurrence over a short horizon (8 years), unrolled into one
projection per year: one row per (key, scenario), generated by exploding a
literal array of scenario structs — the scenario table is a parameter, never
joined. The summaries read any table of scored observations (a score and a
breach flag per key and period) in single aggregates with map-side partials.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import round_to, sum_columns
from ..specs import (
    FIXED_INDEX_B,
    INITIAL_DEFAULTS,
    REFERENCE_RULES,
    REFERENCE_SCENARIOS,
    Horizon,
    RuleSet,
    ScenarioModel,
)
from .rules import score_expr, traffic_light_expr
from .stats import as_list

STATE = ("production", "debt_ratio", "reserves", "deficit", "employment", "revenue_share", "vat_take")


def _max0(x: Column, floor: float) -> Column:
    return F.greatest(x, F.lit(float(floor)))


def _clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def _index(terms, values: dict, multiplier: float = 100.0) -> Column:
    """Fixed-normaliser composite on named Column values."""
    parts = []
    for t in terms:
        parts.append(_term(t, values[t.column]))
    return sum_columns(parts) * F.lit(float(multiplier))


def _term(t, x: Column) -> Column:
    n = F.lit(float(t.norm))
    one = F.lit(1.0)
    if t.kind == "capped":
        v = F.least(x / n, one)
    elif t.kind == "capped_pos":
        v = F.least(F.greatest(x, F.lit(0.0)) / n, one)
    else:
        v = F.greatest(one - x / n, F.lit(0.0))
    return F.lit(float(t.weight)) * v


def _initial(init: DataFrame, keys, defaults: dict) -> list:
    cols = []
    for c in STATE:
        v = F.col(c) if c in init.columns else F.lit(None).cast("double")
        cols.append(F.coalesce(v.cast("double"), F.lit(float(defaults[c]))).alias(f"__{c}0"))
    return [*keys, *cols]


# ---------------------------------------------------------------- scenarios


def scenario_projection(
    init: DataFrame,
    by,
    scenarios=REFERENCE_SCENARIOS,
    horizon: Horizon = Horizon(),
    model: ScenarioModel = ScenarioModel(),
    index_terms=FIXED_INDEX_B,
    rules: RuleSet = REFERENCE_RULES,
    defaults: dict = INITIAL_DEFAULTS,
) -> DataFrame:
    """One row per (key, scenario, year) with the projected metrics,
    composite index, collapse score and flag (full precision)."""
    keys = as_list(by)
    m = model
    scen = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(s.name).alias("scenario"),
                    F.lit(float(s.price)).alias("price"),
                    F.lit(float(s.growth)).alias("growth"),
                    F.lit(float(s.decline)).alias("decline"),
                    F.lit(float(s.deficit_trend)).alias("trend"),
                )
                for s in scenarios
            ]
        )
    ).alias("__s")
    df = init.select(*_initial(init, keys, defaults), scen).select(
        *keys,
        "__s.*",
        F.col("__production0").alias("__q"),
        F.col("__debt_ratio0").alias("__d"),
        F.col("__reserves0").alias("__r"),
        F.col("__deficit0").alias("__def"),
    )
    p, g = F.col("price"), F.col("growth")
    kyear = F.lit(1000.0)
    days = F.lit(365.0)
    years = []
    for t in range(1, horizon.years + 1):
        q = _max0(F.col("__q") * (F.lit(1.0) + F.col("decline")), m.production_floor)
        df = df.withColumn("__q", q)
        q = F.col("__q")
        r = _max0(F.col("__r") - q * days / kyear, 0.0)
        d = _max0(
            F.col("__d") * F.lit(1.0 + m.interest) / (F.lit(1.0) + g / F.lit(100.0))
            + F.col("__def") * F.lit(m.deficit_carry),
            m.debt_floor,
        )
        df = df.withColumns({"__r": r, "__d": d, "__def": F.col("__def") + F.col("trend")})
        q, r, d, de = F.col("__q"), F.col("__r"), F.col("__d"), F.col("__def")
        annual = q * days / kyear
        rp = F.when(q > 0, r / annual).otherwise(F.lit(0.0))
        rev = _clip(
            F.lit(m.revenue_base) * (p / F.lit(m.price_ref)) * (q / F.lit(m.production_ref)) * F.lit(m.revenue_factor),
            *m.revenue_bounds,
        )
        df = df.withColumns({f"__rp{t}": rp, f"__rev{t}": rev})
        rp, rev = F.col(f"__rp{t}"), F.col(f"__rev{t}")
        vat = F.lit(m.vat_base) * (F.lit(1.0) + g / F.lit(100.0))
        emp = F.lit(m.employment_base) + g * F.lit(m.employment_per_growth)
        exports = q * p * days / kyear * F.lit(m.export_share)
        invest = F.lit(m.investment_base) * (rev / F.lit(m.revenue_base))
        values = {"debt_ratio": d, "rp_ratio": rp, "deficit": de, "employment": emp, "revenue_share": rev}
        risk_index = _index(index_terms, values)
        df = df.withColumn(f"__risk_index{t}", risk_index)
        risk_index = F.col(f"__risk_index{t}")
        colmap = {
            "debt_ratio": d,
            "rp_ratio": rp,
            "deficit": de,
            "production": q,
            "risk_index": risk_index,
            "employment": emp,
            "reserves": r,
        }
        score = score_expr(rules, colmap).cast("int")
        years.append(
            F.struct(
                F.lit(horizon.start_year + t - 1).alias("year"),
                q.alias("production"),
                p.alias("price"),
                g.alias("gdp_growth"),
                d.alias("debt_ratio"),
                r.alias("reserves"),
                rev.alias("revenue_share"),
                vat.alias("vat_take"),
                de.alias("deficit"),
                emp.alias("employment"),
                rp.alias("rp_ratio"),
                exports.alias("exports"),
                invest.alias("investment"),
                risk_index.alias("risk_index"),
                score.alias("collapse_score"),
                (score >= F.lit(rules.breach_at)).alias("collapse"),
            )
        )
        df = df.withColumn(f"__y{t}", years[-1])
    return df.select(*keys, "scenario", F.inline(F.array(*[F.col(f"__y{t}") for t in range(1, horizon.years + 1)])))


def scenario_collapse_share(proj: DataFrame, by) -> DataFrame:
    """Share of years flagged per (key, scenario)."""
    keys = as_list(by)
    return proj.groupBy(*keys, "scenario").agg(F.avg(F.col("collapse").cast("double")).alias("collapse_share"))


#: Columns of a scenario row that are shown with two digits.
SCENARIO_DIGITS = (
    "production", "debt_ratio", "reserves", "revenue_share", "vat_take", "deficit",
    "employment", "rp_ratio", "exports", "investment", "risk_index",
)


def scenario_rounding(proj: DataFrame) -> DataFrame:
    """Scenario rows at their digits (price and growth are given, not computed)."""
    return proj.withColumns({c: round_to(c, 2) for c in SCENARIO_DIGITS if c in proj.columns})


def summary_rounding(summary: DataFrame) -> DataFrame:
    """A score summary at its digits: two, and one for the further means."""
    two = {c: 2 for c in ("collapse_pct", "mean_score", "median_score", "std_score")}
    digits = {c: two.get(c, 1) for c in summary.columns if c in two or c.startswith("mean_")}
    return summary.withColumns({c: round_to(c, d) for c, d in digits.items()})


def scenario_comparison(proj: DataFrame, by, yes_no=("SÍ", "NO")) -> DataFrame:
    """Final-year row per (key, scenario), capitalised name, yes/no."""
    keys = as_list(by)
    cols = ["production", "debt_ratio", "reserves", "risk_index", "collapse_score", "collapse"]
    last = proj.groupBy(*keys, "scenario").agg(
        F.max_by(F.struct("year", *cols), F.col("year")).alias("__l")
    )
    return last.select(
        *keys,
        F.initcap("scenario").alias("scenario"),
        F.col("__l.year").alias("year"),
        *[F.col(f"__l.{c}").alias(c) for c in cols[:-1]],
        F.when(F.col("__l.collapse"), F.lit(yes_no[0])).otherwise(F.lit(yes_no[1])).alias("collapse"),
    )


# ---------------------------------------------------------------- summaries of scored rows


def breach_probability(scored: DataFrame, by, breach: str = "breach") -> DataFrame:
    """P(breach) per key = share of its scored rows that breach."""
    return scored.groupBy(*as_list(by)).agg(
        F.count(F.lit(1)).alias("n_obs"), F.avg(F.col(breach).cast("double")).alias("p_collapse")
    )


def yearly_breach_rate(scored: DataFrame, by, year: str = "year", breach: str = "breach") -> DataFrame:
    """Per (key, year), share of rows that breach."""
    return scored.groupBy(*as_list(by), year).agg(F.avg(F.col(breach).cast("double")).alias("collapse_rate"))


def score_histogram(scored: DataFrame, by, ruleset: RuleSet = REFERENCE_RULES, score: str = "score") -> DataFrame:
    """Zero-filled histogram of the scores 0 … number of rules per key.

    One aggregate with one conditional count per bucket, then an explode —
    no join against a bucket table.
    """
    keys = as_list(by)
    counts = scored.groupBy(*keys).agg(
        F.array(*[F.count_if(F.col(score) == F.lit(s)) for s in range(len(ruleset.rules) + 1)]).alias("__h")
    )
    return counts.select(*keys, F.posexplode("__h").alias("score", "n_obs")).withColumn("score", F.col("score").cast("int"))


def score_summary(scored: DataFrame, by, means=(), score: str = "score", breach: str = "breach") -> DataFrame:
    """Breach share, mean / median / population std of the score, and the
    means of further columns."""
    s = F.col(score).cast("double")
    return scored.groupBy(*as_list(by)).agg(
        F.count(F.lit(1)).alias("n_obs"),
        (F.avg(F.col(breach).cast("double")) * F.lit(100.0)).alias("collapse_pct"),
        F.avg(s).alias("mean_score"),
        F.median(s).alias("median_score"),
        F.stddev_pop(s).alias("std_score"),
        *[F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in means],
    )


def traffic_light(prob: DataFrame, p: str = "p_collapse") -> DataFrame:
    """Light per key from P(collapse)."""
    return prob.withColumn("light", traffic_light_expr(F.col(p)))
