"""Parameter specs with the surveyed system's constants as defaults.

Everything an operator needs besides its input DataFrame (weights,
directions, thresholds, scenarios, draw distributions, horizon) is a small
frozen dataclass so one job can run any variant of the analysis.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES — these must equal the surveyed system's values for identical
# results. Stated plainly, in their natural order.
# ---------------------------------------------------------------------------

# The 12 panel metrics (neutral English names, source order).
METRICS = (
    "production",
    "price",
    "gdp_growth",
    "debt_ratio",
    "reserves",
    "revenue_share",
    "vat_take",
    "deficit",
    "employment",
    "rp_ratio",
    "exports",
    "investment",
)

# Source CSV headers (UTF-8, with units) -> canonical column name.
SOURCE_HEADERS = {
    "Año": "year",
    "Periodo": "period",
    "Producción Diaria (Kb/d)": "production",
    "Precio del Crudo (USD/bbl)": "price",
    "Crecimiento PIB (% anual)": "gdp_growth",
    "Deuda/PIB (%)": "debt_ratio",
    "Reservas Probadas (Mb)": "reserves",
    "Ingresos Petroleros al PGE (% PIB)": "revenue_share",
    "Recaudación IVA (USD millones)": "vat_take",
    "Déficit Primario (% PIB)": "deficit",
    "Empleo Adecuado (% PEA)": "employment",
    "Ratio R/P (Años)": "rp_ratio",
    "Exportaciones Petroleras (USD M)": "exports",
    "Inversión Pública (% PIB)": "investment",
}

# Regime id -> name (k-means regimes); unknown ids fall back to
# REGIME_FALLBACK formatted with the id.
REGIME_NAMES = {
    0: "Pre-dolarización/Crisis",
    1: "Dolarización Temprana",
    2: "Boom Petrolero I",
    3: "Crisis Global 2009",
    4: "Boom Petrolero II",
    5: "Recesión Petrolera",
    6: "Pandemia/Post-pandemia",
}
REGIME_FALLBACK = "Clúster {}"

# Traffic light labels for P(collapse) < .30, < .60, otherwise.
LIGHT_LABELS = ("VERDE", "AMARILLO", "ROJO")
# Yes / no labels of the final-year comparison table.
YES_NO = ("SÍ", "NO")

# ---------------------------------------------------------------------------
# Composite index (weighted min-max of risk-oriented metrics)
# ---------------------------------------------------------------------------

# direction: "direct" x; "inverse" 1/max(x, 0.1); "complement" 100 - x;
# "complement_capped" 100 - min(x, 100). ``scale`` multiplies x first.


@dataclass(frozen=True)
class IndexTerm:
    column: str
    direction: str
    weight: float
    scale: float = 1.0


@dataclass(frozen=True)
class IndexSpec:
    terms: tuple
    out: str = "risk_index"
    multiplier: float = 100.0
    round_digits: int | None = 2


REFERENCE_INDEX = IndexSpec(
    terms=(
        IndexTerm("debt_ratio", "direct", 0.30),
        IndexTerm("rp_ratio", "inverse", 0.25),
        IndexTerm("deficit", "direct", 0.20),
        IndexTerm("employment", "complement", 0.15),
        IndexTerm("revenue_share", "complement_capped", 0.10),
    )
)

# Fixed-normaliser composite used inside projections.
# kind: "capped" min(x/n, 1); "capped_pos" min(max(x, 0)/n, 1);
# "shortfall" max(1 - x/n, 0).


@dataclass(frozen=True)
class FixedTerm:
    column: str
    kind: str
    norm: float
    weight: float


# Variant A (stochastic paths): normalisers 80, 12, 8, 50, 15.
FIXED_INDEX_A = (
    FixedTerm("debt_ratio", "capped", 80.0, 0.30),
    FixedTerm("rp_ratio", "shortfall", 12.0, 0.25),
    FixedTerm("deficit", "capped_pos", 8.0, 0.20),
    FixedTerm("employment", "shortfall", 50.0, 0.15),
    FixedTerm("revenue_share", "shortfall", 15.0, 0.10),
)
# Variant B (deterministic scenarios): normalisers 100, 15, 10, 60, 20.
FIXED_INDEX_B = (
    FixedTerm("debt_ratio", "capped", 100.0, 0.30),
    FixedTerm("rp_ratio", "shortfall", 15.0, 0.25),
    FixedTerm("deficit", "capped_pos", 10.0, 0.20),
    FixedTerm("employment", "shortfall", 60.0, 0.15),
    FixedTerm("revenue_share", "shortfall", 20.0, 0.10),
)

# ---------------------------------------------------------------------------
# Breach rules (strict comparisons), breach when score >= breach_at
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    column: str
    op: str  # ">" or "<"
    threshold: float


@dataclass(frozen=True)
class RuleSet:
    rules: tuple
    breach_at: int = 5


REFERENCE_RULES = RuleSet(
    rules=(
        Rule("debt_ratio", ">", 71.5),
        Rule("rp_ratio", "<", 5.5),
        Rule("deficit", ">", 6.2),
        Rule("production", "<", 355.0),
        Rule("risk_index", ">", 66.5),
        Rule("employment", "<", 33.5),
        Rule("reserves", "<", 625.0),
    ),
    breach_at=5,
)

# ---------------------------------------------------------------------------
# Scenarios and horizon
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Scenario:
    name: str
    price: float
    growth: float
    decline: float
    deficit_trend: float


REFERENCE_SCENARIOS = (
    Scenario("optimistic", 75.0, 3.0, -0.020, -0.3),
    Scenario("base", 60.0, 1.5, -0.035, 0.2),
    Scenario("pessimistic", 40.0, 0.0, -0.050, 0.8),
)


@dataclass(frozen=True)
class Horizon:
    start_year: int = 2025
    end_year: int = 2032

    @property
    def years(self) -> int:
        return self.end_year - self.start_year + 1


# Initial-condition defaults used when a field is missing.
INITIAL_DEFAULTS = {
    "production": 470.0,
    "debt_ratio": 63.0,
    "reserves": 1380.0,
    "deficit": 4.0,
    "employment": 38.0,
    "revenue_share": 11.0,
    "vat_take": 8300.0,
}

# ---------------------------------------------------------------------------
# Deterministic scenario recurrence constants
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class ScenarioModel:
    production_floor: float = 50.0
    interest: float = 0.05
    deficit_carry: float = 0.5
    debt_floor: float = 10.0
    revenue_base: float = 11.0
    price_ref: float = 65.0
    production_ref: float = 470.0
    revenue_factor: float = 0.85
    revenue_bounds: tuple = (2.0, 25.0)
    vat_base: float = 8300.0
    employment_base: float = 38.0
    employment_per_growth: float = 2.0
    export_share: float = 0.65
    investment_base: float = 14.3


# Traffic light cut points on P(collapse) (strict "<").
LIGHT_CUTS = (0.30, 0.60)

# ---------------------------------------------------------------------------
# FIXED VALUES for presentation tables (bands, classes, badge cut points).
# ---------------------------------------------------------------------------

# Index zones: [0, 35) / [35, 65) / [65, ...); alert line at 75.
ZONE_EDGES = (35.0, 65.0)
ZONE_LABELS = ("Bajo Riesgo", "Riesgo Moderado", "Riesgo Crítico")
INDEX_ALERT = 75.0
# Debt bands: [0, 50) / [50, 80) / [80, ...); critical line at 80.
DEBT_EDGES = (50.0, 80.0)
DEBT_LABELS = ("low", "elevated", "critical")
DEBT_ALERT = 80.0
# Score classes: < 3 / < 5 / >= 5; collapse vs stable split.
SCORE_EDGES = (3.0, 5.0)
SCORE_LABELS = ("low", "warning", "collapse")
SPLIT_LABELS = ("Colapso", "Estable")
# Production reference line.
PRODUCTION_ALERT = 300.0
# KPI badges: strict ">" cut points, high first.
BADGE_COLORS = ("green", "yellow", "red")
R2_CUTS = (0.9, 0.7)
R2_LABELS = ("Excelente", "Bueno", "Mejorable")
INDEX_CUTS = (65.0, 40.0)
PROB_CUTS = (60.0, 30.0)
