"""More registered queries (cleaning, disaggregation, rules, projections, models, marts)."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..operators import clean as cl
from ..operators import disagg as dg
from ..operators import panel_ops as po
from ..session import ROWS_PER_PART, ensure_checkpoint_dir, materialize, spread
from ..sources import panels
from ..sources.tables import read_table
from ..specs import INITIAL_DEFAULTS
from .queries import KEY, PANEL_METRICS, quarter_panel, register, risk_panel, rounded, year_panel

# Disaggregation / harmonising binding: annual rows up to CUT_YEAR are
# disaggregated, true quarterly rows follow.
CUT_YEAR = 1997
FIRST_ROWS = 16  # of the ``first_n`` query
EVENT_COLS = ["value", "avg_value"]
BLOCK_DAYS = 64  # time block of scans along a series


def events(spark, sf_dir):
    return panels.events_daily(spark, sf_dir)


def metrics_double(df):
    return df.withColumn("n_orders", F.col("n_orders").cast("double"))


# ---------------------------------------------------------------- sources / profile


@register("profile_table")
def q_profile_table(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    p = po.profile_table(li, "l_shipdate")
    return p.select(
        "n_rows", "n_cols", "n_nulls", F.array_join("columns", ",").alias("columns"),
        F.to_date("min_date").alias("min_date"), F.to_date("max_date").alias("max_date"),
    )


@register("profile_sample")
def q_profile_sample(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return po.sample_rows(li, ["l_orderkey", "l_linenumber", *[c for c in li.columns if c not in ("l_orderkey", "l_linenumber")]])


@register("parse_period")
def q_parse_period(spark, sf_dir):
    labelled = panels.period_labels(quarter_panel(spark, sf_dir))
    return panels.parse_period(labelled).select(KEY, "period", "year", "quarter", "period_start")


# ---------------------------------------------------------------- projections / filters


@register("year_slice")
def q_year_slice(spark, sf_dir):
    return rounded(po.year_slice(year_panel(spark, sf_dir), 1996, 1999))


@register("complete_rows")
def q_complete_rows(spark, sf_dir):
    df = po.complete_rows(events(spark, sf_dir), EVENT_COLS)
    return rounded(df.select("user_id", "day", "n_events", "value", "avg_value"))


@register("temporal_split")
def q_temporal_split(spark, sf_dir):
    df = po.temporal_split(quarter_panel(spark, sf_dir), 1999, 2000, date="period_start")
    return df.select(KEY, "period_start", "split")


def event_split(spark, sf_dir):
    """The first two thirds of the calendar's days train, the rest tests."""
    days = events(spark, sf_dir)
    ev = po.complete_rows(days, ["value"])
    edge = days.agg(F.floor(F.max("pos") * 2 / 3).alias("edge")).scalar()
    return ev.withColumn("split", F.when(F.col("pos") <= edge, F.lit("train")).otherwise(F.lit("test")))


@register("min_sample_gate")
def q_min_sample_gate(spark, sf_dir):
    return po.sample_gate(event_split(spark, sf_dir), "user_id", min_train=10, min_test=2)


INITIAL_COLS = ["production", "debt_ratio", "reserves", "deficit", "employment", "revenue_share", "vat_take"]


def initial_conditions(spark, sf_dir, panel=None):
    """Per-nation starting point for projections: the last panel quarter,
    mapped affinely into the surveyed numeric ranges; missing fields take the
    surveyed defaults."""
    rp = risk_panel(spark, sf_dir) if panel is None else panels.risk_roles(panel)
    mapped = rp.select(
        KEY,
        "period_start",
        (F.lit(4.7) * F.col("volume") / F.col("n_orders")).alias("production"),
        (F.lit(45.0) + F.lit(0.5) * F.col("ret_pct")).alias("debt_ratio"),
        (F.lit(4.7) * F.col("volume") / F.col("n_orders") * (F.lit(1.5) + F.col("open_pct") / F.lit(30.0))).alias(
            "reserves"
        ),
        F.col("disc_pct").alias("deficit"),
        (F.lit(15.0) + F.lit(0.5) * F.col("open_pct")).alias("employment"),
        "revenue_share",
        "vat_take",
    )
    return po.last_observation(mapped, KEY, "period_start", INITIAL_COLS, INITIAL_DEFAULTS)


@register("last_observation")
def q_last_observation(spark, sf_dir):
    return rounded(initial_conditions(spark, sf_dir))


@register("quarter_calendar")
def q_quarter_calendar(spark, sf_dir):
    return po.quarter_calendar(quarter_panel(spark, sf_dir), KEY)


@register("first_n")
def q_first_n(spark, sf_dir):
    return rounded(po.first_n(quarter_panel(spark, sf_dir), KEY, "period_start", FIRST_ROWS, block=730))


CLIP_BOUNDS = {"debt_ratio": (None, 40.0), "rp_ratio": (25.0, None), "deficit": (4.0, 6.0)}


@register("clip_bounds")
def q_clip_bounds(spark, sf_dir):
    df = cl.clip_bounds(risk_panel(spark, sf_dir), CLIP_BOUNDS)
    return rounded(df.select(KEY, "period_start", *CLIP_BOUNDS))


# ---------------------------------------------------------------- cleaning


@register("interpolate_linear")
def q_interpolate_linear(spark, sf_dir):
    df = cl.interpolate_linear(events(spark, sf_dir), EVENT_COLS, "user_id", "day", pos="pos", block=BLOCK_DAYS)
    return rounded(df.select("user_id", "day", *EVENT_COLS))


@register("fill_forward_back")
def q_fill_forward_back(spark, sf_dir):
    df = cl.fill_forward_back(events(spark, sf_dir), EVENT_COLS, "user_id", "day", block=BLOCK_DAYS)
    return rounded(df.select("user_id", "day", *EVENT_COLS))


@register("iqr_winsorize")
def q_iqr_winsorize(spark, sf_dir):
    df = cl.iqr_winsorize(materialize(metrics_double(quarter_panel(spark, sf_dir))), PANEL_METRICS, by=KEY)
    return rounded(df.select(KEY, "period_start", *PANEL_METRICS))


@register("iqr_outlier_report")
def q_iqr_outlier_report(spark, sf_dir):
    panel = materialize(metrics_double(quarter_panel(spark, sf_dir)))
    return rounded(cl.iqr_outlier_report(panel, PANEL_METRICS, by=KEY))


@register("null_counts")
def q_null_counts(spark, sf_dir):
    return cl.null_counts(events(spark, sf_dir))


# ---------------------------------------------------------------- disaggregation


def both_grains(spark, sf_dir):
    """(annual, quarterly) panels of one scan: the quarter sums (a row per key
    and quarter) are materialised once, the years are summed from them."""
    base = materialize(panels.nation_quarters(spark, sf_dir))
    return metrics_double(panels.panel_of(base, "year")), metrics_double(panels.panel_of(base))


def source_parts(spark, sf_dir):
    """The annual source up to CUT_YEAR and the quarterly source after it."""
    annual, quarterly = both_grains(spark, sf_dir)
    return annual.where(F.col("year") <= CUT_YEAR), quarterly.where(F.col("year") > CUT_YEAR)


@register("disaggregate_trend")
def q_disaggregate_trend(spark, sf_dir):
    return rounded(dg.disaggregate_trend(metrics_double(year_panel(spark, sf_dir)), PANEL_METRICS, KEY))


@register("disaggregate_indicator")
def q_disaggregate_indicator(spark, sf_dir):
    annual, indicator = both_grains(spark, sf_dir)
    return rounded(dg.disaggregate_indicator(annual, indicator, PANEL_METRICS, KEY))


@register("disaggregate_check")
def q_disaggregate_check(spark, sf_dir):
    annual, indicator = both_grains(spark, sf_dir)
    t = dg.aggregation_check(annual, dg.disaggregate_trend(annual, PANEL_METRICS, KEY), PANEL_METRICS, KEY)
    i = dg.aggregation_check(
        annual, dg.disaggregate_indicator(annual, indicator, PANEL_METRICS, KEY), PANEL_METRICS, KEY
    )
    out = t.withColumn("branch", F.lit("trend")).unionByName(i.withColumn("branch", F.lit("indicator")))
    return rounded(out)


def disaggregated_parts(spark, sf_dir, method):
    annual, quarterly = source_parts(spark, sf_dir)
    return rounded(dg.disaggregate(annual, PANEL_METRICS, KEY, indicator=quarterly, method=method))


@register("disaggregate_all")
def q_disaggregate_all(spark, sf_dir):
    return disaggregated_parts(spark, sf_dir, "by_length")


@register("disaggregate_trend_all")
def q_disaggregate_trend_all(spark, sf_dir):
    return disaggregated_parts(spark, sf_dir, "trend")


@register("disaggregate_indicator_all")
def q_disaggregate_indicator_all(spark, sf_dir):
    return disaggregated_parts(spark, sf_dir, "indicator")


MASTER_COLS = [KEY, "year", "quarter", "period_start", *PANEL_METRICS]


@register("harmonize_panel")
def q_harmonize_panel(spark, sf_dir):
    a, q = source_parts(spark, sf_dir)
    return rounded(dg.harmonize(dg.disaggregate(a, PANEL_METRICS, KEY, method="trend"), q, MASTER_COLS))


def master(annual, quarterly, method="trend"):
    """Clean each source, disaggregate, union, clean the union again."""
    a = cl.clean(annual, PANEL_METRICS, KEY, "year")
    q = cl.clean(quarterly, PANEL_METRICS, KEY, "period_start")
    h = dg.harmonize(dg.disaggregate(a, PANEL_METRICS, KEY, indicator=q, method=method), q, MASTER_COLS)
    return cl.clean(h, PANEL_METRICS, KEY, "period_start")


@register("clean_two_pass")
def q_clean_two_pass(spark, sf_dir):
    return rounded(master(*source_parts(spark, sf_dir), method="indicator"))


def master_from_sources(spark, sf_dir):
    """Full ETL (H2) from source-shaped inputs: the quarterly source carries
    'YYYY Tq' labels that are parsed back (S4/P8) before the pipeline."""
    annual, quarterly = both_grains(spark, sf_dir)
    parsed = panels.parse_period(panels.period_labels(quarterly)).where(F.col("year") > CUT_YEAR)
    return master(annual.where(F.col("year") <= CUT_YEAR), parsed)


@register("master_panel")
def q_master_panel(spark, sf_dir):
    return rounded(master_from_sources(spark, sf_dir))


# ---------------------------------------------------------------- rules and projections

from ..operators import features as feat  # noqa: E402
from ..operators import project as pj  # noqa: E402
from ..operators import rules as rl  # noqa: E402
from ..specs import REFERENCE_INDEX, REFERENCE_SCENARIOS, Horizon, Rule, RuleSet  # noqa: E402

# Panel rule table: each rule fires on some but not all nation-quarters.
PANEL_RULES = RuleSet(
    rules=(
        Rule("ret_pct", ">", 36.0),
        Rule("open_pct", ">", 52.0),
        Rule("disc_pct", ">", 5.2),
        Rule("unit_price", "<", 2100.0),
        Rule("n_orders", "<", 60.0),
        Rule("risk_index", ">", 60.0),
    ),
    breach_at=3,
)
HORIZON = Horizon()


def scored_panel(spark, sf_dir):
    """Every nation-quarter with its rule score and breach flag."""
    return rl.breach_score(feat.risk_index(risk_panel(spark, sf_dir), REFERENCE_INDEX), PANEL_RULES)


@register("breach_score")
def q_breach_score(spark, sf_dir):
    return scored_panel(spark, sf_dir).select(KEY, "period_start", "score", "breach")


@register("scenario_grid")
def q_scenario_grid(spark, sf_dir):
    init = initial_conditions(spark, sf_dir)
    names = F.array(*[F.lit(s.name) for s in REFERENCE_SCENARIOS])
    years = F.sequence(F.lit(HORIZON.start_year), F.lit(HORIZON.end_year))
    return init.select(KEY, F.explode(names).alias("scenario")).select(
        KEY, "scenario", F.explode(years).alias("year")
    )


def projections(spark, sf_dir, panel=None):
    return pj.scenario_projection(initial_conditions(spark, sf_dir, panel), KEY, REFERENCE_SCENARIOS, HORIZON)


@register("scenario_projection")
def q_scenario_projection(spark, sf_dir):
    return rounded(pj.scenario_rounding(projections(spark, sf_dir)))


@register("scenario_collapse_share")
def q_scenario_collapse_share(spark, sf_dir):
    return rounded(pj.scenario_collapse_share(projections(spark, sf_dir), KEY))


@register("scenario_comparison")
def q_scenario_comparison(spark, sf_dir):
    return pj.scenario_rounding(pj.scenario_comparison(projections(spark, sf_dir), KEY))


@register("collapse_probability")
def q_collapse_probability(spark, sf_dir):
    return rounded(pj.breach_probability(scored_panel(spark, sf_dir), KEY))


@register("yearly_collapse_rate")
def q_yearly_collapse_rate(spark, sf_dir):
    return rounded(pj.yearly_breach_rate(scored_panel(spark, sf_dir), KEY))


@register("score_histogram")
def q_score_histogram(spark, sf_dir):
    return pj.score_histogram(scored_panel(spark, sf_dir), KEY, PANEL_RULES)


@register("path_summary")
def q_path_summary(spark, sf_dir):
    return pj.summary_rounding(pj.score_summary(scored_panel(spark, sf_dir), KEY, ("production", "debt_ratio", "rp_ratio")))


@register("traffic_light")
def q_traffic_light(spark, sf_dir):
    return rounded(pj.traffic_light(pj.breach_probability(scored_panel(spark, sf_dir), KEY)))


# ---------------------------------------------------------------- evaluation (SQL-exact)

from ..operators import ecosystem as eco  # noqa: E402
from ..operators import evaluate as ev  # noqa: E402
from ..operators import marts as mt  # noqa: E402
from ..operators import ml  # noqa: E402
from ..operators import regimes as rg  # noqa: E402
from ..operators.store import NotSaved  # noqa: E402

TARGETS = {"forest": "volume", "boost_revenue": "tax_take", "boost_debt": "ret_pct", "kernel": "n_orders"}
TRAIN_END, TEST_START = 1999, 2000


def feature_cols(target):
    return [m for m in PANEL_METRICS if m != target]


def split_panel(spark, sf_dir):
    return po.temporal_split(metrics_double(quarter_panel(spark, sf_dir)), TRAIN_END, TEST_START, date="period_start")


def baselines(spark, sf_dir, target="volume"):
    return ev.naive_forecasts(split_panel(spark, sf_dir), target, KEY, "period_start")


@register("regression_metrics")
def q_regression_metrics(spark, sf_dir):
    return rounded(ev.regression_metrics(baselines(spark, sf_dir), by=["model", KEY]))


@register("backtest_metrics")
def q_backtest_metrics(spark, sf_dir):
    sp = split_panel(spark, sf_dir)
    m = ev.regression_metrics(ev.naive_forecasts(sp, "volume", KEY, "period_start"), by="model")
    sizes = sp.agg(
        F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test")
    )
    out = m.select(
        "model", "mae", "rmse", "r2", "mape",
        sizes.select("n_train").scalar().alias("n_train"), sizes.select("n_test").scalar().alias("n_test"),
    )
    return rounded(out)


@register("backtest_series")
def q_backtest_series(spark, sf_dir):
    return rounded(ev.backtest_series(baselines(spark, sf_dir)))


@register("cv_folds")
def q_cv_folds(spark, sf_dir):
    df = ev.cv_folds(quarter_panel(spark, sf_dir), KEY, "period_start", block=730)
    return df.select(KEY, "period_start", "fold")


def production_series(spark, sf_dir, panel=None):
    rp = quarter_panel(spark, sf_dir) if panel is None else panel
    return rp.select(KEY, "period_start", (F.lit(4.7) * F.col("volume") / F.col("n_orders")).alias("production"))


def decline_params(spark, sf_dir):
    return ev.decline_fit(production_series(spark, sf_dir), "production", KEY, "period_start")


@register("decline_fit")
def q_decline_fit(spark, sf_dir):
    p = decline_params(spark, sf_dir)
    return p.select(KEY, F.round("q", 2).alias("q"), F.round("lam", 5).alias("lam"), "fitted")


@register("decline_curve")
def q_decline_curve(spark, sf_dir):
    c = ev.decline_curve(decline_params(spark, sf_dir), KEY)
    return c.select(KEY, "t", F.round("y_decline", 1).alias("y_decline"))


@register("component_errors")
def q_component_errors(spark, sf_dir):
    from pyspark.sql import Window

    s = production_series(spark, sf_dir)
    w = Window.partitionBy(KEY).orderBy("period_start")
    s = s.withColumn("t", (F.row_number().over(w) - 1).cast("double")).withColumn(
        "y_ml", F.coalesce(F.lag("production").over(w), F.col("production"))
    )
    p = s.join(decline_params(spark, sf_dir), KEY).withColumn("y_decline", F.col("q") * F.exp(-F.col("lam") * F.col("t")))
    p = p.withColumn("y_pred", F.lit(0.5) * F.col("y_ml") + F.lit(0.5) * F.col("y_decline")).withColumnRenamed(
        "production", "y_true"
    )
    errors = ev.component_errors(p, KEY)
    return errors.select(KEY, *[F.round(c, 3).alias(c) for c in ("mae", "rmse", "r2", "mae_ml", "mae_decline")])


# ---------------------------------------------------------------- regimes on labelled points


def labelled_points(spark, sf_dir):
    return panels.points(spark, sf_dir)


@register("silhouette")
def q_silhouette(spark, sf_dir):
    return rounded(rg.silhouette(labelled_points(spark, sf_dir)))


@register("silhouette_score")
def q_silhouette_score(spark, sf_dir):
    return rounded(rg.silhouette_score(labelled_points(spark, sf_dir)))


@register("silhouette_euclidean")
def q_silhouette_euclidean(spark, sf_dir):
    return rounded(rg.silhouette(labelled_points(spark, sf_dir), metric="euclidean"))


@register("silhouette_score_euclidean")
def q_silhouette_score_euclidean(spark, sf_dir):
    return rounded(rg.silhouette_score(labelled_points(spark, sf_dir), metric="euclidean"))


@register("cluster_inertia")
def q_cluster_inertia(spark, sf_dir):
    return rounded(rg.cluster_inertia(labelled_points(spark, sf_dir)))


@register("cluster_centroids")
def q_cluster_centroids(spark, sf_dir):
    return rounded(rg.cluster_centroids(labelled_points(spark, sf_dir)))


@register("cluster_sizes")
def q_cluster_sizes(spark, sf_dir):
    return rg.cluster_sizes(labelled_points(spark, sf_dir))


@register("regime_names")
def q_regime_names(spark, sf_dir):
    return rg.regime_names(labelled_points(spark, sf_dir).select("vec_id", "label"))


@register("regime_summary")
def q_regime_summary(spark, sf_dir):
    """Mean and deviation of every dimension per regime, long form."""
    p = rg.regime_names(labelled_points(spark, sf_dir))
    long = p.select("regime_name", F.posexplode("features").alias("dim", "x"))
    summary = long.groupBy("regime_name", "dim").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    return rounded(summary, digits=2)


@register("feature_metadata")
def q_feature_metadata(spark, sf_dir):
    df = feat.risk_index(risk_panel(spark, sf_dir), REFERENCE_INDEX)
    st = feat.risk_index_stats(df, "risk_index")
    return rounded(
        st.select(
            F.col("n").alias("n_rows"),
            F.lit(len(PANEL_METRICS)).alias("n_features_original"),
            F.lit(len(df.columns)).alias("n_features_final"),
            F.col("mean").alias("risk_index_mean"),
            F.col("std").alias("risk_index_std"),
            F.col("min").alias("risk_index_min"),
            F.col("max").alias("risk_index_max"),
        )
    )


# ---------------------------------------------------------------- pyspark.ml models (statistical checks)


PANEL = eco.PanelSpec(KEY, "period_start", tuple(PANEL_METRICS))
# One list drives training, prediction, backtest and reports. The hybrid's target
# is the production series; the surveyed roles of the others as in TARGETS.
MODELS = [
    eco.ModelSpec("hybrid", "hybrid", "production"),
    eco.ModelSpec("boost_revenue", "boosting", TARGETS["boost_revenue"]),
    eco.ModelSpec("boost_debt", "boosting", TARGETS["boost_debt"]),
    eco.ModelSpec("kernel", "kernel", TARGETS["kernel"]),
    eco.ModelSpec("regimes", "kmeans"),
]
REGRESSORS = [m for m in MODELS if m.kind != "kmeans"]


def training_data(spark, sf_dir):
    """The assembled quarter panel with the production series, materialised and
    in as many partitions as its rows need (a fit runs a job per iteration)."""
    q = metrics_double(quarter_panel(spark, sf_dir))
    rows = materialize(q.withColumn("production", F.lit(4.7) * F.col("volume") / F.col("n_orders")))
    n = rows.count()
    return spread(rows, n) if n > ROWS_PER_PART else rows.coalesce(1)


def rows_mark(rows):
    """Sum of the rows' hashes and their number: equal rows don't cancel."""
    hashes = F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")
    return rows.agg(F.sum(hashes).cast("string").alias("h"), F.count("*").alias("n")).first()


def fitted_models(spark, train, specs, tag, panel=None):
    """Models of these training rows: read from the session's model store if they
    have been fitted there before, else fitted, concurrently, and saved (S7).

    A store's name holds a mark of the rows and the specification, so other rows
    never meet old models. Models with an error are returned, never saved.
    """
    panel = panel or PANEL
    mark = rows_mark(train)
    paths, out, missing = {}, {}, []
    for spec in specs:
        about = hashlib.sha256(repr((tag, spec, panel, mark.h, mark.n)).encode()).hexdigest()[:20]
        paths[spec.name] = f"{ensure_checkpoint_dir(spark)}/models-{about}"
        try:
            out |= eco.load(paths[spec.name], spark)
        except NotSaved:
            missing.append(spec)
    if missing:
        for name, one in eco.train_all(train, missing, panel).items():
            out[name] = one
            if not one.error:
                eco.save({name: one}, paths[name], spark)
                out |= eco.load(paths[name], spark)  # what another writer saved first
    return {s.name: out[s.name] for s in specs}


def model_rows(spark, sf_dir, name):
    """Predictions of one model over its own training rows."""
    df = training_data(spark, sf_dir)
    fitted = fitted_models(spark, df, [m for m in MODELS if m.name == name], "full")
    return eco.predict_all(fitted, df, PANEL, origin="train"), fitted


def plain(predictions):
    return predictions.select("model", KEY, "period_start", "y_true", "y_pred")


def forest_of(spark, df):
    return ml.fit_forest(df, feature_cols(TARGETS["forest"]), TARGETS["forest"])


@register("rf_predictions")
def q_rf_predictions(spark, sf_dir):
    df = training_data(spark, sf_dir)
    return forest_of(spark, df).transform(df).select(
        F.lit("forest").alias("model"), KEY, "period_start",
        F.col(TARGETS["forest"]).alias("y_true"), F.col("prediction").alias("y_pred"),
    )


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    df = training_data(spark, sf_dir)
    ranked = ml.feature_importance(forest_of(spark, df), feature_cols(TARGETS["forest"]))
    rows = [(i + 1, f, float(v)) for i, (f, v) in enumerate(ranked)]
    return spark.createDataFrame(rows, "rank int, feature string, importance double")


@register("hybrid_forecast")
def q_hybrid_forecast(spark, sf_dir):
    """The hybrid with the surveyed time origin (t = n … 2n-1)."""
    df = training_data(spark, sf_dir)
    fitted = fitted_models(spark, df, [MODELS[0]], "full")
    return eco.predict_all(fitted, df, PANEL, origin="reference").drop("model", "error")


@register("gbt_revenue")
def q_gbt_revenue(spark, sf_dir):
    return plain(model_rows(spark, sf_dir, "boost_revenue")[0])


@register("gbt_debt")
def q_gbt_debt(spark, sf_dir):
    return plain(model_rows(spark, sf_dir, "boost_debt")[0])


@register("kernel_regression")
def q_kernel_regression(spark, sf_dir):
    return plain(model_rows(spark, sf_dir, "kernel")[0])


@register("cv_scores")
def q_cv_scores(spark, sf_dir):
    fitted = model_rows(spark, sf_dir, "kernel")[1]["kernel"]
    return spark.createDataFrame(fitted.scores, "c double, gamma_name string, gamma double, mae double")


@register("hybrid_component_errors")
def q_hybrid_component_errors(spark, sf_dir):
    """M6: the trained hybrid's errors by nation, and those of its forest and its
    decline curve alone."""
    df = training_data(spark, sf_dir)
    fitted = fitted_models(spark, df, [MODELS[0]], "full")["hybrid"]
    return eco.hybrid_errors(fitted, df, PANEL, KEY)


@register("predict_all")
def q_predict_all(spark, sf_dir):
    df = training_data(spark, sf_dir)
    return eco.predict_all(fitted_models(spark, df, REGRESSORS, "full"), df, PANEL)


@register("training_report")
def q_training_report(spark, sf_dir):
    """A row per model: the regressors' errors, the regimes' clustering metrics."""
    df = training_data(spark, sf_dir)
    fitted = fitted_models(spark, df, MODELS, "full")
    scored = eco.model_metrics(eco.predict_all(fitted, df, PANEL, origin="train"))
    return mt.r2_badges(scored.unionByName(eco.cluster_metrics(fitted["regimes"], df), allowMissingColumns=True))


@register("cluster_metrics")
def q_cluster_metrics(spark, sf_dir):
    df = training_data(spark, sf_dir)
    return eco.cluster_metrics(fitted_models(spark, df, [MODELS[-1]], "full")["regimes"], df)


@register("fitted_regime_summary")
def q_fitted_regime_summary(spark, sf_dir):
    """Means and deviations of the panel's metrics by fitted regime."""
    df = training_data(spark, sf_dir)
    fitted = fitted_models(spark, df, [MODELS[-1]], "full")["regimes"]
    labelled = fitted.model.transform(eco.regime_vectors(df, fitted.stats))
    ordered = rg.in_time_order(labelled, "period_start", "regime")
    return rounded(rg.regime_summary(rg.regime_names(ordered, "regime"), PANEL_METRICS), digits=2)


def backtest_rows(spark, sf_dir):
    df = training_data(spark, sf_dir)
    sp = po.temporal_split(df, TRAIN_END, TEST_START, date="period_start")
    train, test = (sp.where(F.col("split") == s).drop("split") for s in ("train", "test"))
    if test.count() < eco.MIN_BACKTEST[1]:
        return eco.backtest(train, test, REGRESSORS, PANEL)
    return eco.predict_all(fitted_models(spark, train, REGRESSORS, "past"), test, PANEL)


@register("backtest_predictions")
def q_backtest_predictions(spark, sf_dir):
    return backtest_rows(spark, sf_dir)


@register("backtest_model_metrics")
def q_backtest_model_metrics(spark, sf_dir):
    return eco.model_metrics(backtest_rows(spark, sf_dir))


@register("validation_report")
def q_validation_report(spark, sf_dir):
    """The backtest's report without the models that failed."""
    return mt.r2_badges(eco.without_errors(eco.model_metrics(backtest_rows(spark, sf_dir))))


def panel_pca(spark, sf_dir):
    df = training_data(spark, sf_dir)
    model, data = ml.pca_fit(df, PANEL_METRICS, k=4)
    return model, data


@register("pca_scores")
def q_pca_scores(spark, sf_dir):
    model, data = panel_pca(spark, sf_dir)
    return rounded(ml.pca_scores(model, data, [KEY, "period_start"]), digits=4)


@register("pca_variance")
def q_pca_variance(spark, sf_dir):
    model, _ = panel_pca(spark, sf_dir)
    return rounded(ml.pca_tables(model, PANEL_METRICS, spark)[0], digits=4)


@register("pca_loadings")
def q_pca_loadings(spark, sf_dir):
    model, _ = panel_pca(spark, sf_dir)
    return rounded(ml.pca_tables(model, PANEL_METRICS, spark)[1], digits=4)


@register("feature_metadata_pca")
def q_feature_metadata_pca(spark, sf_dir):
    """The principal components' block of the feature metadata."""
    model, _ = panel_pca(spark, sf_dir)
    variance = rounded(ml.pca_tables(model, PANEL_METRICS, spark)[0], digits=4)
    return variance.agg(
        F.count("*").alias("n_components"),
        F.max("cumulative_pct").alias("variance_pct"),
        F.bool_or("meets_target").alias("meets_target"),
    )


@register("feature_metadata_nested")
def q_feature_metadata_nested(spark, sf_dir):
    """The whole metadata as one row: a map of the components' variances, a
    struct of the index statistics, and the numbers of columns."""
    model, _ = panel_pca(spark, sf_dir)
    variance = ml.pca_tables(model, PANEL_METRICS, spark)[0]
    flat = q_feature_metadata(spark, sf_dir)
    return flat.join(ml.variance_map(variance)).select(
        "pca_variance",
        F.struct(*[F.col(f"risk_index_{x}").alias(x) for x in ("mean", "std", "min", "max")]).alias("risk_index_stats"),
        "n_features_original",
        (F.col("n_features_final") + model.getK()).alias("n_features_final"),
    )


COMPONENTS = tuple(f"PC{i}" for i in range(1, 5))


def panel_regimes(spark, sf_dir):
    """Regimes of the z-scored components, numbered in order of their mean date
    before they get their names (cluster ids carry no order)."""
    model, data = panel_pca(spark, sf_dir)
    pcs = materialize(ml.pca_scores(model, data, [KEY, "period_start"]))
    components = eco.PanelSpec(KEY, "period_start", COMPONENTS)
    spec = eco.ModelSpec("pca_regimes", "kmeans")
    fitted = fitted_models(spark, pcs, [spec], "components", components)[spec.name]
    labelled = fitted.model.transform(eco.regime_vectors(pcs, fitted.stats))
    return rg.regime_names(rg.in_time_order(labelled, "period_start", "regime"), "regime")


@register("kmeans_regimes")
def q_kmeans_regimes(spark, sf_dir):
    return panel_regimes(spark, sf_dir).select(KEY, "period_start", "regime", "regime_name")


@register("pca_regime_points")
def q_pca_regime_points(spark, sf_dir):
    return panel_regimes(spark, sf_dir).select(KEY, "period_start", "PC1", "PC2", "regime_name")


# ---------------------------------------------------------------- marts


@register("risk_zones")
def q_risk_zones(spark, sf_dir):
    df = feat.risk_index(risk_panel(spark, sf_dir), REFERENCE_INDEX)
    return mt.risk_zones(df).select(KEY, "period_start", "risk_index", "zone", "above_alert")


@register("debt_bands")
def q_debt_bands(spark, sf_dir):
    return rounded(mt.debt_bands(projections(spark, sf_dir)).select(KEY, "scenario", "year", "debt_ratio", "band", "above_critical"))


@register("score_classes")
def q_score_classes(spark, sf_dir):
    return mt.score_classes(pj.score_histogram(scored_panel(spark, sf_dir), KEY, PANEL_RULES), PANEL_RULES)


@register("scenario_long")
def q_scenario_long(spark, sf_dir):
    return rounded(mt.scenario_long(projections(spark, sf_dir), KEY))


@register("production_timeline")
def q_production_timeline(spark, sf_dir):
    panel = materialize(quarter_panel(spark, sf_dir))  # one scan for history and projections
    hist = production_series(spark, sf_dir, panel).groupBy(KEY, F.year("period_start").alias("year")).agg(
        F.avg("production").alias("production")
    )
    return rounded(mt.production_timeline(hist, projections(spark, sf_dir, panel), KEY))


def nation_kpis(spark, sf_dir):
    k = scored_panel(spark, sf_dir).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_quarters"), F.avg("risk_index").alias("risk_index_mean"), F.avg(F.col("breach").cast("double")).alias("p_collapse")
    )
    return k.withColumn("p_collapse_pct", F.col("p_collapse") * F.lit(100.0))


@register("kpi_badges")
def q_kpi_badges(spark, sf_dir):
    return rounded(mt.kpi_badges(nation_kpis(spark, sf_dir)).drop("p_collapse", "n_quarters"))


@register("run_summary")
def q_run_summary(spark, sf_dir):
    k = pj.traffic_light(nation_kpis(spark, sf_dir), "p_collapse")
    shares = pj.scenario_collapse_share(projections(spark, sf_dir), KEY)
    wide = shares.groupBy(KEY).pivot("scenario", [s.name for s in REFERENCE_SCENARIOS]).agg(F.first("collapse_share"))
    wide = wide.select(KEY, *[F.col(s.name).alias(f"share_{s.name}") for s in REFERENCE_SCENARIOS])
    panel = quarter_panel(spark, sf_dir)
    shape = k.agg(F.sum("n_quarters").alias("n")).scalar()  # a row per nation and quarter
    found = k.join(wide, KEY).drop("p_collapse")
    return rounded(found.select("*", shape.alias("panel_rows"), F.lit(len(panel.columns)).alias("panel_columns")))
