"""Hand-made edge fixtures (5–12 rows) for each semantic that bites."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from panelrisk.operators import clean as cl
from panelrisk.operators import disagg as dg
from panelrisk.operators import evaluate as ev
from panelrisk.operators import features as feat
from panelrisk.operators import marts as mt
from panelrisk.operators import panel_ops as po
from panelrisk.operators import project as pj
from panelrisk.operators import regimes as rg
from panelrisk.operators import rules as rl
from panelrisk.sources import panels
from panelrisk.sources.tables import annual_schema, export_by, quarterly_schema, read_csv_source, to_json_records, write_table
from panelrisk.specs import IndexSpec, IndexTerm, Rule, RuleSet


def rows(df, order):
    return [r.asDict() for r in df.orderBy(*order).collect()]


def test_interpolation_edges_and_all_null(spark):
    data = [("a", i, v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])] + [
        ("b", i, None) for i in range(3)
    ]
    df = spark.createDataFrame(data, "k string, t int, v double")
    out = rows(cl.interpolate_linear(df, ["v"], "k", "t"), ["k", "t"])
    assert [r["v"] for r in out if r["k"] == "a"] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]
    assert all(r["v"] is None for r in out if r["k"] == "b")


def test_fill_forward_back(spark):
    df = spark.createDataFrame([("a", 0, None), ("a", 1, 2.0), ("a", 2, None), ("a", 3, 5.0)], "k string, t int, v double")
    assert [r["v"] for r in rows(cl.fill_forward_back(df, ["v"], "k", "t"), ["t"])] == [2.0, 2.0, 2.0, 5.0]


def test_winsorize_fractional_quartiles_and_constant(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([("a", float(v)) for v in vals] + [("c", 7.0)] * 3, "k string, v double")
    out = rows(cl.iqr_winsorize(df, ["v"], by="k"), ["k", "v"])
    # Q1=2, Q3=4, IQR=2 -> upper fence 7
    assert [r["v"] for r in out if r["k"] == "a"] == [1.0, 2.0, 3.0, 4.0, 7.0]
    assert [r["v"] for r in out if r["k"] == "c"] == [7.0, 7.0, 7.0]


def test_minmax_constant_is_zero_and_zscore_pop(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, c double")
    mm = rows(feat.minmax_scale(df, ["x", "c"]), ["x"])
    assert [r["x_mm"] for r in mm] == [0.0, 0.5, 1.0]
    assert [r["c_mm"] for r in mm] == [0.0, 0.0, 0.0]
    z = rows(feat.zscore(df, ["x", "c"]), ["x"])
    assert z[0]["x_z"] == pytest.approx(-math.sqrt(1.5))
    assert [r["c_z"] for r in z] == [0.0, 0.0, 0.0]


def test_risk_index_bounds(spark):
    spec = IndexSpec(terms=(IndexTerm("a", "direct", 0.5), IndexTerm("b", "inverse", 0.5)))
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 1.0), (3.0, 4.0)], "a double, b double")
    out = [r["risk_index"] for r in rows(feat.risk_index(df, spec), ["a"])]
    assert all(0.0 <= v <= 100.0 for v in out)
    assert out[0] == 50.0  # a at min, 1/max(b, .1) at max


def test_disaggregation_sum_constraint_and_single_year(spark):
    annual = spark.createDataFrame(
        [("a", 2000, 10.0), ("a", 2002, 14.0), ("a", 2001, 12.0), ("b", 2000, 116.0)], "k string, year int, y double"
    )
    q = dg.disaggregate_trend(annual, ["y"], "k")
    sums = {(r["k"], r["year"]): r["s"] for r in q.groupBy("k", "year").agg(F.sum("y").alias("s")).collect()}
    assert sums[("a", 2000)] == pytest.approx(10.0) and sums[("a", 2002)] == pytest.approx(14.0)
    b = [r["y"] for r in rows(q.where("k = 'b'"), ["quarter"])]
    # one year: minimum-norm solution 4Y/116 + 10Y/116 * q
    assert b == pytest.approx([4.0 + 10.0 * i for i in range(1, 5)])


def test_disaggregation_indicator_branch_and_zero_indicator(spark):
    annual = spark.createDataFrame([("a", 2000, 8.0), ("a", 2001, 12.0), ("z", 2000, 4.0)], "k string, year int, y double")
    ind = spark.createDataFrame(
        [("a", dt.date(2010, 1 + 3 * i, 1), float(i + 1)) for i in range(4)]
        + [("a", dt.date(2011, 1 + 3 * i, 1), float(i + 1)) for i in range(4)]
        + [("z", dt.date(2010, 1 + 3 * i, 1), 0.0) for i in range(4)],
        "k string, period_start date, y double",
    )
    out = dg.disaggregate(annual, ["y"], "k", indicator=ind, method="by_length")
    sums = {(r["k"], r["year"]): r["s"] for r in out.groupBy("k", "year").agg(F.sum("y").alias("s")).collect()}
    assert sums[("a", 2000)] == pytest.approx(8.0) and sums[("a", 2001)] == pytest.approx(12.0)
    assert [r["y"] for r in rows(out.where("k = 'z'"), ["quarter"])] == pytest.approx([1.0] * 4)


def test_rules_are_strict(spark):
    rs = RuleSet(rules=(Rule("x", ">", 5.0), Rule("y", "<", 1.0)), breach_at=2)
    df = spark.createDataFrame([(5.0, 1.0), (5.1, 0.9), (None, 0.0)], "x double, y double")
    out = rows(rl.breach_score(df, rs), ["y"])
    assert [(r["score"], r["breach"]) for r in out] == [(1, False), (2, True), (0, False)]


def test_traffic_light_boundaries(spark):
    df = spark.createDataFrame([(0.2999,), (0.30,), (0.5999,), (0.60,)], "p double")
    out = [r["light"] for r in rows(pj.traffic_light(df, "p"), ["p"])]
    assert out == ["VERDE", "AMARILLO", "AMARILLO", "ROJO"]


def test_decline_fit_recovers_curve_and_falls_back(spark):
    data = [("a", dt.date(2000, 1, 1) + dt.timedelta(days=30 * t), 700.0 * math.exp(-0.031 * t)) for t in range(30)]
    data += [("b", dt.date(2000, 1, 1) + dt.timedelta(days=30 * t), 70.0) for t in range(5)]
    df = spark.createDataFrame(data, "k string, d date, y double")
    out = {r["k"]: r for r in ev.decline_fit(df, "y", "k", "d").collect()}
    assert out["a"]["q"] == pytest.approx(700.0, abs=1e-3) and out["a"]["lam"] == pytest.approx(0.031, abs=1e-6)
    assert out["b"]["fitted"] is False and out["b"]["q"] == 70.0 and out["b"]["lam"] == 0.035


def test_metrics_mape_mask_and_zero_variance(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (2.0, 3.0)], "y_true double, y_pred double")
    m = ev.regression_metrics(df).collect()[0]
    assert m["mape"] == pytest.approx(50.0)
    c = ev.regression_metrics(spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y_true double, y_pred double")).collect()[0]
    assert c["r2"] == 0.0
    p = ev.regression_metrics(spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y_true double, y_pred double")).collect()[0]
    assert p["r2"] == 1.0


def test_regime_fallback_name_and_silhouette_singleton(spark):
    pts = spark.createDataFrame(
        [(1, [0.0, 0.0], 0), (2, [0.1, 0.0], 0), (3, [5.0, 5.0], 9)], "vec_id long, features array<double>, label int"
    )
    names = {r["label"]: r["regime_name"] for r in rg.regime_names(pts).collect()}
    assert names[9] == "Clúster 9"
    sil = {r["vec_id"]: r["silhouette"] for r in rg.silhouette(pts).collect()}
    assert sil[3] == 0.0 and sil[1] > 0.9


def test_scenario_defaults_and_histogram_covers_all_rules(spark):
    init = spark.createDataFrame([(1, None)], "nation_key int, production double")
    proj = pj.scenario_projection(init, "nation_key")
    assert proj.count() == 24
    first = proj.where("scenario = 'base' AND year = 2025").collect()[0]
    assert first["production"] == pytest.approx(470.0 * (1 - 0.035))
    scored = spark.range(500).selectExpr("1 as nation_key", "cast(id % 9 as int) as score")
    rules = RuleSet(rules=tuple(Rule(f"x{i}", ">", 0.0) for i in range(9)), breach_at=5)
    hist = pj.score_histogram(scored, "nation_key", rules).collect()
    assert len(hist) == 10 and sum(r["n_obs"] for r in hist) == 500


def test_csv_source_rename_and_period_parse(spark, tmp_path):
    schema = annual_schema(headers=True)
    header = ",".join(f'"{f.name}"' for f in schema.fields)
    line = ",".join(["2001"] + ["1.5"] * 12)
    p = tmp_path / "annual.csv"
    p.write_text(header + "\n" + line + "\n", encoding="utf-8")
    df = read_csv_source(spark, str(p), schema)
    assert "production" in df.columns and "debt_ratio" in df.columns
    lab = spark.createDataFrame([("2005 T3",)], "period string")
    r = panels.parse_period(lab).collect()[0]
    assert (r["year"], r["quarter"], r["period_start"]) == (2005, 3, dt.date(2005, 7, 1))


def test_quarterly_csv_source(spark, tmp_path):
    schema = quarterly_schema(headers=True)
    header = ",".join(f'"{f.name}"' for f in schema.fields)
    lines = [",".join(["2005 T1"] + ["1.5"] * 12), ",".join(["2005 T4"] + [""] * 12)]
    p = tmp_path / "quarterly.csv"
    p.write_text("\n".join([header, *lines]) + "\n", encoding="utf-8")
    df = panels.parse_period(read_csv_source(spark, str(p), schema))
    got = rows(df, ["period_start"])
    assert [r["period_start"] for r in got] == [dt.date(2005, 1, 1), dt.date(2005, 10, 1)]
    assert got[0]["production"] == 1.5 and got[1]["production"] is None


def test_writers_and_json_records(spark, tmp_path):
    df = spark.createDataFrame([("base", 2025, 1.5), ("base", 2026, None), ("low", 2025, 2.5)], "scenario string, year int, v double")
    paths = export_by(df, str(tmp_path / "out"))
    assert sorted(paths) == ["base", "low"]
    back = spark.read.option("header", True).schema("year int, v double").csv(paths["base"])
    assert [r["v"] for r in rows(back, ["year"])] == [1.5, None]
    for fmt in ("parquet", "json"):
        where = write_table(df, str(tmp_path / fmt), fmt=fmt)
        assert spark.read.format(fmt).schema(df.schema).load(where).count() == 3
    records = [r["record"] for r in to_json_records(df).collect()]
    assert '{"scenario":"low","year":2025,"v":2.5}' in records


def test_profile_lists_columns(spark):
    df = spark.createDataFrame([(1, None), (2, dt.date(2020, 1, 1))], "a int, d date")
    r = po.profile_table(df, "d").first()
    assert (r["n_rows"], r["n_cols"], list(r["columns"]), r["n_nulls"]) == (2, 2, ["a", "d"], 1)
    assert [x["a"] for x in po.sample_rows(df, "a", 1).collect()] == [1]


def test_r2_badges(spark):
    df = spark.createDataFrame([(0.95,), (0.9,), (0.7,)], "r2 double")
    assert [r["r2_badge"] for r in rows(mt.r2_badges(df), ["r2"])] == ["Mejorable", "Bueno", "Excelente"]
