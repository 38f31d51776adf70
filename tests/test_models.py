"""Statistical operators: known functions, identities and tolerances."""

import datetime as dt
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from panelrisk import session
from panelrisk.operators import ecosystem as eco
from panelrisk.operators import kernel, ml, store
from panelrisk.operators import regimes as rg
from panelrisk.operators.ml import BoostSpec, ForestSpec

PANEL = eco.PanelSpec("k", "d", ("a", "b", "c"))
SMALL = {"forest": ForestSpec(num_trees=20, max_depth=6), "boost": BoostSpec(max_iter=15, step_size=0.3)}
SPECS = [
    eco.ModelSpec("hybrid", "hybrid", "a"),
    eco.ModelSpec("boost", "boosting", "b"),
    eco.ModelSpec("kernel", "kernel", "c"),
    eco.ModelSpec("regimes", "kmeans", k=3),
]


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(1)
    data = []
    for k in range(4):
        for t in range(30):
            b, c = rng.uniform(-1, 1), rng.uniform(-1, 1)
            a = 600.0 * math.exp(-0.02 * t) + 5.0 * b
            data.append((k, dt.date(2000, 1, 1) + dt.timedelta(days=91 * t), a, 2.0 * b + (1.0 if c > 0 else -1.0), math.sin(2.0 * b) + 0.01 * a))
    return spark.createDataFrame(data, "k int, d date, a double, b double, c double").coalesce(1)


@pytest.fixture(scope="module")
def fitted(panel):
    return eco.train_all(panel, SPECS, PANEL, **SMALL)


def test_report_has_all_models_without_errors(fitted, panel):
    report = {r.model: r for r in eco.model_metrics(eco.predict_all(fitted, panel, PANEL, origin="train")).collect()}
    assert set(report) == {"hybrid", "boost", "kernel"} and all(r.error is None for r in report.values())
    assert report["hybrid"].r2 > 0.9 and report["boost"].r2 > 0.5
    assert all(round(r.mae, 4) == r.mae and round(r.mape, 2) == r.mape for r in report.values())


def test_hybrid_is_half_forest_half_decline(fitted, panel):
    rows = eco.predict_one(fitted["hybrid"], panel, PANEL, origin="train").collect()
    assert all(r.y_pred == pytest.approx(0.5 * r.y_ml + 0.5 * r.y_decline) for r in rows)
    params = {r.k: (r.q, r.lam, r.n) for r in fitted["hybrid"].decline.collect()}
    late = eco.predict_one(fitted["hybrid"], panel, PANEL).where("k = 1").orderBy("d").collect()
    q, lam, n = params[1]
    assert [r.y_decline for r in late] == pytest.approx([q * math.exp(-lam * (n + i)) for i in range(n)])


def test_kernel_follows_a_smooth_function(spark):
    rng = random.Random(2)
    data = [(0, dt.date(2000, 1, 1) + dt.timedelta(days=i), x := rng.uniform(-2, 2), y := rng.uniform(-2, 2), math.sin(x) + math.cos(y)) for i in range(400)]
    df = spark.createDataFrame(data, "k int, d date, a double, b double, c double").coalesce(1)
    f = eco.train_all(df, [eco.ModelSpec("kernel", "kernel", "c")], PANEL)["kernel"]
    mae = eco.predict_one(f, df, PANEL).agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred")))).first()[0]
    assert mae < 0.15 and [(c, g) for c, g, _, _ in f.scores] == [(c, g) for c in kernel.C_GRID for g in kernel.GAMMA_GRID]


def test_save_load_gives_equal_predictions(spark, fitted, panel, tmp_path):
    again = eco.load(eco.save(fitted, str(tmp_path / "models"), spark), spark)
    key = lambda r: (r.model, r.k, r.d)
    before = sorted(eco.predict_all(fitted, panel, PANEL).collect(), key=key)
    assert before == sorted(eco.predict_all(again, panel, PANEL).collect(), key=key)
    assert eco.cluster_metrics(again["regimes"], panel).collect() == eco.cluster_metrics(fitted["regimes"], panel).collect()


def test_gates_give_error_rows(spark, panel):
    few = panel.limit(4)
    out = eco.backtest(few, panel, SPECS[:2], PANEL, **SMALL)
    assert [(r.model, r.y_pred, "needs 5 training rows" in r.error) for r in out.orderBy("model").collect()] == [("boost", None, True), ("hybrid", None, True)]
    report = eco.model_metrics(eco.backtest(panel, panel.limit(1), SPECS[:2], PANEL, **SMALL))
    assert sorted(r.error for r in report.collect()) == ["needs 2 test rows, has 1"] * 2
    assert eco.without_errors(report).count() == 0
    bad = eco.train_all(panel, [eco.ModelSpec("odd", "boosting", "nothing")], PANEL, **SMALL)["odd"]
    assert bad.error and eco.predict_one(bad, panel, PANEL).first().error == bad.error


def test_gaps_are_filled_before_fit(spark, panel):
    holes = panel.withColumn("b", F.when(F.dayofmonth("d") > 3, F.col("b")))
    assert eco.prepared(holes, PANEL).where("b is null").count() == 0


def test_cluster_metrics_agree_with_direct_sums(fitted, panel):
    m = eco.cluster_metrics(fitted["regimes"], panel).first()
    labelled = fitted["regimes"].model.transform(eco.regime_vectors(panel, fitted["regimes"].stats)).collect()
    centres = np.array(fitted["regimes"].model.clusterCenters())
    cost = sum(float(((r.features.toArray() - centres[r.regime]) ** 2).sum()) for r in labelled)
    assert m.k == 3 and m.inertia == pytest.approx(cost)


def test_kmeans_keeps_the_best_restart(spark):
    rng = np.random.default_rng(0)
    pts = [[float(x), float(y)] for cx, cy in ((0, 0), (9, 0), (0, 9)) for x, y in rng.normal((cx, cy), 0.3, (30, 2))]
    df = spark.createDataFrame([(p,) for p in pts], "f array<double>").select(array_to_vector("f").alias("v")).coalesce(1)
    best = ml.kmeans_restarts(df, "v", k=3, restarts=5)
    one = [ml.kmeans_restarts(df, "v", k=3, restarts=1, seed=42 + i).summary.trainingCost for i in range(5)]
    assert best.summary.trainingCost <= min(one) + 1e-9


def test_pca_loadings_are_orthonormal_and_variances_complete(spark, panel):
    model, data = ml.pca_fit(panel, ["a", "b", "c"], k=3)
    pc = model.pc.toArray()
    assert np.allclose(pc.T @ pc, np.eye(3), atol=1e-8)
    assert model.explainedVariance.toArray().sum() == pytest.approx(1.0)
    signs = ml.pca_signs(model)
    assert all((pc[:, j] * signs[j])[abs(pc[:, j]).argmax()] > 0 for j in range(3))
    scores = np.array([list(r) for r in ml.pca_scores(model, data, [], k=3).collect()])
    assert np.allclose(scores.mean(axis=0), 0, atol=1e-8)
    z = panel.select("a", "b", "c").toPandas().to_numpy()
    eig = np.sort(np.linalg.eigvalsh(np.corrcoef(z.T)))[::-1] / 3
    assert np.allclose(model.explainedVariance.toArray(), eig, atol=1e-8)


def test_inertia_of_tight_far_clusters(spark):
    pts = spark.createDataFrame([(i, [1e8 + 0.001 * i, -1e8], 0) for i in range(5)], "vec_id long, features array<double>, label int")
    assert rg.cluster_inertia(pts).first().inertia == pytest.approx(1e-5, rel=1e-2)


def test_disaggregation_equals_dense_least_squares(spark):
    from panelrisk.operators import disagg as dg

    y = [40.0, 52.0, 47.0, 60.0]
    annual = spark.createDataFrame([("k", 2000 + i, v) for i, v in enumerate(y)], "k string, year int, y double")
    got = [r.y for r in dg.disaggregate(annual, ["y"], "k").orderBy("period_start").collect()]
    n = len(y)
    c = np.kron(np.eye(n), np.ones(4))
    x = np.column_stack([np.ones(4 * n), np.arange(1, 4 * n + 1)])
    g = np.linalg.inv(c @ c.T)
    beta = np.linalg.pinv((c @ x).T @ g @ (c @ x)) @ (c @ x).T @ g @ np.array(y)
    want = x @ beta + c.T @ g @ (np.array(y) - c @ x @ beta)
    assert np.allclose(got, want)


def test_outliers_pull_the_robust_loss_less(spark):
    rng = random.Random(3)
    data = []
    for i in range(600):
        x = rng.uniform(-2, 2)
        y = math.sin(x)
        data.append((0, i, x, y + (40.0 if rng.random() < 0.08 else rng.gauss(0, 0.02)), y))
    df = spark.createDataFrame(data, "k int, d int, x double, y double, clean double").coalesce(2).cache()
    errors = {}
    for loss in kernel.LOSSES:
        stats, weights, gamma, scores = kernel.search(df, "y", ["x"], "k", "d", loss, gammas=(0.5, "auto"))
        p = kernel.predicted(df, stats, weights, gamma)
        errors[loss] = p.agg(F.avg(F.abs(F.col("prediction") - F.col("clean")))).first()[0]
        assert [(c, name) for c, name, _, _ in scores] == [(c, g) for c in kernel.C_GRID for g in ("0.5", "auto")]
    df.unpersist()
    assert errors["robust"] < 0.2 < errors["squared"]


def test_unknown_loss_and_gammas(spark, panel):
    with pytest.raises(ValueError, match="loss"):
        kernel.search(panel, "c", ["a"], "k", "d", "odd")
    stats = kernel.column_stats(panel.withColumn("same", F.lit(2.0)), ["a", "same"])
    assert kernel.gamma_of(panel, {"a": stats["a"]}, "scale") == pytest.approx(1.0)
    assert kernel.gamma_of(panel.withColumn("same", F.lit(2.0)), stats, "scale") == pytest.approx(1.0)
    assert kernel.gamma_of(panel, stats, "auto") == 0.5 and kernel.gamma_of(panel, stats, 3) == 3.0


def test_decline_state_is_a_table_of_all_keys(spark):
    df = spark.range(60_000).select(
        (F.col("id") % 20_000).alias("k"), F.floor(F.col("id") / 20_000).alias("d"),
        (F.lit(500.0) * F.exp(-0.05 * F.floor(F.col("id") / 20_000))).alias("y"),
    )
    from panelrisk.operators.evaluate import decline_fit

    for block in (None, 2):
        got = decline_fit(df, "y", "k", "d", block=block)
        row = got.agg(F.count("*"), F.min("q"), F.max("q"), F.min("lam"), F.max("lam"), F.max("n")).first()
        assert row[0] == 20_000 and row[5] == 3
        assert row[1:5] == pytest.approx((500.0, 500.0, 0.05, 0.05), rel=1e-6)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_component_errors_of_the_hybrid(fitted, panel):
    rows = eco.predict_one(fitted["hybrid"], panel, PANEL, origin="train").collect()
    got = eco.hybrid_errors(fitted["hybrid"], panel, PANEL).first()
    y = np.array([r.y_true for r in rows])
    for name, p in (("mae", "y_pred"), ("mae_ml", "y_ml"), ("mae_decline", "y_decline")):
        assert got[name] == pytest.approx(np.abs(y - np.array([r[p] for r in rows])).mean())
    e = y - np.array([r.y_pred for r in rows])
    assert got.rmse == pytest.approx(np.sqrt((e**2).mean())) and got.r2 == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())
    assert {r.k for r in eco.hybrid_errors(fitted["hybrid"], panel, PANEL, "k").collect()} == {0, 1, 2, 3}


def test_a_failed_fit_is_neither_caught_nor_saved(spark, panel, monkeypatch, tmp_path):
    from panelrisk.plans import queries_more as qm

    spec = eco.ModelSpec("kernel", "kernel", "c")
    whole = kernel.search

    def lost(*args, **more):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(kernel, "search", lost)
    with pytest.raises(RuntimeError, match="executor lost"):
        qm.fitted_models(spark, panel, [spec], str(tmp_path), PANEL)
    monkeypatch.setattr(kernel, "search", whole)
    assert qm.fitted_models(spark, panel, [spec], str(tmp_path), PANEL)["kernel"].weights
    bad = eco.ModelSpec("odd", "boosting", "nothing")
    for _ in range(2):
        assert qm.fitted_models(spark, panel, [bad], str(tmp_path), PANEL)["odd"].error
    with pytest.raises(ValueError, match="odd"):
        eco.save(eco.train_all(panel, [bad], PANEL), str(tmp_path / "m"), spark)


def test_uncommitted_and_damaged_versions_are_not_read(spark, fitted, tmp_path):
    path = str(tmp_path / "models")
    with pytest.raises(store.NotSaved):
        eco.load(path, spark)

    def broken(folder):
        fitted["hybrid"].decline.write.parquet(folder)
        raise OSError("disk full")

    with pytest.raises(OSError):
        store.publish(spark, path, [], {"hybrid/decline": broken})
    with pytest.raises(store.NotSaved):
        eco.load(path, spark)
    one = {"hybrid": fitted["hybrid"]}
    eco.save(one, path, spark)
    eco.save(one, path, spark)  # a second writer
    first, second = [r.version for r in store.versions(spark, path).orderBy("version").collect()]
    assert store.committed(spark, path)[0] == f"{path}/{first}" == store.committed(spark, path)[0]
    fitted["hybrid"].decline.limit(1).write.mode("append").parquet(f"{path}/{first}/hybrid/decline")
    assert store.committed(spark, path)[0] == f"{path}/{second}"
    assert eco.load(path, spark)["hybrid"].decline.count() == fitted["hybrid"].decline.count()


def test_equal_rows_do_not_cancel_in_the_mark(spark):
    from panelrisk.plans.queries_more import rows_mark

    a, b = (spark.createDataFrame([(x,) for x in xs], "x int") for xs in ((1, 1, 2), (7, 7, 2)))
    assert rows_mark(a) != rows_mark(b) and rows_mark(a) == rows_mark(a.orderBy(F.desc("x")))


def test_regimes_are_numbered_in_time_order(spark):
    data = [(1990 + i, label) for i, label in enumerate([4, 4, 0, 0, 2, 2, 4])]
    df = spark.createDataFrame([(dt.date(y, 1, 1), label) for y, label in data], "d date, regime int")
    got = [r.regime for r in rg.in_time_order(df, "d", "regime").orderBy("d").collect()]
    assert got == [0, 0, 1, 1, 2, 2, 0]  # the mean of 4 comes just before that of 0


def test_euclidean_silhouette_of_every_pair(spark, monkeypatch):
    monkeypatch.setattr(rg, "BLOCK", 16)
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 4, (6, 3))
    pts = [(i, [float(v) for v in rng.normal(centres[i % 5], 1 + i % 3)], i % 5) for i in range(150)]
    pts += [(900, [50.0, 0.0, 0.0], 7), (901, [1.0, 1.0, 1.0], 8), (902, [1.0, 1.0, 1.0], 8)]
    x, labels = np.array([p for _, p, _ in pts]), np.array([c for _, _, c in pts])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = {}
    for k, (i, _, c) in enumerate(pts):
        own = labels == c
        a = d[k, own].sum() / (own.sum() - 1) if own.sum() > 1 else None
        b = min(d[k, labels == o].mean() for o in set(labels.tolist()) if o != c)
        want[i] = 0.0 if a is None else (b - a) / max(a, b)
    df = spark.createDataFrame(pts, "vec_id long, features array<double>, label int")
    got = {r.vec_id: r.silhouette for r in rg.silhouette(df, metric="euclidean").collect()}
    assert got == pytest.approx(want)
    assert rg.silhouette_score(df, metric="euclidean").first()[0] == pytest.approx(np.mean(list(want.values())))
    one = df.where("label = 0")
    assert {r.silhouette for r in rg.silhouette(one, metric="euclidean").collect()} == {0.0}
    assert rg.silhouette(df.limit(0), metric="euclidean").collect() == []
    with pytest.raises(ValueError, match="metric"):
        rg.silhouette(df, metric="odd")


def test_summed_distances_of_close_and_far_points():
    rng = np.random.default_rng(3)
    y = rng.normal(0, 1, (700, 8)) + 1e6
    y[100:300] = y[0]  # equal points have distance 0, not the rounding of their norms
    y[300:400] = y[0] + rng.normal(0, 1e-5, (100, 8))
    want = np.array([np.sqrt(((y - row) ** 2).sum(axis=1)).sum() for row in y])
    assert rg._summed_distances(y, y) == pytest.approx(want, rel=1e-9)
    same = np.full((5, 8), 1e6)
    assert rg._summed_distances(same, same).tolist() == [0.0] * 5
    y[7, 2] = np.inf
    assert np.isinf(rg._summed_distances(y[:3], y)).all()


def test_block_pair_never_becomes_python_objects(monkeypatch):
    """A vector is read from Arrow as it lies: lists of numbers took most of the time."""
    xs = pa.array([[[0.0, 0.0], [3.0, 4.0]], [[0.0, 0.0]]], pa.list_(pa.list_(pa.float64())))
    group = pa.table({"c": pa.array([1, 1], pa.int32()), "side": ["points", "cluster"], "ids": pa.array([[5, 6], [7]], pa.list_(pa.int64())), "xs": xs})

    class NoLists:
        def __getattr__(self, name):
            if name == "to_pylist":
                raise AssertionError(name)
            return getattr(group, name)

    assert rg._distance_sums(NoLists()).to_pydict() == {"id": [5, 6], "c": [1, 1], "total": [0.0, 5.0]}
    with pytest.raises(ValueError, match="vectors"):
        rg._distance_sums(group.set_column(3, "xs", pa.array([[[0.0, 0.0], None], [[0.0, 0.0]]], xs.type)))


def test_few_bytes_are_not_left_in_one_part(spark, panel, monkeypatch):
    """A fit's work goes with the rows, not their bytes: a shuffle left 42,000 rows to one core."""
    seen = {}
    specs = [SPECS[0], SPECS[2]]
    one = eco.predict_all(eco.train_all(panel, specs[1:], PANEL), panel, PANEL)
    want = {(r.k, r.d): r.y_pred for r in one.collect()}
    monkeypatch.setattr(session, "ROWS_PER_PART", 20)
    fit_one, sums, forest = eco.train_one, kernel._sums, eco.fit_forest
    note = lambda name, df: seen.setdefault(name, set()).add((df.rdd.getNumPartitions(), df.storageLevel.useMemory))
    monkeypatch.setattr(eco, "train_one", lambda rows, *a, **more: (note("fit", rows), fit_one(rows, *a, **more))[1])
    monkeypatch.setattr(eco, "fit_forest", lambda rows, *a: (note("forest", rows), forest(rows, *a))[1])
    monkeypatch.setattr(kernel, "_sums", lambda rows, *a: (note("kernel", rows), sums(rows, *a))[1])
    fitted = eco.train_all(panel, specs, PANEL, **SMALL)
    assert seen == {"fit": {(6, True)}, "forest": {(6, True)}, "kernel": {(6, True)}}  # the search reads rows dealt once
    assert not any(f.error for f in fitted.values()) and fitted["hybrid"].decline.count() == 4
    predictions = eco.predict_all({"kernel": fitted["kernel"]}, panel, PANEL)
    assert predictions.rdd.getNumPartitions() == 6
    got = {(r.k, r.d): r.y_pred for r in predictions.collect()}
    assert got == pytest.approx(want, abs=1e-3)


def test_spread_keeps_rows_and_parts_of_few(spark):
    df = spark.range(25).select(F.when(F.col("id") > 2, F.col("id") % 7).alias("x")).coalesce(1)
    assert session.spread(df, 25).rdd.getNumPartitions() == 1 and session.spread(df, 20_001).rdd.getNumPartitions() == 3
    assert sorted(map(str, session.spread(df, 20_001).collect())) == sorted(map(str, df.collect()))
    assert session.spread(df.limit(0), 0).count() == 0
