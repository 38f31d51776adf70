"""The model family (M1, M5–M14, B1–B3, S7): one list of specifications drives
training, prediction, backtesting, reports and persistence.

* ``hybrid``  — half a random forest on the panel metrics, half each key's
  exponential decline curve.
* ``boosting`` — gradient-boosted trees.
* ``kernel``  — regression on random Fourier features of z-scored metrics with a loss
  robust to outliers; penalty and γ by contiguous cross-validation (see ``kernel``).
* ``kmeans``  — regimes of the z-scored metrics (a clustering row in reports).

A fit is an explicit step that returns a ``Fitted``; nothing is cached. What a
model knows about single keys is a table, never a list on the driver. Models are
saved to and loaded from a folder (see ``store``). A model that lacks rows, or that
its data don't allow, becomes a row with its ``error``; the others go on. Failures
of the cluster are raised.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, spread
from . import kernel, store
from .clean import fill_forward_back
from .evaluate import component_errors, decline_fit, regression_metrics, report_rounding
from .ml import BoostSpec, ForestSpec, fit_boosting, fit_concurrently, fit_forest, kmeans_restarts

MIN_TRAIN_ROWS = 10
MIN_BACKTEST = (5, 2)
#: What data can do to a fit; anything else is the cluster's failure and is raised.
DATA_ERRORS = (ValueError, ArithmeticError, np.linalg.LinAlgError, IllegalArgumentException, AnalysisException)


@dataclass(frozen=True)
class ModelSpec:
    name: str
    kind: str  # hybrid | boosting | kernel | kmeans
    target: str | None = None
    k: int = 7


@dataclass(frozen=True)
class PanelSpec:
    """Columns of the training panel."""

    key: str
    order: str
    metrics: tuple

    def features(self, target: str | None) -> list:
        return [m for m in self.metrics if m != target]


@dataclass
class Fitted:
    spec: ModelSpec
    model: object = None
    decline: DataFrame | None = None  # hybrid: (key, q, lam, n)
    stats: dict = field(default_factory=dict)  # kernel, kmeans: means and deviations
    scores: list = field(default_factory=list)  # kernel: (c, gamma's name, gamma, mae) of the search
    weights: list = field(default_factory=list)  # kernel: constant and features
    gamma: float | None = None  # kernel
    error: str | None = None


def prepared(df: DataFrame, panel: PanelSpec) -> DataFrame:
    """Fill gaps forward, then backward, within each key (before fit and predict)."""
    return fill_forward_back(df, list(panel.metrics), panel.key, panel.order)


def _scaled(stats: dict, col: str):
    mean, deviation = stats[col]
    return (F.col(col) - F.lit(mean)) / F.lit(deviation)


def _fit_kernel(train: DataFrame, spec: ModelSpec, panel: PanelSpec) -> Fitted:
    """The search over (C, γ) and the fit of its best."""
    stats, weights, gamma, scores = kernel.search(train, spec.target, panel.features(spec.target), panel.key, panel.order)
    return Fitted(spec, weights=weights, stats=stats, scores=scores, gamma=gamma)


def _fit_hybrid(train: DataFrame, spec: ModelSpec, panel: PanelSpec, forest: ForestSpec) -> Fitted:
    model = fit_forest(train, panel.features(spec.target), spec.target, forest)
    curves = decline_fit(train, spec.target, panel.key, panel.order).select(panel.key, "q", "lam", "n")
    return Fitted(spec, model, decline=materialize(curves))


def regime_vectors(df: DataFrame, stats: dict, out: str = "features") -> DataFrame:
    cols = sorted(stats)
    scaled = df.withColumns({f"__z{j}": _scaled(stats, c) for j, c in enumerate(cols)})
    va = VectorAssembler(inputCols=[f"__z{j}" for j in range(len(cols))], outputCol=out)
    return va.transform(scaled).drop(*[f"__z{j}" for j in range(len(cols))])


def _fit_kmeans(train: DataFrame, spec: ModelSpec, panel: PanelSpec, restarts: int = 20) -> Fitted:
    stats = kernel.column_stats(train, panel.metrics)
    work = regime_vectors(train, stats).persist()
    try:
        return Fitted(spec, kmeans_restarts(work, "features", k=spec.k, restarts=restarts), stats=stats)
    finally:
        work.unpersist()


def train_one(train: DataFrame, spec: ModelSpec, panel: PanelSpec, min_rows: int = MIN_TRAIN_ROWS, forest=ForestSpec(), boost=BoostSpec()) -> Fitted:
    """One model, or the reason why there is none."""
    n = train.count()
    if n < min_rows:
        return Fitted(spec, error=f"needs {min_rows} training rows, has {n}")
    try:
        if spec.kind == "hybrid":
            return _fit_hybrid(train, spec, panel, forest)
        if spec.kind == "boosting":
            return Fitted(spec, fit_boosting(train, panel.features(spec.target), spec.target, boost))
        if spec.kind == "kernel":
            return _fit_kernel(train, spec, panel)
        return _fit_kmeans(train, spec, panel)
    except DATA_ERRORS as e:  # a model its data don't allow is a row of the report
        return Fitted(spec, error=f"{type(e).__name__}: {str(e).splitlines()[0][:200]}")


def train_all(train: DataFrame, specs, panel: PanelSpec, min_rows: int = MIN_TRAIN_ROWS, **sizes) -> dict:
    """Every model of the list, as concurrent jobs. The assembled rows are
    spread, persisted for the fits and released after them."""
    rows = spread(prepared(train, panel), train.count()).persist()
    try:
        fits = [lambda s=s: train_one(rows, s, panel, min_rows, **sizes) for s in specs]
        return {f.spec.name: f for f in fit_concurrently(fits)}
    finally:
        rows.unpersist()


def predict_one(fitted: Fitted, df: DataFrame, panel: PanelSpec, origin: str = "reference") -> DataFrame:
    """model, key, order, y_true, y_ml, y_decline, y_pred, error (one row with
    nulls and the error where there is no model)."""
    spec, spark = fitted.spec, df.sparkSession
    keep = [panel.key, panel.order]
    none = F.lit(None).cast("double")
    if fitted.error:
        head = df.limit(1).select(*[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in keep]).limit(1)
        only = spark.range(1).join(head, F.lit(False), "left").select(*keep)
        return only.select(
            F.lit(spec.name).alias("model"), *keep, *[none.alias(c) for c in ("y_true", "y_ml", "y_decline", "y_pred")], F.lit(fitted.error).alias("error")
        )
    if spec.kind == "kernel":
        data = kernel.predicted(df, fitted.stats, fitted.weights, fitted.gamma)
    else:
        data = fitted.model.transform(df)
    scored = data.select(*keep, F.col(spec.target).cast("double").alias("y_true"), F.col("prediction").alias("y_ml"))
    if spec.kind == "hybrid":
        step = F.row_number().over(Window.partitionBy(panel.key).orderBy(panel.order)) - 1
        t = F.col("n") + F.col("__i") if origin == "reference" else F.col("__i")
        scored = (
            scored.withColumn("__i", step)
            .join(fitted.decline, panel.key, "left")
            .withColumn("y_decline", F.col("q") * F.exp(-F.col("lam") * t))
            .withColumn("y_pred", F.coalesce(0.5 * F.col("y_ml") + 0.5 * F.col("y_decline"), F.col("y_ml")))
        )
    else:
        scored = scored.withColumn("y_decline", none).withColumn("y_pred", F.col("y_ml"))
    return scored.select(
        F.lit(spec.name).alias("model"), *keep, "y_true", "y_ml", "y_decline", "y_pred", F.lit(None).cast("string").alias("error")
    )


def predict_all(fitted: dict, df: DataFrame, panel: PanelSpec, origin: str = "reference") -> DataFrame:
    """Predictions of every regressor."""
    rows = spread(prepared(df, panel), df.count())
    out = None
    for f in fitted.values():
        if f.spec.kind != "kmeans":
            one = predict_one(f, rows, panel, origin)
            out = one if out is None else out.unionByName(one)
    return out


def hybrid_errors(fitted: Fitted, df: DataFrame, panel: PanelSpec, by=None) -> DataFrame:
    """M6: errors of the fitted hybrid over its training rows, and of its forest
    and its decline curve alone."""
    return component_errors(predict_one(fitted, prepared(df, panel), panel, origin="train"), by)


def model_metrics(predictions: DataFrame) -> DataFrame:
    """M11/B2 per model at the surveyed digits, with the error text of models
    that gave no prediction."""
    scored = report_rounding(regression_metrics(predictions.where("error is null"), by="model"))
    errors = predictions.where("error is not null").select("model", "error").distinct()
    return scored.withColumn("error", F.lit(None).cast("string")).unionByName(errors, allowMissingColumns=True)


def cluster_metrics(fitted: Fitted, df: DataFrame) -> DataFrame:
    """K, inertia and mean silhouette (squared distance) of the regimes."""
    schema = "model string, k int, inertia double, silhouette double, error string"
    if fitted.error:
        return df.sparkSession.createDataFrame([(fitted.spec.name, None, None, None, fitted.error)], schema)
    labelled = fitted.model.transform(regime_vectors(df, fitted.stats))
    sil = ClusteringEvaluator(predictionCol="regime").evaluate(labelled)
    centres = np.array(fitted.model.clusterCenters())
    cost = _inertia(labelled, centres)
    return df.sparkSession.createDataFrame([(fitted.spec.name, len(centres), cost, float(sil), None)], schema)


def _inertia(labelled: DataFrame, centres: np.ndarray) -> float:
    table = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centres])
    diff = F.zip_with(vector_to_array("features"), table[F.col("regime")], lambda x, c: (x - c) * (x - c))
    return float(labelled.agg(F.sum(F.aggregate(diff, F.lit(0.0), lambda s, v: s + v))).first()[0])


def backtest(train: DataFrame, test: DataFrame, specs, panel: PanelSpec, gate=MIN_BACKTEST, **sizes) -> DataFrame:
    """B1: fit on the past, predict the hold-out. Models without enough rows on
    either side give an error row."""
    n_test = test.count()
    if n_test < gate[1]:
        fitted = {s.name: Fitted(s, error=f"needs {gate[1]} test rows, has {n_test}") for s in specs}
    else:
        fitted = train_all(train, specs, panel, gate[0], **sizes)
    return predict_all(fitted, test, panel)


def without_errors(report: DataFrame) -> DataFrame:
    """The report's rows of models that worked."""
    return report.where("error is null").drop("error")


# ---------------------------------------------------------------- persistence


_READERS = {"hybrid": PipelineModel, "boosting": PipelineModel, "kmeans": KMeansModel}


def save(fitted: dict, path: str, spark: SparkSession) -> str:
    """Publish models as one version of the store at ``path``."""
    failed = [name for name, f in fitted.items() if f.error]
    if failed:
        raise ValueError(f"models with errors are not saved: {failed}")
    about, writers = [], {}
    for name, f in fitted.items():
        if f.model is not None:
            writers[f"{name}/model"] = f.model.write().save
        if f.decline is not None:
            writers[f"{name}/decline"] = f.decline.write.parquet
        about.append(
            {"name": name, "kind": f.spec.kind, "target": f.spec.target, "k": f.spec.k, "decline": f.decline is not None}
            | {"stats": f.stats, "scores": f.scores, "weights": f.weights, "gamma": f.gamma}
        )
    store.publish(spark, path, about, writers)
    return path


def load(path: str, spark: SparkSession) -> dict:
    """The models of the store at ``path``; ``store.NotSaved`` where there are none."""
    folder, about = store.committed(spark, path)
    out = {}
    for a in about:
        name = a["name"]
        spec = ModelSpec(name, a["kind"], a["target"], a["k"])
        model = _READERS[a["kind"]].load(f"{folder}/{name}/model") if a["kind"] in _READERS else None
        decline = spark.read.parquet(f"{folder}/{name}/decline") if a["decline"] else None
        stats = {c: tuple(v) for c, v in a["stats"].items()}
        out[name] = Fitted(spec, model, decline, stats, [tuple(x) for x in a["scores"]], a["weights"], a["gamma"])
    return out
