"""Supervised models, PCA and k-means on ``pyspark.ml``.

Fits are eager Spark jobs (distributed tree building, Gram-matrix
aggregation, Lloyd iterations); predictions are lazy ``transform``s. Model
parameters default to the surveyed values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import zscore
from .stats import as_list


@dataclass(frozen=True)
class ForestSpec:
    num_trees: int = 200
    max_depth: int = 8
    seed: int = 42
    feature_subset: str = "all"  # every feature at every split, as surveyed


@dataclass(frozen=True)
class BoostSpec:
    max_iter: int = 300
    step_size: float = 0.05
    max_depth: int = 5
    subsample: float = 0.8
    seed: int = 42
    checkpoint_interval: int = 10


def assembler(features) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def fit_forest(df: DataFrame, features, target: str, spec: ForestSpec = ForestSpec()):
    """M1: random forest regressor (pipeline: assemble -> forest)."""
    rf = RandomForestRegressor(
        featuresCol="features",
        labelCol=target,
        numTrees=spec.num_trees,
        maxDepth=spec.max_depth,
        seed=spec.seed,
        featureSubsetStrategy=spec.feature_subset,
    )
    return Pipeline(stages=[assembler(features), rf]).fit(df)


def fit_boosting(df: DataFrame, features, target: str, spec: BoostSpec = BoostSpec()):
    """M7/M8: gradient-boosted trees (pipeline: assemble -> GBT)."""
    gbt = GBTRegressor(
        featuresCol="features",
        labelCol=target,
        maxIter=spec.max_iter,
        stepSize=spec.step_size,
        maxDepth=spec.max_depth,
        subsamplingRate=spec.subsample,
        seed=spec.seed,
        checkpointInterval=spec.checkpoint_interval,
    )
    return Pipeline(stages=[assembler(features), gbt]).fit(df)


def feature_importance(model, features) -> list:
    """M2: (feature, importance) ranked descending (driver-side: one small
    vector of length #features)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return sorted(zip(features, imp), key=lambda t: -t[1])


def pca_fit(df: DataFrame, cols, k: int = 4):
    """PCA on z-scored columns (population std). Returns (model, data)."""
    zcols = [c + "_z" for c in cols]
    z = zscore(df, cols, suffix="_z")
    va = VectorAssembler(inputCols=zcols, outputCol="__zv")
    model = PCA(k=k, inputCol="__zv", outputCol="__pcs").fit(va.transform(z))
    return model, va.transform(z)


def pca_signs(model) -> list:
    """Sign per component making its largest-|loading| entry positive."""
    pc = model.pc.toArray()
    signs = []
    for j in range(pc.shape[1]):
        i = abs(pc[:, j]).argmax()
        signs.append(1.0 if pc[i, j] >= 0 else -1.0)
    return signs


def pca_scores(model, data: DataFrame, keep, k: int = 4) -> DataFrame:
    """PC1..PCk scores with the deterministic sign convention."""
    signs = pca_signs(model)
    arr = vector_to_array(F.col("__pcs"))
    out = model.transform(data)
    return out.select(*as_list(keep), *[(arr[j] * F.lit(signs[j])).alias(f"PC{j + 1}") for j in range(k)])


def pca_tables(model, cols, spark):
    """Explained variance table and loadings table (k × p, small)."""
    signs = pca_signs(model)
    ev = model.explainedVariance.toArray().tolist()
    cum = 0.0
    var_rows = []
    for j, v in enumerate(ev):
        cum += v
        var_rows.append((f"PC{j + 1}", float(v * 100.0), float(cum * 100.0), bool(cum >= 0.80)))
    variance = spark.createDataFrame(var_rows, "component string, variance_pct double, cumulative_pct double, meets_target boolean")
    pc = model.pc.toArray()
    load_rows = [
        (f"PC{j + 1}", c, float(pc[i, j] * signs[j]), bool(abs(pc[i, j]) > 0.4))
        for j in range(pc.shape[1])
        for i, c in enumerate(cols)
    ]
    loadings = spark.createDataFrame(load_rows, "component string, feature string, loading double, significant boolean")
    return variance, loadings


def variance_map(variance: DataFrame) -> DataFrame:
    """One row: a map from each component to its share of the variance."""
    pairs = F.array_sort(F.collect_list(F.struct("component", (F.col("variance_pct") / 100.0).alias("share"))))
    return variance.agg(F.map_from_entries(pairs).alias("pca_variance"))


def fit_concurrently(fits, workers: int = 4) -> list:
    """Run independent fits as concurrent Spark jobs (driver threads); the
    scheduler interleaves their stages across the cluster."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=workers) as pool:
        return list(pool.map(lambda f: f(), fits))


def kmeans_restarts(df: DataFrame, features_col: str, k: int = 7, restarts: int = 20, max_iter: int = 500, seed: int = 42):
    """K1: k-means with several seeds (run concurrently); keep the lowest
    training cost (ties -> lowest seed)."""

    def fit(i):
        return lambda: KMeans(k=k, maxIter=max_iter, seed=seed + i, featuresCol=features_col, predictionCol="regime").fit(df)

    models = fit_concurrently([fit(i) for i in range(restarts)])
    costs = [(m.summary.trainingCost, i) for i, m in enumerate(models)]
    return models[min(costs)[1]]
