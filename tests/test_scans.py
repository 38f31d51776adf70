"""Two-level scans and exact quantiles by rank selection."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelrisk.operators import clean as cl
from panelrisk.operators import evaluate as ev
from panelrisk.operators import panel_ops as po
from panelrisk.operators import quantiles
from panelrisk.operators.quantiles import exact_quantiles
from panelrisk.operators.segments import positions, scanned


def series(spark, seed=1, days=400):
    rng = random.Random(seed)
    data = []
    for key in ("a", "b", None):
        for i in sorted(rng.sample(range(days), days // 2)):
            known = rng.random() < 0.2 and not (key == "b" and i < 150)
            data.append((key, dt.date(2000, 1, 1) + dt.timedelta(days=i), rng.uniform(-9, 9) if known else None, None, "kept"))
    return spark.createDataFrame(data, "k string, d date, v double, w double, other string")


def same(a, b):
    a, b = ([r.asDict() for r in x.orderBy("k", "d").collect()] for x in (a, b))
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert {c: pytest.approx(v) if isinstance(v, float) else v for c, v in x.items()} == y


@pytest.mark.parametrize("block", [1, 7, 64, 10_000])
def test_scans_by_block_equal_windows(spark, block):
    df = series(spark)
    same(cl.interpolate_linear(df, ["v", "w"], "k", "d", block=block), cl.interpolate_linear(df, ["v", "w"], "k", "d"))
    same(cl.fill_forward_back(df, ["v", "w"], "k", "d", block=block), cl.fill_forward_back(df, ["v", "w"], "k", "d"))
    same(ev.cv_folds(df, "k", "d", 7, block=block), ev.cv_folds(df, "k", "d", 7))
    same(po.first_n(df, "k", "d", 33, block=block), po.first_n(df, "k", "d", 33))


def test_more_folds_than_rows_and_given_positions(spark):
    df = spark.createDataFrame([("a", i, None if i % 3 else float(i * i)) for i in range(1, 5)], "k string, t int, v double")
    folds = [[r.fold for r in ev.cv_folds(df, "k", "t", 6, **b).orderBy("t").collect()] for b in ({}, {"block": 2})]
    assert folds[0] == folds[1]
    gaps = df.withColumn("pos", F.col("t") * F.col("t"))
    both = [cl.interpolate_linear(gaps, ["v"], "k", "t", pos="pos", **b).orderBy("t").collect() for b in ({}, {"block": 2})]
    assert both[0] == both[1]


def test_empty_table_and_null_times(spark):
    df = spark.createDataFrame([("a", None, 5.0), ("a", 3, None), ("a", 9, 7.0)], "k string, t int, v double")
    assert [r.v for r in cl.fill_forward_back(df, "v", "k", "t", block=2).orderBy("t").collect()] == [5.0, 5.0, 7.0]
    assert cl.interpolate_linear(df.limit(0), "v", "k", "t", block=2).collect() == []


def test_timestamps_have_blocks_too(spark):
    df = spark.range(2000).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 977).alias("t"))
    got = positions(df, "k", "t", 86_400).agg(F.min("__pos"), F.max("__pos"), F.countDistinct("__pos"), F.max("__n")).first()
    assert tuple(got) == (1, 2000, 2000, 2000)


def test_one_key_is_spread_over_tasks(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(20_000).select(F.lit("only").alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 9 == 0, F.col("id") * 1.0).alias("v"))
        placed = scanned(df, ["v"], "k", "t", 500).withColumn("task", F.spark_partition_id())
        held = placed.groupBy("task").agg(F.count("__last_v").alias("rows"), F.max("__pos")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(held) > 4 and max(r.rows for r in held) < 10_000


def values(seed, n):
    rng = random.Random(seed)
    kinds = [
        lambda: rng.gauss(0, 1),
        lambda: rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300),
        lambda: float(rng.randint(0, 3)),
        lambda: 1e15 + rng.random(),
    ]
    return {g: [kind() for _ in range(n)] for g, kind in zip("abcd", kinds, strict=True)}


def test_rank_selection_is_exact(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BUCKETS", 16)
    groups = values(3, 900) | {"one": [7.0], "none": [None], "same": [2.5] * 500, "pair": [1.0, None, 2.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, x double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r.g: r for r in exact_quantiles(df, ["x"], probs, "g", limit=20).collect()}
    for g, vs in groups.items():
        known = [v for v in vs if v is not None]
        assert got[g].n == len(known)
        if not known:
            assert got[g].q is None
            continue
        ordered = sorted(known)
        for p, q in zip(probs, got[g].q, strict=True):
            at = p * (len(known) - 1)
            low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
            assert low <= q <= high and q == pytest.approx(low * (np.ceil(at) - at) + high * (at - np.floor(at)) if low != high else low)


def test_whole_table_quantiles_equal_the_aggregate(spark):
    df = spark.range(5000).select((F.rand(1) * 100).alias("x"), F.randn(2).alias("y")).cache()
    want = {c: df.agg(F.percentile(c, F.array(F.lit(0.25), F.lit(0.75)))).first()[0] for c in "xy"}
    for limit in (10, 100_000):
        assert {r.column: r.q for r in exact_quantiles(df, ["x", "y"], [0.25, 0.75], limit=limit).collect()} == want
    df.unpersist()


def test_winsorising_by_selection_series_and_approximation(spark):
    rng = random.Random(4)
    data = [(k, rng.gauss(0, 1) * (50 if rng.random() < 0.05 else 1), None) for k in ("a", "b", None) for _ in range(300)]
    df = spark.createDataFrame(data, "k string, v double, w double").coalesce(1)
    results = {}
    for how in ("select", "series", "approx"):
        out = cl.iqr_winsorize(df, ["v", "w"], by="k", quartiles=how)
        assert out.columns == df.columns and out.where("w is not null").count() == 0
        results[how] = sorted((str(r.k), r.v) for r in out.collect())
    assert results["select"] == results["series"]
    assert np.allclose([v for _, v in results["approx"]], [v for _, v in results["select"]], atol=0.1)
    whole = cl.iqr_winsorize(df, ["v"]).agg(F.max("v")).first()[0]
    q1, q3 = np.percentile([v for _, v, _ in data], [25, 75])
    assert whole == pytest.approx(q3 + 1.5 * (q3 - q1))


def test_outlier_report_counts_outside_the_fence(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)] + [(None, 5.0)] * 3 + [("n", None)], "k string, v double")
    got = {r.k: (r.lower, r.upper, r.n_outliers) for r in cl.iqr_outlier_report(df, ["v"], by="k").collect()}
    assert got == {"a": (-1.0, 7.0, 1), None: (5.0, 5.0, 0), "n": (None, None, 0)}
