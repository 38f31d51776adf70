"""Top-k against brute force, and the registered query against SQL."""

import math
import random

from pyspark.sql import functions as F

from panelrisk.llm.balltree import exact_top_k


def brute(rows, k, is_query):
    ok = [(i, [math.floor(256.0 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], set()
    for i, v in ok:
        if not is_query(i) or (i, tuple(v)) in seen:
            continue
        seen.add((i, tuple(v)))
        found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i and len(w) == len(v))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def run(spark, rows, k=5, **sizes):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, score string, tree string")
    got = exact_top_k(df, F.col("id") % 5 == 0, k=k, **sizes).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


def test_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [round(rng.gauss(0, 1), 1) for _ in range(4)]) for i in range(400)]
    rows += [(401, [0.0] * 4), (402, [0.0] * 4), (405, [0.0] * 4), (17, rows[17][1]), (17, [9.0] * 4)]
    rows += [(None, [1.0] * 4), (500, None), (501, [1.0, None, 0.0, 0.0]), (505, [math.nan] * 4), (510, [math.inf] * 4)]
    rows += [(600 + i, [float(i), 1.0]) for i in range(3)]
    want = brute(rows, 5, lambda i: i % 5 == 0)
    assert run(spark, rows, shard_rows=50, block_queries=16) == want
    # Three rounds of many small shards, a tree sent to several runs of blocks.
    assert run(spark, rows, shard_rows=20, block_queries=8, group=2) == want


def test_large_values_stay_exact(spark):
    rows = [(i, [1e6 + i, -1e6, 3e5 * i]) for i in range(12)]
    assert run(spark, rows) == brute(rows, 5, lambda i: i % 5 == 0)


def test_fewer_candidates_and_empty(spark):
    assert run(spark, [(5, [1.0]), (6, [2.0])]) == [(5, 1, 6, 256 * 512)]
    assert run(spark, []) == []


def test_kth_scores_travel_between_rounds(spark, monkeypatch):
    """Shards of later rounds return fewer rows than a search without known scores."""
    from panelrisk.llm import balltree

    sizes = []
    real = balltree._best

    def counted(found, k):
        sizes.append(found.count())
        return real(found, k)

    monkeypatch.setattr(balltree, "_best", counted)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(600)]
    got = run(spark, rows, shard_rows=30, block_queries=16)
    assert got == brute(rows, 5, lambda i: i % 5 == 0)
    queries = 120
    assert len(sizes) == 3 and sizes[-1] < queries * 5 * 11 / 2
