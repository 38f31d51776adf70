"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries"
(seconds per query), "sf"}. Each query is materialised with a full collect
of its (small) result, after one warm-up run of the flagship query so JVM
start-up and first-compile costs are not charged to a query. Model queries run
in the order given: the first that needs a model fits it (cold), later ones read
it from the session's model folder.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelrisk.plans.queries import queries  # noqa: E402
from panelrisk.session import build_session  # noqa: E402

HEADLINE = [
    "panel_quarter",
    "risk_index",
    "master_panel",
    "disaggregate_all",
    "interpolate_linear",
    "iqr_winsorize",
    "scenario_projection",
    "path_summary",
    "yearly_collapse_rate",
    "decline_fit",
    "silhouette",
    "backtest_metrics",
    "run_summary",
    "pca_scores",
    "pca_variance",
    "pca_loadings",
    "kmeans_regimes",
    "pca_regime_points",
    "rf_predictions",
    "feature_importance",
    "hybrid_forecast",
    "gbt_revenue",
    "gbt_debt",
    "kernel_regression",
    "cv_scores",
    "cluster_metrics",
    "fitted_regime_summary",
    "predict_all",
    "training_report",
    "backtest_predictions",
    "backtest_model_metrics",
    "validation_report",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="panelrisk-bench-")
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, extra={"spark.checkpoint.dir": shared})
    q = queries()
    q["risk_index"](spark, sf_dir).collect()  # warm-up
    times = {}
    for name in HEADLINE:
        t = time.time()
        q[name](spark, sf_dir).collect()
        times[name] = round(time.time() - t, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(m.group(1)) if m else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
