"""Time the headline queries on one machine and print one JSON line.

BENCH_SF_DIR names the folder of tables and BENCH_CPUS the number of cores. Each query runs to its
last row (``noop`` sink) after one warm-up of the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

from adjudica.plans import load_queries
from adjudica.session import build_session

HEADLINE = (
    "engineered",
    "rate_by_credit_band",
    "numeric_summary",
    "categorical_summary",
    "missing_mechanism",
    "outlier_summary",
    "rate_by_quantile_band",
    "cramers_v",
    "feature_auc",
    "binned_mi",
    "association",
    "spearman",
    "rule_flags",
    "holdout_split_exact",
    "score_report",
    "cost_curve",
    "calibration_bins",
    "segment_errors",
    "fairness_audit",
    "impact_ci",
    "reasons",
    "cv_score",
    "iforest",
    "tree_shap",
    "batch_scores",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_queries()
    registry.QUERIES["rate_by_credit_band"](spark, folder).collect()
    wanted = sys.argv[1:] or HEADLINE
    taken = {}
    for name in wanted:
        start = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        taken[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(taken.values()), 3),
                "unit": "sec",
                "queries": taken,
                "sf": os.path.basename(folder).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
