"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default 8) the cores.
Each query is built and fully executed into a discarding sink; nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ratespark.plans.catalogue import QUERIES
from ratespark.runtime import build_session

HEADLINE = [
    "policy_engineer_features",
    "policy_clean_frequency",
    "policy_claim_join",
    "claim_feature_join",
    "data_quality_summary",
    "defaults_metadata",
    "premium_scoring",
    "premium_summary",
    "top_premiums",
    "scenario_report",
    "scenario_sensitivity",
    "frequency_calibration_deciles",
    "premium_histogram",
    "poisson_deviance",
    "glm_full_scoring",
    "rf_scoring",
    "stratified_split",
    "dutch_portfolio",
    "spanish_portfolio",
    "retrain_union",
    "drift_severity",
    "drift_frequency",
    "lorenz_gini",
    "segment_guidance",
    "stream_daily_quotes",
    "stream_consent_fanout",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    discard(QUERIES["claims_clean_severity"](spark, folder))  # starts the JVM's code paths
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        discard(QUERIES[name](spark, folder))
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


def discard(df) -> None:
    df.write.format("noop").mode("overwrite").save()


if __name__ == "__main__":
    main()
