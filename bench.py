"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the cores.  Queries write into a sink that discards
the rows.  Every query runs three times and the median counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siftlake.plans import PLANS  # noqa: E402
from siftlake.session import session  # noqa: E402

HEADLINE = (
    "secret_scan", "scan_all_families", "rule_scan_sast", "rule_scan_jailbreak", "ai_config_scan", "nearest_popular", "typosquat_matches",
    "publish_anomalies", "agent_block_stats", "agent_leaderboard", "hallucination_stats", "fold_reports", "vuln_range_join", "package_intelligence",
    "trust_score", "build_sbom", "sbom_drift", "security_score", "merge_regions", "attribute_findings", "taint_cross_file", "diff_regressions",
    "match_subscriptions", "stream_daily_counts", "stream_sessions",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("siftlake-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    # The first query of a session pays for loading classes; it is not measured.
    PLANS["secret_scan"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            PLANS[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(sorted(runs)[1], 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
