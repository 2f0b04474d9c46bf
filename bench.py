"""Headline queries, timed: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and cores."""
from __future__ import annotations

import json
import os
import time

from rulemill.registry import QUERIES, all_queries  # noqa: F401
from rulemill.session import build_session

HEADLINES = (
    "count_violations", "product_tags", "rule_verdicts", "sample_violations", "parity_counts",
    "parity_counts_from_verdicts", "failed_case_rows_one_scan", "rule_result", "rule_comparison", "normalize_products",
    "rank_fixes", "review_sheet", "mutant_kills", "dataset_fingerprint",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("rulemill-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["count_rows"].run(spark, sf_dir).collect()  # start the session outside the timings
    seconds = {}
    for name in HEADLINES:
        start = time.time()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
