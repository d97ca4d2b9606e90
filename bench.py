"""Times headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagesieve.plans import catalog  # noqa: E402
from pagesieve.session import build_session  # noqa: E402

HEADLINE = (
    "s2_sources_passive", "s4_attach_scripts", "n1_decode_pages", "m1_m3_matches_with_position", "m4_entropy",
    "f1_secrets_documents", "f1_secrets_conversations", "f1_secrets_token_scripts", "f2_secrets_full",
    "f3_subdomains_pages", "f4_endpoints_pages", "f4_f8_endpoints", "full_scan_pages", "j4_merge_maps",
    "j8_rebuild_sources", "a1_group_findings", "a4_secrets_by_rule", "a9_rollup", "t2_debounce", "t4_upsert_results",
    "k1_reports",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/pages.parquet").count()
    times = {}
    for name in wanted:
        start = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
