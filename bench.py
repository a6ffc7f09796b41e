"""Headline queries, one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose data and cores."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "classify_taxonomy", "dedup_canonical", "build_inventory", "path_entities", "shared_audience",
    "figures_tokens", "figures_presence", "verify_pages", "claims_windows", "facts_grid", "facts_validate",
    "facts_current_truth", "postings", "search_rerank", "version_links", "dossier_rollup", "entities_canonical",
    "merge_candidates", "inventory_diff", "dedup_reelect", "chat_render", "ops_status",
    "lineage_paths", "figure_spans", "verify_answers", "bm25_scores",
]


def main() -> None:
    from sourceloom.queries import PLANS
    from sourceloom.session import build_session
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", {
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
        "spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()          # start the session outside the clock
    times = {}
    for name in names:
        start = time.perf_counter()
        PLANS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
