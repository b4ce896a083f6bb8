"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from storyspark.queries import QUERIES  # noqa: E402
from storyspark.session import build_session  # noqa: E402

HEADLINE = [
    "w7_lookback_repetition", "w12_reuse_tracking", "w26_merge_intervals", "w19_smoothed_curve", "w41_plan_motion", "a5_retention_report",
    "j2_tag_search", "j5_composite_rank", "j10_mine_edges", "j20_vector_top_k", "w37_largest_remainder", "f6_text_quality", "f18_classify_beats",
    "j1_lexicon_entities", "e1_script_to_curve", "e2_storyboard_audit",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    only = os.environ.get("BENCH_QUERIES")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        "spark.driver.bindAddress": "127.0.0.1", "spark.driver.host": "127.0.0.1", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    # start-up is not part of any query: one that is not measured comes first
    QUERIES["a6_reuse_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in only.split(",") if only else HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
