"""Headline queries at one scale; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from joulemill.registry import load  # noqa: E402
from joulemill.session import local_session  # noqa: E402
from joulemill.storage import release  # noqa: E402

HEADLINE = [
    "co_05_run_total_carbon", "co_10_against_baseline", "co_14_intensity_at", "co_16_carbon_per_job", "co_18_parse_executors", "co_25_replay_provisioning",
    *sorted(n for n in load() if n.startswith("tpch_")),
    "agm_03_cube", "agg_2_distinct", "agg_7_quantiles", "jn_08_interval", "jn_09_asof_backward", "jn_14_skewed", "win_1_ranking", "win_2_offsets", "srt_01_sort",
    "dt_8_sliding_window", "dt_8_session_window", "ps_09_cumulative", "ps_19_rolling", "ps_21_ewm", "ps_22_resample", "src_10_bucketed_join",
    "wl_01_word_count", "wl_02_total_sort", "wl_04_log_query", "wl_05_skewed_group_by", "wl_08_transitive_closure", "wl_09_pagerank", "wl_11_order_components", "wl_12_triangles", "wl_20_column_similarity",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    queries = load()
    queries["tpch_06_revenue_forecast"](spark, folder).collect()  # JVM warm-up
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        release(spark)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
