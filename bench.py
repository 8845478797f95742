"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default sf0.1) and BENCH_CPUS (default 8) choose data and threads.
Each query runs once to warm up, then up to five times while its own time budget
lasts; the median counts. Building the query is timed too, and the whole result
goes to the noop sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import tallyframe.plans  # noqa: E402,F401
from tallyframe.plans import registry  # noqa: E402
from tallyframe.session import build_session  # noqa: E402

HEADLINE = (
    "top_categories own_group_avg anti_left_null date_spine agg_of_agg repeat_pairs return_rate monthly_net "
    "rfm_segments iqr_cap describe_long corr_matrix chi2_grid match_topn kmeans_profile kmedoids dbscan"
).split()
RUNS = 5
BUDGET_SECONDS = 20


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    calls = registry.callables()
    calls["count_forms"](spark, directory).collect()  # wake the JVM before the first timed query
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split():
        times: list[float] = []
        spent = 0.0
        for run in range(RUNS + 1):
            start = time.perf_counter()
            calls[name](spark, directory).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            spent += took
            if run:
                times.append(took)
            if times and spent + took > BUDGET_SECONDS:
                break
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name}: {seconds[name]}s ({len(times)} runs)", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(directory).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
