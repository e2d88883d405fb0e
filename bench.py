"""Time the headline queries and print one JSON line.

Reads ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]``.
Each query runs to the end without collecting its rows.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from unbrev.catalog import queries  # noqa: E402
from unbrev.session import tune  # noqa: E402

HEADLINES = (
    "token_counts",
    "bigram_counts",
    "mined_pairs",
    "postings_skeleton_prefix",
    "ranked_flat",
    "ranked_context",
    "ranked_grouped",
    "session_features",
    "history_prior",
    "noisy_pairs",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("unbrev-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    runs = queries()
    # Start the JVM's code paths and the Python workers before timing.
    small = str(Path(sf_dir).parent / "sf0.001")
    runs["ranked_flat"](spark, small if Path(small).exists() else sf_dir).write.format(
        "noop"
    ).mode("overwrite").save()
    times = {}
    for name in HEADLINES:
        start = time.perf_counter()
        runs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
