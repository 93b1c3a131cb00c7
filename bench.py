"""Time the headline queries and print one JSON line.

Tables come from $BENCH_SF_DIR, cores from $BENCH_CPUS. ``queries`` holds seconds per
integer sequences of its four sizes. Every run goes to the ``noop`` sink, so all rows and
columns are computed and none reaches the driver. The first run of a query is a warm-up
and the best of the next runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame  # noqa: E402

from rowdeck import sources  # noqa: E402
from rowdeck.operators import lanes as L, shuffles  # noqa: E402
from rowdeck.plans import QUERIES  # noqa: E402
from rowdeck.session import local_session  # noqa: E402

HEADLINE = [
    "shuffle_audit",
    "keyed_shuffle",
    "lane_shuffle_rr",
    "lane_shuffle_diagonal",
    "lane_shuffle_chunk",
    "lane_shuffle_inplace",
    "lane_shuffle_digit",
    "lane_by_size",
    "batch_shuffle",
    "rotate_shuffle",
    "split_shuffle",
    "pair_exchange",
    "cyclic_shuffle",
    "riffle_merge",
    "merge_shuffle",
    "gather",
    "sample_k",
    "stable_sort",
    "radix_order",
    "verify_multiset",
    "missing_elements",
    "shuffle_percentage",
    "inversions",
    "number_parquet",
    "scan_dicts",
    "map_features",
    "batch_predict",
]
SIZES = [100_000, 500_000, 1_000_000, 10_000_000]


def seconds(build: Callable[[], DataFrame], repeats: int) -> float:
    best = float("inf")
    for _ in range(repeats):
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - start)
    return round(best, 4)


def sequence_runs(spark) -> dict[str, dict[str, float]]:
    """The shuffles of the baseline, with its int(sqrt(n)) lanes."""

    def runs(rows: int) -> dict[str, Callable[[], DataFrame]]:
        data = sources.sequence(spark, rows)
        k = int(rows**0.5)
        return {
            "random": lambda: shuffles.keyed_shuffle(data, "pos", 1, "new_pos", rows),
            "topological": lambda: shuffles.rotate_shuffle(data, L.ceil_chunks(rows, k), 1),
            "round_robin": lambda: shuffles.lane_shuffle(data, L.Strided(rows, k), "pos", 1),
            "predictive": lambda: shuffles.lane_shuffle(data, L.Diagonal(rows, k), "pos", 1),
            "load_balancing": lambda: shuffles.lane_shuffle_in_place(data, L.Strided(rows, k), "pos", 1),
        }

    for run in runs(SIZES[0]).values():
        seconds(run, 2)
    return {
        str(rows): {name: seconds(run, 3 if rows < SIZES[-1] else 2) for name, run in runs(rows).items()}
        for rows in SIZES
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    for name in HEADLINE:
        seconds(lambda: QUERIES[name](spark, folder), 1)
    times = {name: seconds(lambda: QUERIES[name](spark, folder), 2) for name in HEADLINE}
    sizes = sequence_runs(spark)
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "sequence_sizes": sizes,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
