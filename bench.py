"""Bench the headline queries; prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is fully executed through the ``noop`` sink (no collect to the
driver), in a shared folder of its own, so that nothing saved by an earlier
run (the merge closure) is read back. Every headline query first runs once on the small sf0.001 tables
(JIT, codegen and Python-worker warm-up), then is timed at the target
scale. ``value`` is the sum of the timed wall times; ``cold`` gives the
times of a first run in a fresh session for reference.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tokscope.plans.queries import QUERIES  # noqa: E402
from tokscope.session import get_spark  # noqa: E402

HEADLINE = [
    "pretoken_count",
    "token_frequency",
    "token_frequency_byte_level",
    "encode_distinct",
    "bpe_fold",
    "merge_closure",
    "rank_by_survival_ratio",
    "token_metrics",
    "neighbor_counts",
    "batch_by_count",
    "batch_by_chars",
    "scan_conversations",
    "running_token_frequency",
]


def _timed(spark, name: str, sf_dir: str) -> float | None:
    """Wall time of one full execution through the ``noop`` sink; None if it failed."""
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tokscope-bench-"))
    t0 = time.perf_counter()
    try:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    except Exception as exc:  # noqa: BLE001 - report, keep benching the rest
        print(f"{name} failed: {type(exc).__name__}: {str(exc)[:300]}", file=sys.stderr, flush=True)
        return None
    return round(time.perf_counter() - t0, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(master=f"local[{cpus}]", app="tokscope-bench", shuffle_partitions=cpus)
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    cold: dict[str, float | None] = {name: _timed(spark, name, warm_dir) for name in names}
    times: dict[str, float | None] = {}
    for name in names:
        times[name] = _timed(spark, name, sf_dir)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(t for t in times.values() if t is not None), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(m.group(1)) if m else sf_dir,
                "warmup_sf_dir": warm_dir,
                "cold_small_sf": cold,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
