"""Per-stage task balance from a Spark event log (no UI, no server).

    python tools/stage_report.py <eventlog dir or file> [min_ms]

Run a job with ``spark.eventLog.enabled=true`` and ``spark.eventLog.dir``
set to a scratch folder, then point this at the folder. Prints, per stage
slower than ``min_ms``: task count, max and median task time. A max far
above the median marks a skewed stage.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
from collections import defaultdict


def _lines(path: str):
    with open(path, "rb") as fh:
        raw = fh.read()
    if path.endswith(".zstd"):
        import zstandard

        raw = zstandard.ZstdDecompressor().stream_reader(raw).read()
    return raw.decode().splitlines()


def main(target: str, min_ms: int = 200) -> None:
    files = [target] if os.path.isfile(target) else sorted(glob.glob(f"{target}/**/events_*", recursive=True))
    tasks: dict[int, list[int]] = defaultdict(list)
    names: dict[int, str] = {}
    for f in files:
        for line in _lines(f):
            e = json.loads(line)
            if e["Event"] == "SparkListenerTaskEnd":
                ti = e["Task Info"]
                tasks[e["Stage ID"]].append(ti["Finish Time"] - ti["Launch Time"])
            elif e["Event"] == "SparkListenerStageSubmitted":
                names[e["Stage Info"]["Stage ID"]] = e["Stage Info"]["Stage Name"][:60]
    for s in sorted(tasks):
        d = tasks[s]
        if max(d) >= min_ms:
            print(f"stage {s:4d} tasks {len(d):4d} max {max(d):6d} ms median {statistics.median(d):8.1f} ms  {names.get(s, '')}")


if __name__ == "__main__":
    main(sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 200)
