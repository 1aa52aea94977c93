"""Summarise a Spark event log per job description (one bench query each).

    python tools/stage_metrics.py EVENT_LOG (file or eventlog_v2_* folder) [OUT.md]

For every query: Parquet bytes and rows read, shuffle bytes written, task
count and the summed task run time. Repeated runs of a query are averaged.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
from collections import defaultdict


def open_log(path: str):
    """Text lines of an event log (plain or zstd-compressed, file or v2 folder)."""
    files = sorted(glob.glob(os.path.join(path, "events_*"))) if os.path.isdir(path) else [path]
    for name in files:
        if name.endswith(".zstd"):
            import zstandard
            with open(name, "rb") as raw:
                reader = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
                yield from io.TextIOWrapper(reader, encoding="utf-8")
        else:
            with open(name) as f:
                yield from f


def main() -> None:
    path = sys.argv[1]
    out = sys.argv[2] if len(sys.argv) > 2 else None
    stage_job, job_desc, runs = {}, {}, defaultdict(set)
    acc = defaultdict(lambda: defaultdict(float))
    if True:
        for line in open_log(path):
            ev = json.loads(line)
            kind = ev.get("Event")
            if kind == "SparkListenerJobStart":
                desc = (ev.get("Properties") or {}).get("spark.job.description")
                job_desc[ev["Job ID"]] = desc
                for sid in ev.get("Stage IDs", []):
                    stage_job[sid] = ev["Job ID"]
                if desc:
                    runs[desc].add((ev.get("Properties") or {}).get("spark.sql.execution.root.id")
                                   or (ev.get("Properties") or {}).get("spark.sql.execution.id"))
            elif kind == "SparkListenerTaskEnd":
                desc = job_desc.get(stage_job.get(ev.get("Stage ID")))
                m = ev.get("Task Metrics") or {}
                if not desc or not m:
                    continue
                a = acc[desc]
                a["tasks"] += 1
                a["run_ms"] += m.get("Executor Run Time", 0)
                a["read_bytes"] += (m.get("Input Metrics") or {}).get("Bytes Read", 0)
                a["read_rows"] += (m.get("Input Metrics") or {}).get("Records Read", 0)
                a["shuffle_bytes"] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
    lines = ["| query | runs | tasks | task time (ms) | Parquet bytes read | rows read | shuffle bytes written | shuffle / read |",
             "|---|---|---|---|---|---|---|---|"]
    for name, a in acc.items():
        if name.startswith("Listing leaf files"):
            continue
        n = max(1, len(runs[name]))
        ratio = a["shuffle_bytes"] / a["read_bytes"] if a["read_bytes"] else 0.0
        lines.append(f"| {name} | {n} | {a['tasks'] / n:.0f} | {a['run_ms'] / n:.0f} | "
                     f"{a['read_bytes'] / n:,.0f} | {a['read_rows'] / n:,.0f} | "
                     f"{a['shuffle_bytes'] / n:,.0f} | {ratio:.3f} |")
    text = "\n".join(lines) + "\n"
    if out:
        with open(out, "w") as f:
            f.write(text)
    print(text)


if __name__ == "__main__":
    main()
