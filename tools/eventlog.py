"""Summarize a Spark event log: SQL executions, jobs and stages with timings.

    python tools/eventlog.py EVENT_LOG_DIR_OR_FILE [--last N]

Produce a log by running with ``spark.eventLog.enabled=true`` and
``spark.eventLog.dir`` pointing at a scratch folder.  Reads plain, zstd or
rolling (``eventlog_v2_*``) logs.  Prints, for the last ``N`` SQL executions,
the wall time, then every stage that started during it: offset from the
execution start, duration, task count and the slowest task.
"""

from __future__ import annotations

import argparse
import glob
import io
import json
import os
import sys


def _lines(path: str):
    files = sorted(glob.glob(os.path.join(path, "*"))) if os.path.isdir(path) else [path]
    for f in files:
        if os.path.basename(f).startswith("appstatus"):
            continue
        if f.endswith(".zstd"):
            import zstandard

            stream = zstandard.ZstdDecompressor().stream_reader(open(f, "rb"))
            yield from io.TextIOWrapper(stream, encoding="utf-8")
        else:
            with open(f, encoding="utf-8") as fh:
                yield from fh


def summarize(path: str, last: int) -> None:
    executions, stages, task_max = {}, {}, {}
    for line in _lines(path):
        try:
            e = json.loads(line)
        except ValueError:
            continue
        kind = e.get("Event", "")
        if kind.endswith("SQLExecutionStart"):
            executions[e["executionId"]] = [e["time"], None, e.get("description", "")[:60]]
        elif kind.endswith("SQLExecutionEnd") and e["executionId"] in executions:
            executions[e["executionId"]][1] = e["time"]
        elif kind == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            stages[si["Stage ID"]] = (si.get("Submission Time"), si.get("Completion Time"), si["Number of Tasks"])
        elif kind == "SparkListenerTaskEnd":
            ti = e["Task Info"]
            dur = ti["Finish Time"] - ti["Launch Time"]
            task_max[e["Stage ID"]] = max(task_max.get(e["Stage ID"], 0), dur)
    for ex_id in sorted(executions)[-last:]:
        start, end, desc = executions[ex_id]
        print(f"execution {ex_id}: {((end or start) - start)} ms  {desc}")
        for sid, (s, c, n) in sorted(stages.items()):
            if s is not None and start <= s <= (end or s):
                print(f"   stage {sid:5}  +{s - start:6} ms  {c - s:6} ms  tasks {n:5}  slowest task {task_max.get(sid, 0)} ms")


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("path")
    ap.add_argument("--last", type=int, default=3)
    args = ap.parse_args()
    summarize(args.path, args.last)
    return 0


if __name__ == "__main__":
    sys.exit(main())
