"""Arrivals by script, for tests of lateness.

A script is a list of steps: {"kind": "event", "sequence": n} sends the n-th record (from 1), and
{"kind": "watermark", "watermark_ms": w} raises the watermark. An explicit watermark is handed on as each event's
`wm_before_ms`, since an engine whose watermark follows event times can't be given one.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidewatch.sources import generator


def arrivals(steps: list[dict]) -> list[tuple[int, int | None, int]]:
    """(sequence, watermark in force before it or None, burst): the watermark never falls, and each rise begins a burst."""
    out, wm, burst = [], None, 0
    for step in steps:
        if step["kind"] == "event":
            out.append((step["sequence"], wm, burst))
        elif wm is None or step["watermark_ms"] > wm:
            wm, burst = step["watermark_ms"], burst + 1
    return out


def schedule(spark: SparkSession, steps: list[dict]) -> DataFrame:
    return spark.createDataFrame([(n, wm) for n, wm, _ in arrivals(steps)], "sequence long, wm_before_ms long")


def write_bursts(records: list[dict], steps: list[dict], folder: str | Path) -> int:
    """A file of JSON lines per burst, named in order, so that a stream of one file per trigger replays the script."""
    bursts: dict[int, list[dict]] = {}
    for n, _, burst in arrivals(steps):
        bursts.setdefault(burst, []).append(records[n - 1])
    Path(folder).mkdir(parents=True, exist_ok=True)
    for burst, part in bursts.items():
        generator.write(part, Path(folder) / f"{burst:06d}.jsonl")
    return len(bursts)


def read_steps(path: str | Path) -> list[dict]:
    return json.loads(Path(path).read_text())
