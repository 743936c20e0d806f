"""Throughput and latency of streaming queries."""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class RollingP95:
    """Nearest-rank 95th percentile of the last `size` values."""

    def __init__(self, size: int = 2048):
        self.values: deque = deque(maxlen=size)

    def add(self, v: float) -> None:
        self.values.append(v)

    def get(self) -> float:
        s = sorted(self.values)
        return s[math.ceil(0.95 * len(s)) - 1] if s else 0.0


class Metrics(StreamingQueryListener):
    """Rows and rows per second per query, batch times, and the observed counts by kind."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.rate: dict[str, float] = {}
        self.batch_ms = RollingP95()
        self.kinds: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = p.name or str(p.id)
        self.rows[name] = self.rows.get(name, 0) + p.numInputRows
        self.rate[name] = p.processedRowsPerSecond
        self.batch_ms.add(p.batchDuration)
        for row in p.observedMetrics.values():
            for k, v in row.asDict().items():
                self.kinds[k] = self.kinds.get(k, 0) + (v or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def observe_kinds(df: DataFrame, name: str = "join") -> DataFrame:
    """Counts of joined, unmatched, rejoined and late rows, and of all, as observed metrics."""
    n = lambda c: F.count(F.when(c, 1))
    return df.observe(
        name, F.count(F.lit(1)).alias("all"), n(F.col("kind") == "joined").alias("joined"), n((F.col("kind") == "unmatched") & ~F.col("matched")).alias("unmatched"),
        n((F.col("kind") == "unmatched") & F.col("matched")).alias("rejoined"), n(F.col("kind") == "late").alias("late"))
