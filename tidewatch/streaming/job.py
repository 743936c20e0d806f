"""The unified job: records are validated, deduplicated and joined, and the three rules run over the result.

Each stage is a query of its own and hands a durable table to the next, so that each has its own watermark, output
mode and checkpoint, and a failed one restarts alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.functions import validation
from tidewatch.operators import dedup
from tidewatch.sinks.store import SqliteStore
from tidewatch.streaming import pipeline
from tidewatch.streaming.cores import JoinCore, RuleCCore
from tidewatch.streaming.metrics import Metrics, observe_kinds


@dataclass
class Job:
    """`articles` and `behaviors` are streams of raw records in a column `value`; tables and checkpoints go below `root`."""

    spark: SparkSession
    articles: DataFrame
    behaviors: DataFrame
    store: SqliteStore
    root: str
    join: JoinCore = field(default_factory=JoinCore)
    rule_c: RuleCCore = field(default_factory=RuleCCore)
    threshold: int = 1000
    salts: int = 8
    idle: bool = False
    #: rows, rates, batch times and the join's counts by kind, filled while the queries run
    metrics: Metrics = field(default_factory=Metrics)

    def _to_table(self, name: str) -> Callable[[DataFrame, int], None]:
        """Appends a batch under its number, so that a replayed batch overwrites itself."""
        return lambda batch, i: batch.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={i}")

    def _table(self, name: str, schema) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
        return self.spark.readStream.schema(schema).parquet(f"{self.root}/{name}/batch=*")

    def prepared(self, kind: str) -> DataFrame:
        """Clean records of one stream; of behaviours with one id, the first within 24 hours of arrival."""
        found = validation.clean(validation.validate(self.articles if kind == "article" else self.behaviors, kind))
        return found if kind == "article" else dedup.dedup_stream(found, ["event_id"])

    def stages(self) -> list[list[tuple[str, DataFrame, Callable[[DataFrame, int], None], str]]]:
        """(name, stream, sink, output mode), in groups that build on the groups before."""
        first, tables = [], {}
        for kind, raw in (("article", self.articles), ("behavior", self.behaviors)):
            clean = self.prepared(kind)
            dirty = validation.validate(raw, kind).filter(F.col("error_message").isNotNull())
            first += [(f"prepared_{kind}", clean, self._to_table(f"prepared_{kind}"), "append"), (f"dirty_{kind}", dirty, pipeline.dirty_sink(self.store, kind), "append")]
            tables[kind] = self._table(f"prepared_{kind}", clean.schema)
        joined = pipeline.joined_stream(tables["article"], tables["behavior"], self.join, self.salts, self.idle)
        clean = self._table("clean", pipeline.clean_schema())
        unique = self._table("unique", pipeline.clean_schema())
        rules = [
            ("rule_a", pipeline.stream_rule_a(unique), pipeline.sink_a(self.store, self.threshold), "update"), ("late_a", unique.filter("action = 'click'"), pipeline.late_sink(self.store, "A"), "append"),
            ("rule_b", pipeline.stream_rule_b(unique), pipeline.sink_b(self.store), "update"), ("late_b", unique, pipeline.late_sink(self.store, "B"), "append"),
            ("rule_c", pipeline.stream_rule_c(unique, self.rule_c), pipeline.sink_c(self.store), "update")]
        return [
            first, [("join", observe_kinds(joined), pipeline.fan_out(self.store, f"{self.root}/clean"), "append")],
            # a behaviour that is replayed into the join under a new run would come out of it twice
            [("unique", dedup.dedup_stream(clean, ["event_id"]), self._to_table("unique"), "append")], rules]

    def run_all(self, limit_s: float = 300) -> None:
        """Works off what has arrived, stage by stage, and returns; a later call goes on from the checkpoints."""
        self.spark.streams.addListener(self.metrics)
        try:
            self._work_off(limit_s)
        finally:
            self.spark.streams.removeListener(self.metrics)

    def _work_off(self, limit_s: float) -> None:
        for group in self.stages():
            for name, df, sink, mode in group:
                at = f"{self.root}/state/{name}"
                if name == "join":  # its timers never end, so it can't wait for all available input
                    pipeline.drain(pipeline.start(df, sink, at, mode, every="0 seconds", name=name), limit_s)
                else:
                    pipeline.start(df, sink, at, mode, once=True, name=name).awaitTermination()

    def start_all(self, every: str = "30 seconds") -> list[StreamingQuery]:
        """All queries at once, until they are stopped; `metrics` listens for as long as the session."""
        self.spark.streams.addListener(self.metrics)
        return [pipeline.start(df, sink, f"{self.root}/state/{name}", mode, every=every, name=name) for group in self.stages() for name, df, sink, mode in group]
