"""Structured Streaming forms of the join and the three rules.

Q0 joins the raw streams and fans out into clean, late, unmatched and dirty tables; QA, QB and QC read the
clean table, a durable append-only folder, so that each keeps its own watermark and output mode.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.functions import validation
from tidewatch.functions.scalar import salt as salt_of
from tidewatch.operators import audit, rules
from tidewatch.sinks.store import SqliteStore, write_batch
from tidewatch.streaming.cores import JoinCore, RuleCCore
from tidewatch.streaming.processors import C_OUT, JOIN_OUT, JoinProcessor, RuleCProcessor

WATERMARK = "30 seconds"
#: disorder plus allowed lateness, for queries whose state must still take late rows
LATE_WATERMARK = "3930 seconds"
SNAPSHOT_KEY = "tidewatch:top5:latest"


def _payload(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[c for c in df.columns if c not in ("value", "event_ts", "sequence")]))


def joined_stream(articles: DataFrame, behaviors: DataFrame, core: JoinCore | None = None, salts: int = 8, idle: bool = False) -> DataFrame:
    """Tagged rows of the stateful join. Inputs: validated, clean frames with event_ts, behaviours deduplicated (`dedup_stream`).

    The watermark is the lesser one of the two sides. With `idle`, one of both together, so that a side that sends
    nothing doesn't hold the other's lateness back.
    """
    a, b = articles, behaviors
    a = a.select("article_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit("article").alias("side"), _payload(a).alias("payload"), "event_ts")
    b = b.select("article_id", salt_of(F.col("event_id"), salts).alias("salt"), F.lit("behavior").alias("side"), _payload(b).alias("payload"), "event_ts")
    both = a.unionByName(b).withWatermark("event_ts", WATERMARK) if idle else a.withWatermark("event_ts", WATERMARK).unionByName(b.withWatermark("event_ts", WATERMARK))
    return both.groupBy("article_id", "salt").transformWithState(
        statefulProcessor=JoinProcessor(core or JoinCore()), outputStructType=JOIN_OUT, outputMode="Append", timeMode="ProcessingTime")


def clean_schema() -> str:
    return "event_id string, user_id string, article_id string, action string, ip string, event_time string, ingest_time string, event_ms long, read_duration_ms int, title string, category string, tags array<string>, article_published_at string, article_version int"


def fan_out(store: SqliteStore, clean_path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch of the join: clean rows are appended under the batch's id, so that a replayed batch overwrites itself."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            joined = batch.filter("kind = 'joined'").select(F.from_json("payload", clean_schema()).alias("r")).select("r.*")
            joined.write.mode("overwrite").parquet(f"{clean_path}/batch={batch_id}")
            write_batch(store, "clean_behavior", joined)
            store.mark_matched(r[0] for r in joined.select("event_id").toLocalIterator())
            write_batch(store, "unmatched_behavior", batch.filter("kind = 'unmatched'").select("event_id", "article_id", F.get_json_object("payload", "$.event_time").alias("event_time"), "matched", "reason", "payload"), 1)
            write_batch(store, "late_data", batch.filter("kind = 'late'").select(F.col("stream").alias("source_stream"), "event_id", "article_id", F.get_json_object("payload", "$.event_time").alias("event_time"), "watermark_ms", "reason", "payload"), 1)
        finally:
            batch.unpersist()
    return run


def dirty_sink(store: SqliteStore, stream: str) -> Callable[[DataFrame, int], None]:
    return lambda batch, _: write_batch(store, "dirty_data", validation.dirty(batch, stream), 1) and None


def with_time(df: DataFrame) -> DataFrame:
    return df if "event_ts" in df.columns else df.withColumn("event_ts", F.timestamp_millis("event_ms"))


def stream_rule_a(enriched: DataFrame, size: str = "5 minutes", slide: str = "1 minute", watermark: str = LATE_WATERMARK) -> DataFrame:
    """Running counts per window; the threshold is applied by the sink, since update mode emits partial counts."""
    d = with_time(enriched).filter(F.col("action") == "click").withWatermark("event_ts", watermark)
    g = d.groupBy(F.window("event_ts", size, slide).alias("w"), "article_id").agg(F.count(F.lit(1)).alias("click_count"), F.max(F.struct("article_version", "event_ms", "event_id", "title", "category")).alias("m"))
    return g.select(F.unix_millis("w.start").alias("window_start_ms"), F.unix_millis("w.end").alias("window_end_ms"), "article_id", F.col("m.title").alias("title"), F.col("m.category").alias("category"), "click_count")


def sink_a(store: SqliteStore, threshold: int = 1000) -> Callable[[DataFrame, int], None]:
    return lambda batch, _: write_batch(store, "article_alert", batch.filter(F.col("click_count") > threshold)) and None


def stream_rule_b(enriched: DataFrame, size: str = "10 minutes", watermark: str = LATE_WATERMARK) -> DataFrame:
    d = with_time(enriched).withWatermark("event_ts", watermark)
    g = d.groupBy(F.window("event_ts", size).alias("w"), "category", "article_id").agg(F.count(F.lit(1)).alias("score"), F.max(F.struct("article_version", "event_ms", "event_id", "title")).alias("m"))
    return g.select(F.unix_millis("w.start").alias("window_start_ms"), "category", "article_id", F.col("m.title").alias("title"), "score")


def sink_b(store: SqliteStore, size_ms: int = 600_000, top: int = 5, key: str = SNAPSHOT_KEY) -> Callable[[DataFrame, int], None]:
    """Merge scores, rank the touched windows anew, upsert the ranking and set the latest snapshot."""
    def run(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            write_batch(store, "article_score", batch)
            touched = [r[0] for r in batch.select("window_start_ms").distinct().toLocalIterator()]
            if not touched:
                return
            found = [[None if r[c] is None else str(r[c]) for c in batch.columns] for r in store.lookup("article_score", "window_start_ms", touched)]
            text = batch.sparkSession.createDataFrame(found, ", ".join(f"{c} string" for c in batch.columns))
            scores = text.select(*[F.col(c).cast(t).alias(c) for c, t in batch.dtypes])
            ranking = rules.rule_b_from_scores(scores, size_ms, top)
            write_batch(store, "category_rank", ranking)
            for r in rules.latest_snapshot(ranking).toLocalIterator():
                store.set_snapshot(key, r.asDict(True))
        finally:
            batch.unpersist()
    return run


def stream_rule_c(enriched: DataFrame, core: RuleCCore | None = None, watermark: str = WATERMARK, ttl_ms: int = 3_600_000, groups: int = 1024) -> DataFrame:
    """Addresses share state by `groups`, which holds for a checkpoint's life and bounds the tasks of use.

    The watermark's column is left out below it: a stateful operator that sees it drops late rows before its processor can judge them.
    """
    d = with_time(enriched).filter(F.col("action") == "click").withWatermark("event_ts", watermark)
    d = d.select(F.pmod(F.xxhash64(F.col("ip").cast("string")), F.lit(groups)).alias("group"), F.col("ip").cast("string").alias("ip"), F.col("event_id").cast("string").alias("event_id"), "event_ms", F.col("article_id").cast("string").alias("article_id"), "read_duration_ms")
    return d.groupBy("group").transformWithState(statefulProcessor=RuleCProcessor(core or RuleCCore(), ttl_ms), outputStructType=C_OUT, outputMode="Update", timeMode="EventTime")


def sink_c(store: SqliteStore) -> Callable[[DataFrame, int], None]:
    def run(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            write_batch(store, "ip_alert", batch.filter("kind = 'alert'").drop("kind", "event_id", "article_id", "watermark_ms"))
            late = batch.filter("kind = 'late'").select("event_id", "article_id", "ip", "watermark_ms", F.lit("ROLE_C_LOOKBACK_EXPIRED").alias("dirty_reason"))
            write_batch(store, "pipeline_event", audit.audit_rows(late, "ROLE_C_LATE"))
        finally:
            batch.unpersist()
    return run


def late_sink(store: SqliteStore, rule: str, delay_ms: int = 30_000) -> Callable[[DataFrame, int], None]:
    """Audit of rows of rule A or B whose windows have all been cleaned up when they arrive.

    The watermark is that of the batches before: their latest event less the delay. It is kept in the store with the
    batch's number, so a replayed batch judges its rows by the same one.
    """
    test, name = {"A": audit.is_late_a, "B": audit.is_late_b}[rule], f"late:{rule}"

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            last = store.progress(name) or {"batch": -1, "watermark": 0, "peak": 0}
            wm = last["watermark"] if last["batch"] == batch_id else max(0, last["peak"] - delay_ms)
            late = batch.withColumn("watermark_ms", F.lit(wm).cast("long")).filter(test(F.col("event_ms"), F.col("watermark_ms")))
            write_batch(store, "pipeline_event", audit.audit_rows(late, f"ROLE_{rule}_LATE"))
            peak = batch.agg(F.max("event_ms")).first()[0] or 0
            store.set_progress(name, {"batch": batch_id, "watermark": wm, "peak": max(peak, last["peak"])})
        finally:
            batch.unpersist()
    return run


def start(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", once: bool = False, every: str = "30 seconds", name: str | None = None) -> StreamingQuery:
    """Mode "update" sends a window's counts as they change; "append" only once the watermark has closed it."""
    w = df.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint)
    w = w.queryName(name) if name else w
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def drain(q: StreamingQuery, limit_s: float = 300) -> None:
    """Stop a processing-time query once a batch without input follows one with input.

    Such a query runs empty batches for its timers for ever, so waiting for all available input doesn't return.
    """
    seen, until = False, time.monotonic() + limit_s
    try:
        while time.monotonic() < until and q.isActive:
            p = q.lastProgress
            n = p.numInputRows if p else 0
            if seen and p and n == 0:
                return
            seen = seen or n > 0
            time.sleep(0.2)
        if q.exception():
            raise q.exception()
        raise TimeoutError("the query didn't drain")
    finally:
        q.stop()


def supervise(begin: Callable[[], StreamingQuery], restarts: int = 3, delay_s: float = 5, sleep=time.sleep) -> None:
    """Run a query to its end; start it again after a failure, from its checkpoint."""
    for i in range(restarts + 1):
        try:
            begin().awaitTermination()
            return
        except Exception:
            if i == restarts:
                raise
            sleep(delay_s)
