"""Streaming twins: each runs a query to completion over the test tables and returns its result table."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import dedup
from tidewatch.plans import reference_queries as batch
from tidewatch.session import ROCKSDB, checkpoint_root
from tidewatch.sinks.store import SqliteStore
from tidewatch.sources import readers
from tidewatch.streaming import pipeline
from tidewatch.streaming.cores import RuleCCore

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DAY = batch.DAY


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f
    return add


def _stream(spark, d) -> DataFrame:
    """Events as a stream, enriched from the static documents."""
    e = readers.table(spark, d, "events")
    s = spark.readStream.schema(e.schema).parquet(f"{d}/events.parquet*")
    s = s.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("article_id"), F.col("event_type").alias("action"), F.col("user_id").alias("ip"), F.unix_millis(F.col("ts").cast("timestamp")).alias("event_ms"), F.col("value").alias("read_duration_ms"))
    s = s.filter(F.col("action").isin(*batch.VALID))
    a = readers.test_articles(spark, d).select("article_id", "title", "category", F.col("version").alias("article_version"))
    return s.join(a, "article_id")


def _run(spark, df: DataFrame, sink, mode: str = "update") -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    at = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    pipeline.start(df, sink, at, mode, once=True).awaitTermination()


def _store() -> SqliteStore:
    return SqliteStore(os.path.join(tempfile.mkdtemp(), "results.db"))


@query("stream_rule_a", f"SELECT window_start_ms, window_end_ms, article_id, title, category, click_count FROM ({batch.SQL_A}) WHERE click_count > 5")
def stream_rule_a(spark, d):
    store = _store()
    _run(spark, pipeline.stream_rule_a(_stream(spark, d), "5 days", "1 day"), pipeline.sink_a(store, 5))
    rows = [(r["window_start_ms"], r["window_end_ms"], int(r["article_id"]), r["title"], r["category"], r["click_count"]) for r in store.rows("article_alert")]
    return spark.createDataFrame(rows, "window_start_ms long, window_end_ms long, article_id long, title string, category string, click_count long")


@query("stream_rule_b", batch.SQL_RANK)
def stream_rule_b(spark, d):
    store = _store()
    _run(spark, pipeline.stream_rule_b(_stream(spark, d), "1 day"), pipeline.sink_b(store, DAY))
    rows = [(r["window_start_ms"], r["rank_no"], r["window_end_ms"], r["category"], r["score"], r["revision"]) for r in store.rows("category_rank")]
    return spark.createDataFrame(rows, "window_start_ms long, rank_no int, window_end_ms long, category string, score long, revision long")


SQL_C1 = f"""WITH c AS (SELECT * FROM ({batch.ENRICHED}) WHERE action = 'click'), k AS (SELECT a.ip, a.event_id, a.event_ms, COUNT(DISTINCT b.article_id) AS article_count, COUNT(*) AS click_count, SUM(b.read_duration_ms) AS s
 FROM c a JOIN c b ON a.ip = b.ip AND b.event_ms > a.event_ms - {DAY} AND b.event_ms <= a.event_ms GROUP BY 1, 2, 3), h AS (SELECT *, (event_ms // {DAY}) * {DAY} AS alert_minute_ms FROM k WHERE article_count > 1 AND s < 60 * click_count),
 f AS (SELECT *, row_number() OVER (PARTITION BY ip, alert_minute_ms ORDER BY event_ms, event_id) AS rn FROM h) SELECT alert_minute_ms, CAST(ip AS VARCHAR) AS ip, event_ms AS window_end_ms, article_count, click_count, round(s, 4) AS read_sum FROM f WHERE rn = 1"""


@query("stream_rule_c", SQL_C1)
def stream_rule_c(spark, d):
    store = _store()
    core = RuleCCore(DAY, 1, 60)
    _run(spark, pipeline.stream_rule_c(_stream(spark, d), core, ttl_ms=0), pipeline.sink_c(store))
    rows = [(r["alert_minute_ms"], r["ip"], r["window_end_ms"], r["article_count"], r["click_count"], round(float(r["read_duration_sum_ms"]), 4)) for r in store.rows("ip_alert") if not r["retracted"]]
    return spark.createDataFrame(rows, "alert_minute_ms long, ip string, window_end_ms long, article_count long, click_count long, read_sum double")


@query("stream_dedup", f"SELECT count(*) AS n FROM ({batch.CLEAN})")
def stream_dedup(spark, d):
    """Each event is sent twice; the one that arrives first is kept."""
    twice = _stream(spark, d).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2))))
    seen: dict[int, int] = {}
    _run(spark, dedup.dedup_stream(twice, ["event_id"]), lambda b, i: seen.update({i: b.count()}), "append")
    return spark.createDataFrame([(sum(seen.values()),)], "n long")


@query("stream_join", f"SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(article_id AS VARCHAR) AS article_id, title, category FROM ({batch.ENRICHED})")
def stream_join(spark, d):
    """Both sides as streams through the stateful join; articles and behaviours arrive in one batch or in many."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ev, doc = readers.table(spark, d, "events"), readers.table(spark, d, "documents")
    b = spark.readStream.schema(ev.schema).parquet(f"{d}/events.parquet*")
    b = b.select(F.col("event_id").cast("string").alias("event_id"), F.get_json_object("props", "$.k").alias("article_id"), F.col("event_type").alias("action"), F.unix_millis(F.col("ts").cast("timestamp")).alias("event_ms"), F.col("ts").cast("timestamp").alias("event_ts")).filter(F.col("action").isin(*batch.VALID))
    a = spark.readStream.schema(doc.schema).parquet(f"{d}/documents.parquet*")
    a = a.select(F.concat(F.lit("doc-"), "doc_id").alias("event_id"), F.col("doc_id").cast("string").alias("article_id"), F.col("lang").alias("title"), F.col("source").alias("category"), F.lit(1).alias("version"), F.lit(0).cast("long").alias("event_ms"), F.timestamp_millis(F.lit(0).cast("long")).alias("event_ts"))
    at = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{at}/out"

    def sink(batch_df, i):
        batch_df.filter("kind = 'joined'").select("event_id", "article_id", F.get_json_object("payload", "$.title").alias("title"), F.get_json_object("payload", "$.category").alias("category")).write.mode("overwrite").parquet(f"{out}/batch={i}")

    q = pipeline.start(pipeline.joined_stream(a, b, salts=2), sink, f"{at}/state", "append", every="0 seconds")
    pipeline.drain(q)
    return spark.read.parquet(out).drop("batch")
