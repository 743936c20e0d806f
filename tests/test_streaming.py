"""Streaming end to end over JSON lines: join, fan-out, rules, replay and restart from the checkpoint."""

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import validation
from tidewatch.operators import dedup, enrich, rules
from tidewatch.sinks.store import SqliteStore
from tidewatch.sources import generator, readers
from tidewatch.streaming import pipeline
from tidewatch.streaming.job import Job


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    root = tmp_path_factory.mktemp("jsonl")
    arts, behaviors, _ = generator.generate(generator.Spec(behaviors=400, articles=60, span_s=600, duplicate_ratio=0.05))
    (root / "articles").mkdir()
    (root / "behaviors").mkdir()
    generator.write(arts, root / "articles" / "0.jsonl")
    half = len(behaviors) // 2
    generator.write(behaviors[:half], root / "behaviors" / "0.jsonl")
    return root, arts, behaviors, half


def expected(spark, root):
    read = lambda kind, sub: validation.clean(validation.validate(readers.read_lines(spark, str(root / sub)), kind))
    return enrich.enrich(dedup.first_by(read("behavior", "behaviors"), ["event_id"], ["sequence"]), enrich.latest_articles(read("article", "articles")))


@pytest.fixture
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def job(spark, root, out, store, **options):
    return Job(spark, readers.stream_lines(spark, str(root / "articles")), readers.stream_lines(spark, str(root / "behaviors")), store, str(out), salts=2, **options)


def test_unified_job_restart_and_rules(spark, data, tmp_path, few_partitions):
    root, _, behaviors, half = data
    store = SqliteStore(str(tmp_path / "r.db"))
    begun = job(spark, root, tmp_path, store, threshold=30)
    begun.run_all()
    assert begun.metrics.rows["join"] > 0 and begun.metrics.kinds["joined"] == len(store.rows("clean_behavior"))
    first = len(store.rows("clean_behavior"))
    assert first > 0
    generator.write(behaviors[half:], root / "behaviors" / "1.jsonl")
    job(spark, root, tmp_path, store, threshold=30).run_all()  # goes on from the checkpoints: article state is still there
    want = expected(spark, root).cache()
    assert {r["event_id"] for r in store.rows("clean_behavior")} == {r["event_id"] for r in want.select("event_id").collect()} and len(store.rows("clean_behavior")) > first
    got = {(r["window_start_ms"], r["article_id"], r["click_count"]) for r in store.rows("article_alert")}
    assert got == {(r["window_start_ms"], r["article_id"], r["click_count"]) for r in rules.rule_a(want, threshold=30).collect()} != set()
    got = {(r["window_start_ms"], r["rank_no"], r["category"], r["score"], r["revision"]) for r in store.rows("category_rank")}
    assert got == {(r["window_start_ms"], r["rank_no"], r["category"], r["score"], r["revision"]) for r in rules.rule_b(want).collect()}
    assert store.snapshot(pipeline.SNAPSHOT_KEY)[0]["window_start_ms"] == max(w for w, *_ in got)
    got = {(r["alert_minute_ms"], r["ip"], r["article_count"], r["click_count"]) for r in store.rows("ip_alert") if not r["retracted"]}
    assert got == {(r["alert_minute_ms"], r["ip"], r["article_count"], r["click_count"]) for r in rules.rule_c(want).collect()} != set()
    assert all(isinstance(json.loads(r["article_ids"]), list) for r in store.rows("ip_alert"))
    assert {r["source_stream"] for r in store.rows("dirty_data")} == {"behavior"}


def test_lateness_is_reported_by_running_queries(spark, tmp_path, few_partitions):
    """Arrivals by script: events of +5 h, then one of +1 h. The join reports and joins it, A and B report it, C drops and reports it."""
    t0 = datetime(2026, 9, 27, tzinfo=UTC)
    for sub in ("articles", "behaviors"):
        (tmp_path / sub).mkdir()
    store = SqliteStore(str(tmp_path / "r.db"))
    at = lambda h: t0 + timedelta(hours=h)
    generator.write([generator.article(1, at(5), "science")], tmp_path / "articles" / "0.jsonl")
    generator.write([generator.behavior("e1", "article-000001", at(5), "click", "1.1.1.1", "u", 10)], tmp_path / "behaviors" / "0.jsonl")
    job(spark, tmp_path, tmp_path / "out", store).run_all()
    assert not store.rows("late_data")
    generator.write([generator.behavior("e2", "article-000001", at(1), "click", "1.1.1.1", "u", 10), generator.behavior("e1", "article-000001", at(1), "click", "1.1.1.1", "u", 10)], tmp_path / "behaviors" / "1.jsonl")
    job(spark, tmp_path, tmp_path / "out", store).run_all()
    assert {r["event_id"] for r in store.rows("clean_behavior")} == {"e1", "e2"}
    wm = int((at(5) - timedelta(seconds=30)).timestamp() * 1000)
    assert [(r["event_id"], r["watermark_ms"], r["source_stream"]) for r in store.rows("late_data")] == [("e2", wm, "behavior")]
    assert sorted((r["event_type"], r["event_id"]) for r in store.rows("pipeline_event")) == [(f"ROLE_{x}_LATE", "e2") for x in "ABC"]


def test_dirty_stream(spark, data, tmp_path):
    root = data[0]
    store = SqliteStore(str(tmp_path / "d.db"))
    bad = validation.validate(readers.stream_lines(spark, str(root / "behaviors")), "behavior").filter(F.col("error_message").isNotNull())
    pipeline.start(bad, pipeline.dirty_sink(store, "behavior"), f"{tmp_path}/s", "append", once=True).awaitTermination()
    assert {r["source_stream"] for r in store.rows("dirty_data")} == {"behavior"}


def test_supervisor_restarts():
    tries, slept = [], []

    class Query:
        def awaitTermination(self):
            tries.append(1)
            if len(tries) < 3:
                raise RuntimeError("down")

    pipeline.supervise(Query, sleep=slept.append)
    assert len(tries) == 3 and slept == [5, 5]
