"""Batch operators on the fixtures of the survey: validation, deduplication, joins and rule boundaries."""

import json
import math
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import validation
from tidewatch.functions.scalar import iso_millis, uuid3
from tidewatch.operators import audit, dedup, enrich, rules, schedule
from tidewatch.sources import generator, readers, scripted

T0 = datetime(2026, 9, 27, tzinfo=UTC)
MS0 = int(T0.timestamp() * 1000)


def at(ms):
    return T0 + timedelta(milliseconds=ms)


def raw(spark, records):
    rows = [(i, r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "sequence long, value string")


def joined(spark, articles, behaviors):
    a = validation.clean(validation.validate(raw(spark, articles), "article"))
    b = validation.clean(validation.validate(raw(spark, behaviors), "behavior"))
    return enrich.enrich(dedup.first_by(b, ["event_id"], ["sequence"]), enrich.latest_articles(a))


def click(i, article, ms, **more):
    return {**generator.behavior(f"e{i}", article, at(ms), "click", "127.0.0.1", "u", 1000), **more}


GOOD = generator.behavior("e1", "article-000001", T0)


@pytest.mark.parametrize(("change", "message"), [
    ({}, None),
    ({"ip": "256.0.0.1"}, None),
    ({"event_id": None}, validation.MISSING + "event_id"),
    ({"event_id": " \t"}, validation.MISSING + "event_id"),
    ({"article_id": 5}, validation.MISSING + "article_id"),
    ({"event_time": "2026-09-27"}, validation.NO_JSON),
    ({"event_time": "2026-09-27T02:00:01Z"}, None),
    ({"event_time": "2026-09-27T02:00:01.001Z"}, validation.AHEAD),
    ({"action": "view"}, validation.BAD_ACTION),
    ({"read_duration_ms": -1}, validation.BAD_INTEGER + "read_duration_ms"),
    ({"read_duration_ms": 86_400_001}, validation.BAD_INTEGER + "read_duration_ms"),
    ({"read_duration_ms": 1.0}, validation.BAD_INTEGER + "read_duration_ms"),
    ({"read_duration_ms": "7"}, validation.BAD_INTEGER + "read_duration_ms"),
    ({"action": "view", "ip": ""}, validation.MISSING + "ip"),
])
def test_behavior_validation(spark, change, message):
    row = validation.validate(raw(spark, [{**GOOD, **change}]), "behavior").first()
    assert row["error_message"] == message


@pytest.mark.parametrize(("change", "message"), [
    ({}, None), ({"tags": []}, validation.BAD_ARTICLE), ({"tags": "x"}, validation.BAD_ARTICLE), ({"event_type": "drop"}, validation.BAD_ARTICLE),
    ({"version": 0}, validation.BAD_INTEGER + "version"), ({"version": 2147483648}, validation.BAD_INTEGER + "version"), ({"published_at": "soon"}, validation.NO_JSON),
])
def test_article_validation(spark, change, message):
    row = validation.validate(raw(spark, [{**generator.article(1, T0, "science"), **change}]), "article").first()
    assert row["error_message"] == message


def test_unparsable_records_are_dirty_with_stable_ids(spark):
    bad = ["{", "[]", '{"a": 1} trailing', "null"]
    v = validation.validate(raw(spark, bad), "behavior")
    rows = validation.dirty(v, "behavior").collect()
    assert {r["reason"] for r in rows} <= {validation.NO_JSON, validation.MISSING + "event_id"} and len(rows) == 4
    import hashlib
    import uuid

    h = bytearray(hashlib.md5(b"{").digest())
    h[6], h[8] = h[6] & 0x0F | 0x30, h[8] & 0x3F | 0x80
    assert f"raw-{uuid.UUID(bytes=bytes(h))}" in {r["record_id"] for r in rows}


def test_uuid_and_times(spark):
    r = spark.range(1).select(uuid3(F.lit("x")).alias("u"), iso_millis(F.lit("1970-01-01T01:00:00.5+01:00")).alias("t"), iso_millis(F.lit("1970-01-01 00:00:00Z")).alias("n")).first()
    assert len(r["u"]) == 36 and r["u"][14] == "3" and r["t"] == 500 and r["n"] is None


def test_oracle_small(spark):
    arts = [generator.article(i, T0, "science") for i in range(1, 53)]
    b = [click(i, "article-000001", 299_000) for i in range(1001)]
    b += [click(2000 + i, f"article-{i + 2:06d}", 30_000, ip="127.0.0.2") for i in range(51)]
    b += [b[0], {**b[0], "event_id": "bad", "read_duration_ms": -1}]
    e = joined(spark, arts, b).cache()
    assert e.count() == 1052
    a = rules.rule_a(e).orderBy("window_start_ms").collect()
    assert len(a) == 5 and a[0]["click_count"] == 1001 and a[0]["window_end_ms"] == MS0 + 300_000
    assert rules.rule_b(e).count() == 1
    c = rules.rule_c(e).collect()
    assert [(r["article_count"], r["click_count"]) for r in c] == [(51, 51)]


def test_highest_version_holds_for_all_behaviours(spark):
    arts = [generator.article(1, T0, "science"), generator.article(1, at(100_000), "science", 2)]
    e = joined(spark, arts, [click(i, "article-000001", 50_000 * i) for i in range(3)])
    assert [r["title"] for r in e.collect()] == ["Title 1 v2"] * 3


def test_dedup_keeps_the_first_clean_copy(spark):
    ips = ["256.0.0.1", "127..0.1", "a.0.0.1", "127.0.0.1"]
    b = [click(1, "article-000001", 0, read_duration_ms=-1)] + [click(1, "article-000001", 0, ip=i) for i in ips] + [click(2, "article-000001", 0), click(3, "article-000001", 0)]
    e = joined(spark, [generator.article(1, T0, "science")], b)
    assert {(r["event_id"], r["ip"]) for r in e.collect()} == {("e1", "256.0.0.1"), ("e2", "127.0.0.1"), ("e3", "127.0.0.1")}


def test_rule_a_boundaries(spark):
    n, b = 0, []
    for name, extra in (("before", 299_999), ("at", 300_000), ("after", 300_001)):
        b += [(f"boundary-{name}", 270_000)] * 1000 + [(f"boundary-{name}", extra)]
    for k in (999, 1000, 1001):
        b += [(f"count-{k}", 299_999)] * k
    rows = [(f"e{n}_{i}", a, "click", "1.1.1.1", MS0 + ms, 1000, "t", "c", 1) for i, (a, ms) in enumerate(b)]
    rows += [("s1", "count-1000", "share", "1.1.1.1", MS0 + 299_999, 1000, "t", "c", 1)]
    e = spark.createDataFrame(rows, "event_id string, article_id string, action string, ip string, event_ms long, read_duration_ms int, title string, category string, article_version int")
    got = {r["article_id"]: r["count"] for r in rules.rule_a(e).groupBy("article_id").count().collect()}
    assert got == {"count-1001": 5, "boundary-before": 5, "boundary-at": 4, "boundary-after": 4}


def test_rule_b_boundaries(spark):
    rows = []

    def add(category, article, ms, action="click"):
        rows.append((f"e{len(rows)}", article, action, "ip", MS0 + ms, 1, "t", category, 1))

    for i in range(1, 7):
        add("alpha", f"alpha-{i}", 599_999)
    add("alpha", "alpha-1", 599_999, "share")
    add("alpha", "alpha-1", 599_999, "comment")
    for c in ("zeta", "epsilon", "delta", "charlie", "bravo"):
        add(c, f"{c}-1", 599_999)
        add(c, f"{c}-2", 599_999)
    add("next", "n", 600_000)
    add("next", "n", 600_001)
    e = spark.createDataFrame(rows, "event_id string, article_id string, action string, ip string, event_ms long, read_duration_ms int, title string, category string, article_version int")
    r = rules.rule_b(e).orderBy("window_start_ms", "rank_no").collect()
    assert [(x["category"], x["score"]) for x in r[:5]] == [("alpha", 8), ("bravo", 2), ("charlie", 2), ("delta", 2), ("epsilon", 2)]
    assert [t["article_id"] for t in r[0]["top_articles"]] == [f"alpha-{i}" for i in range(1, 6)]
    assert (r[5]["category"], r[5]["score"], r[5]["revision"], r[0]["revision"]) == ("next", 2, 2, 18)
    assert rules.latest_snapshot(rules.rule_b(e)).first()["window_start_ms"] == MS0 + 600_000


def test_lateness_functions(spark):
    rows = [(0, 3_900_000), (0, 3_900_001), (240_000, 4_199_998 + 240_000), (240_000, 4_199_999 + 240_000)]
    d = spark.createDataFrame(rows, "e long, wm long")
    r = d.select(audit.is_late_join(F.col("e"), F.col("wm")).alias("j"), audit.is_late_a(F.col("e"), F.col("wm")).alias("a")).collect()
    assert [x["j"] for x in r] == [False, True, True, True]
    assert [x["a"] for x in r] == [False, False, False, True]


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "event_id string, article_id string, action string, ip string, event_ms long, read_duration_ms int, title string, category string, article_version int")
    for f in (rules.rule_a, rules.rule_b, rules.rule_c, lambda x: rules.latest_snapshot(rules.rule_b(x))):
        assert f(e).count() == 0


def test_diff_reports(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0), (2, 3.0), (4, 1.0), (3, None)], "k int, v double")
    assert {(r["k"], r["status"], r["fields"]) for r in audit.diff(a, b, ["k"]).collect()} == {(2, "different", "v"), (4, "extra", None)}


def test_generator_lines_and_sources(spark, tmp_path):
    arts, behaviors, report = generator.generate(generator.Spec(behaviors=300, articles=20))
    assert (arts, behaviors) == generator.generate(generator.Spec(behaviors=300, articles=20))[:2]
    generator.write(behaviors, tmp_path / "b.jsonl")
    (tmp_path / "b.jsonl").open("a").write("\n  \n")
    lines = readers.read_lines(spark, str(tmp_path / "b.jsonl"))
    assert lines.count() == len(behaviors) >= 351 and report["dirty"] > 0
    v = validation.validate(lines, "behavior")
    assert validation.dirty(v, "behavior").count() == sum(b["event_id"].startswith("dirty") for b in behaviors)
    assert readers.kafka_options("t")["startingOffsets"] == "earliest"


def test_online_rules_judge_each_window_by_the_watermark_at_arrival(spark, tmp_path):
    minute, end = 60_000, 5 * 60_000
    clicks = [click(i, "article-000001", 4 * minute) for i in range(1, 6)]
    # the click's windows end 5 to 9 minutes after T0; the first one is gone at its end - 1 + allowed
    gone = MS0 + end - 1 + audit.ALLOWED_LATENESS_MS
    steps = [{"kind": "event", "sequence": 1}]
    for n, wm in ((2, gone - 1), (3, gone), (4, gone + 4 * minute - 1), (5, gone + 4 * minute)):
        steps += [{"kind": "watermark", "watermark_ms": wm}, {"kind": "event", "sequence": n}]
    steps.append({"kind": "watermark", "watermark_ms": gone})  # a fall changes nothing
    assert [a[1:] for a in scripted.arrivals(steps)] == [(None, 0), (gone - 1, 1), (gone, 2), (gone + 4 * minute - 1, 3), (gone + 4 * minute, 4)]
    events = joined(spark, [generator.article(1, T0, "science")], clicks).withColumn("sequence", F.regexp_extract("event_id", r"(\d+)$", 1).cast("long"))
    late = schedule.at_arrival(events, scripted.schedule(spark, steps))
    got = {(r["window_start_ms"] - MS0) // minute: r["click_count"] for r in schedule.rule_a_online(late, threshold=0).collect()}
    assert got == {0: 2, 1: 3, 2: 3, 3: 3, 4: 4}
    missing = schedule.at_arrival(events, scripted.schedule(spark, steps).filter("sequence = 3"))
    assert missing.count() == 5 and {r["click_count"] for r in schedule.rule_a_online(missing, threshold=0).collect()} == {4, 5}
    # rule B's only window ends 10 minutes after T0
    assert [r["score"] for r in schedule.rule_b_online(late).collect()] == [5]
    assert [r["score"] for r in schedule.rule_b_online(late, allowed_ms=0).collect()] == [1]
    assert scripted.write_bursts(clicks, steps, tmp_path / "s") == 5
    assert [json.loads(p.read_text())["event_id"] for p in sorted((tmp_path / "s").iterdir())] == [c["event_id"] for c in clicks]


def test_late_scores(spark):
    scores = spark.createDataFrame([("a1", "science", 600_000, 7)], "article_id string, category string, window_start_ms long, score long")
    row = audit.late_scores(scores).first()
    assert row[:4] == ("ROLE_B_LATE", "a1-600000", "a1", "RANK_STATE_EXPIRED")
    assert json.loads(row["payload"]) == {"exception_type": "ROLE_B_LATE", "event_id": "a1-600000", "article_id": "a1", "category": "science", "window_start_ms": 600_000, "score": 7, "dirty_reason": "RANK_STATE_EXPIRED"}


def test_writers_keep_pace_and_order(tmp_path):
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    assert list(generator.paced(range(1000), 500, lambda: now[0], sleep)) == list(range(1000))
    assert now[0] == pytest.approx(2) and len(slept) <= 202
    assert list(generator.paced([], 500, lambda: now[0], sleep)) == []
    assert generator.write([GOOD], tmp_path / "x", 1000) == 1 and json.loads((tmp_path / "x").read_text()) == GOOD

    class Producer:
        def __init__(self):
            self.sent, self.flushed = [], False

        def send(self, topic, key, value):
            self.sent.append((topic, key, json.loads(value)["event_id"]))

        def flush(self):
            self.flushed = True

    p, article = Producer(), generator.article(1, at(5000), "science")
    assert generator.send(p, [article], [GOOD, {**GOOD, "event_id": "e2", "article_id": None}]) == 3 and p.flushed
    assert p.sent == [("topic_behavior", b"article-000001", "e1"), ("topic_behavior", None, "e2"), ("topic_article", b"article-000001", article["event_id"])]


def test_rule_c_threshold_and_mean_depend_on_no_order(spark):
    # read in this order the sum of ten binary fractions stays below 6; exactly it is 6
    rows = [(f"e{i}", i, "click", "x", i, 0.6) for i in range(10)] + [(f"f{i}", i, "click", "y", i, v) for i, v in enumerate((0.1, 0.2, 0.3))] + [(f"g{i}", i, "click", "z", i, v) for i, v in enumerate((0.3, 0.2, 0.1))]
    e = spark.createDataFrame(rows, "event_id string, article_id long, action string, ip string, event_ms long, read_duration_ms double")
    assert 0.6 + 0.6 + 0.6 + 0.6 + 0.6 + 0.6 + 0.6 + 0.6 + 0.6 + 0.6 < 6
    assert not [r for r in rules.rule_c_candidates(e, 100, 9, 0.6).collect() if r["ip"] == "x"]
    got = {r["ip"]: r["avg_read_duration_ms"] for r in rules.rule_c(e, 100, 100, 2, 0.5).collect()}
    assert got == {"y": 0.6 / 3, "z": 0.6 / 3}
    odd = e.withColumn("read_duration_ms", F.when(F.col("event_id") == "e3", F.lit(float("nan"))).when(F.col("event_id") == "e4", None).when(F.col("event_id") == "e5", 1e30).otherwise(F.col("read_duration_ms")))
    sums = [r["read_duration_sum_ms"] for r in rules.rule_c_lookback(odd.filter("ip = 'x'"), 2).orderBy("event_ms").collect()]
    assert sums[2] == 1.2 and math.isnan(sums[3]) and math.isnan(sums[4]) and sums[5] == 1e30
