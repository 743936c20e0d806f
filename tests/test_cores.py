"""Exact boundaries of the stateful logic, without Spark."""

import random

import pytest
from pyspark.sql import Row

from tidewatch.sinks import merge
from tidewatch.sinks.store import SqliteStore, batch_size, chunks, with_retry
from tidewatch.streaming.cores import BEYOND_LATENESS, NOT_YET_FOUND, REJOINED, REPLAY_REQUIRED, JoinCore, JoinState, RuleCCore
from tidewatch.streaming.metrics import RollingP95
from tidewatch.streaming.processors import RuleCProcessor

M = 60_000


def art(version=1, ms=0):
    return {"event_id": f"a{version}", "article_id": "a", "event_ms": ms, "title": f"t{version}", "category": "c", "version": version}


def beh(i, ms=0):
    return {"event_id": f"b{i}", "article_id": "a", "event_ms": ms}


def test_join_keeps_arrival_version():
    core, s = JoinCore(), JoinState()
    core.article(s, art(1), 0, 0)
    first = core.behavior(s, beh(1), 1, 0)
    core.article(s, art(2), 2, 0)
    second = core.behavior(s, beh(2), 3, 0)
    assert [o.record["title"] for o in (*first, *second)] == ["t1", "t2"]


def test_join_ignores_older_versions_and_replaces_equal_ones():
    core, s = JoinCore(), JoinState()
    core.article(s, art(2), 0, 0)
    core.article(s, art(1), 0, 0)
    assert s.article["version"] == 2
    core.article(s, {**art(2), "title": "new"}, 0, 0)
    assert s.article["title"] == "new"


def test_pending_is_flushed_with_rejoined_marks():
    core, s = JoinCore(), JoinState()
    assert [o.reason for o in core.behavior(s, beh(1), 5, 0)] == [NOT_YET_FOUND]
    assert core.behavior(s, beh(1), 6, 0) == []
    assert s.deadline_ms == 5 + 2 * 3_600_000
    outs = core.article(s, art(), 10, 0)
    assert [(o.kind, o.reason, o.matched) for o in outs] == [("joined", None, False), ("unmatched", REJOINED, True)]
    assert s.deadline_ms is None and not s.pending


def test_deadline_leaves_for_replay_and_ignores_stale_timers():
    core, s = JoinCore(), JoinState()
    core.behavior(s, beh(1), 0, 0)
    assert core.deadline(s, s.deadline_ms - 1) == []
    assert [o.reason for o in core.deadline(s, s.deadline_ms)] == [REPLAY_REQUIRED]
    assert core.deadline(s, 10**12) == []


def test_article_state_expires():
    core, s = JoinCore(), JoinState()
    core.article(s, art(), 0, 0)
    assert core.behavior(s, beh(1), 2 * 3_600_000, 0)[0].reason == NOT_YET_FOUND


@pytest.mark.parametrize(("wm", "late"), [(0, False), (65 * M, False), (65 * M + 1, True)])
def test_late_rows_are_reported_and_still_joined(wm, late):
    core, s = JoinCore(), JoinState()
    core.article(s, art(ms=10**9), 0, 0)
    outs = core.behavior(s, beh(1, 0), 0, wm)
    assert [o.kind for o in outs] == (["late"] if late else []) + ["joined"]
    if late:
        assert outs[0].reason == BEYOND_LATENESS


def clicks(n, ms=0, duration=1000, start=0):
    return {f"e{start + i:04d}": (ms + i, f"a{start + i:04d}", duration) for i in range(n)}


def test_rule_c_thresholds():
    core = RuleCCore()
    assert core.answer(0, {}, clicks(51, -M)) is None
    assert not core.answer(0, clicks(50), {}).alert
    hit = core.answer(0, clicks(60), {})
    assert hit.alert and hit.click_count == 51 and hit.end == 50
    assert not core.answer(0, clicks(51, duration=2000), {}).alert
    assert core.answer(0, clicks(51, duration=1999), {}).alert


def test_rule_c_excludes_clicks_a_look_back_old():
    core = RuleCCore()
    new = {f"e{i}": (M, f"a{i}", 1000) for i in range(50)}
    assert not core.answer(M, new, {"x": (0, "x", 1000)}).alert
    assert core.answer(M, new, {"x": (1, "x", 1000)}).alert


def test_rule_c_same_millisecond_counts_together():
    assert RuleCCore().answer(0, {f"e{i}": (5, f"a{i}", 1) for i in range(51)}, {}).click_count == 51


def test_rule_c_against_every_look_back():
    r = random.Random(3)
    core = RuleCCore(100, 3, 40)
    for _ in range(300):
        every = {f"e{i}": (r.randrange(0, 200), f"a{r.randrange(8)}", r.randrange(80)) for i in range(r.randrange(1, 40))}
        own, before = ({k: c for k, c in every.items() if c[0] // 100 == m} for m in (1, 0))
        want = None
        for end in sorted({c[0] for c in own.values()}):
            seen = [c for c in every.values() if end - 100 < c[0] <= end]
            alert = len({c[1] for c in seen}) > 3 and sum(c[2] for c in seen) < 40 * len(seen)
            want = (end, len(seen), sum(c[2] for c in seen), tuple(sorted({c[1] for c in seen})), alert)
            if alert:
                break
        got = core.answer(100, own, before)
        assert (got and (got.end, got.click_count, got.duration_sum, got.article_ids, got.alert)) == want


def test_rule_c_retracts_and_revisions_grow():
    core, c = RuleCCore(), clicks(51)
    a, sent = core.follow(None, core.answer(0, c, {}))
    assert sent and a.revision == 1
    assert core.follow(a, core.answer(0, c, {})) == (a, False)
    c["slow"] = (10, "a0000", 10**6)
    b, sent = core.follow(a, core.answer(0, c, {}))
    assert sent and not b.alert and b.revision == 2
    c["more"] = (20, "a0001", 10**6)
    d, sent = core.follow(b, core.answer(0, c, {}))
    assert not sent and d.revision == 2


def test_rule_c_lateness_boundaries():
    core = RuleCCore()
    assert core.lateness(0, 66 * M - 1) == "on_time"
    assert core.lateness(0, 66 * M) == "partial"
    assert core.lateness(0, 67 * M - 1) == "partial"
    assert core.lateness(0, 67 * M) == "dropped"
    assert core.targets(0, 66 * M) == [M]
    assert core.bucket(-1) == -M


def test_merge_rules():
    g = merge.greatest_count({"click_count": 1002, "title": "a"}, {"click_count": 1001, "title": "b"})
    assert g == {"click_count": 1002, "title": "b"}
    assert merge.by_revision({"revision": 2, "x": 1}, {"revision": 1, "x": 2})["x"] == 1
    assert merge.by_revision({"revision": 2, "x": 1}, {"revision": 2, "x": 2})["x"] == 2
    assert merge.keep_first({"x": 1}, {"x": 2}) == {"x": 1}
    m = merge.sticky_matched({"matched": True, "reason": "r", "payload": "p"}, {"matched": False, "reason": "q", "payload": "z"})
    assert m == {"matched": True, "reason": "r", "payload": "p"}
    assert merge.mark_matched(None, "x") is None


def test_store_replay_snapshot_and_time_to_live(tmp_path):
    now = [0.0]
    s = SqliteStore(str(tmp_path / "r.db"), clock=lambda: now[0])
    row = {"window_start_ms": 0, "article_id": "a", "window_end_ms": 1, "title": "t", "category": "c", "click_count": 1002}
    for r in ([row], [row], [{**row, "click_count": 1001}]):
        s.upsert("article_alert", r)
    assert [r["click_count"] for r in s.rows("article_alert")] == [1002]
    first = {"window_start_ms": 10, "revision": 5}
    assert s.set_snapshot("k", first)
    now[0] = 7000
    assert not s.set_snapshot("k", {"window_start_ms": 10, "revision": 4})
    assert not s.set_snapshot("k", {"window_start_ms": 9, "revision": 50})
    assert s.snapshot("k")[1] == 7200
    assert s.set_snapshot("k", {"window_start_ms": 10, "revision": 5})
    assert s.snapshot("k")[1] == 14200
    now[0] = 14200
    assert s.snapshot("k") is None
    s.upsert("unmatched_behavior", [{"event_id": "e", "article_id": "a", "event_time": "t", "matched": False, "reason": "r", "payload": "{}"}])
    s.mark_matched(["e", "unknown"])
    assert [(r["event_id"], r["matched"], r["reason"]) for r in s.rows("unmatched_behavior")] == [("e", 1, "BEHAVIOR_REJOINED")]


def test_batches_and_retries():
    assert [len(c) for c in chunks([{}] * 5, 2)] == [2, 2, 1]
    with pytest.raises(ValueError):
        batch_size(0)
    tries, slept = [], []

    def fail():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("deadlock")

    with_retry(fail, lambda e: "deadlock" in str(e), sleep=slept.append)
    assert len(tries) == 3 and slept == [0.1, 0.2]
    with pytest.raises(ZeroDivisionError):
        with_retry(lambda: 1 / 0, lambda e: False, sleep=slept.append)


def test_p95_is_nearest_rank():
    p = RollingP95(100)
    for i in range(1, 201):
        p.add(i)
    assert p.get() == 195


def test_rule_c_adds_reads_exactly():
    # added one by one these stay below 6
    assert not RuleCCore(100, 9, 0.6).answer(0, {f"e{i}": (i, f"a{i}", 0.6) for i in range(10)}, {}).alert


def test_rule_c_state_is_accessed_by_minute_not_by_address():
    class Minutes(dict):
        calls = 0

        def _count(self, value=None):
            self.calls += 1
            return value

        def exists(self):
            return self._count(bool(self))

        def containsKey(self, k):
            return self._count(k in self)

        def getValue(self, k):
            return self._count(self[k])

        def updateValue(self, k, v):
            self._count()
            self[k] = v

        def removeKey(self, k):
            self._count()
            del self[k]

        def clear(self):
            self._count()
            super().clear()

    class At:
        timers, wm, fired = [], 0, 0
        getCurrentProcessingTimeInMs = lambda self: 0
        getCurrentWatermarkInMs = lambda self: self.wm
        getExpiryTimeInMs = lambda self: self.fired
        getMapState = lambda self, *a: minutes
        registerTimer = lambda self, t: self.timers.append(t)

    def send(lo, hi):
        rows = [Row(ip=f"ip{a}", event_id=f"{a}-{i}", event_ms=m * M + i, article_id=f"a{i}", read_duration_ms=1) for a in range(40) for m in range(3) for i in range(lo, hi)]
        return [r for r in p.handleInputRows((7,), iter(rows), at) if not r["retracted"]]

    minutes, at = Minutes(), At()
    p = RuleCProcessor(RuleCCore(), ttl_ms=0)
    p.init(at)
    assert not send(0, 20) and minutes.calls < 10 and at.timers == [67 * M]
    assert {(r["ip"], r["alert_minute_ms"], r["article_count"]) for r in send(20, 51)} == {(f"ip{a}", m * M, 51) for a in range(40) for m in range(3)}
    at.wm = at.fired = 67 * M
    list(p.handleExpiredTimer((7,), at, at))
    assert sorted(minutes) == [(M,), (2 * M,)] and at.timers[-1] == 68 * M
    at.wm = at.fired = 69 * M
    list(p.handleExpiredTimer((7,), at, at))
    assert not minutes
