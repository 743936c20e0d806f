"""Stateful processors around the cores."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

from pyspark.sql import Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.streaming.cores import JoinCore, JoinState, RuleCCore, Snapshot

JOIN_OUT = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("stream", T.StringType()), T.StructField("event_id", T.StringType()), T.StructField("article_id", T.StringType()),
    T.StructField("event_ms", T.LongType()), T.StructField("reason", T.StringType()), T.StructField("matched", T.BooleanType()), T.StructField("watermark_ms", T.LongType()), T.StructField("payload", T.StringType()),
])
C_OUT = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("ip", T.StringType()), T.StructField("alert_minute_ms", T.LongType()), T.StructField("retracted", T.BooleanType()), T.StructField("revision", T.LongType()),
    T.StructField("window_start_ms", T.LongType()), T.StructField("window_end_ms", T.LongType()), T.StructField("article_count", T.LongType()), T.StructField("click_count", T.LongType()), T.StructField("read_duration_sum_ms", T.DoubleType()),
    T.StructField("avg_read_duration_ms", T.DoubleType()), T.StructField("article_ids", T.ArrayType(T.StringType())), T.StructField("event_id", T.StringType()), T.StructField("article_id", T.StringType()), T.StructField("watermark_ms", T.LongType()),
])
TEXT = T.StructType([T.StructField("v", T.StringType())])
NAME = T.StructType([T.StructField("k", T.StringType())])
LONG = T.StructType([T.StructField("v", T.LongType())])
LONG_KEY = T.StructType([T.StructField("k", T.LongType())])


class JoinProcessor(StatefulProcessor):
    """Input: side ("article" or "behavior"), salt, payload (JSON with event_ms). Runs in processing-time mode."""

    def __init__(self, core: JoinCore):
        self.core = core

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.article = handle.getValueState("article", TEXT)
        self.pending = handle.getMapState("pending", NAME, TEXT)
        self.deadline = handle.getValueState("deadline", LONG)

    def _load(self) -> JoinState:
        s = JoinState()
        if self.article.exists():
            s.article, s.article_written_ms = json.loads(self.article.get()[0])
        if self.pending.exists():
            s.pending = {k[0]: json.loads(v[0]) for k, v in self.pending.iterator()}
        if self.deadline.exists():
            s.deadline_ms = self.deadline.get()[0]
        return s

    def _save(self, before: tuple, s: JoinState) -> None:
        article, pending, deadline = before
        if s.article is not article:
            self.article.update((json.dumps([s.article, s.article_written_ms]),)) if s.article else self.article.clear()
        for k in pending - s.pending.keys():
            self.pending.removeKey((k,))
        for k in s.pending.keys() - pending:
            self.pending.updateValue((k,), (json.dumps(s.pending[k]),))
        if s.deadline_ms != deadline:
            if deadline is not None:
                self.handle.deleteTimer(deadline)
            if s.deadline_ms is None:
                self.deadline.clear()
            else:
                self.deadline.update((s.deadline_ms,))
                self.handle.registerTimer(s.deadline_ms)

    def _rows(self, outs) -> Iterator[Row]:
        for o in outs:
            r = o.record
            yield Row(kind=o.kind, stream=o.stream, event_id=r["event_id"], article_id=r["article_id"], event_ms=r["event_ms"], reason=o.reason, matched=o.matched, watermark_ms=o.watermark_ms, payload=json.dumps(r, ensure_ascii=False))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        s = self._load()
        before = (s.article, set(s.pending), s.deadline_ms)
        now, wm = timerValues.getCurrentProcessingTimeInMs(), timerValues.getCurrentWatermarkInMs()
        outs = []
        for r in rows:
            p = json.loads(r.payload)
            if r.side == "article":
                outs += self.core.article(s, p, now, wm, report=r.salt == 0)
            else:
                outs += self.core.behavior(s, p, now, wm)
        self._save(before, s)
        yield from self._rows(outs)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s = self._load()
        before = (s.article, set(s.pending), s.deadline_ms)
        outs = self.core.deadline(s, expiredTimerInfo.getExpiryTimeInMs())
        self._save(before, s)
        yield from self._rows(outs)

    def close(self) -> None:
        pass


class RuleCProcessor(StatefulProcessor):
    """Input: ip, event_id, event_ms, article_id, read_duration_ms, by groups of addresses. Runs in event-time mode.

    State is kept per minute, each address's clicks and answer with the times they were written, so a batch reads the
    minutes that it touches and those before them. What is older than the time to live reads as absent. Each access to
    the state is a round trip to the JVM, so a minute of all the group's addresses is one entry, a group without state is
    asked once, and it has a single timer: that of its first minute to expire when it was set, which sets the next one.
    """

    def __init__(self, core: RuleCCore, ttl_ms: int = 3_600_000):
        self.core, self.ttl_ms = core, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.minutes = handle.getMapState("minutes", LONG_KEY, TEXT)

    def _get(self, key: int, now: int) -> dict:
        """address -> [clicks, time written, answer, time written]"""
        if not self.minutes.containsKey((key,)):
            return {}
        old = lambda written: self.ttl_ms and now - written > self.ttl_ms
        found = ((ip, [{} if old(t) else clicks, t, None if old(u) else answer, u]) for ip, clicks, t, answer, u in json.loads(self.minutes.getValue((key,))[0]))
        return {ip: e for ip, e in found if e[0] or e[2]}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now, wm = timerValues.getCurrentProcessingTimeInMs(), timerValues.getCurrentWatermarkInMs()
        core, minutes, changed, touched, late = self.core, {}, set(), set(), []
        known = self.minutes.exists()

        def minute(m: int) -> dict:
            if m not in minutes:
                minutes[m] = self._get(m, now) if known else {}
            return minutes[m]

        for r in rows:
            kind = core.lateness(r.event_ms, wm) if wm > 0 else "on_time"
            if kind != "on_time":
                late.append(_c_row(kind="late", ip=r.ip, window_end_ms=r.event_ms, event_id=r.event_id, article_id=r.article_id, watermark_ms=wm))
            if kind != "dropped":
                m = core.bucket(r.event_ms)
                entry = minute(m).setdefault(r.ip, [{}, now, None, now])
                entry[0][r.event_id] = [r.event_ms, r.article_id, r.read_duration_ms]
                entry[1] = now
                changed.add(m)
                touched.update((t, r.ip) for t in core.targets(r.event_ms, wm))
        alerts = []
        for bucket, ip in sorted(touched, key=lambda t: t[0]):
            entry = minute(bucket).get(ip)
            if not entry or not entry[0]:
                continue
            before = minute(bucket - core.bucket_ms).get(ip)
            current, old = core.answer(bucket, entry[0], before[0] if before else {}), entry[2]
            current, send = core.follow(Snapshot(**{**old, "article_ids": tuple(old["article_ids"])}) if old else None, current)
            entry[2:] = [asdict(current), now]
            changed.add(bucket)
            if send:
                alerts.append(self._alert(ip, bucket, current))
        for m in changed:
            self.minutes.updateValue((m,), (json.dumps([[ip, *e] for ip, e in minutes[m].items()]),))
        if changed and not known:
            self.handle.registerTimer(min(map(core.last_use, changed)))
        yield from alerts
        yield from late

    def _alert(self, ip, bucket: int, s: Snapshot) -> Row:
        if not s.alert:  # a retraction only keeps key and revision
            return _c_row(kind="alert", ip=ip, alert_minute_ms=bucket, retracted=True, revision=s.revision)
        return _c_row(
            kind="alert", ip=ip, alert_minute_ms=bucket, retracted=False, revision=s.revision, window_start_ms=s.end - self.core.bucket_ms, window_end_ms=s.end, article_count=len(s.article_ids), click_count=s.click_count,
            read_duration_sum_ms=float(s.duration_sum), avg_read_duration_ms=s.duration_sum / s.click_count, article_ids=[str(a) for a in s.article_ids])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        wm = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        kept = [k for (k,) in self.minutes.keys()]
        gone = [k for k in kept if self.core.last_use(k) <= wm]
        if len(gone) == len(kept):
            self.minutes.clear()
            return iter(())
        for k in gone:
            self.minutes.removeKey((k,))
        self.handle.registerTimer(min(self.core.last_use(k) for k in kept if self.core.last_use(k) > wm))
        return iter(())

    def close(self) -> None:
        pass


def _c_row(**values) -> Row:
    return Row(**{n: values.get(n) for n in C_OUT.names})
