"""Logic of the two stateful operators, free of Spark so that exact boundaries can be tested."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np

MINUTE_MS = 60_000
LATENESS_MS = 65 * MINUTE_MS
PENDING_MS = 2 * 3_600_000

# Reasons that the audit tables carry.
NOT_YET_FOUND = "ARTICLE_NOT_YET_FOUND"
REPLAY_REQUIRED = "ARTICLE_NOT_FOUND_REPLAY_REQUIRED"
REJOINED = "BEHAVIOR_REJOINED"
BEYOND_LATENESS = "BEYOND_JOIN_ALLOWED_LATENESS"
LOOKBACK_EXPIRED = "ROLE_C_LOOKBACK_EXPIRED"
RANK_EXPIRED = "RANK_STATE_EXPIRED"


@dataclass
class JoinState:
    article: dict | None = None
    article_written_ms: int = 0
    pending: dict[str, dict] = field(default_factory=dict)
    deadline_ms: int | None = None


@dataclass(frozen=True)
class Out:
    """kind: joined, late or unmatched."""

    kind: str
    record: dict
    reason: str | None = None
    matched: bool = False
    watermark_ms: int | None = None
    stream: str | None = None


class JoinCore:
    """Either side may arrive first; behaviours wait for their article until a deadline, then are left for replay."""

    def __init__(self, retention_ms: int = PENDING_MS, lateness_ms: int = LATENESS_MS):
        self.retention_ms, self.lateness_ms = retention_ms, lateness_ms

    def _late(self, r: dict, wm: int, stream: str) -> list[Out]:
        if wm > 0 and r["event_ms"] < wm - self.lateness_ms:
            return [Out("late", r, BEYOND_LATENESS, watermark_ms=wm, stream=stream)]
        return []

    def _joined(self, b: dict, a: dict) -> Out:
        return Out("joined", {**b, "title": a["title"], "category": a["category"], "tags": a.get("tags"), "article_published_at": a.get("published_at"), "article_version": a["version"]})

    def _expire(self, s: JoinState, now: int) -> None:
        if s.article is not None and now >= s.article_written_ms + self.retention_ms:
            s.article = None

    def behavior(self, s: JoinState, b: dict, now: int, wm: int) -> list[Out]:
        out = self._late(b, wm, "behavior")
        self._expire(s, now)
        if s.article is not None:
            return [*out, self._joined(b, s.article)]
        if b["event_id"] not in s.pending:
            s.pending[b["event_id"]] = b
            out.append(Out("unmatched", b, NOT_YET_FOUND))
            if s.deadline_ms is None:
                s.deadline_ms = now + self.retention_ms
        return out

    def article(self, s: JoinState, a: dict, now: int, wm: int, report: bool = True) -> list[Out]:
        """report: false for all but one of a salted article's copies."""
        out = self._late(a, wm, "article") if report else []
        self._expire(s, now)
        if s.article is None or a["version"] >= s.article["version"]:
            s.article, s.article_written_ms = a, now
        for b in s.pending.values():
            out += [self._joined(b, s.article), Out("unmatched", b, REJOINED, matched=True)]
        s.pending, s.deadline_ms = {}, None
        return out

    def deadline(self, s: JoinState, fired_ms: int) -> list[Out]:
        if s.deadline_ms is None or fired_ms < s.deadline_ms:
            return []
        out = [Out("unmatched", b, REPLAY_REQUIRED) for b in s.pending.values()]
        s.pending, s.deadline_ms = {}, None
        return out


@dataclass(frozen=True)
class Snapshot:
    """What one address had read at the end of a bucket's look-back."""

    end: int
    click_count: int
    duration_sum: int | float
    article_ids: tuple
    alert: bool
    revision: int = 0


def _total(durations: list) -> int | float:
    """Sum that depends on no order: of whole numbers, or of fractions rounded once."""
    return sum(durations) if all(isinstance(d, int) for d in durations) else math.fsum(durations)


class RuleCCore:
    """Look-back per address with revisions and retractions.

    A minute's clicks are a dict event_id -> (event_ms, article, duration). A bucket is one minute; its answer depends
    on its own clicks and on those of the minute before.
    """

    def __init__(self, look_back_ms: int = MINUTE_MS, min_articles: int = 50, max_avg_ms: int = 2000, lateness_ms: int = LATENESS_MS):
        self.bucket_ms, self.min_articles, self.max_avg_ms, self.lateness_ms = look_back_ms, min_articles, max_avg_ms, lateness_ms

    def bucket(self, ms: int) -> int:
        return ms // self.bucket_ms * self.bucket_ms

    def cleanup_at(self, bucket: int) -> int:
        return bucket + self.bucket_ms + self.lateness_ms

    def lateness(self, event_ms: int, wm: int) -> str:
        m = self.bucket(event_ms)
        if wm >= m + 2 * self.bucket_ms + self.lateness_ms:
            return "dropped"
        return "partial" if wm >= self.cleanup_at(m) else "on_time"

    def targets(self, event_ms: int, wm: int) -> list[int]:
        """Buckets that a click changes and that haven't been cleaned up."""
        m = self.bucket(event_ms)
        return [t for t in (m, m + self.bucket_ms) if wm < self.cleanup_at(t)]

    def answer(self, bucket: int, own: dict, before: dict) -> Snapshot | None:
        """The state at the bucket's first click whose look-back raises the alert, else at its last; None without a click in it.

        Few articles raise no alert, so only the last look-back is gathered. Otherwise columns are sorted once. Counts and
        sums of every look-back are differences of positions and of running totals; only where these leave an alert
        possible, but for rounding, are distinct articles counted (those whose previous click, of the same article, lies
        before the look-back) and reads added exactly.
        """
        if not own:
            return None
        if len({c[1] for part in (before, own) for c in part.values()}) <= self.min_articles:
            end = max(c[0] for c in own.values())
            seen = [c for part in (before, own) for c in part.values() if end - self.bucket_ms < c[0] <= end]
            return Snapshot(end, len(seen), _total([c[2] for c in seen]), tuple(sorted({c[1] for c in seen})), False)
        ms, article, duration = (np.array(c) for c in zip(*sorted([*before.values(), *own.values()], key=lambda c: c[0]), strict=True))
        running = np.concatenate(([0], np.cumsum(duration)))
        _, name = np.unique(article, return_inverse=True)
        by_name = np.argsort(name, kind="stable")
        previous = np.full(len(ms), -1)
        repeat = name[by_name[1:]] == name[by_name[:-1]]
        previous[by_name[1:][repeat]] = by_name[:-1][repeat]
        ends = np.unique(ms[ms >= bucket])
        low, high = np.searchsorted(ms, ends - self.bucket_ms, "right"), np.searchsorted(ms, ends, "right")
        slack = 0 if duration.dtype.kind == "i" else 4 * len(ms) * np.finfo(float).eps * np.abs(duration).sum()
        hot = (high - low > self.min_articles) & (running[high] - running[low] < self.max_avg_ms * (high - low) + slack)
        raises = lambda a, b: np.count_nonzero(previous[a:b] < a) > self.min_articles and (not slack or _total(duration[a:b].tolist()) < self.max_avg_ms * (b - a))
        first = next((k for k in np.flatnonzero(hot).tolist() if raises(low[k], high[k])), None)
        k = len(ends) - 1 if first is None else first
        within = slice(low[k], high[k])
        return Snapshot(int(ends[k]), int(high[k] - low[k]), _total(duration[within].tolist()), tuple(np.unique(article[within]).tolist()), first is not None)

    @staticmethod
    def follow(previous: Snapshot | None, current: Snapshot) -> tuple[Snapshot, bool]:
        """`current` with its revision, and whether it is sent on: a new or changed alert, or the end of one."""
        revision = previous.revision if previous else 0
        current = replace(current, revision=revision)
        send = current != previous and (current.alert or previous is not None and previous.alert)
        return (replace(current, revision=revision + 1) if send else current), send

    def last_use(self, minute: int) -> int:
        """The watermark from which no bucket needs the minute's clicks."""
        return self.cleanup_at(minute + self.bucket_ms)
