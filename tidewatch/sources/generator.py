"""Seeded generator of article and behaviour streams for tests and load runs."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass
from datetime import UTC, datetime, timedelta
from pathlib import Path


@dataclass
class Spec:
    """What to generate; ratios are shares of all behaviours."""

    articles: int = 50
    behaviors: int = 1000
    users: int = 100
    ips: int = 40
    seed: int = 11
    start: str = "2025-03-03T00:00:00+00:00"
    span_s: int = 3600
    duplicate_ratio: float = 0.04
    dirty_ratio: float = 0.01
    disorder_s: int = 20
    hot_articles: int = 2
    hot_share: float = 0.8
    click_share: float = 0.82
    share_share: float = 0.1
    updates: int = 0
    rule_c_positives: int = 1
    categories: tuple[str, ...] = ("science", "sport", "world", "tech", "culture", "health")
    late_articles_s: int = 0


def iso(t: datetime) -> str:
    return t.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S.") + f"{t.microsecond // 1000:03d}Z"


def article(i: int, at: datetime, category: str, version: int = 1) -> dict:
    a = f"article-{i:06d}"
    return {
        "event_id": f"{a}-v{version}", "event_type": "publish" if version == 1 else "update", "article_id": a, "title": f"Title {i} v{version}", "category": category,
        "tags": [category, "news"], "published_at": iso(at), "event_time": iso(at), "ingest_time": iso(at), "version": version,
    }


def behavior(event_id: str, article_id: str, at: datetime, action: str = "click", ip: str = "127.0.0.1", user: str = "user-1", ms: int = 1000) -> dict:
    return {"event_id": event_id, "user_id": user, "article_id": article_id, "action": action, "ip": ip, "event_time": iso(at), "ingest_time": iso(at + timedelta(seconds=1)), "read_duration_ms": ms}


def generate(spec: Spec) -> tuple[list[dict], list[dict], dict]:
    """Articles, behaviours in order of arrival, and a report of what was made."""
    rng, t0 = random.Random(spec.seed), datetime.fromisoformat(spec.start)
    arts = [article(i, t0, spec.categories[i % len(spec.categories)]) for i in range(1, spec.articles + 1)]
    for i in range(1, spec.updates + 1):
        arts.append(article(i, t0 + timedelta(seconds=spec.span_s // 2), spec.categories[i % len(spec.categories)], 2))
    made: list[tuple[datetime, dict]] = []
    report = {"spec": asdict(spec), "dirty": 0, "duplicates": 0, "clicks": 0, "hot_clicks": 0}
    for n in range(spec.behaviors):
        at = t0 + timedelta(milliseconds=rng.randrange(spec.span_s * 1000))
        hot = rng.random() < spec.hot_share
        a = rng.randint(1, spec.hot_articles) if hot else rng.randint(1, spec.articles)
        p = rng.random()
        action = "click" if p < spec.click_share else "share" if p < spec.click_share + spec.share_share else "comment"
        b = behavior(f"event-{n:08d}", f"article-{a:06d}", at, action, f"10.0.{rng.randrange(spec.ips)}.1", f"user-{rng.randrange(spec.users)}", rng.randrange(500, 60_000))
        if rng.random() < spec.dirty_ratio:
            report["dirty"] += 1
            b = {**b, **rng.choice([{"read_duration_ms": -1}, {"article_id": None}, {"event_time": iso(at + timedelta(days=3650))}]), "event_id": f"dirty-{n:08d}"}
        elif action == "click":
            report["clicks"] += 1
            report["hot_clicks"] += a <= spec.hot_articles
        made.append((at + timedelta(seconds=rng.uniform(0, spec.disorder_s)), b))
        if rng.random() < spec.duplicate_ratio:
            report["duplicates"] += 1
            made.append((at + timedelta(seconds=rng.uniform(spec.disorder_s, 2 * spec.disorder_s)), b))
    for k in range(spec.rule_c_positives):
        for i in range(51):
            at = t0 + timedelta(seconds=60 * (k + 1), milliseconds=i * 900)
            made.append((at, behavior(f"scan-{k}-{i:03d}", f"article-{i % max(51, spec.articles) + 1:06d}", at, ip=f"10.255.255.{k + 1}")))
    made.sort(key=lambda x: x[0])
    return arts, [b for _, b in made], report


def paced(records: Iterable, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Iterator:
    """`records` at `rate` a second, 0 for as fast as they go; waits about every hundredth of a second, not per record."""
    if rate <= 0:
        yield from records
        return
    begin, burst, n = clock(), max(1, round(rate / 100)), 0
    for n, r in enumerate(records, 1):
        yield r
        if n % burst == 0:
            sleep(max(0.0, begin + n / rate - clock()))
    sleep(max(0.0, begin + n / rate - clock()))


def write(records: Iterable[dict], path: str | Path, rate: float = 0) -> int:
    """JSON lines, flushed as they are paced; returns their number."""
    n = 0
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        for n, r in enumerate(paced(records, rate), 1):
            f.write(json.dumps(r, ensure_ascii=False) + "\n")
            if rate > 0:
                f.flush()
    return n


def send(producer, articles: list[dict], behaviors: list[dict], topics: tuple[str, str] = ("topic_article", "topic_behavior"), rate: float = 0) -> int:
    """Both streams in order of their ingest time through `producer` (send(topic, key=, value=) and flush()), keyed by article."""
    queue = sorted(((r["ingest_time"], topic, r) for topic, part in zip(topics, (articles, behaviors), strict=True) for r in part), key=lambda x: x[0])
    for _, topic, r in paced(queue, rate):
        key = r.get("article_id")
        producer.send(topic, key=key.encode() if key else None, value=json.dumps(r, ensure_ascii=False).encode())
    producer.flush()
    return len(queue)
