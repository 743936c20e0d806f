"""Merge rules of the keyed result tables.

Each table has a pure function (old row or None, new row) -> row or None (None: nothing is stored), and the
two rules whose outcome doesn't depend on arrival order also have a DataFrame form for file-based tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Row = dict
REJOINED = "BEHAVIOR_REJOINED"


def overwrite(old: Row | None, new: Row) -> Row:
    return dict(new)


def keep_first(old: Row | None, new: Row) -> Row:
    return dict(new) if old is None else old


def greatest_count(old: Row | None, new: Row) -> Row:
    """Alert counts never fall; the other columns follow the last write."""
    if old is None:
        return dict(new)
    return {**old, **new, "click_count": max(old["click_count"], new["click_count"])}


def by_revision(old: Row | None, new: Row) -> Row:
    """A lower revision changes nothing; an equal one replaces."""
    return dict(new) if old is None or new["revision"] >= old["revision"] else old


def sticky_matched(old: Row | None, new: Row) -> Row:
    """Once matched, reason and payload are frozen."""
    if old is None:
        return dict(new)
    kept = {k: old[k] for k in ("reason", "payload") if k in old} if old["matched"] else {k: new[k] for k in ("reason", "payload") if k in new}
    return {**old, **kept, "matched": bool(old["matched"] or new["matched"])}


def mark_matched(old: Row | None, event_id: str) -> Row | None:
    """The second writer: only updates rows that exist."""
    return None if old is None else {**old, "matched": True, "reason": REJOINED}


def newer_snapshot(old: Row | None, new: Row) -> Row | None:
    """Compare-and-set of the latest ranking; None: refused, so its time to live isn't refreshed either."""
    if old is not None:
        if new["window_start_ms"] < old["window_start_ms"]:
            return None
        if new["window_start_ms"] == old["window_start_ms"] and new["revision"] < old["revision"]:
            return None
    return dict(new)


@dataclass(frozen=True)
class Table:
    """A result table: its key, its columns with SQL types, and the merge rule."""

    name: str
    keys: tuple[str, ...]
    columns: tuple[tuple[str, str], ...]
    merge: Callable[[Row | None, Row], Row | None]


def _cols(text: str) -> tuple[tuple[str, str], ...]:
    return tuple((a, b) for a, b in (x.split(":") for x in text.split()))


TABLES = {t.name: t for t in (
    Table("clean_behavior", ("event_id",), _cols("event_id:text user_id:text article_id:text action:text ip:text event_time:text read_duration_ms:integer title:text category:text tags:text"), overwrite),
    Table("article_alert", ("window_start_ms", "article_id"), _cols("window_start_ms:integer article_id:text window_end_ms:integer title:text category:text click_count:integer detect_time:text"), greatest_count),
    Table("category_rank", ("window_start_ms", "rank_no"), _cols("window_start_ms:integer rank_no:integer window_end_ms:integer category:text score:integer revision:integer top_articles:text detect_time:text"), by_revision),
    Table("ip_alert", ("alert_minute_ms", "ip"), _cols("alert_minute_ms:integer ip:text retracted:integer revision:integer window_start_ms:integer window_end_ms:integer article_count:integer click_count:integer avg_read_duration_ms:real read_duration_sum_ms:integer article_ids:text detect_time:text"), by_revision),
    Table("pipeline_event", ("event_type", "event_id"), _cols("event_type:text event_id:text article_id:text dirty_reason:text payload:text"), overwrite),
    Table("dirty_data", ("source_stream", "record_id"), _cols("source_stream:text record_id:text reason:text raw_data:text created_at:text"), keep_first),
    Table("late_data", ("source_stream", "event_id"), _cols("source_stream:text event_id:text article_id:text event_time:text watermark_ms:integer reason:text payload:text created_at:text"), keep_first),
    Table("unmatched_behavior", ("event_id",), _cols("event_id:text article_id:text event_time:text matched:integer reason:text payload:text created_at:text updated_at:text"), sticky_matched),
    # declared in the schema without a producer
    Table("article_heat_state", ("article_id",), _cols("article_id:text window_start_ms:integer window_end_ms:integer click_count:integer updated_at:text"), overwrite),
    Table("ip_window_state", ("ip", "window_start_ms"), _cols("ip:text window_start_ms:integer window_end_ms:integer article_count:integer click_count:integer updated_at:text"), overwrite),
    # scores of touched windows: the ranking needs all of a window, an update batch only brings changed groups
    Table("article_score", ("window_start_ms", "category", "article_id"), _cols("window_start_ms:integer category:text article_id:text title:text score:integer"), overwrite),
)}


def merge_greatest(current: DataFrame, updates: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Greatest value per key; other columns from the last write by `order`."""
    both = current.unionByName(updates)
    rest = [c for c in both.columns if c not in (*keys, value)]
    return both.groupBy(*keys).agg(F.max(value).alias(value), F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, value, *[F.col(f"_r.{c}").alias(c) for c in rest])


def merge_revision(current: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the highest revision per key; of equal revisions the last by `order`."""
    both = current.unionByName(updates)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("revision", order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
