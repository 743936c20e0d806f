"""Lateness, audit rows, comparison of result tables, roll-ups and latency quantiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalar import MINUTE_MS, floor_to

ALLOWED_LATENESS_MS = 65 * MINUTE_MS


def is_late_join(event_ms: Column, wm: Column, allowed_ms: int = ALLOWED_LATENESS_MS) -> Column:
    """The join only reports such rows; a watermark of 0 or null means that there is none yet."""
    return F.coalesce((wm > 0) & (event_ms < wm - allowed_ms), F.lit(False))


def is_late_window(event_ms: Column, wm: Column, size_ms: int, slide_ms: int, allowed_ms: int = ALLOWED_LATENESS_MS) -> Column:
    """True if every window of the event has been cleaned up: the last one's end - 1 + lateness isn't above wm."""
    last_end = floor_to(event_ms, slide_ms) + size_ms
    return F.coalesce(last_end - 1 + allowed_ms <= wm, F.lit(False))


def is_late_a(event_ms: Column, wm: Column) -> Column:
    return is_late_window(event_ms, wm, 5 * MINUTE_MS, MINUTE_MS)


def is_late_b(event_ms: Column, wm: Column) -> Column:
    return is_late_window(event_ms, wm, 10 * MINUTE_MS, 10 * MINUTE_MS)


def c_lateness(event_ms: Column, wm: Column, bucket_ms: int = MINUTE_MS, allowed_ms: int = ALLOWED_LATENESS_MS) -> Column:
    """'dropped', 'partial' (its own minute has expired, the next hasn't) or 'on_time'."""
    minute = floor_to(event_ms, bucket_ms)
    return F.when(wm >= minute + 2 * bucket_ms + allowed_ms, "dropped").when(wm >= minute + bucket_ms + allowed_ms, "partial").otherwise("on_time")


def audit_rows(df: DataFrame, kind: str) -> DataFrame:
    """Rows of the event log: the reason falls back to the kind; the payload is the whole row as JSON."""
    reason = F.coalesce(F.nullif(F.col("dirty_reason"), F.lit("")), F.lit(kind)) if "dirty_reason" in df.columns else F.lit(kind)
    return df.select(F.lit(kind).alias("event_type"), "event_id", "article_id", reason.alias("dirty_reason"), F.to_json(F.struct(*df.columns)).alias("payload"))


def late_scores(scores: DataFrame, kind: str = "ROLE_B_LATE", reason: str = "RANK_STATE_EXPIRED") -> DataFrame:
    """Audit rows of article scores whose window's ranking has been cleaned up; the id is article-window."""
    event_id = F.concat_ws("-", F.col("article_id").cast("string"), F.col("window_start_ms").cast("string"))
    rows = scores.select(F.lit(kind).alias("exception_type"), event_id.alias("event_id"), "article_id", "category", "window_start_ms", "score", F.lit(reason).alias("dirty_reason"))
    return audit_rows(rows, kind)


def status_rollup(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def p95(df: DataFrame, value: str) -> DataFrame:
    """Nearest-rank 95th percentile, exact."""
    return df.agg(F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"), F.count(value).alias("n"))


def diff(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed comparison: rows that are missing, extra or differ, with the fields that do."""
    fields = [c for c in expected.columns if c not in keys]
    e = expected.select(*keys, F.struct(*fields).alias("_e"), F.lit(1).alias("_in_e"))
    a = actual.select(*keys, F.struct(*fields).alias("_a"), F.lit(1).alias("_in_a"))
    j = e.join(a, keys, "full_outer")
    wrong = F.concat_ws(",", *[F.when(~F.col(f"_e.{c}").eqNullSafe(F.col(f"_a.{c}")), F.lit(c)) for c in fields])
    status = F.when(F.col("_in_a").isNull(), "missing").when(F.col("_in_e").isNull(), "extra").when(wrong != "", "different").otherwise("same")
    return j.select(*keys, status.alias("status"), F.when(status == "different", wrong).alias("fields")).filter(F.col("status") != "same")


def multiset_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lines of one side only, with repeats."""
    return reduce(DataFrame.unionByName, [a.exceptAll(b).withColumn("side", F.lit("left")), b.exceptAll(a).withColumn("side", F.lit("right"))])
