"""The rules as they answer online: each event carries the watermark that was in force when it arrived.

A schedule has `sequence` (an event's place in the order of arrival) and `wm_before_ms`. Events without an entry, or
whose entry is null, arrived before any watermark and are never late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalar import MINUTE_MS, floor_to
from tidewatch.operators import rules
from tidewatch.operators.audit import ALLOWED_LATENESS_MS


def at_arrival(events: DataFrame, schedule: DataFrame) -> DataFrame:
    """`events` with `wm_before_ms`; every event stays."""
    return events.join(schedule.select("sequence", "wm_before_ms"), "sequence", "left")


def open_windows(size_ms: int, slide_ms: int, allowed_ms: int):
    """How many of an event's windows, the latest first, still take it: those with wm < end - 1 + allowed."""
    spare = floor_to(F.col("event_ms"), slide_ms) + (size_ms - 1 + allowed_ms) - F.col("wm_before_ms")
    n = F.ceil(spare / slide_ms).cast("int")
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(size_ms // slide_ms), n)), F.lit(size_ms // slide_ms))


def rule_a_online(arrived: DataFrame, size_ms: int = 5 * MINUTE_MS, slide_ms: int = MINUTE_MS, threshold: int = 1000, allowed_ms: int = ALLOWED_LATENESS_MS) -> DataFrame:
    """Rule A where a late click only counts in those of its windows that still exist.

    Clicks are counted per slide-long pane and number of open windows before they are multiplied.
    """
    if size_ms % slide_ms:
        raise ValueError("the size must be a multiple of the slide")
    clicks = arrived.filter(F.col("action") == "click").withColumn("_open", open_windows(size_ms, slide_ms, allowed_ms)).filter(F.col("_open") > 0)
    order = F.struct("article_version", "event_ms", "event_id", "title", "category")
    panes = clicks.groupBy("article_id", floor_to(F.col("event_ms"), slide_ms).alias("_pane"), "_open").agg(F.count(F.lit(1)).alias("_n"), F.max(order).alias("_last"))
    wide = panes.withColumn("window_start_ms", F.explode(F.slice(rules.windows_of(F.col("_pane"), size_ms, slide_ms), F.lit(1), F.col("_open"))))
    out = wide.groupBy("window_start_ms", "article_id").agg(F.sum("_n").alias("click_count"), F.max("_last").alias("_last")).filter(F.col("click_count") > threshold)
    return out.select(
        "window_start_ms", (F.col("window_start_ms") + size_ms).alias("window_end_ms"), "article_id",
        F.col("_last.title").alias("title"), F.col("_last.category").alias("category"), "click_count",
    )


def rule_b_online(arrived: DataFrame, size_ms: int = 10 * MINUTE_MS, top: int = 5, allowed_ms: int = ALLOWED_LATENESS_MS) -> DataFrame:
    """Rule B over the events whose window still exists."""
    return rules.rule_b(arrived.filter(open_windows(size_ms, size_ms, allowed_ms) > 0), size_ms, top)
