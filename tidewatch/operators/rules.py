"""The three rules over enriched behaviours, as batch DataFrame operators.

Input columns: event_id, article_id, action, ip, event_ms (long), read_duration_ms, title, category,
article_version. Times in results are epoch milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.scalar import MINUTE_MS, floor_to


def windows_of(ms: Column, size_ms: int, slide_ms: int) -> Column:
    """Starts of all windows [start, start + size) that hold ms, aligned with the epoch."""
    last = floor_to(ms, slide_ms)
    n = size_ms // slide_ms
    return F.array(*[last - F.lit(i * slide_ms).cast("long") for i in range(n)])


def _latest(*cols: str) -> Column:
    return F.max_by(F.struct(*cols), F.struct("article_version", "event_ms", "event_id"))


def rule_a_counts(enriched: DataFrame, size_ms: int = 5 * MINUTE_MS, slide_ms: int = MINUTE_MS, min_exclusive: int | None = None) -> DataFrame:
    """Clicks per article and sliding window, title and category from the latest version seen in the window.

    Clicks are first combined per slide-long pane, so that only pane sums, not events, are multiplied by the
    windows they belong to, and a hot article is reduced before the shuffle.
    """
    if size_ms % slide_ms:
        raise ValueError("the size must be a multiple of the slide")
    clicks = enriched.filter(F.col("action") == "click")
    order = F.struct("article_version", "event_ms", "event_id", "title", "category")
    panes = clicks.groupBy("article_id", floor_to(F.col("event_ms"), slide_ms).alias("_pane")).agg(F.count(F.lit(1)).alias("_n"), F.max(order).alias("_last"))
    wide = panes.withColumn("window_start_ms", F.explode(windows_of(F.col("_pane"), size_ms, slide_ms)))
    out = wide.groupBy("window_start_ms", "article_id").agg(F.sum("_n").alias("click_count"), F.max("_last").alias("_last"))
    if min_exclusive is not None:
        out = out.filter(F.col("click_count") > min_exclusive)
    return out.select(
        "window_start_ms", (F.col("window_start_ms") + size_ms).alias("window_end_ms"), "article_id",
        F.col("_last.title").alias("title"), F.col("_last.category").alias("category"), "click_count",
    )


def rule_a(enriched: DataFrame, size_ms: int = 5 * MINUTE_MS, slide_ms: int = MINUTE_MS, threshold: int = 1000) -> DataFrame:
    """Hot articles: windows with more than `threshold` clicks."""
    return rule_a_counts(enriched, size_ms, slide_ms, threshold)


def rule_b_scores(enriched: DataFrame, size_ms: int = 10 * MINUTE_MS) -> DataFrame:
    """Events of any action per tumbling window, category and article."""
    return (
        enriched.groupBy(floor_to(F.col("event_ms"), size_ms).alias("window_start_ms"), "category", "article_id")
        .agg(F.count(F.lit(1)).alias("score"), _latest("title").alias("_t"))
        .select("window_start_ms", "category", "article_id", F.col("_t.title").alias("title"), "score")
    )


def rule_b_from_scores(scores: DataFrame, size_ms: int = 10 * MINUTE_MS, top: int = 5) -> DataFrame:
    """Category ranking with each category's top articles, from article scores (also used by the streaming form).

    Windows rank categories (few per window) after a two-phase sum; ranking articles is partitioned by
    window and category, so no task sees a whole window's articles of all categories.
    """
    totals = scores.groupBy("window_start_ms", "category").agg(F.sum("score").alias("score"))
    by_window = Window.partitionBy("window_start_ms")
    ranked = (
        totals.withColumn("revision", F.sum("score").over(by_window))
        .withColumn("rank_no", F.row_number().over(by_window.orderBy(F.desc("score"), F.asc("category"))))
        .filter(F.col("rank_no") <= top)
    )
    in_category = Window.partitionBy("window_start_ms", "category").orderBy(F.desc("score"), F.asc("article_id"))
    best = (
        scores.withColumn("_rn", F.row_number().over(in_category)).filter(F.col("_rn") <= top)
        .groupBy("window_start_ms", "category")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("_rn").alias("rank_no"), "article_id", "title", "score"))).alias("top_articles"))
    )
    return ranked.join(best, ["window_start_ms", "category"]).select(
        "window_start_ms", "rank_no", (F.col("window_start_ms") + size_ms).alias("window_end_ms"), "category", "score", "revision", "top_articles",
    )


def rule_b(enriched: DataFrame, size_ms: int = 10 * MINUTE_MS, top: int = 5) -> DataFrame:
    """Top categories per tumbling window, each with its top articles; revision counts the window's events."""
    return rule_b_from_scores(rule_b_scores(enriched, size_ms), size_ms, top)


def latest_snapshot(ranking: DataFrame) -> DataFrame:
    """One row: the newest window's ranking, as the key-value sink holds it."""
    item = F.struct("rank_no", "category", "score", "top_articles")
    per_window = ranking.groupBy("window_start_ms").agg(F.max("window_end_ms").alias("window_end_ms"), F.max("revision").alias("revision"), F.array_sort(F.collect_list(item)).alias("ranking"))
    return per_window.agg(F.max_by(F.struct("window_start_ms", "window_end_ms", "revision", "ranking"), F.struct("window_start_ms", "revision")).alias("_r")).filter("_r is not null").select("_r.*")


def _exact_sum(df: DataFrame, name: str, w: WindowSpec) -> Column:
    """Sum over a window that depends on no order of the rows.

    Fractions are added as decimals, as they are printed, and rounded once; what isn't finite or is 1e9 or more is
    added as it is. A sum of binary fractions would fall below a threshold, or not, by the order of its rows.
    """
    if not isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.sum(name).over(w)
    v = F.col(name).cast("double")
    plain = F.abs(v) < 1e9
    fine = F.sum(F.when(plain, v).cast("decimal(38,18)")).over(w).cast("double")
    rest = F.sum(F.when(~plain, v)).over(w)
    return F.coalesce(fine + rest, fine, rest)


def rule_c_lookback(enriched: DataFrame, look_back_ms: int = MINUTE_MS) -> DataFrame:
    """Each click with what its address read in (t - look_back, t], clicks of the same millisecond included.

    A range frame instead of a band self-join: one shuffle by address and one sort. Articles of the frame are
    gathered as a set, bounded by the clicks that one address makes in a look-back.
    """
    w = Window.partitionBy("ip").orderBy("event_ms").rangeBetween(-(look_back_ms - 1), 0)
    return enriched.filter(F.col("action") == "click").select(
        "ip", "event_id", "event_ms",
        F.collect_set("article_id").over(w).alias("_ids"), F.count(F.lit(1)).over(w).alias("click_count"), _exact_sum(enriched, "read_duration_ms", w).alias("read_duration_sum_ms"),
    ).select("ip", "event_id", "event_ms", F.size("_ids").cast("long").alias("article_count"), "click_count", "read_duration_sum_ms", F.col("_ids").alias("article_ids"))


def rule_c_candidates(enriched: DataFrame, look_back_ms: int = MINUTE_MS, min_articles: int = 50, max_avg_ms: float = 2000) -> DataFrame:
    """Clicks whose look-back has more than min_articles articles and a mean read below max_avg_ms."""
    return rule_c_lookback(enriched, look_back_ms).filter(
        (F.col("article_count") > min_articles) & (F.col("read_duration_sum_ms") < F.lit(max_avg_ms) * F.col("click_count"))
    )


def rule_c(enriched: DataFrame, look_back_ms: int = MINUTE_MS, bucket_ms: int = MINUTE_MS, min_articles: int = 50, max_avg_ms: float = 2000) -> DataFrame:
    """The earliest candidate of each address and bucket (the event's minute)."""
    hits = rule_c_candidates(enriched, look_back_ms, min_articles, max_avg_ms).withColumn("alert_minute_ms", floor_to(F.col("event_ms"), bucket_ms))
    # the look-back is already dealt by ip, so this window needs no further exchange
    w = Window.partitionBy("ip", "alert_minute_ms").orderBy("event_ms", "event_id")
    return hits.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(
        "alert_minute_ms", "ip", (F.col("event_ms") - look_back_ms).alias("window_start_ms"), F.col("event_ms").alias("window_end_ms"),
        "article_count", "click_count", "read_duration_sum_ms", (F.col("read_duration_sum_ms") / F.col("click_count")).alias("avg_read_duration_ms"),
        F.sort_array("article_ids").alias("article_ids"),
    )
