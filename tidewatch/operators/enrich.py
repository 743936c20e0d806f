"""Enrichment of behaviours by articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalar import salt

ARTICLE_COLUMNS = ("title", "category", "tags", "published_at", "version")


def latest_articles(articles: DataFrame, sequence: str = "sequence") -> DataFrame:
    """The article state that batch enrichment uses: highest version, then latest event, then latest arrival."""
    rest = [c for c in articles.columns if c != "article_id"]
    best = F.max_by(F.struct(*rest), F.struct("version", "event_ms", sequence))
    return articles.groupBy("article_id").agg(best.alias("_r")).select("article_id", *[F.col(f"_r.{c}").alias(c) for c in rest])


def _right(articles: DataFrame) -> DataFrame:
    kept = [c for c in ARTICLE_COLUMNS if c in articles.columns]
    names = {"published_at": "article_published_at", "version": "article_version"}
    return articles.select("article_id", *[F.col(c).alias(names.get(c, c)) for c in kept])


def enrich(behaviors: DataFrame, articles: DataFrame) -> DataFrame:
    """Inner join on article_id; Catalyst broadcasts the articles only if their statistics are small, else AQE splits skew."""
    return behaviors.join(_right(articles), "article_id")


def unmatched(behaviors: DataFrame, articles: DataFrame) -> DataFrame:
    """Behaviours without an article, with the reason that the audit table carries."""
    return behaviors.join(articles.select("article_id"), "article_id", "left_anti").withColumn("dirty_reason", F.lit("ARTICLE_NOT_FOUND_REPLAY_REQUIRED"))


def enrich_salted(behaviors: DataFrame, articles: DataFrame, salts: int = 8) -> DataFrame:
    """The same result with a salted key, for plans in which AQE can't split a hot article (streams)."""
    if salts < 1:
        raise ValueError("salts must be at least 1")
    left = behaviors.withColumn("_salt", salt(F.col("event_id"), salts))
    right = _right(articles).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, ["article_id", "_salt"]).drop("_salt")
