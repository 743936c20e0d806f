"""First-wins deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in `order`. A hash aggregate with map-side combine, not a sort of all rows."""
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(row.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def ranked_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The same by row_number, for orders that need descending or nulls-last parts."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def dedup_stream(df: DataFrame, keys: list[str], keep_for: str = "24 hours") -> DataFrame:
    """First wins for `keep_for` after it arrived, by the engine's clock and not by event time, so late rows aren't lost.

    The arrival time is the batch's, which a replayed batch keeps. A query that needs an event-time watermark reads
    what this one wrote: a watermark on arrival would hold its own back.
    """
    d = df.withColumn("_arrival", F.current_timestamp()).withWatermark("_arrival", keep_for)
    return d.dropDuplicatesWithinWatermark(keys).drop("_arrival")
