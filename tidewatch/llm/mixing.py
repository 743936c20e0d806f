"""Mixing sources to target weights, with DataFrame functions only.

Words per source are aggregated, shares follow the sources' weights, and a source's target is held to `most`
times its size, its excess going to the others by weight. A document is then taken floor(rate) times, and once
more if a hash of its id falls below the rest of the rate, so reruns agree and rows need no coordination.

Defined results: a null text has no words; an empty table gives an empty result; a null source is a source of
its own, the last in order; a source without words gets target 0 and no copies; repeated rows with one id are
decided alike; a null id counts as an empty one; other columns pass through `mix` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import checkpoint_root

WORD = r"[^\x20\x09-\x0D]+"
#: sources up to which the table of targets (a few dozen bytes each) is broadcast; beyond, it is joined by key
BROADCAST_SOURCES = 50_000
MOST = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(key: Column, seed: str) -> Column:
    """A number in [0, 1) with 52 bits, from the seed and the key."""
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """(source, source_size) -> with target. Weights go round over the sources by code point, null last.

    In order of cap / weight the capped sources are a prefix: a source is capped if its cap lies below what the
    level, with all before it capped, would give it. The level of the first uncapped source holds for the rest.
    The windows have one row per source, not per document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    t = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    none = F.lit(0).cast("long")
    t = t.withColumn("_left", F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), none)).withColumn("_lw", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), none))
    t = t.withColumn("_level", F.col("_left") / F.col("_lw")).withColumn("_capped", F.col("_cap") / F.col("_w") < F.col("_level"))
    free = F.when(~F.col("_capped"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level").alias("level")))
    first = F.min(free).over(every)["level"]
    return t.select("source", "source_size", F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(first * F.col("_w")).alias("target"))


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("null"))


def copies(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, size, source_size, target, copies, and the columns named in `keep`."""
    spark = docs.sparkSession
    checkpoint_root(spark)
    # partial sums per task come first, so a hot source is a row per task in the shuffle
    sized = docs.select(F.col(source_col).alias("source"), words(F.col(text_col)).alias("_n")).groupBy("source").agg(F.sum("_n").alias("source_size"))
    targets = source_targets(sized, weights, most).select(_key("source").alias("_key"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target")).checkpoint()
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    d = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_kept") if keep else F.lit(None).cast("string").alias("_kept"), F.col(id_col).alias("_id"), words(F.col(text_col)).alias("_size"), _key(source_col).alias("_key"))
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    n = F.floor(rate) + F.when(unit_hash(F.col("_id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    return d.join(targets, "_key").withColumn("_copies", n)


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target (its source's) and taken: the words that the mix takes, repeats counted."""
    return copies(docs, **options).select(
        F.col("_id").alias(options.get("id_col", "doc_id")), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every column of each document as often as it is taken, with copy from 1.

    A column of the input that is called copy becomes copy_before (with as many _ as make the name new).
    """
    names, before = docs.columns, "copy_before"
    if "copy" in names:
        while before in names:
            before += "_"
        docs = docs.withColumnRenamed("copy", before)
    taken = copies(docs, keep=tuple(docs.columns), **options).filter(F.col("_copies") > 0)
    return taken.select("_kept", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_c")).select("_kept.*", F.col("_c").alias("copy"))
