"""Tables kept in the shared folder, and connected components.

No join here forces a broadcast: a stored table's size is known to Catalyst, which broadcasts it below its threshold.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import suppress

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import checkpoint_root

#: links that one task takes from a single node
HUB = 500


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation.

    `drop` deletes them; what a lazy result still reads is deleted when the process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.count = spark, 0
        self.root = f"{checkpoint_root(spark)}/scratch-{uuid.uuid4().hex}"
        atexit.register(self._last)

    def store(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        atexit.unregister(self._last)

    def _last(self) -> None:
        with suppress(Exception):  # the session may be gone by then
            self.drop()


#: links up to which one task joins them (16 bytes each)
SMALL = 200_000
COMPONENTS = T.StructType([T.StructField("node", T.LongType()), T.StructField("component", T.LongType())])


def _join_up(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of all links of one task, by merging the lesser root."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while up.setdefault(top, top) != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for p in parts:
        for a, b in zip(p["a"].tolist(), p["b"].tolist(), strict=True):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pd.DataFrame({"node": nodes, "component": [root(x) for x in nodes]}).astype("int64")


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(a, b) links, stored -> (node, component): the least node reachable. Up to SMALL links, counted first, go to one task."""
    if edges.limit(SMALL + 1).count() <= SMALL:
        return scratch.store(edges.select("a", "b").coalesce(1).mapInPandas(_join_up, COMPONENTS))
    return spread_components(edges, scratch, most_rounds)


def spread_components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """The same for any number of links.

    Labels fall to the least label among neighbours, then to the label of that label, so long chains halve with
    each round. Every round is stored; Catalyst broadcasts a round's table while its files are small. Beyond that,
    links to a hub (a node of more than HUB links) are dealt over several tasks by a salt, with its label repeated
    for each, and the joins by component are plain exchanges, which adaptive execution splits.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = scratch.store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component"), F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("salts")))
    hubs = labels.filter("salts > 1").select(F.col("node").alias("b"), "salts")
    both = both.join(hubs, "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.col("salts")), F.lit(0)).cast("int").alias("salt"))
    for _ in range(most_rounds):
        dealt = labels.select(F.col("node").alias("b"), "component", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        near = both.join(dealt, ["b", "salt"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        step = labels.join(near, "node").select("node", "salts", "component", F.least("component", "_near").alias("_new"))
        # what the old label now points to: the least new label that any of its followers has seen
        root = step.groupBy(F.col("component").alias("_old")).agg(F.min("_new").alias("_root"))
        up = labels.select(F.col("node").alias("_new"), F.col("component").alias("_up"))
        jump = step.join(root, F.col("component") == F.col("_old")).select("node", "salts", F.col("component").alias("_was"), F.least("_new", "_root").alias("_new"))
        jump = scratch.store(jump.join(up, "_new", "left").select("node", "salts", "_was", F.least("_new", F.coalesce("_up", "_new")).alias("component")))
        labels = jump.select("node", "salts", "component")
        if jump.filter("_was <> component").isEmpty():
            return labels.select("node", "component")
    raise RuntimeError("components didn't settle")
