"""Sources and plain sinks: raw JSON lines, Kafka, and the mapping of the star-schema test tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.scalar import event_millis, not_blank

TOPIC_ARTICLE, TOPIC_BEHAVIOR = "topic_article", "topic_behavior"
TOPIC_PARTITIONS = {TOPIC_ARTICLE: 3, TOPIC_BEHAVIOR: 6}


def kafka_options(topic: str, starting: str = "earliest") -> dict[str, str]:
    """Options of a Kafka source; offsets live in the query's checkpoint, so `starting` only holds at its first start."""
    return {
        "kafka.bootstrap.servers": os.environ.get("KAFKA_BOOTSTRAP_SERVERS", "localhost:9092"),
        "subscribe": topic, "startingOffsets": starting, "failOnDataLoss": "true",
    }


def read_kafka(spark: SparkSession, topic: str, starting: str = "earliest") -> DataFrame:
    """Streaming frame with `value`; needs Spark's Kafka connector on the classpath."""
    return spark.readStream.format("kafka").options(**kafka_options(topic, starting)).load().select(F.col("value").cast("string").alias("value"))


def write_kafka(df: DataFrame, topic: str, key: str = "article_id"):
    return df.select(F.col(key).cast("string").alias("key"), F.col("value")).write.format("kafka").option("kafka.bootstrap.servers", kafka_options(topic)["kafka.bootstrap.servers"]).option("topic", topic)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw JSON lines without blank ones. `sequence` is (modification time, name, offset in the file): the order of arrival."""
    df = spark.read.text(path).filter(not_blank(F.col("value")))
    at = F.col("_metadata.file_modification_time"), F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    return df.select("value", F.struct(at[0].alias("t"), at[1].alias("f"), at[2].alias("b"), at[3].alias("i")).alias("sequence"))


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The same as a stream, a file per micro-batch by default, oldest first."""
    df = spark.readStream.option("maxFilesPerTrigger", str(files_per_trigger)).text(path)
    return df.filter(not_blank(F.col("value")))


def write_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def console(df: DataFrame, prefix: str) -> DataFrame:
    """Lines as the verification tools read them: PREFIX> {json}."""
    return df.select(F.concat(F.lit(prefix + "> "), F.to_json(F.struct(*df.columns))).alias("value"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def test_behaviors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behaviours from `events`: the article is props.k, the address is user_id and the read time is value."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.get_json_object("props", "$.k").cast("long").alias("article_id"), F.col("event_type").alias("action"),
        F.col("user_id").alias("ip"), event_millis(F.col("ts")).alias("event_ms"), F.col("value").alias("read_duration_ms"),
    )


def test_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles from `documents`: the source is the category and the language the title."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("article_id"), F.col("lang").alias("title"), F.col("source").alias("category"),
        F.lit(1).alias("version"), F.lit(0).cast("long").alias("event_ms"), F.col("doc_id").alias("sequence"),
    )
