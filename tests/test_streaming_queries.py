import pytest
from pyspark.sql import functions as F

from tests.oracle import compare
from tidewatch.plans import reference_queries
from tidewatch.plans import streaming_queries as q

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_matches_sql(spark, name):
    assert compare(q.QUERIES[name](spark, SF), q.ORACLES[name], SF) > 0


def test_join_takes_articles_of_any_id(spark, tmp_path):
    small = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{small}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long") + 150
    e.withColumn("props", F.concat(F.lit('{"k": '), k.cast("string"), F.lit("}"))).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.read.parquet(f"{small}/documents.parquet").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = reference_queries.QUERIES["enrich_join"](spark, str(tmp_path)).select(F.col("event_id").cast("string"), F.col("article_id").cast("string"), "title", "category")
    got = q.QUERIES["stream_join"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 0
