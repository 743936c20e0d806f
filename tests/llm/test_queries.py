"""Registered queries against their SQL, and the pipeline against its stages' own decisions."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.oracle import compare
from tidewatch.llm import decontaminate, langid, minhash_dedup, queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    assert compare(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF) == 1000


def test_contract_columns(spark):
    want = {
        "op1": "doc_id size source_size target taken", "op2": "doc_id held_out lang_pred score", "op3": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
        "op4": "doc_id n_bytes n_removed n_spans kept_sha256", "op5": "page_id url text n_chars", "op6": "doc_id held_out score predicted", "op7": "doc_id n_shingles component_id kept",
        "op8": "doc_id text", "op9": "doc_id n_assign n_access n_hex base_sha256 spans", "op10": "doc_id item_id similarity",
    }
    for name, f in queries.queries().items():
        df = f(spark, "/root/testdata/sf0.001")
        assert set(want[name.split("_")[0]].split()) <= set(df.columns), name


def test_toxicity_held_out(spark):
    r = queries.op6(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out")
    x = r.agg(F.sum(((F.col("toxic") == 1) & (F.col("predicted") == 1)).cast("int")).alias("tp"), F.sum("toxic").alias("p"), F.sum("predicted").alias("pp")).first()
    assert x["tp"] > 0.85 * x["p"] and x["tp"] > 0.9 * x["pp"]


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, SF)
        assert (out.columns == docs.columns) == (name != "mixing")
        out = spark.createDataFrame(out.collect(), out.schema)
        assert 0 < out.count() and (name == "mixing" or out.count() <= kept.count())
        if name == "near_duplicates":
            assert minhash_dedup.near_duplicates(out).filter("not kept").count() == 0
        if name == "decontamination":
            assert decontaminate.contaminated(out, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
        if name == "privacy":
            assert out.filter(F.col("text").rlike(r"\+1 \(\d{3}\) 555-\d{4}")).count() < kept.filter(F.col("text").rlike(r"\+1 \(\d{3}\) 555-\d{4}")).count()
        kept = out
    assert kept.select("doc_id").distinct().count() <= docs.count() and langid.UND == "und"


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "privacy", "mixing"]
