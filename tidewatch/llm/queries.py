"""Registered queries of the training-data operators: each on its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import decontaminate, html_extract, langid, lz_fingerprint, minhash_dedup, mixing, pii, secrets, suffix_dedup, toxicity

#: key of the pseudonyms in the registered queries; a deployment passes its own secret
PII_KEY = "tidewatch-demo-key"


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark, d):
    return mixing.mix_sizes(table(spark, d))


OP1_SQL = r"""WITH d AS (SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
 w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w, source_size * 3 AS cap FROM s),
 l AS (SELECT *, (sum(source_size) OVER ()::BIGINT - COALESCE(sum(cap) OVER p, 0)::BIGINT)::DOUBLE / (sum(w) OVER ()::BIGINT - COALESCE(sum(w) OVER p, 0)::BIGINT)::DOUBLE AS level
   FROM w WINDOW p AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 t AS (SELECT source, source_size, CASE WHEN cap / w < level THEN cap::DOUBLE ELSE (SELECT level FROM l WHERE NOT cap / w < level ORDER BY cap / w, source NULLS LAST LIMIT 1) * w END AS target FROM l),
 r AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate, ('0x' || substr(md5('mix:' || COALESCE(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
 SELECT doc_id, size, source_size, target, size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS taken FROM r"""


def op2(spark, d):
    docs = table(spark, d)
    model = langid.fit(docs.filter(~langid.held_out()))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.withColumn("held_out", langid.held_out())


def op3(spark, d):
    return lz_fingerprint.compare_with_next(table(spark, d))


def op4(spark, d):
    return suffix_dedup.deduplicate(table(spark, d))


def op5(spark, d):
    return html_extract.extract_pages(table(spark, d, "pages"))


def op6(spark, d):
    docs = table(spark, d)
    model = toxicity.fit(docs, table(spark, d, "labels"))
    return toxicity.score(docs, model).withColumn("held_out", langid.held_out())


def op7(spark, d):
    return minhash_dedup.near_duplicates(table(spark, d))


OP7_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0)),
 n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 75 * (x.n + y.n - k)),
 r AS (SELECT a AS node, a AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
 c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY 1)
 SELECT d.doc_id, COALESCE(n.n, 0)::BIGINT AS n_shingles, COALESCE(c.component_id, d.doc_id) AS component_id, COALESCE(c.component_id, d.doc_id) = d.doc_id AS kept
 FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id"""


def op8(spark, d):
    return pii.pseudonymize(table(spark, d).select("doc_id", "text"), PII_KEY, count_col="n_replaced")


def op9(spark, d):
    return secrets.scan(table(spark, d))


def op10(spark, d):
    return decontaminate.contaminated(table(spark, d), table(spark, d, "benchmark"))


def queries() -> dict:
    return {
        "op1_mix_sources": op1, "op2_language_id": op2, "op3_lz_fingerprints": op3, "op4_suffix_dedup": op4, "op5_main_text": op5, "op6_toxicity": op6,
        "op7_minhash_near_dedup": op7, "op8_pii_pseudonyms": op8, "op9_secret_scan": op9, "op10_decontaminate": op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op7_minhash_near_dedup": OP7_SQL}



