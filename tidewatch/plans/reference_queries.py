"""Registered queries of the reference's operators over the test tables, and their DuckDB equivalents.

Parameters are scaled to the test data (30 days of events, 100 articles); the operators' defaults are the
production ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import validation
from tidewatch.functions.scalar import event_millis, floor_to, millis_iso, salt, uuid3
from tidewatch.operators import audit, dedup, enrich, rules, schedule
from tidewatch.sinks import merge
from tidewatch.sources import readers

DAY = 86_400_000
VALID = ("click", "view", "purchase")
A = {"size_ms": 5 * DAY, "slide_ms": DAY}
#: steps of the made-up schedule, and the lateness that queries over it allow
ONLINE_STEP, ONLINE_LATE = DAY, 2 * DAY
C = {"look_back_ms": 5 * DAY, "min_articles": 2, "max_avg_ms": 60}
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

BEHAVIORS = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS article_id, event_type AS action, user_id AS ip, (epoch_us(ts) // 1000) AS event_ms, value AS read_duration_ms FROM events"
CLEAN = f"{BEHAVIORS} WHERE event_type IN ('click', 'view', 'purchase')"
ENRICHED = f"SELECT b.*, d.lang AS title, d.source AS category, 1 AS article_version FROM ({CLEAN}) b JOIN documents d ON d.doc_id = b.article_id"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


def clean(spark, d) -> DataFrame:
    return readers.test_behaviors(spark, d).filter(F.col("action").isin(*VALID))


def enriched(spark, d) -> DataFrame:
    return enrich.enrich(clean(spark, d), readers.test_articles(spark, d))


@query("etl_clean", f"SELECT event_id, article_id, action, ip, event_ms, read_duration_ms FROM ({CLEAN})")
def etl_clean(spark, d):
    return clean(spark, d).select("event_id", "article_id", "action", "ip", "event_ms", "read_duration_ms")


@query("etl_dirty_reasons", f"SELECT action AS reason, COUNT(*) AS n FROM ({BEHAVIORS}) WHERE action NOT IN ('click', 'view', 'purchase') GROUP BY 1")
def etl_dirty_reasons(spark, d):
    bad = readers.test_behaviors(spark, d).filter(~F.col("action").isin(*VALID))
    return audit.status_rollup(bad.withColumnRenamed("action", "reason"), "reason")


RAW = """SELECT event_id, CASE event_id % 13 WHEN 0 THEN concat(j, '{}') WHEN 1 THEN concat(j, ' garbage }') WHEN 2 THEN replace(j, '"ip":"', '"xx":"') WHEN 3 THEN replace(j, '"user_id":"', '"user_id":"  ","was":"')
 WHEN 4 THEN replace(j, 'T00:00:00Z', 'T03:00:00.001Z') WHEN 5 THEN replace(j, '"read_duration_ms":', '"read_duration_ms":-') WHEN 6 THEN replace(j, '"read_duration_ms":', '"read_duration_ms":1.') WHEN 7 THEN replace(j, '"article_id":"', '"article_id":7,"was":"')
 WHEN 8 THEN concat('[', j, ']') WHEN 9 THEN substr(j, 1, length(j) - 1) ELSE j END AS value
 FROM (SELECT event_id, concat('{"event_id":"e', CAST(event_id AS STRING), '","article_id":"a', CAST(user_id % 50 AS STRING), '","event_time":"', CAST(CAST(ts AS DATE) AS STRING), 'T00:00:00Z","ingest_time":"', CAST(CAST(ts AS DATE) AS STRING), 'T01:00:00Z","user_id":"u', CAST(user_id AS STRING),
 '","action":"', CASE event_type WHEN 'view' THEN 'share' WHEN 'purchase' THEN 'comment' ELSE event_type END, '","ip":"10.0.0.1","read_duration_ms":', CAST(event_id % 1000 + 1 AS STRING), '}') AS j FROM events) t"""


def _needed(names: tuple[str, ...]) -> str:
    return " ".join(f"WHEN coalesce(json_type(value, '$.{n}'), '') <> 'VARCHAR' OR trim(json_extract_string(value, '$.{n}')) = '' THEN '{validation.MISSING}{n}'" for n in names)


@query("etl_validate", f"""SELECT event_id, CASE WHEN NOT json_valid(value) THEN '{validation.NO_JSON}' WHEN json_type(value) <> 'OBJECT' THEN '{validation.NO_JSON}' {_needed(validation.BEHAVIOR_STRINGS[:4])}
 WHEN json_extract_string(value, '$.event_time')::TIMESTAMPTZ > json_extract_string(value, '$.ingest_time')::TIMESTAMPTZ + INTERVAL 2 HOUR THEN '{validation.AHEAD}' {_needed(validation.BEHAVIOR_STRINGS[4:])}
 WHEN json_extract_string(value, '$.action') NOT IN ('click', 'share', 'comment') THEN '{validation.BAD_ACTION}'
 WHEN coalesce(json_type(value, '$.read_duration_ms'), '') NOT IN ('UBIGINT', 'BIGINT') OR json_extract_string(value, '$.read_duration_ms')::DOUBLE NOT BETWEEN 0 AND {validation.MAX_READ_MS} THEN '{validation.BAD_INTEGER}read_duration_ms' END AS error_message FROM ({RAW})""")
def etl_validate(spark, d):
    """The validator over JSON text made of all events, with every kind of fault planted by event id."""
    readers.table(spark, d, "events").createOrReplaceTempView("_events_as_json")
    raw = spark.sql(RAW.replace("FROM events)", "FROM _events_as_json)"))
    # the record's own event_id is a column of the result too, so the table's goes by another name
    v = validation.validate(raw.withColumnRenamed("event_id", "source_id"), "behavior")
    return v.select(F.col("source_id").alias("event_id"), "error_message")


@query("dirty_record_id", """SELECT event_id, 'raw-' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' ||
 substr('89ab', 1 + (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS record_id
 FROM (SELECT event_id, md5(props) AS h FROM events WHERE event_type IN ('signup', 'error'))""")
def dirty_record_id(spark, d):
    e = readers.table(spark, d, "events").filter(F.col("event_type").isin("signup", "error"))
    return e.select("event_id", F.concat(F.lit("raw-"), uuid3(F.col("props"))).alias("record_id"))


@query("dedup_first", f"SELECT ip, article_id, event_id, event_ms FROM (SELECT *, row_number() OVER (PARTITION BY ip, article_id ORDER BY event_ms, event_id) AS rn FROM ({CLEAN})) WHERE rn = 1")
def dedup_first(spark, d):
    return dedup.first_by(clean(spark, d).select("ip", "article_id", "event_id", "event_ms"), ["ip", "article_id"], ["event_ms", "event_id"])


@query("latest_article_version", f"SELECT article_id, event_id AS version, event_ms, action AS event_type FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY event_id DESC) AS rn FROM ({BEHAVIORS})) WHERE rn = 1")
def latest_article_version(spark, d):
    v = readers.test_behaviors(spark, d).select("article_id", F.col("event_id").alias("version"), "event_ms", F.col("action").alias("event_type"), F.col("event_id").alias("sequence"))
    return enrich.latest_articles(v).drop("sequence")


@query("enrich_join", f"SELECT event_id, article_id, action, ip, event_ms, title, category, article_version FROM ({ENRICHED})")
def enrich_join(spark, d):
    return enriched(spark, d).select("event_id", "article_id", "action", "ip", "event_ms", "title", "category", "article_version")


@query("salted_join", f"SELECT event_id, article_id, title, category FROM ({ENRICHED})")
def salted_join(spark, d):
    return enrich.enrich_salted(clean(spark, d), readers.test_articles(spark, d), 8).select("event_id", "article_id", "title", "category")


@query("unmatched_behaviors", f"SELECT event_id, article_id, 'ARTICLE_NOT_FOUND_REPLAY_REQUIRED' AS reason FROM ({CLEAN}) WHERE article_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 7 <> 3)")
def unmatched_behaviors(spark, d):
    # every seventh article is withheld: with the full table nothing is unmatched
    arts = readers.test_articles(spark, d).filter(F.col("article_id") % 7 != 3)
    return enrich.unmatched(clean(spark, d), arts).select("event_id", "article_id", F.col("dirty_reason").alias("reason"))


SQL_A = f"""WITH e AS ({ENRICHED}), w AS (SELECT (event_ms // {DAY} - o.i) * {DAY} AS window_start_ms, e.* FROM e CROSS JOIN range(5) o(i) WHERE action = 'click')
 SELECT window_start_ms, window_start_ms + {5 * DAY} AS window_end_ms, article_id, arg_max(title, event_id) AS title, arg_max(category, event_id) AS category, COUNT(*) AS click_count FROM w GROUP BY window_start_ms, article_id"""


@query("rule_a_counts", SQL_A)
def rule_a_counts(spark, d):
    return rules.rule_a_counts(enriched(spark, d), **A)


@query("rule_a_alerts", f"SELECT * FROM ({SQL_A}) WHERE click_count > 2")
def rule_a_alerts(spark, d):
    return rules.rule_a(enriched(spark, d), threshold=2, **A)


@query("rule_a_strict", f"SELECT * FROM ({SQL_A}) WHERE click_count > 5")
def rule_a_strict(spark, d):
    return rules.rule_a(enriched(spark, d), threshold=5, **A)


@query("rule_a_argmax_title", f"""SELECT window_start_ms, article_id, arg_max(ip, event_id) AS title FROM (SELECT (event_ms // {DAY}) * {DAY} AS window_start_ms, * FROM ({ENRICHED}) WHERE action = 'click') GROUP BY 1, 2""")
def rule_a_argmax_title(spark, d):
    # the address stands in for a title that changes within the window
    e = enriched(spark, d).withColumn("title", F.col("ip")).withColumn("article_version", F.col("event_id"))
    return rules.rule_a_counts(e, DAY, DAY).select("window_start_ms", "article_id", "title")


SQL_SCORES = f"SELECT (event_ms // {DAY}) * {DAY} AS window_start_ms, category, article_id, arg_max(title, event_id) AS title, COUNT(*) AS score FROM ({ENRICHED}) GROUP BY 1, 2, 3"
SQL_RANK = f"""WITH s AS ({SQL_SCORES}), t AS (SELECT window_start_ms, category, CAST(SUM(score) AS BIGINT) AS score FROM s GROUP BY 1, 2),
 r AS (SELECT *, CAST(SUM(score) OVER (PARTITION BY window_start_ms) AS BIGINT) AS revision, row_number() OVER (PARTITION BY window_start_ms ORDER BY score DESC, category) AS rank_no FROM t)
 SELECT window_start_ms, rank_no, window_start_ms + {DAY} AS window_end_ms, category, score, revision FROM r WHERE rank_no <= 5"""
SQL_TOP = f"""WITH s AS ({SQL_SCORES}), k AS ({SQL_RANK}), a AS (SELECT *, row_number() OVER (PARTITION BY window_start_ms, category ORDER BY score DESC, article_id) AS article_rank FROM s)
 SELECT k.window_start_ms, k.rank_no, k.category, a.article_rank, a.article_id, a.title, a.score FROM k JOIN a USING (window_start_ms, category) WHERE a.article_rank <= 5"""


@query("rule_b_article_scores", SQL_SCORES)
def rule_b_article_scores(spark, d):
    return rules.rule_b_scores(enriched(spark, d), DAY)


@query("rule_b_category_rank", SQL_RANK)
def rule_b_category_rank(spark, d):
    return rules.rule_b(enriched(spark, d), DAY).drop("top_articles")


def _flat(ranking: DataFrame) -> DataFrame:
    return ranking.select("window_start_ms", "rank_no", "category", F.explode("top_articles").alias("t")).select(
        "window_start_ms", "rank_no", "category", F.col("t.rank_no").alias("article_rank"), F.col("t.article_id").alias("article_id"), F.col("t.title").alias("title"), F.col("t.score").alias("score"))


@query("rule_b_top_articles", SQL_TOP)
def rule_b_top_articles(spark, d):
    return _flat(rules.rule_b(enriched(spark, d), DAY))


@query("rule_b_revision", f"SELECT window_start_ms, CAST(SUM(score) AS BIGINT) AS revision FROM ({SQL_SCORES}) GROUP BY 1")
def rule_b_revision(spark, d):
    return rules.rule_b(enriched(spark, d), DAY).groupBy("window_start_ms").agg(F.max("revision").alias("revision"))


@query("rule_b_latest_snapshot", f"SELECT window_start_ms, window_end_ms, revision, rank_no, category, score FROM ({SQL_RANK}) WHERE window_start_ms = (SELECT max(window_start_ms) FROM ({SQL_RANK}))")
def rule_b_latest_snapshot(spark, d):
    s = rules.latest_snapshot(rules.rule_b(enriched(spark, d), DAY))
    return s.select("window_start_ms", "window_end_ms", "revision", F.explode("ranking").alias("r")).select("window_start_ms", "window_end_ms", "revision", F.col("r.rank_no").alias("rank_no"), F.col("r.category").alias("category"), F.col("r.score").alias("score"))


SQL_C = f"""WITH c AS (SELECT * FROM ({ENRICHED}) WHERE action = 'click'), k AS (SELECT a.ip, a.event_id, a.event_ms, COUNT(DISTINCT b.article_id) AS article_count, COUNT(*) AS click_count, SUM(b.read_duration_ms) AS s,
 string_agg(DISTINCT CAST(b.article_id AS VARCHAR), ',' ORDER BY CAST(b.article_id AS VARCHAR)) AS ids
 FROM c a JOIN c b ON a.ip = b.ip AND b.event_ms > a.event_ms - {5 * DAY} AND b.event_ms <= a.event_ms GROUP BY 1, 2, 3), h AS (SELECT * FROM k WHERE article_count > 2 AND s < 60 * click_count)"""
SQL_C_FIRST = f"{SQL_C}, f AS (SELECT *, (event_ms // {DAY}) * {DAY} AS alert_minute_ms, row_number() OVER (PARTITION BY ip, event_ms // {DAY} ORDER BY event_ms, event_id) AS rn FROM h)"


@query("rule_c_candidates", f"{SQL_C} SELECT ip, event_id, event_ms, article_count, click_count, round(s, 4) AS read_sum FROM h")
def rule_c_candidates(spark, d):
    return rules.rule_c_candidates(enriched(spark, d), **C).select("ip", "event_id", "event_ms", "article_count", "click_count", F.round("read_duration_sum_ms", 4).alias("read_sum"))


@query("rule_c_first_per_bucket", f"{SQL_C_FIRST} SELECT alert_minute_ms, ip, event_ms - {5 * DAY} AS window_start_ms, event_ms AS window_end_ms, article_count, click_count, round(s / click_count, 4) AS avg_read FROM f WHERE rn = 1")
def rule_c_first(spark, d):
    r = rules.rule_c(enriched(spark, d), bucket_ms=DAY, **C)
    return r.select("alert_minute_ms", "ip", "window_start_ms", "window_end_ms", "article_count", "click_count", F.round("avg_read_duration_ms", 4).alias("avg_read"))


@query("rule_c_article_ids", f"{SQL_C_FIRST} SELECT alert_minute_ms, ip, ids AS article_ids FROM f WHERE rn = 1")
def rule_c_article_ids(spark, d):
    r = rules.rule_c(enriched(spark, d), bucket_ms=DAY, **C)
    return r.select("alert_minute_ms", "ip", F.array_join(F.sort_array(F.transform("article_ids", lambda x: x.cast("string"))), ",").alias("article_ids"))


WM = 10 * DAY


@query("late_classification", f"""SELECT event_id, event_ms < wm - 3900000 AS join_late, (event_ms // 60000) * 60000 + 300000 - 1 + 3900000 <= wm AS a_late, (event_ms // 600000) * 600000 + 600000 - 1 + 3900000 <= wm AS b_late,
 CASE WHEN wm >= (event_ms // 60000) * 60000 + 120000 + 3900000 THEN 'dropped' WHEN wm >= (event_ms // 60000) * 60000 + 60000 + 3900000 THEN 'partial' ELSE 'on_time' END AS c_late
 FROM (SELECT *, event_ms + 3000000 + (event_id % 1800) * 1000 AS wm FROM ({BEHAVIORS}))""")
def late_classification(spark, d):
    b = readers.test_behaviors(spark, d).withColumn("wm", F.col("event_ms") + 3_000_000 + (F.col("event_id") % 1800) * 1000)
    e, wm = F.col("event_ms"), F.col("wm")
    return b.select("event_id", audit.is_late_join(e, wm).alias("join_late"), audit.is_late_a(e, wm).alias("a_late"), audit.is_late_b(e, wm).alias("b_late"), audit.c_lateness(e, wm).alias("c_late"))


@query("merge_greatest", f"SELECT article_id, max(event_id % 1000) AS click_count, arg_max(action, event_id) AS title, max(event_id) AS seq FROM ({CLEAN}) GROUP BY 1")
def merge_greatest(spark, d):
    rows = clean(spark, d).select("article_id", (F.col("event_id") % 1000).alias("click_count"), F.col("action").alias("title"), F.col("event_id").alias("seq"))
    old, new = rows.filter(F.col("seq") % 2 == 0), rows.filter(F.col("seq") % 2 == 1)
    return merge.merge_greatest(old, new, ["article_id"], "click_count", "seq")


@query("merge_revision", f"SELECT article_id, revision, title, seq FROM (SELECT article_id, event_id % 50 AS revision, action AS title, event_id AS seq, row_number() OVER (PARTITION BY article_id ORDER BY event_id % 50 DESC, event_id DESC) AS rn FROM ({CLEAN})) WHERE rn = 1")
def merge_revision(spark, d):
    rows = clean(spark, d).select("article_id", (F.col("event_id") % 50).alias("revision"), F.col("action").alias("title"), F.col("event_id").alias("seq"))
    old, new = rows.filter(F.col("seq") % 2 == 0), rows.filter(F.col("seq") % 2 == 1)
    return merge.merge_revision(old, new, ["article_id"], "seq")


@query("status_rollup", f"SELECT action, article_id < 50 AS matched, COUNT(*) AS n FROM ({BEHAVIORS}) GROUP BY 1, 2")
def status_rollup(spark, d):
    return audit.status_rollup(readers.test_behaviors(spark, d).withColumn("matched", F.col("article_id") < 50), "action", "matched")


@query("p95_latency", "SELECT quantile_disc(value, 0.95) AS p95, COUNT(value) AS n FROM events")
def p95_latency(spark, d):
    return audit.p95(readers.table(spark, d, "events"), "value")


@query("result_diff", f"""WITH e AS (SELECT article_id, COUNT(*) AS n FROM ({CLEAN}) WHERE event_id % 3 <> 0 GROUP BY 1), a AS (SELECT article_id, COUNT(*) AS n FROM ({CLEAN}) WHERE action <> 'purchase' GROUP BY 1)
 SELECT article_id, CASE WHEN a.n IS NULL THEN 'missing' WHEN e.n IS NULL THEN 'extra' ELSE 'different' END AS status, CASE WHEN a.n IS NOT NULL AND e.n IS NOT NULL THEN 'n' END AS fields
 FROM e FULL JOIN a USING (article_id) WHERE e.n IS DISTINCT FROM a.n""")
def result_diff(spark, d):
    c = clean(spark, d)
    e = audit.status_rollup(c.filter(F.col("event_id") % 3 != 0), "article_id")
    return audit.diff(e, audit.status_rollup(c.filter(F.col("action") != "purchase"), "article_id"), ["article_id"])


@query("multiset_diff", "SELECT *, 'left' AS side FROM (SELECT l_returnflag AS line FROM lineitem EXCEPT ALL SELECT l_linestatus FROM lineitem) UNION ALL SELECT *, 'right' AS side FROM (SELECT l_linestatus AS line FROM lineitem EXCEPT ALL SELECT l_returnflag FROM lineitem)")
def multiset_diff(spark, d):
    t = readers.table(spark, d, "lineitem")
    return audit.multiset_diff(t.select(F.col("l_returnflag").alias("line")), t.select(F.col("l_linestatus").alias("line")))


@query("join_event_audit", f"SELECT event_id, article_id, action AS dirty_reason, 'ROLE_A_LATE' AS event_type FROM ({BEHAVIORS}) WHERE action IN ('signup', 'error')")
def join_event_audit(spark, d):
    bad = readers.test_behaviors(spark, d).filter(~F.col("action").isin(*VALID)).withColumn("dirty_reason", F.col("action"))
    return audit.audit_rows(bad, "ROLE_A_LATE").select("event_id", "article_id", "dirty_reason", "event_type")


@query("salt_partitions", f"SELECT article_id, COUNT(*) AS n FROM ({CLEAN}) GROUP BY 1")
def salt_partitions(spark, d):
    """Pre-aggregation by salted key, then by key: what a hot article's count looks like without AQE."""
    c = clean(spark, d).withColumn("_salt", salt(F.col("event_id"), 8))
    return c.groupBy("article_id", "_salt").agg(F.count(F.lit(1)).alias("n")).groupBy("article_id").agg(F.sum("n").alias("n"))


@query("top_report", f"SELECT article_id, COUNT(*) AS n FROM ({CLEAN}) GROUP BY 1 ORDER BY n DESC, article_id LIMIT 10")
def top_report(spark, d):
    return audit.status_rollup(clean(spark, d), "article_id").orderBy(F.desc("n"), "article_id").limit(10)


@query("union_dirty", "SELECT 'behavior' AS source_stream, event_id AS record_id FROM events WHERE event_type IN ('signup', 'error') UNION ALL SELECT 'article', doc_id FROM documents WHERE n_chars < 100")
def union_dirty(spark, d):
    b = readers.table(spark, d, "events").filter(F.col("event_type").isin("signup", "error")).select(F.lit("behavior").alias("source_stream"), F.col("event_id").alias("record_id"))
    a = readers.table(spark, d, "documents").filter(F.col("n_chars") < 100).select(F.lit("article").alias("source_stream"), F.col("doc_id").alias("record_id"))
    return b.unionByName(a)


@query("iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN (epoch_us(ts) // 1000) % 1000 = 0 THEN '' ELSE strftime(ts, '.%g') END || 'Z' AS event_time, ((epoch_us(ts) // 1000) // 60000) * 60000 AS minute_ms FROM events")
def iso_times(spark, d):
    ms = event_millis(F.col("ts"))
    return readers.table(spark, d, "events").select("event_id", millis_iso(ms).alias("event_time"), floor_to(ms, 60_000).alias("minute_ms"))


# --- the rules online: a made-up schedule, in which a third of the events have no entry ---
ARRIVED = f"SELECT b.*, s.wm_before_ms FROM ({ENRICHED}) b LEFT JOIN (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (epoch_us(ts) // 1000) + (event_id % 11) * {ONLINE_STEP} END AS wm_before_ms FROM events WHERE event_id % 3 <> 0) s USING (event_id)"


def arrived(spark, d) -> DataFrame:
    e = readers.table(spark, d, "events").filter(F.col("event_id") % 3 != 0)
    wm = F.when(F.col("event_id") % 5 != 0, event_millis(F.col("ts")) + (F.col("event_id") % 11) * ONLINE_STEP)
    return schedule.at_arrival(enriched(spark, d).withColumn("sequence", F.col("event_id")), e.select(F.col("event_id").alias("sequence"), wm.alias("wm_before_ms")))


@query("rule_a_online", f"""SELECT window_start_ms, window_start_ms + {5 * DAY} AS window_end_ms, article_id, title, category, COUNT(*) AS click_count FROM (SELECT (event_ms // {DAY} - o.i) * {DAY} AS window_start_ms, e.* FROM ({ARRIVED}) e CROSS JOIN range(5) o(i) WHERE action = 'click')
 WHERE wm_before_ms IS NULL OR wm_before_ms < window_start_ms + {5 * DAY} - 1 + {ONLINE_LATE} GROUP BY ALL HAVING COUNT(*) > 2""")
def rule_a_online(spark, d):
    return schedule.rule_a_online(arrived(spark, d), threshold=2, allowed_ms=ONLINE_LATE, **A)


@query("rule_b_online", f"""WITH e AS (SELECT *, event_ms // {DAY} * {DAY} AS window_start_ms FROM ({ARRIVED})), t AS (SELECT window_start_ms, category, COUNT(*) AS score FROM e WHERE wm_before_ms IS NULL OR wm_before_ms < window_start_ms + {DAY} - 1 + {ONLINE_LATE} GROUP BY ALL),
 r AS (SELECT *, CAST(SUM(score) OVER (PARTITION BY window_start_ms) AS BIGINT) AS revision, row_number() OVER (PARTITION BY window_start_ms ORDER BY score DESC, category) AS rank_no FROM t) SELECT window_start_ms, rank_no, window_start_ms + {DAY} AS window_end_ms, category, score, revision FROM r WHERE rank_no <= 5""")
def rule_b_online(spark, d):
    return schedule.rule_b_online(arrived(spark, d), DAY, allowed_ms=ONLINE_LATE).drop("top_articles")


@query("late_rank_scores", f"SELECT 'ROLE_B_LATE' AS event_type, article_id || '-' || window_start_ms AS event_id, article_id, 'RANK_STATE_EXPIRED' AS dirty_reason FROM ({SQL_SCORES})")
def late_rank_scores(spark, d):
    return audit.late_scores(rules.rule_b_scores(enriched(spark, d), DAY)).drop("payload")


# --- the same rules on a second star: line items as behaviours, parts as articles ---
LINES = "SELECT l_orderkey * 10 + l_linenumber AS event_id, l_partkey AS article_id, 'click' AS action, l_suppkey AS ip, (epoch_us(l_shipdate) // 1000) AS event_ms, l_quantity AS read_duration_ms FROM lineitem"
LINES_E = f"SELECT b.*, p.p_name AS title, p.p_brand AS category FROM ({LINES}) b JOIN part p ON p.p_partkey = b.article_id"
YEAR = 364 * DAY


def line_events(spark, d) -> DataFrame:
    li, p = readers.table(spark, d, "lineitem"), readers.table(spark, d, "part")
    b = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"), F.col("l_partkey").alias("article_id"), F.lit("click").alias("action"), F.col("l_suppkey").alias("ip"), event_millis(F.col("l_shipdate")).alias("event_ms"), F.col("l_quantity").alias("read_duration_ms"))
    return enrich.enrich(b, p.select(F.col("p_partkey").alias("article_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("category"), F.lit(1).alias("version")))


@query("lines_rule_a", f"""SELECT window_start_ms, article_id, title, category, COUNT(*) AS click_count FROM (SELECT (event_ms // {YEAR // 4} - o.i) * {YEAR // 4} AS window_start_ms, e.* FROM ({LINES_E}) e CROSS JOIN range(4) o(i)) GROUP BY 1, 2, 3, 4 HAVING COUNT(*) > 8""")
def lines_rule_a(spark, d):
    return rules.rule_a(line_events(spark, d), YEAR, YEAR // 4, 8).select("window_start_ms", "article_id", "title", "category", "click_count")


@query("lines_rule_b", f"""WITH t AS (SELECT (event_ms // {YEAR}) * {YEAR} AS window_start_ms, category, COUNT(*) AS score FROM ({LINES_E}) GROUP BY 1, 2),
 r AS (SELECT *, CAST(SUM(score) OVER (PARTITION BY window_start_ms) AS BIGINT) AS revision, row_number() OVER (PARTITION BY window_start_ms ORDER BY score DESC, category) AS rank_no FROM t) SELECT window_start_ms, rank_no, category, score, revision FROM r WHERE rank_no <= 5""")
def lines_rule_b(spark, d):
    return rules.rule_b(line_events(spark, d), YEAR).select("window_start_ms", "rank_no", "category", "score", "revision")


@query("lines_latest_price", "SELECT l_partkey AS article_id, max(l_shipdate) AS last_ship, CAST(COUNT(*) AS BIGINT) AS n, COUNT(DISTINCT l_suppkey) AS suppliers, round(avg(l_quantity), 6) AS avg_qty FROM lineitem GROUP BY 1 HAVING COUNT(*) > 20")
def lines_latest_price(spark, d):
    t = readers.table(spark, d, "lineitem")
    return t.groupBy(F.col("l_partkey").alias("article_id")).agg(F.max("l_shipdate").alias("last_ship"), F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), F.round(F.avg("l_quantity"), 6).alias("avg_qty")).filter(F.col("n") > 20)
