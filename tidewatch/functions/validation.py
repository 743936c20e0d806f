"""Strict validation of raw JSON records; one pass gives the parsed fields or the first error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.scalar import iso_millis, not_blank, uuid3

AHEAD_MS = 2 * 3_600_000
MAX_READ_MS = 86_400_000
# Error messages that consumers of the dirty table read, and accepted words.
NO_JSON = "JSON、必填字段或时间非法"
MISSING = "字段缺失或不是非空字符串: "
AHEAD = "event_time 超前 ingest_time 两小时以上"
BAD_ARTICLE = "文章 event_type 或 tags 非法"
BAD_ACTION = "行为 action 非法"
BAD_INTEGER = "整数字段缺失或超出范围: "
DIRTY_REASON = "SCHEMA_VALIDATION_FAILED"
ARTICLE_TYPES = ("publish", "update")
ACTIONS = ("click", "share", "comment")

ARTICLE_STRINGS = ("event_id", "article_id", "event_time", "ingest_time", "event_type", "title", "category", "published_at")
BEHAVIOR_STRINGS = ("event_id", "article_id", "event_time", "ingest_time", "user_id", "action", "ip")


def _string(v: Column, name: str) -> Column:
    """The field if it is a JSON string that isn't blank, else null."""
    f = F.try_variant_get(v, f"$.{name}", "variant")
    s = F.try_variant_get(v, f"$.{name}", "string")
    return F.when((F.schema_of_variant(f) == "STRING") & not_blank(s), s)


def _integer(v: Column, name: str) -> Column:
    """The field if it is a JSON integer (not 1.0, not "1"), else null."""
    f = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(f).isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.try_variant_get(v, f"$.{name}", "bigint"))


def validate(raw: DataFrame, stream: str, value: str = "value") -> DataFrame:
    """Parse `value` and add the fields of `stream` ("article" or "behavior"), event_ms and error_message.

    error_message is null for clean rows, else the message of the first failing check. A null value counts
    as unparsable. Other columns of `raw` (an arrival sequence, say) are kept.
    """
    article = stream == "article"
    names = ARTICLE_STRINGS if article else BEHAVIOR_STRINGS
    text = F.col(value)
    # the parser accepts text behind a value, so the record is put into an object whose end is known by a digest
    df = raw.withColumn("_end", F.md5(text)).withColumn("_whole", F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"r":'), text, F.lit(',"'), F.col("_end"), F.lit('":1}'))), "$", "map<string,variant>"))
    df = df.withColumn("_v", F.when(text.rlike(r"^\s*\{") & (F.size("_whole") == 2) & F.map_contains_key("_whole", F.col("_end")), F.element_at("_whole", F.lit("r"))))
    f = {n: _string(F.col("_v"), n) for n in names}
    df = df.withColumns({f"_{n}": c for n, c in f.items()})
    df = df.withColumns({
        "_ems": iso_millis(F.col("_event_time")), "_ims": iso_millis(F.col("_ingest_time")),
        "_num": _integer(F.col("_v"), "version" if article else "read_duration_ms"),
    })
    checks: list[tuple[Column, Column]] = [(F.col("_v").isNull(), F.lit(NO_JSON))]
    need = lambda n: (F.col(f"_{n}").isNull(), F.lit(MISSING + n))
    checks += [need(n) for n in names[:4]]
    checks += [(F.col("_ems").isNull() | F.col("_ims").isNull(), F.lit(NO_JSON))]
    checks += [(F.col("_ems") > F.col("_ims") + AHEAD_MS, F.lit(AHEAD))]
    checks += [need(n) for n in names[4:]]
    if article:
        tags = F.try_variant_get(F.col("_v"), "$.tags", "array<variant>")
        checks += [
            (iso_millis(F.col("_published_at")).isNull(), F.lit(NO_JSON)),
            (~F.col("_event_type").isin(*ARTICLE_TYPES) | tags.isNull() | (F.size(tags) < 1), F.lit(BAD_ARTICLE)),
            (F.col("_num").isNull() | ~F.col("_num").between(1, 2_147_483_647), F.lit(BAD_INTEGER + "version")),
        ]
    else:
        checks += [
            (~F.col("_action").isin(*ACTIONS), F.lit(BAD_ACTION)),
            (F.col("_num").isNull() | ~F.col("_num").between(0, MAX_READ_MS), F.lit(BAD_INTEGER + "read_duration_ms")),
        ]
    error = reduce(lambda rest, c: F.when(c[0], c[1]).otherwise(rest), reversed(checks), F.lit(None).cast("string"))
    out = [F.col(c) for c in raw.columns] + [F.col(f"_{n}").alias(n) for n in names]
    out += [F.col("_ems").alias("event_ms"), F.timestamp_millis(F.col("_ems")).alias("event_ts")]
    if article:
        out += [F.col("_num").try_cast("int").alias("version"), F.try_variant_get(F.col("_v"), "$.tags", "array<string>").alias("tags")]
    else:
        out += [F.col("_num").try_cast("int").alias("read_duration_ms")]
    return df.withColumn("error_message", error).select(*out, "error_message")


def clean(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("error_message").isNull()).drop("error_message")


def dirty(validated: DataFrame, stream: str, value: str = "value") -> DataFrame:
    """Rows of the dirty table: the record's id comes from its bytes, so replays keep it."""
    return validated.filter(F.col("error_message").isNotNull()).select(
        F.lit(stream).alias("source_stream"), F.concat(F.lit("raw-"), uuid3(F.coalesce(F.col(value), F.lit("")))).alias("record_id"),
        F.col("error_message").alias("reason"), F.lit(DIRTY_REASON).alias("dirty_reason"), F.col(value).alias("raw_data"),
    )
