"""Scalar column functions with the reference's semantics, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE_MS = 60_000
#: date, 'T', time with at least minutes, optional seconds and fraction, then an offset
ISO_OFFSET = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2}(:\d{2})?)$"


def not_blank(c: Column) -> Column:
    """True if the string holds a character above U+0020 (a null gives null)."""
    return c.rlike(r"[^\x00-\x20]")


def iso_millis(c: Column) -> Column:
    """Epoch milliseconds of an ISO-8601 timestamp with an offset; null if it isn't one."""
    return F.when(c.rlike(ISO_OFFSET), F.unix_millis(c.try_cast("timestamp")))


def millis_iso(ms: Column) -> Column:
    """ISO-8601 text of epoch milliseconds; the fraction only where there is one."""
    ts = F.timestamp_millis(ms)
    return F.when(
        F.pmod(ms, F.lit(1000)) == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ).otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def floor_to(ms: Column, step_ms: int) -> Column:
    """The largest multiple of step_ms not above ms, for negative values too."""
    return ms - F.pmod(ms, F.lit(step_ms).cast("long"))


def event_millis(c: Column) -> Column:
    """Epoch milliseconds of a timestamp with or without zone (UTC)."""
    return F.unix_millis(c.cast("timestamp"))


def uuid3(raw: Column) -> Column:
    """Name-based UUID, version 3, of the bytes of a string, without a namespace."""
    h = F.md5(raw)
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )


def salt(key: Column, n: int) -> Column:
    """A salt in [0, n) that is the same at every rerun."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
