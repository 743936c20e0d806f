"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases (each the shortest string that isn't in the dictionary yet, then
added to it); the set of phrases is hashed, and per slot the least hash makes a signature. The share of equal
slots estimates the overlap of two phrase sets, which follows how well one text compresses given the other.

Defined results: ids are integers, others are refused; a null text counts as empty; the empty text has no phrases and its own fingerprint, alike only
to itself; equal texts have equal fingerprints; rows with one id are ordered by text; a null id comes first; an
empty table gives an empty result; other columns are ignored. The last row's next row is the first one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 128
_MIX = np.uint64(0x9E3779B97F4A7C15)


def phrases(text: str, start: int, stop: int, known: set[str], seen: list[str], open_at: int) -> int:
    """Parse text[start:stop] on top of `known`; new phrases go to both collections.

    Returns where the open phrase begins. A phrase may have begun before `start`, at open_at.
    """
    i = open_at
    for j in range(start + 1, stop + 1):
        p = text[i:j]
        if p not in known:
            known.add(p)
            seen.append(p)
            i = j
    return i


def signature(found: list[str]) -> np.ndarray:
    """One-permutation minima: each phrase's hash falls into a slot; empty slots borrow from the next full one."""
    if not found:
        return np.zeros(SLOTS, np.uint16)
    h = np.fromiter((crc32(p.encode("utf-8", "surrogatepass")) for p in found), np.uint64, len(found))
    h = (h + np.uint64(1)) * _MIX
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, (h >> np.uint64(57)).astype(np.int64), h & np.uint64((1 << 57) - 1))
    full = np.flatnonzero(least != np.iinfo(np.uint64).max)
    if len(full) < SLOTS:
        # a fixed hop for each slot, so that two sets with the same full slots borrow alike
        where = full[np.searchsorted(full, np.arange(SLOTS)) % len(full)]
        least = least[where] + (np.arange(SLOTS) - where).astype(np.uint64) % np.uint64(SLOTS) * np.uint64(0x2545F4914F6CDD1D)
    least *= _MIX
    out = (least >> np.uint64(48)).astype(np.uint16)
    return np.maximum(out, 1)  # all zeros is the empty text's


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / SLOTS


def both(text: str, tail: str, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of text and of text[:cut] + tail. The common beginning is parsed once."""
    known: set[str] = set()
    seen: list[str] = []
    at = phrases(text, 0, cut, known, seen, 0)
    n = len(seen)
    edited = text[:cut] + tail
    rest = phrases(text, cut, len(text), known, seen, at)
    mine = signature(seen + [text[rest:]] if rest < len(text) else seen)
    known.difference_update(seen[n:])
    del seen[n:]
    rest = phrases(edited, cut, len(edited), known, seen, at)
    return mine, signature(seen + [edited[rest:]] if rest < len(edited) else seen)


def fingerprint(text: str | None) -> np.ndarray:
    return both(text or "", "", len(text or ""))[0]


def _hex(s: np.ndarray) -> str:
    return s.astype(">u2").tobytes().hex()


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt into ranges of ids: _bucket, _id, _text, _halo. Each range also gets a copy of the first row of the
    next one (the last range: of the first), so that a row's successor is always at hand and no task sees all rows.
    """
    spark = docs.sparkSession
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} isn't an integer")
    least = -(1 << 63)
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("_id"), F.col(id_col).isNull().alias("_null"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    ids = d.select("_id")
    n = max(2, 3 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    marks = sorted(set(int(x) for x in ids.select(F.col("_id").cast("double").alias("x")).approxQuantile("x", [i / n for i in range(1, n)], 0.2 / n)))
    bucket = F.lit(0) if not marks else F.size(F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: m <= F.col("_id")))
    firsts = {r["b"]: r["f"] for r in ids.groupBy(bucket.alias("b")).agg(F.min("_id").alias("f")).collect()}  # a row per range
    full = sorted(firsts)
    before = {firsts[b]: full[i - 1] for i, b in enumerate(full)}  # full[-1] for the first range
    d = d.withColumn("_bucket", bucket)
    if before:
        to = F.create_map(*[F.lit(x) for k, v in before.items() for x in (k, v)])
        d = d.withColumn("_to", F.explode(F.array_compact(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("halo")), F.when(F.col("_id").isin(*before), F.struct(to[F.col("_id")].alias("b"), F.lit(True).alias("halo")))))))
    else:
        d = d.withColumn("_to", F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("halo")))
    d = d.select(F.col("_to.b").alias("_bucket"), F.col("_to.halo").alias("_halo"), "_id", "_null", "_text")
    return d.repartitionById((max(full) if full else 0) + 1, F.col("_bucket").cast("int")).sortWithinPartitions("_bucket", "_halo", "_id", "_text")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next."""
    schema = f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        last: tuple | None = None  # (id, text, bucket) that waits for its successor
        ready: tuple | None = None  # the row before it, complete but for near_next, and its signature

        def close(text_next: str) -> None:
            """Make the waiting row's signatures, and settle the row before it."""
            nonlocal ready
            i, text, _ = last
            k = len(text) // 4
            tail = text_next[:k]
            mine, edited = both(text, tail, len(text) - k)
            if ready:
                out.append((*ready[0], likeness(ready[1], mine)))
            sha = hashlib.sha256((text[: len(text) - k] + tail).encode("utf-8", "surrogatepass")).hexdigest()
            ready = ((i, len(text), sha, _hex(mine), _hex(edited), likeness(mine, edited)), mine)

        for p in parts:
            for b, halo, i, null, text in zip(p["_bucket"], p["_halo"], p["_id"], p["_null"], p["_text"], strict=True):
                if last is not None and last[2] == b:
                    close(text)
                    if halo:
                        out.append((*ready[0], likeness(ready[1], fingerprint(text))))
                        ready, last = None, None
                        continue
                if not halo:
                    last = (None if null else i, text, b)
            if out:
                yield frame(out)
                out = []
        if out:
            yield frame(out)

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        f = pd.DataFrame(rows, columns=names)
        f[id_col] = f[id_col].astype("Int64")
        return f

    return neighbours(docs, id_col, text_col).mapInPandas(run, schema)
