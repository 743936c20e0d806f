"""Removal of long repeated byte strings by families of suffix arrays.

A byte goes if some string of LENGTH bytes that covers it also starts elsewhere, in any document. Sorting every
suffix of the corpus in one place isn't possible, so suffixes are first dealt by content:

1. A window's anchor is the place of its least GRAM-byte hash. Its core is the anchor with SIDE bytes more, on the
   side where the window has more. Equal windows have equal cores at equal places, so windows meet if they are dealt
   by the core's hash. Neighbouring windows with one core form a run.
2. Cores are counted. Those that occur once have no repeated window. Where all runs of a core are the same string,
   all of their windows repeat. Only what is left, the edges of repeats, has its bytes looked at.
3. Those runs are dealt by core (runs of very frequent cores in blocks of windows, so that they spread), and each
   task keeps a logarithmic family of suffix arrays: a batch's window suffixes are sorted, merge-scanned against
   every level, and levels of equal size are merged, so a suffix is moved a logarithmic number of times. A suffix is
   compared by its first LENGTH bytes, and a level holds each of them once.

Cores are compared by 64-bit hashes and whole runs by another 64 bits within the core; the suffix arrays
compare bytes.

Texts are told by 128 bits. Of equal texts one is cut into windows; all of them lose every byte.

Defined results: a null text counts as empty; texts shorter than LENGTH keep all; repeated rows repeat each other,
so all their windows go; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.hashing import mix
from tidewatch.llm.joins import Scratch

LENGTH, GRAM = 200, 32
SIDE = (LENGTH - GRAM) // 2
#: cores with more runs than this are dealt in blocks of BLOCK windows
HOT, BLOCK = 4096, 17
SLICE = 1 << 22  # windows of one text that are looked at together
BATCH = 512  # runs in a batch
_P = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 24) - 1)


def _grams(b: np.ndarray) -> np.ndarray:
    """Hashes of all GRAM-byte strings, by doubling."""
    h, m, p = mix(b.astype(np.uint64) + np.uint64(1)), 1, _P
    while m < GRAM:
        h = h[:-m] * p + h[m:]
        m, p = 2 * m, p * p
    return mix(h)


def runs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the core, first window, number of windows and the anchor's place in the first window, of each run."""
    parts = []
    total = len(data) - LENGTH + 1
    with np.errstate(over="ignore"):
        for at in range(0, max(total, 0), SLICE):
            n = min(SLICE, total - at)
            h = _grams(np.frombuffer(data, np.uint8)[at : at + n + LENGTH - 1])
            key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
            w, m = LENGTH - GRAM + 1, 1
            least = key
            while 2 * m <= w:
                least = np.minimum(least[:-m], least[m:])
                m *= 2
            least = np.minimum(least[: len(least) - (w - m)], least[w - m :]) if w > m else least
            place = (least & _PLACE).astype(np.int64)
            left = place - np.arange(n) >= SIDE
            first = np.concatenate(([0], np.flatnonzero(np.diff(place * 2 + left)) + 1))
            p, left = place[first], left[first]
            # the core that all windows of a run hold: the anchor, and SIDE bytes on the longer side of it
            core = h[p] + left.astype(np.uint64)
            for step in (*range(GRAM, SIDE, GRAM), SIDE):
                core = core * _P + h[np.where(left, p - step, p + step)]
            core = mix(core)
            parts.append((core.view(np.int64), first + at, np.diff(np.concatenate((first, [n]))), p - first))
    if not parts:
        e = np.empty(0, np.int64)
        return e, e, e, e
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class SuffixLevels:
    """A logarithmic family of suffix arrays over suffixes cut at LENGTH bytes."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # sorted distinct suffixes, and the number of each's first window

    def add(self, suffixes: np.ndarray, numbers: np.ndarray, repeated: np.ndarray) -> None:
        """Add a batch. repeated[number] is set for windows that equal another one, seen before or in the batch."""
        order = np.argsort(suffixes, kind="stable")
        s, k = suffixes[order], numbers[order]
        same = s[1:] == s[:-1]
        repeated[k[1:][same]] = True
        repeated[k[:-1][same]] = True
        head = np.concatenate(([True], ~same))
        tail_of = np.cumsum(head) - 1
        distinct, first = s[head], k[head]
        new = np.ones(len(distinct), bool)
        for level, owner in self.levels:
            at = np.minimum(np.searchsorted(level, distinct), len(level) - 1)
            hit = level[at] == distinct
            repeated[owner[at[hit]]] = True
            repeated[k[hit[tail_of]]] = True
            new &= ~hit
        level = (distinct[new], first[new])
        if not len(level[0]):
            return
        while self.levels and len(self.levels[-1][0]) <= 2 * len(level[0]):
            other = self.levels.pop()
            both, owner = np.concatenate((other[0], level[0])), np.concatenate((other[1], level[1]))
            order = np.argsort(both, kind="stable")
            level = (both[order], owner[order])
        self.levels.append(level)


def repeats(strings: list[bytes], places: np.ndarray) -> list[np.ndarray]:
    """For runs (their bytes, and the anchor's place in the first window): which windows repeat another one.

    Equal windows have equal anchor places, so places are done in blocks, and a family only holds a block's windows.
    """
    # equal runs repeat each other; one of each goes on
    seen: dict[tuple[int, bytes], int] = {}
    of = [seen.setdefault((p, s), len(seen)) for p, s in zip(places.tolist(), strings, strict=True)]
    copies = np.bincount(of, minlength=len(seen))
    strings, places = [s for _, s in seen], np.array([p for p, _ in seen])
    n = np.array([len(s) - LENGTH + 1 for s in strings])
    offset = np.concatenate(([0], np.cumsum(n)))
    repeated = np.repeat(copies > 1, n)
    for low in range(0, LENGTH, BLOCK):
        # window j of a run has its anchor at places[i] - j
        first, last = np.maximum(0, places - low - BLOCK + 1), np.minimum(n, places - low + 1)
        mine = np.flatnonzero(first < last)
        family = SuffixLevels()
        for at in range(0, len(mine), BATCH):
            found, numbers = [], []
            for i in mine[at : at + BATCH].tolist():
                a, b = first[i], last[i]
                piece = np.frombuffer(strings[i], np.uint8)[a : b + LENGTH - 1]
                found.append(np.lib.stride_tricks.as_strided(piece, (b - a, LENGTH), (1, 1)))
                numbers.append(np.arange(offset[i] + a, offset[i] + b))
            family.add(np.concatenate(found).view(f"S{LENGTH}").ravel(), np.concatenate(numbers), repeated)
    return [repeated[offset[i] : offset[i + 1]] for i in of]


def spans(starts: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans covered by windows at sorted distinct starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > LENGTH) + 1
    a, b = np.concatenate(([0], cut)), np.concatenate((cut, [len(starts)])) - 1
    return [(int(starts[x]), int(starts[y]) + LENGTH) for x, y in zip(a, b, strict=True)]


def union(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: a text's key, 128 bits of it
KEY = ["_k1", "_k2"]


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


#: _q is a run's first window, number of windows and anchor's place, the latter two in 8 bits each
RUNS = T.StructType(_longs(*KEY, "_a", "_r", "_q"))
EDGES = T.StructType([*_longs("_route", *KEY, "_s", "_p"), T.StructField("_bytes", T.BinaryType())])
COVERED = T.StructType(_longs(*KEY, "_lo", "_hi"))
CUT = T.StructType([*_longs("n_bytes", "n_removed", "n_spans"), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.BinaryType())])


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _runs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        out, size = [], 0
        for k1, k2, text in zip(p["_k1"], p["_k2"], p["_text"], strict=True):
            data = _bytes(text)
            a, s, w, place = runs(data)
            if len(a):
                r = np.fromiter((xxhash.xxh3_64_intdigest(data[x : x + n + LENGTH - 1], q) for x, n, q in zip(s.tolist(), w.tolist(), place.tolist(), strict=True)), np.uint64, len(a))
                out.append(np.stack((np.full(len(a), k1, np.int64), np.full(len(a), k2, np.int64), a, r.view(np.int64), s << 16 | w << 8 | place)))
                size += len(a)
            if size > 100_000:
                yield pd.DataFrame(dict(zip(RUNS.names, np.concatenate(out, axis=1), strict=True)))
                out, size = [], 0
        if out:
            yield pd.DataFrame(dict(zip(RUNS.names, np.concatenate(out, axis=1), strict=True)))


def _edges(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        rows = []
        for k1, k2, text, found in zip(p["_k1"], p["_k2"], p["_text"], p["_edges"], strict=True):
            data = _bytes(text)
            seen: dict[tuple, int] = {}
            for e in found:
                a, s, w, place = e["_a"], e["_q"] >> 16, e["_q"] >> 8 & 255, e["_q"] & 255
                piece = data[s : s + w + LENGTH - 1]
                # equal runs of one text settle each other (without bytes: the row is a covered span); one goes on
                before = seen.setdefault((a, place, piece), s)
                if before != s:
                    rows.append((k1, k1, k2, s, len(piece), None))
                    if before >= 0:
                        rows.append((k1, k1, k2, before, len(piece), None))
                        seen[a, place, piece] = -1
                    continue
                if not e["_hot"]:
                    rows.append((a, k1, k2, s, place, piece))
                    continue
                for block in range((place - w + 1) // BLOCK, place // BLOCK + 1):
                    x, y = max(0, place - (block + 1) * BLOCK + 1), min(w, place - block * BLOCK + 1)
                    rows.append((a ^ (block + 1) * 0x1E3779B97F4A7C15 & (1 << 62) - 1, k1, k2, s + x, place - x, data[s + x : s + y + LENGTH - 1]))
            if len(rows) > 20_000:
                yield pd.DataFrame(rows, columns=EDGES.names)
                rows = []
        yield pd.DataFrame(rows, columns=EDGES.names)


def _search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One task's runs, in order of route; families cover whole routes, a bounded number of runs at a time unless one route has more."""
    k1, k2, s, place, data, route = [], [], [], [], [], []

    def settle(k: int) -> pd.DataFrame:
        found = repeats(data[:k], np.array(place[:k]))
        rows = [(k1[i], k2[i], s[i] + a, s[i] + b) for i, f in enumerate(found) for a, b in spans(np.flatnonzero(f))]
        for x in (k1, k2, s, place, data, route):
            del x[:k]
        return pd.DataFrame(rows, columns=COVERED.names)

    for p in parts:
        open_ = p["_bytes"].notna()
        if not open_.all():
            q = p[~open_]
            yield pd.DataFrame({"_k1": q["_k1"], "_k2": q["_k2"], "_lo": q["_s"], "_hi": q["_s"] + q["_p"]})
            p = p[open_]
        route += p["_route"].tolist()
        k1 += p["_k1"].tolist()
        k2 += p["_k2"].tolist()
        s += p["_s"].tolist()
        place += p["_p"].tolist()
        data += p["_bytes"].tolist()
        if len(data) > 16 * BATCH:
            k = len(route) - 1
            while k > 0 and route[k - 1] == route[-1]:
                k -= 1
            if k > 0:
                yield settle(k)
    if data:
        yield settle(len(data))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept_sha256 of every row, and if asked kept_text, its remaining bytes."""
    scratch = Scratch(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    d = d.withColumn("_k1", F.xxhash64("_text")).withColumn("_k2", F.xxhash64(F.lit(1), "_text"))
    # texts that occur more than once go whole; one of each stands for them among the others
    long = d.filter(F.octet_length("_text") >= LENGTH)
    copied = scratch.store(long.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select(*KEY))
    single = long.join(copied, KEY, "left_anti")
    one = single.select(*KEY, "_text").unionByName(long.join(copied, KEY, "left_semi").select(*KEY, "_text").dropDuplicates(KEY))
    every = one.mapInPandas(_runs, RUNS)
    # per core, with partial sums before the shuffle: how many runs, and whether they are all one string
    counted = every.groupBy("_a").agg(F.count(F.lit(1)).alias("_c"), (F.min("_r") == F.max("_r")).alias("_one")).filter("_c > 1")
    # stored, so that the join's two sides are plain exchanges, of which AQE splits a hot core's
    counted = scratch.store(counted.select("_a", "_one", (F.col("_c") > HOT).alias("_hot")))
    repeated = every.select(*KEY, "_a", "_q").join(counted, "_a")
    run = F.struct("_a", "_q", "_hot")
    first, windows = F.shiftright("_q", 16), F.shiftright("_q", 8).bitwiseAND(F.lit(255))
    whole = F.struct(first.alias("_lo"), (first + windows + (LENGTH - 1)).alias("_hi"))
    # a text's runs: at most one per byte of it
    by_doc = scratch.store(repeated.groupBy(*KEY).agg(F.collect_list(F.when(F.col("_one"), whole)).alias("_whole"), F.collect_list(F.when(~F.col("_one"), run)).alias("_edges")))
    # the texts are dealt by their key once, for this join and for the last one
    edges = one.join(by_doc.filter(F.size("_edges") > 0).select(*KEY, "_edges"), KEY).mapInPandas(_edges, EDGES)
    found = edges.repartition(F.col("_route")).sortWithinPartitions("_route").select("_route", *KEY, "_s", "_p", "_bytes").mapInPandas(_search, COVERED)
    covered = found.groupBy(*KEY).agg(F.collect_list(F.struct("_lo", "_hi")).alias("_found"))
    spans_ = by_doc.select(*KEY, "_whole").join(covered, KEY, "full_outer")

    @F.pandas_udf(CUT)
    def cut(texts: pd.Series, wholes: pd.Series, founds: pd.Series) -> pd.DataFrame:
        rows = []
        for text, w, f in zip(texts, wholes, founds, strict=True):
            data = _bytes(text)
            gone = union([(x["_lo"], x["_hi"]) for part in (w, f) if part is not None for x in part])
            edge = [0, *[x for s in gone for x in s], len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edge[::2], edge[1::2], strict=True))
            rows.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        return pd.DataFrame(rows, columns=CUT.names)

    names = CUT.names if with_text else CUT.names[:-1]
    # ids stay outside of Python
    rest = d.join(copied, KEY, "left_anti").join(spans_, KEY, "left").select("_id", cut("_text", "_whole", "_found").alias("_f")).select(F.col("_id").alias(id_col), *[F.col(f"_f.{c}") for c in names])
    n = F.octet_length("_text").cast("long")
    emptied = [n.alias("n_bytes"), n.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept_sha256"), F.lit(b"").alias("kept_text")]
    return rest.unionByName(d.join(copied, KEY, "left_semi").select(F.col("_id").alias(id_col), *emptied[: len(names)]))
