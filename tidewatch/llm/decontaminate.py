"""Benchmark decontamination.

Texts are cut into words (letters and digits, case folded) and five-word shingles. For each item length, a
window of that many shingles slides over a document; its SimHash sums one weighted vector of signs per shingle.
Fingerprints within RADIUS bits of an item's are found by multi-index hashing: of 8 blocks of 8 bits, two
fingerprints within 23 bits agree in at least one block up to 2 bits, so each block's neighbourhoods are looked
up and no fingerprint within the radius is missed. Candidates are then verified by the exact weighted overlap
of their shingle sets (sum of least weights over sum of largest), at least `similarity`.

Shingles weigh by their rarity among the items. Windows that share no shingle with any item have overlap 0 and
need no fingerprint, so only the surroundings of shared shingles are fingerprinted: every window that holds one.
A document shorter than an item is one window.

The items are broadcast in slices of at most ITEMS_AT_ONCE rows and CHARS_AT_ONCE characters; a larger
benchmark takes more passes.

An item of fewer than five words has no shingle: it is found where its words stand in a row, with similarity 1.

Defined results: null and empty texts match nothing, nor do empty items; repeated rows get the same result, and
repeated items count once each; a null item id is an id of its own; an empty table gives an empty result; other columns are ignored (kept by
`clean`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.hashing import LETTERS, SHINGLE, mix, shingles, words

SIMILARITY, BITS, BLOCKS, NEAR, RADIUS = 0.75, 64, 8, 2, 23
ITEMS_AT_ONCE, CHARS_AT_ONCE = 20_000, 16_000_000
_SHIFTS = np.arange(BITS, dtype=np.uint64)
_POPULATION = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def text_words(text: str | None) -> np.ndarray:
    """Word hashes in order."""
    return words((text or "").lower().encode("utf-8", "surrogatepass"), LETTERS)[0]


def signs(s: np.ndarray) -> np.ndarray:
    return ((mix(s)[:, None] >> _SHIFTS) & np.uint64(1)).astype(np.float32) * 2 - 1


class Items:
    """The benchmark's fingerprints by length, its shingle weights and a filter of its shingles."""

    def __init__(self, rows: list[tuple[int, str]]):
        found = [(i, text_words(t)) for i, t in rows]
        sets = [(i, shingles(w)) for i, w in found if len(w) >= SHINGLE]
        # items too short for a shingle: by number of words, which items are that run of words
        self.short: dict[int, dict[int, list]] = {}
        for i, w in found:
            if 0 < len(w) < SHINGLE:
                self.short.setdefault(len(w), {}).setdefault(int(shingles(w, len(w))[0]), []).append(i)
        every, counts = np.unique(np.concatenate([np.unique(s) for _, s in sets]) if sets else np.empty(0, np.uint64), return_counts=True)
        self.known = every
        self.weight = np.log1p(len(sets) / counts.astype(np.float64))
        self.default = float(np.log1p(max(len(sets), 1)))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(every & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.by_length: dict[int, tuple] = {}
        for n in sorted({len(s) for _, s in sets}):
            mine = [(i, s) for i, s in sets if len(s) == n]
            prints = np.array([self.fingerprint(s) for _, s in mine], np.uint8)
            # near[block][byte]: which items have a block within NEAR bits of the byte
            near = [_POPULATION[np.arange(256, dtype=np.uint8)[:, None] ^ prints[None, :, b]] <= NEAR for b in range(BLOCKS)]
            self.by_length[n] = ([i for i, _ in mine], [np.unique(s) for _, s in mine], prints, near)

    def weights(self, s: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, s), max(len(self.known) - 1, 0))
        return np.where(self.known[at] == s, self.weight[at], self.default) if len(self.known) else np.full(len(s), self.default)

    def fingerprint(self, s: np.ndarray) -> np.ndarray:
        return np.packbits((signs(s) * self.weights(s)[:, None]).sum(0) > 0)

    def shared(self, s: np.ndarray) -> np.ndarray:
        """Places of shingles that some item has."""
        at = np.flatnonzero(self.filter[(s & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(at):
            return at
        k = np.minimum(np.searchsorted(self.known, s[at]), len(self.known) - 1)
        return at[self.known[k] == s[at]]

    def overlap(self, a: np.ndarray, b: np.ndarray) -> float:
        """Weighted overlap of two sorted shingle sets."""
        both = self.weights(np.intersect1d(a, b, assume_unique=True)).sum()
        return float(both / max(self.weights(a).sum() + self.weights(b).sum() - both, 1e-12))

    def match(self, w: np.ndarray, similarity: float) -> list[tuple[int, float, int, int, int]]:
        """(item, similarity, bits apart, first word, words) of each item's best window in a text of words w."""
        out = []
        for n, items in self.short.items():
            if len(w) >= n:
                runs = shingles(w, n)
                for k in np.flatnonzero(np.isin(runs, np.fromiter(items, np.uint64, len(items)))).tolist():
                    out += [(i, 1.0, 0, k, n) for i in items[int(runs[k])]]
        s = shingles(w) if len(w) >= SHINGLE else np.empty(0, np.uint64)
        return self._best(out + self._near(s, similarity))

    def _near(self, s: np.ndarray, similarity: float) -> list[tuple[int, float, int, int, int]]:
        hits = self.shared(s) if len(s) else s
        if not len(hits):
            return []
        out = []
        longest = max(self.by_length)
        cuts = np.flatnonzero(np.diff(hits) > 2 * longest) + 1
        for group in np.split(hits, cuts):
            low, high = max(0, int(group[0]) - longest + 1), min(len(s), int(group[-1]) + longest)
            for a in range(low, high, 8192):  # long regions in overlapping pieces
                out += self._region(s, a, min(high, a + 8192 + longest), similarity)
        return [(i, sim, d, at, n + SHINGLE - 1) for i, sim, d, at, n in out]

    @staticmethod
    def _best(out: list[tuple]) -> list[tuple]:
        best: dict[int, tuple] = {}
        for m in out:
            if m[0] not in best or (m[1], -m[3]) > (best[m[0]][1], -best[m[0]][3]):
                best[m[0]] = m
        return [best[k] for k in sorted(best, key=lambda i: (i is None, i if i is not None else 0))]

    def _region(self, s: np.ndarray, low: int, high: int, similarity: float) -> list[tuple]:
        part = s[low:high]
        total = np.concatenate((np.zeros((1, BITS), np.float64), np.cumsum(signs(part) * self.weights(part)[:, None], axis=0, dtype=np.float64)))
        ours = np.zeros(len(part) + 1, np.int64)
        known = self.shared(part)
        ours[known + 1] = 1
        ours = np.cumsum(ours)
        out = []
        for n, (ids, sets, prints, near) in self.by_length.items():
            k = min(n, len(part))
            starts = np.flatnonzero(ours[k:] - ours[:-k] > 0)
            if not len(starts):
                continue
            fp = np.packbits(total[starts + k] - total[starts] > 1e-6, axis=1)
            maybe = near[0][fp[:, 0]]
            for b in range(1, BLOCKS):
                maybe = maybe | near[b][fp[:, b]]
            w, i = np.nonzero(maybe)
            if not len(w):
                continue
            apart = _POPULATION[fp[w] ^ prints[i]].sum(1)
            for w_, i_, d in zip(w[apart <= RADIUS], i[apart <= RADIUS], apart[apart <= RADIUS], strict=True):
                x = int(starts[w_])
                sim = self.overlap(np.unique(part[x : x + k]), sets[i_])
                if sim >= similarity:
                    out.append((ids[i_], sim, int(d), low + x, k))
        return out


def slices(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Items]:
    """The items in slices of bounded size; the driver holds one at a time."""
    rows: list[tuple[int, str]] = []
    chars, some = 0, False
    for r in benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).filter("t is not null").toLocalIterator():
        if rows and (len(rows) >= ITEMS_AT_ONCE or chars + len(r["t"]) > CHARS_AT_ONCE):
            yield Items(rows)
            rows, chars, some = [], 0, True
        rows.append((r["i"], r["t"]))
        chars += len(r["t"])
    if rows or not some:
        yield Items(rows)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per document and item that it contains: id, item, similarity, bits apart, first word, words."""
    spark = docs.sparkSession
    hits = T.ArrayType(T.StructType([
        T.StructField(item_col, benchmark.schema[item_col].dataType), T.StructField("similarity", T.DoubleType()), T.StructField("hamming", T.IntegerType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())]))
    out = None
    for items in slices(benchmark, item_col, text_col):
        match = _matches(spark.sparkContext.broadcast(items), similarity, hits)
        # ids stay outside of Python
        found = docs.select(F.col(id_col), F.explode(match(F.col(text_col))).alias("_m")).select(F.col(id_col), "_m.*")
        out = found if out is None else out.unionByName(found)
    return out


def _matches(shipped, similarity: float, hits: T.ArrayType):
    names = hits.elementType.names

    @F.pandas_udf(hits)
    def match(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(names, m, strict=True)) for m in shipped.value.match(text_words(t), similarity)] for t in texts], dtype=object)

    return match


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """`docs` without the documents that contain an item; a filter, without any shuffle."""
    for items in slices(benchmark, item_col, "text"):
        docs = docs.filter(~_dirty(docs.sparkSession.sparkContext.broadcast(items), similarity)(F.col(text_col)))
    return docs


def _dirty(shipped, similarity: float):
    @F.pandas_udf("boolean")
    def dirty(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(shipped.value.match(text_words(t), similarity)) for t in texts], dtype=bool)

    return dirty
