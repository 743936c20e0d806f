"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +-1; a trigram's vector binds its letters' vectors, each rolled by its place
(a product), and a text's vector bundles those of its trigrams (a sum). A language's prototype bundles its
training texts. A text gets the language whose prototype has the largest cosine with it.

Each letter of Unicode has its own vector, drawn from the seed and its code point. A text is encoded whole: its
distinct trigrams in chunks, so memory doesn't follow its length. A model is one vector (4 KB) per language; the
driver holds it.

Defined results: null texts and texts without a letter get UND and score 0; repeated rows get the same result;
without any training text all get UND; an empty table gives an empty result; ties go to the language that is
first by code point; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UND = "und"
FOUND = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
DIMENSIONS, SEED, CHUNK, CACHED = 512, 7, 16_384, 32_768
#: bits of a code point
WIDTH = 21

_tables: dict = {}


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if "letters" not in _tables:
        _tables["letters"] = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _tables["letters"]


def trigrams(text: str | None) -> np.ndarray:
    """Codes of a text's trigrams over lower-case letters (three code points each), with one boundary, 0, between words."""
    if not text:
        return np.empty(0, np.int64)
    s = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.concatenate(([0], np.where(letters()[s], s, 0).astype(np.int64), [0]))
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    s = s[keep]
    if len(s) < 3:
        return np.empty(0, np.int64)
    return (s[:-2] << 2 * WIDTH) | (s[1:-1] << WIDTH) | s[2:]


class Space:
    """Trigram vectors, made on demand; the first CACHED of them are kept. Every letter of Unicode has a vector of its own, drawn from its code point."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.d, self.seed = dimensions, seed
        self.letter: dict[int, np.ndarray] = {}
        self.codes, self.at = np.empty(0, np.int64), np.empty(0, np.int64)  # sorted codes, and their rows
        self.rows = np.empty((0, dimensions), np.float32)

    def _letters(self, points: np.ndarray, shift: int) -> np.ndarray:
        distinct, back = np.unique(points, return_inverse=True)
        for c in distinct.tolist():
            if c not in self.letter:
                self.letter[c] = np.random.default_rng([self.seed, c]).integers(0, 2, self.d).astype(np.float32) * 2 - 1
        return np.roll(np.array([self.letter[c] for c in distinct.tolist()]), shift, 1)[back]

    def make(self, codes: np.ndarray) -> np.ndarray:
        mask = (1 << WIDTH) - 1
        return self._letters(codes >> 2 * WIDTH, 2) * self._letters(codes >> WIDTH & mask, 1) * self._letters(codes & mask, 0)

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """Of distinct codes."""
        if not len(codes):
            return np.empty((0, self.d), np.float32)
        k = np.minimum(np.searchsorted(self.codes, codes), max(len(self.codes) - 1, 0))
        known = self.codes[k] == codes if len(self.codes) else np.zeros(len(codes), bool)
        if known.all():
            return self.rows[self.at[k]]
        out = np.empty((len(codes), self.d), np.float32)
        out[known] = self.rows[self.at[k[known]]] if known.any() else 0
        out[~known] = new = self.make(codes[~known])
        if len(self.codes) + len(new) <= CACHED:
            every = np.concatenate((self.codes, codes[~known]))
            order = np.argsort(every)
            self.at = np.concatenate((self.at, np.arange(len(self.rows), len(self.rows) + len(new))))[order]
            self.codes, self.rows = every[order], np.concatenate((self.rows, new))
        return out

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(self.d, np.float32)
        for i in range(0, len(codes), CHUNK):
            out += counts[i : i + CHUNK].astype(np.float32) @ self.vectors(codes[i : i + CHUNK])
        return out


def space() -> Space:
    if "space" not in _tables:
        _tables["space"] = Space()
    return _tables["space"]


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def _profiles(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task and language, the bundle of its texts: trigrams are counted first and bundled once."""
    sums: dict[str, np.ndarray] = {}
    waiting: dict[str, list[np.ndarray]] = {}
    size = 0

    def settle() -> None:
        for lang, found in waiting.items():
            codes, counts = np.unique(np.concatenate(found), return_counts=True)
            b = np.zeros(DIMENSIONS)
            for i in range(0, len(codes), CHUNK):
                b += counts[i : i + CHUNK].astype(np.float64) @ space().vectors(codes[i : i + CHUNK])
            sums[lang] = sums.get(lang, 0) + b
        waiting.clear()

    for p in parts:
        for text, lang in zip(p["text"], p["lang"], strict=True):
            t = trigrams(text)
            if len(t):
                waiting.setdefault(lang, []).append(t)
                size += len(t)
            if size > 4_000_000:
                settle()
                size = 0
    settle()
    if sums:
        yield pd.DataFrame({"lang": list(sums), "v": [v.tolist() for v in sums.values()]})


def fit(training: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes, of length 1, from all rows with text and language. The driver gets one vector per language."""
    rows = training.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    parts = rows.mapInPandas(_profiles, "lang string, v array<double>")
    sums = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    whole = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).collect()  # a row per language
    out = {}
    for r in sorted(whole, key=lambda r: r["lang"]):
        v = np.array([c["x"] for c in r["v"]])
        out[r["lang"]] = v / max(np.linalg.norm(v), 1e-12)
    return out


def identify(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score (the cosine, at least 0) of every row."""
    names, matrix = list(model), np.array(list(model.values()), np.float32)

    def one(text: str | None) -> tuple[str, float]:
        codes, counts = np.unique(trigrams(text), return_counts=True)
        if not len(codes) or not names:
            return UND, 0.0
        b = space().bundle(codes, counts)
        cos = matrix @ b / max(float(np.linalg.norm(b)), 1e-12)
        k = int(np.argmax(cos))
        return names[k], float(min(max(cos[k], 0.0), 1.0))

    @F.pandas_udf(FOUND)
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=FOUND.names)

    # ids stay outside of Python
    return docs.select(F.col(id_col), found(F.col(text_col)).alias("_f")).select(F.col(id_col), "_f.lang_pred", "_f.score")
