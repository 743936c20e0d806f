"""Toxicity: noisy-channel restoration of disguised words, then a linear score of the restored text.

A character language model (trigrams over letters, counted over all documents) and a channel (leetspeak, masked
letters, inserted separators, repeated letters, letters set apart by spaces) span a lattice over each suspicious
token of any length; Viterbi's best path over all states (the last two letters) restores it. Tokens that look
ordinary are taken as they are. What may stand for a letter at a token's ends is in the lattice too, and a digit may
stay a digit: the paths' scores decide, whatever the share of letters.

Words of the restored text and their prefixes are features. A bounded sample of labelled rows (SAMPLE, by hash
of the id, training rows only) selects FEATURES of them by the likelihood-ratio statistic of their document
counts and fits a logistic regression on them, by count and by density. All documents are scored, whole.

Defined results: null and empty texts get the score of a text without features; repeated rows get the same
score; without labels of both kinds all scores are 0; a label that is null is left out, and of several labels of
one id the largest holds; an empty table gives an empty result; other columns are ignored (kept by `clean`).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.langid import held_out

SAMPLE, FEATURES, LEAST_DOCUMENTS = 20_000, 3000, 4
PREFIXES = (3, 4, 5, 6, 7)
FIRST, MANY, CACHED_LENGTH, CACHED = -3.0, 24, 64, 500_000

# What the channel may have done to a letter.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
MASKS, SEPARATORS = "*#?", ".-_~'’·"
# Edges: what stands for no letter is cut off. What may stand for one can be dropped at a token's ends at a cost, low
# where writing puts such a sign. A digit may also stay, as a boundary, dearer beside letters; a mask or separator within
# may be dropped.
EDGE_BEFORE, EDGE_AFTER = "%&\"'“”‘’[{<>.,;:¿-_/\\=", "%&.,;:\"'“”‘’)]}<>-_/\\="
DROP_BEFORE, DROP_AFTER, DROP, DIGIT, BESIDE, WITHIN = {"(": 0.5, "¡": 0.5, "*": 2.0, "#": 2.0, "?": 0.5}, {"!": -2.0, "?": -4.0, "*": 3.5, "#": 3.5}, 5.0, float(np.log(10)), 2.0, 1.5
LETTERS = "abcdefghijklmnopqrstuvwxyz"
APART = re.compile(r"(?<!\S)(?:[^\W_][ .\-_*]{1,2}){3,}[^\W_](?!\w)")
# every match of APART holds this, which is found faster: its second and third letters
WITHIN_APART = re.compile(r"[ .\-_*][^\W_][ .\-_*]{1,2}[^\W_][ .\-_*]")
ODD = re.compile(r"[^\W\d_]")
REPEATED = re.compile(r"([^\W\d_])\1\1")
SUSPECT = re.compile(r"[0-9@$!|+(€£¡*#?.\-_~'’·]|([^\W\d_])\1\1")

_slots: dict = {}


def letter_slots() -> np.ndarray:
    """Slot of each code point in the character model: 0 for what isn't a letter; letters beyond Latin-1 share slots."""
    if "slots" not in _slots:
        t = np.zeros(0x110000, np.uint8)
        low = [c for c in range(256) if chr(c).isalpha() and chr(c).lower() == chr(c)]
        for i, c in enumerate(low):
            t[c] = 1 + i
        base = 1 + len(low)
        rest = [c for c in range(256, 0x110000) if not 0xD800 <= c <= 0xDFFF and chr(c).isalpha()]
        t[rest] = base + np.array(rest) % (128 - base)
        _slots["slots"] = t
    return _slots["slots"]


def trigrams(text: str | None) -> np.ndarray:
    """Codes of a text's trigrams over lower-case letters, with one boundary between words."""
    if not text:
        return np.empty(0, np.int32)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.zeros(len(codes) + 2, np.uint8)
    s[1:-1] = letter_slots()[codes]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] | s[:-1]) != 0
    s = s[keep].astype(np.int32)
    if len(s) < 3:
        return np.empty(0, np.int32)
    return (s[:-2] << 14) | (s[1:-1] << 7) | s[2:]

class Channel:
    """Restores tokens under a trigram model: table[code] is the log-probability of a trigram's last letter."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.codes, self.counts = codes, counts
        self.ready = False

    def _prepare(self) -> None:
        pair = np.zeros(1 << 14)
        np.add.at(pair, self.codes >> 7, self.counts)
        # steps[state << 7 | slot]: what a slot costs after a state (the last two letters' slots); a flat list is read fastest
        self.steps = steps = [-5.0] * (1 << 21)
        for p in np.flatnonzero(pair).tolist():
            steps[p << 7 : (p + 1) << 7] = [float(np.log(0.01 / (pair[p] + 1.28)))] * 128
        for code, s in zip(self.codes.tolist(), np.log((self.counts + 0.01) / (pair[self.codes >> 7] + 1.28)).tolist(), strict=True):
            steps[code] = s
        steps[:128] = [0.0] + [FIRST] * 127  # a word's first letter: trigrams begin at the boundary
        steps[:: 1 << 14] = [0.0] * 128  # boundaries are one
        self.restore = lru_cache(200_000)(self._restore)
        slots = letter_slots()
        self.slots = lru_cache(10_000)(lambda out: tuple(int(slots[ord(ch)]) for ch in out))
        self.letter, self.sign = lru_cache(10_000)(self._letter), lru_cache(10_000)(self._sign)
        self.dense: np.ndarray | None = None
        self.ready = True

    def __getstate__(self):
        return {"codes": self.codes, "counts": self.counts, "ready": False}

    def token(self, t: str) -> str:
        if not self.ready:
            self._prepare()
        # long tokens hardly recur: the cache's memory stays bounded
        return self.restore(t) if len(t) <= CACHED_LENGTH else self._restore(t)

    def _node(self, options: list[tuple[str, float]]) -> tuple[list[tuple[str, int, tuple[int, ...], float]], float]:
        """What a position may stand for: (output, its slot if it is one letter, else 0, its slots, cost) of each option, and the least cost."""
        slots = [self.slots(out) for out, _ in options]
        return [(out, zs[0] if len(zs) == 1 else 0, zs, cost) for (out, cost), zs in zip(options, slots, strict=True)], min(cost for _, cost in options)

    def _letter(self, c: str, n: int) -> tuple:
        """The node of a letter that stands n times, 3 for more."""
        return self._node([(c, 0.0)] if n == 1 else [(c + c, 0.0), (c, 1.0)] if n == 2 else [(c, 1.0), (c + c, 1.0)])

    def _sign(self, c: str, beside: int, before: bool, after: bool, paired: bool) -> tuple:
        """The node of what is no letter: a digit with `beside` letters beside it, or a sign at an edge, in a pair of them or within."""
        options = [(x, 1.0) for x in LEET.get(c, "")]
        if c in MASKS:
            options += [(x, 3.0) for x in LETTERS]
        if c.isdigit():
            options.append((c, DIGIT + BESIDE * beside))
        elif paired:
            options.append(("", 0.0))
        elif before or after:
            options.append(("", min([DROP_BEFORE.get(c, DROP)] * before + [DROP_AFTER.get(c, DROP)] * after) if c in LEET or c in MASKS else WITHIN))
        elif c in SEPARATORS or c in MASKS or not options:
            options.append(("", WITHIN))
        return self._node(options)

    def _lattice(self, token: str) -> list[tuple]:
        first = next((k for k, c in enumerate(token) if c.isalnum()), len(token))
        last = len(token) - next((k for k, c in enumerate(reversed(token)) if c.isalnum()), len(token))
        paired = 0 < first and last < len(token) and token[first - 1] == token[last] in MASKS  # emphasis
        lattice = []
        i = 0
        while i < len(token):
            c = token[i]
            if c.isalpha():
                j = i + 1
                while j < len(token) and token[j] == c:
                    j += 1
                lattice.append(self.letter(c, min(j - i, 3)))
                i = j
                continue
            beside = sum(x.isalpha() for x in token[max(i - 1, 0) : i + 2]) if c.isdigit() else 0
            before, after = i < first, i >= last
            lattice.append(self.sign(c, beside, before, after, paired and c == token[last] and (before or after)))
            i += 1
        return lattice

    def _restore(self, token: str) -> str:
        """The best path's letters (and digits that are best left as they are); the token itself if it holds no disguise."""
        if not SUSPECT.search(token):
            return token
        lattice = self._lattice(token)
        # up to the first choice there is one path
        begin = next((k for k, (options, _) in enumerate(lattice) if len(options) > 1), len(lattice))
        out = "".join([options[0][0] for options, _ in lattice[:begin]])
        if begin == len(lattice):
            return out
        state, score = self._only(lattice[:begin], 0, 0.0)
        lattice = lattice[begin:]
        # what is left costs this much at least: no step adds to a score
        rest = [0.0]
        for _, cost in reversed(lattice):
            rest.append(rest[-1] + cost)
        rest = rest[-2::-1]
        # a greedy search finds one whole path; in the full one only states that can't reach its score are left out
        at, s = self._only(lattice, state, score)
        chain = self._search(lattice, rest, {state: (score, None)}, s + self.steps[at << 7] - 0.01)
        pieces = []
        while chain:
            chain, piece = chain
            pieces.append(piece)
        return out + "".join(reversed(pieces))

    def _only(self, lattice: list, state: int, score: float) -> tuple[int, float]:
        """The state and score of the path that takes the best option at each position."""
        table = self.steps
        for options, _ in lattice:
            best, to = -np.inf, 0
            for _, z, zs, cost in options:
                if z:
                    at, s = (state & 127) << 7 | z, score - cost + table[state << 7 | z]
                else:
                    at, s = self._after(state, score - cost, zs)
                if s > best:
                    best, to = s, at
            state, score = to, best
        return state, score

    def _after(self, state: int, score: float, zs: tuple[int, ...]) -> tuple[int, float]:
        """The state and score after the slots of any output."""
        for z in zs:
            score += self.steps[state << 7 | z]
            if z or state & 127:
                state = (state & 127) << 7 | z
        return state, score

    def _search(self, lattice: list, rest: list[float], paths: dict[int, tuple[float, tuple | None]], floor: float) -> tuple | None:
        """The best path's outputs, as a chain back to the start. `paths`: of each state its best score, and its chain."""
        for (options, _), least in zip(lattice, rest, strict=True):
            paths = self._many(paths, options, floor + least) if len(paths) > MANY and len(options) > 4 else self._few(paths, options, floor + least)
        return max(((s + self.steps[state << 7], chain) for state, (s, chain) in paths.items()), key=lambda p: p[0])[1]

    def _few(self, paths: dict, options: list[tuple], least: float) -> dict:
        """The states after one position that score `least` at least, and the best path to each."""
        table = self.steps
        new: dict[int, tuple[float, tuple | None]] = {}
        for state, (score, chain) in paths.items():
            for out, z, zs, cost in options:
                if z:
                    at, s = (state & 127) << 7 | z, score - cost + table[state << 7 | z]
                else:
                    at, s = self._after(state, score - cost, zs)
                if s >= least and (at not in new or s > new[at][0]):
                    new[at] = (s, (chain, out) if out else chain)
        return new

    def _many(self, paths: dict, options: list[tuple], least: float) -> dict:
        """As _few, for many states and options of one letter at most: all steps of the states with one last letter at once."""
        if self.dense is None:
            self.dense = np.array(self.steps, np.float32).reshape(1 << 14, 128)
        single = [(out, z, cost) for out, z, _, cost in options if out]
        zs, costs = np.array([z for _, z, _ in single]), np.array([c for _, _, c in single])
        new = self._few(paths, [o for o in options if not o[0]], least)
        groups: dict[int, list[int]] = {}
        for state in paths:
            groups.setdefault(state & 127, []).append(state)
        for b, states in groups.items():
            s = np.array([paths[x][0] for x in states])[:, None] + self.dense[states][:, zs] - costs
            best = s.argmax(0)
            top = s.max(0)
            for k in np.flatnonzero(top >= least).tolist():
                out, z, _ = single[k]
                v, at = float(top[k]), b << 7 | z
                if at not in new or v > new[at][0]:
                    new[at] = (v, (paths[states[best[k]]][1], out))
        return new

    def word(self, t: str) -> str:
        """A lower-case token's restored word; empty if nothing is left."""
        if not t.isalpha():
            t = t.lstrip(EDGE_BEFORE).rstrip(EDGE_AFTER)
        return self.token(t) if not t.isalpha() or REPEATED.search(t) else t

    def words(self, text: str | None) -> Counter:
        """Counts of restored words."""
        out: Counter = Counter()
        for t, n in Counter(tokens(text)).items():
            if w := self.word(t):
                out[w] += n
        return out


def tokens(text: str | None) -> list[str]:
    """A text's lower-case tokens; letters set apart are one."""
    if not text:
        return []
    low = text.lower()
    if WITHIN_APART.search(low):
        low = APART.sub(lambda m: re.sub(r"[ .\-_*]", "", m[0]), low)
    return low.split()


def features(word: str) -> list[str]:
    return [word + "$", *[word[:k] for k in PREFIXES if len(word) > k]]


def fit_channel(docs: DataFrame, text_col: str = "text") -> Channel:
    """Trigram counts over every document: summed in each task first; at most 2^21 rows, so their number is bounded."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << 21, np.int64)
        waiting: list[np.ndarray] = []
        size = 0
        for p in parts:
            for t in p["_text"]:
                waiting.append(trigrams(t))
                size += len(waiting[-1])
                if size > 2_000_000:
                    total += np.bincount(np.concatenate(waiting), minlength=1 << 21)
                    waiting, size = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=1 << 21)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"code": at, "n": total[at]})

    sums = docs.select(F.col(text_col).alias("_text")).mapInPandas(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    return Channel(sums["code"].to_numpy(np.int64), sums["n"].to_numpy(np.float64))


class Model:
    """Feature weights (by log count, by density), the intercept, and the channel."""

    def __init__(self, channel: Channel, index: dict[str, int], weights: np.ndarray, bias: float):
        self.channel, self.index, self.weights, self.bias = channel, index, weights, bias
        self.heads = {f[:3] for f in index}
        self.cache: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return {**self.__dict__, "cache": {}}

    def places(self, token: str) -> tuple[int, ...]:
        """The features of a token's restored word; -1 alone if nothing is left of it."""
        w = self.channel.word(token)
        at = (-1,) if not w else tuple([self.index[f] for f in features(w) if f in self.index]) if (w + "$")[:3] in self.heads else ()
        if len(token) <= CACHED_LENGTH:
            if len(self.cache) >= CACHED:
                self.cache.clear()
            self.cache[token] = at
        return at

    def vector(self, text: str | None) -> tuple[dict[int, int], int]:
        found: dict[int, int] = {}
        every = tokens(text)
        get = self.cache.get
        for t, n in Counter(every).items():
            at = get(t)
            if at is None:
                at = self.places(t)
            for k in at:
                found[k] = found.get(k, 0) + n
        return found, len(every) - found.pop(-1, 0)

    def score(self, text: str | None) -> float:
        if not self.index:
            return 0.0
        found, total = self.vector(text)
        if not found:
            return float(1 / (1 + np.exp(-self.bias)))
        k = np.fromiter(found, np.int64, len(found))
        z = float((values(np.fromiter(found.values(), float, len(found)), total) * self.weights[:, k]).sum()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def values(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    return np.stack((np.log1p(counts) * 0.5, 4 * counts / np.sqrt(total + 20.0)))


def _statistic(a: np.ndarray, b: np.ndarray, pos: int, neg: int) -> np.ndarray:
    """Likelihood ratio of document counts, negative where a feature is rarer in positive documents."""
    def part(x, n, m):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-9) * (pos + neg) / (n * m)), 0)
    n = a + b
    g = 2 * (part(a, n, pos) + part(b, n, neg) + part(pos - a, pos + neg - n + 1e-9, pos) + part(neg - b, pos + neg - n + 1e-9, neg))
    return np.where(a * neg > b * pos, g, -g)


def regress(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, width: int, steps: int = 400, penalty: float = 2e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows; full-batch Adam, so that reruns agree."""
    w, bias = np.zeros((2, width)), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    balance = np.where(y > 0, 1.5, 1.0)
    for t in range(1, steps + 1):
        z = bias + np.bincount(rows, (vals * w[:, cols]).sum(0), len(y))
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * balance / len(y)
        g = np.stack([np.bincount(cols, vals[i] * e[rows], width) for i in (0, 1)]) + penalty * w
        gb = float(e.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.1 * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= 0.1 * (mb / a) / (vb**0.5 / b**0.5 + 1e-8)
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", channel: Channel | None = None) -> Model:
    """Fit on at most SAMPLE labelled training rows; only these rows' texts and labels are looked at."""
    spark = docs.sparkSession
    channel = channel or fit_channel(docs, text_col)
    ids = labels.filter(~held_out(id_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_y"))
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(ids), "_id").select("_text", "_y")
    shipped = spark.sparkContext.broadcast(channel)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        neg, pos = c = Counter(), Counter()
        for p in parts:
            for t, y in zip(p["_text"], p["_y"], strict=True):
                c[y].update({f for w in shipped.value.words(t) for f in features(w)})
        yield pd.DataFrame([(f, pos[f], neg[f]) for f in neg.keys() | pos.keys()], columns=["f", "pos", "neg"])

    # rows are counted apart, without their texts, so that the texts are decoded once for their features
    number = {r["_y"]: r["count"] for r in sample.groupBy("_y").count().collect()}
    pos, neg = number.get(1, 0), number.get(0, 0)
    if not pos or not neg:
        return Model(channel, {}, np.zeros((2, 0)), -30.0)
    sums = sample.mapInPandas(count, "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    found = sums.filter(F.col("pos") >= LEAST_DOCUMENTS)
    # a feature must at least be as common in positive documents before its statistic is worth sending
    rated = found.filter(F.col("pos") * neg > F.col("neg") * pos * 2).withColumn("lift", F.col("pos") * F.log((F.col("pos") / pos) / ((F.col("neg") + 0.5) / neg)))
    table = rated.orderBy(F.desc("lift"), "f").limit(4 * FEATURES).toPandas()
    g = _statistic(table["pos"].to_numpy(float), table["neg"].to_numpy(float), pos, neg)
    best = np.argsort(-g, kind="stable")[:FEATURES]
    index = {f: i for i, f in enumerate(table["f"].to_numpy()[best][g[best] > 6])}
    model = Model(channel, index, np.zeros((2, len(index))), 0.0)
    sent = spark.sparkContext.broadcast(model)

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            v = [sent.value.vector(t) for t in p["_text"]]
            yield pd.DataFrame({"k": [list(x[0]) for x in v], "c": [list(x[0].values()) for x in v], "n": [x[1] for x in v], "y": p["_y"]})

    rows = sample.mapInPandas(encode, "k array<int>, c array<int>, n long, y int").toPandas()  # at most SAMPLE rows
    size = rows["k"].map(len).to_numpy()
    r = np.repeat(np.arange(len(rows)), size)
    k = np.concatenate([*rows["k"], np.empty(0, int)]).astype(np.int64)
    c = np.concatenate([*rows["c"], np.empty(0, int)]).astype(float)
    model.weights, model.bias = regress(r, k, values(c, rows["n"].to_numpy(float)[r]), rows["y"].to_numpy(float), len(index))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and predicted of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        return pd.Series([shipped.value.score(t) for t in texts], dtype=float)

    s = docs.select(F.col(id_col), rate(F.col(text_col)).alias("score"))
    return s.select(id_col, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """`docs` without toxic documents: a filter, without any shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        return pd.Series([shipped.value.score(t) for t in texts], dtype=float)

    return docs.filter(rate(F.col(text_col)) < threshold)
