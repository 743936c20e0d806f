"""Secret scans: base patterns, and a battery of randomness tests on other tokens.

Base kinds are found by pattern alone. Any other run of 20 or more key characters outside them is tested; '=' only
belongs to its end, as padding. A run that mixes the signs of base64 and base64url is tested by its pieces of either,
which may overlap. A token's encoding (base32, base64 or letters and digits) is inferred, then three tests ask whether
it could be drawn evenly from that alphabet: chi-squared of the characters, the number of runs about the median, and the
correlation of neighbours. Fisher's sum joins their p-values. Of those that pass, the evidence against ordinary
text is the likelihood ratio of the even alphabet to the corpus's own characters (counted over all documents);
it is an e-value, and per class of length the e-values above the step-up bound at level ALPHA are kept, which
holds the false-discovery rate under any dependence.

Defined results: a null text counts as empty; empty texts and tables have no spans; repeated rows get the same
result (each counts in the corpus); offsets count code points, the end is exclusive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
# '=' is padding at the end of a run; elsewhere it parts a name from a value
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{14,}(?:={1,6}(?![A-Za-z0-9+/_=-]))?")
PIECES = re.compile(r"[A-Za-z0-9+/]{14,}=*"), re.compile(r"[A-Za-z0-9_-]{14,}=*")
LEAST_LENGTH = 20
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")
MIN_ASSIGN = 12
LENGTHS = (20, 24, 32, 48, 96)  # lower ends of the classes of length
ALPHA, LEAST_P, MOST_BITS = 0.01, 1e-3, 1024

ALPHABETS = {
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_SETS = {k: frozenset(v) for k, v in ALPHABETS.items()}
#: evidence of a token that fails the battery
FAILED = -1000
_COUNTS = [T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")]
FOUND = T.StructType([*_COUNTS, T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_random", T.LongType())])


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base kinds."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def encoding(token: str) -> str | None:
    """The narrowest alphabet that has all of the token's characters (padding aside)."""
    found = set(token.rstrip("="))
    return next((k for k, s in _SETS.items() if found <= s), None)


def _tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(token: str, kind: str) -> float:
    """The joint p-value of the three tests: small if the token isn't an even draw from the alphabet."""
    alphabet = ALPHABETS[kind]
    x = np.array([alphabet.index(c) for c in token.rstrip("=")], float)
    n, k = len(x), len(alphabet)
    counts = np.bincount(x.astype(int), minlength=k)
    chi = float(((counts - n / k) ** 2).sum() * k / n)
    # Wilson and Hilferty's cube root; only an uneven spread counts against the token
    z = ((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    p_chi = 0.5 * math.erfc(z / math.sqrt(2))
    high = x >= k / 2
    a, b = int(high.sum()), int(n - high.sum())
    if not a or not b:
        return 0.0
    runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 1 + 2 * a * b / n
    var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
    d = x - x.mean()
    r = float((d[1:] * d[:-1]).sum() / max((d * d).sum(), 1e-9))
    s = -2 * sum(math.log(max(p, 1e-300)) for p in (p_chi, _tail((runs - mean) / math.sqrt(var)), _tail((r + 1 / n) * math.sqrt(n))))
    return math.exp(-s / 2) * (1 + s / 2 + s * s / 8)  # chi-squared with 6 degrees


def length_class(n: int) -> int:
    return sum(n >= x for x in LENGTHS) - 1


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """Runs of key characters; of one that no alphabet has whole, its longest pieces of base64 and of base64url."""
    for m in TOKEN.finditer(text):
        if m.end() - m.start() < LEAST_LENGTH:
            continue
        if encoding(m[0]):
            yield m.span()
        else:
            yield from sorted({(m.start() + p.start(), m.start() + p.end()) for pattern in PIECES for p in pattern.finditer(m[0]) if p.end() - p.start() >= LEAST_LENGTH})


def candidates(text: str, base: list, bits: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start, end, class of length, evidence in bits) of tokens outside the base spans; FAILED for those that fail the battery."""
    out = []
    for start, end in tokens(text):
        if any(s < end and start < e for s, _, e in base):
            continue
        token = text[start:end]
        kind = encoding(token)
        if kind is None:
            continue
        if battery(token, kind) < LEAST_P:
            out.append((start, end, length_class(len(token)), FAILED))
            continue
        x = np.frombuffer(token.rstrip("=").encode(), np.uint8)
        e = float(-np.log2(len(ALPHABETS[kind])) * len(x) - bits[x].sum())
        out.append((start, end, length_class(len(token)), int(max(-64, min(MOST_BITS, math.floor(e))))))
    return out


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def character_bits(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log2 of the share of each ASCII character among the corpus's key characters, over all documents."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(128, np.int64)
        for p in parts:
            for t in p["_text"]:
                total += np.bincount(np.frombuffer(t.encode("ascii", "ignore"), np.uint8), minlength=128)
        yield pd.DataFrame({"c": np.arange(128), "n": total})

    counts = np.zeros(128)
    for r in _texts(docs, text_col).mapInPandas(run, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect():  # 128 rows
        counts[r["c"]] = r["n"]
    keys = np.array([chr(i) in "+/_=-" or chr(i).isalnum() for i in range(128)])
    counts = np.where(keys, counts + 1, 0)
    return np.log2(np.where(keys, counts, 1) / counts.sum())


def bounds(docs: DataFrame, bits: np.ndarray, text_col: str = "text", alpha: float = ALPHA) -> list[int]:
    """Per class of length the least evidence that is kept: the largest k with e_(k) >= m / (k alpha).

    m counts every token that was tested, also those that the battery rejects: their e-value is the likelihood ratio
    times an indicator that is 0, which is at most the ratio, so the control holds for the two tests together.
    """
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[int, int], int] = {}
        for p in parts:
            for t in p["_text"]:
                for _, _, c, e in candidates(t, base_spans(t), bits):
                    seen[c, e] = seen.get((c, e), 0) + 1
        yield pd.DataFrame([(c, e, n) for (c, e), n in seen.items()], columns=["c", "e", "n"]).astype("int64")

    rows = _texts(docs, text_col).mapInPandas(run, "c long, e long, n long").groupBy("c", "e").agg(F.sum("n").alias("n")).collect()  # at most classes x bits
    out = []
    for c in range(len(LENGTHS)):
        mine = sorted(((r["e"], r["n"]) for r in rows if r["c"] == c), reverse=True)
        m, above, least = sum(n for _, n in mine), 0, MOST_BITS + 1
        for e, n in mine:
            above += n
            if e > FAILED and e >= math.log2(m / (above * alpha)):
                least = e
        out.append(least)
    return out


def _join(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans and n_random of every row."""
    bits = character_bits(docs, text_col)
    least = bounds(docs, bits, text_col)
    def one(text: str) -> tuple:
        base = base_spans(text)
        more = [(s, "random", e) for s, e, c, x in candidates(text, base, bits) if x > FAILED and x >= least[c]]
        every = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[1])))
        kinds = [k for _, k, _ in base]
        return (*map(kinds.count, KINDS[:3]), hashlib.sha256(_join(base).encode()).hexdigest(), _join(every), len(more))

    @F.pandas_udf(FOUND)
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=FOUND.names)

    # ids stay outside of Python
    return docs.select(F.col(id_col), found(F.coalesce(F.col(text_col), F.lit(""))).alias("_f")).select(F.col(id_col), *[F.col(f"_f.{c}") for c in FOUND.names])
