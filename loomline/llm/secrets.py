"""Secrets in texts: known forms by pattern, and others by tests for randomness.

Candidates are runs of at least ``SHORTEST`` characters of encoded data. The encoding is inferred
from the characters present (hexadecimal, base32, base36 in one case, base64). Under a random key
each character of that alphabet is as likely as any other and independent of its neighbours, which
three tests check: chi-squared for uniform use of the alphabet, runs above and below its middle,
and serial correlation of neighbours. Fisher's method combines the three p-values.

Short strings give the tests little to go by, so ordinary words can pass. Passing is therefore
judged against decoys: for each candidate, as many characters of its alphabet from the running text
around it, other candidates left out. Decoys keep their own statistics and pass through the same
steps as candidates, so only those count that would be candidates of that encoding. For each encoding
and class of lengths, the share of decoys that reach a score estimates the false discoveries among
the candidates that reach it; the lowest score whose estimate stays within ``FALSE_DISCOVERIES`` is
that class's threshold, and a class whose decoys allow none reports nothing. A class with too few
decoys to show that rate takes the threshold of the nearest length that has enough, or else
``LEAST_P``, which is also the least p-value that any class reports: of random keys it loses that
share. Counts are of distinct candidates and distinct decoys, summed in a table of bounded size
(encodings x lengths x score bins).

Defined cases: a null text is empty and has no spans; spans are in code points, end exclusive;
equal spans of several kinds are all listed; repeated rows are scanned alike; an empty table gives
an empty table; other columns are passed through, columns named like the results are replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import slices

#: The known forms. A match of too few characters is dropped, after it was matched.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

SHORTEST = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % SHORTEST)
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
NOT_IN = {name: re.compile(f"[^{re.escape(a)}]+") for name, a in ALPHABETS.items()}
PLACES = {name: np.array([{c: i for i, c in enumerate(a)}.get(chr(b), -1) for b in range(128)], np.int64) for name, a in ALPHABETS.items()}
SIZES = {name: min(64, len(a)) for name, a in ALPHABETS.items()}
LENGTHS = [20, 24, 28, 32, 40, 48, 64, 96, 1 << 30]
FALSE_DISCOVERIES = 0.02
LEAST_P = 0.01
#: Running text searched on each side of a candidate for its decoy, in candidates' lengths.
NEAR = 16
BINS = 40
ROWS = 500


def known(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of the known forms."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return out + [(*m.span(), "hex") for m in HEX.finditer(text)]


def encoding(run: str) -> str | None:
    """The smallest alphabet that has all characters of a run; None for letters of one kind only."""
    body = run.rstrip("=")
    if not any(c.isdigit() for c in body) and (body.isalpha() and (body[1:].islower() or body.isupper())):
        return None
    present = set(body)
    return next((name for name, a in ALPHABETS.items() if present <= set(a)), None)


@lru_cache(maxsize=4096)
def _upper_gamma(half: float, x: float) -> float:
    """Upper tail of the gamma distribution with shape ``half``, by series or continued fraction."""
    if x <= 0:
        return 1.0
    log = half * math.log(x) - x - math.lgamma(half)
    if x < half + 1:
        term = total = 1.0 / half
        k = half
        while term > total * 1e-12:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * math.exp(log))
    b, c = x + 1 - half, 1e300
    d = h = 1 / b
    for i in range(1, 300):
        a = -i * (i - half)
        b += 2
        d = 1 / (a * d + b)
        c = b + a / c
        h *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return min(1.0, math.exp(log) * h)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def randomness(run: str, name: str) -> float:
    """Combined p-value of the three tests that ``run`` is random in its encoding; 0 if it cannot be."""
    size = SIZES[name]
    v = PLACES[name][np.frombuffer(run.rstrip("=").encode(), np.uint8)]
    v = np.where(v >= size, v - 2, v)
    n = len(v)
    if n < SHORTEST or v.min() < 0:
        return 0.0
    counts = np.bincount(v, minlength=size)
    # With few characters for many cells the statistic is not chi-squared; neighbours share cells then.
    cells = max(2, min(size, n // 5))
    folded = np.bincount(np.arange(size) * cells // size, counts, cells)
    expected = np.bincount(np.arange(size) * cells // size, minlength=cells) * n / size
    uniform = _upper_gamma((cells - 1) / 2, round(float(((folded - expected) ** 2 / expected).sum()) / 2, 6))
    high = v * 2 >= size
    up = int(high.sum())
    down = n - up
    if not up or not down:
        return 0.0
    mean = 2 * up * down / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    runs = _two_sided((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(spread)) if spread > 0 else 0.0
    centred = v - v.mean()
    power = float((centred**2).sum())
    serial = _two_sided((float((centred[1:] * centred[:-1]).sum()) / power + 1 / n) * math.sqrt(n)) if power else 0.0
    # Repeats of few letters are what words and numbers have and random strings lack.
    total = -sum(math.log(max(p, 1e-300)) for p in (uniform, runs, serial))
    return _upper_gamma(3.0, round(total, 6))


def _bin(p: float) -> int:
    """0 for the least random up to BINS - 1; finer where p is small."""
    return max(0, min(BINS - 1, BINS - 1 + int(math.log10(max(p, 1e-300)) * 4)))


def _length_class(n: int) -> int:
    return next(i for i, edge in enumerate(LENGTHS[1:]) if n < edge)


def candidates(text: str) -> list[tuple[int, int, str, int, int]]:
    """start, end, encoding, class of length and score bin of each run that could be encoded data."""
    out = []
    for m in CANDIDATE.finditer(text):
        if name := encoding(m[0]):
            out.append((*m.span(), name, _length_class(m.end() - m.start()), _bin(randomness(m[0], name))))
    return out


def decoy(text: str, start: int, end: int, name: str) -> str:
    """As many characters of an alphabet, in its case, from the text after (or before) a candidate as it has characters."""
    need = end - start

    def fitting(part: str) -> str:
        part = part.encode("ascii", "ignore").decode()
        return NOT_IN[name].sub("", part.upper() if name in ("HEX", "base32", "BASE36") else part.lower() if name in ("hex", "base36") else part)

    after = fitting(text[end : end + NEAR * need])
    return (after if len(after) >= need else after + fitting(text[max(0, start - NEAR * need) : start]))[:need]


def _without(text: str, spans: list) -> str:
    """The text with blanks for the spans."""
    parts, at = [], 0
    for start, end, *_ in spans:
        parts += [text[at:start], " " * (end - start)]
        at = end
    return "".join([*parts, text[at:]])


def _digest(name: str, run: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{name} {run}".encode(), digest_size=8).digest(), "big", signed=True)


def counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """encoding, length, score, decoy and n: how many distinct candidates and decoys got each score."""
    schema = "encoding string, length int, score int, decoy boolean, run long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            rows = []
            for t in batch.column(0).to_pylist():
                spans = candidates(t or "")
                rest = _without(t, spans) if spans else ""
                for start, end, name, length, score in spans:
                    rows.append((name, length, score, False, _digest(name, t[start:end])))
                    other = decoy(rest, start, end, name)
                    # Of the candidate's length: shorter ones pass more easily.
                    if len(other) == end - start and encoding(other) == name:
                        rows.append((name, length, _bin(randomness(other, name)), True, _digest(name, other)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()), strict=True)], names=["encoding", "length", "score", "decoy", "run"])

    scored = documents.select(F.col(f"`{text}`").alias("t")).mapInArrow(run, schema)
    return scored.distinct().groupBy("encoding", "length", "score", "decoy").agg(F.count("*").alias("n"))


def thresholds(table: list[tuple[str, int, int, bool, int]], rate: float = FALSE_DISCOVERIES) -> dict[tuple[str, int], int]:
    """The lowest score of each encoding and length whose estimated false discoveries stay within ``rate``."""
    found: dict[tuple[str, int], int] = {}
    for key in {(e, n) for e, n, *_ in table}:
        real, fake = np.zeros(BINS), np.zeros(BINS)
        for e, n, score, is_decoy, count in table:
            if (e, n) == key:
                (fake if is_decoy else real)[score] += count
        if not fake.sum():
            continue
        above_real = np.cumsum(real[::-1])[::-1]
        above_fake = np.cumsum(fake[::-1])[::-1] * (real.sum() / fake.sum())
        for score in range(BINS):
            if above_real[score] and above_fake[score] <= rate * above_real[score]:
                found[key] = score
                break
    return found


def limits(table: list[tuple[str, int, int, bool, int]], rate: float = FALSE_DISCOVERIES) -> dict[tuple[str, int], int]:
    """The lowest score that each encoding and length reports: by its decoys, or by what stands in where they are too few."""
    least, own = _bin(LEAST_P) + 1, thresholds(table, rate)
    decoys: dict[tuple[str, int], int] = {}
    for e, n, _, is_decoy, count in table:
        decoys[e, n] = decoys.get((e, n), 0) + is_decoy * count
    found = {}
    for e, n in decoys:
        enough = [m for f, m in decoys if f == e and decoys[f, m] * rate >= 1]
        nearest = min(enough, key=lambda m: (abs(m - n), m), default=None)
        found[e, n] = least if nearest is None else max(least, own.get((e, nearest), BINS))
    return found


def scan(documents: DataFrame, rate: float = FALSE_DISCOVERIES, text: str = "text") -> DataFrame:
    """``documents`` with found: an array of (kind, start, end) ordered by start, then by kind."""
    lowest = limits([tuple(r) for r in counts(documents, text).collect()], rate)  # of bounded size
    passed = [f for f in documents.schema.fields if f.name.lower() != "found"]
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([*passed, T.StructField("found", T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    rank = {k: i for i, k in enumerate(KINDS)}

    def of(t: str | None) -> list[dict]:
        t = t or ""
        spans = known(t)
        spans += [(start, end, "random") for start, end, name, length, score in candidates(t) if score >= lowest.get((name, length), BINS)]
        spans.sort(key=lambda s: (s[0], rank[s[2]]))
        return [{"kind": k, "start": a, "end": b} for a, b, k in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            made = pa.array([of(t) for t in batch.column(len(passed)).to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(passed)], made], names=schema.names)

    return documents.select(*(f"`{f.name}`" for f in passed), F.col(f"`{text}`").alias("_text")).mapInArrow(run, schema)
