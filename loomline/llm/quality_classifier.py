"""Quality scores learned from pairs: Bradley-Terry ranking with logistic loss on feature differences.

Every text becomes a vector of statistics of the text alone. Training draws preference pairs (a
document labelled 1 before one labelled 0) from the labelled rows and minimises
log(1 + exp(-w (x1 - x0))) with a ridge term, by Newton steps on the pairs' differences. A
document's strength is w x; the threshold is the quantile of the training strengths at which the
labelled share of 0 lies below, and a logistic curve through it turns strengths into scores, so
that the threshold has the score ``CUT``.

Training uses every labelled row outside the held-out fold. Rows are dealt by a hash of the id into
buckets of about ``BUCKET`` rows (larger where one label is rare) and paired within them,
``PAIRS_A_ROW`` times each; each Newton step adds up the buckets' gradients in tasks. Centre, scale
and threshold are those of all rows; no task or driver holds more than a bucket, or sums.

Defined cases: a null or empty text has the vector of zero counts and is scored like others; rows
with a null id are scored and never train; repeated rows get equal scores; labels that are null
or other than 0 and 1, or without a document, are left out; if one of the two labels is missing,
every score is 1.0 (nothing to tell apart); an empty table gives an empty table; other columns
are passed through and columns named like the results replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import dropped, slices, stored

BUCKET, PAIRS_A_ROW, RIDGE, STEPS, SETTLED = 4_000, 10, 1e-3, 12, 1e-7
LEAST_RARE, BINS, FEW_VALUES = 20, 1_000, 10_000
CUT, FOLDS, SEED = 0.3, 5, 20240607
ROWS = 500
SYMBOLS = str.maketrans("", "", "#*$%&|<>")
UPPER, DIGITS = re.compile("[A-Z]+"), re.compile("[0-9]+")
FEATURES = ["words", "word_length", "symbols", "bars", "capitals", "digits", "exclamations", "stops", "distinct", "repeats", "dup_lines", "line_length", "ends", "short", "compression"]


def vector(text: str | None) -> list[float]:
    """The statistics of a text, each on a scale of about 1."""
    text = text or ""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, chars, rows = len(words), len(text), len(lines)

    def root(part: float, of: float, prior: float) -> float:
        return (part / (of + prior)) ** 0.5

    letters = sum(map(len, words))
    stops = text.count(".") + text.count(",")
    ended = sum(x.rstrip()[-1] in ".!?" for x in lines)
    pairs = len(set(zip(words, words[1:], strict=False)))
    packed = len(zlib.compress(text.encode(), 1)) if text else 0
    return [
        np.log1p(n) / 5,
        (letters + 50.0) / (n + 10.0) / 5,
        root(chars - len(text.translate(SYMBOLS)), chars, 50),
        root(text.count("|"), n, 10),
        root(sum(map(len, UPPER.findall(text))), chars, 50),
        root(sum(map(len, DIGITS.findall(text))), chars, 50),
        root(text.count("!"), n, 10),
        root(stops, n, 10),
        len(set(words)) / (n + 10.0),
        root(max(0, n - 1 - pairs), n, 10),
        root(rows - len(set(lines)), rows, 2),
        np.log1p(chars / (rows + 1.0)) / 5,
        ended / (rows + 1.0),
        1.0 / (1.0 + n / 10.0),
        (packed + 50.0) / (len(text.encode()) + 100.0),
    ]


def expanded(x: np.ndarray) -> np.ndarray:
    """Vectors with their squares and a soft step, so that a linear strength can bend."""
    return np.concatenate([x, x * x, np.tanh(4 * x)], axis=1)


class Ranking:
    """Fitted weights, threshold and slope."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, weights: np.ndarray, threshold: float):
        self.centre, self.scale, self.weights, self.threshold = centre, scale, weights, threshold

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return (expanded(x) - self.centre) / self.scale @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        at = self.strengths(x) - self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(at, -500, 500)))


def _summed(rows: DataFrame, of, width: int) -> np.ndarray:
    """The sum over all rows of ``of(y, x, bucket)``, a vector of ``width`` numbers for each bucket; one vector a task comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for row in batch.to_pylist():
                total += of(np.array(row["y"]), np.array(row["x"]), row["bucket"])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["v"])

    parts = rows.select("bucket", "y", "x").mapInArrow(run, "v array<double>").toPandas()["v"]
    return np.sum(np.array(parts.tolist()).reshape(-1, width), axis=0)


def _ranked(values: DataFrame, place: int) -> float:
    """The value (column s) at ``place`` of all in ascending order, by counts in ever narrower bins."""
    before = 0
    while True:
        n, low, high = values.agg(F.count("*"), F.min("s"), F.max("s")).first()
        if low == high:
            return low
        if n <= FEW_VALUES:
            return sorted(r.s for r in values.collect())[place - before]
        bin_of = F.least(F.floor((F.col("s") - low) / ((high - low) / BINS)), F.lit(BINS - 1))
        for r in sorted(values.groupBy(bin_of.alias("b")).count().collect()):
            if place < before + r["count"]:
                values = values.where(bin_of == r["b"])
                break
            before += r["count"]


def fit(buckets: DataFrame) -> Ranking | None:
    """A ranking of all rows of ``buckets`` (bucket, y and x, arrays of labels and vectors); None unless both labels occur."""
    width = 3 * len(FEATURES)

    def moments(y: np.ndarray, x: np.ndarray, bucket: int) -> np.ndarray:
        z = expanded(x)
        return np.concatenate([[len(y), y.sum()], z.sum(axis=0), (z * z).sum(axis=0)])

    sums = _summed(buckets, moments, 2 + 2 * width)
    n, good = int(sums[0]), int(sums[1])
    if not good or good == n:
        return None
    centre = sums[2 : 2 + width] / n
    scale = np.sqrt(np.maximum(sums[2 + width :] / n - centre**2, 0)) + 1e-3
    w = np.zeros(width)
    for _ in range(STEPS):

        def slopes(y: np.ndarray, x: np.ndarray, bucket: int, w: np.ndarray = w) -> np.ndarray:
            ones, zeros = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
            if not len(ones) or not len(zeros):
                return np.zeros(1 + width + width * width)
            z = (expanded(x) - centre) / scale
            rng = np.random.default_rng([SEED, bucket])
            # Every row is in as many pairs, with any rows of the other label.
            first = np.concatenate([np.repeat(ones, PAIRS_A_ROW), rng.choice(ones, PAIRS_A_ROW * len(zeros))])
            second = np.concatenate([rng.choice(zeros, PAIRS_A_ROW * len(ones)), np.repeat(zeros, PAIRS_A_ROW)])
            difference = z[first] - z[second]
            p = 1 / (1 + np.exp(np.clip(difference @ w, -500, 500)))  # of the pair's other order
            hessian = (difference * (p * (1 - p))[:, None]).T @ difference
            return np.concatenate([[len(first)], -difference.T @ p, hessian.ravel()])

        sums = _summed(buckets, slopes, 1 + width + width * width)
        pairs = max(1.0, sums[0])
        gradient = sums[1 : 1 + width] / pairs + RIDGE * w
        step = np.linalg.solve(sums[1 + width :].reshape(width, width) / pairs + RIDGE * np.eye(width), gradient)
        w = w - step
        if np.abs(step).max() < SETTLED:
            break
    ranking = Ranking(centre, scale, w, 0.0)

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(ranking.strengths(np.array(x)), pa.float64())], names=["s"])

    values = stored(buckets.select("x").mapInArrow(strengths, "s double"), "strengths")
    ranking.threshold = _ranked(values, n - good)
    dropped(values)
    return ranking


def held_out(doc_id: Column) -> Column:
    """Whether a row is in the fold that never trains."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == 0


def train(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Ranking | None:
    """Fit on all labelled rows outside the held-out fold. Texts become vectors where they are read; only vectors are shuffled."""
    number = F.col(f"`{doc_id}`").cast("long").alias("i")
    marked = labels.select(number, F.col(f"`{label}`").cast("int").alias("y")).where("y in (0, 1) and i is not null").where(~held_out(F.col("i")))
    rows = documents.select(number, F.col(f"`{text}`").alias("t")).where(F.col("i").isNotNull() & ~held_out(F.col("i")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            x = pa.array([vector(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], names=["i", "x"])

    found = stored(rows.mapInArrow(run, "i long, x array<double>").join(marked, "i"), "training")
    n, good = found.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    count = max(1, min(n // BUCKET, min(good, n - good) // LEAST_RARE))
    grouped = found.withColumn("bucket", F.pmod(F.xxhash64("i"), F.lit(count))).groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("i", "y", "x"))).alias("r"))
    buckets = stored(grouped.select("bucket", F.col("r.y").alias("y"), F.col("r.x").alias("x")), "buckets")
    ranking = fit(buckets)
    for table in (found, buckets):
        dropped(table)
    return ranking


def score(documents: DataFrame, ranking: Ranking | None, text: str = "text") -> DataFrame:
    """``documents`` with score (0 to 1) and predicted (1 where it is CUT or more)."""
    passed = [f for f in documents.schema.fields if f.name.lower() not in ("score", "predicted")]
    schema = T.StructType([*passed, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            x = np.array([vector(t) for t in batch.column(len(passed)).to_pylist()])
            s = np.ones(len(x)) if ranking is None else ranking.scores(x)
            columns = [*batch.columns[: len(passed)], pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return documents.select(*(f"`{f.name}`" for f in passed), F.col(f"`{text}`").alias("_text")).mapInArrow(run, schema)
