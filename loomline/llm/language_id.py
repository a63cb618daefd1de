"""Language identification by partial matching: the language whose context tree codes a text shortest.

Training counts, for each language, which bytes follow which contexts of 0 to ``ORDER`` bytes in
lower-cased UTF-8. A context that a byte c times followed, out of n followers of d kinds, gives it
the probability c / (n + d) and the escape d / (n + d) to the next shorter context; a context that
a language never met is passed without cost, and below the empty context all 256 bytes are alike.
The statistics are frozen, so a text's code length under a language is a sum over its bytes,
whatever the order in which parts are scored.

The trees of all languages share one trie. A node holds, for each language, the bits of its last
byte after the others (escapes included) and the bits of an escape from it as a context. Children
are numbered in a row, so a bitmap of 256 bits and the number of the first child lead from a
context to the next by a population count. numpy walks all bytes of many texts at once, one level
after the other; only bytes whose longest context does not know them go on to shorter ones.

Training takes a bounded sample: of each language the rows with the ``ROWS`` smallest hashes of
their ids, and all rows that share such an id, each whole. Counts are made in tasks and summed by
Spark; the driver builds the trie, which is bounded by the sample, and broadcasts it. Scoring
covers all texts, whole, in pieces of bounded size, without a shuffle.

Defined cases: a null text, a text without a letter, and every text if nothing was learned, is
``und`` with score 0.0; rows with a null id or language, or in the held-out fold, are never
learned; equal code lengths go to the language that sorts first; repeated rows get equal
predictions; an empty table gives an empty table; other columns are passed through and columns
named like the results replaced. The score is the probability of the language among the learned
ones, each as likely before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import free, slices, stored

ORDER, ROWS = 3, 1000
FOLDS, HELD_OUT, UNKNOWN = 4, 2, "und"
PIECE, BATCH = 1 << 18, 256
#: A gram of ORDER + 1 bytes is packed in a signed 64-bit integer.
MAX_ORDER = 6


def held_out(doc_id: Column) -> Column:
    """Whether a row is in the fold that never trains."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == HELD_OUT


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased texts' bytes in one array, and where each starts, with the end of the last."""
    coded = [(t or "").lower().encode() for t in texts]
    return np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)])


def grams(data: np.ndarray, edges: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The packed grams of ``size`` bytes that lie within one text, and how often each occurs."""
    if len(data) < size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    packed = np.zeros(len(data) - size + 1, np.int64)
    for k in range(size):
        packed = (packed << 8) | data[k : len(packed) + k]
    whole = np.ones(len(packed), bool)
    for k in range(1, size):  # grams that run over the end of a text
        at = edges[1:-1] - k
        whole[at[(at >= 0) & (at < len(packed))]] = False
    return np.unique(packed[whole], return_counts=True)


class Trees:
    """The context trees of all languages over one trie. Node 0 stands for none, node 1 for the empty context."""

    def __init__(self, languages: list[str], order: int, levels: list[tuple[np.ndarray, np.ndarray]]):
        """``levels`` has, for each size from 1 to order + 1, sorted packed grams and their counts by language."""
        self.languages, self.order = languages, order
        width = len(languages)
        first = np.cumsum([2, *(len(keys) for keys, _ in levels)])  # number of the first node of each size
        inner = int(first[order])
        self.bits, self.start = np.zeros(inner * 4, np.uint64), np.zeros(inner * 4, np.int32)
        self.escape = np.zeros((inner, width), np.float32)
        self.cost = np.zeros((int(first[-1]), width), np.float32)
        parents = np.array([0], np.int64)  # packed contexts of the size before
        for size, (keys, counts) in enumerate(levels, 1):
            base = 1 if size == 1 else int(first[size - 2])
            of = np.searchsorted(parents, keys >> 8)  # which context each gram follows
            n, kinds = np.zeros((len(parents), width)), np.zeros((len(parents), width))
            np.add.at(n, of, counts)
            np.add.at(kinds, of, counts > 0)
            total = n + kinds
            with np.errstate(divide="ignore", invalid="ignore"):
                out = np.where(n > 0, -np.log2(kinds / total), 0.0)
                seen = -np.log2(counts / total[of])
            if size == 1:
                shorter = np.full((len(keys), width), 8.0)
            else:
                before = levels[size - 2][0]
                suffix = np.searchsorted(before, keys & ((1 << 8 * (size - 1)) - 1))
                shorter = self.cost[int(first[size - 2]) + suffix]
            self.escape[base : base + len(parents)] = out
            self.cost[int(first[size - 1]) : int(first[size])] = np.where(counts > 0, seen, out[of] + shorter)
            byte = keys & 255
            np.bitwise_or.at(self.bits, (base + of) * 4 + (byte >> 6), np.uint64(1) << (byte & 63).astype(np.uint64))
            children = np.bincount(of, minlength=len(parents))
            words = self.bits[base * 4 : (base + len(parents)) * 4].reshape(-1, 4)
            earlier = np.cumsum(np.bitwise_count(words), axis=1) - np.bitwise_count(words)
            begin = int(first[size - 1]) + np.cumsum(children) - children
            self.start[base * 4 : (base + len(parents)) * 4] = (begin[:, None] + earlier).ravel()
            parents = keys

    def child(self, node: np.ndarray, word: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """The node of a context and its next byte (given as word and bit of the bitmap), or 0."""
        at = node * 4 + word
        bits = self.bits[at]
        below = np.bitwise_count(bits & ((np.uint64(1) << bit) - np.uint64(1)))
        return (self.start[at] + below) * ((bits >> bit) & np.uint64(1)).astype(np.int32)

    def code_lengths(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(edges) - 1, len(self.languages)))
        carried = [0] * (self.order + 1)  # nodes of the contexts of each size that end before a piece
        for low in range(0, len(data), PIECE):
            piece = data[low : low + PIECE]
            high = low + len(piece)
            word, bit = (piece >> 6).astype(np.int32), (piece & 63).astype(np.uint64)
            begins = edges[:-1][(edges[:-1] >= low) & (edges[:-1] < high)] - low
            contexts = [np.ones(len(piece), np.int32)]
            for k in range(self.order + 1):
                node = self.child(contexts[k], word, bit)
                if k < self.order:
                    context = np.concatenate([[carried[k + 1]], node[:-1]]).astype(np.int32)
                    context[begins] = 0
                    contexts.append(context)
                    carried[k + 1] = int(node[-1])
            bits = self.cost[node]
            open_ = np.flatnonzero(node == 0)
            for k in range(self.order, -1, -1):  # what the longest context does not know goes on to shorter ones
                if not len(open_):
                    break
                bits[open_] += self.escape[contexts[k][open_]]
                node = self.child(contexts[k - 1][open_], word[open_], bit[open_]) if k else np.zeros(len(open_), np.int32)
                bits[open_] += self.cost[node] if k else np.float32(8)
                open_ = open_[node == 0]
            # Sums by text: of each that has bytes here.
            texts = np.flatnonzero((edges[:-1] < high) & (edges[1:] > low) & (edges[1:] > edges[:-1]))
            out[texts] += np.add.reduceat(bits, np.maximum(edges[texts] - low, 0), axis=0, dtype=np.float64)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The language of each text, its probability, and its bits a byte."""
        data, edges = joined(texts)
        lengths = self.code_lengths(data, edges)
        best = lengths.argmin(axis=1)
        least = lengths.min(axis=1)
        odds = np.exp2(np.maximum(least[:, None] - lengths, -1000)).sum(axis=1)
        return [self.languages[i] for i in best], 1 / odds, least / np.maximum(np.diff(edges), 1)


def train(documents: DataFrame, order: int = ORDER, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Trees | None:
    """Trees of the languages found outside the held-out fold, from at most ``rows`` ids of each; None if there is none."""
    if not 0 <= order <= MAX_ORDER:
        raise ValueError(f"order must be 0 to {MAX_ORDER}")
    learned = documents.select(F.col(f"`{doc_id}`").cast("long").alias("i"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("t"))
    learned = learned.where(F.col("lang").isNotNull() & ~held_out(F.col("i"))).withColumn("h", F.xxhash64("i"))
    # Ids first, without texts. Hashes are even, so a threshold by a language's count leaves about
    # twice the wanted rows, however many there are, and only these are put in order.
    counts = stored(learned.groupBy("lang").agg(F.count("*").alias("n")), "counts")
    place = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(2**63))), 11) / F.lit(2.0**53)
    near = learned.select("lang", "h").join(counts, "lang").where(place * F.col("n") <= 2 * rows)
    first = near.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("at") <= rows)
    bounds = stored(first.groupBy("lang").agg(F.max("h").alias("most")), "languages")
    sample = learned.join(bounds, "lang").where("h <= most").select("lang", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, BATCH):
            names = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).to_pylist()
            for name in sorted(set(names)):
                data, edges = joined([texts[i] for i in np.flatnonzero(names == name)])
                for size in range(1, order + 2):
                    keys, n = grams(data, edges, size)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array([size] * len(keys), pa.int32()), pa.array(keys), pa.array(n)], names=["lang", "size", "gram", "n"])

    summed = sample.mapInArrow(count, "lang string, size int, gram long, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    found = summed.toPandas()  # distinct grams of a bounded sample
    languages = sorted({r.lang for r in bounds.collect()})
    if not languages:
        return None
    column = {name: k for k, name in enumerate(languages)}
    levels = []
    for size in range(1, order + 2):
        part = found[found["size"] == size]
        keys = np.unique(part["gram"].to_numpy(np.int64))
        table = np.zeros((len(keys), len(languages)))
        table[np.searchsorted(keys, part["gram"].to_numpy(np.int64)), part["lang"].map(column).to_numpy(np.int64)] = part["n"]
        levels.append((keys, table))
    return Trees(languages, order, levels)


def identify(documents: DataFrame, trees: Trees | None, text: str = "text") -> DataFrame:
    """``documents`` with lang_pred, score and bits_per_byte (null where there is no prediction)."""
    results = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]
    passed = [f for f in documents.schema.fields if f.name.lower() not in {r.name for r in results}]
    schema = T.StructType([*passed, *results])
    of_text = F.col(f"`{text}`")
    shared = documents.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches, BATCH):
            texts = batch.column(len(passed)).to_pylist()
            names, scores, bits = [UNKNOWN] * len(texts), np.zeros(len(texts)), [None] * len(texts)
            lettered = [i for i, t in enumerate(texts) if t is not None] if known else []
            if lettered:
                found, chance, per_byte = known.predict([texts[i] for i in lettered])
                for i, name, p, b in zip(lettered, found, chance, per_byte, strict=True):
                    names[i], scores[i], bits[i] = name, p, float(b)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(passed)], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())], names=schema.names)

    # A text without a letter is passed as null: there is nothing in it to score.
    rows = documents.select(*(f"`{f.name}`" for f in passed), F.when(of_text.rlike(r"\p{L}"), of_text).alias(free("_text", documents.columns)))
    return rows.mapInArrow(run, schema)
