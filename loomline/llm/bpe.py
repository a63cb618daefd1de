"""Byte-pair encoding and decoding with the vocabulary of a byte-level tokenizer file.

Encoding keeps the symbols of a piece in a doubly linked list and the possible merges in a
priority queue by rank and position. A popped entry whose symbols have changed since is stale
and skipped. Decoding concatenates the vocabulary's byte strings.

Defined cases: a null text is encoded as the empty text (no ids); an empty text has no ids and
decodes to an empty text; ids outside the vocabulary decode to nothing; repeated rows give
repeated rows; an empty table gives an empty table; other columns are passed through, and the
names of the output columns are the caller's choice and replace columns of that name.
"""

from __future__ import annotations

import heapq
import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomline.llm.chunks import ChunkEncoder, gathered, steps

ROWS = 2000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in such vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class BytePairEncoder:
    """Ids of texts by the merges of one tokenizer file, with memos of bounded size."""

    def __init__(self, content: str):
        spec = json.loads(content)
        alphabet, ids = byte_alphabet(), spec["model"]["vocab"]
        self.of_byte = {alphabet[c]: i for c, i in ids.items() if len(c) == 1}
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        #: By rank: the two symbols that merge, and what they become.
        self.merge_of = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        self.rank_of = {(a, b): rank for rank, (a, b, _) in enumerate(self.merge_of)}
        self.texts = ChunkEncoder(self._many, {a["content"]: a["id"] for a in spec.get("added_tokens", [])})

    def _many(self, pieces: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in (self.merged(p.encode()) for p in pieces)]

    def merged(self, data: bytes) -> list[int]:
        """Ids of one piece: the lowest rank first, the leftmost of equal ranks.

        An entry of the queue is rank * length + position, so that comparing two entries
        compares integers.
        """
        of_byte, rank_of, merge_of = self.of_byte, self.rank_of.get, self.merge_of
        symbols = [of_byte[b] for b in data]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [rank * n + i for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if (rank := rank_of(pair)) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = divmod(heapq.heappop(queue), n)
            left, right, joined = merge_of[rank]
            j = after[i]
            if j >= n or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i], symbols[j] = joined, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := rank_of((joined, symbols[k]))) is not None:
                    heapq.heappush(queue, rank * n + i)
            h = before[i]
            if h >= 0 and (rank := rank_of((symbols[h], joined))) is not None:
                heapq.heappush(queue, rank * n + h)
        return [s for s in symbols if s >= 0]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        return self.texts.encode_all(texts)

    def encode(self, text: str | None) -> list[int]:
        return self.texts.encode(text)


class BytePairDecoder:
    """Texts of ids: the vocabulary's byte strings in one array, gathered by id."""

    def __init__(self, content: str):
        spec, alphabet = json.loads(content), byte_alphabet()
        strings = {i: bytes(alphabet[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        strings |= {a["id"]: a["content"].encode() for a in spec.get("added_tokens", [])}
        self.room = max(strings, default=-1) + 1
        row = [strings.get(i, b"") for i in range(self.room + 1)]  # the last one stands for ids outside
        self.bytes = np.frombuffer(b"".join(row), np.uint8)
        self.sizes = np.fromiter(map(len, row), np.int64, len(row))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The text of each run of ``counts`` ids; byte sequences that are not UTF-8 become replacement characters."""
        known = np.minimum(ids, self.room)
        sizes = self.sizes[known]
        data = gathered(self.bytes, self.starts[known], sizes)
        upto, ends = np.concatenate([[0], np.cumsum(sizes)]), np.cumsum(counts)
        offsets = np.concatenate([[0], upto[ends]]).astype(np.int64)
        made = pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
        try:
            made.validate(full=True)
        except pa.ArrowInvalid:
            whole = data.tobytes()
            made = pa.array([whole[a:b].decode("utf-8", "replace") for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)], pa.large_string())
        return made

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, "<u4"), np.array([len(ids)]))[0].as_py()


_made: dict[type, tuple[int, object]] = {}


def made_of(kind: type, content):
    """The encoder or decoder of a broadcast tokenizer file; built once per Python worker."""
    key = hash(content.value)
    if kind not in _made or _made[kind][0] != key:
        _made[kind] = (key, kind(content.value))
    return _made[kind][1]


def _file(df: DataFrame, tokenizer: str):
    """The tokenizer file, read on the driver and broadcast: a vocabulary, whose size no data changes."""
    with open(tokenizer, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _mapped(df: DataFrame, column: str, fields: list[T.StructField], work: Callable) -> DataFrame:
    """``df`` with new last columns: what ``work`` makes of ``column``, some rows at a time."""
    names = {f.name.lower() for f in fields}
    passed = [f for f in df.schema.fields if f.name.lower() not in names]
    schema = T.StructType([*passed, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, len(passed), ROWS):
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(passed)], *work(batch.column(len(passed)))], names=schema.names)

    return df.select(*(f"`{f.name}`" for f in passed), df[f"`{column}`"].alias("_in")).mapInArrow(run, schema)


def _as_binary(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = (4 * np.concatenate([[0], np.cumsum(counts)])).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", count: str = "n_tokens") -> DataFrame:
    """``df`` with ``ids`` (binary: little-endian unsigned 32-bit) and ``count`` of every whole text."""
    content = _file(df, tokenizer)

    def work(texts: pa.Array) -> tuple:
        made, counts = made_of(BytePairEncoder, content).encode_all(texts)
        return _as_binary(made, counts), pa.array(counts, pa.int64())

    return _mapped(df, text, [T.StructField(ids, T.BinaryType()), T.StructField(count, T.LongType())], work)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the ``text`` of the ids that ``encode`` made."""
    content = _file(df, tokenizer)

    def work(values: pa.Array) -> tuple:
        held = [v or b"" for v in values.to_pylist()]
        counts = np.fromiter(map(len, held), np.int64, len(held)) // 4
        whole = np.frombuffer(b"".join(v[: 4 * n] for v, n in zip(held, counts.tolist(), strict=True)), "<u4")
        return (made_of(BytePairDecoder, content).decode_all(whole, counts).cast(pa.string()),)

    return _mapped(df, ids, [T.StructField(text, T.StringType())], work)


def round_trip(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", count: str = "n_tokens", decoded: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` of its ids in one pass, so that a task needs one Python worker and sends its rows once."""
    content = _file(df, tokenizer)

    def work(texts: pa.Array) -> tuple:
        made, counts = made_of(BytePairEncoder, content).encode_all(texts)
        shown = made_of(BytePairDecoder, content).decode_all(made, counts)
        return _as_binary(made, counts), pa.array(counts, pa.int64()), shown.cast(pa.string())

    fields = [T.StructField(ids, T.BinaryType()), T.StructField(count, T.LongType()), T.StructField(decoded, T.StringType())]
    return _mapped(df, text, fields, work)
