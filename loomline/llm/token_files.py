"""Token ids in binary shards coded by static range asymmetric numeral systems.

A shard file holds *segments*, a record each. A segment holds whole documents in order, one frequency
table that all its blocks share, a directory of document ids and lengths, and blocks of up to
``BLOCK`` ids. A block is coded by itself on interleaved lanes: lane i takes ids i, i + lanes, ...
Every block has a checksum and checkpoints (word position and lane states at some steps), so
readers can take blocks, or parts of blocks, in parallel and in any order.

Writers range-partition documents by id, so shards in the order of (part, segment) hold the
corpus in ascending id order. A segment closes at ``SEGMENT`` ids, which bounds the memory of
writers and readers whatever the size of the corpus; nothing passes through the driver.

Defined cases: a null or empty text has only the end id; rows with a null id come first; repeated
ids stay, ordered by a hash of the text; an empty table gives shards without documents; only the
columns of id and text are read, so others never clash. A damaged block raises ``ValueError``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomline.llm.chunks import ChunkEncoder, steps
from loomline.llm.common import slices

MAGIC = b"LLTS"
PRECISION = 20  # frequencies sum to 2 ** PRECISION
LOW = 31  # a lane's state stays in [2 ** LOW, 2 ** (LOW + 32))
LANES, BLOCK, SEGMENT, CHECKPOINT = 2048, 1 << 18, 1 << 22, 64
SEGMENTS_PER_FILE = 8
ROWS = 2000


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum to 2 ** PRECISION, each at least 1."""
    if len(counts) > 1 << PRECISION:
        raise ValueError(f"more than {1 << PRECISION} different ids in a segment")
    scaled = np.maximum(1, (counts.astype(np.float64) * (1 << PRECISION) / counts.sum()).astype(np.int64))
    while over := int(scaled.sum()) - (1 << PRECISION):
        top = int(scaled.argmax())
        scaled[top] -= min(over, max(1, int(scaled[top]) // 2)) if over > 0 else over
    return scaled.astype(np.uint64)


class Table:
    """A segment's frequency table: which ids occur, how often, and whose turn a slot is."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids, self.freq = ids.astype("<u4"), freq
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.ids), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots


def encode_block(symbols: np.ndarray, table: Table) -> bytes:
    """One block: lanes, checkpoints (step, words before it, states), words."""
    n = len(symbols)
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    state = np.full(lanes, 1 << LOW, np.uint64)
    freq, start = table.freq, table.start
    room, shift = np.uint64(LOW - PRECISION + 32), np.uint64(PRECISION)
    out: list[np.ndarray] = []
    written, marks = 0, []
    for step in range(steps - 1, -1, -1):
        s = symbols[step * lanes : (step + 1) * lanes]
        x, f = state[: len(s)], freq[s]
        full = x >= (f << room)
        if full.any():
            words = x[full].astype(np.uint32)
            out.append(words)
            written += len(words)
            x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[: len(s)] = (q << shift) + (x - q * f) + start[s]
        if step % CHECKPOINT == 0:
            marks.append((step, written, state.copy()))
    words = np.concatenate(out[::-1]) if out else np.empty(0, np.uint32)
    head = struct.pack("<III", n, lanes, len(marks))
    points = b"".join(struct.pack("<II", step, written - at) + s.astype("<u8").tobytes() for step, at, s in marks[::-1])
    return head + points + words.astype("<u4").tobytes()


def decode_block(block: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``last`` (exclusive) of a block, from the nearest checkpoint before ``first``."""
    n, lanes, marks = struct.unpack_from("<III", block)
    last = n if last is None else min(last, n)
    if first >= last:
        return np.empty(0, "<u4")
    size = 8 + 8 * lanes
    words = np.frombuffer(block, "<u4", offset=12 + marks * size)
    mark = min(marks - 1, first // lanes // CHECKPOINT)
    step, at = struct.unpack_from("<II", block, 12 + mark * size)
    state = np.frombuffer(block, "<u8", lanes, 12 + mark * size + 8).astype(np.uint64)
    begin, slots, freq, start = step * lanes, table.slots, table.freq, table.start
    mask, shift, low = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION), np.uint64(1 << LOW)
    out = np.empty(last - begin, np.uint32)
    for base in range(begin, last, lanes):
        width = min(lanes, n - base)
        x = state[:width]
        slot = x & mask
        s = slots[slot]
        out[base - begin : base - begin + width] = s[: last - base]
        x = freq[s] * (x >> shift) + slot - start[s]
        short = x < low
        k = int(np.count_nonzero(short))
        if k:
            x[short] = (x[short] << np.uint64(32)) | words[at : at + k]
            at += k
        state[:width] = x
    return table.ids[out[first - begin :]]


def pack_segment(part: int, number: int, documents: list[tuple[int | None, np.ndarray]]) -> bytes:
    """A segment's bytes: frame, header, table, directory, block index, blocks."""
    stream = np.concatenate([ids for _, ids in documents])
    seen = np.bincount(stream)
    present = np.flatnonzero(seen)
    symbol_of = np.zeros(len(seen), np.int64)
    symbol_of[present] = np.arange(len(present))
    symbols, counts = symbol_of[stream], seen[present]
    table = Table(present, frequencies(counts))
    blocks = [encode_block(symbols[at : at + BLOCK], table) for at in range(0, len(stream), BLOCK)]
    directory = zlib.compress(
        np.array([i is None for i, _ in documents], "u1").tobytes()
        + np.array([i or 0 for i, _ in documents], "<i8").tobytes()
        + np.array([len(ids) for _, ids in documents], "<u4").tobytes()
    )
    ranges = zlib.compress(table.ids.tobytes() + table.freq.astype("<u4").tobytes())
    index = b"".join(struct.pack("<II", len(b), zlib.crc32(b)) for b in blocks)
    head = struct.pack("<IIIQIIII", part, number, len(documents), len(stream), len(present), len(ranges), len(directory), len(blocks))
    body = head + ranges + directory + index
    return MAGIC + struct.pack("<QI", len(body) + sum(map(len, blocks)), zlib.crc32(body)) + body + b"".join(blocks)


HEAD = struct.calcsize("<IIIQIIII")


class Segment:
    """A segment as read: its header at once, its table and blocks when asked for."""

    def __init__(self, data: memoryview):
        check, body = struct.unpack_from("<I", data, 12)[0], data[16:]
        self.part, self.number, self.n_docs, self.n_tokens, distinct, ranges, directory, blocks = struct.unpack_from("<IIIQIIII", body)
        at = HEAD + ranges + directory + 8 * blocks
        if zlib.crc32(body[:at]) != check:
            raise ValueError(f"segment {self.part}/{self.number}: header checksum differs")
        self._ranges, self._directory = body[HEAD : HEAD + ranges], body[HEAD + ranges : HEAD + ranges + directory]
        self.blocks = []
        for i in range(blocks):
            length, crc = struct.unpack_from("<II", body, HEAD + ranges + directory + 8 * i)
            self.blocks.append((body[at : at + length], crc))
            at += length
        self._distinct = distinct

    def table(self) -> Table:
        raw = np.frombuffer(zlib.decompress(self._ranges), "<u4")
        return Table(raw[: self._distinct], raw[self._distinct :].astype(np.uint64))

    def directory(self) -> tuple[list, np.ndarray]:
        """Ids (None where null) and numbers of ids of the documents."""
        raw, n = zlib.decompress(self._directory), self.n_docs
        null, numbers = np.frombuffer(raw, "u1", n), np.frombuffer(raw, "<i8", n, n)
        return [None if z else i for z, i in zip(null.tolist(), numbers.tolist(), strict=True)], np.frombuffer(raw, "<u4", n, 9 * n)

    def block(self, number: int) -> bytes:
        data, crc = self.blocks[number]
        if zlib.crc32(data) != crc:
            raise ValueError(f"segment {self.part}/{self.number}, block {number}: checksum differs")
        return bytes(data)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids ``first`` to ``last`` of the segment; only the blocks and steps needed are decoded."""
        last, table, out = self.n_tokens if last is None else last, self.table(), [np.empty(0, "<u4")]
        for b in range(first // BLOCK, -(-last // BLOCK)):
            out.append(decode_block(self.block(b), table, max(0, first - b * BLOCK), last - b * BLOCK))
        return np.concatenate(out)


def segments_of(content: bytes) -> Iterator[Segment]:
    """The segments of a shard's bytes."""
    data, at = memoryview(content), 0
    while at < len(data):
        if bytes(data[at : at + 4]) != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        size = 16 + struct.unpack_from("<Q", data, at + 4)[0]
        yield Segment(data[at : at + size])
        at += size


_encoders: dict[int, ChunkEncoder] = {}
#: Pieces in one call of the library.
LOT = 2000


def library_encoder(content: str) -> ChunkEncoder:
    """Ids of texts by the tokenizers library; equal pieces are encoded once.

    New pieces are joined and encoded in one call: those that begin with a space as they are, others
    with a line feed before each. The ids fall to the pieces by their lengths in bytes, which the
    vocabulary's strings give; should they not meet the joints, every piece is encoded by itself.
    """
    if (key := hash(content)) not in _encoders:
        tokenizer = Tokenizer.from_str(content)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        sizes = np.zeros(tokenizer.get_vocab_size() + 1, np.int64)
        for token, i in tokenizer.get_vocab().items():
            sizes[i] = len(token)

        def whole(text: str) -> bytes:
            return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

        def lot(pieces: list[str], mark: str) -> list[bytes]:
            data = whole("".join([mark + p for p in pieces]))
            ends = np.cumsum(sizes[np.frombuffer(data, "<u4")])
            lengths = np.array([len(p.encode()) for p in pieces])
            stops = np.cumsum(lengths + len(mark))
            last = np.searchsorted(ends, stops)
            first = np.searchsorted(ends, stops - lengths, "right")
            if last[-1] != len(ends) - 1 or not np.array_equal(ends[last], stops) or (mark and not np.array_equal(ends[first - 1], stops - lengths)):
                return [whole(p) for p in pieces]
            return [data[i:j] for i, j in zip((4 * first).tolist(), (4 * (last + 1)).tolist(), strict=True)]

        def many(pieces: list[str]) -> list[bytes]:
            found = {}
            blank = [p for p in pieces if p.isspace()]  # these would merge with a mark
            found |= zip(blank, map(whole, blank), strict=True)
            for mark, own in (("", [p for p in pieces if p[0] == " " and p not in found]), ("\n", [p for p in pieces if p[0] != " " and p not in found])):
                for at in range(0, len(own), LOT):
                    found |= zip(own[at : at + LOT], lot(own[at : at + LOT], mark), strict=True)
            return [found[p] for p in pieces]

        _encoders.clear()
        _encoders[key] = ChunkEncoder(many, special)
    return _encoders[key]


def write(documents: DataFrame, path: str, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all texts, each followed by ``end_id``, as shards under ``path``."""
    spark = documents.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())  # a vocabulary, whose size no data changes

    def coded(rows: Iterable[tuple]) -> Iterator[bytes]:
        part, number = TaskContext.get().partitionId(), 0
        held, size = [], 0
        for i, ids in rows:
            held.append((i, ids))
            size += len(ids)
            if size >= SEGMENT:
                yield pack_segment(part, number, held)
                number, held, size = number + 1, [], 0
        if held:
            yield pack_segment(part, number, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(content.value)

        def rows() -> Iterator[tuple]:
            for batch in steps(batches, 1, ROWS):
                ids, counts = encoder.encode_all(batch.column(1), end_id)
                yield from zip(batch.column(0).to_pylist(), np.split(ids, np.cumsum(counts)[:-1]), strict=True)

        for segment in coded(rows()):
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.binary())], names=["segment"])

    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("i"), F.col(f"`{text}`").alias("t")).withColumn("h", F.xxhash64("t"))
    order = [F.asc_nulls_first("i"), F.asc("h")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order, F.asc("t")).select("i", "t")
    segments = ordered.mapInArrow(run, "segment binary")
    # A record of a Parquet file is a segment, so that Spark commits shards and takes back those of lost tasks.
    segments.write.option("maxRecordsPerFile", SEGMENTS_PER_FILE).option("compression", "uncompressed").parquet(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("segment binary").parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """part, segment, n_docs, n_tokens and the number of ids before each segment; headers only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = [(s.part, s.number, s.n_docs, s.n_tokens) for s in segments_of(batch.column(0)[0].as_py())]
            columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
            if columns:
                yield pa.RecordBatch.from_arrays(columns, names=["part", "segment", "n_docs", "n_tokens"])

    found = _segments(spark, path).mapInArrow(run, "part long, segment long, n_docs long, n_tokens long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    parts = found.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("of_part"))
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    held = found.withColumn("of_segment", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return held.join(parts, "part").select("part", "segment", "n_docs", "n_tokens", (F.col("of_part") + F.col("of_segment")).alias("start"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the shards: part, segment, position (ids before it in its segment), doc_id, n_tokens, ids (binary)."""
    names = ["part", "segment", "position", "doc_id", "n_tokens", "ids"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for s in segments_of(batch.column(0)[0].as_py()):
                numbers, lengths = s.directory()
                ends = np.cumsum(lengths.astype(np.int64))
                stream = s.ids().tobytes()
                cut = [stream[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [[s.part] * s.n_docs, [s.number] * s.n_docs, (ends - lengths).tolist(), numbers, lengths.tolist(), cut]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return _segments(spark, path).mapInArrow(run, "part long, segment long, position long, doc_id long, n_tokens long, ids binary")
