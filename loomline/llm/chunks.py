"""Cutting texts where byte-level tokenizers always cut, so that equal parts are encoded once.

The byte-level split pattern starts a new piece at every space or line feed that stands between
other characters, and where punctuation follows a letter or digit, whatever came before. A text can
therefore be cut there. The chunks of a batch are cut, numbered and looked up by Arrow kernels; only
those not remembered are split by the pattern itself and encoded, many at a time. Ids are then
gathered by numpy.

What is remembered is kept in Arrow and numpy arrays and bounded by bytes, so a worker's memory
depends neither on the corpus nor on its vocabulary of words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import pre_tokenizers

from loomline.llm.common import tidy

#: Fixed value: the split pattern of byte-level tokenizer files of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points on whose classes all Unicode versions agree; other texts are split by the library's own tables.
SETTLED = re.compile("[^\u0000-ԯ -⁯]")
#: White space that stands beside other white space or at the end, where the cut is left to the pattern; a blank line is not.
_OTHER = r"[\x09\x0B-\x0D\x1C-\x20\x{85}\p{Z}]"
ODD = rf"( (\n|{_OTHER}|\z)|{_OTHER}\n|\n{_OTHER}|\n\n(\n|\z))"
#: Punctuation that is cut from the letter or digit before it.
TAIL, BEFORE_TAIL = ".,;:!?$%&|)", r"[0-9A-Za-zÀ-ÖØ-öø-ÿ]\z"
#: Bytes of text in one step, and bytes that a memo may take.
STEP, ROOM = 2 << 20, 24 << 20
#: What an entry of a memo takes beside its characters and ids, and the longest key kept.
ENTRY, LONGEST = 32, 200


def gathered(table: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of ``table`` that begin at ``starts`` and have ``counts`` entries, one after the other."""
    ends = np.cumsum(counts)
    if not len(ends) or not ends[-1]:
        return table[:0]
    return table[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1])]


def _ends(values: pa.Array) -> np.ndarray:
    return np.cumsum(np.asarray(pc.binary_length(values)).astype(np.int64))


class Memo:
    """Ids by string, the most used ones of late: when ``room`` bytes are full, the less used half goes."""

    def __init__(self, room: int = ROOM):
        self.room = room
        self.keys = pa.array([], pa.large_string())
        self.ids, self.sizes, self.used = np.empty(0, np.uint32), np.empty(0, np.int32), np.empty(0, np.int32)

    def find(self, keys: pa.Array, times: np.ndarray, make: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A table of ids with the start and the number of each key's ids in it.

        ``keys`` differ from each other and were met ``times`` times. ``make`` gives the ids of
        those that are not remembered, one after the other, and their numbers.
        """
        at = np.asarray(pc.fill_null(pc.index_in(keys, value_set=self.keys), -1)).astype(np.int64)
        fresh = np.flatnonzero(at < 0)
        self.used[at[at >= 0]] += times[at >= 0].astype(np.int32)
        sizes, table = self.sizes.astype(np.int64), self.ids
        if len(fresh):
            new = keys.take(pa.array(fresh))
            made, lengths = make(new)
            at[fresh] = len(sizes) + np.arange(len(fresh))
            table, sizes = np.concatenate([table, made]), np.concatenate([sizes, lengths])
            self._remember(new, made, lengths, times[fresh])
        starts = np.cumsum(sizes) - sizes
        return table, starts[at], sizes[at]

    def _remember(self, keys: pa.Array, ids: np.ndarray, sizes: np.ndarray, times: np.ndarray) -> None:
        short = np.asarray(pc.binary_length(keys)) <= LONGEST
        if not short.all():
            keys, ids = keys.filter(pa.array(short)), ids[np.repeat(short, sizes)]
            sizes, times = sizes[short], times[short]
        self.keys = pa.concat_arrays([self.keys, keys])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes]).astype(np.int32)
        self.used = np.concatenate([self.used, times]).astype(np.int32)
        taken = np.asarray(pc.binary_length(self.keys)).astype(np.int64) + 4 * self.sizes + ENTRY
        if taken.sum() > self.room:
            order = np.argsort(-self.used, kind="stable")
            keep = np.zeros(len(order), bool)
            keep[order[np.cumsum(taken[order]) <= self.room // 2]] = True
            self.keys, self.ids = self.keys.filter(pa.array(keep)), self.ids[np.repeat(keep, self.sizes)]
            self.sizes, self.used = self.sizes[keep], self.used[keep] // 2


def steps(batches: Iterator[pa.RecordBatch], column: int, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of about ``STEP`` bytes in ``column`` and at most ``rows`` rows; a longer value is alone."""
    for batch in batches:
        ends, at = _ends(pc.fill_null(batch.column(column), "")), 0
        sizes = np.diff(ends, prepend=0)
        while at < len(sizes):
            upto = int(np.searchsorted(ends, ends[at] - sizes[at] + STEP, "right"))
            upto = min(max(upto, at + 1), at + rows)
            yield batch.slice(at, upto - at)
            at = upto
    tidy()


class Splitter:
    """The split pattern's pieces of a text."""

    def __init__(self):
        self.pattern = regex.compile(PATTERN)
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)

    def __call__(self, text: str) -> list[str]:
        if SETTLED.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.pattern.findall(text)

    def chunk(self, key: str) -> list[str]:
        """Those of a chunk, which a line feed or else a space begins."""
        if key.isalpha() and not SETTLED.search(key):
            return [f" {key}"]
        return self(key if key[:1] == "\n" else f" {key}")


def _tails(keys: pa.Array) -> tuple[pa.Array, pa.Array]:
    """``keys`` without the punctuation that may be cut off, and that punctuation."""
    bases = pc.utf8_rtrim(keys, TAIL)
    bases = pc.if_else(pc.match_substring_regex(bases, BEFORE_TAIL), bases, keys)
    data = np.frombuffer(keys.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1]
    lengths = np.asarray(pc.binary_length(bases)).astype(np.int64)
    sizes = np.diff(ends) - lengths
    rest = gathered(data, ends[:-1] + lengths, sizes)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return bases, pa.LargeStringArray.from_buffers(len(keys), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rest)))


class ChunkEncoder:
    """Ids of whole texts, as one array and the number of each text's ids.

    ``many`` encodes pieces. ``special`` gives the ids of strings that the tokenizer cuts out before
    anything else; a text that holds one is cut at them first.
    """

    def __init__(self, many: Callable[[list[str]], list[bytes]], special: dict[str, int], room: int = ROOM):
        self.many, self.special, self.split = many, special, Splitter()
        self.chunks, self.tails = Memo(room), Memo(room // 16)
        self.cut = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) or r"(?!)")

    def _joined(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lists of pieces, and the number of each list's ids."""
        flat = pa.array([p for pieces in lists for p in pieces], pa.large_string()).dictionary_encode()
        codes = np.asarray(flat.indices).astype(np.int64)
        made = self.many(flat.dictionary.to_pylist())
        sizes = np.fromiter(map(len, made), np.int64, len(made)) // 4
        upto = np.concatenate([[0], np.cumsum(sizes[codes])])
        ends = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
        ids = gathered(np.frombuffer(b"".join(made), "<u4"), (np.cumsum(sizes) - sizes)[codes], sizes[codes])
        return ids, np.diff(upto[ends], prepend=0)

    def _new_chunks(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self._joined(list(map(self.split.chunk, keys.to_pylist())))

    def _new_tails(self, tails: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self._joined([[t] if t else [] for t in tails.to_pylist()])

    def _looked_up(self, keys: pa.Array, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A table of ids with the start and the number of each key's ids in it."""
        found = []
        for part, memo, make in zip(_tails(keys), (self.chunks, self.tails), (self._new_chunks, self._new_tails), strict=True):
            own = part.dictionary_encode()
            codes = np.asarray(own.indices).astype(np.int64)
            table, starts, sizes = memo.find(own.dictionary, np.bincount(codes, times, len(own.dictionary)).astype(np.int64), make)
            found.append((table, starts[codes], sizes[codes]))
        (table, starts, sizes), (tails, behind, more) = found
        both = np.stack([sizes, more], axis=1)
        ids = gathered(np.concatenate([table, tails]), np.stack([starts, len(table) + behind], axis=1).ravel(), both.ravel())
        sizes = both.sum(axis=1)
        return ids, np.cumsum(sizes) - sizes, sizes

    def _whole(self, text: str) -> np.ndarray:
        """Ids of a text with special strings or odd white space."""
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._joined([self.split(text[at : m.start()])])[0], np.array([self.special[m[0]]], np.uint32)]
            at = m.end()
        return np.concatenate([*out, self._joined([self.split(text[at:])])[0]])

    def encode_all(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (a null one has none), each followed by ``end`` if it is given, and how many each text has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        apart = np.asarray(pc.match_substring_regex(texts, "|".join([ODD, *map(re.escape, self.special)])))
        plain = pc.if_else(pa.array(apart), "", texts) if apart.any() else texts
        parts = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        flat = parts.flatten()
        bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(parts)).astype(np.int64))])
        numbered = flat.dictionary_encode()
        codes = np.array(numbered.indices).astype(np.int64)
        table, starts, sizes = self._looked_up(numbered.dictionary, np.bincount(codes, minlength=len(numbered.dictionary)))
        # The first chunk of a text has no space before it, and a text kept apart is one entry.
        heads, lengths = self._joined(list(map(self.split, flat.take(pa.array(bounds[:-1])).to_pylist())))
        whole = [self._whole(texts[i].as_py()) for i in np.flatnonzero(apart).tolist()]
        own = [heads, *whole, np.array([] if end is None else [end], np.uint32)]
        more = np.concatenate([lengths, np.array(list(map(len, own[1:])), np.int64)])
        starts = np.concatenate([starts, len(table) + np.cumsum(more) - more])
        sizes, table = np.concatenate([sizes, more]), np.concatenate([table, *own])
        first = len(numbered.dictionary)
        codes[bounds[:-1]] = first + np.arange(len(texts))
        codes[bounds[:-1][apart]] = first + len(texts) + np.arange(len(whole))
        if end is not None:
            codes = np.insert(codes, bounds[1:], len(sizes) - 1)
            bounds = bounds + np.arange(len(bounds))
        counts = sizes[codes]
        upto = np.concatenate([[0], np.cumsum(counts)])
        return gathered(table, starts[codes], counts), np.diff(upto[bounds])

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all(pa.array([text], pa.large_string()))[0].tolist()
