"""Byte-pair coding equals the tokenizers library and decodes to the text."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from loomline.llm import bpe, chunks
from loomline.llm.queries import TOKENIZER, op5_bpe

SF = "/root/testdata/sf0.001"
PATH = str(public_tokenizers.path(TOKENIZER))
ODD = [None, "", " ", "  ", "a ", " a", "a  b", "\n", " \n a", "a \nb\n\n c", "é ñ  ü", "日本語 テスト", "👍🏽 ok", "it's  we'll 12 3  !!", "\x1c a \x85 b", "x\ny.\nz\n", "x.\n\ny\n\n\nz\n\n", "\n\nx", "x\n\t\ny", "\ta\n b", "12.\n13,|)$ it's. 'll, (a). é! ъ. --. ٣.", "<|endoftext|> x <|endoftext|>", "x" * 3_000, "ab " * 30_000]


def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def expected(texts):
    t, out = library(), []
    for x in texts:
        ids = t.encode(x, add_special_tokens=False).ids if x else []
        out.append((len(ids), digest(np.array(ids, "<u4").tobytes()), digest(t.decode(ids, skip_special_tokens=False).encode())))
    return out


def test_query_equals_the_library(spark):
    rows = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    made = [tuple(r)[1:] for r in op5_bpe(spark, SF).orderBy("doc_id").collect()]
    assert made == expected([r.text for r in rows])


def test_odd_and_random_texts():
    rng = random.Random(7)
    texts = ODD + ["".join(rng.choice(" \n\ta1é!'日 👍sß\x85\x1c.,|") for _ in range(rng.randrange(60))) for _ in range(1_500)]
    texts += ["".join(rng.choice(["\n", "\n", "a", ".", "é", " "]) for _ in range(rng.randrange(12))) for _ in range(1_500)]
    with open(PATH, encoding="utf-8") as f:
        content = f.read()
    coder, decoder = bpe.BytePairEncoder(content), bpe.BytePairDecoder(content)
    coder.texts.tails.room = coder.texts.chunks.room = 20_000  # so that memos turn over
    want = expected(texts)
    for lot in (1, 7, len(texts)):
        made = []
        for at in range(0, len(texts), lot):
            ids, counts = coder.encode_all(pa.array(texts[at : at + lot], pa.string()))
            shown = decoder.decode_all(ids, counts).to_pylist()
            made += [(len(own), digest(own.tobytes()), digest(t.encode())) for own, t in zip(np.split(ids, np.cumsum(counts)[:-1]), shown, strict=True)]
        assert made == want
    assert decoder.decode([0xFFFFFFFF, *coder.encode("a b"), coder.of_byte[0xC3]]) == "a b\ufffd"


def test_memos_stay_within_their_bytes():
    memo = chunks.Memo(20_000)

    def make(keys):
        return np.arange(len(keys), dtype=np.uint32) + 7, np.ones(len(keys), np.int64)

    for at in range(0, 5_000, 50):
        keys = [*(f"word {i}" for i in range(at, at + 50)), "often"]
        table, starts, sizes = memo.find(pa.array(keys, pa.large_string()), np.array([*[1] * 50, 9]), make)
        assert table[starts].tolist()[:50] == list(range(7, 57)) and set(sizes) == {1}
        assert sum(map(len, memo.keys.to_pylist())) + 4 * len(memo.ids) + chunks.ENTRY * len(memo.keys) <= memo.room
    table, starts, _ = memo.find(pa.array(["often"], pa.large_string()), np.array([1]), lambda own: 1 / 0)
    assert table[starts].tolist() == [57]


def test_tables(spark):
    frame = spark.createDataFrame([(1, "a b", "kept"), (2, None, None), (2, None, None)], "doc_id long, text string, n_tokens string")
    both = bpe.decode(bpe.encode(frame, PATH), PATH)
    assert sorted((r.doc_id, r.n_tokens, r.decoded) for r in both.collect()) == [(1, 2, "a b"), (2, 0, ""), (2, 0, "")]
    at_once = bpe.round_trip(frame, PATH)
    assert at_once.columns == ["doc_id", "text", "ids", "n_tokens", "decoded"] and sorted(map(str, at_once.collect())) == sorted(map(str, both.collect()))
    assert bpe.encode(frame.limit(0), PATH).count() == 0 == bpe.round_trip(frame.limit(0), PATH).count()
