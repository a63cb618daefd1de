"""Coded shards: exact round trips, parallel parts, damage, and the query against the library."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomline.llm import token_files as tf
from loomline.llm.common import new_path
from loomline.llm.queries import TOKENIZER, op1_token_files

SF = "/root/testdata/sf0.001"


def library():
    t = Tokenizer.from_file(str(public_tokenizers.path(TOKENIZER)))
    t.no_truncation()
    t.no_padding()
    return t


def test_query_equals_the_library(spark):
    t, start, want = library(), 0, []
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = np.array([*(t.encode(r.text, add_special_tokens=False).ids if r.text else []), 2], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in op1_token_files(spark, SF).collect()) == want


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 5_000, 300_000])
def test_blocks_decode_whole_and_in_part(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.3, n) % 50_000
    present, symbols, counts = np.unique(ids, return_inverse=True, return_counts=True)
    table = tf.Table(present, tf.frequencies(counts))
    block = tf.encode_block(symbols, table)
    assert np.array_equal(tf.decode_block(block, table), ids)
    for first, last in ((0, n), (n // 3, n // 2), (n - 1, n), (n, n)):
        assert np.array_equal(tf.decode_block(block, table, first, last), ids[first:last])


def test_coding_is_close_to_entropy():
    ids = np.random.default_rng(0).zipf(1.5, 200_000) % 30_000
    _, symbols, counts = np.unique(ids, return_inverse=True, return_counts=True)
    share = counts / counts.sum()
    entropy = -(share * np.log2(share)).sum() * len(ids) / 8
    assert len(tf.encode_block(symbols, tf.Table(np.arange(len(counts)), tf.frequencies(counts)))) < 1.1 * entropy + 50_000


def test_damage_is_noticed():
    data = bytearray(tf.pack_segment(0, 0, [(1, np.arange(5_000) % 77)]))
    segment = next(tf.segments_of(bytes(data)))
    assert np.array_equal(segment.ids(), np.arange(5_000) % 77)
    data[-3] ^= 1
    with pytest.raises(ValueError):
        next(tf.segments_of(bytes(data))).ids()


def test_edge_cases(spark):
    rows = [(3, None, "x"), (1, "", "y"), (2, "a b", "z"), (2, "a b", "z"), (None, "c", "w"), (5, "word " * 20_000, "v")]
    path = new_path(spark, "test-tokens")
    tf.write(spark.createDataFrame(rows, "doc_id long, text string, ids string"), path, public_tokenizers.path(TOKENIZER))
    made = tf.read(spark, path).orderBy("part", "segment", "position").collect()
    assert [r.doc_id for r in made] == [None, 1, 2, 2, 3, 5]
    assert [r.n_tokens for r in made][1] == 1 and np.frombuffer(made[1].ids, "<u4").tolist() == [2]
    t = library()
    assert np.frombuffer(made[-1].ids, "<u4").tolist() == [*t.encode("word " * 20_000, add_special_tokens=False).ids, 2]


def test_empty_table(spark):
    path = new_path(spark, "test-tokens")
    tf.write(spark.createDataFrame([], "doc_id long, text string"), path, public_tokenizers.path(TOKENIZER))
    assert tf.read(spark, path).count() == 0 and tf.read_segments(spark, path).count() == 0
