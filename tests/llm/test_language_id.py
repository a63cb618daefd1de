"""Code lengths against a plain context model, held-out accuracy, and the defined cases."""

from __future__ import annotations

import math
import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from loomline.llm import language_id as li
from loomline.llm.queries import op12_language_id

SF = "/root/testdata/sf0.1"


def followers(texts, order):
    """What follows each context of a language's texts."""
    seen = defaultdict(lambda: defaultdict(int))
    for t in texts:
        data = t.lower().encode()
        for i, b in enumerate(data):
            for k in range(min(order, i) + 1):
                seen[data[i - k : i]][b] += 1
    return seen


def bits(text, seen, order):
    """The code length of a text, byte by byte from the longest context on."""
    data, out = (text or "").lower().encode(), 0.0
    for i, b in enumerate(data):
        for k in range(min(order, i), -1, -1):
            found = seen.get(data[i - k : i])
            if found is None:
                continue
            total = sum(found.values()) + len(found)
            if b in found:
                out -= math.log2(found[b] / total)
                break
            out -= math.log2(len(found) / total)
        else:
            out += 8
    return out


def trees(texts_of, order):
    names, levels = sorted(texts_of), []
    for size in range(1, order + 2):
        per = [dict(zip(*(x.tolist() for x in li.grams(*li.joined(texts_of[n]), size)), strict=True)) for n in names]
        keys = sorted(set().union(*per))
        levels.append((np.array(keys, np.int64), np.array([[p.get(k, 0) for p in per] for k in keys], float).reshape(len(keys), len(names))))
    return li.Trees(names, order, levels)


def test_code_lengths_equal_a_plain_model(monkeypatch):
    rng = random.Random(3)
    learned = {"a": ["The cat sat", "", "the mat", "é"], "b": ["Zum Beispiel", "so ÄÖ"], "c": ["x"]}
    asked = ["the cat", "zzz", "", "Ä", "\U0001f600 q", "t", "the mat sat so", "".join(rng.choice("abcthe ÄÖ") for _ in range(300)), None]
    for order in (0, 1, 3, 6):
        model = trees(learned, order)
        want = [[bits(t, followers(learned[n], order), order) for n in sorted(learned)] for t in asked]
        for piece in (1, 7, 1 << 18):
            monkeypatch.setattr(li, "PIECE", piece)
            assert np.allclose(model.code_lengths(*li.joined(asked)), want, rtol=1e-4, atol=1e-3), (order, piece)


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    made = op12_language_id(spark, SF).collect()
    assert {r.doc_id for r in made} == set(truth) and len(made) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in made)
    held = [(r.lang_pred, truth[r.doc_id]) for r in made if r.held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.995
    for lang in set(truth.values()):
        own = [p == t for p, t in held if t == lang]
        assert sum(own) / len(own) > 0.99, lang


def test_only_rows_outside_the_fold_are_learned(spark):
    rows = [(i, "alpha beta " * 3, "x" if zlib.crc32(str(i).encode()) % 4 != 2 else "held") for i in range(60)] + [(None, "gamma", "null-id"), (1001, "delta", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert li.train(frame).languages == ["x"]
    few = li.train(frame, rows=5)
    taken = sorted(frame.where("lang = 'x'").select(F.xxhash64("doc_id").alias("h"), "text").collect())[:5]
    assert few.cost.shape[1] == 1 and len(few.cost) == len(trees({"x": [r.text for r in taken]}, li.ORDER).cost)


def test_the_sample_has_the_smallest_hashes(spark):
    """Each row has letters of its own, so the trie shows which rows were learned."""
    rows = [(i, chr(0x4E00 + i), "x") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    hashed = [r[0] for r in frame.where(~li.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id")).limit(40).select("text").collect()]
    model, want = li.train(frame, rows=40), trees({"x": hashed}, li.ORDER)
    assert np.array_equal(model.cost, want.cost) and np.array_equal(model.bits, want.bits)


def test_defined_cases(spark):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2][:40]
    learned = spark.createDataFrame([(i, *own) for i, own in zip(ids, [("aaa", "a"), ("bbb", "b")] * 20, strict=True)], "doc_id long, text string, lang string")
    model = li.train(learned)
    rows = [(1, None, "k"), (2, "", "k"), (3, "123 !?", "k"), (4, "aa", "k"), (None, "BB", "k"), (6, "zz", "k"), (6, "zz", "k"), (7, "ab" * 400_000 + "b", "k")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("_text", F.lit("clash"))
    made = li.identify(frame, model)
    assert made.columns == ["doc_id", "text", "_text", "lang_pred", "score", "bits_per_byte"]
    got = [(r.lang_pred, r.score) for r in made.collect()]
    assert got[:3] == [("und", 0.0)] * 3 and [g[0] for g in got[3:5]] == ["a", "b"] and got[5] == got[6] == ("a", 0.5) and 0 < got[7][1] <= 1
    assert [tuple(r) for r in li.identify(frame, None).select("lang_pred", "score").distinct().collect()] == [("und", 0.0)]
    assert li.identify(frame.limit(0), model).count() == 0
    assert li.train(learned.limit(0)) is None and li.train(learned.withColumn("lang", F.lit(None).cast("string"))) is None
