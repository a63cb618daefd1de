"""Held-out accuracy of the ranking, and its defined cases."""

from __future__ import annotations

import zlib

from loomline.llm import quality_classifier as qc
from loomline.llm.queries import op9_quality_classifier

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    made = {r.doc_id: r for r in op9_quality_classifier(spark, SF).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in made.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in made.values())
    held = [(made[i].score, made[i].predicted, y) for i, y in labels.items() if i in made and made[i].held_out and y in (0, 1)]
    assert sum(p == y for _, p, y in held) / len(held) > 0.85
    good, bad = [s for s, _, y in held if y == 1], [s for s, _, y in held if y == 0]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.9


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (None, "x y", "a"), (3, "z " * 50_000, "a"), (3, "z " * 50_000, "a")], "doc_id long, text string, score string")
    none = spark.createDataFrame([(1, 1), (2, None), (9, 0), (None, 0)], "doc_id long, quality int")
    made = qc.score(docs, qc.train(docs, none)).collect()
    assert [r.score for r in made] == [1.0] * 5
    assert qc.score(docs.limit(0), None).count() == 0
    both = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in qc.score(docs, qc.train(docs, both)).collect())
