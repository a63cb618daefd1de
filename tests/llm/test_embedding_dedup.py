"""Linked embeddings against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest

from loomline.llm import embedding_dedup
from loomline.llm.queries import op4_embedding_dedup

SF = "/root/testdata/sf0.01"


def brute(rows, cosine):
    able = [(i, label, np.array(v, np.float64)) for i, v, label in rows if label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root, links = {i: i for i, *_ in rows}, dict.fromkeys((i for i, *_ in rows), 0)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for x, (i, a, u) in enumerate(able):
        for j, b, v in able[x + 1 :]:
            if a == b and len(u) == len(v) and u @ v / math.sqrt(u @ u) / math.sqrt(v @ v) >= cosine:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted((i, links[i], find(i), find(i) == i) for i in root)


def planted(rows, seed):
    """The table's rows with near copies of some of them: on both sides of 0.93, in and out of the label, in chains."""
    rng, out, at = np.random.default_rng(seed), list(rows), max(r[0] for r in rows) + 1
    for i in rng.permutation(len(rows))[: len(rows) // 3]:
        _, v, label = rows[i]
        v = np.array(v, np.float64)
        for cosine in rng.uniform(0.9, 0.96, rng.integers(1, 4)):
            noise = rng.normal(size=len(v))
            noise -= v * (noise @ v) / (v @ v)
            near = cosine * v / np.linalg.norm(v) + math.sqrt(1 - cosine**2) * noise / np.linalg.norm(noise)
            v = near if rng.random() < 0.5 else v
            out.append((at, (near * rng.uniform(0.1, 9)).astype(np.float32).tolist(), label if rng.random() < 0.9 else (label or 0) + 1))
            at += 1
    return out


@pytest.mark.parametrize("per_root", [embedding_dedup.PER_ROOT, 3])
def test_real_table_with_planted_copies_equals_brute_force(spark, monkeypatch, tmp_path, per_root):
    monkeypatch.setattr(embedding_dedup, "PER_ROOT", per_root)
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = planted([(r.vec_id, r.embedding, r.label) for r in table.collect()], 5)
    spark.createDataFrame(rows, table.schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    made = sorted(tuple(r) for r in op4_embedding_dedup(spark, str(tmp_path)).collect())
    assert made == brute(rows, 0.93) and sum(m[1] > 0 for m in made) > 100


@pytest.mark.parametrize("per_root", [embedding_dedup.PER_ROOT, 1])
def test_clusters_copies_and_junk(spark, monkeypatch, per_root):
    monkeypatch.setattr(embedding_dedup, "PER_ROOT", per_root)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + rng.normal(scale=0.25, size=16)).tolist(), i % 2) for i in range(240)]
    rows += [(300 + i, rows[0][1], 0) for i in range(30)] + [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] * 16, 0), (403, [float("inf")] * 16, 0), (404, [], 0), (405, [None] * 16, 0), (406, rows[0][1], None), (407, [1.0, 2.0], 0), (408, [2.0, 4.0], 0)]
    frame = spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, embedding array<double>, label int, u string, list int")
    made = embedding_dedup.near_duplicates(frame, cosine=0.93).collect()
    assert sorted(tuple(r) for r in made) == brute(rows, 0.93)


def test_repeated_ids_are_one_node(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0)]
    made = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), cosine=0.93).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in made) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_empty_table(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(frame).count() == 0
