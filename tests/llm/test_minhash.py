"""Near-duplicates against brute force over all pairs."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from loomline.llm import minhash
from loomline.llm.components import components
from loomline.llm.queries import op2_minhash

SF = "/root/testdata/sf0.01"


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def brute(rows, k, percent):
    """doc_id, n_shingles, component_id by comparing all pairs."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    p, q = find(i), find(j)
                    root[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i)) for i, s in sets)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    made = [(r.doc_id, r.n_shingles, r.component_id) for r in op2_minhash(spark, SF).collect()]
    assert sorted(made) == brute(rows, 3, 85)


@pytest.mark.parametrize("seed", [1, 2])
def test_dense_group_below_and_above_the_threshold(spark, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.randrange(0, 9)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(100_000)}"
        rows.append((i, " ".join(text)))
    made = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in made.collect()) == brute(rows, 3, 85)


def test_edge_cases(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \t\n", 0), (4, "One two", 0), (5, "one TWO", 0), (6, "É b c d", 0), (7, "é b c d", 0), (None, "one two", 0), (None, None, 0), (9, "a b c " * 30_000, 0), (10, "a b c " * 30_000, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    made = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame, words=3, percent=85).collect())
    assert (1, 0, 1, True) in made and (2, 0, 2, True) in made and (3, 0, 3, True) in made
    assert (4, 1, 4, True) in made and (5, 1, 4, False) in made
    assert (6, 2, 6, True) in made and (7, 2, 7, True) in made
    assert (9, 3, 9, True) in made and (10, 3, 9, False) in made
    assert len([m for m in made if m[0] == -1]) == 2


def test_repeated_id_links_its_texts(spark):
    """Ids with several texts of different lengths, and rows that repeat both."""
    rows = [(1, "a b c d e"), (1, "p q r s t"), (2, "p q r s t"), (3, "a b c d e")]
    made = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85)
    assert {r.component_id for r in made.collect()} == {1}
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = [(i % 25, " ".join(rng.choice([w, w, w, w, w, w, w, w, w, w, w, f"y{rng.randrange(999)}"]) for w in base)) for i in range(60)]
    made = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=80)
    assert {(r.doc_id, r.component_id) for r in made.collect()} == {(i, c) for i, _, c in brute(rows, 3, 80)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ids_with_several_texts_of_different_lengths(spark, seed):
    rng = random.Random(seed)
    bases = [[f"{b}w{i}" for i in range(rng.randrange(8, 90))] for b in range(12)]
    rows = []
    for _ in range(90):
        base = rng.choice(bases)
        text = [w if rng.random() > 0.03 else f"y{rng.randrange(9_999)}" for w in base[: rng.randrange(len(base) * 3 // 4, len(base) + 1)]]
        rows.append((rng.randrange(55), " ".join(text)))
    rows += rows[:20] + [rows[0]] * 5
    made = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=80).collect()
    lengths = sorted((i, len(shingles(t, 3))) for i, t in rows)
    assert sorted((r.doc_id, r.n_shingles) for r in made) == lengths
    assert {(r.doc_id, r.component_id) for r in made} == {(i, c) for i, _, c in brute(rows, 3, 80)}


def test_empty_table(spark):
    made = minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert made.count() == 0 and made.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_components_of_a_chain(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in components(links).collect()} == {0}
