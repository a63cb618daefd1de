"""Counts against a plain loop; outliers planted in a clean corpus."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from loomline.llm import quality_rules
from loomline.llm.queries import op8_quality_rules

SF = "/root/testdata/sf0.01"


def counted(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_counts_equal_a_loop(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    made = op8_quality_rules(spark, SF).collect()
    assert len(made) == len(rows)
    for r in made:
        n = counted(rows[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and not (r.base_failed and r.kept)
    assert sum(r.kept for r in made if not r.base_failed) > 0.8 * sum(not r.base_failed for r in made)


def clean(rng, n):
    return ". ".join(" ".join(rng.choice(["the", "of", "river", "stone", "under", "light", "walks", "slowly"]) + str(rng.randrange(90)) for _ in range(12)) for _ in range(n))


def test_planted_outliers_go_and_clean_documents_stay(spark):
    rng = random.Random(1)
    rows = [(i, clean(rng, 6), "en", "a") for i in range(200)] + [(1000 + i, "|| <> ## ** " * 40 + clean(rng, 2), "en", "a") for i in range(8)]
    made = {r.doc_id: r.kept for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(made[1000 + i] for i in range(8)) and sum(made[i] for i in range(200)) >= 196


def test_edge_cases(spark):
    rows = [(1, None, None, None, 5), (2, "", "en", None, 5), (3, " \n\t ", None, "s", 5), (4, "word " * 50_000, "en", "s", 5), (4, "word " * 50_000, "en", "s", 5), (None, "a b", "x", "y", 5)]
    made = quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")).collect()
    assert len(made) == 6 and all(r.base_failed and not r.kept for r in made)
    assert quality_rules.judged(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def floored(x):
    return np.cov(x.T, bias=True) + np.diag([quality_rules.FLOOR[s] ** 2 for s in quality_rules.SHARES])


@pytest.mark.parametrize("seed", range(4))
def test_smallest_determinant_of_small_groups(spark, seed, monkeypatch):
    """Of all subsets of three quarters of a group, the estimate's has (but for the bins' width) the smallest determinant."""
    monkeypatch.setattr(quality_rules, "BINS", 4_000)
    monkeypatch.setattr(quality_rules, "PRIOR", 0)
    rng = np.random.default_rng(seed)
    groups = {}
    for g in "abc":
        x = rng.normal(scale=rng.uniform(0.05, 0.4, 5), size=(12, 5)) @ np.linalg.qr(rng.normal(size=(5, 5)))[0]
        x[:3] += rng.normal(scale=1.5, size=5)  # a cluster of outliers
        groups[g] = x
    rows = [(g, "*", *map(float, v)) for g, x in groups.items() for v in x]
    frame = spark.createDataFrame(rows, ["g1", "g2", *quality_rules.SHARES])
    best, _ = quality_rules.fit(frame)
    for r in best.collect():
        x = groups[r.g1]
        least = min(np.linalg.slogdet(floored(x[list(s)]))[1] for s in itertools.combinations(range(12), 9))
        assert r.log_det == pytest.approx(least, abs=1e-6)
        centre = np.array([r[f"c_{i}"] for i in range(5)])
        assert np.abs(centre - x[3:].mean(axis=0)).max() < 1e-6


def quartiles(values, weights_of=(0.25, 0.5, 0.75)):
    """Upper edges of the bins that hold the quantiles."""
    bins = np.sort(np.floor(values * quality_rules.BINS).astype(np.int64))
    at = [bins[max(0, math.ceil(q * len(bins)) - 1)] for q in weights_of]
    return [(b + 1) / quality_rules.BINS for b in at]


def robust(x, centre, var):
    """The rule for one group in numpy: best of three starts after two steps, then steps until the determinant stays."""
    floor, k = np.diag([quality_rules.FLOOR[s] ** 2 for s in quality_rules.SHARES]), quality_rules.PRIOR

    def estimate(weights):
        n, s, ss = weights.sum(), weights @ x, (x * weights[:, None]).T @ x
        n, s, ss = n + k, s + k * centre, ss + k * (np.outer(centre, centre) + np.diag(var))
        c = s / n
        m = ss / n - np.outer(c, c) + floor
        return c, m, np.linalg.slogdet(m)[1]

    def far(c, m):
        d = x - c
        return np.einsum("ij,ij->i", d, np.linalg.solve(m, d.T).T)

    def step(c, m, _):
        bins = np.floor(np.log(far(c, m) + 1e-6) * quality_rules.BINS).astype(np.int64)
        names, place, n = np.unique(bins, return_inverse=True, return_counts=True)
        nearer = np.cumsum(n) - n
        return estimate(np.clip((quality_rules.CLOSEST * len(x) - nearer) / n, 0, 1)[place])

    q = np.array([quartiles(x[:, i]) for i in range(5)])
    begins = [(q[:, 1], np.diag(((q[:, 2] - q[:, 0]) / 1.349) ** 2) + floor, 0), estimate(np.ones(len(x))), (q[:, 1], floor, 0)]
    for _ in range(quality_rules.FIRST_STEPS):
        begins = [step(*b) for b in begins]
    now = min(begins, key=lambda b: b[2])
    for _ in range(quality_rules.MOST_STEPS):
        was, now = now, step(*now)
        if abs(now[2] - was[2]) < quality_rules.SETTLED:
            break
    d2 = far(*now[:2])
    middle = quartiles(np.log(d2 + 1e-6), (0.5,))[0]
    return d2 / max(1.0, math.exp(middle) / quality_rules.CHI_MEDIAN)


def test_query_equals_numpy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = quality_rules.judged(docs.select("doc_id", "text", "lang", "source")).collect()
    assert {(r.doc_id, r.kept, r.distance) for r in op8_quality_rules(spark, SF).select("doc_id", "kept", "distance").collect()} == {(r.doc_id, r.kept, r.distance) for r in made}
    good = [r for r in made if not r.base_failed]
    x = np.array([[r[s] for s in quality_rules.SHARES] for r in good])
    lang, source = np.array([r.lang for r in good]), np.array([r.source for r in good])

    def spread(rows):
        q = np.array([quartiles(rows[:, i]) for i in range(5)])
        return q[:, 1], ((q[:, 2] - q[:, 0]) / 1.349) ** 2

    every, want = spread(x), np.zeros(len(good))
    for name in set(lang):
        rows = x[lang == name]
        prior = [(len(rows) * own + quality_rules.PRIOR * a) / (len(rows) + quality_rules.PRIOR) for own, a in zip(spread(rows), every, strict=True)]
        for s in set(source[lang == name]):
            here = (lang == name) & (source == s)
            want[here] = robust(x[here], *prior)
    got = np.array([r.distance for r in good])
    assert np.allclose(got, want, rtol=1e-6)
    assert [r.kept for r in good] == list(want <= quality_rules.CHI_CUT)


def test_a_group_weighs_by_its_rows(spark):
    """A few rows hardly move the estimate of their language; no number of rows switches it."""
    rng = random.Random(2)
    rows = [(i, clean(rng, 6), "en", "b") for i in range(120)] + [(1000 + i, clean(rng, 6) + " ##", "en", f"s{i % 3}") for i in range(9)] + [(2000, "|| <> ## ** " * 40 + clean(rng, 2), "en", "s0")]
    made = {r.doc_id: r.kept for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not made[2000] and all(made[1000 + i] for i in range(9))
