"""Mixing keeps every row and every source within one block of its share."""

from __future__ import annotations

import math
import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from loomline.llm import mixing
from loomline.llm.queries import op10_mixing

SF = "/root/testdata/sf0.01"


def scheduled(plan):
    """Source and block of every slot, frame by frame."""
    out = []
    for phase in plan:
        for k in range(phase.frames):
            for slot, i, block in phase.planned(k):
                assert slot == len(out)
                out.append((phase.sources[i], block))
    return out


def deviation(plan, every=1):
    """The largest deviation of a source from its exact share of its phase, at every slot (or each so many)."""
    worst, slots = Fraction(0), iter(scheduled(plan))
    for phase in plan:
        total, had = sum(phase.weights), Counter()
        for at in range(1, phase.length + 1):
            had[next(slots)[0]] += 1
            if at % every == 0:
                worst = max(worst, *(abs(Fraction(had[s] * total - w * at, total)) for s, w in zip(phase.sources, phase.weights, strict=True)))
    return worst


def earliest_deadlines(blocks, shares):
    """A phase by the plain rule: in each slot, of all released blocks the one with the earliest deadline."""
    total, names = sum(map(Fraction, shares.values())), sorted(shares)
    w, turn, out = {s: Fraction(shares[s]) / total for s in names}, Counter(), []
    while all(turn[s] < blocks[s] for s in names):
        ready = [(math.ceil((turn[s] + 1) / w[s]), s) for s in names if math.floor(turn[s] / w[s]) <= len(out)]
        due, s = min(ready)
        assert due > len(out)
        out.append((s, turn[s]))
        turn[s] += 1
    return out


def test_one_frame_is_the_plain_rule():
    for shares in ({"a": 1.0}, {"a": 5, "b": 3, "c": 2}, {"a": 1, "b": 1, "c": 97}, {"a": math.pi, "b": math.sqrt(2), "c": 1 / 3}, {str(i): i + 0.5 for i in range(12)}):
        blocks = dict.fromkeys(shares, 400)
        plan, want = mixing.phases(blocks, shares), earliest_deadlines(blocks, shares)
        assert plan[0].frames == 1 and scheduled(plan)[: len(want)][:-50] == want[:-50]  # the end of a phase binds the last ones


@pytest.mark.parametrize(
    ("shares", "frame"),
    [({"a": 7, "b": 7, "c": 3}, 1 << 16), ({"a": 7, "b": 7, "c": 3}, 1000), ({"a": 1.0, "b": 0.0001}, 1 << 14), ({"a": math.pi, "b": math.e, "c": math.sqrt(2), "d": 1e-4, "e": 0.1}, 1 << 14)],
)
def test_100_000_slots_stay_within_one_block(monkeypatch, shares, frame):
    monkeypatch.setattr(mixing, "FRAME", frame)
    plan = mixing.phases({s: int(120_000 * w / sum(shares.values())) + 2 for s, w in shares.items()}, shares)
    assert sum(p.length for p in plan) > 100_000 and deviation(plan) < 1


def test_a_thousand_sources(monkeypatch):
    monkeypatch.setattr(mixing, "FRAME", 4096)
    rng = random.Random(1)
    blocks = {f"s{i:03}": 60 + i % 7 for i in range(1000)}
    plan = mixing.phases(blocks, {s: 1 + rng.random() for s in blocks})
    assert deviation(plan, 499) < 1 and Counter(s for s, _ in scheduled(plan)) == Counter(blocks)


def test_random_weights_sizes_and_frames(monkeypatch):
    rng = random.Random(2)
    for _ in range(150):
        monkeypatch.setattr(mixing, "FRAME", rng.choice([1, 3, 16, 100]))
        names = [f"s{i}" for i in range(rng.randrange(1, 12))]
        blocks = {s: rng.choice([0, 1, 2, 5, 30, 200]) for s in names}
        shares = {s: rng.choice([0, -1, 1, 2, 3, math.pi, math.sqrt(2), 0.1, 1 / 3, 1e-3, rng.random()]) for s in names if rng.random() < 0.9}
        plan = mixing.phases(blocks, shares)
        slots = scheduled(plan)
        assert deviation(plan) < 1 if slots else plan == []
        for s, n in blocks.items():
            assert [b for name, b in slots if name == s] == list(range(n))  # every block once, in order


def test_weights_hold_until_a_source_runs_out():
    blocks, shares = {"a": 2, "b": 30, "c": 57, "d": 4000, "e": 5}, {"a": 1.0, "b": 1.0, "c": 3.0, "d": 5.0}
    plan = mixing.phases(blocks, shares)
    left = Counter(blocks)
    for phase in plan[:-1]:
        assert set(phase.sources) == {s for s in shares if left[s]}
        assert [Fraction(w) / sum(phase.weights) for w in phase.weights] == [Fraction(shares[s]) / sum(Fraction(shares[x]) for x in phase.sources) for s in phase.sources]
        left.subtract(dict(zip(phase.sources, phase.had, strict=True)))
        assert not all(left[s] for s in phase.sources)
    assert plan[-1].sources == ["e"] and [s for s, _ in scheduled(plan)[-5:]] == ["e"] * 5


def test_query_keeps_rows_and_shares(spark):
    made = op10_mixing(spark, SF).collect()
    assert len(made) == spark.read.parquet(f"{SF}/documents.parquet").count() == len({r.doc_id for r in made})
    by = {}
    for r in made:
        by.setdefault((r.source, r.block), set()).add(r.slot)
    assert all(len(s) == 1 for s in by.values())
    slots = [next(iter(s)) for s in by.values()]
    assert len(slots) == len(set(slots))


def test_running_sizes(spark):
    rows = [(i, "x" * (i % 9), "s" if i % 3 else None) for i in range(3_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    made = mixing.mix(frame, F.length("text"), block_size=500).collect()
    for source in ("s", None):
        own = sorted((r.start, len(r.text), r.block) for r in made if r.source == source)
        at = 0
        for start, size, block in own:
            assert start <= at <= start + 8 or start == at
            assert block == start // 500
            at = start + size


def test_edge_cases(spark):
    rows = [(1, None, "a", 9), (None, "x", None, 9), (2, "y" * 200_000, "a", 9), (2, "y" * 200_000, "a", 9), (3, "", "b", 9)]
    made = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, slot int"), F.length("text"), {"a": 1.0, None: 1.0})
    assert made.count() == 5 and made.columns == ["doc_id", "text", "source", "start", "block", "slot"]
    assert mixing.in_order(made).count() == 5
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string"), F.length("text")).count() == 0


def test_query_holds_square_root_weights(spark):
    made = op10_mixing(spark, "/root/testdata/sf0.1").collect()
    size = Counter()
    for r in made:
        size[r.source] += r.size or 0
    for s, n in size.items():  # a row takes up all blocks it covers, also those in which no row starts
        assert {r.block for r in made if r.source == s} <= set(range(n // mixing.BLOCK + 1))
    shares = {s: max(n, 1) ** 0.5 for s, n in size.items()}
    plan = mixing.phases({s: n // mixing.BLOCK + 1 for s, n in size.items()}, {f"{s}": w for s, w in shares.items()})
    slots = scheduled(plan)
    assert all(slots[r.slot] == (r.source, r.block) for r in made)
    assert deviation(plan) < 1


def test_many_planned_slots_join_by_block(spark, monkeypatch):
    frame = spark.createDataFrame([(i, "x" * (i % 90), f"s{i % 7 * (i % 3)}") for i in range(2_000)], "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "FRAME", 16)
    broadcast = sorted(mixing.mix(frame, F.length("text"), block_size=500).collect())
    monkeypatch.setattr(mixing, "MAX_PLANNED", 0)
    assert sorted(mixing.mix(frame, F.length("text"), block_size=500).collect()) == broadcast and len(broadcast) == 2_000
