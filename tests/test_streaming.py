"""Streams by state: turns, trailing budgets and versions equal what batch makes of all that has come so far."""

from __future__ import annotations

import datetime
import random
import threading

import pytest
from pyspark.sql import functions as F

from loomline.operators import costs, turns
from loomline.streaming import ingest

START = datetime.datetime(2024, 1, 1)


@pytest.fixture
def state(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    ingest.with_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def streamed(spark, tmp_path, batches, schema, make):
    """What ``make`` of a stream gives, micro-batch by micro-batch; the query stops and starts again between them."""
    source, out = str(tmp_path / "in"), []
    lock = threading.Lock()

    def write(frame, number):
        with lock:
            out.append((number, [tuple(r) for r in frame.collect()]))

    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        made = make(spark.readStream.schema(schema).parquet(source))
        query = made.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        yield [r for _, part in out for r in part]
        out.clear()


def test_turns_equal_the_batch(spark, tmp_path, state):
    rng = random.Random(2)
    schema = "session_id string, line long, kind string"
    sessions = {f"s{k}": [rng.choice(["user_message", "assistant_message", "tool_use_stub"]) if k else "assistant_message" for _ in range(rng.randrange(1, 12))] for k in range(12)}
    rows = [(s, i + 1, kind) for s, kinds in sessions.items() for i, kind in enumerate(kinds)]
    cuts = {s: sorted(rng.choices(range(len(kinds) + 1), k=2)) for s, kinds in sessions.items()}
    batches = [[r for r in rows if sum(r[1] > c for c in cuts[r[0]]) == k] for k in range(3)]
    made = [r for part in streamed(spark, tmp_path, batches, schema, ingest.turns_as_they_come) for r in part]
    want = turns.grouped(spark.createDataFrame(rows, schema)).select("session_id", "line", "turn_index").collect()
    assert sorted(made) == sorted(tuple(r) for r in want) and "s0" not in {r[0] for r in made}
    first_asked = {s: kinds.index("user_message") for s, kinds in sessions.items() if "user_message" in kinds}
    assert any(at >= cuts[s][0] > 0 for s, at in first_asked.items())  # some leading records waited for a later micro-batch


def test_what_waits_too_long_is_forgotten(spark, tmp_path, state):
    schema, day = "session_id string, line long, kind string, at timestamp", datetime.timedelta(days=1)
    batches = [
        [("a", 1, "assistant_message", START), ("b", 1, "assistant_message", START + 6 * day)],
        [("c", 1, "user_message", START + 9 * day)],  # moves the time on past a's week
        [("a", 2, "user_message", START + 10 * day), ("b", 2, "user_message", START + 10 * day)],
    ]
    parts = list(streamed(spark, tmp_path, batches, schema, lambda s: ingest.turns_as_they_come(s, "at")))
    assert sorted(r for p in parts for r in p) == [("a", 2, 0), ("b", 1, 0), ("b", 2, 0), ("c", 1, 0)]


@pytest.mark.parametrize("amount", [None, "cost"])
def test_budgets_equal_the_batch_after_each_micro_batch(spark, tmp_path, state, amount):
    rng = random.Random(4)
    schema = "account string, at timestamp, cost double, id long"
    rows = []
    for k in range(90):  # times in order over the micro-batches, with ties, gaps over a window and unknown costs
        at = START + datetime.timedelta(minutes=k // 2 + (k // 45) * 300)
        rows.append((rng.choice("ab"), at, rng.choice([None, 0.25, 1.0]), k))
    batches = [rows[k : k + 15] for k in range(0, 90, 15)]
    so_far = []
    for part, fresh in zip(streamed(spark, tmp_path, batches, schema, lambda s: ingest.trailing_budgets(s, "3/20m", "at", ["account"], amount)), batches, strict=True):
        so_far += fresh
        whole = costs.trailing(spark.createDataFrame(so_far, schema), "3/20m", "at", ["account"], None if amount is None else F.col(amount))
        new = {r[3] for r in fresh}
        want = {(r.id, r.used, r.remaining, r.allowed) for r in whole.collect() if r.id in new}
        assert {(r[3], *r[4:]) for r in part} == want


def test_late_uses_count_for_what_comes_after(spark, tmp_path, state):
    schema = "account string, at timestamp"
    minute = datetime.timedelta(minutes=1)
    batches = [[("a", START + 50 * minute)], [("a", START + 40 * minute)], [("a", START + 55 * minute), ("a", None)]]
    parts = list(streamed(spark, tmp_path, batches, schema, lambda s: ingest.trailing_budgets(s, "3/20m", "at", ["account"])))
    assert [[r[2] for r in p] for p in parts] == [[1.0], [1.0], [3.0]]


def test_versions_bring_changes_only(spark, tmp_path, state):
    schema = "k string, seen long, h string"
    batches = [[("a", 1, "x"), ("b", 1, "x"), ("b", 2, "y")], [("a", 3, "x"), ("b", 3, "y"), ("c", 3, None)], [("b", 5, "x"), ("b", 4, "z"), ("c", 4, None), ("a", 4, "x")]]
    parts = list(streamed(spark, tmp_path, batches, schema, lambda s: ingest.versions(s, ["k"], "h", "seen")))
    assert [sorted(p) for p in parts] == [[("a", 1, "x"), ("b", 1, "x"), ("b", 2, "y")], [("c", 3, None)], [("b", 4, "z"), ("b", 5, "x")]]


def test_two_versions_in_a_micro_batch(spark, tmp_path):
    """The newest stays, whichever way the rows come, and a retry keeps the same one."""
    target, schema = str(tmp_path / "out"), "k string, at long, h string"
    write = ingest.keyed_upsert(target, ["k"], "h", ["at"])
    rows = [("a", 1, "z"), ("a", 3, "m"), ("a", 2, "b"), ("b", 1, "q")]
    for order in (rows, rows[::-1]):
        write(spark.createDataFrame(order, schema).repartition(3), 0)
        assert sorted((r.k, r.h, r.batch) for r in spark.read.parquet(target).collect()) == [("a", "m", 0), ("b", "q", 0)]
    for _ in range(2):
        write(spark.createDataFrame([("a", 4, "n"), ("a", 5, "m"), ("b", 2, "r")], schema), 1)
    assert sorted((r.k, r.h, r.batch) for r in spark.read.parquet(target).collect()) == [("a", "m", 0), ("b", "q", 0), ("b", "r", 1)]
