"""Stateful parts: replay of deltas, incremental ingest, sinks, review with a provider."""

from __future__ import annotations

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import costs, instincts, review
from loomline.plans.catalog import queries
from loomline.sources import sinks
from loomline.streaming import ingest

SF = "/root/testdata/sf0.001"


def replayed(rows):
    """The six operations restated as a plain loop."""
    held = {}

    def value(r, now):
        v = r["floor"]
        for good, at in r["obs"]:
            v += (0.04 if good else -0.16) * 0.5 ** (max(0.0, (now - at).total_seconds() / 86400) / 90)
        return min(0.9, max(0.3, v))

    for r in sorted(rows, key=lambda r: (r["at"], r["pos"])):
        me, op = held.get(r["id"]), r["op"]
        if op == "create" and me is None:
            held[r["id"]] = {"finding": "f", "floor": 0.7, "obs": [(True, r["at"])], "gone": False, "at": r["at"]}
        elif op in ("create", "reinforce", "correct"):
            if me is not None and not me["gone"]:
                me["obs"].append((op != "correct", r["at"]))
                me["at"] = r["at"]
                me["gone"] = value(me, r["at"]) < 0.301
                if op == "correct":
                    me["finding"] = f"not {r['pos']}"
        elif op in ("deprecate", "revive"):
            if me is not None:
                me["gone"], me["at"] = op == "deprecate", r["at"]
        elif op == "merge":
            to = held.get(r["into"])
            if me is not None and to is not None and not to["gone"]:
                to["obs"] = to["obs"] + me["obs"]
                to["floor"], to["at"] = max(to["floor"], me["floor"]), r["at"]
                to["gone"] = value(to, r["at"]) < 0.301
            held.pop(r["id"], None)
    return held


def test_fold_of_all_operations(spark):
    by = {}
    for e in spark.read.parquet(f"{SF}/events.parquet").collect():
        n = math.floor(e.value)
        op = "correct" if e.event_type == "error" else "deprecate" if n % 29 == 3 else "revive" if n % 29 == 5 else "merge" if n % 97 == 7 else "create" if e.event_type == "signup" else "reinforce"
        by.setdefault(f"p{e.user_id % 7}", []).append({"at": e.ts, "pos": e.event_id, "op": op, "id": f"i{e.user_id}", "into": f"i{e.user_id + 7}"})
    want = sorted((p, i, r["finding"], r["gone"], len(r["obs"])) for p, rows in by.items() for i, r in replayed(rows).items())
    made = sorted((r.project_id, r.instinct_id, r.finding, r.deprecated, r.n_observations) for r in queries()["l10_fold_deltas"](spark, SF).collect())
    assert made == want


def test_fold_groups_only_what_merges_connect(spark):
    at = [f"2024-01-01 00:00:{s:02d}" for s in range(30)]
    ids = ["a", "b", "c", "d", "e", "f", "g"]
    made = [("p", "create", i, None) for i in ids] + [("q", "create", i, None) for i in ids]
    merges = [("p", "merge", "a", "b"), ("p", "merge", "b", "c"), ("p", "merge", "d", "e"), ("p", "merge", "f", None), ("q", "merge", "a", "g"), ("p", "merge", "g", "g")]
    rows = [(p, "s", at[k], k, op, i, "t", "f", "workflow", 0.5, None, into) for k, (p, op, i, into) in enumerate(made + merges)]
    schema = "project_id string, session_id string, at string, pos long, op string, instinct_id string, trigger string, finding string, domain string, initial_confidence double, correction string, into string"
    frame = spark.createDataFrame(rows, schema).withColumn("at", F.col("at").cast("timestamp"))
    groups = {}
    for r in instincts.connected(frame).collect():
        groups.setdefault((r.project_id, r._group), set()).add(r.instinct_id)
    assert sorted((p, "".join(sorted(g))) for (p, _), g in groups.items()) == [("p", "abc"), ("p", "de"), ("p", "f"), ("p", "g"), ("q", "ag"), *(("q", i) for i in "bcdef")]
    left = sorted((r.project_id, r.instinct_id, len(r.observations)) for r in instincts.fold(frame).collect())
    assert left == [("p", "c", 3), ("p", "e", 2), *(("q", i, 1) for i in "bcdef"), ("q", "g", 2)]


def test_eligibility_after_a_contradiction(spark):
    rows = [("a", f"2024-01-{d:02d} 00:00:00", d, ok) for d, ok in ((1, True), (2, False), (3, True), (4, True), (20, True))]
    frame = spark.createDataFrame(rows, "k string, at string, ord int, reinforcing boolean").withColumn("at", F.col("at").cast("timestamp"))
    assert [str(r.eligible_at) for r in instincts.reached(frame, ["k"], F.lit(0.7)).collect()] == ["2024-01-20 00:00:00"]
    assert instincts.reached(frame, ["k"], F.lit(0.4)).count() == 0


def test_available_now_equals_the_batch(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    whole = spark.read.parquet(f"{SF}/events.parquet")
    for part in (0, 1):
        whole.where(F.col("event_id") % 2 == part).unionByName(whole.where("event_id < 20")).write.mode("append").parquet(source)
        stream = spark.readStream.schema(whole.schema).parquet(source)
        ingest.available_now(stream, ingest.keyed_upsert(target, ["event_id"]), str(tmp_path / "state"))
    made = spark.read.parquet(target).drop("batch")
    assert made.count() == whole.count() and made.exceptAll(whole).count() == 0


def test_changed_content_is_a_newer_version(spark, tmp_path):
    target, schema = str(tmp_path / "out"), "k string, h string"
    write = ingest.keyed_upsert(target, ["k"], "h")
    for number, rows in enumerate(([("a", "1"), ("b", "1")], [("a", "1"), ("b", "2")], [("b", "1"), ("c", "1")])):
        for _ in range(2):  # a batch that is tried again changes nothing
            write(spark.createDataFrame(rows, schema), number)
    table = spark.read.parquet(target)
    assert sorted((r.k, r.h, r.batch) for r in table.collect()) == [("a", "1", 0), ("b", "1", 0), ("b", "1", 2), ("b", "2", 1), ("c", "1", 2)]
    assert sorted(tuple(r) for r in ingest.latest(table, ["k"]).collect()) == [("a", "1"), ("b", "1"), ("c", "1")]


def test_manifests_are_immutable(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "k string, v string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "k string, v string")
    made = {r.k: r.action for r in sinks.new_manifests(old, new, ["k"], ["v"], override=True).collect()}
    assert made == {"a": "same", "b": "replace", "c": "create"}
    with pytest.raises(Exception, match="other content"):
        sinks.new_manifests(old, new, ["k"], ["v"]).collect()


def test_logs_and_pages(spark, tmp_path):
    frame = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    for _ in range(2):
        sinks.append_log(frame, str(tmp_path / "log"), "k")
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    pages = spark.createDataFrame([("new", "x"), ("same", "x"), ("edited", "x")], "id string, body string")
    digest = "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"
    published = spark.createDataFrame([("same", digest, digest), ("edited", digest, "other")], "id string, content_hash string, actual_hash string")
    assert {r.id: r.status for r in sinks.page_status(pages, published, "id", "body").collect()} == {"new": "written", "same": "skipped_unchanged", "edited": "skipped_protected"}


def test_a_failing_lot_leaves_the_others_alone(spark):
    def provider(rows):
        if any(r["learning_id"] == 3 for r in rows):
            raise RuntimeError("down")
        return [{"verdict": "keep", "suggested_statement": "s"}] * len(rows)

    frame = spark.range(6).selectExpr("id as learning_id").coalesce(1)
    made = {r.learning_id: r.verdict for r in review.reviewed(frame, provider, size=2).collect()}
    assert made == {0: "keep", 1: "keep", 2: "error", 3: "error", 4: "keep", 5: "keep"}


def test_windows():
    assert costs.parse_window("50/24h") == (50.0, 86_400) and costs.parse_window(" 0.5/90m ") == (0.5, 5_400)
    for bad in ("50", "5/0h", "x/2h", "5/2d", "-1/2h"):
        with pytest.raises(ValueError):
            costs.parse_window(bad)


def test_closed_form_equals_the_replay(spark):
    """Random deltas: records that sink, are deprecated, revived before and after sinking, merged, and never created."""
    rng = random.Random(11)
    start, rows = datetime.datetime(2024, 1, 1), []
    for record in range(150):
        kinds = rng.choice([["reinforce", "correct"], ["correct"], ["reinforce", "correct", "correct", "revive", "deprecate"], ["create", "reinforce", "merge", "correct", "revive"]])
        count = rng.randrange(1, 14)
        for k in range(count):
            op = "create" if k == 0 and rng.random() < 0.9 else rng.choice(kinds)
            at = start + datetime.timedelta(hours=rng.choice([0, 1, 5, 24, 24 * 60, 24 * 200]) * k)
            rows.append({"at": at, "pos": record * 100 + k, "op": op, "id": f"i{record}", "into": f"i{rng.randrange(100, 150)}" if op == "merge" else None})
    made = [("p", "s", r["at"], r["pos"], r["op"], r["id"], "t", "f", "workflow", 0.7, f"not {r['pos']}", r["into"]) for r in rows]
    schema = "project_id string, session_id string, at timestamp, pos long, op string, instinct_id string, trigger string, finding string, domain string, initial_confidence double, correction string, into string"
    frame = spark.createDataFrame(made, schema)
    want = sorted((i, r["finding"], r["gone"], [o[0] for o in r["obs"]], r["at"]) for i, r in replayed(rows).items())
    for placed in (frame, frame.withColumn("pos", F.struct("session_id", "pos"))):
        got = sorted((r.instinct_id, r.finding, r.deprecated, [o.reinforcing for o in r.observations], r.updated_at) for r in instincts.fold(placed).collect())
        assert got == want
    free, tied = instincts.split(frame)
    merged = {i for r in rows if r["op"] == "merge" for i in (r["id"], r["into"])}
    assert {r.instinct_id for r in tied.collect()} == merged & {r["id"] for r in rows}
    again = {r.instinct_id for r in instincts.traced(free).where("again").collect()}
    revived = {r["id"] for r in rows if r["op"] == "revive"} - merged
    assert again and again < revived  # the rest of the revived ones fold in SQL
