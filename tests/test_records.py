"""YAML records and bundles, JSON lines: round trips and files as other tools write them."""

from __future__ import annotations

import datetime
import random

import pytest

from loomline.operators import instincts
from loomline.sources import artifacts, records

SESSION = """schema_version: session-bundle-v1
session_id: 's''1'
project_id: 'p'
source_adapter: 'pi'
source_transcript: '/x'
ingested_at: '2024-01-01T00:00:00.000Z'
reviewed_at: null
reviewer: null
diary: |
  op: create
  - op: create

deltas:
  - op: create
    instinct_id: 'a'
    trigger: 'when it''s: late'
    finding: 'go home'
    domain: 'workflow'
    initial_confidence: 0.55
  - op: correct
    instinct_id: 'a'
    correction: 'stay'
    delta:
      confidence: -0.16
  - op: merge
    instinct_id: 'a'
    into: 'b'
extraction_cost: null
"""


def test_records_survive_a_round_trip(spark):
    rng = random.Random(3)
    parts = ["it's", "id: 'x'", "a\nb", "  indented", "\n\n", "- session: 'q'", ": |", "é", "''", "key: value", "#"]
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for k in range(40):
        seen = [(f"s'{i}", rng.random() < 0.5, start + datetime.timedelta(minutes=i)) for i in range(rng.randrange(0, 5))]
        text = [" ".join(rng.choices(parts, k=rng.randrange(1, 5))).strip() for _ in range(2)]
        gone = rng.random() < 0.3
        rows.append((f"p{k % 3}", f"i{k}'", text[0], text[1], "git", "project", 0.55, 0.61, "deprecated" if gone else "candidate", gone, seen, start))
    frame = spark.createDataFrame(rows, artifacts.SCHEMAS["instincts"])
    made = records.of_yaml(records.to_yaml(frame), "yaml")
    assert made.columns == frame.columns
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, frame.collect()))


def test_a_text_that_is_no_record_fails(spark):
    with pytest.raises(Exception, match="without an id"):
        records.of_yaml(spark.createDataFrame([("schema_version: x\n",)], "text string")).collect()


def test_bundles_give_deltas(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "s1.yaml").write_text(SESSION)
    (tmp_path / "s2.yaml").write_text(SESSION.replace("s''1", "s2").replace("reviewed_at: null", "reviewed_at: '2024-02-01T00:00:00.000Z'").split("deltas:")[0] + "deltas:\n  []\nextraction_cost: null\n")
    (tmp_path / "notes.md").write_text("no")
    read = records.texts(spark, str(tmp_path))
    assert read.count() == 2
    rows = records.deltas_of_bundles(read)
    made = [(r.session_id, r.pos.pos, r.op, r.instinct_id, r.trigger, r.initial_confidence, r.correction, r.into) for r in rows.orderBy("pos").collect()]
    assert made == [("s'1", 0, "create", "a", "when it's: late", 0.55, None, None), ("s'1", 1, "correct", "a", None, None, "stay", None), ("s'1", 2, "merge", "a", None, None, None, "b")]
    assert [r.finding for r in instincts.fold(rows.where("op <> 'merge'")).collect()] == ["stay"]


def test_index_and_knowledge_lines(spark, tmp_path):
    row = ("s1", "pi", "p", "Parser", "2024-01-01", ["a"], [])
    built = spark.createDataFrame([row], records.INDEX)
    assert [tuple(r) for r in records.index_or(spark, str(tmp_path / "none"), built).collect()] == [row]
    artifacts.export_lines(built, str(tmp_path / "index"), ["session_id"])
    other = spark.createDataFrame([], records.INDEX)
    assert [tuple(r) for r in records.index_or(spark, str(tmp_path / "index"), other).collect()] == [row]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"session_id": "a"}\n\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        records.lines(spark, str(bad), records.INDEX).collect()
    learned = spark.createDataFrame([("p", "s", "l", scope, "decision", "It.", "T", "", ["e"], "high") for scope in ("project", "user")], records.KNOWLEDGE)
    records.export_knowledge(learned, str(tmp_path / "knowledge"))
    back = records.lines(spark, str(tmp_path / "knowledge"), records.KNOWLEDGE)
    assert sorted(map(tuple, back.select(*learned.columns).collect())) == sorted(map(tuple, learned.collect()))
