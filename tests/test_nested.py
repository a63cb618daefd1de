"""Nested JSON in SQL against plain recursion: texts, and what an editor's entries speak of."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from loomline.functions import nested
from loomline.operators import attribution
from loomline.sources import transcripts as tr


def flat(value, between="\n\n"):
    """The text of a JSON value: a string, the texts of an array, or of an object its text, else content, message or body."""
    if isinstance(value, str):
        return value.strip() or None
    if isinstance(value, list):
        return between.join(t for t in (flat(x, between) for x in value) if t) or None
    if isinstance(value, dict):
        own = value.get("text")
        if isinstance(own, str) and own.strip():
            return own.strip()
        return next((t for t in (flat(value.get(k), between) for k in ("content", "message", "body")) if t), None)
    return None



def anything(rng, depth):
    k = rng.randrange(8)
    if depth == 0 or k < 2:
        return rng.choice(["a", " b ", "", "x\ny", 3, None, True, "c"])
    if k < 5:
        return [anything(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["text", "content", "message", "body", "other"]): anything(rng, depth - 1) for _ in range(rng.randrange(4))}


def test_texts_of_any_depth(spark):
    rng = random.Random(1)
    values = [anything(rng, rng.randrange(7)) for _ in range(500)]
    deep = "z"
    for i in range(60):
        deep = [deep, "w"] if i % 2 else {"content": [deep, "q"], "body": "never"}
    raw = {json.dumps(v): v for v in [*values, deep]}
    made = spark.createDataFrame([(x,) for x in raw], "raw string").select("raw", nested.flat_text(F.parse_json("raw"), "|").alias("t"))
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
    assert {r.raw: r.t for r in made.collect()} == {x: flat(v, "|") for x, v in raw.items()}


def test_records_need_no_python(spark):
    frame = spark.createDataFrame([("pi", "/w/s.jsonl", "s", 1, "{}")], "source_tool string, source_path string, session_id string, line int, raw string")
    for tool in tr.DIALECTS:
        assert "Python" not in tr.records(frame, tool)._jdf.queryExecution().executedPlan().toString(), tool


def test_attribution(spark):
    value = {
        "composerId": "c1", "tabs": [{"conversationId": "v1", "note": "see /home/me/app and C:\\w\\x"}, {"deep": {"RequestID": "r1", "list": [{"sessionId": "s1"}, "plain"]}}],
        "sessionId": ["not-direct"], "id": "i0", "nowActive": {"more": [{"id": "i1", "workspaceId": 7}]}, "root": {"path": ["/data/app", "relative"]}, "workspaceStorageId": "ws1",
    }
    rows = [("composer.state", json.dumps(value)), ("workspace.last", "/srv/site"), ("active.tab", json.dumps({"id": "i2"})), ("session.raw", "not json /tmp/x.log"), ("session.none", None), ("session.empty", " ")]
    made = {(r.kind, r.name) for r in attribution.attributed(spark.createDataFrame(rows, "key string, value string")).collect()}
    assert made == {
        ("active_composer", "c1"), ("active_composer", "i1"), ("active_composer", "i2"), ("conversation", "v1"), ("request", "r1"), ("session", "s1"), ("workspace_storage", "ws1"),
        ("workspace_path", "/home/me/app"), ("workspace_path", "C:\\w\\x"), ("workspace_path", "/data/app"), ("workspace_path", "/srv/site"), ("workspace_path", "/tmp/x.log"),
        *(("entry", k) for k, _ in rows),
    }


def test_one_tool_names_its_workspace_in_the_preamble(spark):
    rows = [("pi", "a", 1, "title", None), ("pi", "a", 2, "session", "/w/a"), ("pi", "b", 1, "message", None), ("pi", "b", 2, "session", "/w/b"), ("pi", "d", 40, "session", "/w/d")]
    rows += [("pi", "c", n, "title", None) for n in range(1, 17)] + [("pi", "c", 17, "session", "/w/c"), ("claude-code", "e", 1, "user", None), ("claude-code", "e", 2, "user", "/w/e")]
    frame = spark.createDataFrame(rows, "source_tool string, session_id string, line int, raw_type string, cwd string")
    assert {r.session_id: r.workspace_path for r in tr.workspaces(frame).collect()} == {"a": "/w/a", "b": None, "c": None, "d": "/w/d", "e": "/w/e"}
