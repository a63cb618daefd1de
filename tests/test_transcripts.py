"""Five dialects of one session give the same records."""

from __future__ import annotations

import json

import pytest

from loomline.operators import turns
from loomline.operators.turns import ASSISTANT, EVENT, TOOL_RESULT, TOOL_USE, USER
from loomline.sources import transcripts as tr

UUID = "0b5e2a52-9f6c-4d58-8d7e-000000000001"
MD5 = "d41d8cd98f00b204e9800998ecf8427e"
FILES = {
    "cursor": (
        f"proj/agent-transcripts/a/{UUID}.jsonl",
        [
            {"type": "user", "timestamp": "t1", "text": "<user_query>fix the parser</user_query> <x>"},
            {"role": "assistant", "message": {"content": [{"type": "text", "text": "Fixed in /home/a/b.py"}]}},
            {"type": "tool_call", "name": "sh", "id": "c1", "arguments": {"command": "npm test", "cwd": "/home/a"}},
            {"type": "tool_result", "status": "failed", "summary": "it failed"},
        ],
    ),
    "claude-code": (
        f"projects/-home-a/{UUID}.jsonl",
        [
            {"type": "user", "timestamp": "t1", "cwd": "/home/a", "message": {"role": "user", "content": "fix the parser"}},
            {"type": "assistant", "message": {"content": [{"type": "text", "text": "Fixed in /home/a/b.py"}]}},
            {"type": "tool_use", "name": "sh", "id": "c1", "arguments": {"command": "npm test"}},
            {"type": "tool_result", "status": "failed", "summary": "it failed"},
        ],
    ),
    "codex-cli": (
        f"sessions/2026/05/03/rollout-{UUID}.jsonl",
        [
            {"timestamp": "t1", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "fix the parser"}]}},
            {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"text": "Fixed in /home/a/b.py"}]}},
            {"type": "response_item", "payload": {"type": "function_call", "name": "sh", "call_id": "c1", "command": "npm test"}},
            {"type": "response_item", "payload": {"type": "function_call_output", "status": "failed", "message": "it failed"}},
        ],
    ),
    "kimi": (
        f"sessions/{MD5}/{UUID}/wire.jsonl",
        [
            {"timestamp": "t1", "message": {"type": "TurnBegin", "payload": {"user_input": [{"type": "text", "text": "fix the parser"}]}}},
            {"message": {"type": "ContentPart", "payload": {"type": "text", "text": "Fixed in /home/a/b.py"}}},
            {"message": {"type": "ToolCall", "payload": {"id": "c1", "function": {"name": "sh", "arguments": json.dumps({"command": "npm test"})}}}},
            {"message": {"type": "ToolResult", "payload": {"return_value": {"output": "it failed"}}}},
        ],
    ),
    "pi": (
        f"sessions/--home--/2026_{UUID}.jsonl",
        [
            {"type": "message", "timestamp": "t1", "message": {"role": "user", "content": [{"type": "text", "text": "fix the parser"}]}},
            {"type": "message", "message": {"role": "assistant", "content": [{"type": "text", "text": "Fixed in /home/a/b.py"}]}},
            {"type": "session", "cwd": "/home/a", "version": 1},
            {"type": "message", "message": {"role": "toolResult", "status": "failed", "content": [{"text": "it failed"}]}},
        ],
    ),
}


def write(root, tool, extra=()):
    path, rows = FILES[tool]
    file = root / path
    file.parent.mkdir(parents=True)
    lines = [json.dumps(r) for r in rows]
    lines.insert(1, "")  # blank lines are skipped but counted
    file.write_text("\r\n".join([*lines, *extra]) + "\n", encoding="utf-8")
    return str(root)


@pytest.mark.parametrize("tool", sorted(FILES))
def test_dialects_agree(spark, tmp_path, tool):
    root = write(tmp_path, tool)
    rows = tr.records(tr.lines(spark, tool, root), tool).orderBy("line").collect()
    assert [r.line for r in rows] == [1, 3, 4, 5] and {r.session_id for r in rows} == {UUID if tool != "codex-cli" else f"rollout-{UUID}"}
    third = EVENT if tool == "pi" else TOOL_USE
    assert [r.kind for r in rows] == [USER, ASSISTANT, third, TOOL_RESULT]
    assert rows[0].text == "fix the parser" and rows[0].ts == "t1" and rows[1].files == ["/home/a/b.py"] and rows[3].text == "it failed"
    if tool != "pi":
        assert (rows[2].tool_name, rows[2].call_id, rows[2].input_text, rows[2].commands) == ("sh", "c1", "npm test", ["npm test"])
    found = tr.discovered(spark, tool, root).collect()
    assert len(found) == 1 and found[0].source_hash.startswith("sha256:") and found[0].session_id == rows[0].session_id
    same = tr.from_text(spark.createDataFrame([(found[0].source_path, (tmp_path / FILES[tool][0]).read_text())], "source_path string, content string"), tool)
    assert [r.text for r in tr.records(same, tool).orderBy("line").collect()] == [r.text for r in rows]


def test_bad_lines_and_redaction(spark, tmp_path):
    root = write(tmp_path, "claude-code", ["[1, 2]", "{broken"])
    assert [r.line for r in tr.bad_lines(tr.lines(spark, "claude-code", root)).orderBy("line").collect()] == [6, 7]
    assert tr.records(tr.lines(spark, "claude-code", root), "claude-code").count() == 0
    raw = [json.dumps({"type": "user", "isRedacted": True, "message": {"content": "x"}}), json.dumps({"type": "user", "message": {"content": " [Redacted] "}}), json.dumps({"type": "user", "redacted": "x", "message": {"content": "kept"}})]
    frame = spark.createDataFrame([("f/s.jsonl", "\n".join(raw))], "source_path string, content string")
    made = tr.records(tr.from_text(frame, "claude-code"), "claude-code").orderBy("line").collect()
    assert [(r.redacted, r.text) for r in made] == [(True, None), (True, None), (False, "kept")]


def test_turns_of_a_session(spark):
    kinds = [ASSISTANT, TOOL_RESULT, USER, ASSISTANT, USER, ASSISTANT]
    rows = [("s", i + 1, k, None if i == 4 else f"m{i}", i == 4) for i, k in enumerate(kinds)] + [("quiet", 1, ASSISTANT, "x", False)]
    frame = turns.grouped(turns.with_defaults(spark.createDataFrame(rows, "session_id string, line int, kind string, text string, redacted boolean")))
    made = turns.rolled_up(frame).orderBy("turn_index").collect()
    assert [(r.turn_id, r.first_line, r.last_line, r.user_prompt, r.tool_stub_count) for r in made] == [("s:turn-0000", 1, 4, "m2", 1), ("s:turn-0001", 5, 6, "[redacted user message]", 0)]
    assert made[0].assistant_messages == ["m0", "m3"]
