"""Lessons: redundant ones against a plain loop, the durable test, summaries that are mostly Markdown, and the fallback."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomline.functions import statements as st
from loomline.operators import candidates

FULL = "session_id string, project_key string, turn_id string, line int, learning_id string, kind string, basis string, statement string, title string, trigger string, evidence array<string>, confidence string"
TURN = "turn_id string, session_id string, project_key string, turn_index int, first_line int, user_prompt string, commands_seen array<string>, files_touched array<string>"
EVENT = "session_id string, project_key string, turn_id string, turn_index int, event_id string, line int, type string, summary string, confidence string, verification_command string"


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("o")).first().o


@pytest.fixture(autouse=True)
def column(spark):
    global t
    t = F.col("t")


def chosen(rows, keys, cap):
    """The greedy choice restated: by priority, each against all that are held."""
    order = sorted(rows, key=lambda r: (-candidates.PRIORITY[r["basis"]], r["line"], r["learning_id"], r["kind"]))
    held = []
    for r in order:
        k = keys[r["statement"]]

        def same(h, r=r, k=k):
            if h["kind"] == r["kind"]:
                return h["statement"].lower() == r["statement"].lower()
            other = keys[h["statement"]]
            return len(k) >= 32 and len(other) >= 32 and (k in other or other in k)

        if not any(same(h) for h in held):
            held.append(r)
    shown = sorted(held, key=lambda r: (r["line"], -candidates.PRIORITY[r["basis"]], r["learning_id"]))
    return [(r["session_id"], r["learning_id"], place) for place, r in enumerate(shown[:cap])]


@pytest.mark.parametrize("cap", [4, 1000])
def test_redundant_lessons_equal_a_plain_loop(spark, cap):
    rng = random.Random(6)
    words = "parser retries the network layer before giving up on slow hosts and logs every attempt twice".split()
    kinds = [("workflow", "verified-fix"), ("workflow", "workflow"), ("decision", "decision"), ("pattern", "file-scoped"), ("failure_mode", "failure"), ("verification_rule", "verification")]
    rows = []
    for n in range(260):
        start = rng.randrange(0, 8)
        text = " ".join(words[start : start + rng.randrange(1, 10)])
        kind, basis = rng.choice(kinds)
        text = rng.choice([text, text.capitalize(), text + " x", "p" + text])
        rows.append({"session_id": f"s{rng.randrange(6)}", "learning_id": f"l{n:03}", "kind": kind, "basis": basis, "statement": text, "line": rng.randrange(0, 60)})
    frame = spark.createDataFrame([(r["session_id"], "p", "t", r["line"], r["learning_id"], r["kind"], r["basis"], r["statement"], "t", "g", [], "high") for r in rows], FULL)
    keys = {r.statement: r.k for r in frame.select("statement", candidates.semantic_key(F.col("statement")).alias("k")).distinct().collect()}
    want = sorted(x for s in {r["session_id"] for r in rows} for x in chosen([r for r in rows if r["session_id"] == s], keys, cap))
    made = sorted((r.session_id, r.learning_id, r.place) for r in candidates.kept(frame, cap).collect())
    assert made == want and len(want) < len(rows)
    plan = candidates.contained(spark.createDataFrame([("s", 1, "k", "x")], "session_id string, place int, kind string, key string"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize(
    ("kind", "statement", "kept"),
    [
        ("workflow", "Fixed the parser; verified with `npm test`.", True),
        ("workflow", "Let me check the parser first", False),
        ("decision", "**Done:** all of it", False),
        ("workflow", "Run it. summary of what was done", True),
        ("verification_rule", "Run `./scripts/qa` when verifying changes in p.", False),
        ("verification_rule", "Run `npm test` when verifying changes in p.", True),
        ("workflow", "Use `./scripts/qa` for repo workflow in p.", False),
        ("pattern", "In src/a.py, **Cause:** a race", False),
        ("pattern", "Here’s what’s going on in src/a.py", False),
        ("failure_mode", "The CSS is fine but the build is not", False),
        ("decision", "Great question, the table is partitioned by day", False),
        ("decision", "Great question, we decided to partition the table by day", True),
        ("workflow", "Fixed completed; verified.", False),
        ("workflow", "Completed desktop checks are green", False),
        ("workflow", "Fixed | --- | rows", False),
        ("decision", "Keep must-fix items out of the release", False),
        ("dead_end", "Avoid the must-fix list in p", True),
    ],
)
def test_durable_statements(spark, kind, statement, kept):
    assert one(spark, st.durable(F.lit(kind), t), statement) is kept


@pytest.mark.parametrize(
    ("summary", "file", "action"),
    [
        ("## Summary of changes\n- **Parser:** `src/parser.py`: use a lookahead table - keeps speed\n- done", "src/parser.py", "use a lookahead table"),
        ("- a\n- b\n- [src/a/b.ts](x): 'label' - replace the old loop with a map", "src/a/b.ts", "replace the old loop with a map"),
        ("- x\n- lib/one.js add retries to it\n- lib/two.js: remove the cache", "lib/one.js", "add retries to it -"),
        ("- x\n- y\n- /home/me/Code/app/src/c.rs: note: move the lock out of src/c.rs before waiting", "src/c.rs", "note: move the lock out of"),
        ("- x\n- lib/one.js: nothing that helps here\n- more", None, None),
        ("- only words - add tests\n- and more\n- words", None, None),
        ("plain text about src/a.py: use it well always", None, None),
        ("- a\n- b\n- src/a.py: fix", None, None),
    ],
)
def test_summaries_that_are_mostly_markdown(spark, summary, file, action):
    made = one(spark, st.compressed(t), summary)
    want = None if file is None else (file, " ".join(action.split()))
    assert (None if made is None else (made.file, made.action)) == want


def events(spark, rows):
    return spark.createDataFrame([(s, "p", f"{s}:{k}", k, f"e{n}", n, kind, text, "high", None) for n, (s, k, kind, text) in enumerate(rows)], EVENT)


def test_compressed_and_told_fixes(spark):
    turns = spark.createDataFrame([("s:0", "s", "p", 0, 1, "x", [], ["src/z.py"]), ("s:1", "s", "p", 1, 5, "x", [], ["src/y.py"])], TURN)
    markdown = "## Summary of changes\n- **Parser:** `src/parser.py`: use a lookahead table\n- done"
    found = events(spark, [("s", 0, "fix", markdown), ("s", 0, "verification", "all tests pass, done"), ("s", 1, "verification", "Done: the fix is to close the file before renaming.")])
    made = {r.basis: r.statement for r in candidates.of_turns(turns, found).collect()}
    assert made["verified-fix"] == "In src/parser.py, use a lookahead table; verified."
    assert made["verification-only-fix"] == "In src/y.py, close the file before renaming; verified."


def test_fallback_only_without_a_workflow(spark):
    rows = [
        ("a:0", "a", "p", 0, 1, "fix the slow import of the parser module", ["ls", "python tools/profile.py"], []),
        ("a:1", "a", "p", 1, 4, "add a test for the lexer", ["ls"], ["/home/me/Code/app/src/lexer.py"]),
        ("a:2", "a", "p", 2, 6, "hello", ["./run.sh"], []),
        ("a:3", "a", "p", 3, 8, "update ONLY this file please", ["./run.sh"], []),
        ("a:4", "a", "p", 4, 9, "What do you think of the colour of it all today", ["./run.sh"], ["src/c.css"]),
        ("b:0", "b", "p", 0, 1, "fix the slow import of the parser module", ["./run.sh"], []),
    ]
    turns = spark.createDataFrame(rows, TURN)
    flow = spark.createDataFrame([("b", "workflow"), ("a", "decision")], "session_id string, kind string")
    made = {r.turn_id: r.statement for r in candidates.of_fallback(turns, flow).collect()}
    assert made == {
        "a:0": "Use `python tools/profile.py` for fix the slow import of the parser module in p.",
        "a:1": "When working on add a test for the lexer, inspect src/lexer.py in p.",
        "a:4": "Use `./run.sh` when working on src/c.css in p.",
    }
