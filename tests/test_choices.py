"""Selection, snapshots, judges, drafts and artifacts on small cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from loomline.functions import answers
from loomline.operators import candidates, judges, run, selection, snapshots, workflow
from loomline.sources import artifacts
from loomline.sources.scratch import shared_dir


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("path", "flat", "allowed"),
    [
        ("MEMORY.md", "MEMORY.md", True),
        (" ./notes/a.md ", "notes/a.md", True),
        ("notes/../../x", None, False),
        ("a/../..", None, False),
        ("a/b/../../MEMORY.md", "MEMORY.md", True),
        ("/MEMORY.md", None, False),
        ("notes/.x", "notes/.x", False),
        ("notes/a/b", "notes/a/b", False),
        ("notes/", "notes/", False),
        ("a\\..\\b", None, False),
        (".hidden", None, False),
        ("", None, False),
    ],
)
def test_paths(spark, path, flat, allowed):
    made = spark.createDataFrame([(path,)], "p string").select(selection.normal_path(F.col("p")).alias("f"), selection.allowed_page(F.col("p"), "notes", "manifest.json").alias("a")).first()
    assert (made.f, made.a) == (flat, allowed)


def test_porcelain_listings(spark):
    text = "worktree /a b\nHEAD h1\nbranch refs/heads/x/td-1A\n\nworktree /c\nHEAD h2\ndetached\n\nworktree /d\nbranch refs/heads/y\n"
    made = selection.worktrees(spark.createDataFrame([("r", text)], "repo string, text string")).orderBy("path").collect()
    assert [(r.repo, r.path, r.head, r.branch, r.detached) for r in made] == [("r", "/a b", "h1", "x/td-1A", False), ("r", "/c", "h2", None, True)]


def _pool(spark, n):
    rows = [(f"i{i}", "p", "d", f"user {i}", "f", 1.0 - i / 100) for i in range(n)]
    return spark.createDataFrame(rows, "instinct_id string, project_id string, domain string, trigger string, finding string, confidence double")


def test_judging_stops_at_budgets_and_after_three_errors(spark):
    empty = spark.createDataFrame([], "cache_key string, answer string")
    yes = json.dumps({"global": True, "confidence": 0.9, "reason": "r"})
    calls = []

    def provider(row):
        calls.append(row["instinct_id"])
        if row["instinct_id"] in ("i2", "i4", "i5", "i6"):
            return ("no json", 0.0) if row["instinct_id"] == "i2" else ('{"global": 1}', 0.0)
        return yes, 1.0

    agreed, made = judges.judged_promotions(_pool(spark, 12), empty, provider, calls_left=99, usd_left=99.0)
    assert sorted(r.instinct_id for r in agreed.collect()) == ["i0", "i1", "i3"] and calls == [f"i{i}" for i in range(7)]
    assert [r.stopped for r in made.collect() if r.stopped] and len([r for r in made.collect() if r.error]) == 4
    cache = made.where("answer is not null").select("cache_key", "answer")
    calls.clear()
    agreed, made = judges.judged_promotions(_pool(spark, 4), cache, provider, calls_left=0, usd_left=0.0)
    assert calls == [] and agreed.count() == 2 and [r.stopped for r in made.collect() if r.stopped] == ["count_budget_exhausted"]
    agreed, _ = judges.judged_promotions(_pool(spark, 2), empty, lambda row: (yes, 1.0), calls_left=9, usd_left=1.0)
    assert agreed.count() == 1


def test_guidance_is_judged_once(spark):
    rows = [(f"wf_{i}", f"r{i}", "c", "weak", "ask", "g", "t", 1, 0) for i in range(3)]
    found = spark.createDataFrame(rows, "candidate_id string, rule_id string, cluster string, confidence string, recommendation string, guidance string, trigger string, supporting_count int, contradicting_count int")
    decided = spark.createDataFrame([("wf_1", "adopt", "", "t", 1)], "candidate_id string, decision string, note string, decided_at string, ord int")
    answer = json.dumps({"wording_ok": False, "artifact_kind": "rule", "confidence": "weak", "reason": "r", "suggested_guidance": "s"})
    made, _ = judges.judged_guidance(found, decided, spark.createDataFrame([], "cache_key string, answer string"), lambda row: (f"Well: {answer}", 0.1), 9, 9.0)
    rows = {r.candidate_id: json.loads(r.note) for r in made.collect()}
    assert set(rows) == {"wf_0", "wf_2"} and rows["wf_0"]["suggested_guidance"] == "s" and rows["wf_0"]["wording_ok"] is False


def test_knowledge_falls_back_where_nothing_is_reviewed(spark):
    rows = spark.createDataFrame([("p", "a", "project"), ("p", "a", "project"), ("q", "b", "user")], "project_id string, text string, scope string")
    records = spark.createDataFrame([("p",)], "project_id string")
    made = snapshots.knowledge_snapshot(snapshots.knowledge(rows.limit(0), rows), records, F.col("text")).collect()
    assert sorted((r.project_id, r.source, r.learnings, r.instincts) for r in made) == [("p", "deterministic-export", 1, 1), ("q", "deterministic-export", 0, 0)]
    assert {r.source for r in snapshots.knowledge(rows.limit(1), rows).collect()} == {"reviewed-export"}


def test_prompt_corpus(spark):
    sessions = spark.createDataFrame([(s, "t", "p", "h", s) for s in "abcd"], "session_id string, source_tool string, project_key string, source_hash string, updated_at string")
    points = spark.createDataFrame([("a", "completed", "h"), ("b", "completed", "old"), ("c", "completed", "h"), ("d", "completed", "h")], "session_id string, state string, source_hash string")
    rows = [("a", "a0", 0, "fix the parser"), ("a", "a1", 1, "You are a helpful agent. Your task is to reply"), ("a", "a2", 2, "<x> add a test"), ("c", "c0", 0, "# AGENTS.md"), ("b", "b0", 0, "x y")]
    turns = spark.createDataFrame([(*r[:3], "t", r[3]) for r in rows], "session_id string, turn_id string, turn_index int, started_at string, user_prompt string")
    messages, manifest = snapshots.prompt_corpus(sessions, points, turns)
    assert sorted((r.turn_id, r.text) for r in messages.collect()) == [("a0", "fix the parser"), ("a2", "add a test")]
    assert {r.session_id: (r.message_count, r.skipped) for r in manifest.collect()} == {
        "a": (2, None), "b": (None, "reduced_checkpoint_missing_or_stale"), "c": (None, "no_substantive_user_messages"), "d": (None, "reduced_artifact_missing"),
    }
    row = snapshots.generation(manifest).first()
    assert (row.session_count, row.message_count, row.generated_at, len(row.generation_id)) == (1, 2, "a", 24)
    assert snapshots.generation(manifest.repartition(3)).first() == row
    assert snapshots.generation(manifest.where("session_id <> 'b'")).first().generation_id != row.generation_id


def test_details_without_summary_or_turns(spark):
    index = spark.createDataFrame([("a",), ("b",)], "session_id string")
    told = spark.createDataFrame([("a", "t")], "session_id string, topic string")
    turns = spark.createDataFrame([("a", 1, "y"), ("a", 0, "x")], "session_id string, turn_index int, text string")
    made = {r.session_id: (r.summary and r.summary.topic, [t.text for t in r.turns]) for r in snapshots.session_details(index, told, turns).collect()}
    assert made == {"a": ("t", ["x", "y"]), "b": (None, [])}
    assert snapshots.session_details(index, told, turns, "b").count() == 1 and snapshots.session_details(index, told, turns, "c").count() == 0


def test_evidence_sentences_and_drafts(spark):
    text = "Short stop.\nPlease stop doing that at /home/me/x; token=abc now! Next."
    assert one(spark, workflow.sentence(F.col("t"), r"\bstop\b"), t="One. Please stop it! Two") == "Please stop it!"
    frame = spark.createDataFrame([("s", text, "2024")], "session_id string, text string, updated_at string")
    found = workflow.seeds(frame)
    shown = workflow.evidence(found, frame)
    assert [r.excerpt for r in shown.collect()] == ["Please stop doing that at /[local-path] [secret-ref] now!"]
    made = workflow.drafts(workflow.candidates(found), shown, "rule").first()
    assert made.flags == [] and made.markdown.startswith(f"# Workflow rule draft: {made.candidate_id}\n") and "- s (validation-scope-correction): Please stop" in made.markdown


def test_seeds_of_records(spark):
    records = spark.createDataFrame([("a", "global", "workflow", "proven", "when x", "do y"), ("b", "project", "workflow", "proven", "x", "y"), ("c", "global", "workflow", "candidate", "x", "y")], "instinct_id string, scope string, domain string, maturity string, trigger string, finding string")
    seen = spark.createDataFrame([("a", "s1", True), ("a", "s2", False), ("b", "s1", True)], "instinct_id string, session_id string, reinforcing boolean")
    (row,) = workflow.candidates(workflow.record_seeds(records, seen)).collect()
    assert (row.rule_id, row.confidence, row.recommendation, row.supporting_count, row.contradicting_count, row.source_tier) == (row.rule_id, "strong", "adopt", 1, 1, "instinct")


def test_answers(spark):
    assert one(spark, answers.preference_statement(F.col("t")), t="2) Always  run tests!!") == "Always run tests."
    assert one(spark, answers.generated_topic(F.col("t")), t='{"topic": "\'A  b\'"}') == "A b" and one(spark, answers.generated_topic(F.col("t")), t="x") is None
    assert one(spark, answers.promotion_verdict(F.col("t")), t='so {"global": true, "confidence": 2, "reason": "r"}').general is None
    assert one(spark, answers.workflow_verdict(F.col("t")), t='{"wording_ok": true, "artifact_kind": "none", "confidence": "weak", "reason": "r"}').wording_ok is True


def test_artifacts(spark, tmp_path):
    root = str(tmp_path / "a")
    assert artifacts.load(spark, root, "pages").count() == 0
    for rows, touched in (([("p", "m", "1"), ("q", "m", "1"), ("", "m", "1")], ["p", "q", ""]), ([("q", "m", "2")], ["q", ""])):
        generation = artifacts.Generation(spark, root)
        generation.save(spark.createDataFrame(rows, "project_id string, name string, page string"), "pages", spark.createDataFrame([(t,) for t in touched], "p string"))
        generation.commit()
    assert sorted((r.project_id, r.page) for r in artifacts.load(spark, root, "pages").collect()) == [("p", "1"), ("q", "2")]
    artifacts.export_lines(artifacts.load(spark, root, "pages"), str(tmp_path / "lines"), ["project_id"])
    assert [r.page for r in spark.read.json(str(tmp_path / "lines")).orderBy("project_id").collect()] == ["1", "2"]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://x:7077"

        @staticmethod
        def getConf():
            return {}

    class Session:
        conf = {}
        sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)


def test_candidates_of_prompts(spark):
    rows = [
        ("please prune the old worktree", ["git status", "git worktree remove x"], []),
        ("commit it", ["git commit -m x"], []),
        ("Review PR 12", ["gh pr view 12"], []),
        ("sync with upstream", ["git fetch upstream"], []),
        ("debug the parser", ["python3 -m pytest tests/a"], ["/w/crash.log"]),
        ("Write the roadmap for search", [], ["/w/docs/roadmap.md"]),
        ("hello there", ["git commit -m x"], ["/w/docs/a.md"]),
    ]
    frame = spark.createDataFrame([(f"s:{i}", "s", "p", i, 1, *r) for i, r in enumerate(rows)], "turn_id string, session_id string, project_key string, turn_index int, first_line int, user_prompt string, commands_seen array<string>, files_touched array<string>")
    made = {(r.turn_id, r.basis): r.statement for r in candidates.of_prompts(frame).collect()}
    assert made == {
        ("s:0", "workflow"): "Use `git worktree remove x` for worktree pruning in p.",
        ("s:1", "workflow"): "Use `git commit -m x` for repo workflow in p.",
        ("s:2", "pr-review"): "Use `gh pr view 12` for PR review in p.",
        ("s:3", "fork-sync"): "Use `git fetch upstream` to maintain private fork with upstream in p.",
        ("s:4", "crash"): "Diagnose crashes with `python3 -m pytest tests/a`; check /w/crash.log for error details.",
        ("s:5", "spec"): "Refer to /w/docs/roadmap.md for Write the roadmap for search architecture decisions.",
    }


def test_a_second_run_takes_up_what_is_new(spark, tmp_path):
    def lines(session, texts):
        raw = [json.dumps({"type": kind, "timestamp": f"2024-01-0{i + 1}T00:00:00.000Z", "cwd": "/w/p", "message": {"content": t}}) for i, (kind, t) in enumerate(texts)]
        return [("claude-code", f"/a/b/{session}.jsonl", session, i + 1, r) for i, r in enumerate(raw)]

    schema, root = "source_tool string, source_path string, session_id string, line int, raw string", str(tmp_path / "run")
    first = lines("s1", [("user", "always run the linter"), ("assistant", "We decided to use parquet for the table")])
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    run.run(spark.createDataFrame(first, schema), root, now)
    more = first + lines("s2", [("user", "fix the parser"), ("assistant", "Fixed the parser so that empty input is read as none."), ("assistant", "All tests pass now with `npm test`, verified and done.")])
    pages = run.run(spark.createDataFrame(more, schema), root, now)
    assert [r.project_id for r in pages.collect()] == ["p"] and "parser" in pages.first().page
    assert {(r.session_id, r.project_key, r.content_revision, r.lifecycle) for r in artifacts.load(spark, root, "ledger").collect()} == {("s1", "p", 1, "extracted"), ("s2", "p", 1, "extracted")}
    assert sorted(r.session_id for r in artifacts.load(spark, root, "turns").collect()) == ["s1", "s2"]
    known = artifacts.load(spark, root, "learnings").collect()
    assert {(r.session_id, r.kind) for r in known} >= {("s1", "preference"), ("s1", "decision")}
    assert artifacts.load(spark, root, "instincts").count() == len({r.learning_id for r in known if r.scope == "project"})


def test_excerpts_tidy_only_lines_with_a_match(spark):
    parts = ["Nothing here to see at all, stays out.", "Stop.", "Please stop that at /home/me/x now! Next.", "Then stop again and for good, please."]
    cases = [(parts, "Please stop that at /[local-path] now!"), (["Please do all of it and", "stop"], "Please do all of it and stop"), (["stop when request fulfilled, as told"], ""), (["stop"], ""), (["none"], ""), ([], "")]
    frame = spark.createDataFrame(cases, "p array<string>, want string")
    for clean in (None, F.transform("p", workflow.redacted)):
        assert [r.got for r in frame.select(workflow.excerpt(F.col("p"), r"\bstop\b", clean).alias("got")).collect()] == [w for _, w in cases]
