"""Parts that no query compares: rendered summaries, wiki records, workspaces by digest, retention classes, upserts, ranking."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from loomline.operators import ledger, skills, storage, summaries, workflow
from loomline.sources import sinks, transcripts


def test_rendered_summaries(spark):
    schema = "topic string, what_worked array<string>, what_failed array<string>, what_was_decided array<string>, useful_commands array<string>, files_of_interest array<string>, next_step string"
    row = spark.createDataFrame([("Parser", ["a", "b"], [], ["c"], ["npm test"], [], "Go on.")], schema)
    assert summaries.rendered(row).first().markdown == (
        "# Parser\n\n## What worked\n\n- a\n- b\n\n## What failed\n\n- None recorded.\n\n## What was decided\n\n- c\n\n"
        "## Useful commands\n\n- npm test\n\n## Files of interest\n\n- None recorded.\n\n## Next step\n\nGo on.\n"
    )


def test_wiki_records(spark):
    frame = spark.createDataFrame([("p", "A — title", "It — works."), ("p", "A - title", "It - works."), ("q", "A - title", "It - works.")], "project_key string, title string, statement string")
    rows = sinks.wiki_records(frame).collect()
    assert [r.body for r in rows] == ["# A - title\n\nIt - works."] * 3
    assert rows[0].id != rows[2].id and rows[1].id != rows[2].id and len({len(r.id) for r in rows}) == 1
    again = sinks.wiki_records(frame.orderBy(F.desc("project_key"))).collect()
    assert {r.id for r in again} == {r.id for r in rows}


def test_retention_report(spark):
    row = sinks.retention_report(spark.createDataFrame([(True,), (False,), (True,)], "safe_to_delete boolean")).first()
    assert tuple(row) == (3, 2, 1)


def test_workspaces_by_digest(spark):
    known = ["/home/a/app", "/home/b"]
    slug = {k: hashlib.md5(k.encode()).hexdigest() for k in known}
    paths = [f"/r/{slug['/home/a/app']}/x/wire.jsonl", f"/r/{'0' * 32}/y/wire.jsonl"]
    found = spark.createDataFrame([(p, None) for p in paths], "source_path string, workspace_path string")
    made = transcripts.kimi_workspaces(found, spark.createDataFrame([(k,) for k in known], "path string"))
    assert {r.source_path: r.workspace_path for r in made.collect()} == {paths[0]: "/home/a/app", paths[1]: None}


def test_retention_classes(spark):
    rows = [("a/manifests/x", True, False), ("parsed/x", True, True), ("staging/x", False, False), ("a/reduced/x", True, False), ("other/x", False, True), ("receipts/x", False, True)]
    made = spark.createDataFrame(rows, "p string, k boolean, d boolean").select(storage.retention_class(F.col("p"), F.col("k"), F.col("d")).alias("c"))
    assert [r.c for r in made.collect()] == ["keep", "reclaimable", "orphan", "review", "review", "keep"]


def test_rows_replace_those_of_equal_keys(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x")], "k string, n int, v string")
    new = spark.createDataFrame([("a", 2, "y"), ("c", 1, "y"), ("c", 1, "y")], "k string, n int, v string")
    assert sorted(tuple(r) for r in ledger.upserted_by(old, new, ["k", "n"]).collect()) == [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), ("c", 1, "y"), ("c", 1, "y")]


def test_fields_that_name_a_skill(spark):
    row = spark.createDataFrame([("We ran Code Review", None, "code_review it")], "topic string, next_step string, said string")
    made = row.select(skills.evidence_fields({c: F.col(c) for c in ("topic", "next_step", "said")}, F.lit("code-review")).alias("f")).first()
    assert made.f == ["topic", "said"]


def test_ranked_guidance(spark):
    levels, tiers = sorted(workflow.RANK, key=workflow.RANK.get, reverse=True), sorted(workflow.TIERS, key=workflow.TIERS.get, reverse=True)
    want = [(levels[0], tiers[0], 1, "b"), (levels[0], tiers[-1], 9, "a"), (levels[0], tiers[-1], 9, "c"), (levels[0], tiers[-1], 2, "a"), (levels[-1], tiers[0], 50, "a")]
    frame = spark.createDataFrame(want[::-1], "confidence string, source_tier string, evidence_count int, guidance string")
    assert [tuple(r) for r in workflow.ranked(frame, 10).collect()] == want
    assert workflow.ranked(frame, 2).count() == 2


def test_exports_are_in_order(spark, tmp_path):
    from loomline.sources import artifacts

    frame = spark.createDataFrame([(f"s{k:02}", k) for k in (3, 1, 2)], "session_id string, n int")
    artifacts.export_lines(frame, str(tmp_path / "out"), ["session_id"])
    said = [json.loads(x) for part in sorted((tmp_path / "out").glob("part-*")) for x in part.read_text().splitlines()]
    assert [r["n"] for r in said] == [1, 2, 3]


def test_scratch_tables_can_be_cleared(spark):
    """In a session of its own application's folder: what a query leaves behind goes, and only that."""
    from pathlib import Path

    from loomline.plans import catalog
    from loomline.sources import scratch

    folder = Path(scratch.shared_dir(spark).removeprefix("file://"))
    scratch.clear(spark)
    (folder / "other").mkdir(exist_ok=True)
    before = {p.name for p in folder.iterdir()}
    catalog.queries()["l10_fold_deltas"](spark, "/root/testdata/sf0.001").count()
    left = {p.name for p in folder.iterdir()} - before
    assert left and all(name.startswith("loomline-") for name in left)
    assert scratch.clear(spark) >= len(left) and {p.name for p in folder.iterdir()} == before
