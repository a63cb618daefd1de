"""Generations of artifacts: commits by manifest, stale artifacts, runs that die half-way."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from loomline.operators import run
from loomline.sources import artifacts, listing

LINES = "source_tool string, source_path string, session_id string, line int, raw string"
LESSON = [("user", "fix the parser"), ("assistant", "We decided to use parquet for the table"), ("assistant", "Fixed the parser so that empty input is read as none."), ("assistant", "All tests pass now with `npm test`, verified and done.")]
QUIET = [("user", "hello"), ("assistant", "hello there")]


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def lines(spark, **sessions):
    """Sessions as lines; a session's value is its texts, with its working folder first."""
    rows = []
    for session, (cwd, texts) in sessions.items():
        raw = [json.dumps({"type": kind, "timestamp": f"2024-01-0{i + 1}T00:00:00.000Z", "cwd": cwd, "message": {"content": t}}) for i, (kind, t) in enumerate(texts)]
        rows += [("claude-code", f"/a/b/{session}.jsonl", session, i + 1, r) for i, r in enumerate(raw)]
    return spark.createDataFrame(rows, LINES)


def held(spark, root, name, *columns):
    return sorted(tuple(r) for r in artifacts.load(spark, root, name).select(*columns).collect())


def test_a_session_that_loses_its_lessons_leaves_none(spark, tmp_path):
    root = str(tmp_path / "run")
    first = run.run(lines(spark, s1=("/w/p", LESSON), s2=("/w/q", LESSON)), root, now())
    assert sorted(r.project_id for r in first.collect()) == ["p", "q"]
    assert held(spark, root, "pages", "project_id") == [("p",), ("q",)] == held(spark, root, "instincts", "project_id")
    second = run.run(lines(spark, s1=("/w/p", QUIET)), root, now())
    assert second.collect() == []
    assert {r[0] for r in held(spark, root, "learnings", "session_id")} == {"s2"}
    assert held(spark, root, "instincts", "project_id") == [("q",)] == held(spark, root, "pages", "project_id")
    assert held(spark, root, "ledger", "session_id", "project_key", "content_revision", "lifecycle") == [("s1", "p", 2, "extracted"), ("s2", "q", 1, "extracted")]
    assert [t for s, t in held(spark, root, "turns", "session_id", "user_prompt") if s == "s1"] == ["hello"]


def test_a_session_that_moves_leaves_its_old_project(spark, tmp_path):
    root = str(tmp_path / "run")
    run.run(lines(spark, s1=("/w/p", LESSON)), root, now())
    run.run(lines(spark, s1=("/w/q", LESSON)), root, now())
    for name in ("ledger", "turns", "learnings", "summaries"):
        assert {r[0] for r in held(spark, root, name, "project_key")} == {"q"}, name
    assert held(spark, root, "pages", "project_id") == [("q",)] == held(spark, root, "instincts", "project_id")


def test_lines_that_cannot_be_read_any_more(spark, tmp_path):
    root = str(tmp_path / "run")
    run.run(lines(spark, s1=("/w/p", LESSON)), root, now())
    torn = lines(spark, s1=("/w/p", LESSON), s2=("/w/p", LESSON)).withColumn("raw", F.lit("{"))
    for _ in range(2):
        run.run(torn, root, now())
        assert held(spark, root, "turns", "session_id") == [] == held(spark, root, "pages", "page")
    assert held(spark, root, "ledger", "session_id", "project_key", "content_revision") == [("s1", "p", 2), ("s2", "s2", 1)]


def test_a_run_that_dies_half_way_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "run")
    run.run(lines(spark, s1=("/w/p", LESSON)), root, now())
    tables = {name: held(spark, root, name, artifacts.PARTITION[name]) for name in artifacts.SCHEMAS}

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(run, "memory_pages", broken)
        with pytest.raises(RuntimeError, match="lost"):
            run.run(lines(spark, s1=("/w/p", QUIET), s3=("/w/p", LESSON)), root, now())
    assert {name: held(spark, root, name, artifacts.PARTITION[name]) for name in artifacts.SCHEMAS} == tables
    run.run(lines(spark, s1=("/w/p", LESSON), s3=("/w/r", LESSON)), root, now())
    assert {r[0] for r in held(spark, root, "learnings", "session_id")} == {"s1", "s3"}
    whole = {name: held(spark, root, name, artifacts.PARTITION[name]) for name in artifacts.SCHEMAS}
    assert artifacts.vacuum(spark, root) > 0 and artifacts.vacuum(spark, root) == 0
    assert {name: held(spark, root, name, artifacts.PARTITION[name]) for name in artifacts.SCHEMAS} == whole


def test_of_two_runs_from_one_manifest_one_commits(spark, tmp_path):
    root, pages, touched = str(tmp_path / "run"), "project_id string, name string, page string", spark.createDataFrame([("p",)], "p string")
    one, two = artifacts.Generation(spark, root), artifacts.Generation(spark, root)
    for generation, text in ((one, "1"), (two, "2")):
        generation.save(spark.createDataFrame([("p", "MEMORY.md", text)], pages), "pages", touched)
    one.commit()
    with pytest.raises(Exception, match="(?i)exist"):
        two.commit()
    assert held(spark, root, "pages", "page") == [("1",)]


def transcript(root, name, texts, at):
    file = root / "projects" / "-w-p" / f"{name}.jsonl"
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text("".join(json.dumps({"type": kind, "timestamp": "2024-01-01T00:00:00.000Z", "cwd": "/w/p", "message": {"content": t}}) + "\n" for kind, t in texts))
    os.utime(file, (at, at))
    return file


def test_unchanged_files_are_not_read(spark, tmp_path):
    root, roots = str(tmp_path / "run"), {"claude-code": str(tmp_path / "in")}
    names = [f"0000000{k}-0000-4000-8000-00000000000{k}" for k in range(3)]
    for k, name in enumerate(names):
        transcript(tmp_path / "in", name, LESSON, 1_700_000_000 + k)
    found = listing.listed_all(spark, roots)
    assert "content" not in found._jdf.queryExecution().executedPlan().toString()
    run.ingest(spark, roots, root, now(), limit=2)  # the limit comes after the comparison
    assert held(spark, root, "ledger", "session_id") == [(n,) for n in names[:2]]
    run.ingest(spark, roots, root, now(), limit=2)
    assert held(spark, root, "ledger", "session_id") == [(n,) for n in names]
    assert listing.to_read(found, artifacts.load(spark, root, "files")).count() == 0
    transcript(tmp_path / "in", names[1], QUIET, 1_700_000_100)
    os.utime(tmp_path / "in" / "projects" / "-w-p" / f"{names[2]}.jsonl", (1_700_000_200, 1_700_000_200))  # same content, touched
    fresh = listing.to_read(listing.listed_all(spark, roots), artifacts.load(spark, root, "files"))
    read = listing.lines(spark, fresh).inputFiles()
    assert sorted(f.rsplit("/", 1)[1][:-6] for f in read) == names[1:]
    run.ingest(spark, roots, root, now())
    assert held(spark, root, "ledger", "session_id", "content_revision") == [(names[0], 1), (names[1], 2), (names[2], 1)]
    assert run.ingest(spark, roots, root, now()).collect() == [] and artifacts.newest(spark, root) == 3
    assert listing.selected(found, exclude=["-w-p"]).count() == 0 == listing.selected(found, exclude_projects=["p", *names]).count()


def test_sessions_of_tests_are_left_out(spark, tmp_path):
    for folder, name in (("ws", "1_a"), ("ws", "pi-test-1_a"), ("my-PI-TEST", "1_b"), ("ws", "pi-branching-test-1_c")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{name}.jsonl").write_text("{}\n")
    assert [r.source_path.rsplit("/", 1)[1] for r in listing.listed(spark, "pi", str(tmp_path)).collect()] == ["1_a.jsonl"]
    assert listing.listed(spark, "pi", str(tmp_path), tests=True).count() == 4


def test_files_do_not_grow_with_projects(spark, tmp_path):
    root, touched = str(tmp_path / "run"), spark.range(300).select(F.concat(F.lit("p"), "id").alias("p"))
    rows = touched.select(F.col("p").alias("project_id"), F.explode(F.array(F.lit("MEMORY.md"), F.lit("workflow.md"))).alias("name"), F.lit("x").alias("page"))
    for part in (rows, rows.where("project_id <> 'p7'")):
        generation = artifacts.Generation(spark, root)
        generation.save(part, "pages", touched)
        generation.commit()
    assert len([f for _, _, files in os.walk(f"{root}/pages") for f in files if f.endswith(".parquet")]) <= 16
    assert held(spark, root, "pages", "project_id", "name") == sorted((r.project_id, r.name) for r in rows.where("project_id <> 'p7'").collect())
    unnamed, lone = spark.createDataFrame([("", "a", "x"), (None, "b", "y")], "project_id string, name string, page string"), spark.createDataFrame([("",)], "p string")
    generation = artifacts.Generation(spark, root)
    generation.save(unnamed, "pages", lone)
    generation.commit()
    assert len(held(spark, root, "pages", "name")) == 600
