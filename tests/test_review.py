"""Review as a run: waves, terminal errors, the ledger of batches; skills by hash join; invalidation."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomline.operators import ledger, review, skills
from loomline.sources import artifacts



def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def learnings(spark, n):
    return spark.range(n).selectExpr("id as learning_id", "cast(id as string) as cache_key")


def test_a_terminal_error_ends_the_asking_after_its_wave(spark, tmp_path):
    log = str(tmp_path / "asked")
    frame = learnings(spark, 200)
    waves = {r.cache_key: r.w for r in frame.select("cache_key", F.pmod(F.xxhash64("cache_key"), F.lit(5)).alias("w")).collect()}

    def provider(rows):
        with open(log, "a") as f:
            f.writelines(f"{r['cache_key']}\n" for r in rows)
        if any(waves[r["cache_key"]] == 1 for r in rows):
            raise RuntimeError("(402) quota used up")
        return [{"verdict": "keep", "suggested_statement": "s"}] * len(rows)

    made = review.reviewed_in_waves(frame, provider, size=10, lots=4).collect()
    assert len(made) == 200
    asked = {k.strip() for k in open(log)}
    assert asked == {k for k, w in waves.items() if w <= 1}
    for r in made:
        want = (0, True, "keep") if waves[r.cache_key] == 0 else (1, True, "error") if waves[r.cache_key] == 1 else (None, False, None)
        assert (r.wave, r.asked, r.verdict) == want
    again = review.reviewed_in_waves(frame, lambda rows: [{"verdict": "keep", "suggested_statement": "s"}] * len(rows), size=10, lots=4)
    assert review.cache_rows(again).count() == 200
    assert review.reviewed_in_waves(frame.limit(0), provider).count() == 0


def batch(spark, tmp_path):
    root = str(tmp_path / "root")
    originals = spark.createDataFrame(
        [("p", "s", f"l{k}", f"h{k}", "decision", f"old {k}", f"title {k}", "when", "Seen once.") for k in range(5)],
        "project_key string, session_id string, learning_id string, content_hash string, kind string, statement string, title string, trigger string, basis string",
    )
    rows = [("s", "l0", "h0", "keep", "new 0"), ("s", "l1", "changed", "keep", "new 1"), ("s", "l2", "h2", "drop", "new 2"), ("s", "gone", "h", "keep", "x"), ("s", "l4", "h4", "keep", "bad")]
    reviews = spark.createDataFrame(rows, "session_id string, learning_id string, input_hash string, verdict string, suggested_statement string")
    flags = F.when(F.col("suggested_statement") == "bad", F.array(F.lit("too_long"))).otherwise(F.array().cast("array<string>"))
    return root, originals, reviews, flags


def test_a_batch_is_applied_once(spark, tmp_path):
    root, originals, reviews, flags = batch(spark, tmp_path)
    first = review.apply_batch(spark, root, reviews, originals, flags, now())
    assert first | {"batch_id": 0} == {"status": "applied", "batch_id": 0, "n_applied": 1, "n_rejected": 2, "n_skipped": 2}
    rows = artifacts.load(spark, root, "reviewed").collect()
    assert [(r.learning_id, r.statement, r.title, r.trigger, r.basis) for r in rows] == [("l0", "new 0", "title 0", "when", "Seen once. LLM-reviewed with keep verdict.")]
    number = artifacts.newest(spark, root)
    again = review.apply_batch(spark, root, reviews.orderBy(F.desc("learning_id")).repartition(3), originals, flags, now())
    assert again == first | {"status": "same"} and artifacts.newest(spark, root) == number
    other = reviews.withColumn("suggested_statement", F.concat("suggested_statement", F.lit("!")))
    assert review.apply_batch(spark, root, other, originals, flags, now())["status"] == "applied"
    assert [r.statement for r in artifacts.load(spark, root, "reviewed").where("learning_id = 'l0'").collect()] == ["new 0!"]


def test_a_batch_that_fails_may_be_applied_again(spark, tmp_path):
    root, originals, reviews, flags = batch(spark, tmp_path)
    broken = originals.withColumn("trigger", F.when(F.col("learning_id") == "l0", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("trigger")))
    with pytest.raises(Exception, match="lost"):
        review.apply_batch(spark, root, reviews, broken, flags, now())
    assert artifacts.load(spark, root, "reviewed").count() == 0
    assert review.apply_batch(spark, root, reviews, originals, flags, now())["status"] == "applied"
    assert sorted(r.status for r in artifacts.load(spark, root, "applications").collect()) == ["applied", "failed"]


def test_ten_thousand_skills_by_hash_join(spark):
    rng = random.Random(8)
    names = [f"{rng.choice(['code', 'test', 'data', 'pr'])}-{rng.choice(['review', 'plan', 'fix', 'lint'])}-{k}" for k in range(9_990)] + ["ab", "Q", "über-Skill", "a-b_c", "x" * 40, "tdd", "go", "", "tidy-up", "code-review"]
    texts = []
    for k in range(60):
        said = [rng.choice(names) for _ in range(rng.randrange(0, 4))]
        texts.append((f"s{k}", " and ".join(rng.choice([n, n.upper(), n.replace("-", " "), n.replace("-", "_"), f"pre{n}post"]) for n in said) or None))
    sessions = spark.createDataFrame(texts, "session_id string, text string")
    frame = spark.createDataFrame([(n,) for n in names], "skill_id string")
    made = skills.naming(sessions, frame)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = {(s, n) for s, text in texts if text for n in names if n and any(v in text.lower() for v in (n.lower(), n.lower().replace("-", " "), n.lower().replace("-", "_")))}
    assert {(r.session_id, r.skill_id) for r in made.collect()} == want and made.count() == len(want)


def test_invalidation_of_what_was_derived(spark):
    frame = spark.createDataFrame
    made = ledger.invalidated(
        frame([("done",), ("new",), ("done",)], "k string"),
        frame([("done", 1, "completed", "parsed"), ("done", 2, "failed", "error"), ("new", 1, "running", "parsed"), ("other", 1, "completed", "parsed")], "k string, n int, state string, lifecycle string"),
        frame([("done", "completed", "x"), ("done", "queued", "x"), ("new", "completed", "x"), ("other", "completed", "x")], "k string, state string, lifecycle string"),
        frame([("done", "ready", "x", True), ("done", "blocked", "x", False), ("new", "ready", "x", True), ("other", "ready", "x", None)], "k string, candidate_state string, lifecycle string, safe_to_delete boolean"),
        "k",
    )
    assert sorted(tuple(r) for r in made["sessions"].collect()) == [("done", "stale"), ("new", "discovered")]
    assert sorted(tuple(r) for r in made["checkpoints"].collect()) == [("done", 1, "stale", "stale"), ("done", 2, "failed", "error"), ("new", 1, "running", "parsed"), ("other", 1, "completed", "parsed")]
    assert sorted(tuple(r) for r in made["queue"].collect()) == [("done", "queued", "stale"), ("done", "stale", "stale"), ("new", "completed", "x"), ("other", "completed", "x")]
    assert sorted(tuple(r) for r in made["candidates"].collect()) == [("done", "blocked", "stale", False), ("done", "stale", "stale", False), ("new", "ready", "x", True), ("other", "ready", "x", None)]
