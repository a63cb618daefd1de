"""The session ledger as pure functions of tables: upserts, invalidation, phases, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import listed
from loomline.sources.scratch import dealt, stored

# Fixed values.
PHASES = ["parsed", "reduced", "summarized", "extracted", "archived", "deletion_candidate", "deleted"]
STATES = ["pending", "running", "completed", "stale", "failed", "skipped"]
REASONS = {
    "summary_missing": "summary_missing: Summary artifacts have not been written yet.",
    "summary_low_signal": "summary_low_signal: Summary captured no durable signal yet.",
    "no_durable_learnings": "no_durable_learnings: No project or user learnings have been written yet.",
    "manifest_missing": "manifest_missing: Immutable provenance manifest has not been written yet.",
    "receipt_missing": "receipt_missing: Retention receipt has not been written yet.",
}
READY_REASON = "All required retention artifacts are present."
NO_SIGNAL_REASON = "no_signal: Summary and provenance artifacts exist; session had no durable learnings."


def ordinal(phase: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, PHASES)), phase)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], content: str) -> DataFrame:
    """The ledger after seeing ``new`` sources: one row for each key.

    Unknown keys are discovered at revision 1; a changed ``content`` raises the revision and makes
    the row stale; an equal one leaves it. Rows without a new sighting stay. ``change`` says which.
    """
    seen = new.select(*keys, F.col(content).alias("_new"), F.lit(True).alias("_seen"))
    both = old.select(*keys, content, "content_revision", "lifecycle", F.lit(True).alias("_old")).join(seen, keys, "full")
    known, changed = F.col("_old").isNotNull(), F.col("_seen").isNotNull() & F.col("_old").isNotNull() & ~F.col("_new").eqNullSafe(F.col(content))
    return both.select(
        *keys,
        F.when(F.col("_seen").isNotNull(), F.col("_new")).otherwise(F.col(content)).alias(content),
        F.when(~known, 1).when(changed, F.col("content_revision") + 1).otherwise(F.col("content_revision")).cast("int").alias("content_revision"),
        F.when(~known, "discovered").when(changed, "stale").otherwise(F.col("lifecycle")).alias("lifecycle"),
        F.when(~known, "inserted").when(changed, "changed").when(F.col("_seen").isNotNull(), "unchanged").otherwise("unseen").alias("change"),
    )


def to_process(ledger: DataFrame) -> DataFrame:
    """What an incremental run takes up: new and changed sources, and first revisions that were only discovered."""
    return ledger.where("change in ('inserted', 'changed') or (change = 'unchanged' and content_revision = 1 and lifecycle = 'discovered')")


def invalidated(changed: DataFrame, checkpoints: DataFrame, queue: DataFrame, candidates: DataFrame, key: str) -> dict[str, DataFrame]:
    """What a change of sessions does to all that was derived from them: sessions, checkpoints, queue and candidates after it.

    ``checkpoints`` and ``queue`` have state and lifecycle, ``candidates`` candidate_state, lifecycle
    and safe_to_delete. A changed session with a completed checkpoint is stale, and so are its
    completed checkpoints and its queue entries and deletion candidates, whatever their state; of
    these, completed entries and ready candidates change their state too, and none is safe to
    delete. A changed session without one is as good as just discovered, and nothing else changes.
    """
    hit = changed.select(key).distinct()
    derived = dealt(checkpoints.where("state = 'completed'").select(key), key).distinct().withColumn("_hit", F.lit(True))
    stale = stored(hit.join(derived, key, "left"), "stale")  # keys and flags, read by every table below
    sessions = stale.select(key, F.when(F.col("_hit"), "stale").otherwise("discovered").alias("lifecycle"))
    touched, on = stale.where("_hit"), F.coalesce("_hit", F.lit(False))

    def marked(table: DataFrame) -> DataFrame:
        return dealt(table, key).join(touched, key, "left").withColumn("_hit", on)

    done = on & (F.col("state") == "completed")
    of_checkpoints = marked(checkpoints).withColumns({"lifecycle": F.when(done, "stale").otherwise(F.col("lifecycle")), "state": F.when(done, "stale").otherwise(F.col("state"))})
    of_queue = marked(queue).withColumns({"lifecycle": F.when(on, "stale").otherwise(F.col("lifecycle")), "state": F.when(done, "stale").otherwise(F.col("state"))})
    ready = on & (F.col("candidate_state") == "ready")
    of_candidates = marked(candidates).withColumns(
        {"lifecycle": F.when(on, "stale").otherwise(F.col("lifecycle")), "candidate_state": F.when(ready, "stale").otherwise(F.col("candidate_state")), "safe_to_delete": F.col("safe_to_delete") & ~on}
    )
    return {"sessions": sessions, "checkpoints": of_checkpoints.drop("_hit"), "queue": of_queue.drop("_hit"), "candidates": of_candidates.drop("_hit")}


def phase_states(transitions: DataFrame, key: str) -> DataFrame:
    """The state of each phase of a session after its transitions (phase, state, seq).

    The last transition of a phase counts, unless an earlier phase was completed after it: then a
    completed phase is stale.
    """
    session = Window.partitionBy(key)
    last = transitions.groupBy(key, "phase").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"), F.max(F.when(F.col("state") == "completed", F.col("seq"))).alias("done"))
    upstream = F.max("done").over(session.orderBy(ordinal(F.col("phase"))).rowsBetween(Window.unboundedPreceding, -1))
    out = last.withColumn("up", upstream)
    stale = (F.col("state") == "completed") & (F.coalesce("up", F.lit(-1)) > F.col("seq"))
    return out.select(key, "phase", F.when(stale, "stale").otherwise(F.col("state")).alias("state"), "seq")


def lifecycle(phase: Column, state: Column) -> Column:
    """A session's lifecycle after a transition: the completed phase, stale, or error for any other state."""
    return F.when(state == "completed", phase).when(state == "stale", "stale").otherwise("error")


def resumable(checkpoints: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted work that no completed checkpoint of the same content covers."""
    return wanted.join(checkpoints.where("state = 'completed'").select(*keys).distinct(), keys, "left_anti")


def retention(sessions: DataFrame) -> DataFrame:
    """safe_to_delete, candidate_state and reason from summary_written, manifest_written, receipt_written,
    project_learnings_written, user_learnings_written, low_signal and no_signal (booleans)."""
    c = F.col
    learned = c("project_learnings_written") | c("user_learnings_written")
    complete = c("summary_written") & c("manifest_written") & c("receipt_written")
    discardable = complete & ~learned & c("low_signal") & c("no_signal")
    safe = complete & (learned | discardable)
    blocked = (
        F.when(~c("summary_written"), REASONS["summary_missing"])
        .when(c("low_signal"), REASONS["summary_low_signal"])
        .when(~learned, REASONS["no_durable_learnings"])
        .when(~c("manifest_written"), REASONS["manifest_missing"])
        .when(~c("receipt_written"), REASONS["receipt_missing"])
        .otherwise("")
    )
    return sessions.withColumns(
        {
            "safe_to_delete": safe,
            "candidate_state": F.when(safe & learned, "ready").when(safe, "discardable_no_signal").otherwise("pending_artifacts"),
            "reason": F.when(safe & learned, READY_REASON).when(safe, NO_SIGNAL_REASON).otherwise(blocked),
        }
    )


def missing_artifacts(candidates: DataFrame) -> DataFrame:
    """Names of the artifacts that a deletion still lacks, in alphabetical order; knowledge is optional without a signal."""
    c = F.col
    knowledge = (c("candidate_state") == "discardable_no_signal") | c("project_learnings_written") | c("user_learnings_written")
    names = listed(
        ("knowledge_jsonl", ~knowledge),
        ("manifest_json", ~c("manifest_written")),
        ("retention_receipt_json", ~c("receipt_written")),
        ("summary_json", ~c("summary_written")),
        ("summary_markdown", ~c("summary_written")),
    )
    return candidates.withColumn("missing", names).withColumn("status", F.when(c("safe_to_delete") & c("candidate_state").isin("ready", "discardable_no_signal"), "ready").otherwise("blocked"))


def status_counts(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """kind, state, n over several tables, each with the column that holds its state."""
    parts = [df.groupBy(F.col(c).cast("string").alias("state")).count().select(F.lit(kind).alias("kind"), "state", F.col("count").alias("n")) for kind, (df, c) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def upserted_by(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with equal keys; the rest stays."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
