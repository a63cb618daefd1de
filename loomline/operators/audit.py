"""Reports over sessions and their summaries: quality, learning counts, topics, tools, integrity, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.prompts import completed, has_chatter, has_wrapper_tags
from loomline.functions.text import listed

# Fixed values.
NO_NEXT_STEP = "No explicit next step recorded."
QUANTILES = [0.5, 0.75, 0.9, 0.95, 0.99]
BUCKETS = {"gte_10": (">=", 10), "gt_10": (">", 10), "gte_25": (">=", 25), "gt_25": (">", 25), "gte_50": (">=", 50), "gt_50": (">", 50)}
SIGNALS = ["what_worked", "what_failed", "what_was_decided", "useful_commands", "files_of_interest", "project_learnings", "user_learnings"]


def useful() -> Column:
    """Whether a summary row has any durable signal."""
    any_signal = F.lit(False)
    for s in SIGNALS:
        any_signal = any_signal | (F.coalesce(F.size(s), F.lit(0)) > 0)
    return any_signal


def issues(sessions: DataFrame) -> DataFrame:
    """``sessions`` (one row each, summary fields or nulls, candidate columns or nulls) with an array of issue codes.

    Columns: session_id, lifecycle, has_summary, invalid_summary, safe_to_delete, knowledge_written,
    topic, next_step and the signal arrays.
    """
    body = F.array_join(F.concat("what_worked", "what_failed", "what_was_decided", F.array("next_step"), "project_learnings", "user_learnings"), "\n")
    seen, signal = F.col("has_summary"), useful()
    found = listed(
        ("summary_missing", ~seen & ~F.col("invalid_summary")),
        ("summary_invalid", F.col("invalid_summary")),
        ("blocked_deletion", F.coalesce(~F.col("safe_to_delete"), F.lit(False))),
        ("summary_low_signal", seen & ~signal & (F.col("next_step") == NO_NEXT_STEP)),
        ("topic_process_chatter", seen & has_chatter(F.col("topic"))),
        ("completion_as_next_step", seen & completed(F.col("next_step"))),
        ("process_chatter", seen & has_chatter(body)),
        ("wrapper_tags", seen & has_wrapper_tags(F.concat_ws("\n", F.col("topic"), body))),
        ("no_useful_commands", seen & signal & (F.size("useful_commands") == 0)),
        ("no_files_of_interest", seen & signal & (F.size("files_of_interest") == 0)),
        ("no_project_learnings", seen & signal & (F.col("lifecycle") == "deletion_candidate") & (F.size("project_learnings") == 0) & ~F.col("knowledge_written")),
    )
    return sessions.withColumn("issues", F.when(F.col("lifecycle") == "discovered", F.array().cast("array<string>")).otherwise(found))


def issue_counts(audited: DataFrame) -> DataFrame:
    return audited.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("sessions"))


def recommended(counts: DataFrame, top: int = 3) -> DataFrame:
    return counts.orderBy(F.desc("sessions"), "issue").limit(top)


def worst(audited: DataFrame, top: int = 10) -> DataFrame:
    return audited.withColumn("issue_count", F.size("issues")).orderBy(F.desc("issue_count"), "session_id").limit(top)


def learning_distribution(counts: DataFrame, n: str = "n") -> DataFrame:
    """One row over sessions with a learning: threshold buckets, maximum, total and nearest-rank percentiles."""
    own = counts.where(F.col(n) > 0)
    tests = {">=": lambda c, v: c >= v, ">": lambda c, v: c > v}
    ranks = [F.expr(f"percentile_disc({q}) within group (order by `{n}`)").cast("long").alias(f"p{round(q * 100)}") for q in QUANTILES]
    return own.agg(
        F.count("*").alias("sessions_with_learnings"),
        F.coalesce(F.sum(n), F.lit(0)).alias("total_learnings"),
        F.coalesce(F.max(n), F.lit(0)).alias("max_learnings"),
        *(F.count_if(tests[op](F.col(n), v)).alias(name) for name, (op, v) in BUCKETS.items()),
        *ranks,
    )


def topic_distribution(sessions: DataFrame) -> DataFrame:
    """Per project: sessions, missing summaries, topics by source, low-signal and leaking topics and their rate."""
    has, llm = F.col("has_summary"), F.col("topic_source") == "llm"
    sums = sessions.groupBy("project_key").agg(
        F.count("*").alias("sessions"),
        F.count_if(~has & ~F.col("invalid_summary")).alias("missing_summaries"),
        F.count_if(has & llm).alias("llm_rescued_topics"),
        F.count_if(has & ~llm).alias("deterministic_topics"),
        F.count_if(has & F.col("low_signal")).alias("low_signal_topics"),
        F.count_if(has & F.col("wrapper_leak")).alias("wrapper_leak_topics"),
    )
    return sums.withColumn("low_signal_rate", F.round(F.col("low_signal_topics") / F.col("sessions"), 3))


def by_tool(sessions: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Per source tool its sessions, learnings and calls, and a row for all.

    Calls of unknown sessions are in the totals only. ``telemetry``: session_id, cost, cost_known, cache_hit.
    """
    call = [
        F.count("*").alias("calls"),
        F.count_if(~F.col("cache_hit")).alias("real_calls"),
        F.count_if("cache_hit").alias("cache_hits"),
        F.count_if(~F.col("cache_hit") & ~F.col("cost_known")).alias("unknown_cost_calls"),
        F.coalesce(F.sum(F.when(F.col("cost_known"), F.col("cost"))), F.lit(0.0)).alias("total_cost"),
    ]
    own = [F.count("*").alias("sessions"), F.sum("project_learnings").alias("project_learnings")]
    tools = sessions.groupBy("source_tool").agg(*own)
    known = telemetry.join(sessions.select("session_id", "source_tool"), "session_id")
    rows = tools.join(known.groupBy("source_tool").agg(*call), "source_tool", "left")
    total = sessions.agg(F.lit("all").alias("source_tool"), *own).crossJoin(telemetry.agg(*call))
    return rows.unionByName(total).na.fill(0, ["calls", "real_calls", "cache_hits", "unknown_cost_calls"]).na.fill(0.0, ["total_cost"])


def duplicate_ids(sessions: DataFrame) -> DataFrame:
    """Session ids that several ledger rows share, with the rows' sources in order."""
    sums = sessions.groupBy("session_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("source_path")), ",").alias("sources"))
    return sums.where("n > 1")


def shared_identities(manifests: DataFrame) -> DataFrame:
    """Session ids that stand for more than one (tool, path)."""
    sums = manifests.select("session_id", "source_tool", "source_path").distinct().groupBy("session_id").agg(F.count("*").alias("identities"))
    return sums.where("identities > 1")


def orphans(manifests: DataFrame, ledger: DataFrame) -> DataFrame:
    """Manifests without a ledger row of the same tool, path and session."""
    keys = ["source_tool", "source_path", "session_id"]
    return manifests.join(ledger.select(*keys), keys, "left_anti")


def integrity(duplicates: DataFrame, identities: DataFrame, orphaned: DataFrame) -> DataFrame:
    """code, severity, n of every kind of integrity finding."""
    kinds = [("duplicate_session_id", "blocking", duplicates), ("shared_identity", "warning", identities), ("orphan_manifest", "blocking", orphaned)]
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "n") for code, severity, df in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def latest_manifests(manifests: DataFrame) -> DataFrame:
    """The newest manifest of each (tool, path, session); of equal times the last by path."""
    newest = Window.partitionBy("source_tool", "source_path", "session_id").orderBy(F.desc("generated_at"), F.desc("manifest_path"))
    return manifests.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def session_index(manifests: DataFrame, summaries: DataFrame, deleted: DataFrame) -> DataFrame:
    """Searchable sessions: newest manifests with their summaries, without deleted sessions."""
    live = latest_manifests(manifests).join(deleted.select("session_id").distinct(), "session_id", "left_anti")
    return live.join(summaries, "session_id")


def search_sessions(index: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Sessions whose topic, id or tool contains the words, newest first."""
    q = query.lower().strip()
    hit = F.contains(F.lower(F.concat_ws("\n", "topic", "session_id", "source_tool")), F.lit(q))
    return index.where(hit).orderBy(F.desc("updated_at"), "session_id").limit(limit)


def health(facts: DataFrame) -> DataFrame:
    """Reasons and the first fitting action from one row of counts: blocking, pending_reviews, stale, reclaimable_bytes."""
    c = F.col
    reasons = listed(("integrity", c("blocking") > 0), ("pending_reviews", c("pending_reviews") > 0), ("stale_sessions", c("stale") > 0), ("reclaimable_storage", c("reclaimable_bytes") > 0))
    action = F.when(c("blocking") > 0, "check").when(c("stale") > 0, "ingest sync").when(c("pending_reviews") > 0, "quality review-learnings").when(c("reclaimable_bytes") > 0, "storage cleanup-parsed")
    return facts.withColumns({"reasons": reasons, "next_action": F.coalesce(action, F.lit("none")), "healthy": F.size(reasons) == 0})
