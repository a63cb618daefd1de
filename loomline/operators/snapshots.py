"""Snapshots of what is known: recall events, learning counts, knowledge, session details, technologies, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.prompts import embedded_agent, substantive
from loomline.functions.text import SPACE
from loomline.operators.instincts import in_rollup

# What a command's first word and a file's ending say about technology.
COMMAND_TECHNOLOGY = {
    "git": "git", "gh": "git", "npm": "npm", "pnpm": "pnpm", "yarn": "yarn", "bun": "bun", "node": "node", "uv": "uv", "python": "python", "python3": "python", "cargo": "rust", "go": "go",
    "docker": "docker", "sqlite3": "sqlite", "just": "just", "make": "make", "tsc": "typescript", "biome": "biome", "vitest": "vitest", "pytest": "pytest",
}
FILE_TECHNOLOGY = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "go": "go",
    "rs": "rust", "swift": "swift", "kt": "kotlin", "java": "java", "c": "c", "cc": "cpp", "cpp": "cpp", "h": "c", "hpp": "cpp", "sql": "sql", "json": "json", "yaml": "yaml", "yml": "yaml",
    "toml": "toml", "md": "markdown",
}
# Which skill a command shows; the first pattern that fits counts.
SKILL_OF_COMMAND = [
    (r"\bgit\s+worktree\b", "using-git-worktrees"),
    (r"^wt\b", "using-git-worktrees"),
    (r"^td\b", "td-task-management"),
    (r"^gh\b[\s\S]*\bpr\b", "git"),
    (r"^git\s+(?:commit|push|merge|rebase)\b", "git"),
    (r"\b(?:bun test|vitest|pytest|npm test|uv run pytest)\b", "tdd-guide"),
]


def recall_summary(lines: DataFrame, line: str = "line") -> DataFrame:
    """One row: recalls, those that delivered, projects, last delivery and last recall; lines that are not JSON are left out.

    A field counts only in its own type: a text for ts and project_id, a truth value for delivered.
    """
    events = lines.where(F.length(F.trim(line)) > 0).select(F.try_parse_json(line).alias("v")).where("v is not null")

    def field(name: str, kind: str) -> Column:
        value = F.try_variant_get("v", f"$.{name}", "variant")
        return F.when(F.schema_of_variant(value) == kind.upper(), F.try_variant_get("v", f"$.{name}", kind))

    rows = events.select(field("ts", "string").alias("ts"), field("project_id", "string").alias("project_id"), F.coalesce(field("delivered", "boolean"), F.lit(False)).alias("delivered"))
    return rows.agg(
        F.count("*").alias("total_fires"),
        F.count_if("delivered").alias("fires_delivered"),
        F.count_distinct("project_id").alias("distinct_projects"),
        F.max(F.when(F.col("delivered"), F.col("ts"))).alias("last_delivered_at"),
        F.max("ts").alias("last_fire_at"),
    )


def learning_counts(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """``sessions`` with learnings: the lines of their files that are not blank, 0 without a file."""
    full = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(f"(?!{SPACE}).")))
    counts = files.groupBy("session_id").agg(F.sum(full).alias("learnings"))
    return sessions.join(counts, "session_id", "left").withColumn("learnings", F.coalesce("learnings", F.lit(0)).cast("long"))


def most_learnings(counts: DataFrame, limit: int = 10) -> DataFrame:
    """The report's top sessions by learnings."""
    return counts.orderBy(F.desc("learnings"), "session_id").limit(limit)


def duplicate_rate(rows: DataFrame, key: Column) -> DataFrame:
    """One row: rows, kept ones (the first of each key), duplicates, rate of duplicates and groups that repeat."""
    groups = rows.groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    out = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("kept"), F.count_if(F.col("n") > 1).alias("repeating_keys")).withColumn("duplicates", F.col("rows") - F.col("kept"))
    return out.withColumn("rate", F.when(F.col("rows") > 0, F.round(F.col("duplicates") / F.col("rows"), 4)).otherwise(F.lit(0.0)))


def knowledge(reviewed: DataFrame, exported: DataFrame) -> DataFrame:
    """The learnings that stand: all of ``reviewed`` if there are any, else ``exported``, with their source."""
    some = reviewed.limit(1).agg((F.count("*") > 0).alias("_some"))  # one row
    first = reviewed.withColumn("source", F.lit("reviewed-export"))
    second = exported.crossJoin(F.broadcast(some)).where("not _some").drop("_some").withColumn("source", F.lit("deterministic-export"))
    return first.unionByName(second)


def knowledge_snapshot(learnings: DataFrame, instincts: DataFrame, key: Column) -> DataFrame:
    """project_id, source, learnings (distinct keys of scope project) and instincts of every project with knowledge."""
    own = learnings.groupBy("project_id", "source").agg(F.count_distinct(F.when(F.col("scope") == "project", key)).alias("learnings"))
    held = instincts.groupBy("project_id").agg(F.count("*").alias("instincts"))
    return own.join(held, "project_id", "left").withColumn("instincts", F.coalesce("instincts", F.lit(0)).cast("long"))


def session_details(index: DataFrame, summaries: DataFrame, turns: DataFrame, session_id: str | None = None) -> DataFrame:
    """Index rows with their summary (a struct or null) and turns (an array in order), of one session or all."""
    if session_id is not None:
        index, summaries, turns = (df.where(F.col("session_id") == session_id) for df in (index, summaries, turns))
    told = summaries.select("session_id", F.struct(*(c for c in summaries.columns if c != "session_id")).alias("summary"))
    row = F.struct("turn_index", *(c for c in turns.columns if c not in ("session_id", "turn_index")))
    own = turns.groupBy("session_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    out = index.join(told, "session_id", "left").join(own, "session_id", "left")
    return out.withColumn("turns", F.coalesce("turns", F.slice("turns", 1, 0), F.array().cast(own.schema["turns"].dataType)))


def top_sessions(scores: DataFrame, limit: int) -> DataFrame:
    """The best scored sessions; the limit is the report's."""
    return scores.orderBy(F.desc("score"), "session_id").limit(limit)


def merged_by_id(prior: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both; of equal ids the new one."""
    both = prior.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    value = F.struct(*(c for c in prior.columns if c != key))
    return both.groupBy(key).agg(F.max_by(value, "_new").alias("_v")).select(key, "_v.*")


def for_rollup(project: DataFrame, general: DataFrame, key: str = "instinct_id") -> DataFrame:
    """Records of a project that are shown, and general ones, which replace those of equal id."""
    return merged_by_id(project.where(in_rollup()), general.where(in_rollup()), key)


def _looked_up(c: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def technologies(turns: DataFrame) -> DataFrame:
    """session_id, technologies and skills of sessions: sorted sets that commands and files of their turns show."""
    head = F.transform("commands_seen", lambda x: _looked_up(F.lower(F.element_at(F.split(F.trim(x), r"\s+"), F.lit(1))), COMMAND_TECHNOLOGY))
    ending = F.transform("files_touched", lambda x: _looked_up(F.lower(F.substring_index(x, ".", -1)), FILE_TECHNOLOGY))

    def skill(x: Column) -> Column:
        t, found = F.lower(F.trim(x)), F.when(F.lit(False), F.lit(""))
        for pattern, name in SKILL_OF_COMMAND:
            found = found.when(t.rlike(pattern), name)
        return found

    rows = turns.select("session_id", F.array_compact(F.concat(head, ending)).alias("t"), F.array_compact(F.transform("commands_seen", skill)).alias("s"))
    flat = rows.select("session_id", F.explode_outer(F.array_distinct(F.concat(F.transform("t", lambda x: F.struct(F.lit("t").alias("k"), x.alias("v"))), F.transform("s", lambda x: F.struct(F.lit("s").alias("k"), x.alias("v")))))).alias("x"))

    def of(kind: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("x.k") == kind, F.col("x.v"))))

    return flat.groupBy("session_id").agg(of("t").alias("technologies"), of("s").alias("skills"))


def prompt_corpus(sessions: DataFrame, checkpoints: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The users' own prompts as rows, and a row for every session: exported with a content hash, or skipped with a reason.

    ``sessions``: session_id, source_tool, project_key, source_hash, updated_at. ``checkpoints``:
    session_id, state, source_hash of the reducing phase. ``turns``: session_id, turn_id, turn_index,
    started_at, user_prompt.
    """
    done = checkpoints.where("state = 'completed'").select("session_id", F.col("source_hash").alias("_done")).distinct()
    marked = sessions.join(done, "session_id", "left").withColumn("fresh", F.coalesce(F.col("_done") == F.col("source_hash"), F.lit(False))).drop("_done")
    said = turns.where(~embedded_agent(F.col("user_prompt"))).select("session_id", "turn_id", "turn_index", F.col("started_at").alias("timestamp"), substantive(F.col("user_prompt")).alias("text")).where("text is not null")
    messages = said.join(marked.where("fresh").select("session_id", "source_tool", "source_hash", "project_key"), "session_id")
    line = F.to_json(F.struct("session_id", "source_tool", "source_hash", "project_key", "turn_id", "turn_index", "timestamp", "text"))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_index", line.alias("l")))), lambda x: x.l), "\n")
    counts = messages.groupBy("session_id").agg(F.count("*").alias("message_count"), F.sha2(F.concat(content, F.lit("\n")), 256).alias("content_sha256"))
    reduced = turns.select("session_id").distinct().withColumn("_reduced", F.lit(True))
    listed = marked.join(counts, "session_id", "left").join(reduced, "session_id", "left")
    reason = F.when(~F.col("fresh"), "reduced_checkpoint_missing_or_stale").when(F.col("_reduced").isNull(), "reduced_artifact_missing").when(F.col("message_count").isNull(), "no_substantive_user_messages")
    return messages, listed.select("session_id", "source_tool", "project_key", "source_hash", "updated_at", "message_count", "content_sha256", reason.alias("skipped"))


def generation(manifest: DataFrame) -> DataFrame:
    """One row: generation id (a hash of all sessions, whatever their order), counts and the newest time of what is exported."""
    row = F.to_json(F.struct("session_id", "source_tool", "project_key", "source_hash", "message_count", "content_sha256", "skipped"), {"ignoreNullFields": "false"})
    exported = F.col("skipped").isNull()
    parts = [F.count("*"), F.bit_xor(F.xxhash64(row)), F.bit_xor(F.xxhash64(F.lit(1), row)), F.bit_xor(F.xxhash64(F.lit(2), row))]
    return manifest.agg(
        F.substring(F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256), 1, 24).alias("generation_id"),
        F.count_if(exported).alias("session_count"),
        F.coalesce(F.sum("message_count"), F.lit(0)).alias("message_count"),
        F.max(F.when(exported, F.col("updated_at"))).alias("generated_at"),
    )


def copy_plan(source: DataFrame, target: DataFrame, free_bytes: int) -> DataFrame:
    """path, bytes and action of every source file: copy, skip (the same is there) or conflict; and whether all copies fit."""
    there = target.select("path", F.col("hash").alias("_there"))
    rows = source.join(there, "path", "left")
    action = F.when(F.col("_there").isNull(), "copy").when(F.col("_there") == F.col("hash"), "skip").otherwise("conflict")
    rows = rows.select("path", "bytes", action.alias("action"))
    need = rows.where("action = 'copy'").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("_need"))
    return rows.crossJoin(F.broadcast(need)).select("path", "bytes", "action", (F.col("_need") <= free_bytes).alias("fits"))

