"""Choosing sessions, files and worktrees: look-ups, re-run plans with reasons, deletion plans, path rules, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.prompts import has_chatter
from loomline.functions.text import squeezed

# Fixed values.
RESUMMARIZABLE = ["archived", "deletion_candidate", "extracted", "summarized"]
TERMINAL = ["archived", "deletion_candidate", "deleted"]
ACTIVE_HOURS = 2
PAGES = ["MEMORY.md", "workflow.md", "tooling.md", "preferences.md", "pitfalls.md", "debugging.md"]
MOST_COMMANDS, MOST_PATHS, EXCERPT, TOOL_EXCERPT, MOST_KEYS = 6, 6, 200, 160, 8
UNSAFE_STATE = "Candidate is not in a safe ready or legacy-applied state."
HALF_ARCHIVED = "Archive collision: both the gzip artifact and receipt must exist together."
BAD_RECEIPT = "Archive collision: the existing receipt is invalid."
OTHER_RECEIPT = "Archive collision: the existing receipt does not match the source session."
OTHER_ARCHIVE = "Archive collision: the gzip artifact does not match the recorded source hash."
CHANGED_SOURCE = "Source hash mismatch: the current bytes do not match the ledger hash."
PROJECT_ID = r"\A[0-9a-f]{12}\z"


def by_lifecycle(sessions: DataFrame, states: list[str]) -> DataFrame:
    """Sessions in one of ``states``, the longest untouched first; no states choose none."""
    return sessions.where(F.col("lifecycle").isin(states) if states else F.lit(False)).orderBy("updated_at", "id")


def latest_of(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """For each key the row that is last by ``order``; partial maxima, so a hot key is no hot task."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), F.struct(*order)).alias("_r")).select(key, "_r.*")


def chosen(rows: DataFrame, wanted: DataFrame | None, *keys: str) -> DataFrame:
    """The rows whose keys are wanted; all of them if nothing is asked for."""
    return rows if wanted is None else rows.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def resummarize_plan(
    sessions: DataFrame,
    wanted_sessions: DataFrame | None = None,
    wanted_projects: DataFrame | None = None,
    limit: int | None = None,
    topics: str | None = None,
    most_learnings: int | None = None,
) -> DataFrame:
    """session_id and outcome: ``process``, or why a session is passed over.

    ``sessions``: session_id, project_key, lifecycle, updated_at, id, topic, low_signal_topic,
    harness_topic, learnings, has_manifest. ``topics`` is None, "low_signal" or "leaked": only such
    topics are made again. ``most_learnings`` asks for sessions with more than that many.
    """
    rows = sessions.where(F.col("lifecycle").isin(RESUMMARIZABLE))
    rows = chosen(chosen(rows, wanted_sessions, "session_id"), wanted_projects, "project_key")
    if limit is not None:
        rows = rows.orderBy("updated_at", "id").limit(limit)
    poor = {None: F.lit(True), "low_signal": F.col("low_signal_topic"), "leaked": F.col("harness_topic")}[topics]
    outcome = F.when(F.lit(False), F.lit(""))
    if topics is not None:
        outcome = outcome.when(F.col("topic").isNull() | ~F.coalesce(poor, F.lit(False)), "clean_topic" if topics == "leaked" else "high_signal_topic")
    if most_learnings is not None:
        outcome = outcome.when(F.coalesce("learnings", F.lit(0)) <= most_learnings, "not_over_extracted")
    return rows.select("session_id", outcome.when(~F.coalesce("has_manifest", F.lit(False)), "missing_manifest").otherwise("process").alias("outcome"))


def with_chatter(summaries: DataFrame) -> DataFrame:
    """session_id of the summaries whose text tells of the process, which are extracted again."""
    lists = [F.coalesce(c, F.array().cast("array<string>")) for c in ("what_worked", "what_failed", "what_was_decided", "project_learnings", "user_learnings")]
    worked, failed, decided, project, user = lists
    text = F.array_join(F.concat(F.array(F.coalesce("topic", F.lit(""))), worked, failed, decided, F.array(F.coalesce("next_step", F.lit(""))), project, user), "\n")
    return summaries.where(has_chatter(text)).select("session_id")


def rereduce_plan(sessions: DataFrame, parsed: DataFrame) -> DataFrame:
    """session_id and whether its parsed records survive (``candidate``) or not (``locked``)."""
    marked = sessions.select("session_id").join(parsed.select("session_id").distinct().withColumn("_held", F.lit(True)), "session_id", "left")
    return marked.select("session_id", F.when(F.col("_held"), "candidate").otherwise("locked").alias("outcome"))


def worktrees(listings: DataFrame, text: str = "text") -> DataFrame:
    """path, head, branch (null if none of refs/heads) and detached of every block of porcelain listings.

    The other columns are passed through; blocks without a path or head are left out.
    """
    others = [c for c in listings.columns if c != text]
    rows = listings.select(*others, F.explode(F.split(F.trim(text), "\n\n")).alias("_b"))

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract("_b", rf"(?m)^{name} (.*)$", 1), F.lit(""))

    ref = field("branch")
    out = rows.select(
        *others,
        field("worktree").alias("path"),
        field("HEAD").alias("head"),
        F.when(F.startswith(ref, F.lit("refs/heads/")), F.substring(ref, F.lit(12), F.length(ref))).alias("branch"),
        F.col("_b").rlike(r"(?m)^detached$").alias("detached"),
    )
    return out.where("path is not null and head is not null")


def with_tasks(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """Worktrees with the id and status of the task that their branch names, if there is one."""
    named = F.lower(F.nullif(F.regexp_extract("branch", r"(?i)\b(td-[a-z0-9]+)\b", 1), F.lit("")))
    known = tasks.select(F.lower("id").alias("_task"), F.col("id").alias("task_id"), F.col("status").alias("task_status"))
    return rows.withColumn("_task", named).join(known, "_task", "left").drop("_task")


def worktree_class(now: Column) -> list[Column]:
    """classification and next_command of worktrees with tasks: dirty, dirty_at, merged, detached, branch, task_id, task_status."""
    c = F.col
    path = F.to_json(F.struct(c("path").alias("p")))
    quoted = F.substring(path, F.lit(6), F.length(path) - 6)
    inspect = F.concat(F.lit("git -C "), quoted, F.lit(" status --short"))
    recent = F.coalesce(c("dirty_at") > now - F.make_dt_interval(hours=F.lit(ACTIVE_HOURS)), F.lit(False))
    unknown = c("detached") | c("task_id").isNull() | c("branch").isNull() | (c("dirty") & c("dirty_at").isNull())
    merged = c("merged") | (c("task_status") == "closed")
    name = F.when(unknown, "unknown").when(c("dirty") & recent, "dirty-active").when(c("dirty"), "dirty-stale").when(merged, "merged").otherwise("clean-current")
    show = F.concat(F.lit("td show "), c("task_id"), F.lit(" && "), inspect)
    return [name.alias("classification"), F.when(name.isin("dirty-stale", "merged"), show).otherwise(inspect).alias("next_command")]


def normal_path(path: Column) -> Column:
    """A relative path with ``.``, ``..`` and doubled slashes resolved, or null if it leaves its folder or is hidden."""
    t = F.trim(path)
    parts = F.filter(F.split(t, "/"), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")

    def step(held: Column, p: Column) -> Column:
        up = (p == "..") & (F.size(held) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), held), F.lit(-1)) != "..")
        return F.when(up, F.slice(held, F.lit(1), F.size(held) - 1)).otherwise(F.concat(held, F.array(p)))

    joined = F.concat(F.array_join(F.aggregate(parts, empty, step), "/"), F.when(F.endswith(t, F.lit("/")), "/").otherwise(""))
    flat = F.replace(joined, F.lit("\\"), F.lit("/"))
    bad = F.startswith(t, F.lit("/")) | (F.length(flat) == 0) | flat.rlike(r"\A[/.]|/\.\./|/\.\.\z")
    return F.when(~bad, flat)


def allowed_page(path: Column, folder: str, manifest: str) -> Column:
    """Whether a page may be written: the manifest, a fixed page, or a file that is not hidden straight in ``folder``."""
    flat = normal_path(path)
    name = F.substring(flat, F.lit(len(folder) + 2), F.length(flat))
    inside = F.startswith(flat, F.lit(f"{folder}/")) & (F.length(name) > 0) & ~F.contains(name, F.lit("/")) & ~F.startswith(name, F.lit("."))
    return F.coalesce(flat.isin(manifest, *PAGES) | inside, F.lit(False))


def folder_name(project_id: Column) -> Column:
    """A project id that is safe as a folder's name."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(project_id, r"[\\/]+", ""), r"\.\.+", ""), r"\A\.+", ""))


def deletion_plan(candidates: DataFrame, sessions: DataFrame, facts: DataFrame, tool: str) -> DataFrame:
    """Every candidate of one tool's sessions with status archivable, already_archived, blocked or missing, and reason.

    ``candidates``: session_id, source_session_id, candidate_state, safe_to_delete. ``sessions``:
    source_session_id, source_tool, source_hash. ``facts``: session_id, location (found, missing or
    blocked), location_reason, current_hash, archive_exists, receipt_exists, receipt_valid,
    receipt_session_id, receipt_hash, receipt_tool, receipt_archive_hash, archive_hash,
    unpacked_hash; a session without facts is blocked.
    """
    c = F.col
    rows = candidates.join(sessions.where(c("source_tool") == tool), "source_session_id").join(facts.withColumn("_known", F.lit(True)), "session_id", "left")
    held = c("archive_exists") | c("receipt_exists")
    ready = c("candidate_state").isin("ready", "discardable_no_signal") & c("safe_to_delete")
    matches = (c("receipt_session_id") == c("session_id")) & (c("receipt_hash") == c("source_hash")) & (c("receipt_tool") == tool)
    intact = (c("unpacked_hash") == c("source_hash")) & (c("archive_hash") == c("receipt_archive_hash"))

    def no(test: Column) -> Column:
        return ~F.coalesce(test, F.lit(False))

    blocked = (
        F.when(no((c("candidate_state") == "applied") | ready), UNSAFE_STATE)
        .when(c("_known").isNull(), "Source facts are missing.")
        .when(c("location") == "blocked", c("location_reason"))
        .when(held & no(c("archive_exists") & c("receipt_exists")), HALF_ARCHIVED)
        .when(held & no(c("receipt_valid")), BAD_RECEIPT)
        .when(held & no(matches), OTHER_RECEIPT)
        .when(held & no(intact), OTHER_ARCHIVE)
        .when(no(held) & (c("location") != "missing") & no(c("current_hash") == c("source_hash")), CHANGED_SOURCE)
    )
    missing = no(held) & (c("location") == "missing")
    status = F.when(blocked.isNotNull(), "blocked").when(held, "already_archived").when(missing, "missing").otherwise("archivable")
    return rows.select("session_id", status.alias("status"), F.when(blocked.isNotNull(), blocked).when(missing, c("location_reason")).alias("reason"))


def tombstones(applied: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The tombstones of applied deletions, and the ledger's transitions to ``deleted``.

    ``applied``: session_id, source_session_id, source_hash, reason.
    """
    stones = applied.select("session_id", "source_hash", "reason", now.alias("applied_at"))
    moves = applied.select("source_session_id", F.lit("applied").alias("candidate_state"), F.lit("deleted").alias("phase"), F.lit("completed").alias("state"), "source_hash")
    return stones, moves


def shown(sessions: DataFrame, tool: str | None = None, lifecycle: str | None = None, needle: str = "") -> DataFrame:
    """Sessions of a tool and lifecycle (if given) that mention ``needle`` in any shown field, case aside."""
    out = sessions
    if tool:
        out = out.where(F.col("source_tool") == tool)
    if lifecycle:
        out = out.where(F.col("lifecycle") == lifecycle)
    if sought := needle.strip().lower():
        fields = F.concat(F.array(*(F.coalesce(c, F.lit("")) for c in ("session_id", "topic", "next_step", "lifecycle", "summary_topic"))), F.coalesce("issues", F.array().cast("array<string>")))
        out = out.where(F.contains(F.lower(F.array_join(fields, "\n")), F.lit(sought)))
    return out


def inventoried(files: DataFrame, sessions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Files (path, kind, session_id) with the lifecycle of the session's newest row and the state of its candidate."""
    newest = latest_of(sessions.select("session_id", "id", "lifecycle"), "session_id", "id")
    held = latest_of(candidates.select("source_session_id", "updated_at", "id", "candidate_state"), "source_session_id", "updated_at", "id")
    of_session = newest.join(held.select(F.col("source_session_id").alias("id"), "candidate_state"), "id", "left").drop("id")
    return files.join(of_session, "session_id", "left").withColumn("lifecycle", F.coalesce("lifecycle", F.lit("unknown")))


def dashboard_issues(wanted: DataFrame, issues: DataFrame) -> DataFrame:
    """session_id, issue_count and issues of the wanted sessions that have any."""
    found = issues.where(F.size("issues") > 0).select("session_id", F.size("issues").alias("issue_count"), "issues")
    return found.join(wanted.select("session_id").distinct(), "session_id", "left_semi")


def project_of_keys(keys: DataFrame, sessions: DataFrame, resolved: Column, named: Column) -> DataFrame:
    """project_id of legacy keys: that of the first session with the key and a workspace, else the key if it is an id, else by name.

    ``keys`` has key; ``sessions`` has key, workspace and ord; ``resolved`` makes an id of a session's
    row, ``named`` of a key.
    """
    own = sessions.where(F.length(F.trim("workspace")) > 0).withColumn("_id", resolved)
    first = own.groupBy("key").agg(F.min_by("_id", "ord").alias("_id"))
    return keys.join(first, "key", "left").select("key", F.coalesce("_id", F.when(F.col("key").rlike(PROJECT_ID), F.col("key")), named).alias("project_id"))


def key_migration(sessions: DataFrame, folders: DataFrame, resolved: Column, named: Column) -> DataFrame:
    """old_key, new_id, workspace: the first session of each key, then folders that no key and no new id accounts for."""
    first = sessions.groupBy("key").agg(F.min_by(F.struct(resolved.alias("new_id"), "workspace"), "ord").alias("_r")).select(F.col("key").alias("old_key"), "_r.*")
    rest = folders.select(F.col("name").alias("key")).distinct().where(~F.col("key").rlike(PROJECT_ID))
    rest = rest.join(first.select(F.col("old_key").alias("key")), "key", "left_anti").join(first.select(F.col("new_id").alias("key")), "key", "left_anti")
    return first.unionByName(rest.select(F.col("key").alias("old_key"), named.alias("new_id"), F.lit(None).cast("string").alias("workspace")))


def redundant_reports(reports: DataFrame, sessions: DataFrame, history: int) -> DataFrame:
    """Paths of archive reports of finished sessions beyond the ``history`` newest sessions.

    ``reports``: path, name, modified_at. A session's reports go together, by their newest time. The
    order is over one row a session.
    """
    kept = max(1, history)
    named = reports.withColumn("session_id", F.nullif(F.regexp_extract("name", r"^archive-(.+)\.(?:json|md)$", 1), F.lit(""))).where("session_id is not null")
    own = named.join(sessions.where(F.col("lifecycle").isin(TERMINAL)).select("session_id").distinct(), "session_id", "left_semi")
    newest = own.groupBy("session_id").agg(F.max("modified_at").alias("at")).orderBy(F.desc("at"), "session_id").limit(kept)
    return own.join(newest, "session_id", "left_anti").select("path", F.lit("terminal_history").alias("reason"))


def redundant_batches(batches: DataFrame, applications: DataFrame, history: int) -> DataFrame:
    """Paths of review batches whose last application succeeded, beyond the ``history`` newest."""
    last = latest_of(applications.select("batch_id", "status", "ord"), "batch_id", "ord").where("status = 'applied'")
    own = batches.join(last.select("batch_id"), "batch_id", "left_semi")
    newest = own.orderBy(F.desc("created_at"), "batch_id").limit(max(1, history)).select("batch_id")
    return own.join(newest, "batch_id", "left_anti").select("path", F.lit("applied_history").alias("reason"))


def _cut(c: Column, size: int) -> Column:
    flat = squeezed(c)
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.substring(flat, 1, size - 3), F.lit("...")))


def pruned(records: DataFrame, raw: str = "raw") -> DataFrame:
    """Records with ``payload``: what a reduced record keeps of its raw JSON, texts cut and lists capped.

    The caps are the payload's form; counts cover everything. ``records``: line, kind, raw_type, ts,
    redacted, text, files, commands, tool_name, call_id, input_text, status and the raw JSON text.
    """
    keys = F.array_sort(F.json_object_keys(raw))
    fields = F.from_json(raw, "map<string,string>")
    nested = F.coalesce(F.exists(F.map_values(fields), lambda v: v.rlike(r"\A\s*[\[{]")), F.lit(False))
    count = F.coalesce(F.size(keys), F.lit(0))
    stub = F.struct(
        F.length(raw).alias("approximate_bytes"),
        nested.alias("has_nested_content"),
        count.alias("key_count"),
        F.coalesce(F.slice(keys, 1, MOST_KEYS), F.array().cast("array<string>")).alias("kept_keys"),
        F.greatest(F.lit(0), count - MOST_KEYS).alias("omitted_key_count"),
    )
    tool = F.when(F.col("tool_name").isNotNull(), F.struct("call_id", _cut(F.col("input_text"), TOOL_EXCERPT).alias("input_excerpt"), F.col("tool_name").alias("name"), "status"))
    payload = F.struct(
        F.col("redacted").alias("content_redacted"),
        F.col("line").alias("line_number"),
        F.col("kind").alias("raw_kind"),
        "raw_type",
        F.col("ts").alias("timestamp_hint"),
        _cut(F.col("text"), EXCERPT).alias("message_excerpt"),
        F.slice("files", 1, MOST_PATHS).alias("file_paths"),
        F.transform(F.slice("commands", 1, MOST_COMMANDS), lambda x: _cut(x, EXCERPT)).alias("command_strings"),
        tool.alias("tool_use"),
        stub.alias("raw_payload_stub"),
    )
    return records.withColumn("payload", payload)
