"""Lesson candidates of a session: from single events, from turns, from abandoned approaches.

Candidates are rows (session_id, kind, basis, statement, title, trigger, evidence, confidence,
line, learning_id). ``finalized`` tidies and filters them, ``kept`` drops repeats and redundant
ones greedily by priority within a session and caps the list that a session shows. ``offered`` is
all of a session's candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import statements as st
from loomline.functions.prompts import atomic, cleaned_prompt, cleaned_statement, cleaned_title, no_signal, skill_leak, substantive, without_leaks
from loomline.functions.text import capped_bytes, let, matches, matches_any, rule, shortened, squeezed
from loomline.operators.commands import COMMAND_LINE, TICKED, all_of
from loomline.sources.scratch import once_each, stored

# Fixed values.
USEFUL_CHECK = [
    r"\b(?:verified|all checks passed|0 failures|done|completed|implemented|replaced)\b",
    r"\btests?\s+pass(?:ed|es)?\b",
    r"`[^`]+`\s+passes\b",
    r"\b(?:the\s+)?fix\s+is\s+to\b",
]
PLANNED_CHECK = [r"\b(?:can|will|could|should)\s+verify\b", r"\blet me verify\b"]
CONCRETE_FAILURE = r"\b(?:failed|error|exception|enoent|eacces|no such|cannot|could not|missing|unknown import|traceback)\b"
PRIORITY = {"verified-fix": 40, "completion": 40, "workflow": 30, "verification-only-fix": 30, "turn-fallback": 30, "decision": 25, "dead-end": 22, "file-scoped": 20, "failure": 10, "error-resolution": 10, "verification": 5}
VERIFIED = ["verified-fix", "completion", "verification", "error-resolution"]
TRIGGERS = {
    "verification_rule": "When verifying changes in ",
    "failure_mode": "When the same failure recurs in ",
    "decision": "When revisiting related design decisions in ",
    "pattern": "When editing the affected files in ",
    "dead_end": "When tempted to try the same approach in ",
    "workflow": "When running the same workflow in ",
}
WORKFLOW_WORDS = r"\b(?:worktree|setup|prune|test|tests|performance|example|fixture|script|plan|strategy)\b"
DIAGNOSIS = r"\b(?:bun -e|node -e|python3? -c|python3? -m pytest|npm test|bun test)\b"
CONCRETE_TASK = (
    r"\b(?:fix|fixed|bug|debug|implement|implemented|resolve|resolved|refactor|refactored|migrate|migrated|upgrade|upgraded|update|updated|change|changed|add|added|remove|removed"
    r"|review|audit|test|tests|optimize|performance|configure|config|install|build|deploy)\b"
)
INSTRUCTION = [r"\b(?:re-read|review|update|edit|change)\b.*\b(?-i:ONLY)\b", r"^\s*When working on\b"]
LOCAL_COMMAND = [r"^\./", r"\b(?:tools|scripts|src|lib|app|server|desktop|mobile|api|core|shared)/[^\s]+"]
FIX_IS_TO = r"\b(?:the\s+)?fix\s+is\s+to\s+(.+?)(?::\s*-\s*|$)"
NO_TASK = "this project"
SPEC_WORDS = r"\b(?:speckit|spec|architecture|roadmap|design doc|create a .+ wrapper|create a .+ spec)\b"
CAP, LONGEST, KEY_LEAST = 12, 240, 32
COLUMNS = ["session_id", "project_key", "turn_id", "line", "learning_id", "kind", "basis", "statement", "title", "trigger", "evidence", "confidence"]


def useful_check(c: Column) -> Column:
    return ~matches_any(c, PLANNED_CHECK) & matches_any(c, USEFUL_CHECK)


def command_in(c: Column) -> Column:
    """The first command in ticks."""
    return F.get(F.filter(all_of(c, TICKED, 1), lambda x: matches(x, COMMAND_LINE)), F.lit(0))


def _candidate(kind: str, basis: str, statement: Column, title: Column, evidence: Column, confidence: Column, trigger: Column | None = None) -> Column:
    general = F.concat(F.lit(TRIGGERS[kind]), F.col("project_key"), F.lit("."))
    return F.struct(
        F.lit(kind).alias("kind"),
        F.lit(basis).alias("basis"),
        statement.alias("statement"),
        title.alias("title"),
        (general if trigger is None else F.coalesce(trigger, general)).alias("trigger"),
        evidence.alias("evidence"),
        confidence.alias("confidence"),
    )


def _signature_trigger(signature: Column) -> Column:
    return F.concat(F.lit("When "), signature, F.lit(" recurs in "), F.col("project_key"), F.lit("."))


def said_in(name: Column, summary: Column) -> dict[str, Column]:
    """What the rules read in an event's summary, by its type, as columns that start with an underscore."""
    tidy = F.when(name == "fix", st.fix_statement(summary))
    useful = F.when(name == "verification", useful_check(summary))
    tried = st.tried_approach(summary)
    avoided = F.when(tried.isNotNull(), F.struct(F.lit(True).alias("tried"), st.lower_first(tried).alias("what"))).otherwise(F.struct(F.lit(False).alias("tried"), shortened(st.without_stop(summary), 100).alias("what")))
    return {
        "_solid": ~st.narration(summary),
        "_leak": skill_leak(summary),
        "_calm": ~st.process_text(summary),
        "_passing": F.when(name.isin("decision", "failure"), st.passing_summary(summary)),
        "_decided": F.when((name == "decision") & ~st.explanation(summary), st.without_elision(without_leaks(summary))),
        "_concrete": F.when(name == "failure", matches(summary, CONCRETE_FAILURE)),
        "_failed": F.when((name == "failure") & ~st.completion_not_failure(summary), st.without_elision(summary)),
        "_signature": F.when(name == "failure", st.error_signature(summary)),
        "_useful": useful,
        "_ticked": F.when(useful, command_in(summary)),
        "_avoided": F.when(matches(summary, st.DEAD_END), avoided),
        "_told": F.when(useful & matches(summary, r"\b(?:the\s+)?fix\s+is\s+to\b"), F.struct(st.lower_first(F.nullif(st.without_stop(F.regexp_extract(summary, rule(FIX_IS_TO), 1)), F.lit(""))).alias("action"))),
        "_fix": let(tidy, lambda t: F.when(t.isNotNull(), F.struct(F.when(st.past_tense(t), "").otherwise("Fixed ").alias("verb"), st.lower_first(t).alias("text"), st.narration(st.lower_first(t)).alias("told")))),
        "_short": F.when(name == "fix", st.compressed(summary)),
        "_block": F.when(name == "fix", st.completion_block(summary)),
        "_resolution": F.when(name.isin("fix", "verification", "failure"), st.resolution(summary)),
    }


def with_said(events: DataFrame) -> DataFrame:
    """``events`` with the columns of ``said_in``; those that have them stay as they are."""
    return events if "_solid" in events.columns else events.withColumns(said_in(F.col("type"), F.col("summary")))


def of_events(events: DataFrame) -> DataFrame:
    """Candidates of single events (columns of ``events.tagged`` and project_key), outside turns with a verified fix."""
    events = with_said(events)
    summary, name = F.col("summary"), F.col("type")
    turn = Window.partitionBy("turn_id")
    fixed = F.bool_or((name == "fix") & F.col("_solid")).over(turn) & F.bool_or((name == "verification") & F.col("_useful")).over(turn)
    rows = events.withColumn("_fixed", fixed).where(~F.col("_fixed") & ~F.col("_leak") & F.col("_solid"))
    calm, passing, project = F.col("_calm"), F.col("_passing"), F.col("project_key")
    decided = F.col("_decided")
    decision = F.when((name == "decision") & calm & ~passing & (F.length(decided) > 0), _candidate("decision", "decision", decided, F.concat(F.lit("Decision: "), shortened(decided, 72)), F.array(decided), F.col("confidence")))
    said = F.col("_failed")
    failing = (name == "failure") & calm & ~passing & F.col("_concrete") & said.isNotNull()
    failure = F.when(failing, _candidate("failure_mode", "failure", said, F.concat(F.lit("Failure mode: "), shortened(said, 68)), F.array(summary), F.col("confidence"), _signature_trigger(F.col("_signature"))))
    command = F.coalesce("verification_command", "_ticked")
    rule = F.concat(F.lit("Run "), command, F.lit(" when verifying changes in "), project, F.lit("."))
    check = F.when((name == "verification") & calm & command.isNotNull(), _candidate("verification_rule", "verification", rule, F.concat(F.lit("Verification: "), command), F.array(summary), F.col("confidence")))
    avoid = F.when(F.col("_avoided.tried"), F.concat(F.lit("Avoid "), F.col("_avoided.what"), F.lit(" in "), project, F.lit(" (tried and abandoned)."))).otherwise(
        F.concat(F.lit("In "), project, F.lit(", avoid the approach that was abandoned: "), F.col("_avoided.what"), F.lit("."))
    )
    dead = F.when(F.col("_avoided").isNotNull(), _candidate("dead_end", "dead-end", avoid, F.concat(F.lit("Dead end: "), shortened(avoid, 60)), F.array(summary), F.lit("medium")))
    found = rows.withColumn("c", F.explode(F.array_compact(F.array(decision, failure, check, dead))))
    name_of = F.concat("session_id", F.lit(":project:"), F.col("c.basis"), F.lit(":"), F.col("event_id"))
    return found.select("session_id", "project_key", "turn_id", "line", name_of.alias("learning_id"), "c.*").select(*COLUMNS)


def of_turns(turns: DataFrame, events: DataFrame) -> DataFrame:
    """Candidates of turns: a fix with its verification, a fix that a verification tells, a failure with its resolution, a fix with its file.

    A fix whose summary is mostly Markdown gives way to the file and action in it (``st.compressed``).

    ``turns`` has turn_id, session_id, project_key, turn_index, commands_seen, files_touched.
    """
    name, useful, solid = F.col("type"), F.col("_useful"), F.col("_solid")

    def one(*more: str) -> Column:
        return F.struct("line", "summary", "verification_command", *more)

    sums = with_said(events).groupBy("turn_id").agg(
        F.min(F.when((name == "fix") & solid, one("_fix", "_short", "_block", "_resolution"))).alias("fix"),
        F.min(F.when((name == "verification") & useful, one("_ticked", "_resolution"))).alias("check"),
        F.min(F.when((name == "verification") & F.col("_told").isNotNull(), one("_told"))).alias("told"),
        F.array_sort(F.collect_list(F.when((name == "failure") & F.col("_concrete") & solid, one("_resolution", "_signature")))).alias("failures"),
    )
    rows = turns.join(sums, "turn_id")
    fix, check, tidy, short = F.col("fix.summary"), F.col("check.summary"), F.col("fix._fix"), F.col("fix._short")
    # The first command in ticks stands in a useful verification only, as ``check`` is.
    command = F.coalesce(F.get("commands_seen", F.lit(0)), F.col("check.verification_command"), F.col("check._ticked"))
    with_command = F.coalesce(F.concat(F.lit(" with "), st.in_ticks(command)), F.lit(""))
    sure = F.when(command.isNotNull(), "high").otherwise("medium")
    there = F.concat(F.lit("In "), short.file, F.lit(", "), short.action)
    done = F.concat(F.coalesce(there, F.concat(tidy.verb, tidy.text)), F.lit("; verified"), with_command, F.lit("."))
    both = F.col("fix").isNotNull() & F.col("check").isNotNull()
    verified = F.when(both, _candidate("workflow", "verified-fix", done, F.concat(F.lit("Verified fix: "), shortened(done, 60)), F.array_distinct(F.array(fix, check)), sure))
    file = st.repo_path(F.get("files_touched", F.lit(0)))
    scoped = F.concat(F.coalesce(there, F.when(~tidy.told, F.concat(F.lit("In "), file, F.lit(", "), tidy.text))), F.lit("."))
    pattern = F.when(~both & F.col("fix").isNotNull() & file.isNotNull() & ~F.col("fix._block") & scoped.isNotNull(), _candidate("pattern", "file-scoped", scoped, F.concat(F.lit("File update: "), shortened(scoped, 60)), F.array(fix, file), F.lit("medium")))
    only = F.concat(F.lit("In "), file, F.lit(", "), F.col("told._told.action"), F.lit("; verified."))
    told = F.when(fix.isNull() & only.isNotNull(), _candidate("workflow", "verification-only-fix", only, F.concat(F.lit("Verified fix: "), shortened(only, 60)), F.array(F.col("told.summary"), file), F.lit("medium")))
    answer = F.coalesce(fix, check)
    resolution = F.when(fix.isNotNull(), F.col("fix._resolution")).otherwise(F.col("check._resolution"))

    def resolved(f: Column) -> Column:
        text = F.concat(F.lit("Resolved "), f["_resolution"], F.lit(" by "), st.lower_first(resolution), F.lit("."))
        return _candidate("failure_mode", "error-resolution", text, F.concat(F.lit("Error resolution: "), shortened(text, 60)), F.array_distinct(F.array(f.summary, answer)), sure, _signature_trigger(f["_signature"]))

    fixes = F.when(~both & answer.isNotNull(), F.transform("failures", resolved))
    parts = F.concat(F.array_compact(F.array(verified, told, pattern)), F.coalesce(fixes, F.array().cast(f"array<{_TYPE}>")))
    found = rows.select("*", F.posexplode(parts).alias("pos", "c"))
    name_of = F.concat("session_id", F.lit(":project:"), F.col("c.basis"), F.lit(":"), F.col("turn_index").cast("string"), F.lit(":"), F.col("pos").cast("string"))
    line = F.coalesce(F.col("fix.line"), F.col("check.line"))
    return found.select("session_id", "project_key", "turn_id", line.alias("line"), name_of.alias("learning_id"), "c.*").select(*COLUMNS)


def _first(commands: Column, test) -> Column:
    return F.get(F.filter(commands, test), F.lit(0))


def workflow_command(commands: Column, prompt: Column) -> Column:
    """A project's own or a setup command where a prompt is about such work, or the commit that it asks for; else null."""
    about = matches(prompt, WORKFLOW_WORDS)
    own = _first(commands, lambda x: F.startswith(x, F.lit("./")) | F.contains(x, F.lit("worktree")))
    setup = _first(commands, lambda x: x.rlike(r"(?i)(?:uv sync|pnpm install|npm install|git worktree)"))
    commit = _first(commands, lambda x: matches(x, r"^git commit\b"))
    return F.coalesce(F.when(about, own), F.when(about, setup), F.when(matches(prompt, r"\bcommit\b"), commit))


def workflow_target(prompt: Column) -> Column:
    """What such a prompt is about."""
    tree = matches(prompt, r"\bworktree\b")
    return (
        F.when(tree & matches(prompt, r"\bsetup\b"), "worktree setup")
        .when(tree & matches(prompt, r"\bprune|stale|old\b"), "worktree pruning")
        .when(matches(prompt, r"\btests?|performance|faster\b"), "test performance work")
        .when(matches(prompt, r"\bexample|fixture\b"), "fixture/example maintenance")
        .otherwise("repo workflow")
    )


def review_command(commands: Column, prompt: Column) -> Column:
    """The command with which a pull request was looked at."""
    asked = matches(prompt, r"\b(?:review|checkout)\b.*\bpr\b|\bpr\b.*\b(?:review|checkout)\b")
    tree = _first(commands, lambda x: x.rlike(r"(?i)git worktree (?:add|remove)"))
    return F.when(asked, F.coalesce(tree, _first(commands, lambda x: matches(x, r"^gh\b"))))


def fork_command(commands: Column, prompt: Column) -> Column:
    """The command that keeps a fork in step."""
    asked = matches(prompt, r"\b(?:private clone|upstream|fork|sync with upstream)\b")
    added = _first(commands, lambda x: x.rlike("(?i)git remote add upstream"))
    return F.when(asked, F.coalesce(added, _first(commands, lambda x: x.rlike("(?i)git fetch upstream"))))


def asked_in(prompt: Column) -> dict[str, Column]:
    """What the rules read in a user's prompt, as columns that start with an underscore."""
    asked = F.coalesce(F.nullif(cleaned_prompt(prompt), F.lit("")), prompt)
    fit = let(asked, lambda t: ~skill_leak(t) & ~no_signal(t) & ~st.narration(t) & ~matches_any(t, INSTRUCTION))
    return {"_asked": asked, "_line": F.coalesce(F.nullif(F.trim(F.substring_index(substantive(prompt), "\n", 1)), F.lit("")), F.lit(NO_TASK)), "_concrete": matches(asked, CONCRETE_TASK), "_fit": fit, "_target": workflow_target(asked)}


def with_asked(turns: DataFrame) -> DataFrame:
    """``turns`` with the columns of ``asked_in``; those that have them stay as they are."""
    return turns if "_asked" in turns.columns else turns.withColumns(asked_in(F.col("user_prompt")))


def of_prompts(turns: DataFrame) -> DataFrame:
    """Candidates of what prompts ask for: workflow, pull-request, fork, crash and specification lessons.

    ``turns``: turn_id, session_id, project_key, turn_index, first_line, user_prompt, commands_seen, files_touched.
    """
    commands, project = F.col("commands_seen"), F.col("project_key")
    rows = with_asked(turns)
    asked, line = F.col("_asked"), F.col("_line")

    def said(kind: str, basis: str, title: str, command: Column, statement: Column, evidence: Column) -> Column:
        return F.when(command.isNotNull(), _candidate(kind, basis, statement, F.concat(F.lit(f"{title}: "), shortened(statement, 60)), F.array_distinct(F.array_compact(evidence)), F.lit("medium")))

    def use(command: Column, purpose: Column) -> Column:
        return F.concat(F.lit("Use "), st.in_ticks(command), purpose, F.lit(" in "), project, F.lit("."))

    flow, review, fork = workflow_command(commands, asked), review_command(commands, asked), fork_command(commands, asked)
    trouble = matches(asked, r"\b(?:fix|crash|error):|\b(?:debug|diagnose)\b")
    tried = F.when(trouble, _first(commands, lambda x: matches(x, DIAGNOSIS)))
    log = F.when(trouble, _first(F.col("files_touched"), lambda x: x.rlike(r"(?i)\.(?:log|crash|err)\z|crash|error|debug|trace")))
    crash = (
        F.when(tried.isNotNull() & log.isNotNull(), F.concat(F.lit("Diagnose crashes with "), st.in_ticks(tried), F.lit("; check "), log, F.lit(" for error details.")))
        .when(tried.isNotNull(), F.concat(F.lit("Diagnose crashes with "), st.in_ticks(tried), F.lit(" in "), line, F.lit(".")))
        .when(log.isNotNull(), F.concat(F.lit("Check "), log, F.lit(" for crash diagnostics in "), line, F.lit(".")))
    )
    page = F.when(matches(asked, SPEC_WORDS), _first(F.col("files_touched"), lambda x: x.rlike(r"(?i)/(?:specs?|docs?|design)/|\.mdx?\z")))
    topic = without_leaks(F.substring_index(F.trim(F.regexp_replace(F.regexp_replace(asked, r"(?i)/(?:speckit|speckit-specify)(?![\w])", ""), "['\"]", "")), "\n", 1))
    spec = F.concat(F.lit("Refer to "), page, F.lit(" for "), shortened(topic, 60), F.lit(" architecture decisions."))
    spec = F.when((F.length(topic) > 0) & ~skill_leak(topic) & ~skill_leak(spec), spec)
    parts = F.array_compact(
        F.array(
            said("workflow", "workflow", "Workflow", flow, use(flow, F.concat(F.lit(" for "), F.col("_target"))), F.array(line, flow)),
            said("workflow", "pr-review", "PR review", review, use(review, F.lit(" for PR review")), F.array(line, review)),
            said("workflow", "fork-sync", "Fork sync", fork, use(fork, F.lit(" to maintain private fork with upstream")), F.array(line, fork)),
            said("failure_mode", "crash", "Crash", crash, crash, F.array(tried, log, line)),
            said("decision", "spec", "Decision", spec, spec, F.array(line, page)),
        )
    )
    found = rows.select("*", F.explode(parts).alias("c"))
    name_of = F.concat("session_id", F.lit(":project:"), F.col("c.basis"), F.lit(":"), F.col("turn_index").cast("string"))
    return found.select("session_id", "project_key", "turn_id", F.col("first_line").alias("line"), name_of.alias("learning_id"), "c.*").select(*COLUMNS)


def of_fallback(turns: DataFrame, others: DataFrame) -> DataFrame:
    """Candidates of sessions of which ``others`` has no workflow: commands and files that a concrete prompt's turn used."""
    none = turns.join(others.where("kind = 'workflow'").select("session_id").distinct(), "session_id", "left_anti")
    asked, project, commands = F.col("_asked"), F.col("project_key"), F.col("commands_seen")
    rows = with_asked(none)
    own = _first(commands, lambda x: matches_any(x, LOCAL_COMMAND))
    rows = rows.withColumns({"_file": st.repo_path(F.get("files_touched", F.lit(0))), "_command": F.coalesce(own, workflow_command(commands, asked))})
    rows = rows.withColumn("_task", F.when(F.col("_concrete"), F.col("_line")).otherwise(F.col("_target")))
    file, command, task = F.col("_file"), F.col("_command"), F.col("_task")
    use = F.concat(F.lit("Use "), st.in_ticks(command), F.coalesce(F.concat(F.lit(" when working on "), file), F.concat(F.lit(" for "), task)), F.lit(" in "), project, F.lit("."))
    inspect = F.when(F.col("_concrete"), F.concat(F.lit("When working on "), task, F.lit(", inspect "), file, F.lit(" in "), project, F.lit(".")))
    rows = rows.withColumn("_statement", F.coalesce(use, inspect))
    statement = F.col("_statement")
    made = _candidate("workflow", "turn-fallback", statement, F.concat(F.lit("Workflow: "), shortened(statement, 60)), F.array_distinct(F.array_compact(F.array(F.col("_line"), F.coalesce(command, file)))), F.lit("medium"))
    good = F.col("_fit") & (task != NO_TASK) & statement.isNotNull()
    found = rows.select("*", F.explode(F.array_compact(F.array(F.when(good, made)))).alias("c"))
    name_of = F.concat("session_id", F.lit(":project:turn-fallback:"), F.col("turn_index").cast("string"))
    return found.select("session_id", "project_key", "turn_id", F.col("first_line").alias("line"), name_of.alias("learning_id"), "c.*").select(*COLUMNS)


def offered(turns: DataFrame, events: DataFrame) -> DataFrame:
    """All candidates of sessions: of events, of turns, of what prompts ask for, and the fallback where none of them is a workflow.

    A prompt's workflow gives way to the turn's verified fix. Both tables are read several times and should be ``stored``.
    """
    events = once_each(events, ["type", "summary"], with_said, "said")
    turns = once_each(turns, ["user_prompt"], with_asked, "asked")
    told = of_turns(turns, events)
    fixed = told.where("basis = 'verified-fix'").select("turn_id", F.lit("workflow").alias("basis")).distinct()
    asked = of_prompts(turns).join(fixed, ["turn_id", "basis"], "left_anti").select(*COLUMNS)
    first = stored(of_events(events).unionByName(told).unionByName(asked), "offered")  # read twice; its rules make a large plan
    return first.unionByName(of_fallback(turns, first))


_TYPE = "struct<kind:string,basis:string,statement:string,title:string,trigger:string,evidence:array<string>,confidence:string>"


def finalized(candidates: DataFrame) -> DataFrame:
    """Candidates with tidy statements, titles and evidence; leaks, dumps and stories of several sentences go."""
    kind, basis = F.col("kind"), F.col("basis")

    def tidy(t: Column) -> Column:
        flat = squeezed(t)
        sound = (F.length(t) > 0) & ~skill_leak(t) & ~st.raw_dump(t)
        return F.when(sound, let(flat, lambda f: F.when(~f.rlike(r"(?i)^In\s*,") & ((basis == "verified-fix") | atomic(f)) & ~st.narration(f), f)))

    def titled(said: Column) -> Column:
        title = F.when(kind == "decision", cleaned_title(F.col("title"), said, 72)).otherwise(cleaned_title(F.col("title"), said, 60))
        return let(title, lambda t: F.when((F.length(t) > 0) & st.durable(kind, said), F.struct(said.alias("statement"), t.alias("title"))))

    lines = let(cleaned_statement(without_leaks(F.col("statement")), keep_lines=True), tidy)
    made = let(shortened(lines, LONGEST), lambda said: F.when(said.isNotNull(), titled(said)))
    clean = F.filter(F.transform("evidence", lambda e: capped_bytes(without_leaks(e))), lambda e: (F.length(e) > 0) & ~skill_leak(e))
    rows = stored(candidates, "offered")
    rows = once_each(rows, ["kind", "basis", "statement", "title"], lambda v: v.withColumn("_made", made), "finalized").where("_made is not null")
    rows = once_each(rows, ["evidence"], lambda v: v.withColumn("_clean", F.array_distinct(clean)), "evidence")
    rows = rows.withColumns({"statement": F.col("_made.statement"), "title": F.col("_made.title")})
    evidence = F.when(F.size("_clean") > 0, F.col("_clean")).otherwise(F.array(capped_bytes(F.col("statement"))))
    verified = F.when(basis.isin(VERIFIED), "verified").otherwise("inferred")
    return rows.withColumns({"evidence": evidence, "evidence_type": verified}).drop("_made", "_clean")


def semantic_key(c: Column) -> Column:
    """What a statement is about, without leading verbs, places, causes and small words."""
    t = F.regexp_replace(F.lower(c), r"`([^`]+)`", "$1")
    for pattern in (
        r"\A(?:resolved|fixed|completed|implemented|added|updated|changed)\s+",
        r"\Aerror\s+(?:after|with|in|while)\s+",
        r"\Ain\s+[^,]+,\s+",
        r"\s+by\s+[\s\S]*\z",
        r";\s*verified[\s\S]*\z",
    ):
        t = F.regexp_replace(t, pattern, "")
    t = F.regexp_replace(t, r"\b(?:the|a|an|to|each|in|by|with|and|or|for|of|on|at|is|are|was|were)\b", " ")
    return F.trim(F.regexp_replace(t, r"[^a-z0-9]+", " "))


def contained(rows: DataFrame) -> DataFrame:
    """session_id, place and before: pairs of rows of which the one's key contains the other's, the earlier as ``before``.

    ``rows``: session_id, place, kind, key. Only keys of ``KEY_LEAST`` characters or more, of
    different kinds, count. A key that another contains begins with some window of that one's
    characters, so rows meet by session and window, and only those that do are compared.
    """
    long = rows.where(F.length("key") >= KEY_LEAST)
    windows = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("key") - KEY_LEAST + 1), lambda i: F.substring("key", i, F.lit(KEY_LEAST))))
    outer = long.select("session_id", F.col("place").alias("_p"), F.col("kind").alias("_kind"), F.col("key").alias("_key"), F.explode(windows).alias("window"))
    met = long.withColumn("window", F.substring("key", 1, KEY_LEAST)).join(outer, ["session_id", "window"])
    met = met.where((F.col("kind") != F.col("_kind")) & F.contains("_key", F.col("key")))
    return met.select("session_id", F.greatest("place", "_p").alias("place"), F.least("place", "_p").alias("before")).distinct()


def kept(candidates: DataFrame, cap: int | None = CAP) -> DataFrame:
    """Per session the candidates that are not repeats and not contained in a stronger one of another kind, or contain one.

    A greedy choice by priority. Repeats of a kind go by a window; what contains or is contained is
    found by a join (``contained``), and of these few a fold in order of priority drops each that
    meets an earlier one which was not dropped itself. ``cap`` is how many lessons a session shows
    (None: all); ``place`` is a lesson's place by its line.
    """
    candidates = stored(candidates, "candidates")
    order = F.coalesce(*(F.when(F.col("basis") == b, F.lit(-p)) for b, p in PRIORITY.items()), F.lit(0))
    line = F.coalesce("line", F.lit(2**31 - 1))
    first = Window.partitionBy("session_id", "kind", F.lower("statement")).orderBy("o", "l", "learning_id")
    rows = candidates.select("session_id", "learning_id", "kind", "statement", order.alias("o"), line.alias("l")).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    session = Window.partitionBy("session_id")
    keyed = rows.select("session_id", "learning_id", "kind", "o", "l", semantic_key(F.col("statement")).alias("key")).withColumn("place", F.row_number().over(session.orderBy("o", "l", "learning_id", "kind")))
    conflicts = contained(keyed).groupBy("session_id", "place").agg(F.collect_set("before").alias("before"))
    lists = conflicts.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("place", "before"))).alias("all"))
    none = F.array().cast("array<int>")
    gone = F.aggregate("all", none, lambda out, x: F.when(F.size(F.array_except(x.before, out)) > 0, F.concat(out, F.array(x.place))).otherwise(out))
    dropped = lists.select("session_id", F.explode(gone).alias("place"))
    chosen = keyed.join(dropped, ["session_id", "place"], "left_anti").drop("place").withColumn("place", F.row_number().over(session.orderBy("l", "o", "learning_id")) - 1)
    if cap is not None:
        chosen = chosen.where(F.col("place") < cap)
    return candidates.join(chosen.select("session_id", "learning_id", "place"), ["session_id", "learning_id"])


def preferences(turns: DataFrame) -> DataFrame:
    """Lasting preferences that a user states: lines that start with always, never or prefer and ask for no task."""
    line = F.trim(F.regexp_replace("line", r"\A[\s\-*]+", ""))
    rows = turns.select("user_prompt").distinct().select("user_prompt", F.posexplode(F.split("user_prompt", r"\r?\n+")).alias("pos", "line")).withColumn("line", line)
    task = matches(F.col("line"), r"\b(?:this task|this change|this session|this request)\b") | matches(
        F.col("line"), r"\b(?:add|change|create|edit|fix|implement|inspect|review|update)\b.*\b(?:branch|change|command|file|feature|PR|task|test)\b"
    )
    stated = matches(F.col("line"), r"^(?:please\s+)?(?:always|never|prefer(?:ably)?\b)")
    tidy = F.regexp_replace(F.regexp_replace(cleaned_statement(F.col("line")), r"\A\d+\s*[\].):-]\s*", ""), r"[.!?]+\z", "")
    out = rows.where((F.length("line") > 0) & (F.length("line") <= 180) & stated & ~task).withColumn("statement", F.concat(squeezed(tidy), F.lit(".")))
    said = turns.select("session_id", "turn_id", "user_prompt").join(out.where(F.length("statement") > 1), "user_prompt")
    return said.select("session_id", "turn_id", "pos", "line", "statement")
