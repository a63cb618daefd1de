"""What a session was about and came to: topic, outcomes, failures, decisions, next step, commands, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.prompts import (
    boot_line,
    chatter_line,
    cleaned_statement,
    completed,
    embedded_agent,
    has_chatter,
    has_wrapper_tags,
    no_signal,
    skill_leak,
    substantive,
    without_leaks,
    wrapper_only,
)
from loomline.functions.statements import repo_path
from loomline.functions.text import let, matches, matches_any, shortened, squeezed, text_lines
from loomline.operators.commands import COMMAND
from loomline.sources.scratch import once_each

# Fixed values.
HARNESS_TOPICS = [
    r"^#\s*(?:AGENTS|CLAUDE)\.md\b",
    r"^(?:AGENTS|CLAUDE)\.md\s+instructions\s+for\b",
    r"^#{1,6}\s+Instructions\s*\(read first\)",
    r"^#{1,6}\s+TASK\b",
    r"^#{1,6}\s+Context Usage\b",
    r"^#{1,6}\s+Handoff\b",
    r"^<!--",
]
WEAK_TOPICS = [
    r"^Session summary for\b",
    r"^Base directory for this skill\b",
    r"^/[\w:-]+(?:\s|$)",
    r"^`[^`]*$",
    r"^line \d+, in\b",
    r'^file "(?:~/|/|[A-Za-z]:[\\/]).*", line \d+\b',
    r"^(?:\./|/|~/)\S+$",
]
POSITIVE = r"verified|confirmed|tests? pass(?:ed)?|build succeeded|all checks passed"
OPEN_STEP, NO_STEP = "No open next step recorded.", "No explicit next step recorded."
MOST_FAILED, MOST_LISTED, TOPIC, LINE = 10, 6, 120, 180


def summary_line(c: Column) -> Column:
    """A line as a summary shows it."""
    tidy = F.nullif(cleaned_statement(without_leaks(c)), F.lit(""))
    return shortened(F.coalesce(tidy, c), LINE)


def showable(line: Column) -> Column:
    return (F.length(line) > 0) & ~has_chatter(line) & ~has_wrapper_tags(line)


def low_signal_topic(topic: Column) -> Column:
    """Whether a topic says nothing: boot lines, launch commands, paths, at most one ASCII word, other programs' prompts."""
    return let(squeezed(topic), _weak)


def _weak(t: Column) -> Column:
    words = F.size(F.regexp_extract_all(t, F.lit("[A-Za-z0-9_]+"), F.lit(0)))
    bare = matches(t, COMMAND) & (words <= 4)
    return (F.length(t) == 0) | boot_line(t) | matches_any(t, HARNESS_TOPICS + WEAK_TOPICS) | embedded_agent(t) | skill_leak(t) | (words <= 1) | bare


def topic_line(prompt: Column) -> Column:
    """The first line of a prompt that is not noise."""
    def first(p: Column) -> Column:
        good = F.filter(text_lines(p), lambda x: ~boot_line(x) & ~matches_any(x, HARNESS_TOPICS) & ~chatter_line(x))
        return F.coalesce(F.get(good, F.lit(0)), p)

    return shortened(let(prompt, first), TOPIC)


def topics(turns: DataFrame) -> DataFrame:
    """session_id, topic, topic_source: the first prompt with a signal, else an assistant's sentence, else a default.

    ``turns``: session_id, project_key, turn_index, user_prompt, assistant_summary.
    """
    prompt = substantive(F.col("user_prompt"))
    usable = prompt.isNotNull() & ~wrapper_only(F.col("user_prompt")) & ~no_signal(F.col("user_prompt"))
    line = let(F.when(usable, topic_line(prompt)), lambda t: F.struct(F.when(~low_signal_topic(t), t).alias("good"), F.when(~matches_any(t, HARNESS_TOPICS), t).alias("any")))
    rows = once_each(turns.select("session_id", "project_key", "turn_index", "user_prompt"), ["user_prompt"], lambda v: v.withColumn("_line", line), "topics")

    def first(c: Column) -> Column:
        return F.min_by(c, F.when(c.isNotNull(), F.col("turn_index")))

    by = ["session_id", "project_key"]
    asked = rows.groupBy(*by).agg(first(F.col("_line.good")).alias("a"), first(F.col("_line.any")).alias("b"))
    # What the assistant said is looked at only in sessions whose prompts give no topic.
    sentence = summary_line(F.regexp_extract(squeezed(summary_line(F.col("assistant_summary"))), r"^(.*?[.!?])(?:\s|\z)|^(.*)$", 0))
    good_said = let(sentence, lambda t: F.when(~low_signal_topic(t) & showable(t), shortened(t, TOPIC)))
    silent = asked.where("a is null and b is null").select(F.col("session_id").alias("_s")).distinct()
    said = turns.select(*by, "turn_index", "assistant_summary").join(silent, F.col("session_id") == F.col("_s"), "left_semi").withColumn("_said", good_said)
    told = said.groupBy(F.col("session_id").alias("_s"), F.col("project_key").alias("_p")).agg(first(F.col("_said")).alias("c"))
    out = asked.join(told, (F.col("session_id") == F.col("_s")) & F.col("project_key").eqNullSafe(F.col("_p")), "left")
    default = F.concat(F.lit("Session summary for "), F.col("project_key"))
    return out.select("session_id", F.coalesce("a", "b", "c", default).alias("topic"), F.lit("deterministic").alias("topic_source"))


def _lines(events: DataFrame) -> DataFrame:
    """session_id, field, ord, line: what each event adds to a summary, once per field."""
    said = F.trim(F.regexp_replace("summary", r"(?i)^Verification noted:\s*", ""))
    positive = (F.col("type") == "verification") & matches(F.col("summary"), POSITIVE)
    field = F.when(F.col("type") == "failure", "what_failed").when(F.col("type") == "decision", "what_was_decided").when((F.col("type") == "fix") | positive, "what_worked")
    text = F.when(positive, F.concat(F.lit("Verified: "), said)).otherwise(said)
    shown = F.when(field.isNotNull(), let(summary_line(text), lambda t: F.when(showable(t), t)))
    rows = once_each(events, ["type", "summary"], lambda v: v.withColumns({"field": field, "_shown": shown}), "lines")
    return rows.where("_shown is not null").select("session_id", "field", F.struct("turn_index", F.col("line").alias("l"), "event_id").alias("ord"), F.col("_shown").alias("line"))


def outcomes(events: DataFrame) -> DataFrame:
    """session_id, what_failed, what_was_decided, what_worked: a line is in the first of them that has it."""
    key = F.lower(squeezed(F.col("line")))
    rank = F.when(F.col("field") == "what_failed", 0).when(F.col("field") == "what_was_decided", 1).otherwise(2)
    same = Window.partitionBy("session_id", "_key").orderBy("_rank", "ord")
    first = _lines(events).withColumns({"_key": key, "_rank": rank}).withColumn("_n", F.row_number().over(same)).where("_n = 1")

    def of(field: str, most: int | None = None) -> Column:
        listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == field, F.struct("ord", "line")))), lambda x: x.line)
        return (listed if most is None else F.slice(listed, 1, most)).alias(field)

    return first.groupBy("session_id").agg(of("what_failed", MOST_FAILED), of("what_was_decided"), of("what_worked"))


def next_steps(events: DataFrame) -> DataFrame:
    """session_id and next_step: the last one that is not done yet, or a sentence that there is none."""
    open_step = (F.col("type") == "next_step") & ~completed(F.col("summary"))
    positive = (F.col("type") == "fix") | ((F.col("type") == "verification") & matches(F.col("summary"), POSITIVE))
    sums = events.groupBy("session_id").agg(F.max_by("summary", F.when(open_step, F.struct("turn_index", "line"))).alias("s"), F.bool_or(positive).alias("p"))
    return sums.select("session_id", summary_line(F.coalesce("s", F.when(F.col("p"), OPEN_STEP).otherwise(NO_STEP))).alias("next_step"))


def mentions(turns: DataFrame) -> DataFrame:
    """session_id, useful_commands and files_of_interest: the first six of each in order of turns."""
    in_turns = F.array_sort(F.collect_list(F.struct("turn_index", "commands_seen", F.transform("files_touched", repo_path).alias("f"))))
    sums = turns.groupBy("session_id").agg(in_turns.alias("t"))
    commands = F.array_distinct(F.flatten(F.transform("t", lambda x: x.commands_seen)))
    files = F.filter(F.array_distinct(F.flatten(F.transform("t", lambda x: x.f))), lambda x: x.isNotNull())
    return sums.select("session_id", F.transform(F.slice(commands, 1, MOST_LISTED), summary_line).alias("useful_commands"), F.slice(files, 1, MOST_LISTED).alias("files_of_interest"))


def summaries(turns: DataFrame, events: DataFrame, learnings: DataFrame) -> DataFrame:
    """One row for each session. ``learnings``: session_id, scope, statement."""
    line = let(summary_line(F.col("statement")), lambda t: F.when(showable(t), t))
    of_scope = learnings.select("session_id", "scope", line.alias("line")).groupBy("session_id").agg(
        *(F.sort_array(F.collect_set(F.when(F.col("scope") == scope, F.col("line")))).alias(f"{scope}_learnings") for scope in ("project", "user"))
    )
    out = topics(turns).join(mentions(turns), "session_id")
    for part in (outcomes(events), next_steps(events), of_scope):
        out = out.join(part, "session_id", "left")
    arrays = ["what_failed", "what_was_decided", "what_worked", "project_learnings", "user_learnings"]
    return out.withColumns({**{c: F.coalesce(c, F.array().cast("array<string>")) for c in arrays}, "next_step": F.coalesce("next_step", F.lit(NO_STEP))})


def rendered(rows: DataFrame) -> DataFrame:
    """``rows`` with markdown: a page for each summary."""

    def section(title: str, c: str) -> Column:
        body = F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise("- None recorded.")
        return F.concat(F.lit(f"## {title}\n\n"), body)

    parts = [
        F.concat(F.lit("# "), F.col("topic")),
        section("What worked", "what_worked"),
        section("What failed", "what_failed"),
        section("What was decided", "what_was_decided"),
        section("Useful commands", "useful_commands"),
        section("Files of interest", "files_of_interest"),
        F.concat(F.lit("## Next step\n\n"), F.col("next_step")),
    ]
    return rows.withColumn("markdown", F.concat(F.array_join(F.array(*parts), "\n\n"), F.lit("\n")))
