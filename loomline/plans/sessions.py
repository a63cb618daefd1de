"""Queries over records, turns, events, commands and what they lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.statements import ERRNO, error_signature
from loomline.operators import candidates, commands, events, summaries, turns
from loomline.plans import overlay
from loomline.plans.registry import Tables, query
from loomline.sources.scratch import spread, stored
from loomline.sources.transcripts import of_conversations

KIND_SQL = "case role when 'user' then 'user_message' when 'assistant' then 'assistant_message' when 'tool' then 'tool_result_stub' else 'event' end"
GROUPED_SQL = f"""
select *, concat(session_id, ':turn-', lpad(cast(turn_index as varchar), 4, '0')) as turn_id from (
  select *, greatest(g, 1) - 1 as turn_index from (
    select cast(conv_id as varchar) as session_id, turn as line, {KIND_SQL} as kind, text,
           sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as g,
           sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id) as asked
    from conversations
  ) as counted where asked > 0
) as numbered
"""
WHITE = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
VERIFIED = r"\b(verified|confirmed|tests? pass(ed)?|build succeeded|all checks passed)\b"
TAG_ORDER = ["failure", "fix", "decision", "next_step", "verification"]


def overlaid(t: Tables) -> DataFrame:
    """Grouped records of the overlay."""
    rows = t.spark.sql(overlay.SQL.replace("from events", "from {events}"), events=t.events)
    return turns.grouped(turns.with_defaults(rows))


def tagged(t: Tables) -> DataFrame:
    return events.tagged(overlaid(t))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _tag_sql() -> str:
    """Events of the overlay by the definition: each type's first pattern, allowed kinds, first of equal ones in a turn."""
    parts = []
    for i, name in enumerate(TAG_ORDER):
        first = "case " + " ".join(f"when regexp_matches(text, {_quoted(p)}, 'i') then {k}" for k, p in enumerate(events.PATTERNS[name])) + " end"
        kinds = "('assistant_message', 'tool_result_stub', 'tool_use_stub')" if name == "failure" else "('assistant_message')"
        done = " and not (regexp_matches(text, '\\b(?:done|completed|implemented|fixed|resolved|merged|pushed)\\b', 'i') and regexp_matches(text, '\\b(?:verified|tests? pass(?:ed)?|all checks passed|0 failures)\\b', 'i'))" if name == "next_step" else ""
        summary = "concat('Verification noted: ', text)" if name == "verification" else "text"
        parts.append(f"select session_id, turn_id, line, kind, {i} as ord, '{name}' as type, {first} as rule, {summary} as summary from t where kind in {kinds}{done}")
    command = _quoted(events.VERIFYING_COMMAND)
    parts.append(f"select session_id, turn_id, line, kind, 5 as ord, 'verification' as type, 99 as rule, concat('Ran verification command: ', regexp_replace(text, '\\s+', ' ', 'g')) as summary from t where kind = 'tool_use_stub' and regexp_matches(regexp_replace(text, '\\s+', ' ', 'g'), {command}, 'i')")
    return f"""with t as ({overlay.TURNS_SQL}), tagged as ({" union all ".join(parts)}),
      numbered as (select *, row_number() over (partition by turn_id, type, lower(summary) order by line, ord) as rn from tagged where rule is not null)
    select * from numbered where rn = 1"""


TAG_SQL = _tag_sql()


@query(f"select session_id, cast(line as bigint) as line, cast(turn_index as bigint) as turn_index, turn_id from ({GROUPED_SQL})")
def w1_turn_grouping(t: Tables) -> DataFrame:
    return turns.grouped(of_conversations(t.conversations)).select("session_id", F.col("line").cast("long").alias("line"), F.col("turn_index").cast("long").alias("turn_index"), "turn_id")


@query(
    f"""select session_id, turn_id, cast(sum(case when kind in ('tool_use_stub', 'tool_result_stub') then 1 else 0 end) as bigint) as tool_stub_count,
      cast(min(line) as bigint) as first_line, cast(max(line) as bigint) as last_line, count(*) as n_records, count(distinct case when kind = 'assistant_message' then text end) as n_messages,
      sha256(coalesce(arg_min(case when kind = 'user_message' then trim(text, {WHITE}) end, case when kind = 'user_message' then line end), '')) as prompt_sha256,
      coalesce(string_agg(distinct case when kind = 'assistant_message' then sha256(text) end, ',' order by case when kind = 'assistant_message' then sha256(text) end), '') as messages_sha256,
      coalesce(bool_or(kind = 'assistant_message' and regexp_matches(text, '{VERIFIED}', 'i')), false) as verification_seen from ({GROUPED_SQL}) group by session_id, turn_id"""
)
def a19_turn_rollup(t: Tables) -> DataFrame:
    grouped = turns.with_defaults(turns.grouped(of_conversations(t.conversations))).withColumn("input_text", F.lit(None).cast("string"))
    rolled = turns.rolled_up(grouped, seen=events.verifies(F.col("kind"), F.col("text"), F.col("input_text"), F.col("commands")))
    return rolled.select(
        "session_id",
        "turn_id",
        F.col("tool_stub_count").cast("long").alias("tool_stub_count"),
        F.col("first_line").cast("long").alias("first_line"),
        F.col("last_line").cast("long").alias("last_line"),
        "n_records",
        F.size("assistant_messages").cast("long").alias("n_messages"),
        F.sha2("user_prompt", 256).alias("prompt_sha256"),
        F.array_join(F.array_sort(F.transform("assistant_messages", lambda m: F.sha2(m, 256))), ",").alias("messages_sha256"),
        F.col("seen").alias("verification_seen"),
    )


@query(f"select {KIND_SQL} as kind, role as raw_type, count(*) as n from conversations group by all")
def p4_record_kind_counts(t: Tables) -> DataFrame:
    return of_conversations(t.conversations).groupBy("kind", "raw_type").agg(F.count("*").alias("n"))


@query(
    f"""select session_id, count(distinct turn_id) as turn_count, min(turn_id) as first_turn_id, max(turn_id) as last_turn_id, cast(min(line) as bigint) as line_start,
      cast(max(line) as bigint) as line_end, (select count(*) from ({TAG_SQL}) e where e.session_id = t.session_id) as event_count from ({overlay.TURNS_SQL}) t group by session_id"""
)
def a21_manifest_span(t: Tables) -> DataFrame:
    rows = overlaid(t)
    out = turns.span(turns.rolled_up(rows), events.tagged(rows))
    return out.select("session_id", "turn_count", "first_turn_id", "last_turn_id", "line_start", "line_end", "event_count")


@query(f"select concat(turn_id, ':', type, ':', lpad(cast(line as varchar), 6, '0')) as event_id, type, cast(line as bigint) as line, summary from ({TAG_SQL})")
def f8_event_tagging(t: Tables) -> DataFrame:
    return tagged(t).select("event_id", "type", F.col("line").cast("long").alias("line"), "summary")


@query(f"select session_id, type, count(*) as n, count(distinct turn_id) as n_turns from ({TAG_SQL}) group by all")
def w4_event_counts(t: Tables) -> DataFrame:
    return tagged(t).groupBy("session_id", "type").agg(F.count("*").alias("n"), F.count_distinct("turn_id").alias("n_turns"))


_NORMAL_SQL = "regexp_replace(regexp_replace(trim(c), '\\s+', ' ', 'g'), '[.,;:!?]+$', '')"
_COMMANDS_SQL = f"""
select session_id, turn_id, line, pos, command from (
  select *, {_NORMAL_SQL} as command from (
    select session_id, turn_id, line, 0 as pos, text as c from ({overlay.TURNS_SQL}) where kind = 'tool_use_stub'
    union all
    select session_id, turn_id, line, 1, unnest(regexp_extract_all(text, '`([^`\\n]+)`', 1)) from ({overlay.TURNS_SQL})
  )
) where regexp_matches(command, {_quoted(commands.COMMAND)}, 'i') and not regexp_matches(command, '^td-[0-9a-z]{{4,}}', 'i')
  and not (command not like '% %' and lower(command) in ({", ".join(_quoted(c) for c in commands.IDLE)}))
"""


@query(f"select session_id, command, turn_id, cast(line as bigint) as first_seen_line from (select *, row_number() over (partition by session_id, command order by turn_id, line, pos) as rn from ({_COMMANDS_SQL})) where rn = 1")
def f6_command_entries(t: Tables) -> DataFrame:
    return commands.entries(overlaid(t)).select("session_id", "command", "turn_id", F.col("first_seen_line").cast("long").alias("first_seen_line"))


@query(
    f"""with t as ({overlay.TURNS_SQL}), signals as (
      select turn_id, line from t where kind = 'tool_result_stub' and regexp_matches(status, 'fail|error', 'i')
      union select turn_id, line from ({TAG_SQL}) where type in ('failure', 'verification')),
    found as (select s.turn_id, min(a.line) as pos from signals s join t a on a.turn_id = s.turn_id and a.kind = 'assistant_message' and a.line >= s.line group by s.turn_id, s.line)
    select turn_id, count(distinct text) as n_messages, min(text) as first_text from (select f.turn_id, t.line, t.text from (select distinct turn_id, pos from found) f join t on t.turn_id = f.turn_id and t.line = f.pos) group by turn_id"""
)
def j12_forward_asof(t: Tables) -> DataFrame:
    rows = overlaid(t)
    return events.focused(rows, events.tagged(rows)).select("turn_id", F.size(F.array_distinct("focus")).cast("long").alias("n_messages"), F.array_min("focus").alias("first_text"))


@query(
    f"""with e as ({TAG_SQL}), ids as (select *, concat(turn_id, ':', type, ':', lpad(cast(line as varchar), 6, '0')) as event_id from e),
      f as (select turn_id, min(case when type = 'fix' then line end) as fix, min(case when type = 'verification' then line end) as chk from e group by turn_id)
    select ids.event_id, coalesce(f.fix, f.chk) as by_line from ids join f using (turn_id) where type = 'failure' and coalesce(f.fix, f.chk) is not null"""
)
def j13_resolutions(t: Tables) -> DataFrame:
    out = events.resolutions(tagged(t))
    return out.select("event_id", F.regexp_extract("by_event_id", r"(\d+)$", 1).cast("long").alias("by_line"))


@query(
    f"""select event_id, case
      when len(list_filter(regexp_extract_all(text, '\\b(E[A-Z]{{2,}})\\b', 1), lambda x: x in ({", ".join(_quoted(e) for e in ERRNO)}))) > 0 then list_filter(regexp_extract_all(text, '\\b(E[A-Z]{{2,}})\\b', 1), lambda x: x in ({", ".join(_quoted(e) for e in ERRNO)}))[1]
      when regexp_matches(text, '\\b[A-Z][A-Za-z0-9]*(?:Error|Exception)\\b') then regexp_extract(text, '\\b([A-Z][A-Za-z0-9]*(?:Error|Exception))\\b', 1)
      when regexp_matches(text, '(?i)\\bexit(?:ed with)?(?:\\s+status)?\\s+code\\s+(\\d+)\\b') then concat('exit code ', regexp_extract(text, '(?i)\\bexit(?:ed with)?(?:\\s+status)?\\s+code\\s+(\\d+)\\b', 1)) end as signature
    from ({overlay.SQL}) where kind = 'tool_result_stub'"""
)
def f23_error_signature(t: Tables) -> DataFrame:
    return overlaid(t).sparkSession.sql(overlay.SQL.replace("from events", "from {events}"), events=t.events).where("kind = 'tool_result_stub'").select("event_id", error_signature(F.col("text")).alias("signature"))


def session_turns(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Canonical turns and events of the overlay, with a project for each user; stored, as every rule reads them again."""
    rows = spread(stored(overlaid(t), "grouped"))
    said = events.read_once(rows)
    found = spread(stored(events.tagged(said), "events"))
    rolled = turns.rolled_up(rows).join(commands.by_turn(said), "turn_id", "left")
    out = events.canonical_turns(rolled.drop("commands"), found, events.focused(rows, found))
    project = F.concat(F.lit("project-"), F.regexp_extract("session_id", r"^u(\d+)", 1))
    empty = F.array().cast("array<string>")
    own = spread(stored(out.withColumns({"project_key": project, "commands_seen": F.coalesce("commands_seen", empty)}), "turns"))
    return own, found.withColumn("project_key", project)


@query()
def f27_lesson_candidates(t: Tables) -> DataFrame:
    """Candidates of the overlay's sessions after tidying, without repeats and redundant ones."""
    own, found = session_turns(t)
    out = candidates.kept(candidates.finalized(candidates.offered(own, found)))
    return out.select("session_id", "learning_id", "kind", "basis", "statement", "title", "trigger", "evidence_type", "confidence", F.col("place").cast("long").alias("place"))


@query()
def f33_session_summaries(t: Tables) -> DataFrame:
    own, found = session_turns(t)
    offered = candidates.kept(candidates.finalized(candidates.offered(own, found)))
    lessons = offered.select("session_id", F.lit("project").alias("scope"), "statement")
    prefs = candidates.preferences(own).select("session_id", F.lit("user").alias("scope"), "statement")
    return summaries.summaries(own, found, lessons.unionByName(prefs))


@query()
def f10_assistant_summaries(t: Tables) -> DataFrame:
    own, _ = session_turns(t)
    return own.select("turn_id", "user_prompt", "assistant_summary", "verification_seen")
