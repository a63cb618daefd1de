"""Queries that start from transcript lines: conversations and the overlay written as lines of each tool and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators import run
from loomline.plans import overlay
from loomline.plans.registry import Query, Tables, query
from loomline.plans.sessions import TAG_SQL
from loomline.sources import artifacts, transcripts
from loomline.sources.scratch import new_path

c = F.col


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))


def _struct(**fields: Column) -> Column:
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def _message(tool: str) -> Column:
    """A line of ``tool`` with a message of role and text."""
    role, text = c("role"), c("text")
    part = F.array(_struct(type=F.lit("text"), text=text))
    if tool == "cursor":
        quoted = F.when(role == "user", F.concat(F.lit("<user_query>"), text, F.lit("</user_query>"))).otherwise(text)
        return _json(type=role, message=_struct(content=F.array(_struct(type=F.lit("text"), text=quoted))))
    if tool == "claude-code":
        return _json(type=role, message=_struct(content=text))
    if tool == "codex-cli":
        return _json(type=F.lit("response_item"), payload=_struct(type=F.lit("message"), role=role, content=part))
    if tool == "kimi":
        user = _json(message=_struct(type=F.lit("TurnBegin"), payload=_struct(user_input=part)))
        other = F.when(role == "assistant", "ContentPart").otherwise("StatusUpdate")
        return F.when(role == "user", user).otherwise(_json(message=_struct(type=other, payload=_struct(type=F.lit("text"), text=text))))
    return _json(type=F.lit("message"), message=_struct(role=role, content=part))


def _call(tool: str) -> Column:
    """A line of ``tool`` with a call of ``command``, which one dialect writes as a result."""
    command, number = c("command"), c("call")
    if tool == "codex-cli":
        return _json(type=F.lit("response_item"), payload=_struct(type=F.lit("function_call"), name=F.lit("sh"), call_id=number, command=command))
    if tool == "kimi":
        return _json(message=_struct(type=F.lit("ToolCall"), payload=_struct(id=number, function=_struct(name=F.lit("sh"), arguments=_json(command=command)))))
    if tool == "pi":
        return _json(type=F.lit("message"), message=_struct(role=F.lit("toolResult"), toolName=F.lit("sh"), id=number, command=command, content=F.lit("")))
    return _json(type=F.lit("tool_use"), name=F.lit("sh"), id=number, arguments=_struct(command=command))


PATHS = {
    "cursor": "/a/proj/agent-transcripts/x/{}.jsonl",
    "claude-code": "/a/projects/-home-a/{}.jsonl",
    "codex-cli": "/a/sessions/2026/05/03/rollout-{}.jsonl",
    "kimi": "/a/sessions/d41d8cd98f00b204e9800998ecf8427e/{}/wire.jsonl",
    "pi": "/a/sessions/--home--/2026_{}.jsonl",
}


def written(t: Tables, tool: str) -> DataFrame:
    """Lines of ``tool``: each message of the conversations, and after each user's message a call."""
    said = t.conversations.select(c("conv_id").cast("string").alias("conv"), (2 * c("turn") + 1).alias("line"), "role", "text")
    messages = said.select("conv", "line", _message(tool).alias("raw"))
    asked = said.where("role = 'user'").withColumns({"line": c("line") + 1, "command": F.concat(F.lit("npm run build-"), "conv"), "call": F.concat(F.lit("c"), c("line").cast("string"))})
    calls = asked.select("conv", "line", _call(tool).alias("raw"))
    before, after = PATHS[tool].split("{}")
    rows = messages.unionByName(calls).withColumn("source_path", F.concat(F.lit(before), "conv", F.lit(after)))
    return rows.select(F.lit(tool).alias("source_tool"), "source_path", transcripts.DIALECTS[tool].session_id(c("source_path")).alias("session_id"), "line", "raw")


def _sql(tool: str) -> str:
    prefix = "rollout-" if tool == "codex-cli" else ""
    kind = "tool_result_stub" if tool == "pi" else "tool_use_stub"
    white = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
    return f"""select concat('{prefix}', conv_id) as session_id, 2 * turn + 1 as line, case role when 'user' then 'user_message' when 'assistant' then 'assistant_message' else 'event' end as kind,
      sha256(trim(text, {white})) as text_sha256, null as call_id, null as command from conversations
    union all select concat('{prefix}', conv_id), 2 * turn + 2, '{kind}', null, concat('c', 2 * turn + 1), concat('npm run build-', conv_id) from conversations where role = 'user'"""


def _records(tool: str) -> Query:
    def read(t: Tables) -> DataFrame:
        rows = transcripts.records(written(t, tool), tool)
        called = c("kind").isin("tool_use_stub", "tool_result_stub")
        return rows.select("session_id", c("line").cast("long").alias("line"), "kind", F.when(~called, F.sha2("text", 256)).alias("text_sha256"), "call_id", F.when(called, F.array_join("commands", ",")).alias("command"))

    return read


for number, name in ((9, "cursor"), (10, "claude-code"), (11, "codex-cli"), (12, "kimi"), (13, "pi")):
    made = _records(name)
    made.__name__ = f"s{number}_{name.split('-')[0]}_records"
    query(_sql(name))(made)


@query("select concat('/a/projects/-home-a/', conv_id, '.jsonl:', 2 * turn + 1) as at from conversations where conv_id % 5 = 0 and role = 'assistant'")
def p5_bad_lines(t: Tables) -> DataFrame:
    """Of every fifth conversation the assistant's lines are torn."""
    rows = written(t, "claude-code")
    torn = c("raw").contains('"type":"assistant"') & (c("session_id").cast("long") % 5 == 0)
    return transcripts.bad_lines(rows.withColumn("raw", F.when(torn, F.expr("substring(raw, 1, length(raw) - 1)")).otherwise(c("raw")))).select("at")


def overlay_lines(t: Tables) -> DataFrame:
    """The overlay's sessions as lines of one tool."""
    rows = t.spark.sql(overlay.SQL.replace("from events", "from {events}"), events=t.events)
    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    said = _json(type=F.when(c("kind") == "user_message", "user").otherwise("assistant"), timestamp=when, message=_struct(content=c("text")))
    call = _json(type=F.lit("tool_use"), timestamp=when, name=F.lit("sh"), id=c("event_id").cast("string"), arguments=_struct(command=c("text")))
    result = _json(type=F.lit("tool_result"), timestamp=when, status=c("status"), summary=c("text"))
    raw = F.when(c("kind") == "tool_use_stub", call).when(c("kind") == "tool_result_stub", result).otherwise(said)
    path = F.concat(F.lit("/a/projects/-home-a/"), "session_id", F.lit(".jsonl"))
    return rows.select(F.lit("claude-code").alias("source_tool"), path.alias("source_path"), "session_id", "line", raw.alias("raw"))


@query(
    f"""with n as (select session_id, count(distinct turn_id) as n_turns, min(turn_id) as first_turn_id from ({overlay.TURNS_SQL}) group by session_id), e as (select session_id, count(*) as n_events from ({TAG_SQL}) group by session_id)
    select n.session_id, n_turns, first_turn_id, coalesce(n_events, 0) as n_events, 'extracted' as lifecycle from n left join e using (session_id)"""
)
def t7_memory_run(t: Tables) -> DataFrame:
    """A whole run over the overlay's lines: the tables that it leaves behind, by session."""
    root, rows = new_path(t.spark, "run"), overlay_lines(t)
    now = F.lit("2024-04-01 00:00:00").cast("timestamp")
    project = F.concat(F.lit("project-"), F.regexp_extract("session_id", r"^u(\d+)", 1))
    run.run(rows, root, now, project)
    own = artifacts.load(t.spark, root, "turns").groupBy("session_id").agg(F.count("*").alias("n_turns"), F.min("turn_id").alias("first_turn_id"))
    found = artifacts.load(t.spark, root, "events").groupBy("session_id").agg(F.count("*").alias("n_events"))
    out = own.join(found, "session_id", "left").join(artifacts.load(t.spark, root, "ledger").select("session_id", "lifecycle"), "session_id")
    return out.select("session_id", "n_turns", "first_turn_id", F.coalesce("n_events", F.lit(0)).cast("long").alias("n_events"), "lifecycle")
