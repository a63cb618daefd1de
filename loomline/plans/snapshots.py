"""Queries of snapshots, merges by id, exports, provider answers and judges."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import answers
from loomline.operators import instincts, judges, snapshots
from loomline.plans.memory import _IN_ROLLUP, _RECORDS_SQL, records
from loomline.plans.registry import Tables, query
from loomline.plans.selections import text_of
from loomline.plans.sessions import _COMMANDS_SQL, _quoted, session_turns

c = F.col

_EVENT_LINES = """case when event_id % 13 = 0 then '{"ts": broken' when event_id % 13 = 1 then '  ' when event_id % 13 = 2 then concat('{"ts":', event_id, ',"project_id":7,"delivered":"true"}')
  else concat('{"ts":"', substr(concat('000000000', event_id), -9), '","project_id":"p', user_id, '","delivered":', case when event_type = 'view' then 'true' else 'false' end, '}') end"""


@query(
    """with e as (select *, lpad(cast(event_id as varchar), 9, '0') as ts9, event_id % 13 > 2 as typed from events where event_id % 13 > 1)
    select count(*) as total_fires, count(*) filter (typed and event_type = 'view') as fires_delivered, count(distinct case when typed then user_id end) as distinct_projects,
      max(case when typed and event_type = 'view' then ts9 end) as last_delivered_at, max(case when typed then ts9 end) as last_fire_at from e"""
)
def a12_recall_summary(t: Tables) -> DataFrame:
    return snapshots.recall_summary(t.events.selectExpr(f"{_EVENT_LINES} as line"))


@query("select o_custkey, count(*) as learnings from orders group by o_custkey order by learnings desc, cast(o_custkey as varchar) limit 10")
def a6_most_learnings(t: Tables) -> DataFrame:
    counts = t.orders.groupBy(text_of(c("o_custkey")).alias("session_id")).agg(F.count("*").alias("learnings"))
    return snapshots.most_learnings(counts).select(c("session_id").cast("long").alias("o_custkey"), "learnings")


@query(
    """with g as (select coalesce(text, '') as k, count(*) as n from documents group by 1), s as (select cast(sum(n) as bigint) as rows, count(*) as kept, count(*) filter (n > 1) as repeating_keys from g)
    select rows, kept, repeating_keys, rows - kept as duplicates, round((rows - kept) / rows, 4) as rate from s"""
)
def a23_duplicate_rate(t: Tables) -> DataFrame:
    return snapshots.duplicate_rate(t.documents, F.coalesce("text", F.lit("")))


@query(
    """with r as (select d.source, d.text, toxic from labels l join documents d using (doc_id) where quality = 1), i as (select source, count(*) as n from documents where lang = 'en' group by 1)
    select r.source as project_id, 'reviewed-export' as source, count(distinct case when toxic = 0 then coalesce(text, '') end) as learnings, coalesce(max(i.n), 0) as instincts from r left join i on i.source = r.source group by r.source"""
)
def a28_knowledge(t: Tables) -> DataFrame:
    """Documents labelled good stand for reviewed learnings, so the others are not read."""
    rows = t.documents.select("doc_id", c("source").alias("project_id"), "text").join(t.labels, "doc_id", "left").withColumn("scope", F.when(c("toxic") == 0, "project").otherwise("user"))
    good = F.coalesce(c("quality") == 1, F.lit(False))
    found = snapshots.knowledge(rows.where(good).select("project_id", "text", "scope"), rows.where(~good).select("project_id", "text", "scope"))
    held = t.documents.where("lang = 'en'").select(c("source").alias("project_id"))
    return snapshots.knowledge_snapshot(found, held, F.coalesce("text", F.lit("")))


_TECH = "case " + " ".join(f"when head = '{k}' then '{v}'" for k, v in snapshots.COMMAND_TECHNOLOGY.items()) + " end"
_SKILL = "case " + " ".join(f"when regexp_matches(lower(trim(command)), {_quoted(p)}) then '{v}'" for p, v in snapshots.SKILL_OF_COMMAND) + " end"


@query(
    f"""with k as (select session_id, command, split_part(lower(trim(command)), ' ', 1) as head from ({_COMMANDS_SQL})), m as (select session_id, {_TECH} as tech, {_SKILL} as skill from k)
    select session_id, coalesce(string_agg(distinct tech, ',' order by tech), '') as technologies, coalesce(string_agg(distinct skill, ',' order by skill), '') as skills from m group by session_id"""
)
def a20_technologies(t: Tables) -> DataFrame:
    own, _ = session_turns(t)
    out = snapshots.technologies(own.where(F.size("commands_seen") > 0).select("session_id", "commands_seen", F.array().cast("array<string>").alias("files_touched")))
    return out.select("session_id", F.array_join("technologies", ",").alias("technologies"), F.array_join("skills", ",").alias("skills"))


@query("select c_custkey, c_acctbal as score from customer order by c_acctbal desc, cast(c_custkey as varchar) limit 25")
def o8_top_sessions(t: Tables) -> DataFrame:
    return snapshots.top_sessions(t.customer.select(text_of(c("c_custkey")).alias("session_id"), c("c_acctbal").alias("score")), 25).select(c("session_id").cast("long").alias("c_custkey"), "score")


@query(
    f"""{_RECORDS_SQL}, u as (select instinct_id, round(confidence, 6) as confidence, case when project_id = 'view' then 1 else 0 end as g from r where {_IN_ROLLUP} and project_id in ('view', 'click'))
    select instinct_id, arg_max(confidence, g) as confidence, max(g) = 1 as general from u group by instinct_id"""
)
def o10_for_rollup(t: Tables) -> DataFrame:
    rows = records(t).select("instinct_id", F.round("confidence", 6).alias("confidence"), "maturity", "project_id")
    out = snapshots.for_rollup(rows.where("project_id = 'click'").withColumn("general", F.lit(False)), rows.where("project_id = 'view'").withColumn("general", F.lit(True)))
    return out.select("instinct_id", "confidence", "general")


@query("select coalesce(s_suppkey, c_custkey) as id, coalesce(s_name, c_name) as name from customer full join supplier on s_suppkey = c_custkey")
def o12_merged_by_id(t: Tables) -> DataFrame:
    return snapshots.merged_by_id(t.customer.select(c("c_custkey").alias("id"), c("c_name").alias("name")), t.supplier.select(c("s_suppkey").alias("id"), c("s_name").alias("name")), "id")


@query(
    """with o as (select o_custkey, count(*) as n, arg_min(o_orderstatus, o_orderkey) as f, arg_max(o_orderstatus, o_orderkey) as l from orders group by 1)
    select c_custkey as session_id, case when c_acctbal > 0 then c_name end as topic, coalesce(n, 0) as n_turns, f as first_status, l as last_status from customer left join o on o_custkey = c_custkey"""
)
def j22_session_details(t: Tables) -> DataFrame:
    index = t.customer.select(c("c_custkey").alias("session_id"))
    told = t.customer.where("c_acctbal > 0").select(c("c_custkey").alias("session_id"), c("c_name").alias("topic"))
    own = t.orders.select(c("o_custkey").alias("session_id"), c("o_orderkey").alias("turn_index"), c("o_orderstatus").alias("status"))
    status = F.transform("turns", lambda x: x.status)
    return snapshots.session_details(index, told, own).select("session_id", c("summary.topic").alias("topic"), F.size("turns").cast("long").alias("n_turns"), F.get(status, F.lit(0)).alias("first_status"), F.try_element_at(status, F.lit(-1)).alias("last_status"))


@query(
    """with a as (select o_orderkey as path, cast(o_custkey as bigint) as bytes, case when o_orderkey % 3 <> 0 then 'copy' when o_orderstatus = 'F' then 'skip' else 'conflict' end as action from orders)
    select path, bytes, action, (select sum(bytes) from a where action = 'copy') <= 1000000 as fits from a"""
)
def k16_copy_plan(t: Tables) -> DataFrame:
    source = t.orders.select(c("o_orderkey").alias("path"), c("o_custkey").cast("long").alias("bytes"), c("o_orderstatus").alias("hash"))
    return snapshots.copy_plan(source, source.where("path % 3 = 0").select("path", F.lit("F").alias("hash")), 1_000_000)


_UUID = "concat('0a1b2c3d-0000-4000-8000-', lpad(concat('', page_id), 12, '0'))"
_FILES = f"case page_id % 5 when 0 then concat('/a/rollout-2024-01-02T03-04-05-', {_UUID}, '.jsonl') when 1 then concat('/a/b.c/rollout-x', page_id, '.jsonl') when 2 then concat('/a/', page_id, '.tar.gz') when 3 then '/a/' else concat('/a/rollout-', {_UUID}) end"


@query(
    f"""with f as (select page_id, {_FILES} as path, page_id % 2 = 0 as codex from pages), s as (select *, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') as stem from f),
      u as (select *, regexp_extract(stem, '^rollout-(?:\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}-\\d{{2}}-\\d{{2}}-)?([0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}})$', 1) as id from s)
    select page_id, coalesce(case when codex then coalesce(nullif(id, ''), nullif(regexp_replace(stem, '^rollout-', ''), '')) else nullif(stem, '') end, concat('s', page_id)) as uuid from u"""
)
def f45_source_uuid(t: Tables) -> DataFrame:
    rows = t.pages.selectExpr("page_id", f"{_FILES} as path")
    tool = F.when(c("page_id") % 2 == 0, "codex-cli").otherwise("other")
    return rows.select("page_id", answers.source_uuid(tool, c("path"), F.concat(F.lit("s"), text_of(c("page_id")))).alias("uuid"))


#: Answers of reviewers: most are valid, others lack a part or have it in another type.
_ANSWERS = """case when event_id % 17 = 0 then 'no json' else concat('{"verdict":', case when event_id % 19 = 0 then '"maybe"' when event_id % 2 = 0 then '"keep"' else '"reject"' end, ',"durability":', case when event_id % 23 = 0 then '1' else '"durable"' end,
  ',"keep":', case when event_id % 29 = 0 then '"true"' when event_id % 2 = 0 then 'true' else 'false' end, case when event_id % 31 = 0 then '' else concat(',"reason":" of ', event_type, ' "') end,
  case when event_id % 5 = 0 then '' when event_id % 5 = 1 then ',"statement":" "' else concat(',"statement":" user ', user_id, '"') end, case when event_id % 7 = 0 then ',"trigger":3' else ',"trigger":"a   b "' end, '}') end"""


@query(
    f"""with a as (select event_id, {_ANSWERS} as a from events), p as (select event_id, case when json_valid(a) then a end as j from a),
      f as (select event_id, j, case when json_type(j, '$.verdict') = 'VARCHAR' then j ->> '$.verdict' end as verdict, case when json_type(j, '$.durability') = 'VARCHAR' then j ->> '$.durability' end as durability,
        case when json_type(j, '$.keep') = 'BOOLEAN' then j ->> '$.keep' = 'true' end as keep, case when json_type(j, '$.reason') = 'VARCHAR' then nullif(trim(j ->> '$.reason'), '') end as reason,
        case when json_type(j, '$.statement') = 'VARCHAR' then nullif(trim(j ->> '$.statement'), '') end as statement, case when json_type(j, '$.trigger') = 'VARCHAR' then nullif(trim(regexp_replace(j ->> '$.trigger', '\\s+', ' ', 'g')), '') end as trigger from p),
      e as (select *, case when j is null then 'no JSON' when verdict is null or verdict not in ('keep', 'reject', 'rewrite') then 'verdict' when durability is null or durability not in ('durable', 'transient', 'process', 'duplicate', 'unclear') then 'durability'
        when keep is null then 'keep' when reason is null then 'reason' end as error from f)
    select event_id, error, case when error is null then verdict end as verdict, case when error is null then reason end as reason, case when error is null then coalesce(statement, case when keep then '__missing_statement__' else 'Rejected learning' end) end as statement,
      case when error is null then coalesce(trigger, case when keep then 'When this reviewed learning is relevant.' else 'When reviewing rejected learning output.' end) end as trigger from e"""
)
def f47_reviewed(t: Tables) -> DataFrame:
    rows = t.events.selectExpr("event_id", f"{_ANSWERS} as answer")
    return rows.select("event_id", answers.reviewed(c("answer")).alias("r")).select("event_id", "r.error", "r.verdict", "r.reason", "r.statement", "r.trigger")


_ERRORS = "concat(case event_id % 7 when 0 then 'HTTP (401) ' when 1 then 'Rate Limit Exceeded ' when 2 then 'over QUOTA ' when 3 then 'HTTP (500) ' when 4 then 'Key limit ' when 5 then '(429' else '' end, event_type)"


@query(
    f"""with e as (select event_id, user_id, lower({_ERRORS}) as m from events), k as (select *, contains(m, '(401)') or contains(m, '(403)') or contains(m, '(429)') or contains(m, 'limit exceeded') or contains(m, 'key limit') or contains(m, 'quota') as terminal from e),
      s as (select user_id, min(event_id) as stop from k where terminal group by 1)
    select k.event_id, terminal, coalesce(k.event_id <= stop, true) as asked from k left join s using (user_id)"""
)
def f49_terminal_errors(t: Tables) -> DataFrame:
    rows = t.events.selectExpr("event_id", "user_id", f"{_ERRORS} as error")
    return judges.until_terminal(rows, "user_id", "event_id").select("event_id", answers.terminal_error(c("error")).alias("terminal"), "asked")


_FRONT = "case doc_id % 4 when 0 then concat('---', chr(10), 'title: x', chr(10), '---', chr(10), text) when 1 then concat('---', text) when 2 then concat('---', chr(10), '- a', chr(10), '---') else concat('- ', text) end"


@query(
    f"""with d as (select doc_id, {_FRONT} as t from documents where text is not null), p as (select *, strpos(substr(t, 4), concat(chr(10), '---')) as e from d), r as (select *, substr(t, e + 4) as rest from p),
      s as (select doc_id, case when starts_with(t, '---') and e > 0 then case when strpos(rest, chr(10)) > 0 then substr(rest, strpos(rest, chr(10)) + 1) else '' end else t end as body from r)
    select doc_id, sha256(body) as body_sha256, regexp_matches(body, '(?m)^- ') as has_bullet from s"""
)
def f50_frontmatter(t: Tables) -> DataFrame:
    rows = t.documents.where("text is not null").selectExpr("doc_id", f"{_FRONT} as t")
    body = answers.without_frontmatter(c("t"))
    return rows.select("doc_id", F.sha2(body, 256).alias("body_sha256"), answers.has_bullet(body).alias("has_bullet"))


@query("select doc_id, coalesce(nullif(trim(regexp_replace(case when doc_id % 3 = 0 then concat(' ', chr(10)) when doc_id % 3 = 1 then concat(' When  ', lang, chr(9)) end, '\\s+', ' ', 'g')), ''), source) as trigger from documents")
def f51_trigger(t: Tables) -> DataFrame:
    said = F.when(c("doc_id") % 3 == 0, " \n").when(c("doc_id") % 3 == 1, F.concat(F.lit(" When  "), c("lang"), F.lit("\t")))
    return t.documents.select("doc_id", answers.trigger_or(said, c("source")).alias("trigger"))


def _judge(row: dict) -> tuple[str, float]:
    """A stand-in for a provider: it agrees with users of even number, more surely the higher the number, and fails for every eleventh."""
    user = int(row["trigger"].split()[1])
    if user % 11 == 0:
        raise RuntimeError("no answer")
    return "Sure: " + json.dumps({"global": user % 2 == 0, "confidence": round(0.5 + user % 10 / 20, 2), "reason": "so"}), 0.01


@query(
    f"""{_RECORDS_SQL}, p as (select instinct_id, project_id, confidence, row_number() over (partition by instinct_id order by confidence desc, project_id) as rn from r where maturity <> 'deprecated' and confidence >= 0.7),
      n as (select *, cast(substr(instinct_id, 2) as bigint) as u, row_number() over (order by confidence desc, instinct_id) as place from p where rn = 1),
      k as (select *, sum(case when u % 11 <> 0 then 1 else 0 end) over (order by place rows unbounded preceding) as calls, case when u % 11 = 0 and lag(u) over (order by place) % 11 = 0 and lag(u, 2) over (order by place) % 11 = 0 then place end as broken from n where place <= 20),
      f as (select * from k where place <= coalesce((select min(broken) from k), 20) and calls <= 15)
    select instinct_id, project_id as source_project, 0.5 + u % 10 / 20.0 as verdict_confidence from f where u % 11 <> 0 and u % 2 = 0 and u % 10 >= 2"""
)
def m4_judged_promotions(t: Tables) -> DataFrame:
    """The twenty strongest records judged by a stand-in within a budget of fifteen calls."""
    pool = instincts.judge_pool(records(t)).withColumns({"domain": F.lit("workflow"), "trigger": F.concat(F.lit("user "), F.substring("instinct_id", 2, 20)), "finding": c("instinct_id")})
    cache = t.spark.createDataFrame([], "cache_key string, answer string")
    agreed, _ = judges.judged_promotions(pool, cache, _judge, calls_left=15, usd_left=100.0)
    return agreed.select("instinct_id", "source_project", F.round("verdict_confidence", 2).alias("verdict_confidence"))


def _topic(row: dict) -> str:
    if row["session_id"] % 7 == 0:
        raise RuntimeError("no answer")
    return json.dumps({"topic": f'"Order   {row["session_id"]}"'} if row["session_id"] % 5 else {"title": "x"})


@query(
    """select o_orderkey as session_id, case when o_orderstatus = 'F' and o_orderkey % 7 <> 0 and o_orderkey % 5 <> 0 then concat('Order ', o_orderkey) else o_orderpriority end as topic,
      case when o_orderstatus = 'F' and o_orderkey % 7 <> 0 and o_orderkey % 5 <> 0 then 'llm' else 'deterministic' end as topic_source from orders"""
)
def m3_topics(t: Tables) -> DataFrame:
    """Topics of a stand-in for orders of one status; where it fails or says nothing the order's own stays."""
    rows = t.orders.select(c("o_orderkey").alias("session_id"), c("o_orderpriority").alias("topic"), c("o_orderstatus").alias("status"))
    return judges.topics(rows, c("status") == "F", _topic).select("session_id", "topic", "topic_source")
