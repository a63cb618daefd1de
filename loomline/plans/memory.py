"""Queries over long-lived records: deltas, confidence, promotion, recall, workflow mining, review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import confidence as conf
from loomline.operators import instincts, recall, review, workflow
from loomline.plans import overlay
from loomline.plans.registry import Tables, query
from loomline.sources.scratch import spread, stored
from loomline.plans.sessions import _quoted
from loomline.plans.texts import slug_of, words_sql
from loomline.sources.sinks import memory_pages

NOW = "timestamp '2024-04-01 00:00:00'"
#: Observations: a user is a record, an event type a project, an error a correction.
_OBS = "select user_id, event_type, ts, event_id, event_type <> 'error' as reinforcing, (epoch_us({now}) - epoch_us(ts)) / 86400000000.0 as days from events".replace("{now}", NOW)
_VALUE = "sum(case when reinforcing then 0.04 else -0.16 end * pow(0.5, greatest(days, 0) / 90.0))"


def _maturity(value: str, days: str, gains: str, survived: str) -> str:
    return f"""case when {value} < 0.301 then 'deprecated' when {value} >= 0.8 and {days} >= 30 and {gains} >= 5 and {survived} then 'proven'
      when {value} >= 0.6 and {days} >= 7 and {gains} >= 2 then 'established' else 'candidate' end"""


def observations(t: Tables) -> DataFrame:
    return t.events.select("user_id", "event_type", F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("ord"), (F.col("event_type") != "error").alias("reinforcing"))


def now():
    return F.lit("2024-04-01 00:00:00").cast("timestamp")


_STATE_SQL = f"""
with o as ({_OBS}), l as (select *, min(case when not reinforcing then (ts, event_id) end) over (partition by user_id) as loss from o),
s as (select user_id, least(0.9, greatest(0.3, 0.5 + {_VALUE})) as value, max(days) as days, count(*) filter (reinforcing) as gains, count(*) filter (not reinforcing) as losses,
  count(*) filter (reinforcing and (ts, event_id) > loss) >= 2 as survived from l group by user_id)
"""


@query(
    f"""{_STATE_SQL} select user_id, round(value, 6) as confidence, round(days, 6) as age_days, gains as reinforcing_count, losses as correction_count,
      coalesce(survived, false) as survived_contradiction, {_maturity("value", "days", "gains", "coalesce(survived, false)")} as maturity from s"""
)
def f37_maturity(t: Tables) -> DataFrame:
    out = instincts.state(observations(t), ["user_id"], now(), F.lit(conf.START))
    return out.select("user_id", F.round("confidence", 6).alias("confidence"), F.round("age_days", 6).alias("age_days"), "reinforcing_count", "correction_count", "survived_contradiction", "maturity")


@query(
    """with recursive o as (select user_id, event_type, ts, event_id, event_type <> 'error' as reinforcing, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events),
      p as (select a.user_id, a.event_type, a.n, a.ts, least(0.9, greatest(0.3, 0.7 + sum(case when b.reinforcing then 0.04 else -0.16 end * pow(0.5, greatest((epoch_us(a.ts) - epoch_us(b.ts)) / 86400000000.0, 0) / 90.0)))) as value,
        max((epoch_us(a.ts) - epoch_us(b.ts)) / 86400000000.0) as days, count(*) filter (b.reinforcing) as gains
        from o a join o b on a.user_id = b.user_id and a.event_type = b.event_type and b.n <= a.n group by a.user_id, a.event_type, a.n, a.ts)
    select user_id, event_type, epoch_us(min(ts)) as eligible_us from p where value >= 0.6 and days >= 7 and gains >= 2 group by user_id, event_type"""
)
def w12_eligibility(t: Tables) -> DataFrame:
    out = instincts.reached(observations(t), ["user_id", "event_type"], F.lit(0.7))
    return out.select("user_id", "event_type", F.unix_micros("eligible_at").alias("eligible_us"))


_RECORDS_SQL = f"""
with o as ({_OBS}), s as (select user_id, event_type, least(0.9, greatest(0.3, 0.6 + {_VALUE})) as value, max(days) as days, count(*) filter (reinforcing) as gains, max(ts) as updated_at from o group by user_id, event_type),
r as (select concat('i', user_id) as instinct_id, event_type as project_id, value as confidence, {_maturity("value", "days", "gains", "false")} as maturity, 'project' as scope, updated_at from s)
"""


def records(t: Tables) -> DataFrame:
    """A record for each user and project (event type), with its confidence and maturity."""
    rows = observations(t)
    out = instincts.state(rows, ["user_id", "event_type"], now(), F.lit(0.6)).join(rows.groupBy("user_id", "event_type").agg(F.max("at").alias("updated_at")), ["user_id", "event_type"])
    return out.select(F.concat(F.lit("i"), F.col("user_id").cast("string")).alias("instinct_id"), F.col("event_type").alias("project_id"), "confidence", "maturity", F.lit("project").alias("scope"), "updated_at")


@query(
    f"""{_RECORDS_SQL}, a as (select instinct_id, avg(confidence) as c, count(*) as n, bool_or(maturity in ('established', 'proven')) as aged, string_agg(project_id, ',' order by confidence desc, project_id) as projects from r where maturity <> 'deprecated' group by instinct_id)
    select instinct_id, round(c, 4) as avg_confidence, n as project_count, projects from a where n >= 2 and c >= 0.8 and aged"""
)
def a13_promotion_queue(t: Tables) -> DataFrame:
    aged = records(t).withColumn("eligible_at", F.when(F.col("maturity").isin("established", "proven"), F.lit("2024-02-01").cast("timestamp")))
    out = instincts.promotion_queue(aged, now())
    return out.select("instinct_id", F.round("avg_confidence", 4).alias("avg_confidence"), "project_count", F.array_join("projects", ",").alias("projects"))


@query(
    f"""{_RECORDS_SQL}, p as (select *, row_number() over (partition by instinct_id order by confidence desc, project_id) as rn, count(*) over (partition by instinct_id) as project_count from r where maturity <> 'deprecated' and confidence >= 0.7)
    select instinct_id, round(confidence, 6) as confidence, maturity, project_id, project_count from p where rn = 1"""
)
def a14_judge_pool(t: Tables) -> DataFrame:
    out = instincts.judge_pool(records(t))
    return out.select("instinct_id", F.round("confidence", 6).alias("confidence"), "maturity", "project_id", "project_count")


_IN_ROLLUP = "(maturity = 'proven' or (maturity = 'established' and confidence >= 0.7) or (maturity = 'candidate' and confidence >= 0.6))"


@query(
    f"""{_RECORDS_SQL}, p as (select project_id, count(*) as n, count(*) filter ({_IN_ROLLUP}) as r from r group by project_id)
    select cast(sum(n) as bigint) as produced, cast(sum(r) as bigint) as reachable, count(*) as projects_total, count(*) filter (r > 0) as projects_with_reachable, round(sum(r) / sum(n), 4) as reachable_ratio from p"""
)
def a11_reachability(t: Tables) -> DataFrame:
    return instincts.reachability(records(t)).select("produced", "reachable", "projects_total", "projects_with_reachable", "reachable_ratio")


@query(f"{_RECORDS_SQL}, l as (select *, row_number() over (partition by instinct_id order by updated_at desc, project_id) as rn from r) select instinct_id, epoch_us(updated_at) as updated_us from l where rn = 1")
def w6_latest_by_id(t: Tables) -> DataFrame:
    return instincts.latest_by_id(records(t)).select("instinct_id", F.unix_micros("updated_at").alias("updated_us"))


@query(
    f"""{_RECORDS_SQL}, q as (select project_id, instinct_id, row_number() over (partition by project_id order by round(confidence, 6) desc, instinct_id) as place from r where {_IN_ROLLUP})
    select project_id, instinct_id, place, place + 9 <= 60 as included from q"""
)
def w16_rollup_split(t: Tables) -> DataFrame:
    rows = records(t).where(instincts.in_rollup()).withColumns({"domain": F.lit("workflow"), "_c": F.round("confidence", 6)})
    out = instincts.rollup_pages(rows.withColumn("confidence", F.col("_c")), page_lines=60)
    return out.select("project_id", "instinct_id", F.col("place").cast("long").alias("place"), "included")


_DOMAIN = "case cast(substr(instinct_id, 2) as bigint) % 4 when 0 then 'workflow' when 1 then 'git' when 2 then 'code-style' else 'product' end"


@query(
    f"""{_RECORDS_SQL}, q as (select *, {_DOMAIN} as domain, round(confidence, 2) as c from r where {_IN_ROLLUP}),
      p as (select *, row_number() over (partition by project_id order by domain, c desc, instinct_id) as place from q),
      b as (select project_id, place, case when place + 9 <= 16 then 'MEMORY.md' when domain = 'workflow' then 'workflow.md' when domain = 'git' then 'pitfalls.md' else 'preferences.md' end as name,
        concat('- **when ', instinct_id, '** ', maturity, ' (', printf('%.2f', c), ')') as bullet from p),
      g as (select project_id, name, string_agg(bullet, chr(10) order by place) as page from b group by all)
    select project_id, name, case when name = 'MEMORY.md' then page else concat('# ', replace(name, '.md', ''), chr(10), chr(10), 'Spillover from curated MEMORY.md (instincts beyond the line cap).', chr(10), chr(10), page, chr(10)) end as page from g"""
)
def k10_memory_pages(t: Tables) -> DataFrame:
    """Every project's page, and by topic the pages of what the page has no line for."""
    kept = records(t).where(instincts.in_rollup())  # by the full confidence: pages show it rounded
    rows = kept.withColumns({"domain": F.expr(_DOMAIN), "confidence": F.round("confidence", 2), "trigger": F.concat(F.lit("when "), "instinct_id"), "finding": F.col("maturity")})
    return memory_pages(instincts.rollup_pages(rows, page_lines=16)).select("project_id", "name", "page")


@query(
    f"""with l as (select doc_id, case lang when 'en' then 'failure_mode' when 'de' then 'pattern' when 'fr' then 'preference' else 'workflow' end as kind, concat('when ', source) as t, trim(text) as f,
        case when n_chars > 2000 then 'high' when n_chars > 500 then 'medium' else 'low' end as level from documents where text is not null),
      v as (select *, {words_sql("f")} as words from l where length(f) > 0),
      w as (select *, {slug_of("words")} as slug, left(sha256(concat(t, '|', f)), 8) as digest from v),
      i as (select *, concat(case when slug = '' then 'instinct' else slug end, '-', digest) as id from w)
    select doc_id, case when length(id) <= 80 then id else concat(left(id, 72), '-', digest) end as instinct_id,
      case kind when 'failure_mode' then 'debugging' when 'pattern' then 'code-style' when 'preference' then 'tooling' else 'workflow' end as domain,
      case level when 'high' then 0.7 when 'medium' then 0.55 else 0.4 end::double as initial_confidence from i"""
)
def l12_learning_to_delta(t: Tables) -> DataFrame:
    c = F.col
    kind = F.when(c("lang") == "en", "failure_mode").when(c("lang") == "de", "pattern").when(c("lang") == "fr", "preference").otherwise("workflow")
    level = F.when(c("n_chars") > 2000, "high").when(c("n_chars") > 500, "medium").otherwise("low")
    rows = t.documents.where("length(trim(text)) > 0").select("doc_id", kind.alias("kind"), F.lit("").alias("title"), F.concat(F.lit("when "), c("source")).alias("trigger"), c("text").alias("statement"), level.alias("confidence"))
    return instincts.to_deltas(rows).select("doc_id", "instinct_id", "domain", "initial_confidence")


@query(
    "select user_id, count(*) as n_observations, epoch_us(max(ts)) as updated_us from events group by user_id"
)
def l10_fold_observations(t: Tables) -> DataFrame:
    """Every user's events as deltas that create and reinforce one record, replayed."""
    c = F.col
    rows = t.events.select(
        F.lit("p").alias("project_id"), F.concat(F.lit("s"), c("event_id").cast("string")).alias("session_id"), c("ts").cast("timestamp").alias("at"), c("event_id").alias("pos"),
        F.lit("create").alias("op"), c("user_id").cast("string").alias("instinct_id"), F.lit("t").alias("trigger"), F.lit("f").alias("finding"), F.lit("workflow").alias("domain"),
        F.lit(0.5).alias("initial_confidence"), F.lit(None).cast("string").alias("correction"), F.lit(None).cast("string").alias("into"),
    )
    return instincts.fold(rows).select(c("instinct_id").cast("long").alias("user_id"), F.size("observations").cast("long").alias("n_observations"), F.unix_micros("updated_at").alias("updated_us"))


@query(
    """with d as (select *, case when event_type = 'error' then 'correct' when floor(value) % 97 = 3 then 'deprecate' when event_type = 'signup' then 'create' else 'reinforce' end as op from events),
      f as (select *, min(case when op = 'create' then (ts, event_id) end) over (partition by user_id) as first from d),
      r as (select *, (epoch_us(ts) - epoch_us(first[1])) / 86400000000.0 / 90 as age from f where (ts, event_id) >= first),
      c as (select *, op <> 'deprecate' and not bool_or(op = 'deprecate') over (partition by user_id order by ts, event_id rows unbounded preceding) as offered from r),
      v as (select *, offered and 0.6 + sum(case when offered then case when op = 'correct' then -0.16 else 0.04 end * pow(2, age) else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) * pow(0.5, age) < 0.301 as sinks from c),
      k as (select *, offered and not coalesce(bool_or(sinks) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), false) as accepted from v)
    select user_id, count(*) filter (accepted) as n_observations, bool_or(sinks) or bool_or(op = 'deprecate') as deprecated, coalesce(arg_max(concat('not ', event_id), (ts, event_id)) filter (accepted and op = 'correct'), 'f') as finding,
      epoch_us(max(ts) filter (accepted or op = 'deprecate')) as updated_us from k group by user_id"""
)
def l10_fold_closed(t: Tables) -> DataFrame:
    """Every user's events as deltas that create, reinforce, correct and deprecate one record: all fold in SQL."""
    c = F.col
    op = F.when(c("event_type") == "error", "correct").when(F.floor("value") % 97 == 3, "deprecate").when(c("event_type") == "signup", "create").otherwise("reinforce")
    rows = t.events.select(
        F.lit("p").alias("project_id"), F.concat(F.lit("s"), c("event_id").cast("string")).alias("session_id"), c("ts").cast("timestamp").alias("at"), c("event_id").alias("pos"),
        op.alias("op"), c("user_id").cast("string").alias("instinct_id"), F.lit("t").alias("trigger"), F.lit("f").alias("finding"), F.lit("workflow").alias("domain"),
        F.lit(0.6).alias("initial_confidence"), F.concat(F.lit("not "), c("event_id").cast("string")).alias("correction"), F.lit(None).cast("string").alias("into"),
    )
    out = instincts.fold(rows)
    return out.select(c("instinct_id").cast("long").alias("user_id"), F.size("observations").cast("long").alias("n_observations"), "deprecated", "finding", F.unix_micros("updated_at").alias("updated_us"))


@query()
def l10_fold_deltas(t: Tables) -> DataFrame:
    """All six operations: an error corrects, some events deprecate, revive or merge; a test replays them in plain Python."""
    c = F.col
    n = F.floor("value").cast("long")
    op = F.when(c("event_type") == "error", "correct").when(n % 29 == 3, "deprecate").when(n % 29 == 5, "revive").when((n % 97 == 7), "merge").when(c("event_type") == "signup", "create").otherwise("reinforce")
    rows = t.events.select(
        F.concat(F.lit("p"), (c("user_id") % 7).cast("string")).alias("project_id"), F.concat(F.lit("s"), c("event_id").cast("string")).alias("session_id"), c("ts").cast("timestamp").alias("at"), c("event_id").alias("pos"),
        op.alias("op"), F.concat(F.lit("i"), c("user_id").cast("string")).alias("instinct_id"), F.lit("t").alias("trigger"), F.lit("f").alias("finding"), F.lit("workflow").alias("domain"),
        F.lit(0.7).alias("initial_confidence"), F.concat(F.lit("not "), c("event_id").cast("string")).alias("correction"), F.when(op == "merge", F.concat(F.lit("i"), (c("user_id") + 7).cast("string"))).alias("into"),
    )
    out = instincts.fold(rows)
    return out.select("project_id", "instinct_id", "finding", "deprecated", F.size("observations").cast("long").alias("n_observations"), F.unix_micros("updated_at").alias("updated_us"))


def _pages(t: Tables) -> DataFrame:
    return t.pages.where("url is not null").select(F.col("page_id").alias("instinct_id"), F.regexp_extract("url", r"://[^/]*(/[^?#]*)", 1).alias("path"))


@query(
    """with d as (select doc_id, least(1.0, (cast(contains(lower(text), 'the') as int) + cast(contains(lower(text), 'license') as int) + cast(contains(lower(text), 'nicht') as int)) / 3.0) as score, n_chars, source from documents where text is not null)
    select doc_id, round(score, 6) as score from d where score > 0 order by score desc, n_chars desc, source desc, doc_id limit 25"""
)
def o1_search(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("doc_id").alias("instinct_id"), "text", F.col("n_chars").alias("confidence"), F.col("source").alias("updated_at"))
    out = recall.search(rows, "The license, nicht", limit=25, fields=("text",))
    return out.select(F.col("instinct_id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(
    """with p as (select page_id, regexp_extract(url, '://[^/]*(/[^?#]*)', 1) as path from pages where url is not null), t as (select distinct path as target from p where page_id % 100 = 0),
      s as (select target, page_id, case when path = target then 1.0 when length(regexp_extract(target, '^(.*)/[^/]*$', 1)) > 0 and regexp_extract(target, '^(.*)/[^/]*$', 1) = regexp_extract(path, '^(.*)/[^/]*$', 1) then 0.75
        when length(regexp_extract(target, '([^/]*)$', 1)) > 0 and regexp_extract(target, '([^/]*)$', 1) = regexp_extract(path, '([^/]*)$', 1) then 0.6 else 0 end as score from p, t)
    select target, page_id, cast(max(score) as double) as score from s where score > 0 group by target, page_id"""
)
def j14_for_file(t: Tables) -> DataFrame:
    rows = _pages(t)
    out = recall.for_files(rows, rows.where("instinct_id % 100 = 0").select(F.col("path").alias("target")), ["instinct_id"])
    return out.select("target", F.col("instinct_id").alias("page_id"), "score")


@query(
    """with w as (select *, max(ts) over () as e from events), r as (select event_id, row_number() over (order by ts desc, event_id) as rank from w where ts >= e - interval 7 day order by ts desc, event_id limit 50)
    select event_id, rank, round(1.0 - (rank - 1) / count(*) over (), 6) as score from r"""
)
def w10_recent(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_id").alias("instinct_id"), F.col("ts").cast("timestamp").alias("updated_at"))
    return recall.recent(rows, 7, 50).select(F.col("instinct_id").alias("event_id"), F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("select source, doc_id, used_bytes from (select source, doc_id, cast(sum(strlen(coalesce(text, '')) + 1) over (partition by source order by doc_id rows unbounded preceding) as bigint) as used_bytes from documents) where used_bytes <= 50000")
def w17_byte_budget(t: Tables) -> DataFrame:
    lines = t.documents.select("source", "doc_id", F.coalesce("text", F.lit("")).alias("bullet"))
    return recall.within_bytes(lines, ["source"], "doc_id", "bullet", 50_000).select("source", "doc_id", F.col("used_bytes").cast("long").alias("used_bytes"))


_MARKS = " union all ".join(f"select session_id, {_quoted(r)} as rule_id, {_quoted(c)} as cluster, {_quoted(k)} as kind from s where regexp_matches(text, {_quoted(p)}, 'i')" for r, c, k, p in workflow.MARKERS)
_GUIDANCE = ", ".join(f"({_quoted(r)}, {_quoted(a)}, {_quoted(g)}, {_quoted(t)})" for r, (a, g, t) in workflow.GUIDANCE.items())
_SESSIONS = f"s as (select session_id, string_agg(text, E'\\n' order by line) as text, max(ts) as updated_at from ({overlay.SQL}) group by session_id)"


def _sessions(t: Tables) -> DataFrame:
    rows = t.spark.sql(overlay.SQL.replace("from events", "from {events}"), events=t.events)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x.text), "\n")
    return rows.groupBy("session_id").agg(text.alias("text"), F.max("ts").alias("updated_at"))


@query(
    f"""with {_SESSIONS}, m as ({_MARKS}), e as (select cluster, rule_id, session_id, bool_or(kind = 'contradiction') as against, bool_or(kind in ('correction', 'explicit_preference')) as said from m group by all),
      c as (select cluster, rule_id, count(*) as evidence_count, count(*) filter (against) as contradicting_count, count(*) filter (not against) as supporting_count, bool_or(said) as said from e group by all),
      l as (select *, case when contradicting_count / evidence_count > 0.2 then 'contradicted' when said or evidence_count >= 3 then 'strong' when evidence_count >= 2 then 'medium' else 'weak' end as confidence from c)
    select cluster, rule_id, evidence_count, contradicting_count, supporting_count, confidence, 'keyword' as source_tier, case when confidence = 'weak' then 'none' else g.artifact_kind end as artifact_kind, g.guidance, g.trigger,
      case confidence when 'contradicted' then 'high' when 'weak' then 'medium' else 'low' end as risk,
      case confidence when 'strong' then 'adopt' when 'medium' then 'consider' when 'contradicted' then 'ask' else 'dismiss' end as recommendation,
      concat('wf_', left(sha256(concat(cluster, chr(0), rule_id)), 10)) as candidate_id from l join (values {_GUIDANCE}) g(rule_id, artifact_kind, guidance, trigger) using (rule_id)"""
)
def a15_workflow_mine(t: Tables) -> DataFrame:
    return workflow.candidates(workflow.seeds(_sessions(t)))


def _sentence(text: str, pattern: str) -> str:
    head = f"regexp_extract({text}, {_quoted(f'(?is)^(.*?)(?:{pattern})')}, 1)"
    return f"trim(concat(regexp_extract({head}, '[^.!?\\n]*$'), regexp_extract(substr({text}, length({head}) + 1), '^[^.?!\\n]*[.?!\\n]?')))"


#: The first sentence with a marker that is long enough, of a session's lines, else of all of them joined.
_EXCERPTS = "select rule_id, session_id, case when length(said) <= 200 then said else concat(rtrim(left(said, 199)), '…') end as excerpt from (select rule_id, session_id, arg_min(said, (marker, pos)) as said from (" + " union all ".join(
    f"select {_quoted(r)} as rule_id, session_id, {i} as marker, pos, {_sentence('line', p)} as said from lines where regexp_matches(line, {_quoted(p)}, 'i')" for i, (r, _, _, p) in enumerate(workflow.MARKERS)
) + ") where length(said) >= 20 group by rule_id, session_id)"


@query(
    f"""with {_SESSIONS}, lines as (select session_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from s union all select session_id, replace(text, chr(10), ' '), 1000000 from s), m as (select distinct rule_id, session_id from ({_MARKS})), x as ({_EXCERPTS}),
      r as (select m.rule_id, m.session_id, coalesce(x.excerpt, '') as excerpt, row_number() over (partition by m.rule_id order by x.excerpt is null, s.updated_at desc, m.session_id) as place from m join s using (session_id) left join x using (rule_id, session_id))
    select rule_id, session_id, excerpt, place from r where place <= 10"""
)
def o5_evidence(t: Tables) -> DataFrame:
    rows = spread(stored(_sessions(t), "sessions"))
    return workflow.evidence(workflow.seeds(rows), rows).select("rule_id", "session_id", "excerpt", F.col("place").cast("long").alias("place"))


@query("select event_id from events where event_id % 7 <> 0 and event_type = 'view' and ts >= timestamp '2024-01-20 00:00:00'")
def w11_window(t: Tables) -> DataFrame:
    """Views as sessions of a tool, a seventh of them with a time that is none, ten days before a given day."""
    rows = t.events.select("event_id", F.col("event_type").alias("source_tool"), F.when(F.col("event_id") % 7 == 0, "no time").otherwise(F.col("ts").cast("string")).alias("updated_at"))
    return workflow.in_window(rows, 10, F.lit("2024-01-30 00:00:00").cast("timestamp"), "view").select("event_id")


@query(
    """with d as (select user_id as candidate_id, event_type as decision, event_id, row_number() over (partition by user_id order by event_id desc) as rn from events)
    select candidate_id, decision from d where rn = 1"""
)
def j9_latest_decision(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("candidate_id"), F.col("event_type").alias("decision"), F.lit("").alias("note"), F.col("ts").alias("decided_at"), F.col("event_id").alias("ord"))
    return workflow.latest_decisions(rows).select("candidate_id", "decision")


@query("select count(*) as pending_learnings, count(distinct source) as pending_sessions from documents where doc_id not in (select doc_id from labels)")
def a18_pending_review(t: Tables) -> DataFrame:
    learnings = t.documents.select(F.col("doc_id").alias("learning_id"), F.col("source").alias("session_id"))
    return review.pending_counts(learnings, t.labels.select(F.col("doc_id").alias("learning_id")))


@query(
    """select l.doc_id, case when d.doc_id is null then 'missing' when d.n_chars % 5 = 0 then 'changed' when l.quality <> 1 then 'rejected' when d.lang = 'fr' then 'invalid' else 'applied' end as outcome from labels l left join documents d on d.doc_id = l.doc_id and d.doc_id % 3 <> 0"""
)
def j7_apply_review(t: Tables) -> DataFrame:
    c = F.col
    reviews = t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id", "left").select(
        F.lit("s").alias("session_id"), c("doc_id").alias("learning_id"), F.lit("h").alias("input_hash"), F.when(c("quality") == 1, "keep").otherwise("reject").alias("verdict"), "lang"
    )
    originals = t.documents.where("doc_id % 3 <> 0").select(F.lit("s").alias("session_id"), c("doc_id").alias("learning_id"), F.when(c("n_chars") % 5 == 0, "other").otherwise("h").alias("content_hash"))
    flags = F.when(c("lang") == "fr", F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return review.applied(reviews, originals, flags).select(c("learning_id").alias("doc_id"), "outcome")


@query("select a.doc_id, exists(select 1 from documents b where b.doc_id % 2 = 0 and b.text is not distinct from a.text and b.lang is not distinct from a.lang) as cached from documents a")
def l14_review_cache(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.col("lang").alias("kind"), F.col("text").alias("statement"), F.lit("").alias("title"), F.lit("").alias("trigger"))
    cache = rows.where("doc_id % 2 = 0").select(review.content_hash().alias("cache_key"))
    return review.planned(rows, cache).select("doc_id", "cached")
