"""Queries of the ledger, audits, costs, budgets and storage over orders, events, documents and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators import audit, costs, ledger, storage
from loomline.plans.registry import Tables, query

c = F.col

# Ledger over orders: a source is an order, its content the status, seen again with what its lines say.
_OLD = "select o_orderkey as k, o_orderstatus as h, 1 as content_revision, case when o_orderkey % 4 = 0 then 'discovered' else 'parsed' end as lifecycle from orders where o_orderdate < timestamp '2000-01-01'"
_NEW = "select o_orderkey as k, case when o_totalprice > 200000 then 'X' else o_orderstatus end as h from orders where o_orderdate >= timestamp '1998-01-01'"
_UPSERT = f"""select coalesce(o.k, n.k) as k, case when n.k is not null then n.h else o.h end as h,
  case when o.k is null then 1 when n.k is not null and n.h <> o.h then 2 else 1 end as content_revision,
  case when o.k is null then 'discovered' when n.k is not null and n.h <> o.h then 'stale' else o.lifecycle end as lifecycle,
  case when o.k is null then 'inserted' when n.k is null then 'unseen' when n.h <> o.h then 'changed' else 'unchanged' end as change
  from ({_OLD}) o full join ({_NEW}) n on o.k = n.k"""


def upserted(t: Tables) -> DataFrame:
    orders = t.orders.withColumn("o_orderdate", c("o_orderdate").cast("timestamp"))
    old = orders.where("o_orderdate < timestamp '2000-01-01'").select(c("o_orderkey").alias("k"), c("o_orderstatus").alias("h"), F.lit(1).alias("content_revision"), F.when(c("o_orderkey") % 4 == 0, "discovered").otherwise("parsed").alias("lifecycle"))
    new = orders.where("o_orderdate >= timestamp '1998-01-01'").select(c("o_orderkey").alias("k"), F.when(c("o_totalprice") > 200000, "X").otherwise(c("o_orderstatus")).alias("h"))
    return ledger.upserted(old, new, ["k"], "h")


@query(f"select k, h, cast(content_revision as bigint) as content_revision, lifecycle, change from ({_UPSERT})")
def l1_upsert(t: Tables) -> DataFrame:
    return upserted(t).withColumn("content_revision", c("content_revision").cast("long"))


@query(f"select k, change from ({_UPSERT}) where change in ('inserted', 'changed') or (change = 'unchanged' and content_revision = 1 and lifecycle = 'discovered')")
def p2_to_process(t: Tables) -> DataFrame:
    return ledger.to_process(upserted(t)).select("k", "change")


_PHASE = "['parsed', 'reduced', 'summarized', 'extracted', 'archived', 'deletion_candidate', 'deleted']"


@query(
    f"""with x as (select user_id, event_id as seq, event_id % 7 + 1 as o, case when event_type in ('view', 'click', 'signup') then 'completed' when event_type = 'error' then 'failed' else 'running' end as state from events),
      l as (select user_id, o, arg_max(state, seq) as state, max(seq) as seq, max(case when state = 'completed' then seq end) as done from x group by user_id, o),
      u as (select *, max(done) over (partition by user_id order by o rows between unbounded preceding and 1 preceding) as up from l)
    select user_id, ({_PHASE})[o] as phase, case when state = 'completed' and coalesce(up, -1) > seq then 'stale' else state end as state, seq from u"""
)
def l3_transitions(t: Tables) -> DataFrame:
    phases = F.array(*map(F.lit, ledger.PHASES))
    state = F.when(c("event_type").isin("view", "click", "signup"), "completed").when(c("event_type") == "error", "failed").otherwise("running")
    rows = t.events.select("user_id", F.get(phases, (c("event_id") % 7).cast("int")).alias("phase"), state.alias("state"), c("event_id").alias("seq"))
    return ledger.phase_states(rows, "user_id")


@query("select event_id, case when event_type = 'view' then 'reduced' when event_type = 'click' then 'stale' else 'error' end as lifecycle from events")
def l4_lifecycle(t: Tables) -> DataFrame:
    state = F.when(c("event_type") == "view", "completed").when(c("event_type") == "click", "stale").otherwise("failed")
    return t.events.select("event_id", ledger.lifecycle(F.lit("reduced"), state).alias("lifecycle"))


@query(
    """with ch as (select o_orderkey as k from orders where o_totalprice > 200000),
      cp as (select l_orderkey as k, cast(l_linenumber as bigint) as n, case when l_linestatus = 'F' then 'completed' else 'failed' end as state from lineitem),
      qu as (select l_orderkey as k, cast(l_linenumber as bigint) as n, case when l_returnflag = 'R' then 'completed' else 'queued' end as state from lineitem where l_quantity > 25),
      dc as (select o_orderkey as k, case when o_orderstatus = 'F' then 'ready' else 'pending_artifacts' end as state, o_orderstatus <> 'O' as safe from orders),
      st as (select k from ch where k in (select k from cp where state = 'completed'))
    select 'session' as kind, k, 0::bigint as n, null as state, case when k in (from st) then 'stale' else 'discovered' end as lifecycle, null as safe from ch
    union all select 'checkpoint', k, n, case when state = 'completed' and k in (from st) then 'stale' else state end, case when state = 'completed' and k in (from st) then 'stale' else 'reduced' end, null from cp
    union all select 'queue', k, n, case when state = 'completed' and k in (from st) then 'stale' else state end, case when k in (from st) then 'stale' else 'extracted' end, null from qu
    union all select 'candidate', k, 0, case when state = 'ready' and k in (from st) then 'stale' else state end, case when k in (from st) then 'stale' else 'deletion_candidate' end, safe and k not in (from st) from dc"""
)
def l2_invalidation(t: Tables) -> DataFrame:
    """Orders are sessions, their lines checkpoints and queue entries: what a change of the expensive ones makes stale."""
    line = t.lineitem.select(c("l_orderkey").alias("k"), c("l_linenumber").cast("long").alias("n"), "l_linestatus", "l_returnflag", "l_quantity")
    checkpoints = line.select("k", "n", F.when(c("l_linestatus") == "F", "completed").otherwise("failed").alias("state"), F.lit("reduced").alias("lifecycle"))
    queue = line.where("l_quantity > 25").select("k", "n", F.when(c("l_returnflag") == "R", "completed").otherwise("queued").alias("state"), F.lit("extracted").alias("lifecycle"))
    state = F.when(c("o_orderstatus") == "F", "ready").otherwise("pending_artifacts")
    candidates = t.orders.select(c("o_orderkey").alias("k"), state.alias("candidate_state"), F.lit("deletion_candidate").alias("lifecycle"), (c("o_orderstatus") != "O").alias("safe_to_delete"))
    changed = t.orders.where("o_totalprice > 200000").select(c("o_orderkey").alias("k"))
    made = ledger.invalidated(changed, checkpoints, queue, candidates, "k")
    zero, no_state, no_flag = F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("state"), F.lit(None).cast("boolean").alias("safe")
    rows = made["sessions"].select(F.lit("session").alias("kind"), "k", zero, no_state, "lifecycle", no_flag)
    for kind, table in (("checkpoint", "checkpoints"), ("queue", "queue")):
        rows = rows.unionByName(made[table].select(F.lit(kind).alias("kind"), "k", "n", "state", "lifecycle", no_flag))
    return rows.unionByName(made["candidates"].select(F.lit("candidate").alias("kind"), "k", zero, c("candidate_state").alias("state"), "lifecycle", c("safe_to_delete").alias("safe")))


@query("select distinct user_id from events where event_type = 'view' and user_id not in (select user_id from events where event_type = 'error' and value > 120)")
def l7_resumable(t: Tables) -> DataFrame:
    wanted = t.events.where("event_type = 'view'").select("user_id").distinct()
    done = t.events.where("event_type = 'error' and value > 120").select("user_id", F.lit("completed").alias("state"))
    return ledger.resumable(done, wanted, ["user_id"])


def _artifacts(t: Tables) -> DataFrame:
    """What has been written for every document, from its id and length."""
    n, i = c("n_chars"), c("doc_id")
    return t.documents.select(
        "doc_id",
        (i % 11 != 0).alias("summary_written"),
        (i % 13 != 0).alias("manifest_written"),
        (i % 17 != 0).alias("receipt_written"),
        (n > 2000).alias("project_learnings_written"),
        (i % 3 == 0).alias("user_learnings_written"),
        (n < 400).alias("low_signal"),
        (n < 300).alias("no_signal"),
    )


_ARTIFACTS = """select doc_id, doc_id % 11 <> 0 as s, doc_id % 13 <> 0 as m, doc_id % 17 <> 0 as r, n_chars > 2000 or doc_id % 3 = 0 as l, n_chars < 400 as low, n_chars < 300 as nosig from documents"""
_RETENTION = f"""select *, s and m and r and (l or (low and nosig)) as safe_to_delete, case when s and m and r and l then 'ready' when s and m and r and low and nosig then 'discardable_no_signal' else 'pending_artifacts' end as candidate_state,
  case when s and m and r and l then 'ready' when s and m and r and low and nosig then 'no_signal' when not s then 'summary_missing' when low then 'summary_low_signal' when not l then 'no_durable_learnings' when not m then 'manifest_missing' when not r then 'receipt_missing' else '' end as code
  from ({_ARTIFACTS})"""


@query(f"select doc_id, safe_to_delete, candidate_state, code from ({_RETENTION})")
def l8_retention(t: Tables) -> DataFrame:
    out = ledger.retention(_artifacts(t))
    code = F.when(c("reason") == ledger.READY_REASON, "ready").otherwise(F.substring_index("reason", ":", 1))
    return out.select("doc_id", "safe_to_delete", "candidate_state", code.alias("code"))


@query(
    f"""select doc_id, case when safe_to_delete then 'ready' else 'blocked' end as status, array_to_string(list_filter([case when not (candidate_state = 'discardable_no_signal' or l) then 'knowledge_jsonl' end,
      case when not m then 'manifest_json' end, case when not r then 'retention_receipt_json' end, case when not s then 'summary_json' end, case when not s then 'summary_markdown' end], lambda x: x is not null), ',') as missing from ({_RETENTION})"""
)
def l9_missing_artifacts(t: Tables) -> DataFrame:
    out = ledger.missing_artifacts(ledger.retention(_artifacts(t)))
    return out.select("doc_id", "status", F.array_join("missing", ",").alias("missing"))


@query("select 'orders' as kind, o_orderstatus as state, count(*) as n from orders group by 2 union all select 'customers', c_mktsegment, count(*) from customer group by 2 union all select 'events', event_type, count(*) from events group by 2")
def a1_status_counts(t: Tables) -> DataFrame:
    return ledger.status_counts({"orders": (t.orders, "o_orderstatus"), "customers": (t.customer, "c_mktsegment"), "events": (t.events, "event_type")})


def _manifests(t: Tables) -> DataFrame:
    """A manifest for every order, by customer."""
    return t.orders.select(
        c("o_custkey").cast("string").alias("session_id"), c("o_orderstatus").alias("source_tool"), c("o_orderpriority").alias("source_path"),
        F.unix_micros(c("o_orderdate").cast("timestamp")).alias("generated_at"), c("o_orderkey").cast("string").alias("manifest_path"),
    )


@query("select cast(o_custkey as varchar) as session_id, count(*) as n, string_agg(o_orderpriority, ',' order by o_orderpriority) as sources from orders group by o_custkey having count(*) > 1")
def a2_duplicate_ids(t: Tables) -> DataFrame:
    return audit.duplicate_ids(_manifests(t))


@query("select cast(o_custkey as varchar) as session_id, count(distinct (o_orderstatus, o_orderpriority)) as identities from orders group by o_custkey having count(distinct (o_orderstatus, o_orderpriority)) > 1")
def a3_shared_identities(t: Tables) -> DataFrame:
    return audit.shared_identities(_manifests(t))


_ORPHANS = "select o_orderkey from orders o where not exists (select 1 from orders p where p.o_orderkey % 3 = 0 and p.o_custkey = o.o_custkey and p.o_orderstatus = o.o_orderstatus and p.o_orderpriority = o.o_orderpriority)"


@query(f"select cast(o_orderkey as varchar) as manifest_path from ({_ORPHANS})")
def j3_orphans(t: Tables) -> DataFrame:
    return audit.orphans(_manifests(t), _manifests(t).where("cast(manifest_path as bigint) % 3 = 0")).select("manifest_path")


@query(
    f"""select 'duplicate_session_id' as code, 'blocking' as severity, count(*) as n from (select o_custkey from orders group by 1 having count(*) > 1)
    union all select 'shared_identity', 'warning', count(*) from (select o_custkey from orders group by 1 having count(distinct (o_orderstatus, o_orderpriority)) > 1)
    union all select 'orphan_manifest', 'blocking', count(*) from ({_ORPHANS})"""
)
def a4_integrity(t: Tables) -> DataFrame:
    m = _manifests(t)
    return audit.integrity(audit.duplicate_ids(m), audit.shared_identities(m), audit.orphans(m, m.where("cast(manifest_path as bigint) % 3 = 0")))


_LATEST = """select * from (select *, row_number() over (partition by o_orderstatus, o_orderpriority, o_custkey order by o_orderdate desc, cast(o_orderkey as varchar) desc) as rn from orders) where rn = 1"""


@query(f"select cast(o_custkey as varchar) as session_id, o_orderstatus as source_tool, o_orderpriority as source_path, cast(o_orderkey as varchar) as manifest_path from ({_LATEST})")
def w3_latest_manifests(t: Tables) -> DataFrame:
    return audit.latest_manifests(_manifests(t)).select("session_id", "source_tool", "source_path", "manifest_path")


_INDEX = f"select cast(o_custkey as varchar) as session_id, o_orderstatus as source_tool, cast(o_orderkey as varchar) as manifest_path, c_name as topic, epoch_us(o_orderdate) as updated_at from ({_LATEST}) join customer on c_custkey = o_custkey where c_mktsegment <> 'BUILDING'"


def _index(t: Tables) -> DataFrame:
    topics = t.customer.select(c("c_custkey").cast("string").alias("session_id"), c("c_name").alias("topic"))
    deleted = t.customer.where("c_mktsegment = 'BUILDING'").select(c("c_custkey").cast("string").alias("session_id"))
    return audit.session_index(_manifests(t), topics, deleted).withColumnRenamed("generated_at", "updated_at")


@query(f"select session_id, source_tool, manifest_path, topic from ({_INDEX})")
def j2_searchable_index(t: Tables) -> DataFrame:
    return _index(t).select("session_id", "source_tool", "manifest_path", "topic")


@query(f"select session_id, manifest_path from (select * from ({_INDEX}) where contains(lower(topic || chr(10) || session_id || chr(10) || source_tool), '#0000001'))")
def p10_session_search(t: Tables) -> DataFrame:
    return audit.search_sessions(_index(t), "#0000001", limit=1_000_000).select("session_id", "manifest_path")


_TEXT = "coalesce(text, '')"
_AUDIT = """select doc_id, source, list_filter([case when d.doc_id % 7 = 0 then 'summary_missing' end, case when d.doc_id % 5 = 0 then 'blocked_deletion' end,
  case when d.doc_id % 7 <> 0 and n_chars < 300 then 'summary_low_signal' end, case when d.doc_id % 7 <> 0 and n_chars >= 300 then 'no_useful_commands' end,
  case when d.doc_id % 7 <> 0 and n_chars >= 300 and d.doc_id % 2 = 1 then 'no_files_of_interest' end,
  case when d.doc_id % 7 <> 0 and n_chars >= 300 and n_chars <= 1000 then 'no_project_learnings' end], lambda x: x is not null) as issues from documents d"""


def _audited(t: Tables) -> DataFrame:
    """Each document as a session: its summary fields follow from its id and length."""
    none = F.array().cast("array<string>")
    signal = c("n_chars") >= 300
    fields = {
        "session_id": c("doc_id"),
        "lifecycle": F.lit("deletion_candidate"),
        "has_summary": c("doc_id") % 7 != 0,
        "invalid_summary": F.lit(False),
        "safe_to_delete": c("doc_id") % 5 != 0,
        "knowledge_written": F.lit(False),
        "topic": F.lit("a topic"),
        "next_step": F.lit(audit.NO_NEXT_STEP),
        "what_worked": F.when(signal, F.array(F.lit("it worked"))).otherwise(none),
        "what_failed": none,
        "what_was_decided": none,
        "useful_commands": none,
        "files_of_interest": F.when(signal & (c("doc_id") % 2 == 0), F.array(F.lit("src/a"))).otherwise(none),
        "project_learnings": F.when(c("n_chars") > 1000, F.array(F.lit("learned"))).otherwise(none),
        "user_learnings": none,
    }
    return audit.issues(t.documents.select("doc_id", "source", *(v.alias(k) for k, v in fields.items())))


@query(f"select issue, count(*) as sessions from (select unnest(issues) as issue from ({_AUDIT})) group by issue")
def a5_issue_counts(t: Tables) -> DataFrame:
    return audit.issue_counts(_audited(t))


@query(f"select issue, sessions from (select issue, count(*) as sessions from (select unnest(issues) as issue from ({_AUDIT})) group by issue) order by sessions desc, issue limit 3")
def a7_recommendations(t: Tables) -> DataFrame:
    return audit.recommended(audit.issue_counts(_audited(t)))


@query(f"select doc_id, cast(len(issues) as bigint) as issue_count from ({_AUDIT}) order by issue_count desc, doc_id limit 10")
def o7_worst_sessions(t: Tables) -> DataFrame:
    return audit.worst(_audited(t)).select("doc_id", c("issue_count").cast("long").alias("issue_count"))


_LEARNED = "select user_id, count(*) filter (event_type = 'view') as n from events group by user_id"


@query(
    f"""select count(*) as sessions_with_learnings, cast(sum(n) as bigint) as total_learnings, max(n) as max_learnings, count(*) filter (n >= 10) as gte_10, count(*) filter (n > 10) as gt_10,
      count(*) filter (n >= 25) as gte_25, count(*) filter (n > 25) as gt_25, count(*) filter (n >= 50) as gte_50, count(*) filter (n > 50) as gt_50,
      quantile_disc(n, 0.5) as p50, quantile_disc(n, 0.75) as p75, quantile_disc(n, 0.9) as p90, quantile_disc(n, 0.95) as p95, quantile_disc(n, 0.99) as p99 from ({_LEARNED}) where n > 0"""
)
def a6_learning_distribution(t: Tables) -> DataFrame:
    return audit.learning_distribution(t.events.groupBy("user_id").agg(F.count_if(c("event_type") == "view").alias("n")))


@query(
    """select source as project_key, count(*) as sessions, count(*) filter (l.doc_id is null) as missing_summaries, count(*) filter (l.doc_id is not null and l.toxic = 1) as llm_rescued_topics,
      count(*) filter (l.doc_id is not null and l.toxic = 0) as deterministic_topics, count(*) filter (l.doc_id is not null and l.quality = 0) as low_signal_topics,
      count(*) filter (l.doc_id is not null and d.lang = 'de') as wrapper_leak_topics, round(count(*) filter (l.doc_id is not null and l.quality = 0) / count(*), 3) as low_signal_rate
    from documents d left join labels l on l.doc_id = d.doc_id group by source"""
)
def a8_topic_distribution(t: Tables) -> DataFrame:
    joined = t.documents.join(t.labels, "doc_id", "left")
    rows = joined.select(
        c("source").alias("project_key"), c("quality").isNotNull().alias("has_summary"), F.lit(False).alias("invalid_summary"), F.when(c("toxic") == 1, "llm").otherwise("deterministic").alias("topic_source"),
        (c("quality") == 0).alias("low_signal"), (c("lang") == "de").alias("wrapper_leak"),
    )
    return audit.topic_distribution(rows)


_CALLS = """select user_id, event_type, case when event_id % 10 <> 3 then value end as cost, event_id % 10 <> 3 as known, event_id % 4 = 0 as hit, case when event_id % 6 = 0 then 10 end as batch, event_id from events"""


def _calls(t: Tables) -> DataFrame:
    i = c("event_id")
    return t.events.select(
        c("user_id").alias("session_id"),
        F.when(c("event_type") == "view", "learning_review").otherwise(c("event_type")).alias("operation"),
        F.when(i % 10 != 3, c("value")).alias("cost"),
        (i % 10 != 3).alias("cost_known"),
        F.when(i % 10 == 3, "unknown").when(i % 2 == 0, "provider").otherwise("upstream").alias("cost_source"),
        (i % 4 == 0).alias("cache_hit"),
        F.when(i % 6 == 0, 10).alias("batch_size"),
        F.floor(c("value")).cast("long").alias("input_tokens"),
        F.when(i % 5 != 0, i % 100).alias("output_tokens"),
        F.when(i % 7 != 0, i).alias("learning_id"),
        c("ts").cast("timestamp").alias("created_at"),
    )


@query(
    f"""with c as ({_CALLS}) select count(*) as calls, count(*) filter (not hit) as real_calls, round(sum(case when not hit then 1.0 / greatest(1, coalesce(batch, 1)) end), 3) as http_calls, count(*) filter (hit) as cache_hits,
      round(count(*) filter (hit) / count(*), 6) as cache_hit_rate, count(*) filter (not hit and not known) as unknown_cost_calls, round(sum(case when known then cost end), 2) as total_cost,
      round(sum(case when known and event_type = 'view' and event_id % 7 <> 0 then cost end) / count(*) filter (known and event_type = 'view' and event_id % 7 <> 0), 4) as cost_per_learning,
      round(avg(case when known then floor(cost) end), 4) as input_tokens_mean, round(avg(case when known and event_id % 5 <> 0 then event_id % 100 end), 4) as output_tokens_mean from c"""
)
def a10_cost_report(t: Tables) -> DataFrame:
    digits = {"http_calls": 3, "total_cost": 2, "cost_per_learning": 4, "input_tokens_mean": 4, "output_tokens_mean": 4}
    return costs.totals(_calls(t)).withColumns({k: F.round(k, d) for k, d in digits.items()})


@query(f"with c as ({_CALLS}), s as (select user_id, sum(cost) as c from c where known group by user_id) select count(*) as sessions, round(avg(c), 3) as mean, round(quantile_cont(c, 0.5), 3) as p50, round(quantile_cont(c, 0.9), 3) as p90, round(max(c), 3) as max from s")
def a10_cost_per_session(t: Tables) -> DataFrame:
    out = costs.per_session(_calls(t))
    return out.select("sessions", *(F.round(k, 3).alias(k) for k in ("mean", "p50", "p90", "max")))


@query(f"with c as ({_CALLS}) select case when event_type = 'view' then 'learning_review' else event_type end as operation, round(sum(cost), 2) as cost from c where known group by 1")
def a10_cost_by_operation(t: Tables) -> DataFrame:
    return costs.by_operation(_calls(t)).withColumn("cost", F.round("cost", 2))


@query("select case when event_id % 10 = 3 then 'unknown' when event_id % 2 = 0 then 'provider' else 'upstream' end as cost_source, count(*) as calls from events group by 1")
def a10_calls_by_source(t: Tables) -> DataFrame:
    return costs.by_cost_source(_calls(t))


@query(
    f"""with c as ({_CALLS}), s as (select c_custkey as session_id, c_mktsegment as source_tool, 1 as pl from customer), k as (select s.source_tool, c.* from c join s on s.session_id = c.user_id),
      own as (select source_tool, count(*) as sessions, cast(sum(pl) as bigint) as project_learnings from s group by 1 union all select 'all', count(*), cast(sum(pl) as bigint) from s),
      tel as (select source_tool, count(*) as calls, count(*) filter (not hit) as real_calls, count(*) filter (hit) as cache_hits, count(*) filter (not hit and not known) as unknown_cost_calls, round(sum(case when known then cost end), 2) as total_cost from k group by 1
        union all select 'all', count(*), count(*) filter (not hit), count(*) filter (hit), count(*) filter (not hit and not known), round(sum(case when known then cost end), 2) from c)
    select own.*, coalesce(calls, 0) as calls, coalesce(real_calls, 0) as real_calls, coalesce(cache_hits, 0) as cache_hits, coalesce(unknown_cost_calls, 0) as unknown_cost_calls, coalesce(total_cost, 0) as total_cost from own left join tel using (source_tool)"""
)
def a9_harness_breakdown(t: Tables) -> DataFrame:
    sessions = t.customer.select(c("c_custkey").alias("session_id"), c("c_mktsegment").alias("source_tool"), F.lit(1).cast("long").alias("project_learnings"))
    return audit.by_tool(sessions, _calls(t)).withColumn("total_cost", F.round("total_cost", 2))


@query(
    """select event_id, used, greatest(0.0, 10.0 - used) as remaining, used < 10 as allowed from (select event_id, cast(count(*) over (partition by user_id order by epoch_us(ts) range between 259200000000 preceding and current row) as double) as used from events)"""
)
def w8_count_budget(t: Tables) -> DataFrame:
    uses = t.events.select("event_id", "user_id", c("ts").cast("timestamp").alias("at"))
    return costs.trailing(uses, "10/72h", "at", by=["user_id"]).select("event_id", "used", "remaining", "allowed")


@query(
    """with u as (select event_id, coalesce(sum(case when event_id % 10 <> 3 then value end) over (partition by user_id order by epoch_us(ts) range between 259200000000 preceding and current row), 0.0) as used from events)
    select event_id, round(used, 3) as used, used < 300.5003 as allowed from u"""
)
def w9_usd_budget(t: Tables) -> DataFrame:
    uses = t.events.select("event_id", "user_id", "value", c("ts").cast("timestamp").alias("at"))
    out = costs.trailing(uses, "300.5003/72h", "at", amount=F.when(c("event_id") % 10 != 3, c("value")), by=["user_id"])
    return out.select("event_id", F.round("used", 3).alias("used"), "allowed")


@query("select cast(count(*) as double) as used, count(*) filter (event_id % 10 = 3) as excluded, round(sum(case when event_id % 10 <> 3 then value end), 2) as spent from events where ts >= timestamp '2024-01-29 00:00:00'")
def m6_budget_now(t: Tables) -> DataFrame:
    uses = t.events.select("event_id", c("ts").cast("timestamp").alias("at"), F.when(c("event_id") % 10 != 3, c("value")).alias("cost"))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    money = costs.budget(uses, "100000/48h", "at", now, c("cost")).select(F.round("used", 2).alias("spent"), "excluded")
    return costs.budget(uses, "1000000/48h", "at", now).select("used").join(money)


@query(
    """with m as (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as place, count(*) over (partition by o_custkey) as size from orders)
    select o_orderkey, 1000 // size + case when place <= 1000 - (1000 // size) * size then 1 else 0 end as part from m"""
)
def w18_split_evenly(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", F.lit(1000).cast("long").alias("total"))
    return costs.split_evenly(rows, "total", ["o_custkey"], "o_orderkey").select("o_orderkey", "part")


@query("select event_id, (row_number() over (partition by user_id order by event_id) - 1) // 10 as batch from events")
def w19_batches(t: Tables) -> DataFrame:
    return costs.chunked(t.events, "event_id", ["user_id"]).select("event_id", "batch")


@query("select event_id, case when value > 50 then value when event_id % 2 = 0 then value / 2 when event_id % 3 = 0 then 0.0 end as cost, case when value > 50 then 'provider' when event_id % 2 = 0 then 'upstream' when event_id % 3 = 0 then 'zero' else 'unknown' end as cost_source from events")
def f46_effective_cost(t: Tables) -> DataFrame:
    own = F.when(c("value") > 50, c("value")).otherwise(0.0)
    upstream = F.when(c("event_id") % 2 == 0, c("value") / 2)
    found = costs.effective_cost(own, upstream, c("event_id") % 3 != 0)
    return t.events.select("event_id", found.alias("e")).select("event_id", "e.cost", "e.cost_source")


@query("select source as kind, lang, cast(sum(n_chars) as bigint) as bytes, count(*) as n, min(doc_id) as oldest, max(doc_id) as newest from documents group by all")
def a16_inventory(t: Tables) -> DataFrame:
    files = t.documents.select(c("source").alias("kind"), "lang", c("n_chars").alias("bytes"), c("doc_id").alias("modified_at"))
    return storage.inventory(files, ["kind", "lang"])


@query("select source as folder, count(*) as n, cast(sum(n_chars) as bigint) as bytes, max(n_chars) as largest, round(avg(n_chars), 4) as mean from documents group by source")
def a25_directory_sizes(t: Tables) -> DataFrame:
    return storage.directory_sizes(t.documents.select(c("source").alias("folder"), c("n_chars").alias("bytes"))).withColumn("mean", F.round("mean", 4))


@query(
    """with f as (select event_id, ts, cast(floor(value * 100) as bigint) as b from events), l as (select *, coalesce(sum(b) over (order by ts, cast(event_id as varchar) rows between unbounded preceding and 1 preceding), 0) as before, sum(b) over () as total from f where ts >= timestamp '2024-01-05')
    select cast(event_id as varchar) as path, b as bytes, 'age' as reason from f where ts < timestamp '2024-01-05' union all select cast(event_id as varchar), b, 'size' from l where before < total - 20000000"""
)
def w14_cleanup(t: Tables) -> DataFrame:
    files = t.events.select(c("event_id").cast("string").alias("path"), F.floor(c("value") * 100).cast("long").alias("bytes"), c("ts").cast("timestamp").alias("modified_at"))
    return storage.cleanup(files, F.lit("2024-01-05").cast("timestamp"), 20_000_000)


@query("select doc_id from (select doc_id, row_number() over (partition by source order by n_chars desc, doc_id) as place from documents) where place > 5")
def w15_beyond_newest(t: Tables) -> DataFrame:
    return storage.beyond_newest(t.documents, ["source"], [F.desc("n_chars"), c("doc_id")], 5).select("doc_id")


@query("select doc_id as path, case when lang in ('en', 'fr') then 'pending' else 'ordinary' end as origin from documents")
def o14_merged_candidates(t: Tables) -> DataFrame:
    pending = t.documents.where("lang in ('en', 'fr')").select(c("doc_id").alias("path"), F.lit("pending").alias("origin"))
    ordinary = t.documents.where("lang is null or lang <> 'fr'").select(c("doc_id").alias("path"), F.lit("ordinary").alias("origin"))
    return storage.merged_candidates(pending, ordinary)


@query(
    """with f as (select user_id, count(*) filter (event_type = 'error' and value > 60) as blocking, count(*) filter (event_type = 'view' and value > 60) as pending_reviews, count(*) filter (event_type = 'click' and value > 60) as stale, sum(case when event_type = 'signup' and value > 60 then 1 else 0 end) as bytes from events group by user_id)
    select user_id, blocking, stale, pending_reviews, array_to_string(list_filter([case when blocking > 0 then 'integrity' end, case when pending_reviews > 0 then 'pending_reviews' end, case when stale > 0 then 'stale_sessions' end, case when bytes > 0 then 'reclaimable_storage' end], lambda x: x is not null), ',') as reasons,
      case when blocking > 0 then 'check' when stale > 0 then 'ingest sync' when pending_reviews > 0 then 'quality review-learnings' when bytes > 0 then 'storage cleanup-parsed' else 'none' end as next_action, blocking = 0 and stale = 0 and pending_reviews = 0 and bytes = 0 as healthy from f"""
)
def a27_health(t: Tables) -> DataFrame:
    """Every user's large events stand for what a check of their sessions counts."""
    large = c("value") > 60
    facts = t.events.groupBy("user_id").agg(*(F.count_if((c("event_type") == e) & large).alias(n) for e, n in (("error", "blocking"), ("view", "pending_reviews"), ("click", "stale"), ("signup", "reclaimable_bytes"))))
    return audit.health(facts).select("user_id", "blocking", "stale", "pending_reviews", F.array_join("reasons", ",").alias("reasons"), "next_action", "healthy")
