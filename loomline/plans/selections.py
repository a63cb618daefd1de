"""Queries that choose: look-ups, re-run plans, worktrees, path rules, deletion plans, retention, pruned payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import prompts
from loomline.functions.identity import project_id
from loomline.operators import selection, snapshots
from loomline.plans import overlay
from loomline.plans.registry import Tables, query
from loomline.plans.sessions import _quoted

c = F.col


def text_of(x: Column) -> Column:
    return x.cast("string")


@query("select o_orderkey from orders where o_orderstatus in ('F', 'P')")
def p7_by_lifecycle(t: Tables) -> DataFrame:
    rows = t.orders.select(c("o_orderkey").alias("id"), c("o_orderstatus").alias("lifecycle"), c("o_orderdate").alias("updated_at"))
    return selection.by_lifecycle(rows, ["F", "P"]).select(c("id").alias("o_orderkey"))


@query("select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1")
def p8_latest(t: Tables) -> DataFrame:
    return selection.latest_of(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


_LINES = "len(list_filter(string_split_regex(coalesce(text, ''), '\\r?\\n'), lambda x: regexp_matches(x, '\\S')))"


@query(f"select l.doc_id, coalesce({_LINES}, 0) as learnings from labels l left join documents d on d.doc_id = l.doc_id and d.lang <> 'fr'")
def a29_learning_counts(t: Tables) -> DataFrame:
    files = t.documents.where("lang <> 'fr'").select(c("doc_id").alias("session_id"), "text")
    return snapshots.learning_counts(t.labels.select(c("doc_id").alias("session_id")), files).select(c("session_id").alias("doc_id"), "learnings")


_STATES = "case doc_id % 5 when 0 then 'archived' when 1 then 'extracted' when 2 then 'summarized' when 3 then 'deletion_candidate' else 'parsed' end"


@query(
    f"""with d as (select doc_id, {_STATES} as lifecycle, n_chars, {_LINES} as n from documents where lang in ('en', 'de') and doc_id in (select doc_id from labels))
    select doc_id, case when doc_id % 11 = 0 or n_chars >= 1500 then 'high_signal_topic' when n <= 3 then 'not_over_extracted' when doc_id % 13 = 0 then 'missing_manifest' else 'process' end as outcome from d where lifecycle <> 'parsed'"""
)
def p15_resummarize(t: Tables) -> DataFrame:
    """Labelled documents in two languages as sessions; the languages stand for projects."""
    docs = t.documents.withColumnRenamed("doc_id", "session_id")
    i = c("session_id")
    state = F.when(i % 5 == 0, "archived").when(i % 5 == 1, "extracted").when(i % 5 == 2, "summarized").when(i % 5 == 3, "deletion_candidate").otherwise("parsed")
    rows = snapshots.learning_counts(docs.select("session_id", "lang", "n_chars"), docs.select("session_id", "text")).select(
        "session_id", c("lang").alias("project_key"), state.alias("lifecycle"), i.alias("updated_at"), i.alias("id"), F.when(i % 11 != 0, "t").alias("topic"),
        (c("n_chars") < 1500).alias("low_signal_topic"), F.lit(False).alias("harness_topic"), "learnings", (i % 13 != 0).alias("has_manifest"),
    )
    projects = t.documents.where("lang in ('en', 'de')").select(c("lang").alias("project_key"))
    wanted = t.labels.select(c("doc_id").alias("session_id"))
    return selection.resummarize_plan(rows, wanted, projects, topics="low_signal", most_learnings=3).withColumnRenamed("session_id", "doc_id")


@query("select doc_id, case when doc_id in (select doc_id from labels) then 'candidate' else 'locked' end as outcome from documents")
def p16_rereduce(t: Tables) -> DataFrame:
    return selection.rereduce_plan(t.documents.select(c("doc_id").alias("session_id")), t.labels.select(c("doc_id").alias("session_id"))).withColumnRenamed("session_id", "doc_id")


@query(
    f"select distinct session_id from ({overlay.SQL}) where regexp_matches(text, {_quoted(prompts.PROCESS_START)}, 'i') and not regexp_matches(text, {_quoted(prompts.DURABLE_OUTCOME)}, 'i')"
)
def p16_chatter(t: Tables) -> DataFrame:
    """Sessions of the overlay: messages to the user stand for what worked, results for what failed."""
    rows = t.spark.sql(overlay.SQL.replace("from events", "from {events}"), events=t.events)

    def texts(*kinds: str) -> Column:
        return F.collect_list(F.when(c("kind").isin(*kinds), c("text")))

    own = rows.groupBy("session_id").agg(texts("assistant_message").alias("what_worked"), texts("tool_result_stub").alias("what_failed"), texts("tool_use_stub").alias("what_was_decided"), texts("user_message").alias("user_learnings"))
    empty = F.array().cast("array<string>")
    return selection.with_chatter(own.withColumns({"topic": F.lit(None).cast("string"), "next_step": F.lit(None).cast("string"), "project_learnings": empty}))


_NOW = "timestamp '1998-01-01 00:00:00'"


@query(
    f"""with w as (select concat('/w/', o_orderkey) as path, concat('h', o_orderkey) as head, o_orderkey % 4 = 0 as detached, o_orderkey % 5 < 3 as dirty, o_totalprice > 250000 as merged,
        case when o_orderkey % 5 < 2 then case when o_orderkey % 2 = 0 then {_NOW} - interval 1 hour else cast(o_orderdate as timestamp) end end as dirty_at,
        case o_orderkey % 4 when 1 then concat('td-', o_custkey, '-fix') when 2 then 'main' when 3 then concat('feature/TD-', o_custkey) end as branch, o_custkey from orders),
      j as (select w.*, 'TD-' || c_custkey as task_id, case when c_mktsegment = 'BUILDING' then 'closed' else 'open' end as status from w left join customer on c_custkey = o_custkey and (branch like 'td-%' or branch like 'feature/%')),
      k as (select *, case when detached or task_id is null or (dirty and dirty_at is null) then 'unknown' when dirty and dirty_at > {_NOW} - interval 2 hour then 'dirty-active' when dirty then 'dirty-stale' when merged or status = 'closed' then 'merged' else 'clean-current' end as classification from j)
    select path, branch, detached, task_id, classification, concat(case when classification in ('dirty-stale', 'merged') then concat('td show ', task_id, ' && ') else '' end, 'git -C "', path, '" status --short') as next_command from k"""
)
def p17_worktrees(t: Tables) -> DataFrame:
    """Every customer's orders as a porcelain listing of worktrees, parsed, joined with tasks and classified."""
    k = c("o_orderkey")
    branch = F.when(k % 4 == 0, "detached").when(k % 4 == 1, F.concat(F.lit("branch refs/heads/td-"), text_of(c("o_custkey")), F.lit("-fix"))).when(k % 4 == 2, "branch refs/heads/main")
    branch = branch.otherwise(F.concat(F.lit("branch refs/heads/feature/TD-"), text_of(c("o_custkey"))))
    block = F.concat(F.lit("worktree /w/"), text_of(k), F.lit("\nHEAD h"), text_of(k), F.lit("\n"), branch)
    listings = t.orders.groupBy("o_custkey").agg(F.array_join(F.collect_list(block), "\n\n").alias("text")).select("text")
    now = F.lit("1998-01-01 00:00:00").cast("timestamp")
    at = F.when(k % 5 < 2, F.when(k % 2 == 0, now - F.expr("interval 1 hour")).otherwise(c("o_orderdate").cast("timestamp")))
    facts = t.orders.select(F.concat(F.lit("/w/"), text_of(k)).alias("path"), (k % 5 < 3).alias("dirty"), (c("o_totalprice") > 250000).alias("merged"), at.alias("dirty_at"))
    tasks = t.customer.select(F.concat(F.lit("TD-"), text_of(c("c_custkey"))).alias("id"), F.when(c("c_mktsegment") == "BUILDING", "closed").otherwise("open").alias("status"))
    rows = selection.with_tasks(selection.worktrees(listings), tasks).join(facts, "path")
    return rows.select("path", "branch", "detached", "task_id", *selection.worktree_class(now))


_PATHS = "case page_id % 10 when 0 then 'MEMORY.md' when 1 then concat('./', page_id, '.md') when 2 then concat('../notes/', page_id) when 3 then concat('notes/', page_id, '.md') when 4 then 'notes/.hidden' when 5 then '/MEMORY.md' when 6 then 'notes/../MEMORY.md' when 7 then concat('notes//a/', page_id) when 8 then './notes//x' else 'notes/x/' end"


@query(
    f"""with p as (select page_id, {_PATHS} as path from pages), n as (select *, regexp_replace(regexp_replace(regexp_replace(path, '/+', '/', 'g'), '[^/.]+/\\.\\./', ''), '^\\./', '') as flat from p)
    select page_id, flat not like '/%' and (flat in ('manifest.json', 'MEMORY.md', 'workflow.md', 'tooling.md', 'preferences.md', 'pitfalls.md', 'debugging.md') or regexp_matches(flat, '^notes/[^./][^/]*$')) as allowed,
      case when flat like '/%' or flat like '../%' then null else flat end as flat from n"""
)
def p19_allowed_pages(t: Tables) -> DataFrame:
    rows = t.pages.selectExpr("page_id", f"{_PATHS} as path")
    return rows.select("page_id", selection.allowed_page(c("path"), "notes", "manifest.json").alias("allowed"), selection.normal_path(c("path")).alias("flat"))


@query("select page_id, trim(regexp_replace(regexp_replace(regexp_replace(url, '[\\\\/]+', '', 'g'), '\\.\\.+', '', 'g'), '^\\.+', '')) as folder from pages")
def p19_folder_names(t: Tables) -> DataFrame:
    return t.pages.select("page_id", selection.folder_name(c("url")).alias("folder"))


#: An order is a session with a candidate; its parts of the date and price say what is on disk.
_FACTS = """select o_orderkey as k, o_custkey % 3 = 0 as own, case o_orderstatus when 'F' then 'ready' when 'O' then 'applied' else 'pending' end as state, o_orderkey % 2 = 0 as safe,
  case when o_orderkey % 7 = 0 then 'missing' when o_orderkey % 11 = 0 then 'blocked' else 'found' end as location, o_orderkey % 13 in (1, 2, 3, 4) as archive, o_orderkey % 13 in (2, 3, 4, 5) as receipt,
  o_orderkey % 17 <> 0 as valid, o_custkey % 19 <> 0 as same, o_custkey % 23 <> 0 as intact, o_orderkey % 5 <> 0 as unchanged from orders"""


@query(
    f"""with f as ({_FACTS}), r as (select k, case when not (state = 'applied' or (state = 'ready' and safe)) then 'state' when location = 'blocked' then 'location' when (archive or receipt) and not (archive and receipt) then 'half'
        when archive and not valid then 'receipt' when archive and not same then 'other' when archive and not intact then 'archive' when not (archive or receipt) and location <> 'missing' and not unchanged then 'changed' end as why, archive or receipt as held, location from f where own)
    select k as session_id, case when why is not null then 'blocked' when held then 'already_archived' when location = 'missing' then 'missing' else 'archivable' end as status,
      case why when 'state' then 'Candidate is not in a safe ready or legacy-applied state.' when 'location' then 'no such folder' when 'half' then 'Archive collision: both the gzip artifact and receipt must exist together.'
        when 'receipt' then 'Archive collision: the existing receipt is invalid.' when 'other' then 'Archive collision: the existing receipt does not match the source session.' when 'archive' then 'Archive collision: the gzip artifact does not match the recorded source hash.'
        when 'changed' then 'Source hash mismatch: the current bytes do not match the ledger hash.' else case when not held and location = 'missing' then 'no such folder' end end as reason from r"""
)
def p20_deletion_plan(t: Tables) -> DataFrame:
    f = t.spark.sql(_FACTS.replace("from orders", "from {orders}"), orders=t.orders)
    candidates = f.select(c("k").alias("session_id"), c("k").alias("source_session_id"), c("state").alias("candidate_state"), c("safe").alias("safe_to_delete"))
    sessions = f.select(c("k").alias("source_session_id"), F.when(c("own"), "one").otherwise("other").alias("source_tool"), F.lit("h").alias("source_hash"))
    facts = f.select(
        c("k").alias("session_id"), "location", F.when(c("location") != "found", "no such folder").alias("location_reason"), F.when(c("unchanged"), "h").otherwise("x").alias("current_hash"),
        c("archive").alias("archive_exists"), c("receipt").alias("receipt_exists"), c("valid").alias("receipt_valid"), F.when(c("same"), c("k")).otherwise(-c("k")).alias("receipt_session_id"),
        F.lit("h").alias("receipt_hash"), F.lit("one").alias("receipt_tool"), F.lit("a").alias("receipt_archive_hash"), F.lit("a").alias("archive_hash"), F.when(c("intact"), "h").otherwise("x").alias("unpacked_hash"),
    )
    return selection.deletion_plan(candidates, sessions, facts, "one")


@query("select o_orderkey as source_session_id, 'applied' as candidate_state, 'deleted' as phase, 'completed' as state, o_orderstatus as source_hash from orders where o_totalprice > 300000")
def k14_tombstones(t: Tables) -> DataFrame:
    rows = t.orders.where("o_totalprice > 300000").select(text_of(c("o_orderkey")).alias("session_id"), c("o_orderkey").alias("source_session_id"), c("o_orderstatus").alias("source_hash"), c("o_orderpriority").alias("reason"))
    return selection.tombstones(rows, F.current_timestamp())[1]


@query("select doc_id from documents where lang = 'en' and contains(lower(concat_ws(chr(10), cast(doc_id as varchar), coalesce(text, ''), '', coalesce(source, ''), '')), 'license')")
def p21_shown(t: Tables) -> DataFrame:
    rows = t.documents.select(text_of(c("doc_id")).alias("session_id"), c("text").alias("topic"), F.lit("").alias("next_step"), c("source").alias("lifecycle"), F.lit("").alias("summary_topic"), c("lang").alias("source_tool"), F.array().cast("array<string>").alias("issues"))
    return selection.shown(rows, tool="en", needle=" License ").select(c("session_id").cast("long").alias("doc_id"))


@query(
    """with s as (select o_custkey as session_id, max(o_orderkey) as id, arg_max(o_orderstatus, o_orderkey) as lifecycle from orders group by 1),
      k as (select l_orderkey as id, arg_max(l_linestatus, (l_shipdate, l_linenumber)) as candidate_state from lineitem group by 1)
    select event_id, coalesce(s.lifecycle, 'unknown') as lifecycle, k.candidate_state from events e left join s on s.session_id = e.user_id left join k on k.id = s.id"""
)
def j15_inventory(t: Tables) -> DataFrame:
    files = t.events.select("event_id", c("user_id").alias("session_id"))
    sessions = t.orders.select(c("o_custkey").alias("session_id"), c("o_orderkey").alias("id"), c("o_orderstatus").alias("lifecycle"))
    # Lines of an order may share date and number; of these the first of the file stands, as with SQL on one thread.
    place = F.struct("l_linenumber", -c("_metadata.row_index"))
    candidates = t.lineitem.select(c("l_orderkey").alias("source_session_id"), c("l_shipdate").alias("updated_at"), place.alias("id"), c("l_linestatus").alias("candidate_state"))
    return selection.inventoried(files, sessions, candidates).select("event_id", "lifecycle", "candidate_state")


@query(
    """with i as (select o_orderkey, list_filter([case when o_totalprice > 200000 then 'large' end, case when o_orderstatus = 'P' then 'partial' end], lambda x: x is not null) as issues from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING'))
    select o_orderkey, len(issues) as issue_count, array_to_string(issues, ',') as issues from i where len(issues) > 0"""
)
def j16_dashboard_issues(t: Tables) -> DataFrame:
    found = F.array_compact(F.array(F.when(c("o_totalprice") > 200000, "large"), F.when(c("o_orderstatus") == "P", "partial")))
    wanted = t.orders.join(t.customer.where("c_mktsegment = 'BUILDING'").select(c("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select(c("o_orderkey").alias("session_id"))
    out = selection.dashboard_issues(wanted, t.orders.select(c("o_orderkey").alias("session_id"), found.alias("issues")))
    return out.select(c("session_id").alias("o_orderkey"), c("issue_count").cast("long").alias("issue_count"), F.array_join("issues", ",").alias("issues"))


_KEYS = "select distinct source as key from documents where source is not null union select n_name from nation union select left(sha256(cast(c_custkey as varchar)), 12) from customer"
_SPACES = "select source as key, case when doc_id % 3 = 0 then concat('/w/', lang, '/', doc_id % 7) when doc_id % 3 = 1 then ' ' end as workspace, doc_id as ord from documents where source is not null"


def _key_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    sha = F.substring(F.sha2(text_of(c("c_custkey")).cast("binary"), 256), 1, 12)
    keys = t.documents.where("source is not null").select(c("source").alias("key")).union(t.nation.select("n_name")).union(t.customer.select(sha)).distinct()
    return keys, t.spark.sql(_SPACES.replace("from documents", "from {documents}"), documents=t.documents)


@query(
    f"""with s as ({_SPACES}), f as (select key, left(sha256(arg_min(workspace, ord)), 12) as id from s where length(trim(workspace)) > 0 group by key)
    select k.key, coalesce(f.id, case when regexp_matches(k.key, '^[0-9a-f]{{12}}$') then k.key end, left(sha256(k.key), 12)) as project_id from ({_KEYS}) k left join f using (key)"""
)
def j18_project_of_keys(t: Tables) -> DataFrame:
    keys, sessions = _key_tables(t)
    return selection.project_of_keys(keys, sessions, project_id(c("workspace")), project_id(c("key")))


@query(
    f"""with s as ({_SPACES}), f as (select key as old_key, arg_min(left(sha256(coalesce(workspace, '-')), 12), ord) as new_id from s group by key)
    select old_key, new_id from f union all select key, left(sha256(key), 12) from ({_KEYS}) where not regexp_matches(key, '^[0-9a-f]{{12}}$') and key not in (select old_key from f) and key not in (select new_id from f)"""
)
def j18_key_migration(t: Tables) -> DataFrame:
    keys, sessions = _key_tables(t)
    out = selection.key_migration(sessions, keys.withColumnRenamed("key", "name"), project_id(F.coalesce("workspace", F.lit("-"))), project_id(c("key")))
    return out.select("old_key", "new_id")


@query(
    """with r as (select o_orderkey as path, case when o_orderkey % 3 = 0 then concat('archive-', o_custkey, '.json') when o_orderkey % 3 = 1 then concat('archive-', o_custkey, '.md') else concat('audit-', o_custkey, '.json') end as name, o_orderdate as day from orders),
      own as (select path, day, regexp_extract(name, '^archive-(.+)\\.(json|md)$', 1) as s from r where name like 'archive-%'), done as (select own.* from own join customer on cast(c_custkey as varchar) = s where c_mktsegment in ('BUILDING', 'MACHINERY')),
      kept as (select s from (select s, max(day) as day from done group by s) order by day desc, s limit 20)
    select path, 'terminal_history' as reason from done where s not in (select s from kept)"""
)
def j19_redundant_reports(t: Tables) -> DataFrame:
    k, cust = c("o_orderkey"), text_of(c("o_custkey"))
    name = F.when(k % 3 == 0, F.concat(F.lit("archive-"), cust, F.lit(".json"))).when(k % 3 == 1, F.concat(F.lit("archive-"), cust, F.lit(".md"))).otherwise(F.concat(F.lit("audit-"), cust, F.lit(".json")))
    reports = t.orders.select(k.alias("path"), name.alias("name"), c("o_orderdate").alias("modified_at"))
    state = F.when(c("c_mktsegment") == "BUILDING", "archived").when(c("c_mktsegment") == "MACHINERY", "deleted").otherwise("parsed")
    return selection.redundant_reports(reports, t.customer.select(text_of(c("c_custkey")).alias("session_id"), state.alias("lifecycle")), 20)


@query(
    """with l as (select user_id, arg_max(event_type, event_id) as status from events group by user_id), b as (select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) as n from customer where c_custkey in (select user_id from l where status in ('view', 'click')))
    select c_custkey as path, 'applied_history' as reason from b where n > 2"""
)
def j19_redundant_batches(t: Tables) -> DataFrame:
    batches = t.customer.select(c("c_custkey").alias("batch_id"), c("c_custkey").alias("path"), c("c_acctbal").alias("created_at"))
    applications = t.events.select(c("user_id").alias("batch_id"), F.when(c("event_type").isin("view", "click"), "applied").otherwise("failed").alias("status"), c("event_id").alias("ord"))
    return selection.redundant_batches(batches, applications, 2)


_RAW = """concat('{"type":"page","id":', page_id, ',"url":"', url, '"', case when page_id % 3 = 0 then ',"a":{"b":1}' else '' end, case when page_id % 2 = 0 then ',"k1":1,"k2":2,"k3":3,"k4":4,"k5":5,"k6":6,"k7":7' else '' end, '}')"""


@query(
    f"""with r as (select page_id, {_RAW} as raw, trim(regexp_replace(regexp_replace(html, '\\s+', ' ', 'g'), '[ ]+', ' ', 'g')) as flat from pages where url is not null), k as (select *, list_sort(json_keys(raw)) as keys from r)
    select page_id, length(raw) as approximate_bytes, page_id % 3 = 0 as has_nested_content, cast(len(keys) as int) as key_count, array_to_string(keys[1:8], ',') as kept_keys, cast(greatest(0, len(keys) - 8) as int) as omitted_key_count,
      case when length(flat) <= 200 then flat else concat(left(flat, 197), '...') end as message_excerpt from k"""
)
def p6_pruned(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = t.pages.where("url is not null").selectExpr("*", f"{_RAW} as raw").select(
        "page_id", "raw", c("page_id").alias("line"), F.lit("event").alias("kind"), none.alias("raw_type"), none.alias("ts"), F.lit(False).alias("redacted"), c("html").alias("text"),
        F.array("url").alias("files"), F.array("url").alias("commands"), none.alias("tool_name"), none.alias("call_id"), none.alias("input_text"), none.alias("status"),
    )
    stub = "payload.raw_payload_stub"
    return selection.pruned(rows).select(
        "page_id", c(f"{stub}.approximate_bytes").cast("long").alias("approximate_bytes"), f"{stub}.has_nested_content", f"{stub}.key_count", F.array_join(f"{stub}.kept_keys", ",").alias("kept_keys"), f"{stub}.omitted_key_count", "payload.message_excerpt"
    )
