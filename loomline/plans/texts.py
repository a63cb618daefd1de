"""Queries of the text functions over documents, pages and benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import identity
from loomline.functions.prompts import atomic, cleaned_statement, no_signal, statement_flags, without_tags
from loomline.functions.text import capped_bytes, excerpt_around, shortened, squeezed
from loomline.operators import review, skills, workflow
from loomline.operators.summaries import low_signal_topic
from loomline.plans.registry import Tables, query

_SQUEEZED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
STOP = "(" + ", ".join(f"'{w}'" for w in identity.STOP_WORDS) + ")"


def words_sql(text: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower({text}), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+'), lambda w: w <> '' and w not in {STOP})"


STEM_SQL = """lambda w: case when length(w) > 4 and w like '%ing' then left(w, -3) when length(w) > 4 and w like '%ed' then left(w, -2)
  when length(w) > 3 and w like '%es' then left(w, -2) when length(w) > 3 and w like '%s' and w not like '%ss' then left(w, -1) else w end"""


def key_sql(text: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter(list_transform({words_sql(text)}, {STEM_SQL}), lambda w: w <> '' and w not in {STOP}))), '-')"


def slug_of(words: str) -> str:
    """A slug from a column of words, which is worth a step of its own: computed within, it would be made anew for each word."""
    return f"array_to_string(list_filter({words}, lambda x, i: i = 1 or x <> {words}[i - 1])[1:8], '-')"


@query(f"select doc_id, case when length({_SQUEEZED}) <= 120 then {_SQUEEZED} else concat(rtrim(left({_SQUEEZED}, 117)), '...') end as short from documents")
def f11_shortened(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", shortened(F.col("text"), 120).alias("short"))


@query(
    """with c as (select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', E'\\n\\n', 'g'), '^\\s+|\\s+$', '', 'g') as t from documents),
      m as (select doc_id, t, greatest(length(regexp_extract(t, '(?is)^(.*?)\\blicen[sc]e', 1)), 0) as i, regexp_matches(t, '(?i)\\blicen[sc]e') as hit from c),
      p as (select doc_id, t, case when hit then i else 0 end as pos from m),
      l as (select *, length(regexp_extract(left(t, pos), '(?s)^(.*\\n)', 1)) as line from p),
      s as (select *, case when pos - line >= 234 then pos - 80 else line end as start from l),
      e as (select *, least(length(t), start + 240 - case when start > 0 then 3 else 0 end) as e0 from s)
    select doc_id, case when length(t) <= 240 then t else concat(case when start > 0 then '...' else '' end,
      regexp_replace(substr(t, start + 1, case when e0 < length(t) then greatest(start, e0 - 3) else e0 end - start), '^\\s+|\\s+$', '', 'g'),
      case when e0 < length(t) then '...' else '' end) end as excerpt from e"""
)
def f9_excerpt(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", excerpt_around(F.col("text"), r"\blicen[sc]e", 240).alias("excerpt"))


@query("select page_id, trim(regexp_replace(regexp_replace(html, '(?i)</?[a-z_:-]+(?:\\s+[^>]*)?>', ' ', 'g'), '\\s+', ' ', 'g')) as plain from pages")
def f12_tag_strip(t: Tables) -> DataFrame:
    return t.pages.select("page_id", squeezed(without_tags(F.col("html"))).alias("plain"))


@query("select item_id, len(regexp_extract_all(text, '[.!?]+(?:\\s|$)')) <= 1 as atomic from benchmark")
def f19_atomic(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", atomic(F.col("text")).alias("atomic"))


@query()
def f14_no_signal(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", no_signal(F.col("text")).alias("no_signal"))


@query()
def f32_low_signal_topic(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", low_signal_topic(F.col("text")).alias("low_signal"))


@query("select doc_id, regexp_replace(regexp_replace(text, '\\b(?:[A-Za-z]:)?/?(?:Users|home)/[^\\s]+', '[local-path]', 'g'), '(?i)\\b[A-Z0-9_]*(?:TOKEN|SECRET|PASSWORD|API_KEY)\\b\\s*[=:]\\s*\\S+', '[secret-ref]', 'g') as redacted from documents")
def f40_redacted(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", workflow.redacted(F.col("text")).alias("redacted"))


@query(
    """with s as (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from documents), cut as (select doc_id, t, list_aggregate(list_filter(range(1, 510), lambda k: strlen(left(t, k)) <= 509), 'max') as k from s)
    select doc_id, case when strlen(t) <= 512 then t else concat(rtrim(left(t, k)), '…') end as capped from cut"""
)
def f15_capped_bytes(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", capped_bytes(F.col("text")).alias("capped"))


@query()
def f16_cleaned_statement(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", cleaned_statement(F.col("text")).alias("statement"))


@query(
    """select item_id, array_to_string(list_filter([case when trim(text) in ('', 'Rejected learning', '__missing_statement__') then 'missing_statement' end,
      case when length(trim(text)) > 180 then 'too_long' end, case when regexp_matches(text, '\\*\\*|(?m:^#+\\s)|\\|\\s*-{2,}\\s*\\|') then 'markdown_residue' end], lambda x: x is not null), ',') as flags from benchmark"""
)
def f18_statement_flags(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.array_join(statement_flags(F.col("text")), ",").alias("flags"))


@query(f"select doc_id, {key_sql("concat(source, ' ', text)")} as key from documents")
def f34_canonical_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", identity.canonical_key(F.col("source"), F.col("text")).alias("key"))


@query(
    f"""with v as (select *, {words_sql("text")} as words from benchmark), s as (select item_id, {slug_of("words")} as slug, left(sha256(concat('when ', item_id, '|', text)), 8) as digest from v),
      w as (select item_id, concat(case when slug = '' then 'instinct' else slug end, '-', digest) as id, digest from s)
    select item_id, case when length(id) <= 80 then id else concat(left(id, 72), '-', digest) end as id from w"""
)
def f35_record_id(t: Tables) -> DataFrame:
    trigger = F.concat(F.lit("when "), F.col("item_id").cast("string"))
    return t.benchmark.select("item_id", identity.record_id(trigger, F.col("text")).alias("id"))


@query(
    """select page_id, left(sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^(?:https?://|git@|ssh://)', ''), '^([^:]*):', '\\1/'), '\\.git$', ''), '/+$', '')), 12) as project_id from pages where url is not null"""
)
def f36_project_id(t: Tables) -> DataFrame:
    return t.pages.where("url is not null").select("page_id", identity.project_id(identity.normal_remote(F.col("url"))).alias("project_id"))


@query(
    f"""with k as (select lower(trim(text)) as e, {key_sql("concat(' ', text)")} as k, source as p from documents), per as (select k, count(distinct e) as e, count(distinct p) as p from k group by k)
    select (select count(distinct e) from k) as exact_ids, count(*) as canonical_keys, cast(count(*) filter (e > 1) as bigint) as mergeable_keys, cast(count(*) filter (p > 1) as bigint) as cross_project_keys from per"""
)
def a24_merge_opportunity(t: Tables) -> DataFrame:
    return review.merge_opportunity(t.documents, F.lower(F.trim("text")), identity.canonical_key(F.lit(""), F.col("text")), "source")


_STATEMENT_KEY = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"


@query(
    f"""select doc_id, case when low then 'low_signal' when rn > 1 then 'duplicate' else 'review' end as verdict from (
      select doc_id, n_chars < 200 as low, row_number() over (partition by {_STATEMENT_KEY}, n_chars < 200 order by source, doc_id) as rn from documents)"""
)
def p14_prefilter(t: Tables) -> DataFrame:
    return review.prefiltered(t.documents, F.col("n_chars") < 200, ["source", "doc_id"], "text").select("doc_id", "verdict")


@query(
    f"""select lang, {_STATEMENT_KEY} as merge_key, max(doc_id) as doc_id, count(*) as n_learnings, count(distinct source) as n_refs,
      array_to_string(list_sort(list_distinct(list(source)))[1:20], ',') as refs from documents group by lang, {_STATEMENT_KEY}"""
)
def w5_knowledge_merge(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang", "text", "source")
    out = review.merged(rows, review.statement_key(F.col("text")), ["lang"], ["doc_id"], refs="source")
    return out.select("lang", "merge_key", "doc_id", "n_learnings", "n_refs", F.array_join("refs", ",").alias("refs"))


@query(
    """with f as (select doc_id, case lang when 'en' then 'what_failed' when 'de' then 'what_was_decided' else 'what_worked' end as field, text as line, source from documents),
      r as (select *, case field when 'what_failed' then 1 when 'what_was_decided' then 2 else 3 end as rank, trim(regexp_replace(lower(line), '\\s+', ' ', 'g')) as k from f)
    select doc_id, field from (select *, min(rank) over (partition by source, k) as best from r) where rank = best"""
)
def o11_without_higher(t: Tables) -> DataFrame:
    field = F.when(F.col("lang") == "en", "what_failed").when(F.col("lang") == "de", "what_was_decided").otherwise("what_worked")
    rows = t.documents.select("doc_id", "source", field.alias("field"), F.col("text").alias("line"))
    return review.without_higher(rows, "source", "field", ["what_failed", "what_was_decided", "what_worked"]).select("doc_id", "field")


@query("select doc_id from (select doc_id, row_number() over (partition by text order by doc_id) as rn from documents) where rn = 1")
def a23_kept_first(t: Tables) -> DataFrame:
    return review.kept_first(t.documents, F.col("text"), ["doc_id"]).select("doc_id")


_SKILL_WORDS = "list_filter(string_split_regex(regexp_replace(lower(line), '[^\\w\\s-]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 4)"
_ITEMS_SQL = f"""select skill_id, item, words, case when len(words) > 0 then array_to_string(words[1:6], ' ') else left(lower(line), 40) end as match_key from (
  select 'the' as skill_id, item, line, {_SKILL_WORDS} as words from (
    select 1000000 * item_id + pos as item, trim(replace(line, '`', '')) as line from (select item_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from benchmark)) where length(line) >= 8)"""
_HIT = "(contains(lower(text), match_key) or (len(words) > 0 and len(list_filter(words, lambda w: contains(lower(text), w))) >= greatest(2, ceil(len(words) * 0.5))))"


def _checklist(t: Tables) -> DataFrame:
    """All lines of every benchmark item as bullets of one skill, numbered by item and line."""
    bullets = t.benchmark.select(F.col("item_id").alias("skill_id"), F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("- "), x)), "\n").alias("markdown"))
    parsed = skills.checklist(bullets)
    return parsed.withColumns({"item": 1_000_000 * F.col("skill_id") + F.col("item"), "skill_id": F.lit("the")})


@query(
    f"""with i as ({_ITEMS_SQL}), n as (select d.doc_id as session_id, count(*) as total, count(*) filter ({_HIT}) as hits from documents d join i on contains(lower(d.text), 'the') group by d.doc_id)
    select 'the' as skill_id, session_id, hits, total, round(0.4 + 0.4 * (hits / total) + 0.2, 3) as score from n"""
)
def a22_skill_adherence(t: Tables) -> DataFrame:
    sessions = t.documents.select(F.col("doc_id").alias("session_id"), "text", F.lit(False).alias("failed"))
    return skills.adherence(sessions, _checklist(t)).select("skill_id", "session_id", F.col("hits").cast("long").alias("hits"), F.col("total").cast("long").alias("total"), "score")


@query(f"with i as ({_ITEMS_SQL}) select i.item, count(*) filter ({_HIT}) as hits, round(count(*) filter ({_HIT}) / count(*), 3) as rate, count(*) filter ({_HIT}) / count(*) < 0.25 as rare from documents d join i on contains(lower(d.text), 'the') group by i.item")
def f41_item_rates(t: Tables) -> DataFrame:
    sessions = t.documents.select(F.col("doc_id").alias("session_id"), "text")
    return skills.item_rates(sessions, _checklist(t)).select("item", "hits", "rate", "rare")


@query(
    f"""with q as (select item_id, string_split({key_sql("concat(' ', text)")}, '-') as tok from benchmark), q2 as (select item_id, list_distinct(list_filter(tok, lambda x: x <> '')) as tok from q),
      d as (select doc_id, list_distinct(list_filter(string_split({key_sql("concat(' ', text)")}, '-'), lambda x: x <> '')) as tok from documents)
    select item_id, min(doc_id) as encoded_in from q2 join d on len(list_intersect(q2.tok, d.tok)) >= 0.6 * len(q2.tok) where len(q2.tok) > 0 group by item_id"""
)
def j10_encoded_overlap(t: Tables) -> DataFrame:
    def tokens(c):
        return F.filter(F.array_distinct(F.split(F.array_join(identity.stems(c), "-"), "-")), lambda x: x != "")

    asked = t.benchmark.select("item_id", tokens(F.col("text")).alias("tokens"))
    known = t.documents.select(F.col("doc_id").alias("known_id"), F.col("doc_id").alias("ord"), tokens(F.col("text")).alias("tokens"))
    return workflow.already_encoded(asked, known, "item_id", "tokens")
