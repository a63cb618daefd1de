"""The registered queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import (
    bpe,
    divergence,
    embedding_dedup,
    fill_in_middle,
    language_id,
    line_dedup,
    minhash,
    mixing,
    quality_classifier,
    quality_rules,
    secrets,
    token_files,
    url_filter,
)
from loomline.llm.common import LOWER, UPPER, new_path, spread

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(read) if name == "documents" else read


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written as coded shards and read back."""
    path = new_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    docs = token_files.read(spark, path).select("part", "segment", "position", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    starts = token_files.read_segments(spark, path).select("part", "segment", F.col("start").alias("of_segment"))
    return docs.join(starts, ["part", "segment"]).select("doc_id", (F.col("of_segment") + F.col("position")).alias("start"), "n_tokens", "ids_crc32")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates by three-word shingles at a similarity of 0.85."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


#: Rules on host and path, and names of sites listed under every ending, whose pages are blocked where no rule fits.
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
LISTED = [f"{name}.example.{ending}" for name in ("spam-farm", "cheap-pills", "casino-win", "free-bets", "adult-x", "ads-track") for ending in ("com", "net", "org")]
#: Of the addresses in ``pages`` those whose sha256 begins with this digit are listed: a sixteenth, by no order or size.
LISTED_DIGIT = "3"


def listed_pages(pages: DataFrame) -> DataFrame:
    """The list of blocked addresses: host and path of a sixteenth of all addresses that occur, by their digests."""
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    entry = F.concat(host, F.when(path == "", "/").otherwise(path))
    rows = pages.where(F.instr("url", "://") > 0).select(entry.alias("entry")).distinct()
    return rows.where(F.substring(F.sha2(F.col("entry").cast("binary"), 256), 1, 1) == LISTED_DIGIT).select("entry", F.lit("block").alias("verdict"), F.lit(False).alias("is_rule"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page, by rules, listed hosts and listed addresses."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listing = url_filter.entries(spark, RULES, LISTED).unionByName(listed_pages(pages))
    return url_filter.judge(pages, listing).select("page_id", "host", "path", "rule", "verdict")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of equal labels at a cosine of 0.93."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    tokenizer = public_tokenizers.path(TOKENIZER)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, tokenizer).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more are dropped everywhere."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup(docs, min_docs=10, min_chars=1, keep="none")
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "found")
    known = [F.expr(f"cast(size(filter(found, s -> s.kind = '{kind}')) as bigint) as n_{kind}") for kind in ("assign", "access", "hex")]
    base = F.expr("filter(found, s -> s.kind <> 'random')")
    return found.select("doc_id", *known, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and outlier verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality_rules.judged(docs).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "distance")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranking = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(docs, ranking)
    return scored.select("doc_id", F.coalesce(quality_classifier.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot of every document in a mixture with square-root weights."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("size"))
    return mixing.mix(docs, F.col("size")).select("doc_id", "source", "size", "start", "block", "slot")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from the others of its language, and the terms that make it stand out."""
    docs = table(spark, sf_dir, "documents").select("text", "lang", "source")
    return divergence.audit(docs).withColumn("rank", F.col("rank").cast("int"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    trees = language_id.train(table(spark, sf_dir, "documents"))
    found = language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text"), trees)
    return found.select("doc_id", F.coalesce(language_id.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged between sentinels, and restored from that."""
    made = fill_in_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    sizes = [F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    digests = [F.sha2(F.encode(c, "UTF-8"), 256).alias(name) for c, name in ((F.col("output"), "output_sha256"), (back, "restored_sha256"))]
    return made.select("doc_id", "n", "form", *sizes, *digests)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        op1_token_files,
        op2_minhash,
        op3_url_filter,
        op4_embedding_dedup,
        op5_bpe,
        op6_line_dedup,
        op7_secrets,
        op8_quality_rules,
        op9_quality_classifier,
        op10_mixing,
        op11_divergence,
        op12_language_id,
        op13_fill_in_middle,
    ]
    return {f.__name__: f for f in named}


_ENTRIES = ", ".join(f"('{e}', '{v}', true)" for e, v in RULES.items()) + "".join(f", ('{e}', 'block', false)" for e in LISTED)
_LOWER = f"translate({{}}, '{UPPER}', '{LOWER}')"

OP3_SQL = f"""
with entry(entry, verdict, is_rule) as (values {_ENTRIES}),
  listing as (select *, regexp_extract(entry, '^[^/]*') as h, regexp_extract(entry, '^[^/]*(.*)$', 1) as p from entry),
  address as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
  page as (select page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from address),
  canonical as (select *, rtrim(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') as bare,
    concat('/', regexp_replace(regexp_replace(case when contains(path, '%') then url_decode(path) else path end, '^/+', ''), '/+', '/', 'g')) as plain from page),
  listed as (select distinct bare, plain from canonical where (host <> '' or path <> '') and substr(sha256(concat(host, case when path = '' then '/' else path end)), 1, 1) = '{LISTED_DIGIT}'),
  fit as (select page_id, entry, verdict, is_rule, row_number() over (partition by page_id order by is_rule desc, length(entry) desc, length(h) desc) as n
    from canonical join listing on case when is_rule then (host = h or ends_with(host, '.' || h)) and starts_with(path, p) else bare = h or ends_with(bare, '.' || h) end)
select c.page_id, host, path, case when is_rule then entry end as rule, coalesce(verdict, case when listed.plain is not null then 'block' end, 'allow') as verdict
from canonical c left join fit on fit.page_id = c.page_id and n = 1 left join listed on listed.bare = c.bare and listed.plain = c.plain
"""

OP6_SQL = f"""
with doc as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
  line as (select doc_id, lines[pos] as line, pos, {_LOWER.format("trim(lines[pos], concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))")} as key
    from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as pos from doc)),
  often as (select key from line where key <> '' group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (often.key is not null) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (often.key is null), '')) as kept_sha256
from line left join often on often.key = line.key group by doc_id
"""

_APART = "({p} - {q}) * ({p} - {q}) // {q}"
_LEVEL = "1 + 1000000000::hugeint * ({n} + 1) // ({total} + {kept})"

OP11_SQL = f"""
with doc as (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
  each as (select doc_id, lang, source, unnest(regexp_extract_all({_LOWER.format("text")}, '{divergence.TERM}')) as term from doc),
  kept as (select lang, term, count(*) as n from each group by lang, term having count(distinct doc_id) >= {divergence.LEAST_DOCS}),
  counted as (select each.lang, source, each.term, count(*) as n from each join kept on kept.lang = each.lang and kept.term = each.term group by all),
  vocabulary as (select lang, count(*) as v, sum(n) as total from kept group by lang),
  groups as (select distinct lang, source from doc),
  size as (select groups.lang, groups.source, coalesce(sum(n), 0) as total from groups left join counted on counted.lang = groups.lang and counted.source = groups.source group by all),
  level as (select size.lang, size.source, kept.term, coalesce(c.n, 0) as n, {_LEVEL.format(n="coalesce(c.n, 0)", total="size.total", kept="v")} as p,
      {_LEVEL.format(n="kept.n", total="vocabulary.total", kept="v")} as q
    from size join vocabulary on vocabulary.lang = size.lang join kept on kept.lang = size.lang
      left join counted c on c.lang = size.lang and c.source = size.source and c.term = kept.term),
  summed as (select a.lang, a.source, b.source as item, sum({_APART.format(p="a.p", q="b.p")}) as value
    from level a join level b on b.lang = a.lang and b.term = a.term and b.source <> a.source group by all),
  pairs as (select a.lang, a.source, b.source as item, coalesce(value, 0) as value
    from groups a join groups b on b.lang = a.lang and b.source <> a.source left join summed s on s.lang = a.lang and s.source = a.source and s.item = b.source),
  terms as (select lang, source, term as item, {_APART.format(p="p", q="q")} as value from level where n > 0 and p > q),
  part as (select *, 'pair' as part from pairs union all by name select *, 'term' as part from terms),
  ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from part)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from ranked where part = 'pair' or rank <= {divergence.TOP}
"""

_HASHED = "cast('0x' || substr(h, {at}, 8) as bigint)"

OP13_SQL = f"""
with doc as (select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
  split as (select *, regexp_extract_all(text, '{fill_in_middle.UNIT}') as units from doc),
  numbered as (select *, cast(len(units) as bigint) as n, {_HASHED.format(at=1)} as h1, {_HASHED.format(at=9)} as h2, {_HASHED.format(at=17)} as h3, {_HASHED.format(at=25)} as h4 from split),
  cut as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from numbered),
  part as (select *, coalesce(array_to_string(units[1:a], ''), '') as prefix, coalesce(array_to_string(units[a + 1:b], ''), '') as middle, coalesce(array_to_string(units[b + 1:n], ''), '') as suffix from cut),
  made as (select *, case form when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else text end as output from part),
  mark as (select *, strpos(output, '<P>') as p, strpos(output, '<S>') as s, strpos(output, '<M>') as m from made),
  back as (select *, case form when 'psm' then substr(output, p + 3, s - p - 3) || substr(output, m + 3) || substr(output, s + 3, m - s - 3)
    when 'spm' then substr(output, p + 3, m - p - 3) || substr(output, m + 3) || substr(output, s + 3, p - s - 3) else output end as restored from mark)
select doc_id, n, form, case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
  sha256(output) as output_sha256, sha256(restored) as restored_sha256
from back
"""


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express; tests hold the others against brute force."""
    return {"op3_url_filter": OP3_SQL, "op6_line_dedup": OP6_SQL, "op11_divergence": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
