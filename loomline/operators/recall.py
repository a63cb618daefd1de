"""Reading long-lived records back: search, by file, recent ones, and what fits a byte budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.confidence import MATURITY

SAME_FOLDER, SAME_NAME = 0.75, 0.6
#: Parts that the records of one folder or name are dealt to.
SALTS = 64


def usable(instincts: DataFrame, domain: str | None = None, scopes: list[str] | None = None, min_maturity: str | None = None) -> DataFrame:
    """Records that are not deprecated, of a domain, scopes and least maturity if these are given."""
    out = instincts.where("maturity <> 'deprecated'")
    if domain:
        out = out.where(F.col("domain") == domain)
    if scopes:
        out = out.where(F.col("scope").isin(scopes))
    if min_maturity:
        out = out.where(F.col("maturity").isin(MATURITY[MATURITY.index(min_maturity) :]))
    return out


def terms(query: str) -> list[str]:
    """Lower-cased words of a query."""
    return [t for t in "".join(c if c.isascii() and (c.isalnum() or c in "-_./") else " " for c in query.lower()).split() if t]


def search(instincts: DataFrame, query: str, limit: int = 10, fields: tuple[str, ...] = ("trigger", "finding", "domain", "scope"), paths: str | None = None) -> DataFrame:
    """The best ``limit`` records by the share of query words found in them; each path with a word adds half a word."""
    asked = terms(query)
    if not asked:
        return instincts.limit(0).withColumn("score", F.lit(0.0))

    def found(word: str) -> Column:
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(f)), F.lit(word)), F.lit(False))
        return hit.cast("int")

    matched = sum((found(w) for w in asked), F.lit(0))
    near = F.lit(0)
    if paths:
        near = F.coalesce(F.size(F.filter(paths, lambda p: F.exists(F.array(*map(F.lit, asked)), lambda w: F.contains(F.lower(p), w)))), F.lit(0))
    score = F.least(F.lit(1.0), (matched + near * 0.5) / float(len(asked)))
    hits = instincts.withColumn("score", score).where("score > 0")
    return hits.orderBy(F.desc("score"), F.desc("confidence"), F.desc("updated_at"), "instinct_id").limit(limit)


def _folder(c: Column) -> Column:
    return F.regexp_extract(c, r"^(.*)/[^/]*$", 1)


def _name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def proximity(target: Column, ref: Column) -> Column:
    """1 for equal paths, 0.75 in one folder, 0.6 with one name, else 0."""

    beside = (F.length(_folder(target)) > 0) & (_folder(target) == _folder(ref))
    return F.when(target == ref, 1.0).when(beside, SAME_FOLDER).when((F.length(_name(target)) > 0) & (_name(target) == _name(ref)), SAME_NAME).otherwise(0.0)


def for_files(refs: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """The best match of every record (columns ``by``) for each target path; equality joins only.

    ``refs`` has ``by`` and path; ``targets`` has target. Equal paths, one folder with other paths,
    and one name in other folders are three joins of which each finds what no other does, so pairs
    of a record with one path need no aggregation: as many as a large folder makes, they stream
    through. Targets are the smaller side; each goes to ``SALTS`` parts of its folder's or name's records.
    """
    own = refs.groupBy(*by).agg(F.collect_set("path").alias("_paths"))
    paths = own.select(*by, (F.size("_paths") > 1).alias("_many"), F.explode("_paths").alias("path"))
    at = F.pmod(F.xxhash64(*by, "path"), F.lit(SALTS)).cast("int")
    refs_at = paths.withColumns({"_folder": _folder(F.col("path")), "_name": _name(F.col("path")), "_salt": at})
    wanted = targets.select("target").where("target is not null").distinct()
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = wanted.select("target", _folder(F.col("target")).alias("_f"), _name(F.col("target")).alias("_n"), salts.alias("_s"))
    other = F.col("path") != F.col("target")
    same, one_salt = F.col("_folder") == F.col("_f"), F.col("_salt") == F.col("_s")
    columns = ["target", *by, "_many"]
    equal = paths.join(wanted, F.col("path") == F.col("target")).select(*columns, F.lit(1.0).alias("score"))
    beside = refs_at.where("_folder <> ''").join(salted, same & one_salt & other).select(*columns, F.lit(SAME_FOLDER).alias("score"))
    named = refs_at.where("_name <> ''").join(salted, (F.col("_name") == F.col("_n")) & one_salt & other & ((F.col("_folder") == "") | ~same)).select(*columns, F.lit(SAME_NAME).alias("score"))
    met = equal.unionByName(beside).unionByName(named)
    best = met.where("_many").groupBy("target", *by).agg(F.max("score").alias("score"))
    out = met.where("not _many").drop("_many").unionByName(best)
    return out.withColumn("kind", F.when(F.col("score") == 1.0, "exact").otherwise("proximal"))


def recent(instincts: DataFrame, days: int = 7, limit: int = 20) -> DataFrame:
    """The newest records within ``days`` of the newest of all, scored 1 - rank / count."""
    end = instincts.agg(F.max("updated_at").alias("_end"))
    inside = instincts.crossJoin(F.broadcast(end)).where(F.col("updated_at") >= F.col("_end") - F.make_dt_interval(days=F.lit(days))).drop("_end")
    newest = inside.orderBy(F.desc("updated_at"), "instinct_id").limit(limit)  # at most ``limit`` rows from here on
    everything = Window.partitionBy()
    rank = F.row_number().over(everything.orderBy(F.desc("updated_at"), "instinct_id"))
    total = F.count("*").over(everything)
    return newest.withColumns({"rank": rank, "score": F.when(total <= 1, 1.0).otherwise(1.0 - (rank - 1) / total)})


def within_bytes(lines: DataFrame, by: list[str], order: str, text: str, budget: int) -> DataFrame:
    """The first lines of each group that fit a byte budget, line ends counted."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.octet_length(text) + 1).over(upto)
    return lines.withColumn("used_bytes", used).where(F.col("used_bytes") <= budget)
