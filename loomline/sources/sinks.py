"""Where results go: tables by partition, append-only logs, immutable manifests, exports, status of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.identity import json_hash


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace the partitions that ``df`` has rows for, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_log(df: DataFrame, path: str, key: str | None = None) -> None:
    """Append JSON lines; with ``key`` only those whose key the log lacks."""
    spark = df.sparkSession
    if key:
        try:
            seen = spark.read.schema(df.schema).json(path).select(key).distinct()
            df = df.join(seen, key, "left_anti").dropDuplicates([key])
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    df.write.mode("append").json(path)


def new_manifests(existing: DataFrame, made: DataFrame, keys: list[str], fields: list[str], override: bool = False) -> DataFrame:
    """``made`` with action: create, same (equal content, nothing to write), or replace where overriding is allowed.

    A manifest is immutable: different content under the same key fails the job unless overridden.
    """

    def digest() -> Column:
        return json_hash(**{f: F.col(f).cast("string") for f in fields})

    old = existing.select(*keys, digest().alias("_old"))
    both = made.withColumn("_new", digest()).join(old, keys, "left")
    conflict = F.lit("replace") if override else F.raise_error(F.concat(F.lit("a manifest with other content exists: "), F.concat_ws(":", *keys))).cast("string")
    action = F.when(F.col("_old").isNull(), "create").when(F.col("_old") == F.col("_new"), "same").otherwise(conflict)
    return both.withColumn("action", action).drop("_old", "_new")


def page_status(pages: DataFrame, published: DataFrame, key: str, body: str) -> DataFrame:
    """``pages`` with status: written, skipped_unchanged, or skipped_protected if what was published has been edited.

    ``published``: key, content_hash (what was written), actual_hash (what is there).
    """
    own = F.sha2(F.col(body).cast("binary"), 256)
    both = pages.withColumn("content_hash", own).join(published.select(key, F.col("content_hash").alias("_was"), F.col("actual_hash").alias("_is")), key, "left")
    status = F.when(F.col("_was").isNotNull() & (F.col("_is") != F.col("_was")), "skipped_protected").when(F.col("_was") == F.col("content_hash"), "skipped_unchanged").otherwise("written")
    return both.withColumn("status", status).drop("_was", "_is")


def wiki_records(learnings: DataFrame) -> DataFrame:
    """Learnings as wiki records, whose id is the hash of their content."""
    body = F.concat_ws("\n\n", F.concat(F.lit("# "), F.translate(F.col("title"), "—", "-")), F.translate(F.col("statement"), "—", "-"))
    out = learnings.withColumn("body", body)
    return out.withColumn("id", json_hash(project=F.col("project_key"), title=F.col("title"), body=F.col("body")))


def retention_report(receipts: DataFrame) -> DataFrame:
    """One row: sessions, ready ones, blocked ones."""
    return receipts.agg(F.count("*").alias("sessions"), F.count_if("safe_to_delete").alias("ready"), F.count_if(~F.col("safe_to_delete")).alias("blocked"))


# Where the records of a domain go that the memory page has no line for.
MEMORY = "MEMORY.md"
TOPIC_FILES = {
    "workflow": "workflow.md",
    "tooling": "tooling.md",
    "code-style": "preferences.md",
    "product": "preferences.md",
    "testing": "pitfalls.md",
    "git": "pitfalls.md",
    "security": "pitfalls.md",
    "performance": "pitfalls.md",
    "debugging": "debugging.md",
}
OTHER_TOPICS = "pitfalls.md"
SPILLOVER = "Spillover from curated MEMORY.md (instincts beyond the line cap)."


def bullet() -> Column:
    """A record as a line of a page."""
    return F.concat(F.lit("- **"), F.col("trigger"), F.lit("** "), F.col("finding"), F.lit(" ("), F.format_string("%.2f", F.col("confidence")), F.lit(")"))


def memory_pages(rolled: DataFrame) -> DataFrame:
    """project_id, name and page: the included records of ``instincts.rollup_pages`` as one page, the others by topic, in their order."""
    topic = F.coalesce(*(F.when(F.col("domain") == d, F.lit(f)) for d, f in TOPIC_FILES.items()), F.lit(OTHER_TOPICS))
    name = F.when(F.col("included"), MEMORY).otherwise(topic)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", bullet().alias("b")))), lambda x: x.b)
    made = rolled.withColumn("name", name).groupBy("project_id", "name").agg(F.array_join(lines, "\n").alias("page"))
    heading = F.concat(F.lit("# "), F.regexp_replace("name", r"\.md$", ""), F.lit(f"\n\n{SPILLOVER}\n\n"), F.col("page"), F.lit("\n"))
    return made.withColumn("page", F.when(F.col("name") == MEMORY, F.col("page")).otherwise(heading))
