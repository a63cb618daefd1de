"""Learnings before, during and after review: prefilter, pending ones, batches, caches, application, merging."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.answers import terminal_error
from loomline.functions.identity import json_hash
from loomline.operators.ledger import upserted_by
from loomline.sources import artifacts
from loomline.sources.scratch import stored

REFS_CAP = 20


def statement_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def prefiltered(learnings: DataFrame, low_signal: Column, order: list[str], statement: str = "statement") -> DataFrame:
    """``learnings`` with verdict: low_signal, duplicate (of an earlier one that passed) or review."""
    marked = learnings.withColumns({"_low": low_signal, "_key": statement_key(F.col(statement))})
    place = F.row_number().over(Window.partitionBy("_key", "_low").orderBy(*order))
    verdict = F.when(F.col("_low"), "low_signal").when(place > 1, "duplicate").otherwise("review")
    return marked.withColumn("verdict", verdict).drop("_low", "_key")


def pending(learnings: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Learnings that no review has seen."""
    return learnings.join(reviewed.select("learning_id").distinct(), "learning_id", "left_anti")


def pending_counts(learnings: DataFrame, reviewed: DataFrame) -> DataFrame:
    return pending(learnings, reviewed).agg(F.count("*").alias("pending_learnings"), F.countDistinct("session_id").alias("pending_sessions"))


def content_hash() -> Column:
    """The hash that tells whether a learning has changed since its review."""
    return json_hash(**{c: F.col(c) for c in ("kind", "statement", "title", "trigger")})


def planned(learnings: DataFrame, cache: DataFrame) -> DataFrame:
    """``learnings`` with cache_key and cached: whether a verdict for the same content is known."""
    keyed = learnings.withColumn("cache_key", content_hash())
    return keyed.join(cache.select("cache_key").distinct().withColumn("_hit", F.lit(True)), "cache_key", "left").withColumn("cached", F.coalesce("_hit", F.lit(False))).drop("_hit")


def reviewed(misses: DataFrame, provider: Callable[[list[dict]], list[dict]], size: int = 10) -> DataFrame:
    """Verdicts of a provider for learnings that the cache lacks, ``size`` at a time in each task.

    ``provider`` maps rows to dicts of verdict and suggested_statement; it is never called by
    default. A lot that fails is marked ``error`` and leaves the others alone.
    """
    columns = misses.columns
    schema = T.StructType([*misses.schema.fields, T.StructField("verdict", T.StringType()), T.StructField("suggested_statement", T.StringType())])

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), size):
                lot = frame.iloc[at : at + size]
                try:
                    answers = provider(lot.to_dict("records"))
                    if len(answers) != len(lot):
                        raise ValueError("as many answers as learnings are needed")
                except Exception as e:  # a provider's failure is a verdict, not the job's
                    answers = [{"verdict": "error", "suggested_statement": str(e)[:200]}] * len(lot)
                yield lot.assign(verdict=[a.get("verdict") for a in answers], suggested_statement=[a.get("suggested_statement") for a in answers])[[*columns, "verdict", "suggested_statement"]]

    return misses.mapInPandas(run, schema)


def reviewed_in_waves(misses: DataFrame, provider: Callable[[list[dict]], list[dict]], key: str = "cache_key", size: int = 10, lots: int = 8) -> DataFrame:
    """``reviewed`` wave by wave, with wave and asked: after a wave with a terminal error nothing more is asked.

    A wave is about ``lots`` lots of ``size`` learnings, dealt by a hash of the key, which tasks ask
    in parallel. Its answers are stored before the next begins, so a lost executor asks only the
    lots of its own wave again. Learnings that were not asked have a null wave and verdict, and
    wait for the next run.
    """
    spark = misses.sparkSession
    held = stored(misses, "misses")
    n = held.count()
    waves = max(1, -(-n // (size * lots)))
    numbered = held.withColumn("wave", F.pmod(F.xxhash64(key), F.lit(waves)).cast("int"))
    made: list[DataFrame] = []
    for wave in range(waves if n else 0):
        rows = numbered.where(F.col("wave") == wave)
        answers = stored(reviewed(rows.repartition(lots, key), provider, size), f"wave-{wave}")
        made.append(answers)
        error = F.when(F.col("verdict") == "error", F.col("suggested_statement"))
        if not answers.where(terminal_error(error)).isEmpty():
            break
    none = spark.createDataFrame([], made[0].schema) if made else reviewed(numbered.limit(0), provider, size)
    asked = reduce(DataFrame.unionByName, made, none).withColumn("asked", F.lit(True))
    rest = numbered.where(F.col("wave") >= len(made)).withColumns({"wave": F.lit(None).cast("int"), "verdict": F.lit(None).cast("string"), "suggested_statement": F.lit(None).cast("string"), "asked": F.lit(False)})
    return asked.unionByName(rest.select(*asked.columns))


def cache_rows(answers: DataFrame) -> DataFrame:
    """The answers that a later run need not ask for again."""
    return answers.where(F.col("asked") & F.col("verdict").isNotNull() & (F.col("verdict") != "error")).select("cache_key", "verdict", "suggested_statement")


def batch_hash(reviews: DataFrame) -> str:
    """The identity of a batch of reviews: what is reviewed, with which content and verdict, in any order."""
    row = F.struct(*(F.col(c).cast("string") for c in ("session_id", "learning_id", "input_hash", "verdict", "suggested_statement")))
    return reviews.agg(F.concat_ws(":", F.count("*").cast("string"), F.bit_xor(F.xxhash64(row)).cast("string"), F.bit_xor(F.xxhash64(F.lit(1), row)).cast("string"))).first()[0]


def apply_batch(spark: SparkSession, root: str, reviews: DataFrame, originals: DataFrame, flags: Column, now: Column) -> dict:
    """Apply a batch of reviews once: its status (applied, or same if it had been applied before) and counts of outcomes.

    ``reviews``: session_id, learning_id, input_hash, verdict, suggested_statement; ``originals``:
    project_key, session_id, learning_id, content_hash, kind, statement, title, trigger, basis.
    Applied reviews become learnings of the artifact "reviewed": the suggested statement under the
    learning's own title and trigger. They replace what stood under the same ids, and the ledger's
    entry comes into force with them, so a batch is applied wholly or not at all. A batch that
    fails leaves an entry that says so, and may be applied again.
    """
    batch = batch_hash(reviews)
    entries = artifacts.load(spark, root, "applications").where((F.col("batch_id") == batch) & (F.col("status") == "applied"))
    known = entries.select("n_applied", "n_rejected", "n_skipped").limit(1).collect()
    if known:
        return {"status": "same", "batch_id": batch} | known[0].asDict()

    def entry(generation: artifacts.Generation, status: str, counts: tuple, error: str | None) -> None:
        row = spark.createDataFrame([(batch, status, *counts, error)], "batch_id string, status string, n_applied long, n_rejected long, n_skipped long, error string")
        rows = artifacts.load(spark, root, "applications").where(F.col("batch_id") == batch).unionByName(row.withColumn("recorded_at", now))
        generation.save(rows, "applications", row.select("batch_id"))

    try:
        generation = artifacts.Generation(spark, root)
        judged = stored(applied(reviews, originals, flags), "outcomes")
        outcomes = {r[0]: r[1] for r in judged.groupBy("outcome").count().collect()}
        good = judged.where("outcome = 'applied'").select("session_id", "learning_id", "verdict", "suggested_statement")
        basis = F.concat("basis", F.lit(" LLM-reviewed with "), "verdict", F.lit(" verdict."))
        made = originals.join(good, ["session_id", "learning_id"]).withColumns({"statement": F.col("suggested_statement"), "basis": basis, "reviewed_at": now})
        touched = stored(made.select("project_key").distinct(), "touched")
        old = artifacts.load(spark, root, "reviewed").join(touched, "project_key", "left_semi")
        generation.save(upserted_by(old, made.select(*old.columns), ["session_id", "learning_id"]), "reviewed", touched)
        counts = (outcomes.get("applied", 0), outcomes.get("rejected", 0) + outcomes.get("invalid", 0), outcomes.get("missing", 0) + outcomes.get("changed", 0))
        entry(generation, "applied", counts, None)
        generation.commit()
    except Exception as e:
        failed = artifacts.Generation(spark, root)
        entry(failed, "failed", (None, None, None), str(e)[:200])
        failed.commit()
        raise
    return {"status": "applied", "batch_id": batch} | dict(zip(("n_applied", "n_rejected", "n_skipped"), counts, strict=True))


def applied(reviews: DataFrame, originals: DataFrame, flags: Column) -> DataFrame:
    """Reviews with outcome: applied, rejected, invalid (flags), missing or changed (content differs).

    ``reviews``: session_id, learning_id, input_hash, verdict; ``originals``: session_id,
    learning_id, content_hash.
    """
    keys = ["session_id", "learning_id"]
    both = reviews.join(originals.select(*keys, "content_hash"), keys, "left")
    outcome = (
        F.when(F.col("content_hash").isNull(), "missing")
        .when(F.col("content_hash") != F.col("input_hash"), "changed")
        .when(F.col("verdict") != "keep", "rejected")
        .when(F.size(flags) > 0, "invalid")
        .otherwise("applied")
    )
    return both.withColumn("outcome", outcome)


def merged(learnings: DataFrame, key: Column, by: list[str], newest: list[str], refs: str = "ref", cap: int = REFS_CAP) -> DataFrame:
    """One row for each key: the newest learning, and the union of references in order, at most ``cap``.

    ``cap`` is the length of the list that is shown; ``n_refs`` counts all.
    """
    keyed = learnings.withColumn("merge_key", key)
    value = F.struct(*(c for c in learnings.columns if c not in (*by, refs)))
    return keyed.groupBy(*by, "merge_key").agg(
        F.max_by(value, F.struct(*newest)).alias("_v"),
        F.count_distinct(F.col(refs)).alias("n_refs"),
        F.slice(F.array_sort(F.collect_set(refs)), 1, cap).alias("refs"),
        F.count("*").alias("n_learnings"),
    ).select(*by, "merge_key", "_v.*", "n_learnings", "n_refs", "refs")


def kept_first(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key; the empty key counts like others."""
    place = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    return rows.withColumn("_key", key).withColumn("_n", place).where("_n = 1").drop("_key", "_n")


def merge_opportunity(learnings: DataFrame, exact: Column, canonical: Column, project: str) -> DataFrame:
    """One row: distinct exact ids, distinct merge keys, keys that several projects share."""
    keys = learnings.select(exact.alias("e"), canonical.alias("k"), F.col(project).alias("p"))
    per_key = keys.groupBy("k").agg(F.count_distinct("e").alias("e"), F.count_distinct("p").alias("p"))
    exact_ids = keys.select("e").distinct().agg(F.count("*").alias("exact_ids"))
    sums = per_key.agg(F.count("*").alias("canonical_keys"), F.count_if(F.col("e") > 1).alias("mergeable_keys"), F.count_if(F.col("p") > 1).alias("cross_project_keys"))
    return exact_ids.crossJoin(sums)


def without_higher(lines: DataFrame, by: str, field: str, priority: list[str]) -> DataFrame:
    """Lines of each group without those that a field of higher priority has too (case and spaces aside)."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col(field))
    key = F.trim(F.regexp_replace(F.lower("line"), r"\s+", " "))
    best = F.min("_rank").over(Window.partitionBy(by, "_key"))
    return lines.withColumns({"_rank": rank, "_key": key}).withColumn("_best", best).where("_rank = _best").drop("_rank", "_key", "_best")
