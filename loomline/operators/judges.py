"""Judging by a provider within budgets: records for promotion, mined guidance, topics of sessions.

A provider maps a row to an answer and its cost; none is called by default. Candidates are a
report's list of bounded length, and each call depends on what the calls before it cost, so the
calls are made in order on the driver; candidates, caches and results are tables.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.answers import KINDS, LEVELS, generated_topic, promotion_verdict, terminal_error, workflow_verdict
from loomline.functions.identity import json_hash
from loomline.operators.workflow import undecided

# Fixed values.
MOST_ERRORS, LEAST_CONFIDENCE, LIMIT = 3, 0.6, 20
ANSWERS = "cache_key string, answer string, cost double, from_cache boolean, error string, stopped string"
Provider = Callable[[dict], tuple[str, float]]


def asked(candidates: DataFrame, cache: DataFrame, provider: Provider, valid: Callable[[dict], bool], calls_left: float, usd_left: float, limit: int = LIMIT) -> DataFrame:
    """One row for each candidate that got an answer or an error, in order: cache_key, answer, cost, from_cache, error, stopped.

    ``candidates`` has cache_key and ord, ``cache`` cache_key and answer. Cached answers are free.
    Asking stops when a budget is used up, or after three errors in a row; the row after the last
    call then says so in ``stopped``. An answer without a JSON object that is ``valid`` is an error.
    """
    spark = candidates.sparkSession
    known = cache.groupBy("cache_key").agg(F.max("answer").alias("cached"))
    rows = candidates.orderBy("ord", "cache_key").limit(limit).join(known, "cache_key", "left").orderBy("ord", "cache_key")
    out, errors = [], 0
    for row in rows.collect():  # at most ``limit`` rows
        if row.cached is not None:
            out.append((row.cache_key, row.cached, 0.0, True, None, None))
            continue
        if calls_left < 1 or usd_left <= 0:
            out.append((row.cache_key, None, 0.0, False, None, "count_budget_exhausted" if calls_left < 1 else "usd_budget_exhausted"))
            break
        try:
            answer, cost = provider({k: v for k, v in row.asDict().items() if k != "cached"})
            if not valid(json.loads(answer[answer.index("{") : answer.rindex("}") + 1])):
                raise ValueError("the answer is not valid")
        except Exception as e:  # a provider's failure is recorded; three in a row end the run
            errors += 1
            stop = f"aborted_after_{errors}_consecutive_errors: {e}" if errors >= MOST_ERRORS else None
            out.append((row.cache_key, None, 0.0, False, str(e)[:200], stop))
            if stop:
                break
            continue
        errors, calls_left, usd_left = 0, calls_left - 1, usd_left - cost
        out.append((row.cache_key, answer, float(cost), False, None, None))
    return spark.createDataFrame(out, ANSWERS)


def _is_promotion(v: dict) -> bool:
    certain = v.get("confidence")
    return isinstance(v.get("global"), bool) and isinstance(certain, int | float) and 0 <= certain <= 1 and isinstance(v.get("reason"), str)


def _is_guidance(v: dict) -> bool:
    return isinstance(v.get("wording_ok"), bool) and v.get("artifact_kind") in KINDS and v.get("confidence") in LEVELS and isinstance(v.get("reason"), str)


def promotion_key(model: str, version: str) -> Column:
    """The key of a record's verdict: what it says, the model and the question's version."""
    return F.concat_ws(":", json_hash(domain=F.col("domain"), trigger=F.col("trigger"), finding=F.col("finding")), F.lit(model), F.lit(version))


def judged_promotions(pool: DataFrame, cache: DataFrame, provider: Provider, calls_left: float, usd_left: float, model: str = "", version: str = "1", limit: int = LIMIT, least: float = LEAST_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """The records to promote with the verdict's confidence and reason, and all answers (the cache's new rows are among them).

    ``pool``: instinct_id, project_id, domain, trigger, finding, confidence; the most confident are asked first.
    """
    keyed = pool.withColumns({"cache_key": promotion_key(model, version), "ord": F.struct((-F.col("confidence")).alias("c"), "instinct_id")})
    answers = asked(keyed, cache, provider, _is_promotion, calls_left, usd_left, limit)
    verdicts = answers.where("answer is not null").select("cache_key", promotion_verdict(F.col("answer")).alias("v")).distinct()
    agreed = keyed.drop("ord").join(verdicts, "cache_key").where(F.col("v.general") & (F.col("v.confidence") >= least))
    return agreed.select("instinct_id", F.col("project_id").alias("source_project"), "domain", "confidence", F.col("v.confidence").alias("verdict_confidence"), F.col("v.reason").alias("reason")), answers


def promoted(records: DataFrame, agreed: DataFrame, now: Column) -> DataFrame:
    """The general copies of agreed records."""
    own = records.join(agreed.select("instinct_id", F.col("source_project").alias("project_id")), ["instinct_id", "project_id"], "left_semi")
    return own.withColumns({"scope": F.lit("global"), "project_id": F.lit(""), "last_promoted_at": now})


def judged_guidance(candidates: DataFrame, decisions: DataFrame, cache: DataFrame, provider: Provider, calls_left: float, usd_left: float, model: str = "", version: str = "1", limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """Decisions ``judged`` of undecided guidance with the verdict as a note, and all answers.

    ``candidates``: candidate_id, rule_id, cluster, confidence, recommendation, guidance, trigger and counts.
    """
    fields = [c for c in ("rule_id", "cluster", "confidence", "recommendation", "guidance", "trigger", "supporting_count", "contradicting_count") if c in candidates.columns]
    keyed = undecided(candidates, decisions).withColumn("cache_key", F.concat_ws(":", F.lit("workflow"), json_hash(**{f: F.col(f) for f in fields}), F.lit(model), F.lit(version)))
    answers = asked(keyed.withColumn("ord", F.col("candidate_id")), cache, provider, _is_guidance, calls_left, usd_left, limit)
    notes = answers.where("answer is not null").select("cache_key", "from_cache", F.to_json(workflow_verdict(F.col("answer"))).alias("note")).distinct()
    return keyed.join(notes, "cache_key").select("candidate_id", "rule_id", F.lit("judged").alias("decision"), "note", "from_cache"), answers


def topics(sessions: DataFrame, poor: Column, provider: Callable[[dict], str] | None = None) -> DataFrame:
    """``sessions`` with topic and topic_source: a provider's topic where the session's own is poor, else (or if that fails) its own.

    Sessions are independent, so tasks ask in parallel; a failure keeps the session's own topic.
    """
    if provider is None:
        return sessions.withColumn("topic_source", F.lit("deterministic"))
    marked = sessions.withColumn("_poor", F.coalesce(poor, F.lit(False)))
    schema = T.StructType([*sessions.schema.fields, T.StructField("_answer", T.StringType())])
    columns = sessions.columns

    def ask(row: dict) -> str | None:
        try:
            return provider(row)
        except Exception:  # an optional title never breaks a session
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = frame[columns].to_dict("records")
            yield frame[columns].assign(_answer=[ask(r) if p else None for r, p in zip(rows, frame["_poor"], strict=True)])

    made = marked.mapInPandas(run, schema).withColumn("_topic", generated_topic(F.col("_answer")))
    source = F.when(F.col("_topic").isNotNull(), "llm").otherwise("deterministic")
    return made.withColumns({"topic_source": source, "topic": F.coalesce("_topic", "topic")}).drop("_answer", "_topic")


def until_terminal(results: DataFrame, by: str, order: str) -> DataFrame:
    """Provider results with ``asked``: false for those of a group after its first terminal error."""
    first = results.where(terminal_error(F.col("error"))).groupBy(by).agg(F.min(order).alias("_stop"))
    return results.join(first, by, "left").withColumn("asked", F.coalesce(F.col(order) <= F.col("_stop"), F.lit(True))).drop("_stop")
