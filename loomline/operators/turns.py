"""Records of a session grouped into turns, and what a turn adds up to.

Input columns: session_id, line, kind, text, and where a record has them redacted, commands, files
(arrays), ts. A turn starts at every user message; records before the first one belong to it; a
session without a user message has no turns. Both the grouping and the aggregation partition by
session, so one shuffle serves them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import filled

USER, ASSISTANT, TOOL_USE, TOOL_RESULT, EVENT = "user_message", "assistant_message", "tool_use_stub", "tool_result_stub", "event"
RECORD = {"redacted": "boolean", "commands": "array<string>", "files": "array<string>", "ts": "string"}


def with_defaults(records: DataFrame) -> DataFrame:
    """``records`` with every optional column; missing ones are empty."""
    made = {"redacted": F.lit(False), "commands": F.array().cast("array<string>"), "files": F.array().cast("array<string>"), "ts": F.lit(None).cast("string")}
    return records.withColumns({c: v for c, v in made.items() if c not in records.columns})


def grouped(records: DataFrame) -> DataFrame:
    """``records`` with turn_index and turn_id, without sessions that have no user message."""
    session = Window.partitionBy("session_id")
    asked = F.sum(F.when(F.col("kind") == USER, 1).otherwise(0))
    upto = session.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    out = records.withColumns({"_upto": asked.over(upto), "_all": asked.over(session)}).where("_all > 0")
    index = (F.greatest(F.col("_upto"), F.lit(1)) - 1).cast("int")
    return out.withColumn("turn_index", index).withColumn("turn_id", turn_id(F.col("session_id"), index)).drop("_upto", "_all")


def turn_id(session: Column, index: Column) -> Column:
    return F.concat(session, F.lit(":turn-"), F.lpad(index.cast("string"), 4, "0"))


def prompt(text: Column, redacted: Column) -> Column:
    """The user's words, or what stands for them."""
    return F.coalesce(filled(text), F.when(redacted, "[redacted user message]").otherwise("[user message unavailable]"))


def in_order(value: Column, keep: Column | None = None) -> Column:
    """Values of a group by line, without nulls; ``keep`` says which rows give one."""
    given = F.struct("line", value.alias("v"))
    pairs = F.array_sort(F.collect_list(given if keep is None else F.when(keep, given)))
    return F.filter(F.transform(pairs, lambda p: p.v), lambda v: v.isNotNull())


def rolled_up(turns: DataFrame, **flags: Column) -> DataFrame:
    """A row for each turn of ``grouped`` records; each of ``flags`` says whether it holds for any record of the turn."""
    kind = F.col("kind")
    dated = F.col("ts").isNotNull()
    return with_defaults(turns).groupBy("session_id", "turn_index", "turn_id").agg(
        F.get(in_order(prompt(F.col("text"), F.col("redacted")), kind == USER), F.lit(0)).alias("user_prompt"),
        F.array_distinct(in_order(F.col("text"), kind == ASSISTANT)).alias("assistant_messages"),
        F.count_if(kind.isin(TOOL_USE, TOOL_RESULT)).cast("int").alias("tool_stub_count"),
        F.array_distinct(F.flatten(in_order(F.col("files")))).alias("files_touched"),
        F.array_distinct(F.flatten(in_order(F.col("commands")))).alias("commands"),
        F.min_by("ts", F.when(dated, F.col("line"))).alias("started_at"),
        F.max_by("ts", F.when(dated, F.col("line"))).alias("ended_at"),
        F.min("line").alias("first_line"),
        F.max("line").alias("last_line"),
        F.count("*").alias("n_records"),
        *(F.bool_or(F.coalesce(f, F.lit(False))).alias(name) for name, f in flags.items()),
    )


def span(turns: DataFrame, events: DataFrame) -> DataFrame:
    """Per session: numbers of turns and events, first and last turn and line."""
    of_turns = turns.groupBy("session_id").agg(
        F.count("*").alias("turn_count"),
        F.min_by("turn_id", "turn_index").alias("first_turn_id"),
        F.max_by("turn_id", "turn_index").alias("last_turn_id"),
        F.min("first_line").alias("line_start"),
        F.max("last_line").alias("line_end"),
    )
    of_events = events.groupBy("session_id").agg(F.count("*").alias("event_count"))
    return of_turns.join(of_events, "session_id", "left").withColumn("event_count", F.coalesce("event_count", F.lit(0)))
