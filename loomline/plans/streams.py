"""Queries that take the tables up as streams: what has arrived is processed once, with state by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.plans.registry import Tables, query
from loomline.sources import transcripts
from loomline.sources.scratch import new_path
from loomline.streaming import ingest


def streamed(t: Tables, name: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``make`` gives of a table's files as a stream, written by the file sink and read back."""
    root = new_path(t.spark, "stream")
    ingest.with_rocksdb(t.spark)
    # As a pattern, which serves a table in one file as well as a folder of files.
    made = make(t.spark.readStream.schema(getattr(t, name).schema).parquet(f"{t.sf_dir}/{name}.parque[t]"))
    run = made.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return t.spark.read.schema(made.schema).parquet(f"{root}/out")


@query(
    """select event_id, used, greatest(0.0, 8.0 - used) as remaining, used < 8 as allowed
    from (select event_id, cast(count(*) over (partition by user_id order by epoch_us(ts) range between 172800000000 preceding and current row) as double) as used from events)"""
)
def t4_trailing_budgets(t: Tables) -> DataFrame:
    """Every user's events against a budget of 8 in 48 hours, as they come."""

    def make(stream: DataFrame) -> DataFrame:
        uses = stream.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("at"))
        return ingest.trailing_budgets(uses, "8/48h", "at", ["user_id"]).select("event_id", "used", "remaining", "allowed")

    return streamed(t, "events", make)


@query(
    """with u as (select conv_id, turn, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) as upto, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id) as n from conversations)
    select cast(conv_id as varchar) as session_id, turn as line, cast(greatest(upto, 1) - 1 as bigint) as turn_index from u where n > 0"""
)
def t5_turns_as_they_come(t: Tables) -> DataFrame:
    """The turn of every message of a conversation, numbered as the messages come."""
    out = streamed(t, "conversations", lambda stream: ingest.turns_as_they_come(transcripts.of_conversations(stream)))
    return out.select("session_id", "line", F.col("turn_index").cast("long").alias("turn_index"))
