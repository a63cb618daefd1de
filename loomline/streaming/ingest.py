"""Incremental ingest with Structured Streaming: new lines by file, sessions and budgets by state.

``available_now`` takes up what has arrived since the last run and hands each micro-batch to an
idempotent upsert, so a replayed batch changes nothing. The stateful parts (``versions``,
``turns_as_they_come``, ``trailing_budgets``) keep a small state for each key in RocksDB, whose
changes are committed with the micro-batch; they need ``with_rocksdb`` before the query starts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from loomline.operators.costs import parse_window
from loomline.operators.turns import USER
from loomline.sources.artifacts import exists

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long records wait for their session's first user message, and spent amounts for late calls.
PATIENCE_MS, LATE = 7 * 86_400_000, "1 hour"


def with_rocksdb(spark: SparkSession) -> None:
    """State of keys in RocksDB for the queries that this session starts from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def available_now(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything that has arrived, once, and stop."""
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def keyed_upsert(path: str, keys: list[str], content: str | None = None, order: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """A batch writer that adds the rows whose keys the Parquet table at ``path`` lacks.

    With ``content`` (a hash), a row whose content differs from what stands under its keys is added
    too, as a newer version; ``latest`` gives the newest of each. Of several rows with equal keys in
    one micro-batch the last by ``order`` counts (without it by all other columns), so that a retry
    keeps the same one. Each micro-batch writes a folder of its own, named by its number, so a
    retried batch replaces what its first try left behind. Every batch reads the keys that stand;
    for long runs of small batches, filter by ``versions`` first, whose state does without that.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        first = [c for c in order or [] if c in rest]
        placed = F.struct(*first, *(c for c in rest if c not in first))
        fresh = batch.groupBy(*keys).agg(F.max(placed).alias("_v")).select(*keys, "_v.*").select(*batch.columns) if rest else batch.distinct()
        if exists(spark, path):
            held = spark.read.parquet(path).where(F.col("batch") < number)
            held = held.select(*keys).distinct() if content is None else latest(held, keys).select(*keys, content)
            fresh = fresh.join(held, keys if content is None else [*keys, content], "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version of each key in a table with a column batch."""
    value = F.struct(*(c for c in table.columns if c not in (*keys, "batch")))
    return table.groupBy(*keys).agg(F.max_by(value, "batch").alias("_v")).select(*keys, "_v.*")


def _joined(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True)


class _Versions(StatefulProcessor):
    """The content that stands under a key."""

    def __init__(self, content: str, order: str):
        self.content, self.order = content, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.standing = handle.getValueState("standing", "content string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = _joined(rows).sort_values([self.order, self.content], kind="stable")
        held = self.standing.get()[0] if self.standing.exists() else None
        said = frame[self.content].fillna("")
        changed = said != said.shift(fill_value="" if held is None else held)
        if held is None:
            changed.iloc[0] = True
        self.standing.update((said.iloc[-1],))
        yield frame[changed]


def versions(stream: DataFrame, keys: list[str], content: str, order: str) -> DataFrame:
    """The rows of a stream that bring a key's first content, or another than stood before, in ``order`` within a micro-batch.

    Each key's last content is kept for good, so nothing that stands is read again; a null content
    counts as an empty one. Rows come back with their columns.
    """
    return stream.groupBy(*keys).transformWithStateInPandas(_Versions(content, order), stream.schema, "append", "none")


class _Turns(StatefulProcessor):
    """How many user messages a session has had, and the lines that came before the first."""

    def __init__(self, at: str | None):
        self.at = at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asked = handle.getValueState("asked", "asked int")
        self.leading = handle.getListState("leading", "line long")

    def _forget(self) -> None:
        self.leading.clear()
        if self.at:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = _joined(rows).sort_values("line", kind="stable")
        before = self.asked.get()[0] if self.asked.exists() else 0
        upto = before + (frame["kind"] == USER).cumsum()
        if not upto.iloc[-1]:  # no user message yet
            if self.at and not self.leading.exists():
                last = int(frame[self.at].astype("datetime64[ms]").astype("int64").max())
                self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs()) + PATIENCE_MS)
            self.leading.appendList([(int(n),) for n in frame["line"]])
            return
        lines, turns = frame["line"].to_numpy(), upto.clip(lower=1).to_numpy() - 1
        if not before:
            waited = [row[0] for row in self.leading.get()] if self.leading.exists() else []
            lines, turns = np.concatenate([np.array(waited, np.int64), lines]), np.concatenate([np.zeros(len(waited), np.int64), turns])
            self._forget()
        self.asked.update((int(upto.iloc[-1]),))
        yield pd.DataFrame({"session_id": key[0], "line": lines, "turn_index": turns.astype("int32")})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._forget()
        return iter(())


def turns_as_they_come(records: DataFrame, at: str | None = None, late: str = LATE) -> DataFrame:
    """session_id, line, turn_index of records as they arrive, in order of lines within a micro-batch.

    Records before a session's first user message wait until it comes and belong to turn 0, as in
    batch; a session that never asks gives no rows. With ``at`` (a column of event times, from which
    records later than ``late`` are dropped) what waits goes after ``PATIENCE_MS`` of event time,
    without it never.
    """
    columns = ["session_id", "line", "kind", *([at] if at else [])]
    rows = (records.withWatermark(at, late) if at else records).select(*columns).groupBy("session_id")
    return rows.transformWithStateInPandas(_Turns(at), "session_id string, line long, turn_index int", "append", "eventTime" if at else "none")


class _Trailing(StatefulProcessor):
    """Times and amounts of a key's uses that a window may still reach."""

    def __init__(self, columns: list[str], at: str, amount: str | None, most: float, seconds: int):
        self.columns, self.at, self.amount, self.most, self.micros = columns, at, amount, most, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.uses = handle.getListState("uses", "at long, amount double")

    def _held(self, watermark_ms: int) -> tuple[np.ndarray, np.ndarray]:
        rows = [r for r in self.uses.get() if r[0] >= watermark_ms * 1000 - self.micros] if self.uses.exists() else []
        return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)

    def _keep(self, times: np.ndarray, amounts: np.ndarray) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if len(times):
            self.uses.put([(int(t), float(a)) for t, a in zip(times, amounts, strict=True)])
            self.handle.registerTimer(int(times.max() + self.micros) // 1000 + 1)
        else:
            self.uses.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = _joined(rows)
        at = frame[self.at].astype("datetime64[us]").astype("int64").to_numpy()
        amount = np.ones(len(frame)) if self.amount is None else frame[self.amount].astype(float).fillna(0.0).to_numpy()
        old_times, old_amounts = self._held(timerValues.getCurrentWatermarkInMs())
        times, amounts = np.concatenate([old_times, at]), np.concatenate([old_amounts, amount])
        order = np.argsort(times, kind="stable")
        times, amounts = times[order], amounts[order]
        upto = np.concatenate([[0.0], np.cumsum(amounts)])
        used = upto[np.searchsorted(times, at, "right")] - upto[np.searchsorted(times, at - self.micros, "left")]
        self._keep(times, amounts)
        yield frame[self.columns].assign(used=used, remaining=np.maximum(0.0, self.most - used), allowed=used < self.most)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._keep(*self._held(timerValues.getCurrentWatermarkInMs()))
        return iter(())


def trailing_budgets(uses: DataFrame, spec: str, at: str, by: list[str], amount: str | None = None, late: str = LATE) -> DataFrame:
    """A stream of uses with used, remaining and allowed, as ``costs.trailing`` has them of all uses that came so far.

    used is a true sliding count (or sum of a known ``amount``) over the window that ends at each
    use, ends included. A use that is late by less than ``late`` counts for itself and for what
    comes after it; rows already given stay as they are. A key keeps the uses of one window and
    the lateness, and nothing once a window has passed without any.
    """
    most, seconds = parse_window(spec)
    schema = T.StructType([*uses.schema.fields, *T._parse_datatype_string("used double, remaining double, allowed boolean").fields])
    timed = uses.where(F.col(at).isNotNull()).withWatermark(at, late)
    return timed.groupBy(*by).transformWithStateInPandas(_Trailing(uses.columns, at, amount, most, seconds), schema, "append", "eventTime")


def spend_by_window(calls: DataFrame, window: str = "24 hours", late: str = LATE) -> DataFrame:
    """Calls and known cost per window of event time, final once the watermark has passed."""
    return calls.withWatermark("created_at", late).groupBy(F.window("created_at", window)).agg(F.count("*").alias("calls"), F.sum(F.when(F.col("cost_known"), F.col("cost"))).alias("cost"))
