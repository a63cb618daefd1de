"""Mixing sources to target weights by Pfair scheduling of blocks.

A source's documents, in a fixed shuffled order, are cut into blocks of equal size. Block j of a
source with weight w (weights sum to 1, as exact fractions of the numbers given) is released at
floor(j / w) and due at ceil((j + 1) / w); in each slot the released block with the earliest
deadline goes next. No deadline is missed, so at every slot a source has had less than one block
more or less than its weight's share.

A phase ends at the first slot in which some weighted source has had all its blocks; the next one
holds the weights of those that remain, and begins anew. Only phase ends are planned on the driver,
from the weights and numbers of blocks of the sources. Within a phase, frames of slots are planned
by tasks on their own: at the slot where a frame begins, a source has had either the floor or the
ceiling of its share. Which of them is a rounding of all sources' fractions at once, by which in
order of release as well as in order of deadline each number of sources gets what their fractions
sum to, rounded down or up. Of windows that end or begin within a range of slots, there are then
never more than the range has slots, so each frame has a schedule, and its earliest deadlines find
it. A frame is longer than any window, so that a block meets one beginning of a frame at most.
Sources without a weight come last, in proportion to their blocks. No row is dropped or repeated.

Running sizes are summed in two levels (buckets of a source, then rows of a bucket), so that a
source with a third of all rows never meets in one task.

Defined cases: a null source is a source of its own; a null size counts as 0, and a block starts
where the size before a row says, so a row longer than a block takes up the blocks it covers; rows
that agree in id and size may swap places; sources without a weight (none given, or not above 0)
wait for the last phase; an empty table gives an empty table; other columns are passed through,
and the columns block, slot and start of the result replace columns of those names.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import stored

BLOCK = 1 << 16
ROWS_PER_BUCKET = 4096
#: Slots of a frame, which one task plans in about a tenth of a second; more where a window is longer.
FRAME = 1 << 16
#: Planned slots, in rows of about 50 bytes, up to which they are broadcast; beyond it the join is shuffled.
MAX_PLANNED = 100_000
MAX_TASKS, ROWS = 2_000, 1 << 14


def whole(shares: dict) -> dict:
    """Whole numbers in exactly the proportions of the weights above 0."""
    exact = {s: Fraction(w) for s, w in shares.items() if w > 0}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    numbers = {s: int(w * scale) for s, w in exact.items()}
    common = math.gcd(*numbers.values())
    return {s: n // common for s, n in numbers.items()}


@dataclass
class Phase:
    """``weights`` (whole numbers), ``first`` (blocks had before) and ``had`` (blocks of this phase) of ``sources``, over ``length`` slots from ``slot`` in frames."""

    sources: list
    weights: list[int]
    first: list[int]
    had: list[int]
    slot: int
    length: int
    frame: int

    @property
    def frames(self) -> int:
        return max(1, self.length // self.frame)  # the last one takes the rest

    def begun(self, at: int) -> list[int]:
        """How many blocks of this phase each source has had before its slot ``at``, the beginning of a frame or the end."""
        if at >= self.length:
            return self.had
        total = sum(self.weights)
        done = [divmod(w * at, total) for w in self.weights]
        open_ = [(i, rest, n * total // self.weights[i], -(-(n + 1) * total // self.weights[i])) for i, (n, rest) in enumerate(done) if rest]
        up = rounded_up(open_, total)
        return [n + (i in up) for i, (n, _) in enumerate(done)]

    def planned(self, k: int) -> Iterator[tuple[int, int, int]]:
        """slot, place of the source and block of each slot of frame ``k``, earliest deadlines first."""
        low, high = k * self.frame, self.length if k + 1 == self.frames else (k + 1) * self.frame
        turn, last, total = list(self.begun(low)), self.begun(high), sum(self.weights)
        waiting: list[tuple[int, int]] = []
        ready: list[tuple[int, int]] = []
        for i, w in enumerate(self.weights):
            if turn[i] < last[i]:
                waiting.append((max(low, turn[i] * total // w), i))
        heapq.heapify(waiting)
        for at in range(low, high):
            while waiting and waiting[0][0] <= at:
                i = heapq.heappop(waiting)[1]
                heapq.heappush(ready, (min(high, -(-(turn[i] + 1) * total // self.weights[i])), i))
            due, i = heapq.heappop(ready)
            if due <= at:
                raise AssertionError("a block missed its deadline")
            yield self.slot + at, i, self.first[i] + turn[i]
            turn[i] += 1
            if turn[i] < last[i]:
                heapq.heappush(waiting, (turn[i] * total // self.weights[i], i))


def rounded_up(items: list[tuple[int, int, int, int]], total: int) -> set[int]:
    """Which of the items (number, part of ``total``, release, deadline) count whole, the others not at all.

    The parts sum to a multiple of the total. Laid end to end from the latest release on, they fill
    as many cells of size ``total`` as items are to count, and likewise from the earliest deadline
    on. Each cell of either line gets one of the items that reach into it: a flow of whole numbers
    from the first line's cells over the items to the second line's, which the parts themselves show
    to exist. So the items up to any place of either line count as many as their parts, rounded.
    """

    def cells(order: list) -> dict[int, range]:
        out, at = {}, 0
        for number, part, *_ in order:
            out[number] = range(at // total, (at + part - 1) // total + 1)
            at += part
        return out

    left = cells(sorted(items, key=lambda x: (-x[2], x[0])))
    right = cells(sorted(items, key=lambda x: (x[3], x[0])))
    # Steps that are open; taking one opens the way back. Kept in order, so that every task finds the same.
    ways: dict = defaultdict(dict)
    for number, *_ in items:
        ways["in", number]["out", number] = None
        for cell in left[number]:
            ways["left", cell]["in", number] = None
        for cell in right[number]:
            ways["out", number]["right", cell] = None
            ways["right", cell]["end"] = None
    for cell in range(sum(x[1] for x in items) // total):
        came: dict = {("left", cell): None}
        queue = deque(came)
        while "end" not in came:
            node = queue.popleft()
            for step in ways[node]:
                if step not in came:
                    came[step] = node
                    queue.append(step)
        step = "end"
        while (node := came[step]) is not None:
            del ways[node][step]
            ways[step][node] = None
            step = node
    return {number for number, *_ in items if ("in", number) in ways["out", number]}


def ended(weights: list[int], left: list[int]) -> tuple[int, list[int]]:
    """Length of a phase, which ends with the slot in which the first source has had all of ``left``, and what each has had by then."""
    total = sum(weights)
    length = min(-(-n * total // w) for n, w in zip(left, weights, strict=True))
    had, open_, over = [], [], 0
    for i, (w, n) in enumerate(zip(weights, left, strict=True)):
        done, rest = divmod(w * length, total)
        if done >= n:  # done within the last slot, whose remainder goes to others
            over += w * length - n * total
        elif rest:
            open_.append([i, rest, done * total // w])
        had.append(min(done, n))
    for item in open_:
        more = min(over, total - item[1])
        item[1] += more
        over -= more
    at = 0
    for i, rest, _ in sorted(open_, key=lambda x: (-x[2], x[0])):
        had[i] += (at + rest) // total - at // total
        at += rest
    return length, had


def phases(blocks: dict, shares: dict) -> list[Phase]:
    """The phases that place all ``blocks`` (by source), with weights in proportion to ``shares`` while they last."""
    left, done, out, slot = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), [], 0
    numbers = whole({s: w for s, w in shares.items() if s in left})
    while left:
        sources = sorted((s for s in left if s in numbers), key=str) or sorted(left, key=str)
        weights = [numbers[s] if s in numbers else left[s] for s in sources]
        length, had = ended(weights, [left[s] for s in sources])
        window = -(-sum(weights) // min(weights)) + 1
        out.append(Phase(sources, weights, [done[s] for s in sources], had, slot, length, max(FRAME, window)))
        slot += length
        for s, n in zip(sources, had, strict=True):
            done[s] += n
            left[s] -= n
            if not left[s]:
                del left[s]
    return out


def planned(spark: SparkSession, plan: list[Phase]) -> DataFrame:
    """_source, block and slot of every block, planned in frames by tasks."""
    if not plan:
        return spark.createDataFrame([], "_source string, block long, slot long")
    shared = spark.sparkContext.broadcast(plan)  # a few numbers a source and phase
    firsts = [0, *accumulate(p.frames for p in plan)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                k = bisect_right(firsts, number) - 1
                phase = shared.value[k]
                slots = phase.planned(number - firsts[k])
                names = pa.array(phase.sources, pa.string())
                while rows := list(islice(slots, ROWS)):
                    slot, source, block = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([names.take(source), block, slot], names=["_source", "block", "slot"])

    frames = spark.range(0, firsts[-1], 1, min(firsts[-1], MAX_TASKS))
    return frames.mapInArrow(run, "_source string, block long, slot long")


def placed(rows: DataFrame, block_size: int) -> DataFrame:
    """``rows`` (with _source, _id, _size) with start (size before a row in its source) and block."""
    counts = rows.groupBy("_source").agg(F.ceil(F.count("*") / F.lit(ROWS_PER_BUCKET)).alias("_buckets"))
    # The whole row decides the place, so that rows that share an id, or have none, spread as well.
    order = F.xxhash64("_id", *(f"`{f.name}`" for f in rows.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))))
    dealt = rows.join(stored(counts, "counts"), "_source").withColumn("_bucket", F.pmod(order, "_buckets")).drop("_buckets")
    sums = dealt.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_sum"))
    earlier = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = stored(sums.select("_source", "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")), "before")
    within = Window.partitionBy("_source", "_bucket").orderBy(order, "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("_in", F.coalesce(F.sum("_size").over(within), F.lit(0))).join(before, ["_source", "_bucket"])
    return out.withColumn("start", F.col("_before") + F.col("_in")).withColumn("block", F.floor(F.col("start") / F.lit(block_size)).cast("long")).drop("_bucket", "_before", "_in")


def mix(documents: DataFrame, size: Column, shares: dict | None = None, block_size: int = BLOCK, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``documents`` with start, block and slot; order by slot and start to read the mixture.

    ``shares`` gives target weights by source; without it they are the square roots of the sources'
    total sizes, which lifts small sources without exhausting them at once.
    """
    spark = documents.sparkSession
    kept = documents.select(*(f"`{c}`" for c in documents.columns if c.lower() not in ("start", "block", "slot")))
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("-"))
    rows = kept.withColumns({"_source": name, "_id": F.col(f"`{doc_id}`").cast("long"), "_size": F.coalesce(size.cast("long"), F.lit(0))})
    # A row for each source: its last start is below its total size.
    totals = {r[0]: r[1] for r in rows.groupBy("_source").agg(F.sum("_size")).collect()}
    blocks = {s: n // block_size + 1 for s, n in totals.items()}
    wanted = {s: max(n, 1) ** 0.5 for s, n in totals.items()} if shares is None else {("-" if s is None else f"={s}"): w for s, w in shares.items()}
    slots = planned(spark, phases(blocks, wanted))
    if sum(blocks.values()) <= MAX_PLANNED:
        slots = F.broadcast(slots)
    # By source and block, since many rows share a source.
    found = placed(rows, block_size).join(slots, ["_source", "block"])
    return found.select(*(f"`{c}`" for c in kept.columns), "start", "block", "slot")


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows laid out as mixed: partitions, and rows in them, follow the slots."""
    return mixed.repartitionByRange("slot", "start").sortWithinPartitions("slot", "start")
