"""Long-lived records ("instincts"): folding deltas, confidence and maturity, promotion, rollups.

Observations are rows (instinct columns, ``at`` timestamp, ``ord``, ``reinforcing``); state is an
aggregate over them. Deltas fold in a closed form of running sums; only ids that merges connect,
and records revived after they had sunk, need their order replayed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import confidence as conf
from loomline.functions.identity import record_id
from loomline.operators.components import components
from loomline.sources.scratch import stored

# Fixed values.
LEVELS = {"high": 0.7, "medium": 0.55, "low": 0.4}
DOMAINS = {"verification_rule": "testing", "failure_mode": "debugging", "pattern": "code-style", "preference": "tooling", "dead_end": "debugging"}
MIN_PROJECTS, MIN_AVERAGE, MIN_AGE_DAYS, JUDGE_CONFIDENCE = 2, 0.8, 14, 0.7
PAGE_LINES, HEADER_LINES = 200, 9


def _mapped(c: Column, values: dict, other) -> Column:
    out = F.when(F.lit(False), F.lit(other))
    for k, v in values.items():
        out = out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(other))


def to_deltas(learnings: DataFrame) -> DataFrame:
    """Create deltas of reviewed learnings (kind, title, trigger, statement, confidence)."""
    trigger = F.when(F.length(F.trim("trigger")) > 0, F.trim("trigger")).otherwise(F.trim("title"))
    finding = F.trim("statement")
    made = {
        "op": F.lit("create"),
        "instinct_id": record_id(trigger, finding),
        "trigger": trigger,
        "finding": finding,
        "domain": _mapped(F.col("kind"), DOMAINS, "workflow"),
        "initial_confidence": F.greatest(F.lit(conf.LOWEST), _mapped(F.col("confidence"), LEVELS, conf.LOWEST)),
    }
    return learnings.withColumns(made)


def state(observations: DataFrame, keys: list[str], now: Column, floor: Column) -> DataFrame:
    """Confidence, counts, age and maturity of each record at ``now``, from its observations.

    ``floor`` is an aggregate-able column of the rows (the same on all rows of a record).
    """
    days = conf.days_between(F.col("at"), now)
    order = F.array_sort(F.collect_list(F.struct("at", "ord", "reinforcing")))
    sums = observations.groupBy(*keys).agg(
        conf.clamped(F.first(floor) + F.sum(conf.contribution(F.col("reinforcing"), days))).alias("confidence"),
        F.max(days).alias("age_days"),
        F.count_if("reinforcing").alias("reinforcing_count"),
        F.count_if(~F.col("reinforcing")).alias("correction_count"),
        conf.survived(F.transform(order, lambda o: o.reinforcing)).alias("survived_contradiction"),
    )
    return sums.withColumn("maturity", conf.proposed(F.col("confidence"), F.col("age_days"), F.col("reinforcing_count"), F.col("survived_contradiction")))


def reached(observations: DataFrame, keys: list[str], floor: Column) -> DataFrame:
    """keys and eligible_at: the first observation at which a record is established or proven.

    Decay is re-based at every observation. With the sum S of contributions aged to the first
    observation, the value at a later one is floor + S * 2 ** -(days since the first) / 90, so a
    running sum serves all prefixes. Equal times count together with their order. A prefix that
    falls to the lowest confidence deprecates the record until it is above 0.4 again; the maturity
    of a prefix thus depends on the last prefix that crossed either bound.
    """
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("at", "ord").rowsBetween(Window.unboundedPreceding, 0)
    since = conf.days_between(F.min("at").over(whole), F.col("at"))
    grown = F.when(F.col("reinforcing"), F.lit(conf.GAIN)).otherwise(F.lit(-conf.LOSS)) * F.pow(F.lit(2.0), F.col("_since") / conf.HALF_LIFE_DAYS)
    rows = observations.withColumns({"_since": since, "_floor": floor})
    rows = rows.withColumn("_value", conf.clamped(F.col("_floor") + F.sum(grown).over(upto) * F.pow(F.lit(0.5), F.col("_since") / conf.HALF_LIFE_DAYS)))
    first_loss = F.min(F.when(~F.col("reinforcing"), F.struct("at", "ord"))).over(upto)
    rows = rows.withColumns({"_gains": F.count_if("reinforcing").over(upto), "_loss": first_loss})
    after = F.count_if(F.col("reinforcing") & F.col("_loss").isNotNull()).over(upto)
    rows = rows.withColumn("_survived", after >= 2)
    edge = F.when(F.col("_value") < conf.LOWEST + 0.001, F.lit(True)).when(F.col("_value") > conf.LOWEST + 0.1, F.lit(False))
    # Between the bounds a record stays as it was; the prefix that brings it back is a candidate still.
    rows = rows.withColumn("_down", F.coalesce(F.last(edge, ignorenulls=True).over(whole.orderBy("at", "ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    level = conf.proposed(F.col("_value"), F.col("_since"), F.col("_gains"), F.col("_survived"), F.col("_down"))
    good = rows.where(level.isin("established", "proven"))
    return good.groupBy(*keys).agg(F.min("at").alias("eligible_at"))


def promotion_queue(instincts: DataFrame, now: Column) -> DataFrame:
    """Records of two projects or more whose mean confidence is 0.8 and of which one has been eligible for 14 days.

    ``instincts``: instinct_id, project_id, confidence, maturity, scope, updated_at, eligible_at.
    """
    latest = Window.partitionBy("instinct_id", "project_id").orderBy(F.desc("updated_at"))
    own = instincts.where("scope = 'project' and maturity <> 'deprecated'").withColumn("_n", F.row_number().over(latest)).where("_n = 1")
    old = F.col("maturity").isin("established", "proven") & (conf.days_between(F.col("eligible_at"), now) >= MIN_AGE_DAYS)
    sums = own.groupBy("instinct_id").agg(
        F.avg("confidence").alias("avg_confidence"),
        F.count("*").alias("project_count"),
        F.bool_or(F.coalesce(old, F.lit(False))).alias("aged"),
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "project_id"))), lambda p: p.project_id).alias("projects"),
    )
    return sums.where((F.col("project_count") >= MIN_PROJECTS) & (F.col("avg_confidence") >= MIN_AVERAGE) & F.col("aged")).drop("aged")


def judge_pool(instincts: DataFrame, promoted: DataFrame | None = None) -> DataFrame:
    """The strongest occurrence of each confident record, and in how many projects it is confident."""
    pool = instincts.where((F.col("scope") == "project") & (F.col("maturity") != "deprecated") & (F.col("confidence") >= JUDGE_CONFIDENCE))
    if promoted is not None:
        pool = pool.join(promoted.select("instinct_id"), "instinct_id", "left_anti")
    best = F.min_by(F.struct("confidence", "maturity", "project_id"), F.struct(-F.col("confidence"), F.col("project_id")))
    return pool.groupBy("instinct_id").agg(best.alias("b"), F.count("*").alias("project_count")).select("instinct_id", "b.*", "project_count")


def in_rollup() -> Column:
    """Whether a record is shown: proven ones, established ones from 0.7 and candidates from 0.6."""
    level, value = F.col("maturity"), F.col("confidence")
    return (level == "proven") | ((level == "established") & (value >= 0.7)) | ((level == "candidate") & (value >= 0.6))


def reachability(instincts: DataFrame) -> DataFrame:
    """One row: records of projects produced, shown and their ratio; projects, those with a shown record; global ones."""
    own = F.col("scope") == "project"
    sums = instincts.groupBy(F.when(own, F.col("project_id")).alias("p"), own.alias("own")).agg(F.count("*").alias("n"), F.count_if(in_rollup()).alias("r"))

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    out = sums.agg(
        total(F.when(F.col("own"), F.col("n"))).alias("produced"),
        total(F.when(F.col("own"), F.col("r"))).alias("reachable"),
        F.count_if("own").alias("projects_total"),
        F.count_if(F.col("own") & (F.col("r") > 0)).alias("projects_with_reachable"),
        total(F.when(~F.col("own"), F.col("n"))).alias("global_produced"),
        total(F.when(~F.col("own"), F.col("r"))).alias("global_reachable"),
    )
    return out.withColumn("reachable_ratio", F.when(F.col("produced") > 0, F.round(F.col("reachable") / F.col("produced"), 4)).otherwise(F.lit(0.0)))


def latest_by_id(instincts: DataFrame) -> DataFrame:
    """The newest record of each id over all scopes; of equal times the project's."""
    newest = Window.partitionBy("instinct_id").orderBy(F.desc("updated_at"), F.when(F.col("scope") == "project", 0).otherwise(1))
    return instincts.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def rollup_pages(instincts: DataFrame, page_lines: int = PAGE_LINES, header_lines: int = HEADER_LINES) -> DataFrame:
    """Shown records of each project by domain, confidence and id; what comes after the page's last line spills."""
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("domain", F.desc("confidence"), "instinct_id"))
    return instincts.where(in_rollup()).withColumn("place", place).withColumn("included", F.col("place") + header_lines <= page_lines)


FOLDED = "project_id string, instinct_id string, trigger string, finding string, domain string, confidence_floor double, deprecated boolean, observations array<struct<session: string, reinforcing: boolean, at: timestamp>>, updated_at timestamp"


DELTA = ["project_id", "session_id", "at", "pos", "op", "instinct_id", "trigger", "finding", "domain", "initial_confidence", "correction", "into"]


def connected(deltas: DataFrame) -> DataFrame:
    """``deltas`` with _group: the ids of a project that merges tie together, directly or through others, share one."""
    own, into = (F.to_json(F.struct("project_id", c)) for c in (F.col("instinct_id"), F.col("into").alias("instinct_id")))
    links = deltas.where("op = 'merge' and into is not null").select(own.alias("a"), into.alias("b"))
    tied = components(links).select(F.col("node").alias("_node"), "component")
    return deltas.withColumn("_node", own).join(tied, "_node", "left").withColumn("_group", F.coalesce("component", "_node")).drop("_node", "component")


KEY = ["project_id", "instinct_id"]


def split(deltas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The deltas of ids that no merge names, and those of the others, by connected group."""
    both = deltas.where("op = 'merge'").select("project_id", F.explode(F.array("instinct_id", "into")).alias("instinct_id")).where("instinct_id is not null").distinct()
    named = stored(both, "merged")
    return deltas.join(named, KEY, "left_anti"), connected(deltas.join(named, KEY, "left_semi"))


def traced(deltas: DataFrame) -> DataFrame:
    """Deltas of ids without merges from their creation on, with what became of each.

    An explicit state (deprecate, revive) holds until the next. Observations outside deprecation
    are accepted until the record sinks: until the floor and all contributions, aged to the last
    one, reach the lowest confidence. As ageing is a common factor, a running sum of contributions
    that are grown to the record's creation serves every prefix. ``again`` marks records revived
    after they had sunk, for which what counts later depends on what counted before.
    """
    upto = Window.partitionBy(*KEY).orderBy("at", "pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*KEY).orderBy("at", "pos").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*KEY)
    first = F.min(F.when(F.col("op") == "create", F.struct("at", "pos"))).over(whole)
    rows = deltas.withColumn("_first", first).where(F.struct("at", "pos") >= F.col("_first"))
    closed = F.last(F.when(F.col("op").isin("deprecate", "revive"), F.col("op") == "deprecate"), ignorenulls=True).over(upto)
    opened = F.greatest(F.lit(conf.LOWEST), F.least(F.lit(conf.HIGHEST), F.first("initial_confidence").over(whole.orderBy("at", "pos"))))
    rows = rows.withColumns({"_closed": F.coalesce(closed, F.lit(False)), "_floor": opened, "_observes": F.col("op").isin("create", "reinforce", "correct")})
    days = conf.days_between(F.col("_first.at"), F.col("at"))
    offered = F.col("_observes") & ~F.col("_closed")
    amount = F.when(F.col("op") == "correct", F.lit(-conf.LOSS)).otherwise(F.lit(conf.GAIN))
    grown = F.when(offered, amount * F.pow(F.lit(2.0), days / conf.HALF_LIFE_DAYS)).otherwise(0.0)
    value = F.col("_floor") + F.sum(grown).over(upto) * F.pow(F.lit(0.5), days / conf.HALF_LIFE_DAYS)
    rows = rows.withColumn("_sinks", offered & (value < conf.LOWEST + 0.001))
    sunk = F.coalesce(F.bool_or("_sinks").over(before), F.lit(False))
    rows = rows.withColumn("_sunk", sunk).withColumn("accepted", offered & ~F.col("_sunk"))
    return rows.withColumn("again", F.bool_or((F.col("op") == "revive") & F.col("_sunk")).over(whole))


def closed_form(trace: DataFrame) -> DataFrame:
    """Records from ``traced`` deltas that were never revived after they had sunk."""
    order, correct = F.struct("at", "pos"), F.col("op") == "correct"
    taken = F.when(F.col("accepted"), F.struct("at", "pos", "session_id", (~correct).alias("reinforcing")))
    said = F.when(F.col("accepted") & correct, F.struct(order.alias("o"), F.struct(F.col("correction").alias("f")).alias("v")))
    begun = F.when(order == F.col("_first"), F.struct("trigger", "finding", "domain"))
    sums = trace.groupBy(*KEY).agg(
        F.first(begun, ignorenulls=True).alias("b"),
        F.first("_floor").alias("confidence_floor"),
        (F.bool_or("_sinks") | F.max_by("_closed", order)).alias("deprecated"),
        F.array_sort(F.collect_list(taken)).alias("taken"),
        F.max(said).alias("said"),
        F.max(F.when(F.col("accepted") | ~F.col("_observes"), F.col("at"))).alias("updated_at"),
    )
    finding = F.when(F.col("said").isNull(), F.col("b.finding")).otherwise(F.col("said.v.f"))
    seen = F.transform("taken", lambda o: F.struct(o.session_id.alias("session"), o.reinforcing.alias("reinforcing"), o.at.alias("at")))
    return sums.select(*KEY, "b.trigger", finding.alias("finding"), "b.domain", "confidence_floor", "deprecated", seen.alias("observations"), "updated_at")


def fold(deltas: DataFrame) -> DataFrame:
    """Records of each project after replaying its deltas in the order of (at, pos).

    ``deltas``: project_id, session_id, at, pos (of any type that has an order), op, instinct_id,
    trigger, finding, domain, initial_confidence, correction, into. Six operations: create (again:
    reinforce), reinforce, correct (new finding), deprecate, merge (observations and the higher
    floor move to the target, the source goes even without one), revive. A deprecated record
    ignores observations.

    Ids that no merge names fold in SQL (``traced``, ``closed_form``). Only deltas of merged ids,
    by connected group, and of records revived after they had sunk are replayed in Python.
    """
    free, tied = split(deltas)
    trace = traced(free)
    fields = [c for c in deltas.columns if c in DELTA]
    late = trace.where("again").select(*fields, F.col("instinct_id").alias("_group"))
    turn = F.row_number().over(Window.partitionBy("project_id", "_group").orderBy("at", "pos"))
    replay = tied.select(*fields, "_group").unionByName(late).withColumn("pos", turn)
    return closed_form(trace.where("not again")).unionByName(replay.groupBy("project_id", "_group").applyInPandas(_replayed, FOLDED))


def _aged(row: dict, now: pd.Timestamp) -> float:
    """The sum of a record's contributions aged to ``now``, which one multiplication carries on from the last time."""
    days = max(0.0, (now - row["_at"]) / pd.Timedelta(days=1))
    return row["_sum"] * 0.5 ** (days / conf.HALF_LIFE_DAYS)


def _move(row: dict, now: pd.Timestamp, more: float) -> None:
    """Age a record to ``now``, add ``more``, and see whether it falls to the lowest confidence."""
    row |= {"_sum": _aged(row, now) + more, "_at": now, "updated_at": now}
    row["deprecated"] = max(conf.LOWEST, row["confidence_floor"] + row["_sum"]) < conf.LOWEST + 0.001


def _replayed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The replay of one group; a small state machine over its deltas."""
    held: dict[str, dict] = {}

    def observe(name: str, d, reinforcing: bool) -> None:
        row = held.get(name)
        if row is None or row["deprecated"]:
            return
        row["observations"].append({"session": d.session_id, "reinforcing": reinforcing, "at": d.at})
        _move(row, d.at, conf.GAIN if reinforcing else -conf.LOSS)
        if not reinforcing:
            row["finding"] = d.correction

    for d in pdf.sort_values("pos").itertuples():
        name, row = d.instinct_id, held.get(d.instinct_id)
        if d.op == "create" and row is None:
            floor = min(conf.HIGHEST, max(conf.LOWEST, d.initial_confidence))
            held[name] = {"trigger": d.trigger, "finding": d.finding, "domain": d.domain, "confidence_floor": floor, "deprecated": False, "updated_at": d.at, "observations": [{"session": d.session_id, "reinforcing": True, "at": d.at}], "_sum": conf.GAIN, "_at": d.at}
        elif d.op in ("create", "reinforce"):
            observe(name, d, True)
        elif d.op == "correct":
            observe(name, d, False)
        elif d.op in ("deprecate", "revive") and row is not None:
            row |= {"deprecated": d.op == "deprecate", "updated_at": d.at}
        elif d.op == "merge":
            target = held.get(d.into)
            if row is not None and target is not None and not target["deprecated"]:
                target["observations"] += row["observations"]
                target["confidence_floor"] = max(target["confidence_floor"], row["confidence_floor"])
                _move(target, d.at, _aged(row, d.at))
            held.pop(name, None)
    rows = [{"project_id": pdf["project_id"].iloc[0], "instinct_id": k, **v} for k, v in held.items()]
    return pd.DataFrame(rows, columns=["project_id", "instinct_id", "trigger", "finding", "domain", "confidence_floor", "deprecated", "observations", "updated_at"])
