"""Costs of model calls: the report, trailing budgets, and how a batch's usage is split."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6
_UNITS = {"h": 3600, "m": 60}


def parse_window(spec: str) -> tuple[float, int]:
    """Amount and seconds of a window like ``50/24h`` or ``0.5/90m``."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)/([1-9]\d*)([hm])", spec.strip())
    if not m:
        raise ValueError(f"a window is amount/number and h or m, like 50/24h; not {spec!r}")
    return float(m[1]), int(m[2]) * _UNITS[m[3]]


def totals(calls: DataFrame) -> DataFrame:
    """One row: calls, requests (a batch member counts 1 / batch_size), cache hits and rate, known cost, token means.

    ``calls``: session_id, operation, cost, cost_known, cost_source, cache_hit, batch_size,
    input_tokens, output_tokens, learning_id.
    """
    real, known = ~F.col("cache_hit"), F.col("cost_known")
    share = 1.0 / F.greatest(F.lit(1), F.coalesce("batch_size", F.lit(1)))
    reviewed = known & (F.col("operation") == "learning_review") & F.col("learning_id").isNotNull()

    def cost(on: Column) -> Column:
        return F.coalesce(F.sum(F.when(on, F.coalesce("cost", F.lit(0.0)))), F.lit(0.0))

    return calls.agg(
        F.count("*").alias("calls"),
        F.count_if(real).alias("real_calls"),
        F.round(F.coalesce(F.sum(F.when(real, share)), F.lit(0.0)), DIGITS).alias("http_calls"),
        F.count_if(~real).alias("cache_hits"),
        F.round(F.when(F.count("*") > 0, F.count_if(~real) / F.count("*")).otherwise(0.0), DIGITS).alias("cache_hit_rate"),
        F.count_if(real & ~known).alias("unknown_cost_calls"),
        F.round(cost(known), DIGITS).alias("total_cost"),
        F.round(F.when(F.count_if(reviewed) > 0, cost(reviewed) / F.count_if(reviewed)).otherwise(0.0), DIGITS).alias("cost_per_learning"),
        *(F.round(F.avg(F.when(known, F.col(c))), DIGITS).alias(f"{c}_mean") for c in ("input_tokens", "output_tokens")),
    )


def by_operation(calls: DataFrame) -> DataFrame:
    return calls.where("cost_known").groupBy("operation").agg(F.round(F.sum(F.coalesce("cost", F.lit(0.0))), DIGITS).alias("cost"))


def by_cost_source(calls: DataFrame) -> DataFrame:
    return calls.groupBy("cost_source").agg(F.count("*").alias("calls"))


def per_session(calls: DataFrame) -> DataFrame:
    """One row: spread of the known cost of sessions, with percentiles interpolated linearly."""
    sums = calls.where("cost_known").groupBy("session_id").agg(F.sum(F.coalesce("cost", F.lit(0.0))).alias("c"))
    spread = {"mean": F.avg("c"), "p50": F.percentile("c", 0.5), "p90": F.percentile("c", 0.9), "max": F.max("c")}
    return sums.agg(F.count("*").alias("sessions"), *(F.round(F.coalesce(v, F.lit(0.0)), DIGITS).alias(k) for k, v in spread.items()))


def trailing(uses: DataFrame, spec: str, at: str, by: list[str], amount: Column | None = None) -> DataFrame:
    """``uses`` with used (count, or sum of a known ``amount``) over the window that ends at each row, and whether another is allowed.

    ``by`` (account, project, ...) is needed, as a window over everything would be one task.
    """
    most, seconds = parse_window(spec)
    back = Window.partitionBy(*by).orderBy(F.unix_micros(at)).rangeBetween(-seconds * 1_000_000, 0)
    used = F.count("*").over(back).cast("double") if amount is None else F.coalesce(F.sum(amount).over(back), F.lit(0.0))
    return uses.withColumn("used", used).withColumns({"remaining": F.greatest(F.lit(0.0), F.lit(most) - F.col("used")), "allowed": F.col("used") < most})


def budget(uses: DataFrame, spec: str, at: str, now: Column, amount: Column | None = None) -> DataFrame:
    """One row: used, excluded (rows without a known amount), remaining and allowed in the window before ``now``."""
    most, seconds = parse_window(spec)
    inside = uses.where(F.unix_micros(at) >= F.unix_micros(now) - seconds * 1_000_000)
    used = F.count("*").cast("double") if amount is None else F.coalesce(F.sum(amount), F.lit(0.0))
    excluded = F.lit(0).cast("long") if amount is None else F.count_if(amount.isNull())
    out = inside.agg(used.alias("used"), excluded.alias("excluded"))
    return out.withColumns({"remaining": F.greatest(F.lit(0.0), F.lit(most) - F.col("used")), "allowed": F.col("used") < most})


def split_evenly(members: DataFrame, total: str, by: list[str], order: str) -> DataFrame:
    """``members`` with part: the batch's whole total, dealt out so that earlier members get the remainder."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    size = F.count("*").over(Window.partitionBy(*by))
    base = F.expr(f"`{total}` div _size")
    return members.withColumns({"_place": place, "_size": size}).withColumn("part", base + F.when(F.col("_place") <= F.col(total) - base * F.col("_size"), 1).otherwise(0)).drop("_place", "_size")


def chunked(rows: DataFrame, order: str, by: list[str], size: int = 10) -> DataFrame:
    """``rows`` with batch: consecutive groups of ``size`` in each group of ``by``."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("batch", F.floor((place - 1) / size).cast("long"))


def effective_cost(own: Column, upstream: Column, byok: Column) -> Column:
    """What a call really cost, and which figure says so: the provider's, else the upstream's, else zero."""
    cost = F.when(own > 0, own).when(upstream.isNotNull(), upstream).when(own.isNotNull() & ~byok, own)
    source = F.when(own > 0, "provider").when(upstream.isNotNull(), "upstream").when(own.isNotNull() & ~byok, "zero").otherwise("unknown")
    return F.struct(cost.alias("cost"), source.alias("cost_source"), cost.isNotNull().alias("cost_known"))
