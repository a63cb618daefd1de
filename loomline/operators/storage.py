"""Files of the runtime: inventory, what may be removed, and how long things are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inventory(files: DataFrame, by: list[str]) -> DataFrame:
    """Bytes, count, oldest and newest of each kind of file."""
    return files.groupBy(*by).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.min("modified_at").alias("oldest"), F.max("modified_at").alias("newest"))


def directory_sizes(files: DataFrame) -> DataFrame:
    return files.groupBy("folder").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest"), F.avg("bytes").alias("mean"))


def cleanup(files: DataFrame, cutoff: Column, most_bytes: int) -> DataFrame:
    """Files to remove: those before ``cutoff``, and of the others the oldest until at most ``most_bytes`` remain.

    The running size is summed in two levels (per day, then within a day), so that no window spans
    all files.
    """
    left = files.where(F.col("modified_at") >= cutoff)
    day = F.to_date("modified_at").alias("day")
    days = left.groupBy(day).agg(F.sum("bytes").alias("b"))
    earlier = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # a row for each day
    sums = days.select("day", F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("before"), F.sum("b").over(Window.partitionBy()).alias("total"))
    own = Window.partitionBy("day").orderBy("modified_at", "path").rowsBetween(Window.unboundedPreceding, -1)
    placed = left.withColumn("day", F.to_date("modified_at")).withColumn("in_day", F.coalesce(F.sum("bytes").over(own), F.lit(0)))
    over = placed.join(F.broadcast(sums), "day").where(F.col("before") + F.col("in_day") < F.col("total") - most_bytes)
    old = files.where(F.col("modified_at") < cutoff).select("path", "bytes", F.lit("age").alias("reason"))
    return old.unionByName(over.select("path", "bytes", F.lit("size").alias("reason")))


def beyond_newest(files: DataFrame, by: list[str], order: list[Column], keep: int) -> DataFrame:
    """All but the newest ``keep`` rows of each category."""
    return files.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") > keep)


def merged_candidates(pending: DataFrame, ordinary: DataFrame) -> DataFrame:
    """Both lists by path; a pending entry wins."""
    return pending.unionByName(ordinary.join(pending.select("path"), "path", "left_anti"))


def retention_class(path: Column, known: Column, deleted: Column) -> Column:
    """How a runtime file is kept, by the folder it is in and the state of its session."""
    return (
        F.when(path.rlike(r"(^|/)(manifests|receipts|knowledge)/"), "keep")
        .when(deleted & path.rlike(r"(^|/)(parsed|reduced|staging)/"), "reclaimable")
        .when(~known & path.rlike(r"(^|/)(parsed|reduced|staging)/"), "orphan")
        .otherwise("review")
    )
