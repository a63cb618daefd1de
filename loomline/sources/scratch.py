"""Scratch tables in the folder that the driver and all executors share.

Results are lazy, so the tables that they read must outlive the call that made them; ``clear``
deletes all that a session still has, once its results are written.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``, or on a local master a private one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='loomline-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """A table just read, dealt out to all cores where its files make fewer partitions than these.

    Work on texts takes far longer than reading them, and a small table in one file would leave it
    to one core. Larger tables stay as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows that a task of a shuffle gets where their number is known to be large.
ROWS_A_TASK = 1_000_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """A large table by ``keys`` in as many parts as its rows need, so that a join's tasks stay as small as with a small table."""
    parts = -(-df.count() // ROWS_A_TASK)
    return df.repartition(parts, *keys) if parts > 1 else df


#: Paths given out and not deleted yet, by application.
_given: dict[str, set[str]] = {}


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/loomline-{name}-{uuid.uuid4().hex}"
    _given.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def clear(spark: SparkSession) -> int:
    """Delete all scratch tables of this application; how many there were. Results not written by then can no longer be read."""
    paths = _given.pop(spark.sparkContext.applicationId, set())
    for path in paths:
        delete(spark, path)
    return len(paths)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The files survive lost executors, so a later failure never recomputes what led here.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


#: Up to this many bytes of distinct values, what was made of them is sent to every task.
FEW_BYTES = 16 << 20


def once_each(rows: DataFrame, keys: list[str], made_of: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """``made_of(rows)`` where that adds columns that depend on ``keys`` alone: worked out once for each distinct value of these.

    Sessions say the same things over and over, and rules on texts take far longer than finding
    out which texts there are. ``rows`` is read twice and should be ``stored``.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    values = rows.select(*keys).distinct().repartition(tasks)
    named = {k: f"_of_{k}" for k in keys}
    made = stored(made_of(values).withColumnsRenamed(named), name)
    size = made.agg(F.sum(reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 8 for c in named.values()]))).first()[0] or 0
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(made[c]) for k, c in named.items()])
    return rows.join(F.broadcast(made) if size <= FEW_BYTES else made, same, "left").drop(*named.values())


def dropped(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    path = getattr(df, "scratch_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    _given.get(spark.sparkContext.applicationId, set()).discard(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
