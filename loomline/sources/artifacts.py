"""Artifacts of the pipeline: named tables of fixed schemas under one root, and their exports.

A table's files lie in generations, one for each run that wrote it, and are sorted by project within. A
project is a partition by name only: folders and files of its own for each would be many times more
files than there is data to fill. A manifest names the generation that each partition of each table is read from. A run replaces whole
partitions: those it touched and wrote rows for point to its generation, those it touched and
wrote nothing for go. The manifest is renamed into place last, so a run that dies half-way changes
nothing, and of two runs that began from the same manifest only one can commit. A table that has
not been written reads as empty, so a first run needs no set-up.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.sources.scratch import delete

SCHEMAS = {
    "ledger": "project_key string, session_id string, source_tool string, source_hash string, content_revision int, lifecycle string, updated_at timestamp",
    "turns": "project_key string, session_id string, turn_index int, turn_id string, user_prompt string, assistant_summary string, commands_seen array<string>, files_touched array<string>, tool_stub_count int, started_at string, ended_at string, first_line int, last_line int, verification_seen boolean",
    "events": "project_key string, session_id string, turn_id string, turn_index int, event_id string, line int, type string, summary string, matched_rule string, confidence string, verification_command string",
    "learnings": "project_key string, session_id string, learning_id string, scope string, kind string, basis string, statement string, title string, trigger string, evidence array<string>, evidence_type string, confidence string, at timestamp, pos int",
    "summaries": "project_key string, session_id string, topic string, topic_source string, what_failed array<string>, what_was_decided array<string>, what_worked array<string>, useful_commands array<string>, files_of_interest array<string>, project_learnings array<string>, user_learnings array<string>, next_step string",
    "instincts": "project_id string, instinct_id string, trigger string, finding string, domain string, scope string, confidence_floor double, confidence double, maturity string, deprecated boolean, observations array<struct<session: string, reinforcing: boolean, at: timestamp>>, updated_at timestamp",
    "pages": "project_id string, name string, page string",
    "reviewed": "project_key string, session_id string, learning_id string, kind string, statement string, title string, trigger string, basis string, verdict string, reviewed_at timestamp",
    "applications": "batch_id string, status string, n_applied long, n_rejected long, n_skipped long, error string, recorded_at timestamp",
    "files": "source_tool string, source_path string, bytes long, modified_at timestamp, session_id string",
}
PARTITION = {name: {"instincts": "project_id", "pages": "project_id", "files": "source_tool", "applications": "batch_id"}.get(name, "project_key") for name in SCHEMAS}
MANIFEST = "name string, part string, generation string"


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _fs(spark, path)
    return fs.exists(target)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    target, fs = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def renamed(spark: SparkSession, old: str, new: str) -> None:
    """Move a folder to a name that must be free: the one step of a commit that is seen as a whole."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    path, options = jvm.org.apache.hadoop.fs.Path, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(old).toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(path(old), path(new), options)


def newest(spark: SparkSession, root: str) -> int:
    """The number of the manifest in force; 0 before the first."""
    return max((int(n) for n in names_in(spark, f"{root}/manifests") if n.isdigit()), default=0)


def manifest(spark: SparkSession, root: str, number: int) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifests/{number:08d}") if number else spark.createDataFrame([], MANIFEST)


def _part(c: Column) -> Column:
    """A partition's value as the manifest has it; null is the empty string there."""
    return F.coalesce(c.cast("string"), F.lit(""))


def load(spark: SparkSession, root: str, name: str, generation: str | None = None) -> DataFrame:
    """An artifact's table as the manifest in force has it, or what one generation wrote of it, committed or not."""
    if not exists(spark, f"{root}/{name}"):
        return spark.createDataFrame([], SCHEMAS[name])
    rows = spark.read.schema(f"{SCHEMAS[name]}, generation string").parquet(f"{root}/{name}")
    if generation is None:
        named = manifest(spark, root, newest(spark, root)).where(F.col("name") == name).select("generation", F.col("part").alias("_part"))
        rows = rows.withColumn("_part", _part(F.col(PARTITION[name]))).join(named, ["generation", "_part"], "left_semi")
    else:
        rows = rows.where(F.col("generation") == generation)
    return rows.select(*spark.createDataFrame([], SCHEMAS[name]).columns)


class Generation:
    """The writes of one run; nothing of it is read by others until ``commit``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.number = newest(spark, root) + 1
        self.name = f"{self.number:08d}-{uuid.uuid4().hex[:8]}"
        self.touched: dict[str, DataFrame] = {}

    def save(self, df: DataFrame, name: str, touched: DataFrame) -> None:
        """Write ``df`` as all there is of the partitions in ``touched`` (one column); columns are cast to the artifact's schema."""
        fields = self.spark.createDataFrame([], SCHEMAS[name]).schema.fields
        rows = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields))
        spread = rows.repartition(PARTITION[name], F.pmod(F.xxhash64(rows.columns[1]), F.lit(16))).sortWithinPartitions(PARTITION[name])
        spread.write.parquet(f"{self.root}/{name}/generation={self.name}")
        self.touched[name] = touched.select(_part(F.col(touched.columns[0])).alias("part"))

    def commit(self) -> None:
        """Bring this generation into force, unless another run has committed since it began."""
        rows = manifest(self.spark, self.root, self.number - 1)
        for name, parts in self.touched.items():
            rows = rows.join(parts.select(F.lit(name).alias("name"), "part").distinct(), ["name", "part"], "left_anti")
        for name in self.touched:
            wrote = load(self.spark, self.root, name, self.name).select(_part(F.col(PARTITION[name])).alias("part")).distinct()
            rows = rows.unionByName(wrote.select(F.lit(name).alias("name"), "part", F.lit(self.name).alias("generation")))
        waiting = f"{self.root}/manifests/_{self.name}"
        rows.write.parquet(waiting)
        renamed(self.spark, waiting, f"{self.root}/manifests/{self.number:08d}")


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete all but the newest ``keep`` manifests, and generations up to the newest that none of these name; how many generations went."""
    last = newest(spark, root)
    numbers = sorted(int(n) for n in names_in(spark, f"{root}/manifests") if n.isdigit())
    kept = numbers[-keep:]
    used = {(r[0], r[1]) for n in kept for r in manifest(spark, root, n).select("name", "generation").distinct().collect()}  # a row a generation
    gone = 0
    for n in set(numbers) - set(kept):
        delete(spark, f"{root}/manifests/{n:08d}")
    for name in SCHEMAS:
        for folder in names_in(spark, f"{root}/{name}"):
            found = re.fullmatch(r"generation=((\d+)-\w+)", folder)
            if found and int(found[2]) <= last and (name, found[1]) not in used:
                delete(spark, f"{root}/{name}/{folder}")
                gone += 1
    return gone


def export_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """An ordered export as JSON lines, such as the index of sessions."""
    df.orderBy(*order).write.mode("overwrite").json(path)
