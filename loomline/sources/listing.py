"""Which transcript files are new or changed, from a listing alone: only their content is read and hashed.

A listing has the path, length and time of change of every file; no file is opened for it. Held
against the listing of what earlier runs took up, it gives the files to read. Filters come first,
then the comparison, then the limit, so a limited run always takes up the oldest work that is left.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.sources import transcripts

COLUMNS = ["source_tool", "source_path", "bytes", "modified_at", "session_id"]

# How names of test sessions begin, and what they contain in any case.
TEST_STARTS = ["pi-test-", "pi-branching-test-", "pi-compaction-test-"]
TEST_PART = "pi-test"


def is_test(name: Column) -> Column:
    """Whether a session's or a workspace folder's name is that of a test."""
    return reduce(lambda a, b: a | b, [F.startswith(name, F.lit(s)) for s in TEST_STARTS], F.contains(F.lower(name), F.lit(TEST_PART)))


def listed(spark: SparkSession, tool: str, root: str, tests: bool = False) -> DataFrame:
    """source_tool, source_path, bytes, modified_at, session_id and workspace_path of a tool's transcripts; their content is not read."""
    d, path = transcripts.DIALECTS[tool], F.col("source_path")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", d.glob).load(root)
    found = files.select(F.lit(tool).alias("source_tool"), F.col("path").alias("source_path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified_at")).where(path.rlike(d.path))
    if tool == "pi" and not tests:
        own, folder = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
        found = found.where(~is_test(own) & ~is_test(folder))
    return found.withColumns({"session_id": d.session_id(path), "workspace_path": d.workspace(path)})


def listed_all(spark: SparkSession, roots: dict[str, str], tests: bool = False) -> DataFrame:
    return reduce(DataFrame.unionByName, [listed(spark, tool, root, tests) for tool, root in roots.items()])


def selected(files: DataFrame, since: Column | None = None, exclude: list[str] | None = None, exclude_projects: list[str] | None = None) -> DataFrame:
    """Files not older than ``since``, whose path has none of the excluded parts, and of no excluded project."""
    out = files if since is None else files.where(F.col("modified_at") >= since)
    for part in exclude or []:
        if part:
            out = out.where(~F.contains("source_path", F.lit(part)))
    if exclude_projects:
        out = out.where(~transcripts.project_key(F.col("workspace_path"), F.col("session_id")).isin(exclude_projects))
    return out


def changed(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files that ``seen`` does not have with the same length and time."""
    same = ["source_tool", "source_path", "bytes", "modified_at"]
    return files.join(seen.select(*same), same, "left_anti")


def to_read(files: DataFrame, seen: DataFrame, limit: int | None = None) -> DataFrame:
    """The files of sessions that have a changed one; with ``limit`` of the sessions of the first so many changed files by time and path.

    A session's other files come along, as a session is always taken up whole.
    """
    fresh = changed(files, seen)
    if limit is not None:
        fresh = fresh.orderBy("modified_at", "source_path").limit(limit)
    return files.join(fresh.select("source_tool", "session_id").distinct(), ["source_tool", "session_id"], "left_semi")


def merged(seen: DataFrame, read: DataFrame) -> DataFrame:
    """The listing of what has been taken up, with ``read`` in place of what stood under the same paths."""
    keys = ["source_tool", "source_path"]
    return seen.select(*COLUMNS).join(read.select(*keys), keys, "left_anti").unionByName(read.select(*COLUMNS))


def literal(path: str) -> str:
    """A path as a pattern that matches it alone."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def lines(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``transcripts.lines`` of the listed files. Their paths go through the driver, as in any reading of files."""
    paths: dict[str, list[str]] = {}
    for r in files.select("source_tool", "source_path").collect():
        paths.setdefault(r[0], []).append(literal(r[1]))
    parts = [transcripts.lines(spark, tool, of_tool) for tool, of_tool in sorted(paths.items())]
    if not parts:
        return spark.createDataFrame([], "source_tool string, source_path string, session_id string, line int, raw string")
    return reduce(DataFrame.unionByName, parts)
