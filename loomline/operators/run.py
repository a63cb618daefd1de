"""The whole way from transcript lines to memory pages, each step's table written and read again.

A run takes up new and changed sessions only: their content hashes are held against the ledger. The
artifacts of a project that has, or had, such a session are made again from what stands of it, as
one generation: it comes into force as a whole when all of it is written, and what the project no
longer has (a session's last lesson, a record, a page) is gone with it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import confidence as conf
from loomline.operators import candidates, commands, events, instincts, ledger, summaries, turns
from loomline.sources import artifacts, listing, transcripts
from loomline.sources.scratch import dropped, stored
from loomline.sources.sinks import memory_pages


def sources(lines: DataFrame) -> DataFrame:
    """source_tool, session_id and source_hash of transcript lines: a hash of all lines with their numbers, whatever their order."""
    row = F.struct("line", "raw")
    digest = F.concat_ws(":", F.count("*").cast("string"), F.bit_xor(F.xxhash64(row)).cast("string"), F.bit_xor(F.xxhash64(F.lit(1), row)).cast("string"))
    return lines.groupBy("source_tool", "session_id").agg(digest.alias("source_hash"))


def learned(own: DataFrame, found: DataFrame) -> DataFrame:
    """Lessons of projects and preferences of users from canonical turns and events, with their time and place."""
    lessons = candidates.kept(candidates.finalized(candidates.offered(own, found))).withColumn("scope", F.lit("project"))
    when = own.select("turn_id", F.try_to_timestamp("started_at").alias("at"))
    lessons = lessons.join(when, "turn_id", "left").withColumn("pos", F.col("place").cast("int"))
    said = candidates.preferences(own).join(own.select("turn_id", "project_key", F.try_to_timestamp("started_at").alias("at")), "turn_id")
    said = said.select(
        "project_key", "session_id", F.concat("session_id", F.lit(":user:"), F.sha2("statement", 256)).alias("learning_id"), F.lit("user").alias("scope"), F.lit("preference").alias("kind"),
        F.lit("stated").alias("basis"), "statement", F.col("statement").alias("title"), F.lit("").alias("trigger"), F.array("statement").alias("evidence"), F.lit("verified").alias("evidence_type"),
        F.lit("high").alias("confidence"), "at", F.col("pos").cast("int").alias("pos"),
    ).dropDuplicates(["session_id", "learning_id"])
    return lessons.select(*said.columns).unionByName(said)


def deltas(learnings: DataFrame) -> DataFrame:
    """Lessons of projects as deltas for ``instincts.fold``, in order of time, session and place."""
    made = instincts.to_deltas(learnings.where("scope = 'project'"))
    early = F.lit("1970-01-01 00:00:00").cast("timestamp")
    return made.select(
        F.col("project_key").alias("project_id"), "session_id", F.coalesce("at", early).alias("at"), F.struct("session_id", "pos", "learning_id").alias("pos"), "op", "instinct_id", "trigger", "finding", "domain",
        "initial_confidence", F.lit(None).cast("string").alias("correction"), F.lit(None).cast("string").alias("into"),
    )


def known(folded: DataFrame, now: Column) -> DataFrame:
    """Folded records with confidence and maturity at ``now``."""
    key = ["project_id", "instinct_id"]
    rows = folded.select(*key, "confidence_floor", F.posexplode("observations").alias("ord", "o")).select(*key, "confidence_floor", "ord", "o.at", "o.reinforcing")
    state = instincts.state(rows, key, now, F.col("confidence_floor")).select(*key, "confidence", "maturity")
    level = F.when(F.col("deprecated"), "deprecated").otherwise(F.col("maturity"))
    return folded.join(state, key).withColumns({"maturity": level, "scope": F.lit("project")})


def run(lines: DataFrame, root: str, now: Column, project: Column | None = None, files: DataFrame | None = None) -> DataFrame:
    """Take up ``lines`` (of ``transcripts.lines``, of any tools) and return the pages of every project touched that has any.

    ``project`` makes a project's key of a record (default: the last folder of its workspace, else the session).
    A session without a readable record keeps the project it had, or is one of its own. ``files`` is
    the listing of what has been taken up with this run, which comes into force with it.
    """
    spark, generation = lines.sparkSession, artifacts.Generation(lines.sparkSession, root)
    seen = stored(sources(lines), "sources")
    old = artifacts.load(spark, root, "ledger")
    merged = stored(ledger.upserted(old, seen, ["source_tool", "session_id"], "source_hash"), "ledger")
    todo = stored(ledger.to_process(merged).select("source_tool", "session_id"), "todo")
    fresh = lines.join(todo, ["source_tool", "session_id"], "left_semi")
    tools = {r[0] for r in todo.select("source_tool").distinct().collect()}  # a few names
    parts = [transcripts.records(fresh.where(F.col("source_tool") == tool), tool) for tool in transcripts.DIALECTS if tool in tools or not tools]
    records = stored(reduce(DataFrame.unionByName, parts), "records")
    places = transcripts.workspaces(records).drop("source_tool")
    key = transcripts.project_key(F.col("workspace_path"), F.col("session_id")) if project is None else project
    homes = records.select("session_id", "source_tool").distinct().join(places, "session_id", "left").select("session_id", "source_tool", key.alias("project_key"))
    homes = stored(homes, "homes")

    grouped = stored(turns.grouped(records.drop("source_path", "raw")), "grouped")
    said = events.read_once(grouped)
    found = stored(events.tagged(said).join(homes.drop("source_tool"), "session_id"), "events")
    rolled = turns.rolled_up(grouped).join(commands.by_turn(said), "turn_id", "left").drop("commands")
    own = events.canonical_turns(rolled, found, events.focused(grouped, found)).join(homes.drop("source_tool"), "session_id")
    own = stored(own.withColumn("commands_seen", F.coalesce("commands_seen", F.array().cast("array<string>"))), "turns")
    lessons = stored(learned(own, found), "learnings")
    told = summaries.summaries(own, found, lessons.select("session_id", "scope", "statement")).join(homes.drop("source_tool"), "session_id")

    held = old.select("session_id", "source_tool", F.col("project_key").alias("_p"))
    named = todo.join(homes, ["source_tool", "session_id"], "left").join(held, ["source_tool", "session_id"], "left")
    named = stored(named.withColumn("project_key", F.coalesce("project_key", "_p", "session_id")), "named")
    # Where a session is now, and where it was.
    touched = stored(named.select("project_key").union(named.where("_p is not null").select("_p")).distinct(), "touched")
    rows = merged.join(named.select("source_tool", "session_id", "project_key"), ["source_tool", "session_id"], "left").join(held, ["source_tool", "session_id"], "left")
    rows = rows.withColumn("project_key", F.coalesce("project_key", "_p")).drop("_p").join(touched, "project_key", "left_semi")
    state = F.when(F.col("change").isin("inserted", "changed"), "extracted").otherwise(F.col("lifecycle"))
    generation.save(rows.withColumns({"lifecycle": state, "updated_at": now}), "ledger", touched)
    for name, made in (("turns", own), ("events", found), ("learnings", lessons), ("summaries", told)):
        standing = artifacts.load(spark, root, name).join(touched, "project_key", "left_semi").join(todo.select("session_id"), "session_id", "left_anti")
        generation.save(standing.unionByName(made.select(*standing.columns)), name, touched)

    changes = stored(deltas(artifacts.load(spark, root, "learnings", generation.name)), "deltas")
    generation.save(known(instincts.fold(changes), now), "instincts", touched)
    folded = artifacts.load(spark, root, "instincts", generation.name)
    generation.save(memory_pages(instincts.rollup_pages(folded)), "pages", touched)
    if files is not None:
        generation.save(files, "files", files.select("source_tool").distinct())
    generation.commit()
    for table in (seen, merged, todo, records, homes, grouped, found, own, lessons, named, touched, changes):
        dropped(table)
    return artifacts.load(spark, root, "pages", generation.name)


def ingest(spark: SparkSession, roots: dict[str, str], root: str, now: Column, project: Column | None = None, limit: int | None = None, tests: bool = False, **filters) -> DataFrame:
    """``run`` over the new and changed files under each tool's root; the others are listed, but not read.

    ``filters`` are those of ``listing.selected``; ``limit`` bounds the changed files of one run.
    """
    found = listing.selected(listing.listed_all(spark, roots, tests), **filters)
    seen = artifacts.load(spark, root, "files")
    read = stored(listing.to_read(found, seen, limit), "files")
    if read.isEmpty():
        return artifacts.load(spark, root, "pages").limit(0)
    pages = run(listing.lines(spark, read), root, now, project, listing.merged(seen, read))
    dropped(read)
    return pages
