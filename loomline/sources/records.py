"""Records and session bundles as YAML texts, and indexes and knowledge as JSON lines.

The YAML is the small part of the language that such files use: single-quoted scalars with doubled
quotes, literal blocks with two spaces before each line, and lists of maps at fixed depths. So a
text is read by patterns, in SQL; a text is one row, whether it comes from a file or a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSIONS = {"record": "instinct-v1", "bundle": "session-bundle-v1"}
OBSERVATION = "session string, reinforcing boolean, at timestamp"
INDEX = "session_id string, source_tool string, project_key string, topic string, updated_at string, project_learnings array<string>, user_learnings array<string>"
KNOWLEDGE = "project_key string, session_id string, learning_id string, scope string, kind string, statement string, title string, trigger string, evidence array<string>, confidence string"
TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"


def quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))


def unquoted(c: Column) -> Column:
    """The value of a scalar: a quoted one without its quotes, ``null`` and nothing as null, others as they are."""
    inner = F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit("''"), F.lit("'"))
    return F.when(F.startswith(c, F.lit("'")), inner).when(~c.isin("null", "", "~"), c)


def scalar(text: Column, name: str, depth: int = 0) -> Column:
    return unquoted(F.trim(F.regexp_extract(text, rf"(?m)^ {{{depth}}}(?:- )?{name}: (.*)$", 1)))


def block(text: Column, name: str) -> Column:
    """A literal block without its indentation and final line ends."""
    lines = F.regexp_extract(text, rf"(?m)^{name}: \|\n((?:(?:  [^\n]*)?\n)*)", 1)
    return F.regexp_replace(F.regexp_replace(lines, r"(?m)^  ", ""), r"\n+\z", "")


def section(text: Column, name: str) -> Column:
    """All that follows a key at the start of a line; lines of literal blocks never start so."""
    return F.regexp_extract(text, rf"(?ms)^{name}:\n(.*)", 1)


def _block(name: str, c: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(c, r"\s+\z", ""), r"(?m)^(?=[^\n])", "  ")
    return F.concat(F.lit(f"{name}: |\n"), body)


def time(c: Column) -> Column:
    return F.date_format(c, TIME)


def to_yaml(records: DataFrame) -> DataFrame:
    """``records`` (the artifact "instincts") with yaml: a text for each."""
    def line(name: str, c: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), c)

    def each(o: Column) -> Column:
        return F.concat(F.lit("    - session: "), quoted(o.session), F.lit("\n      reinforcing: "), o.reinforcing.cast("string"), F.lit("\n      at: "), quoted(time(o["at"])))

    first = F.get("observations", F.lit(0))
    seen = F.array_join(F.concat(F.array(F.lit("  observations:")), F.transform("observations", each)), "\n")
    level = F.when(F.col("deprecated"), "deprecated").otherwise(F.col("maturity"))
    parts = [
        F.lit(f"schema_version: {SCHEMA_VERSIONS['record']}"), line("id", quoted(F.col("instinct_id"))), _block("trigger", F.col("trigger")), _block("finding", F.col("finding")),
        line("confidence", F.col("confidence").cast("string")), line("confidence_floor", F.col("confidence_floor").cast("string")), line("domain", quoted(F.col("domain"))),
        line("maturity", quoted(level)), line("scope", quoted(F.col("scope"))), line("project_id", quoted(F.col("project_id"))),
        F.lit("source:"), F.concat(F.lit("  first_session: "), quoted(first.session)), F.concat(F.lit("  first_observed_at: "), quoted(time(first["at"]))), F.lit("  source_refs:"), seen,
        F.lit("related: []"), line("created_at", quoted(time(first["at"]))), line("updated_at", quoted(time(F.col("updated_at")))), F.lit("last_promoted_at: null"),
    ]
    return records.withColumn("yaml", F.concat(F.array_join(F.array(*parts), "\n"), F.lit("\n")))


def of_yaml(texts: DataFrame, text: str = "text") -> DataFrame:
    """Records (the columns of the artifact "instincts") of YAML texts; a text without an id fails the job."""
    t = F.col(f"`{text}`")
    item = r"(?m)^    - session: (.*)\n      reinforcing: (true|false)\n      at: (.*)$"
    columns = [F.regexp_extract_all(section(t, "source"), F.lit(item), F.lit(k)) for k in (1, 2, 3)]
    seen = F.transform(
        F.arrays_zip(*(c.alias(n) for c, n in zip(columns, "abc", strict=True))),
        lambda z: F.struct(unquoted(z.a).alias("session"), (z.b == "true").alias("reinforcing"), F.to_timestamp(unquoted(z.c)).alias("at")),
    )
    named = scalar(t, "id")
    return texts.select(
        F.coalesce(scalar(t, "project_id"), F.lit("")).alias("project_id"),
        F.coalesce(named, F.raise_error(F.concat(F.lit("a record without an id: "), F.substring(t, 1, 80))).cast("string")).alias("instinct_id"),
        block(t, "trigger").alias("trigger"), block(t, "finding").alias("finding"), scalar(t, "domain").alias("domain"), scalar(t, "scope").alias("scope"),
        scalar(t, "confidence_floor").cast("double").alias("confidence_floor"), scalar(t, "confidence").cast("double").alias("confidence"), scalar(t, "maturity").alias("maturity"),
        (scalar(t, "maturity") == "deprecated").alias("deprecated"), seen.alias("observations"), F.to_timestamp(scalar(t, "updated_at")).alias("updated_at"),
    )


def deltas_of_bundles(texts: DataFrame, text: str = "text") -> DataFrame:
    """The deltas of session bundles, in the columns of ``instincts.fold``; they count from the review, or else from the ingest."""
    t = F.col(f"`{text}`")
    at = F.to_timestamp(F.coalesce(scalar(t, "reviewed_at"), scalar(t, "ingested_at")))
    items = F.regexp_extract_all(section(t, "deltas"), F.lit(r"(?m)^  - op: [^\n]*\n(?:    [^\n]*\n?)*"), F.lit(0))
    rows = texts.select(scalar(t, "project_id").alias("project_id"), scalar(t, "session_id").alias("session_id"), at.alias("at"), F.posexplode(items).alias("pos", "_d"))
    d = F.col("_d")
    return rows.select(
        "project_id", "session_id", "at", F.struct("session_id", "pos").alias("pos"), scalar(d, "op", 2).alias("op"),
        *(scalar(d, n, 4).alias(n) for n in ("instinct_id", "trigger", "finding", "domain")),
        scalar(d, "initial_confidence", 4).cast("double").alias("initial_confidence"), scalar(d, "correction", 4).alias("correction"), scalar(d, "into", 4).alias("into"),
    )


def texts(spark: SparkSession, path: str, glob: str = "*.yaml") -> DataFrame:
    """path and text of the files under a folder, one row each."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a schema; blank lines are skipped, and a line that is no JSON object of it fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def index_or(spark: SparkSession, path: str, built: DataFrame) -> DataFrame:
    """The index of sessions as exported, or ``built`` where there is no export."""
    from loomline.sources.artifacts import exists

    return lines(spark, path, INDEX) if exists(spark, path) else built.select(*spark.createDataFrame([], INDEX).columns)


def export_knowledge(learnings: DataFrame, path: str) -> None:
    """Learnings as JSON lines in folders by scope and project."""
    learnings.repartition("scope", "project_key").sortWithinPartitions("session_id", "learning_id").write.mode("overwrite").partitionBy("scope", "project_key").json(path)
