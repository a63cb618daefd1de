"""Transcripts of coding assistants as one table of records, whatever tool wrote them.

Files are read as lines with Spark's text source, so a long session is split over tasks like any
other file; line numbers come from the order of lines in their file. A line is parsed to VARIANT
once, and each dialect is a set of column expressions over it; so is its text, which can nest to any
depth. Lines that are not JSON objects go to ``bad_lines``; their sessions are left out by
``records``, as a broken file must not half-load.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions.nested import flat_text, levels_in
from loomline.functions.text import SPACE, filled, trimmed
from loomline.operators.commands import commands_in, paths_in
from loomline.operators.turns import ASSISTANT, EVENT, TOOL_RESULT, TOOL_USE, USER

REDACTED_LEAF = r'(?i)(?<=[:,\[])\s*"\s*(?:\[redacted\]|<redacted>|redacted)\s*"(?!\s*:)'
PREAMBLE, TITLE, SESSION = 16, "title", "session"
TIMES = ["timestamp", "createdAt", "updatedAt", "time", "ts", "date"]


def at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}" if path else "$", kind)


def string_at(v: Column, path: str) -> Column:
    """A string leaf that is not blank; numbers and objects give null."""
    found = F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant")) == "STRING", at(v, path))
    return F.when(F.length(trimmed(found)) > 0, found)


def first_string(v: Column, *paths: str) -> Column:
    return F.coalesce(*(string_at(v, p) for p in paths))


REDACTED = ("[redacted]", "<redacted>", "redacted")


def said(v: Column, levels: Column, kind: Column, paths: dict[str, list[str]], between: str = "\n\n") -> Column:
    """The first text, other than a redaction mark, at the paths of a record's kind ("" for kinds without their own)."""

    def roots(of_kind: list[str]) -> Column:
        return F.array(*(F.try_variant_get(v, f"$.{p}", "variant") for p in of_kind))

    chosen = F.lit(None).cast("array<variant>")
    for name, of_kind in paths.items():
        if name:
            chosen = F.when(kind == name, roots(of_kind)).otherwise(chosen)
    every = F.coalesce(chosen, roots(paths[""]))
    texts = F.transform(F.filter(every, lambda r: r.isNotNull()), lambda r: flat_text(r, between, levels))
    return F.get(F.filter(texts, lambda t: t.isNotNull() & ~F.lower(t).isin(*REDACTED)), F.lit(0))


def tool_input(v: Column, prefix: str = "") -> Column:
    names = ["arguments.command", "arguments.input", "arguments.path", "input", "command", "path"]
    return filled(first_string(v, *(prefix + n for n in names)))


def _when(c: Column, cases: list[tuple[Column, str]]) -> Column:
    out = F.when(F.lit(False), F.lit(EVENT))
    for test, kind in cases:
        out = out.when(test, kind)
    return out.otherwise(EVENT)


def _paths(spoken: list[str], other: list[str]) -> dict[str, list[str]]:
    return {USER: spoken, ASSISTANT: spoken, "": other}


def cursor_text(c: Column, kind: Column) -> Column:
    """Text without wrapper blocks and tags; of a user's message only the query section, if it has one."""
    query = filled(F.regexp_extract(c, r"(?i)<user_query>([\s\S]*?)</user_query>", 1))
    t = F.when(kind == USER, F.coalesce(query, c)).otherwise(c)
    for tag in ("plugin_info", "attached_files", "code_selection"):
        t = F.regexp_replace(t, rf"(?i)<{tag}\b[^>]*>[\s\S]*?</{tag}>", " ")
    t = F.translate(F.regexp_replace(t, r"(?i)</?[a-z_:-]+(?:\s+[^>]*)?>", " "), "\r", "\n")
    return filled(F.regexp_replace(F.regexp_replace(t, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


@dataclass(frozen=True)
class Dialect:
    """Where a tool keeps its transcripts, and how a line becomes a record."""

    tool: str
    glob: str
    path: str
    #: Where the text is, by kind of record, and what stands between the texts of an array.
    texts: dict[str, list[str]]
    between: str = "\n\n"

    def fields(self, v: Column) -> dict[str, Column]:
        raise NotImplementedError

    def session_id(self, path: Column) -> Column:
        return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)

    def workspace(self, path: Column) -> Column:
        return F.lit(None).cast("string")


class Cursor(Dialect):
    def fields(self, v: Column) -> dict[str, Column]:
        raw = first_string(v, "type", "role", "kind", "eventType", "event.type")
        name = F.lower(raw)
        kind = _when(
            name,
            [
                (F.contains(name, F.lit("tool_result")) | (name == "result"), TOOL_RESULT),
                (name.rlike("tool_call|tool_use|function_call"), TOOL_USE),
                (F.contains(name, F.lit("assistant")), ASSISTANT),
                (name.rlike("user|human"), USER),
            ],
        )
        return {
            "raw_type": raw,
            "kind": kind,
            "input_text": tool_input(v),
            "call_id": first_string(v, "id", "callId", "toolCallId"),
            "tool_name": first_string(v, "name", "toolName", "tool.name"),
            "status": first_string(v, "status", "state", "tool.status"),
            "ts": first_string(v, *TIMES),
        }

    def workspace(self, path: Column) -> Column:
        return F.url_decode(F.regexp_extract(path, r"/([^/]+)/agent-transcripts/", 1))


class ClaudeCode(Dialect):
    def fields(self, v: Column) -> dict[str, Column]:
        raw = first_string(v, "type", "role")
        name = F.lower(raw)
        kind = _when(
            name,
            [
                (name.isin("user", "human"), USER),
                (name == "assistant", ASSISTANT),
                (F.contains(name, F.lit("tool_result")) | (name == "result"), TOOL_RESULT),
                (name.rlike("tool_use|function_call"), TOOL_USE),
            ],
        )
        return {
            "raw_type": raw,
            "kind": kind,
            "input_text": tool_input(v),
            "call_id": first_string(v, "id", "callId", "toolUseID"),
            "tool_name": first_string(v, "name", "toolName"),
            "status": first_string(v, "status", "state"),
            "ts": first_string(v, *TIMES),
        }

    def workspace(self, path: Column) -> Column:
        slug = F.regexp_extract(path, r"/([^/]+)/[^/]+$", 1)
        return F.when(F.startswith(slug, F.lit("-")), F.translate(slug, "-", "/"))


class Codex(Dialect):
    def fields(self, v: Column) -> dict[str, Column]:
        top, inner, role = string_at(v, "type"), string_at(v, "payload.type"), string_at(v, "payload.role")
        item = top == "response_item"
        kind = _when(
            top,
            [
                (item & (inner == "message") & (role == "user"), USER),
                (item & (inner == "message") & (role == "assistant"), ASSISTANT),
                (item & (inner == "function_call"), TOOL_USE),
                (item & (inner == "function_call_output"), TOOL_RESULT),
            ],
        )
        return {
            "raw_type": F.concat_ws("/", top, inner),
            "kind": kind,
            "input_text": F.coalesce(tool_input(v, "payload."), filled(string_at(v, "payload.output"))),
            "call_id": first_string(v, "payload.call_id", "payload.id"),
            "tool_name": string_at(v, "payload.name"),
            "status": first_string(v, "payload.status", "payload.state"),
            "ts": string_at(v, "timestamp"),
            "cwd": F.when(top == "session_meta", string_at(v, "payload.cwd")),
        }


class Kimi(Dialect):
    def fields(self, v: Column) -> dict[str, Column]:
        name = string_at(v, "message.type")
        kind = _when(name, [(name == "TurnBegin", USER), (name == "ContentPart", ASSISTANT), (name == "ToolCall", TOOL_USE), (name == "ToolResult", TOOL_RESULT)])
        raw_args = filled(string_at(v, "message.payload.function.arguments"))
        args = F.try_parse_json(raw_args)
        given = F.when(args.isNull(), raw_args).otherwise(filled(first_string(args, "command", "input", "path", "text", "content")))
        seconds = F.try_variant_get(v, "$.timestamp", "double")
        iso = F.date_format(F.timestamp_millis((seconds * 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        return {
            "raw_type": name,
            "kind": kind,
            "input_text": F.coalesce(given, tool_input(v, "message."), F.when(kind == TOOL_RESULT, filled(string_at(v, "message.payload.return_value.output")))),
            "call_id": first_string(v, "message.payload.tool_call_id", "message.payload.id"),
            "tool_name": first_string(v, "message.payload.function.name", "message.payload.name"),
            "status": F.lit(None).cast("string"),
            "ts": F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(v, "$.timestamp", "variant")) != "STRING", iso), string_at(v, "timestamp")),
        }

    def session_id(self, path: Column) -> Column:
        return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


class Pi(Dialect):
    def fields(self, v: Column) -> dict[str, Column]:
        top, role = string_at(v, "type"), string_at(v, "message.role")
        message = top == "message"
        kind = _when(top, [(message & (role == "user"), USER), (message & (role == "assistant"), ASSISTANT), (message & (role == "toolResult"), TOOL_RESULT)])
        return {
            "raw_type": F.when(message, F.concat_ws("/", top, role)).otherwise(top),
            "kind": kind,
            "input_text": tool_input(v, "message."),
            "call_id": first_string(v, "message.toolCallId", "message.id"),
            "tool_name": first_string(v, "message.toolName", "message.name"),
            "status": first_string(v, "message.status", "message.state"),
            "ts": string_at(v, "timestamp"),
            "cwd": F.when(top == "session", string_at(v, "cwd")),
        }

    def session_id(self, path: Column) -> Column:
        return F.regexp_extract(path, r"_([^/_]+)\.jsonl$", 1)


DIALECTS = {
    d.tool: d
    for d in (
        Cursor("cursor", "*.{jsonl,txt}", r"/agent-transcripts/(?:.*/)?[^/]+\.(?:jsonl|txt)$", _paths(["text", "message.content", "message.text", "content", "body", "prompt"], ["summary", "message", "text", "content"])),
        ClaudeCode("claude-code", "*.jsonl", r"/[^/]+/[^./][^/]*\.jsonl$", _paths(["message.content", "message.text", "content", "text"], ["summary", "message", "text", "content"])),
        Codex(
            "codex-cli",
            "rollout-*.jsonl",
            r"/(?:sessions/\d{4}/\d{2}/\d{2}|archived_sessions)/rollout-[^/]+\.jsonl$",
            _paths(["payload.content", "payload.message", "payload.text"], ["payload.message", "payload.text", "payload.content", "payload.summary"]),
        ),
        Kimi(
            "kimi",
            "wire.jsonl",
            r"/[0-9a-f]{32}/[^/]+/wire\.jsonl$",
            {
                USER: ["message.payload.user_input"],
                ASSISTANT: ["message.payload.think", "message.payload"],
                TOOL_RESULT: ["message.payload.return_value.output", "message.payload.return_value.message", "message.payload.return_value"],
                "": ["message.payload"],
            },
            "\n",
        ),
        Pi("pi", "*.jsonl", r"/[^/]+/[^/]+_[^/]+\.jsonl$", _paths(["message.content", "message.text"], ["content", "text", "message"]) | {TOOL_RESULT: ["message.content", "message.text"]}),
    )
}


def discovered(spark: SparkSession, tool: str, root: str) -> DataFrame:
    """source_tool, source_path, bytes, modified_at, source_hash and session_id of a tool's transcripts under ``root``."""
    d = DIALECTS[tool]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", d.glob).load(root)
    found = files.where(F.col("path").rlike(d.path)).select(
        F.lit(tool).alias("source_tool"),
        F.col("path").alias("source_path"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified_at"),
        F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("source_hash"),
    )
    return found.withColumns({"session_id": d.session_id(F.col("source_path")), "workspace_path": d.workspace(F.col("source_path"))})


def discovered_all(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [discovered(spark, tool, root) for tool, root in roots.items()])


def lines(spark: SparkSession, tool: str, root: str | list[str]) -> DataFrame:
    """source_path, session_id, line (from 1, blank lines counted) and raw text of all lines under a root, or of the files named."""
    d = DIALECTS[tool]
    # Ids grow with the place in a file: splits of a file are read in order of their start.
    start = F.col("_metadata.file_block_start")
    read = spark.read.option("pathGlobFilter", d.glob)
    raw = (read.option("recursiveFileLookup", True) if isinstance(root, str) else read).text(root).select("value", F.col("_metadata.file_path").alias("source_path"), start.alias("_start"), F.monotonically_increasing_id().alias("_at"))
    placed = raw.where(F.col("source_path").rlike(d.path))
    number = F.row_number().over(Window.partitionBy("source_path").orderBy("_start", "_at"))
    return placed.select(F.lit(tool).alias("source_tool"), "source_path", d.session_id(F.col("source_path")).alias("session_id"), number.alias("line"), F.regexp_replace("value", r"\r\z", "").alias("raw"))


def from_text(files: DataFrame, tool: str) -> DataFrame:
    """``lines`` of a table of whole files (source_path, content as string)."""
    d = DIALECTS[tool]
    rows = files.select("source_path", F.posexplode(F.split("content", r"\r?\n")).alias("pos", "raw"))
    return rows.select(F.lit(tool).alias("source_tool"), "source_path", d.session_id(F.col("source_path")).alias("session_id"), (F.col("pos") + 1).alias("line"), "raw")


def _parsed_lines(rows: DataFrame) -> DataFrame:
    full = rows.where(~F.col("raw").rlike(rf"\A{SPACE}*\z"))
    return full.withColumn("v", F.try_parse_json("raw"))


def _is_object() -> Column:
    return F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT")


def bad_lines(rows: DataFrame) -> DataFrame:
    """Lines that are not JSON objects, with where they are."""
    return _parsed_lines(rows).where(~_is_object()).select("source_tool", "source_path", "session_id", "line", F.concat("source_path", F.lit(":"), F.col("line").cast("string")).alias("at"))


def records(rows: DataFrame, tool: str) -> DataFrame:
    """Canonical records of ``lines`` of one tool, without the files that have a bad line."""
    d, v = DIALECTS[tool], F.col("v")
    parsed = _parsed_lines(rows)
    broken = F.max(F.when(_is_object(), 0).otherwise(1)).over(Window.partitionBy("source_path"))
    whole = parsed.withColumn("_broken", broken).where("_broken = 0")
    fields = d.fields(v)
    hidden = F.coalesce(at(v, "isRedacted", "boolean"), F.lit(False)) | F.col("raw").rlike(REDACTED_LEAF)
    out = whole.withColumn("redacted", hidden).withColumns({**fields, "cwd": fields.get("cwd", string_at(v, "cwd"))})
    out = out.withColumn("text", said(v, levels_in(F.col("raw")), F.col("kind"), d.texts, d.between))
    if tool == "cursor":
        out = out.withColumn("text", cursor_text(F.col("text"), F.col("kind")))
    if tool == "pi":
        out = out.withColumn("input_text", F.coalesce("input_text", "text"))
    tool_kind = F.col("kind").isin(TOOL_USE, TOOL_RESULT)
    out = out.withColumns({"text": F.when(~F.col("redacted"), F.col("text")), **{c: F.when(tool_kind, F.col(c)) for c in ("input_text", "call_id", "tool_name", "status")}})
    places = [string_at(v, p) for p in ("arguments.path", "arguments.cwd", "metadata.path", "metadata.cwd", "path", "cwd")]
    spoken = F.array_compact(F.array("text", *places))
    files = paths_in(F.array_compact(F.array("text", "input_text", *places)))
    out = out.withColumns({"commands": commands_in(spoken, F.col("input_text")), "files": files})
    return out.select("source_tool", "source_path", "session_id", "line", "kind", "raw_type", "text", "redacted", "commands", "files", "ts", "cwd", "input_text", "call_id", "tool_name", "status", "raw")


def of_conversations(conversations: DataFrame) -> DataFrame:
    """A table of conversations (conv_id, turn, role, text) as records."""
    kind = F.when(F.col("role") == "user", USER).when(F.col("role") == "assistant", ASSISTANT).when(F.col("role") == "tool", TOOL_RESULT).otherwise(EVENT)
    return conversations.select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("line"), kind.alias("kind"), F.col("role").alias("raw_type"), "text")


def workspaces(rows: DataFrame) -> DataFrame:
    """session_id and workspace_path: the first working directory that a session's records name.

    One tool names it in its preamble alone: in the first of ``PREAMBLE`` records that is no title, if that is a session's.
    """
    place = F.row_number().over(Window.partitionBy("source_tool", "session_id").orderBy("line"))
    placed, pi = rows.withColumn("_n", place), F.col("source_tool") == "pi"
    leads = (F.col("_n") <= PREAMBLE) & (F.coalesce("raw_type", F.lit("")) != TITLE)
    told = F.when(F.when(pi, leads).otherwise(F.col("cwd").isNotNull()), F.col("line"))
    first = F.min_by(F.struct("raw_type", "cwd"), told)
    found = placed.groupBy("source_tool", "session_id").agg(first.alias("_f"))
    return found.select("source_tool", "session_id", F.when(~pi | (F.col("_f.raw_type") == SESSION), F.col("_f.cwd")).alias("workspace_path"))


def kimi_workspaces(found: DataFrame, known_paths: DataFrame) -> DataFrame:
    """Files of the tool that names folders by the MD5 of the workspace path, joined with known paths."""
    slug = F.regexp_extract("source_path", r"/([0-9a-f]{32})/", 1)
    return found.drop("workspace_path").withColumn("slug", slug).join(known_paths.select(F.col("path").alias("workspace_path"), F.md5("path").alias("slug")), "slug", "left").drop("slug")


def project_key(workspace: Column, fallback: Column) -> Column:
    name = F.regexp_extract(workspace, r"([^/]+)/*$", 1)
    return F.coalesce(F.when(F.length(name) > 0, name), fallback)
