"""Commands and paths that records mention, and the commands of a turn in normal form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import matches, rule, squeezed, trimmed

# Fixed values.
STARTERS = "npm|pnpm|yarn|bun|node|python3?|uv|git|just|make|cargo|go|docker|sqlite3"
MORE_STARTERS = f"{STARTERS}|gh|jq|curl|wget|rg|grep|ls|cat|sed|awk|ssh|kubectl|brew|td|hubctl|qa|wt|op|gog|mise|tar"
COMMAND = rf"^(?:\./[\w./-]+|script/[\w./-]+|(?:{MORE_STARTERS})\b)"
COMMAND_LINE = rf"^(?:[-*]\s*)?(?:\./[\w./-]+|(?:{STARTERS})\b)"
COMMAND_IN_LINE = rf"(?:^|\s)(\./[\w./-]+|(?:{STARTERS})\b(?: [^`\"\n,.;:!?]+)*)"
RUN = rf"\brun\s+(\./[\w./-]+|(?:{STARTERS})\b[^`\n,.;:!?]*)"
TICKED = r"`([^`\n]+)`"
TASK_ID = r"^td-[0-9a-z]{4,}"
IDLE = [
    "awk", "brew", "bun", "cargo", "cat", "curl", "docker", "gh", "git", "go", "gog", "grep", "hubctl", "jq", "kubectl", "mise", "node", "npm",
    "op", "pnpm", "python", "python3", "rg", "sed", "sqlite3", "ssh", "tar", "td", "uv", "wget", "wt", "yarn",
]
POSIX_PATH = r"/(?:Users|home|tmp|var|opt|private|Volumes)/[^\s\"'`]+"
WINDOWS_PATH = r"[A-Za-z]:\\[^\s\"'`]+"


def all_of(c: Column, pattern: str, group: int = 0) -> Column:
    return F.coalesce(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def _all_with(c: Column, part: str, pattern: str, group: int = 0) -> Column:
    """``all_of`` where ``part``, which every match has in some case, is; else nothing."""
    return F.when(F.contains(F.lower(c), F.lit(part)), all_of(c, pattern, group)).otherwise(F.array().cast("array<string>"))


def paths_in(sources: Column) -> Column:
    """Distinct POSIX and Windows paths of an array of texts, in order."""
    each = F.transform(sources, lambda s: F.concat(_all_with(s, "/", POSIX_PATH), _all_with(s, ":\\", WINDOWS_PATH)))
    return F.array_distinct(F.flatten(each))


def _lines_of(s: Column) -> Column:
    lines = F.filter(F.transform(F.split(s, "\n"), trimmed), lambda x: matches(x, COMMAND_LINE))
    return F.flatten(F.transform(lines, lambda x: all_of(x, rule(COMMAND_IN_LINE, ignore_case=False), 0)))


def commands_in(sources: Column, tool_input: Column) -> Column:
    """Distinct commands: a tool input that is one, then those in ticks, on lines of their own, and after "run"."""
    given = F.when(matches(trimmed(tool_input), COMMAND_LINE), F.array(tool_input)).otherwise(F.array().cast("array<string>"))
    given = F.coalesce(given, F.array().cast("array<string>"))
    each = F.transform(sources, lambda s: F.concat(_all_with(s, "`", TICKED, 1), _lines_of(s), _all_with(s, "run", rule(RUN), 1)))
    found = F.filter(F.transform(F.flatten(each), trimmed), lambda x: F.length(x) > 0)
    return F.array_distinct(F.concat(given, found))


def normal(c: Column) -> Column:
    """A command in normal form, or null if it is none: first line, squeezed, no final stops, not a task id or an idle name."""
    bare = F.regexp_replace(trimmed(c), r"\A`+|`+\z", "")
    line = squeezed(F.substring_index(bare, "\n", 1))
    t = F.regexp_replace(line, r"[.,;:!?]+\z", "")
    idle = ~F.contains(t, F.lit(" ")) & F.lower(t).isin(IDLE)
    return F.when((F.length(t) > 0) & matches(t, COMMAND) & ~matches(t, TASK_ID) & ~idle, t)


def candidates(commands: Column, input_text: Column, text: Column) -> Column:
    """What a record offers as commands: its own, its tool input and the code in ticks, in that order."""
    own = F.coalesce(commands, F.array().cast("array<string>"))
    return F.concat(own, F.array_compact(F.array(input_text)), F.transform(all_of(text, TICKED, 1), trimmed))


def with_normal(records: DataFrame) -> DataFrame:
    """``records`` (commands, input_text, text) with the normal commands of each as an array; those that have it stay as they are."""
    offered = candidates(F.col("commands"), F.col("input_text"), F.col("text"))
    return records if "_normal" in records.columns else records.withColumn("_normal", F.filter(F.transform(offered, normal), lambda x: x.isNotNull()))


def by_turn(turns: DataFrame) -> DataFrame:
    """turn_id and commands_seen of grouped records: distinct normal commands in order of appearance."""
    rows = with_normal(turns).select("turn_id", "line", F.col("_normal").alias("c"))
    pairs = rows.where(F.size("c") > 0).groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct("line", "c"))).alias("p"))
    return pairs.select("turn_id", F.array_distinct(F.flatten(F.transform("p", lambda x: x.c))).alias("commands_seen"))


def entries(turns: DataFrame) -> DataFrame:
    """Each distinct command of a session, with the turn and line where it is first seen."""
    offered = candidates(F.col("commands"), F.col("input_text"), F.col("text"))
    rows = turns.select("session_id", "turn_id", "turn_index", "line", F.posexplode(F.transform(offered, normal)).alias("pos", "command")).where("command is not null")
    first = Window.partitionBy("session_id", "command").orderBy("turn_index", "line", "pos")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").select("session_id", "command", "turn_id", F.col("line").alias("first_seen_line"))
