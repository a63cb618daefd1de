"""Events in turns: decisions, failures, fixes, next steps and verifications, and the summaries they focus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.prompts import completed
from loomline.functions.statements import markdown_marks
from loomline.functions.text import excerpt_around, filled, first_rule, guarded, head_and_tail, head_excerpt, matches, matches_any, rule, shortened, squeezed
from loomline.operators.commands import with_normal
from loomline.operators.turns import ASSISTANT, TOOL_RESULT, TOOL_USE
from loomline.sources.scratch import once_each

# Patterns of each event type, in the order in which the first match is taken.
PATTERNS = {
    "failure": [
        r"\bfailed\b",
        r"\berror\b.+(?:\b(?:occurred|thrown|returned|found|detected|encountered|prevented|stopped|blocked|caused|in)\b|:\s*\w+)",
        r"\b(?:fatal|critical|uncaught)\s+error\b",
        r"\bexception\b",
        r"\btimed out\b",
        r"\bunable to\b",
        r"\bno such\b",
        r"\benoent\b",
        r"\beacces\b",
    ],
    "fix": [
        r"\bfixed\b",
        r"\bresolved\b",
        r"\bpatched\b",
        r"\bcorrected\b",
        r"\bupdated\b.+\bto (?:fix|handle|avoid)\b",
        r"\bchanged\b.+\bto (?:fix|handle|avoid)\b",
        r"\broot cause was\b",
    ],
    "decision": [
        r"\bdecided to\b",
        r"\bchose to\b",
        r"\bgoing with\b",
        r"\bopted to\b",
        r"\bkept\b.+\bfor now\b",
        r"\brecommend(?:ed|ation)?\b",
        r"\bbest (?:default|choice|option|approach)\b",
        r"\btop (?:pick|choice|recommendation|candidate)\b",
        r"\b(?:winner|preferred|favored)\b",
        r"\b(?:chose|selected|picked)\b.+\bover\b",
        r"\bgo with\b",
        r"\b(?:should use|prefer)\b.+\bfor\b",
        r"\barchitecture decision\b",
        r"\bwe (?:will|should|could) use\b",
        r"\bthe approach (?:is|will be)\b",
        r"\b(?:v\d|version \d).+\b(?:epic|roadmap|milestone|plan)\b",
        r"\b(?:create|write|draft|produce)\b.+\bspec(?:ification)?\b",
        r"\b(?:design|approach).+\bfor\b.+\bis\b",
        r"\bconclusion:?\b",
        r"\b(?:verdict|outcome|result).+\b(?:is|was)\b",
        r"\b(?:ranking|comparison|versus|vs\.?)\b",
    ],
    "next_step": [
        r"\bnext step\b",
        r"\bnext i(?:'|’)ll\b",
        r"\bstill need to\b",
        r"\bremaining (?:work|task|issue|step|item)s?\b",
        r"\bleft to do\b",
        r"\bfollow-?up (?:needed|required|is|will|task|item|step)s?\b",
    ],
    "verification": [r"\bverified\b", r"\bconfirmed\b", r"\btests? pass(?:ed)?\b", r"\bbuild succeeded\b", r"\ball checks passed\b"],
}
#: Parts in lower case of which every match of a pattern has one.
NEEDED = {
    p: needed
    for name, parts in {
        "failure": [["failed"], ["error"], ["error"], ["exception"], ["timed out"], ["unable to"], ["no such"], ["enoent"], ["eacces"]],
        "fix": [["fixed"], ["resolved"], ["patched"], ["corrected"], ["updated"], ["changed"], ["root cause was"]],
        "decision": [
            ["decided to"], ["chose to"], ["going with"], ["opted to"], ["for now"], ["recommend"], ["best "], ["top "], ["winner", "preferred", "favored"], ["chose", "selected", "picked"], ["go with"], ["should use", "prefer"],
            ["architecture decision"], ["we "], ["the approach"], ["epic", "roadmap", "milestone", "plan"], ["spec"], ["design", "approach"], ["conclusion"], ["verdict", "outcome", "result"], ["ranking", "comparison", "versus", "vs"],
        ],
        "next_step": [["next step"], ["next i"], ["still need to"], ["remaining"], ["left to do"], ["follow"]],
        "verification": [["verified"], ["confirmed"], ["pass"], ["build succeeded"], ["all checks passed"]],
    }.items()
    for p, needed in zip(PATTERNS[name], parts, strict=True)
}
VERIFYING_COMMAND = (
    r"^(?:\./[\w./-]+|npm(?: run)? build|npm test|pnpm(?: run)? build|pnpm test|yarn build|yarn test|bun test|cargo test|go test|python(?:3)? -m pytest"
    r"|uv run pytest|just (?:test|check|build|lint|ci|qa|verify)[\w-]*|script/(?:test|cibuild)\b|qa)\b"
)
NOISE = [r"<attached_files>", r"<code_selection\b", r"<plugin_info\b", r"<question-form\b", r"<answer-form\b"]
EXCERPT = 240
SHORT, WIDE, FOCUS, LEAST, MOST_FOCUS = 240, 1600, 600, 20, 2
NO_SUMMARY = "No assistant summary captured."


def _by_rule(c: Column, patterns: list[str], at: Column) -> Column:
    """The excerpt around the match of the rule whose number is ``at``."""
    return excerpt_around(c, F.get(F.array(*(F.lit(rule(p)) for p in patterns)), at), EXCERPT)


def verifying_command(kind: Column, input_text: Column, commands: Column) -> Column:
    """The squeezed command of a tool call that checks the work; else null."""
    said = squeezed(F.coalesce(input_text, F.get(commands, F.lit(0))))
    return F.when((kind == TOOL_USE) & matches(said, VERIFYING_COMMAND), said)


def noisy(text: Column) -> Column:
    """Whether a message quotes attachments or forms."""
    return F.coalesce(F.contains(text, F.lit("<")) & matches_any(text, NOISE), F.lit(False))


def verifies(kind: Column, text: Column, input_text: Column, commands: Column) -> Column:
    """Whether a record is a verification: a message that says so, or a tool call that checks the work. ``tagged`` finds the same."""

    def said(t: Column) -> Column:
        found = F.lit(False)
        for p in PATTERNS["verification"]:
            found = found | guarded(t, F.lower(t), p, NEEDED[p])
        return found & ~noisy(t)

    return F.coalesce((kind == ASSISTANT) & said(filled(text)), F.lit(False)) | verifying_command(kind, input_text, commands).isNotNull()


def with_findings(records: DataFrame) -> DataFrame:
    """``records`` (kind, text, input_text, commands) with what is found in each, as an array; those that have it stay as they are.

    A message gives at most one finding of each type, of the first pattern found.
    """
    if "_found" in records.columns:
        return records
    kind, text = F.col("kind"), filled(F.col("text"))
    quiet = records.withColumn("_text", text).withColumns({"_noise": noisy(F.col("_text")), "_lower": F.lower("_text")})
    speaks = {"failure": kind.isin(ASSISTANT, TOOL_RESULT, TOOL_USE)}
    found = []
    for order, (name, patterns) in enumerate(PATTERNS.items()):
        t, at = F.col("_text"), F.col(f"_{name}")
        allowed = speaks.get(name, kind == ASSISTANT) & ~F.col("_noise")
        if name == "next_step":
            allowed = allowed & ~completed(t)
        quiet = quiet.withColumn(f"_{name}", F.when(allowed, first_rule(t, patterns, F.col("_lower"), NEEDED)))
        excerpt = _by_rule(t, patterns, at)
        if name == "fix":
            excerpt = F.when(markdown_marks(t) >= 3, head_excerpt(t, EXCERPT)).otherwise(excerpt)
        if name == "verification":
            excerpt = F.concat(F.lit("Verification noted: "), excerpt)
        named = F.get(F.array(*map(F.lit, patterns)), at)
        sure = "high" if name == "failure" else "medium"
        found.append(F.when(at.isNotNull(), F.struct(F.lit(order).alias("ord"), F.lit(name).alias("type"), excerpt.alias("summary"), named.alias("matched_rule"), F.lit(sure).alias("confidence"), F.lit(None).cast("string").alias("verification_command"))))
    command = verifying_command(kind, F.col("input_text"), F.col("commands"))
    ran = F.concat(F.lit("Ran verification command: "), F.col("_command"))
    found.append(F.when(F.col("_command").isNotNull(), F.struct(F.lit(len(found)).alias("ord"), F.lit("verification").alias("type"), ran.alias("summary"), F.lit("verification_command").alias("matched_rule"), F.lit("high").alias("confidence"), F.col("_command").alias("verification_command"))))
    return quiet.withColumn("_command", command).select(*records.columns, F.array_compact(F.array(*found)).alias("_found"))


def read_once(records: DataFrame) -> DataFrame:
    """``records``, which should be ``stored``, with findings and normal commands, worked out once for each distinct text."""
    return once_each(records, ["kind", "text", "input_text", "commands"], lambda v: with_normal(with_findings(v)), "read")


def tagged(turns: DataFrame) -> DataFrame:
    """Events of grouped records (columns of ``turns.grouped`` and input_text), one per finding.

    Within a turn, equal types with equal summaries (in any case) count once, at their first line.
    """
    rows = with_findings(turns).select("session_id", "turn_id", "turn_index", "line", "kind", "commands", "files", F.explode("_found").alias("e"))
    same = Window.partitionBy("turn_id", "e.type", F.lower("e.summary")).orderBy("line", "e.ord")
    first = rows.withColumn("_n", F.row_number().over(same)).where("_n = 1")
    event_id = F.concat("turn_id", F.lit(":"), F.col("e.type"), F.lit(":"), F.lpad(F.col("line").cast("string"), 6, "0"))
    return first.select("session_id", "turn_id", "turn_index", event_id.alias("event_id"), "line", "kind", "commands", "files", "e.type", "e.summary", "e.matched_rule", "e.confidence", "e.verification_command")


def focused(turns: DataFrame, events: DataFrame) -> DataFrame:
    """turn_id and focus: assistant messages at or after the turn's failures, verifications and failed tools, in order.

    A forward as-of join without a join: the first assistant message at or after each line is a
    window over the turn, and the signal lines pick theirs.
    """
    signal = events.where(F.col("type").isin("failure", "verification")).select("turn_id", "line").distinct().withColumn("_signal", F.lit(True))
    failed = (F.col("kind") == TOOL_RESULT) & F.coalesce(F.col("status").rlike("(?i)fail|error"), F.lit(False))
    ahead = Window.partitionBy("turn_id").orderBy("line").rowsBetween(0, Window.unboundedFollowing)
    answer = F.first(F.when(F.col("kind") == ASSISTANT, F.struct("line", "text")), ignorenulls=True).over(ahead)
    marked = turns.join(signal, ["turn_id", "line"], "left").withColumn("_answer", answer)
    picked = marked.where((F.col("_signal") | failed) & filled(F.col("_answer.text")).isNotNull())
    order = picked.groupBy("turn_id", "_answer").agg(F.min(F.struct((~failed).cast("int").alias("late"), "line")).alias("at"))
    listed = order.groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct("at", F.col("_answer.text").alias("text")))).alias("f"))
    return listed.select("turn_id", F.transform("f", lambda x: x.text).alias("focus"))


def summary(messages: Column, focus: Column) -> Column:
    """What the assistant said: the head, or with a signal up to two focus excerpts and then the head of the rest."""
    head = shortened(F.array_join(messages, " "), SHORT)
    plain = F.when(F.length(head) > 0, head).otherwise(F.lit(NO_SUMMARY))
    first = head_and_tail(F.get(focus, F.lit(0)), FOCUS)
    second = F.when(F.size(focus) > 1, head_and_tail(F.get(focus, F.lit(1)), FOCUS))
    used = F.length(first) + 1 + F.coalesce(F.length(second) + 1, F.lit(0))
    left = F.lit(WIDE) - used
    others = squeezed(F.array_join(F.array_except(messages, focus), " "))
    cut = F.concat(F.rtrim(F.substring(others, F.lit(1), left - 3)), F.lit("..."))
    rest = F.when((left >= LEAST) & (F.length(others) > 0), F.when(F.length(others) <= left, others).otherwise(cut))
    return F.when(F.coalesce(F.size(focus), F.lit(0)) < 1, plain).otherwise(F.concat_ws(" ", first, second, rest))


def canonical_turns(rolled: DataFrame, events: DataFrame, focus: DataFrame) -> DataFrame:
    """``turns.rolled_up`` with verification_seen and assistant_summary."""
    seen = events.groupBy("turn_id").agg(F.bool_or(F.col("type") == "verification").alias("seen"))
    out = rolled.join(seen, "turn_id", "left").join(focus, "turn_id", "left")
    return out.select(*rolled.columns, F.coalesce("seen", F.lit(False)).alias("verification_seen"), summary(F.col("assistant_messages"), F.col("focus")).alias("assistant_summary"))


def resolutions(events: DataFrame) -> DataFrame:
    """Each failure with the first fix (else the first verification) of its turn."""
    turn = Window.partitionBy("turn_id")
    fix = F.min(F.when(F.col("type") == "fix", F.struct("line", "event_id", "summary"))).over(turn)
    check = F.min(F.when(F.col("type") == "verification", F.struct("line", "event_id", "summary"))).over(turn)
    out = events.withColumn("by", F.coalesce(fix, check)).where("type = 'failure' and by is not null")
    return out.select("session_id", "turn_id", "event_id", "summary", F.col("by.event_id").alias("by_event_id"), F.col("by.summary").alias("by_summary"))
