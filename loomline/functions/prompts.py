"""What a prompt says once wrappers, tags and boot lines are gone, and whether that is a signal at all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.text import contains_one, filled, let, listed, matches, matches_any, rule, shortened, squeezed, text_lines, trimmed

# Tags whose blocks are wrappers, and the patterns of lines and prompts without a signal.
WRAPPER_TAGS = [
    "instructions", "environment_context", "cursor_commands", "skill", "system[-_]reminder", "command-message", "command-name", "command-args",
    "task-notification", "local-command-(?:stdout|stderr)", "user-prompt-submit-hook", "bash-(?:input|stdout|stderr)", "user_info", "rules",
    "agent_skills", "mcp_instructions", "open_and_recently_viewed_files", "git_status", "agent_transcripts", "attached_files", "code_selection", "plugin_info",
]
SKILL_BLOCK = r"<skill\b[^>]*>[\s\S]*?(?:</skill>|\z)"
SKILL_FILE = r"(?:^|\s)[^\s]*/SKILL\.md\b"
ANY_TAG = r"</?[a-z_:-]+(?:\s+[^>]*)?>"
BOOT_LINES = [
    r"^#\s*(?:AGENTS|CLAUDE)\.md\b",
    r"^(?:AGENTS|CLAUDE)\.md\s+instructions\s+for\b",
    r"^(?:system[-_]reminder|environment_context|command-message|command-name|command-args|task-notification|local-command-(?:stdout|stderr)|user-prompt-submit-hook|bash-(?:input|stdout|stderr))\b",
    r"^turn_aborted$",
    r"^Caveat:",
    r"^\[Request interrupted by user\b",
    r"^\[Image:[^\]]+\]$",
    r"^Follow project (?:rules|standards)\.?$",
    r"^</?[a-z_:-]+",
    r"^(?:instructions|environment_context|cursor_commands)\b",
    r"^✓",
    r"^Test Files\b",
    r"^Duration\b",
]
SKILL_LINES = [
    r"^</?skill\b",
    r"/SKILL\.md\b",
    r"^Base directory for this skill\b",
    r"^Skill (?:file|directory|location)\b",
    r"^Use when\b",
    r"^Triggers?\b",
    r"^Description:\s",
    r"^(?:Using|I am using) (?:the )?[\w-]+\s+skill\b",
    r"^Read (?:the )?`[^`]*/SKILL\.md`",
]
SKILL_LEAKS = [r"</?skill\b", r"\bBase directory for this skill\b", r"^(?:using|i am using)\s+(?:the\s+)?[\w-]+\s+skill\b"]
NO_SIGNAL = [
    r"^(?:hello|hi|hey|ping|test)\b[!.?]*$",
    r"^say\s+one\b",
    r"^what\s+is\s+2\s*\+\s*2\??$",
    r"^first\s+message\b",
    r"^\[?(?:redacted\s+)?user\s+message(?:\s+unavailable)?\]?$",
    r"^(?:thanks|thank you|thx|ty)\b[!.?]*$",
    r"^(?:ok|okay|k|yep|yes|no|nope)\b[!.?]*$",
    r"^(?:good|great|cool|nice)\b[!.?]*$",
    r"^what(?:'s| is) (?:your|the) name\??$",
    r"^who are you\??$",
    r"^are you there\??$",
    r"^can you hear me\??$",
    r"^\?+$",
]
EMBEDDED_AGENT = [
    r"^you are an? [\w'’-]+(?:[\s,][\w'’-]+){0,8}\b",
    r"^you are the [\w'’-]+(?:[\s,][\w'’-]+){0,8}\b",
    r"\byour (?:task|role|job) is to\b",
    r"\bgiven the user'?s most recent message\b",
    r"\byou (?:must|should) (?:respond|reply|output|return) (?:only )?(?:with|in|using) (?:valid )?json\b",
    r"^(?:respond|reply|output|return|answer)\b[^.]{0,40}?\b(?:only )?(?:with|in|using|as) (?:valid |raw )?json\b",
]
#: Words of which every program's prompt has one, whatever wrappers are around and within it.
AGENT_WORDS = ["you", "json", "recent"]
WORK_WORDS = r"\b(?:fix|implement|refactor|debug|error|failing|tests?|build|commit|prs?|pull requests?|merge|review)\b"
PROCESS_START = (
    r"^(?:let me|i(?:'|')ll|i will|i need to|i(?:'|')m|checking|exploring|now let me|now i(?:'|')ll|now i(?:'|')m|first, let me|first, i(?:'|')ll|first, i(?:'|')m"
    r"|now\s+(?:stage|regenerate|check|inspect|read|review|run|verify|commit|add|update|fix|implement|create|write))\b"
)
DURABLE_OUTCOME = r"\b(?:fixed|resolved|implemented|updated|added|removed|replaced|merged|pushed|verified with|tests? pass(?:ed)?|build succeeded|all checks passed)\b"
DONE = r"\b(?:done|completed|implemented|fixed|resolved|merged|pushed)\b"
PROVEN = r"\b(?:verified|tests? pass(?:ed)?|all checks passed|0 failures)\b"
WRAPPED = r"<(?:attached_files|code_selection|plugin_info|skill)\b"
MISSING_STATEMENTS = ["", "Rejected learning", "__missing_statement__"]
RAW_PREFIX = r"^(?:completed|fixed done|yes[—-]|you(?:'|’)re right|now fix|here is|here(?:'|’)s|summary)"
TRANSIENT = r"\b(?:continue investigating|investigating remaining|line \d+|l\d+ fixed|tests? pass|coverage|verified with `?\./scripts/qa`?)\b"
FRAMED = r"\A\s*(?:Verified:|Done\s*[-—]|Good\s*[-—]|Summary of changes:|Summary of what changed:|\*\*Verdict:\*\*|Verdict:)"
#: What a statement has of which anything is taken off.
MARKED = rf"(?mi)```|[|#*_\[]|^\s*[-+]\s|{FRAMED}"
MARKDOWN_LEFT = r"(?m)\*\*|^#+\s|\|\s*-{2,}\s*\|"


def _erased(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, rule(pattern), " ")


def without_tags(c: Column) -> Column:
    return _erased(c, ANY_TAG)


def cleaned_prompt(c: Column) -> Column:
    """A prompt without wrapper blocks and tags; a user_query section stands for the whole."""
    def files_erased(x: Column) -> Column:
        return F.when(F.contains(F.lower(x), F.lit("/skill.md")), _erased(x, SKILL_FILE)).otherwise(x)

    def unwrapped(x: Column) -> Column:
        for tag in ("attached_files", "code_selection", "plugin_info"):
            x = _erased(x, rf"<{tag}\b[^>]*>[\s\S]*?</{tag}>")
        x = let(_erased(x, SKILL_BLOCK), files_erased)
        x = _erased(x, rf"<({'|'.join(WRAPPER_TAGS)})\b[^>]*>[\s\S]*?</\1>")
        x = let(x, lambda y: F.coalesce(filled(F.regexp_extract(y, r"(?i)<user_query>([\s\S]*?)</user_query>", 1)), y))
        return without_tags(x)

    # Every wrapper and tag has a "<".
    plain = let(c, lambda x: F.when(F.contains(x, F.lit("\r")), F.translate(x, "\r", "\n")).otherwise(x))
    t = let(plain, lambda x: F.when(F.contains(x, F.lit("<")), unwrapped(x)).otherwise(files_erased(x)))
    spaced = let(t, lambda x: F.when(F.contains(x, F.lit("\n")), F.regexp_replace(F.regexp_replace(x, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")).otherwise(x))
    return trimmed(spaced)


def skill_line(line: Column) -> Column:
    return matches_any(line, SKILL_LINES)


def boot_line(line: Column) -> Column:
    return (F.length(line) == 0) | matches_any(line, BOOT_LINES + SKILL_LINES)


def skill_leak(line: Column) -> Column:
    return matches_any(line, SKILL_LEAKS + SKILL_LINES)


def substantive(c: Column) -> Column:
    """The lines that are neither boot nor skill lines, or null if none are."""
    kept = F.filter(text_lines(cleaned_prompt(c)), lambda x: ~boot_line(x))
    return F.nullif(F.array_join(kept, "\n"), F.lit(""))


def without_leaks(c: Column) -> Column:
    return F.coalesce(substantive(c), F.lit(""))


def embedded_agent(c: Column) -> Column:
    """Whether a prompt is another program's system prompt."""
    found = let(squeezed(substantive(c)), lambda t: matches_any(t, EMBEDDED_AGENT))
    return F.coalesce(contains_one(F.lower(c), AGENT_WORDS) & found, F.lit(False))


def no_signal_line(line: Column) -> Column:
    """Whether one squeezed line is small talk, a probe or another program's prompt."""
    small = (
        (F.length(line) <= 48)
        & ~matches(line, WORK_WORDS)
        & ~line.rlike(r"[`$\\/]")
        & line.rlike(r"(?i)^[\w\s'?,!.+-]+\z")
        & (matches_any(line, NO_SIGNAL) | (F.length(line) <= 24))
    )
    return small | matches_any(line, EMBEDDED_AGENT) | matches_any(line, NO_SIGNAL)


def no_signal(c: Column) -> Column:
    return F.coalesce(let(squeezed(substantive(c)), no_signal_line), F.lit(True))


def wrapper_only(c: Column) -> Column:
    lines = text_lines(substantive(c))
    return F.coalesce(F.forall(lines, lambda x: boot_line(x) | skill_leak(x)), F.lit(True))


def chatter_line(line: Column) -> Column:
    return let(trimmed(line), lambda t: matches(t, PROCESS_START) & ~matches(t, DURABLE_OUTCOME))


def has_chatter(c: Column) -> Column:
    return F.exists(F.split(c, "\n"), chatter_line)


def completed(c: Column) -> Column:
    return matches(c, DONE) & matches(c, PROVEN)


def has_wrapper_tags(c: Column) -> Column:
    return matches(c, WRAPPED)


def atomic(c: Column) -> Column:
    """Whether a text is one sentence: at most one run of stops before white space or the end."""
    t = trimmed(c)
    return (F.length(t) > 0) & (F.size(F.regexp_extract_all(t, F.lit(r"[.!?]+(?:\s|\z)"), F.lit(0))) <= 1)


def statement_flags(c: Column) -> Column:
    """What is wrong with a suggested statement."""
    t = trimmed(c)
    return listed(
        ("missing_statement", t.isin(MISSING_STATEMENTS)),
        ("too_long", F.length(t) > 180),
        ("raw_prefix", matches(t, RAW_PREFIX)),
        ("transient_or_validation_detail", matches(t, TRANSIENT)),
        ("markdown_residue", t.rlike(MARKDOWN_LEFT)),
    )


def cleaned_statement(c: Column, keep_lines: bool = False) -> Column:
    """A statement without code fences, tables, headings, emphasis, links, bullets and framing.

    A table cuts the text at its first separator row, or at the row or heading just before it.
    """
    t = let(c, lambda x: F.when(x.rlike(MARKED), _unmarked(x)).otherwise(x))
    return trimmed(F.regexp_replace(t, r"[ \t]+", " ")) if keep_lines else squeezed(t)


def _unmarked(c: Column) -> Column:
    t = F.regexp_replace(c, r"(?m)^```[\s\S]*?^```", " ")
    t = F.regexp_replace(t, r"(?m)^```[\s\S]*\z", " ")
    heading = r"(?:^#{1,6}\s+[^\n]*\n(?:\s*\n){0,3})?"
    row = r"(?:^\s*\|(?:[^\n]+\|)+[^\n]*\n)?"
    table = rf"(?m){heading}{row}^\s*\|?\s*:?-+:?\s*\|"
    t = let(t, lambda x: F.when(F.regexp_instr(x, F.lit(table)) > 0, F.substring(x, F.lit(1), F.regexp_instr(x, F.lit(table)) - 1)).otherwise(x))
    t = F.regexp_replace(t, r"\s*\|\s*", " ")
    t = F.regexp_replace(t, r"(?m)^(#{1,6})\s+([^\n]+)$", " $2 ")
    t = F.regexp_replace(t, r"(\*\*|__)([^\n]+?)\1", " $2 ")
    t = F.regexp_replace(t, r"(?<![\w*])\*([^\n\s][^\n]*?)\*(?![\w*])", " $1 ")
    t = F.regexp_replace(t, r"(?<!\w)_([^\n\s][^\n]*?)_(?!\w)", " $1 ")
    t = F.regexp_replace(t, r"\[([^\]]+)\]\([^)]+\)", "$1")
    t = F.regexp_replace(t, r"(?m)^\s*[-*+]\s+", " ")
    return F.regexp_replace(t, rf"(?i){FRAMED}\s*", " ")


def cleaned_title(title: Column, statement: Column, size: int) -> Column:
    """A title of a prefix and a body; a body with markup gives way to the statement."""
    at = F.instr(title, ":")
    markup = title.rlike(r"(?i)</?skill")

    def chosen(x: Column) -> Column:
        clean = (F.length(x.body) > 0) & ~skill_leak(x.body) & ~x.body.rlike(r"(?i)</?skill|\*\*|\||#\s+") & ~markup
        whole = F.concat(trimmed(F.substring(title, F.lit(1), at - 1)), F.lit(": "), shortened(F.when(clean, x.body).otherwise(x.said), size))
        return F.when(F.length(x.said) == 0, "").when(at == 0, shortened(x.said, size)).otherwise(whole)

    body = cleaned_statement(without_leaks(F.substring(title, at + 1, F.length(title))))
    return let(F.struct(without_leaks(statement).alias("said"), body.alias("body")), chosen)
