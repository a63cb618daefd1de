"""Judging and tidying the statements that events make: narration, dumps, error signatures, paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.prompts import has_chatter
from loomline.functions.text import EDGE, let, matches, matches_any, rule, squeezed, trimmed

# The words and patterns of the rules.
NARRATION = [
    r"\b(?:let me|i(?:'|’)m checking|i(?:'|’)ll check|i need to check|checking whether|now let me|clarifying)\b",
    r"\b(?:would be like|what(?:'|’)s next\?|continue workflow|recommended\)|generation runs, but)\b",
    r"\bi can detect\b",
    r"^summary of what was done",
]
PROCESS_PREFIXES = [
    "reading ", "loading ", "creating a ", "implementing ", "adding ", "updating ", "now i have enough context", "now i understand", "now i see",
    "first, the ", "i see - there's", "i see - the", "i need to add", "i need to update", "i need to fix", "rust compiles and",
    "the toast infrastructure", "the command infrastructure", "--- ## ",
]
ERRNO = [
    "EACCES", "EADDRINUSE", "EADDRNOTAVAIL", "EAGAIN", "EBADF", "EBUSY", "ECANCELED", "ECONNABORTED", "ECONNREFUSED", "ECONNRESET", "EEXIST",
    "EFAULT", "EFBIG", "EHOSTUNREACH", "EINTR", "EINVAL", "EIO", "EISDIR", "ELOOP", "EMFILE", "EMLINK", "ENAMETOOLONG", "ENETDOWN",
    "ENETUNREACH", "ENFILE", "ENOBUFS", "ENODEV", "ENOENT", "ENOMEM", "ENOSPC", "ENOSYS", "ENOTCONN", "ENOTDIR", "ENOTEMPTY", "ENOTFOUND",
    "ENOTSOCK", "ENOTSUP", "ENXIO", "EOPNOTSUPP", "EOVERFLOW", "EPERM", "EPIPE", "EPROTO", "EPROTONOSUPPORT", "EPROTOTYPE", "ERANGE", "EROFS",
    "ESHUTDOWN", "ESPIPE", "ESRCH", "ETIMEDOUT", "EXDEV",
]
MARKDOWN_MARK = r"(?:^|\s)(?:#{1,6}\s+|[-*]\s+|\d+\.\s+|\*\*[^*]+:\*\*)"
DUMP_WORDS = ["Traceback (most recent call last)", "\n    at ", "npm ERR!", "pnpm ERR!", "Base directory for this skill", "/SKILL.md", "<skill", "Use when:", "Triggers:", "Description:"]
LOCAL_PATH = r"\b(?:src|lib|app|server|scripts|tools|docs|tests?|api|core|shared|desktop|mobile)/[^\s]+"
ADVICE = r"\b(?:use|keep|avoid|run|configure|prefer|move|add|remove)\b"
PAST = (
    r"^(?:fixed|resolved|updated|changed|patched|corrected|added|implemented|replaced|removed|wired|pre-?production\b[\s\S]{0,120}\bare implemented\b"
    r"|all\b[\s\S]{0,80}\boptimizations\b)"
)
CHANGE_HEADS = "What changed|Changed|Changes|Implemented|Delivered|Updates|Change|Summary|Summary of changes"
DEAD_END = r"\b(?:abandoned|gave up on|dead[- ]ends?|not viable|wasn['’]t viable|won['’]t work|did(?:n['’]t| not) pan out|turned out not to work|was a waste of time)\b"
TRIED = r"\b(?:tried|attempted|experimented with)\s+(?:to\s+)?(.+?)(?=\s+(?:but|because|then|so|,|;|—)|[.!?]|\z)"
TECHNOLOGY = r"`([^`\n]+)`"
BLOCK_HEADS = r"\*\*(?:Done|Verified|Changed|Changes|Implemented|Summary of changes):\*\*"
BLOCK_SUMMARY = r"summary of what was done"
CHAT_OPENINGS = r"^(got it|sure thing|sure[,!.]|absolutely[,!.]|of course[,!.]|great question|happy to help|no problem)\b"
CHAT_STARTS = [
    "now i have the full picture", "clean.", "created to-dos", "created todos", "here's a summary", "here\u2019s a summary", "here is a summary",
    "summary:", "summary of what", "summary of every", "it depends on the source",
]
CHAT_PARTS = [r"\bgaps\s+vs\b", r"\bsummary of every fix\b"]
REVIEW_STARTS = ["## pragmatic code review", "pragmatic code review"]
REVIEW_PARTS = [r"^(?:#{2,3}\s+)?pragmatic code review\b", r"\b(?:must-fix|nice-to-have)\b"]
DURABLE_DECISION = [
    r"\b(?:decided|chose) to\b",
    r"\b(?:keep|use|prefer)\b[\s\S]{0,120}\bbecause\b",
    r"\bshould use\b[\s\S]{0,120}\bfor\b",
    r"\bthe rule protects\b",
    r"\bgeneration should\b",
    r"\bsingle (?:result )?error channel\b",
    r"\bcanonical\b",
    r"\bsource of truth\b",
]
EXPLAINED_STARTS = ["here's how ", "here is how ", "here\u2019s how ", "here's what ", "here is what ", "here\u2019s what ", "## diff review", "### diff review", "--- ## "]
OVERVIEW_STARTS = ["here is a ", "here's a ", "here\u2019s a "]
OVERVIEW = r"\b(?:plan|summary|overview|guide|tutorial)\b"
WORKFLOW_DUMP_START = "fixed completed; verified"
WORKFLOW_DUMP = [r"\*\*(?:delivered|implemented|summary|summary of changes|changes|verified):\*\*", r"\|\s*-{2,}\s*\|"]
OWN_CHECKS = [r"^Run `?\./scripts/qa`?", r"^Use `\./scripts/qa` for "]
PATTERN_BLOCKS = [
    r"\*\*(?:Done|Verified|Changed|Changes|Implemented|Summary of changes|Cause):\*\*",
    r"\b(?:Summary of what changed|Summary of changes|The four meaningful changes are|perfect alignment)\b",
]
PATTERN_TALK = r"\bhere(?:'|\u2019)s what(?:'|\u2019)s going on\b"
FAILURE_TALK = r"^(?:The log ends right after|The CSS is fine|Now let me check)"
WORKFLOW_TALK = r"^(?:Completed|Fixed)\s+(?:summary of what|summary of changes|summary of what was fixed|desktop checks are green|cargo failed with)"
CHANGE_VERB = (
    r"\b(?:use|add|remove|replace|switch|configure|implement|migrate|upgrade|fix|set|change|move|prefer|avoid|keep|run|pre-?bundle|pre-?load|enable|disable)\b"
)
SUMMARY_HEADS = r"\b(?:Summary of changes|Summary of what changed|Implemented|Verification noted)\s*:?\s*"
SEPARATOR = r"(?<=\S)\s+[-–—]\s+(?=\S)|:\s+"
CLAUSE_BREAK = r"\s+(?:[-•*]|–|—)\s+"


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def narration(c: Column) -> Column:
    """Whether a text tells what is being done rather than what came of it."""
    return has_chatter(c) | matches_any(trimmed(c), NARRATION)


def process_text(c: Column) -> Column:
    t = F.lower(trimmed(c))
    return has_chatter(c) | reduce(lambda a, b: a | b, [F.startswith(t, F.lit(p)) for p in PROCESS_PREFIXES])


def completion_not_failure(c: Column) -> Column:
    t = F.lower(trimmed(c))
    heading = F.startswith(t, F.lit("## ")) & ~F.contains(t, F.lit("error")) & ~F.contains(t, F.lit("fail"))
    verified = matches(t, r"\bverified\b.+(?:against|with|using)\b") & ~matches(t, r"\b(?:error|fail|exception)\b")
    return t.rlike(r"^(?:\*\*done:\*\*|summary of what['’]s done:)") | heading | verified | (F.startswith(t, F.lit("--- ## ")) & matches(t, r"\bbatch \d+ complete\b"))


def markdown_marks(c: Column) -> Column:
    return F.regexp_count(c, F.lit(MARKDOWN_MARK))


def raw_dump(c: Column) -> Column:
    """Whether a text is output or notes pasted whole: JSON findings, traces, skill files, long prose."""
    return let(trimmed(c), _dumped)


def _dumped(t: Column) -> Column:
    json = t.rlike(r"^[{\[]") & t.rlike('"(?:findings|severity|verdict|file|line)"')
    many_lines = F.contains(t, F.lit("\n")) & contains_any(t, ["Error: ", "ECONNRESET", "ENOENT", "EACCES"])
    long = let(squeezed(t), lambda f: (F.length(f) > 420) & ~(matches(F.substring(f, 1, 180), LOCAL_PATH) & matches(F.substring(f, 1, 180), ADVICE)))
    return (F.length(t) > 0) & (json | many_lines | contains_any(t, DUMP_WORDS) | (markdown_marks(t) >= 3) | long)


def error_signature(c: Column) -> Column:
    """The first known errno, else the first error class, else the exit code; null if none."""
    codes = F.filter(F.regexp_extract_all(c, F.lit(f"{EDGE}(E[A-Z]{{2,}}){EDGE}"), F.lit(1)), lambda x: x.isin(ERRNO))
    raised = F.regexp_extract(c, f"{EDGE}([A-Z][A-Za-z0-9]*(?:Error|Exception)){EDGE}", 1)
    code = F.regexp_extract(c, rule(r"\bexit(?:ed with)?(?:\s+status)?\s+code\s+(\d+)\b"), 1)
    return F.coalesce(F.get(codes, F.lit(0)), F.when(raised != "", raised), F.when(code != "", F.concat(F.lit("exit code "), code)))


def lower_first(c: Column) -> Column:
    return let(c, lambda t: F.concat(F.lower(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t))))


def without_elision(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, r"\A(?:\.\.\.|…)\s*", ""))


def without_stop(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, r"[.!?]+\z", ""))


def resolution(c: Column) -> Column:
    """What a fix event says, without its prefix, change list, verification block and final stop."""
    said = trimmed(F.regexp_replace(c, r"(?i)\AVerification noted:\s*", ""))
    bare = F.regexp_replace(said, r"(?i)\A\*\*Done:\*\*\s*", "")
    bare = trimmed(F.regexp_replace(bare, r"(?i)\s+\*\*(?:Verified|Changed|Changes):\*\*[\s\S]*\z", ""))
    body = F.coalesce(F.nullif(bare, F.lit("")), c)
    body = F.regexp_replace(body, rf"(?i)\s+\*\*(?:{CHANGE_HEADS}):\*\*[\s\S]*\z", "")
    body = trimmed(F.regexp_replace(body, r"(?i)\s+Summary of what changed:[\s\S]*\z", ""))
    return without_elision(without_stop(body))


def fix_statement(c: Column) -> Column:
    """A fix as a statement: doubled and completion verbs at the start give way."""
    verbs = "fixed|resolved|updated|changed|patched|corrected"
    t = F.regexp_replace(resolution(c), rf"(?i)\A({verbs})\s+(?:{verbs}){EDGE}\s*", "$1 ")
    t = F.regexp_replace(trimmed(t), rf"(?i)\A(?:completed|done)\s+(?=(?:implemented|added|{verbs}|replaced|removed){EDGE})", "")
    t = F.regexp_replace(without_elision(t), r"(?i)\A(?:completed|done)\s+", "")
    return trimmed(F.regexp_replace(t, r"(?i)\Aimplemented\s+(?=implemented)", ""))


def past_tense(c: Column) -> Column:
    return matches(c, PAST)


def in_ticks(c: Column) -> Column:
    return F.when(c.rlike(r"\A`[\s\S]*`\z"), c).otherwise(F.concat(F.lit("`"), c, F.lit("`")))


def repo_path(c: Column) -> Column:
    """A path relative to its checkout under a Code folder; other paths as they are, empty ones null."""
    bare = F.nullif(F.regexp_replace(trimmed(c), r"\A`+|`+\z", ""), F.lit(""))
    return F.regexp_replace(bare, r"\A[\s\S]*?/Code/[^/]*/(?=[\s\S])", "")


def tried_approach(c: Column) -> Column:
    """What was tried, of a text that says it was abandoned."""
    found = F.regexp_replace(trimmed(F.regexp_extract(c, rule(TRIED), 1)), r"[\s,;:]+\z", "")
    return let(found, lambda t: F.when(F.length(t) >= 4, t))


def starts_with_any(c: Column, starts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(c, F.lit(x)) for x in starts])


def completion_block(c: Column) -> Column:
    """Whether a text is a report of what was done, with its headings."""
    return matches(c, BLOCK_HEADS) | matches(c, BLOCK_SUMMARY)


def explanation(c: Column) -> Column:
    """Whether a text explains or lays out something rather than decides it."""
    low = F.lower(trimmed(c))
    return starts_with_any(low, EXPLAINED_STARTS) | (starts_with_any(low, OVERVIEW_STARTS) & matches(low, OVERVIEW))


def passing_summary(c: Column) -> Column:
    """Whether a text is chat, a review or a list of points, without a decision that lasts."""
    low = F.lower(trimmed(c))
    chat = matches(low, CHAT_OPENINGS, False) | starts_with_any(low, CHAT_STARTS) | matches_any(c, CHAT_PARTS)
    review = starts_with_any(low, REVIEW_STARTS) | matches(trimmed(c), REVIEW_PARTS[0]) | matches(c, REVIEW_PARTS[1])
    return (chat | review | (markdown_marks(c) >= 3)) & ~matches_any(c, DURABLE_DECISION)


def durable(kind: Column, c: Column) -> Column:
    """Whether a lesson's statement is worth keeping, by its kind."""
    flow = kind == "workflow"
    refused = (
        narration(c)
        | raw_dump(c)
        | (~flow & completion_block(c))
        | ((kind == "verification_rule") & matches(c, OWN_CHECKS[0]))
        | matches(c, OWN_CHECKS[1])
        | ((kind == "pattern") & (matches_any(c, PATTERN_BLOCKS) | matches(c, PATTERN_TALK)))
        | ((kind == "failure_mode") & matches(c, FAILURE_TALK))
        | (kind.isin("decision", "failure_mode", "pattern") & passing_summary(c))
        | (flow & (matches(c, WORKFLOW_TALK) | F.startswith(F.lower(trimmed(c)), F.lit(WORKFLOW_DUMP_START)) | matches_any(c, WORKFLOW_DUMP) | (markdown_marks(c) >= 3)))
    )
    return ~refused


def _action(segment: Column) -> Column:
    """What a clause says to do: after its first separator that a verb of change follows, without a quoted label."""
    heads = F.regexp_extract_all(segment, F.lit(rf"[\s\S]*?(?:{SEPARATOR})"), F.lit(0))

    def chosen(h: Column) -> Column:
        ends = F.transform(h, lambda x, i: F.length(F.array_join(F.slice(h, F.lit(1), i + 1), "")))
        tails = F.transform(ends, lambda e: trimmed(F.substring(segment, e + 1, F.length(segment))))
        return F.coalesce(F.get(F.filter(tails, lambda t: matches(t, CHANGE_VERB)), F.lit(0)), segment)

    label = r"\A[\w.]+:\s*['\"][^'\"]+['\"]\s*[-–—]\s*"
    return let(let(heads, chosen), lambda a: trimmed(F.regexp_replace(F.regexp_replace(a, label, ""), r"\A['\"][^'\"]+['\"]\s*[-–—]\s*", "")))


def compressed(c: Column) -> Column:
    """A summary that is mostly Markdown as a struct of the first file it names and what was done there; null if it has neither.

    The words' places say which part of the text belongs to the first file: from its end to the
    start of the next one. Of that part, the clauses with a verb of change make up the action.
    """
    t = trimmed(c)
    plain = F.regexp_replace(t, r"\[(.*?)\]\(.*?\)", "$1")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "`", ""), r"\*\*", ""), r"#{1,6}\s+", "")
    plain = trimmed(F.regexp_replace(plain, rule(SUMMARY_HEADS), ""))

    def placed(x: Column) -> Column:
        words = F.split(x, r"\s+")

        def found(w: Column) -> Column:
            bare = F.transform(w, lambda v: repo_path(F.regexp_replace(F.regexp_replace(v, r"\A[(\"']+", ""), r"[.,;:!?()]+\z", "")))
            starts = F.transform(w, lambda v, i: F.length(F.array_join(F.slice(w, F.lit(1), i), " ")) + F.when(i > 0, 1).otherwise(0))
            files = F.filter(F.arrays_zip(bare.alias("file"), starts.alias("at")), lambda z: z.file.rlike(r"[\\/]"))
            return let(files, lambda f: F.when(F.size(f) > 0, F.struct(x.alias("text"), F.get(f, F.lit(0)).alias("first"), F.get(f, F.lit(1)).alias("next"))))

        return let(words, found)

    def told(z: Column) -> Column:
        begin = z.first.at + F.length(z.first.file)
        region = trimmed(F.substring(z.text, begin + 1, F.greatest(F.lit(0), F.coalesce(z.next.at, F.length(z.text)) - begin)))
        clauses = F.filter(F.transform(F.split(region, CLAUSE_BREAK), lambda x: trimmed(F.regexp_replace(x, r"\A\s*[:\-–—]\s*", ""))), lambda x: F.length(x) > 0)
        named = F.concat(F.lit(rf"(?i){EDGE}\Q"), z.first.file, F.lit(rf"\E{EDGE}"))

        def without_file(a: Column) -> Column:
            at = F.regexp_instr(a, named)
            rest = F.concat(F.substring(a, F.lit(1), at - 1), F.substring(a, at + F.length(z.first.file), F.length(a)))
            return trimmed(F.when(at > 0, rest).otherwise(a))

        actions = F.filter(F.transform(clauses, lambda x: let(_action(x), without_file)), lambda a: (F.length(a) >= 5) & matches(a, CHANGE_VERB))
        whole = squeezed(F.array_join(actions, "; "))
        return let(whole, lambda w: F.when(F.length(w).between(10, 160), F.struct(z.first.file.alias("file"), lower_first(w).alias("action"))))

    return let(plain, lambda x: F.when(markdown_marks(t) >= 3, let(placed(x), lambda z: F.when(z.isNotNull(), told(z)))))
