"""Column helpers for text, with the semantics that transcript rules were written in.

Rules come from a world where a word is ASCII, white space is all of Unicode's, and ``$`` is the
very end of the text. Java's regular expressions differ in all three, so patterns pass through
``rule`` and white space through ``SPACE``. Everything here is a Catalyst expression.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One white-space character: ASCII ones and the Unicode spaces that trimming removes too.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_WORD = "A-Za-z0-9_"
EDGE = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
#: The characters of ``SPACE``.
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def rule(pattern: str, ignore_case: bool = True) -> str:
    """A Java pattern for a rule: ASCII word edges, ``$`` at the very end, letters of either case."""
    java = pattern.replace(r"\b", EDGE)
    if java.endswith("$") and not java.endswith(r"\$"):
        java = java[:-1] + r"\z"
    return f"(?i){java}" if ignore_case else java


def _needed(parsed) -> list[str] | None:
    """Of a parsed pattern, texts of which every match has one; None if it has no such texts."""
    choices, run = [], ""
    for op, arg in [*parsed, (None, None)]:
        if str(op) == "LITERAL":
            run += chr(arg)
            continue
        if run:
            choices.append([run])
        run, inner = "", None
        if str(op) == "SUBPATTERN":
            inner = _needed(arg[-1])
        elif str(op) == "BRANCH":
            parts = [_needed(part) for part in arg[1]]
            inner = None if None in parts else [t for part in parts for t in part]
        elif str(op) == "MAX_REPEAT" and arg[0] > 0:
            inner = _needed(arg[2])
        if inner:
            choices.append(inner)
    return max(choices, key=lambda texts: (min(map(len, texts)), -len(texts)), default=None)


@cache
def fixed_parts(pattern: str) -> tuple[str, ...]:
    """Texts in lower case of which every match of a rule has one; none where a rule has none, or has to begin at the text's start."""
    try:
        parsed = re._parser.parse(pattern)
    except (re.error, AttributeError):  # Java's own syntax
        return ()
    found = None if list(parsed[:1]) == [(re._constants.AT, re._constants.AT_BEGINNING)] else _needed(parsed)
    return tuple(sorted({t.lower() for t in found})) if found and len(found) <= 24 and min(map(len, found)) > 1 else ()


@cache
def anchored(pattern: str) -> bool:
    """Whether a rule as a whole has to match at the text's start."""
    return pattern.startswith("^") and bool(re.fullmatch(r"(?:[^|()\\\[]|\\.|\[[^\]]*\]|\((?:[^()\\\[]|\\.|\[[^\]]*\]|\((?:[^()\\\[]|\\.|\[[^\]]*\])*\))*\))*", pattern))


def matches(c: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Whether a rule is found; looked for only where one of its fixed parts is."""
    parts = fixed_parts(pattern)
    found = rule(pattern, ignore_case)
    return let(c, lambda t: let(F.lower(t), lambda low: contains_one(low, parts)) & t.rlike(found)) if parts else c.rlike(found)


def matches_any(c: Column, patterns: Sequence[str]) -> Column:
    """Whether one of the rules is found: those at the text's start as one pattern, the others where their fixed parts are."""
    first = [rule(p)[len("(?i)^"):] for p in patterns if anchored(p)]
    inside = [p for p in patterns if not anchored(p)]

    def found(t: Column) -> Column:
        parts = [let(F.lower(t), lambda low: reduce(lambda a, b: a | b, [guarded(t, low, p, fixed_parts(p)) for p in inside]))] if inside else []
        if first:
            parts.insert(0, t.rlike(f"(?i)^(?:{'|'.join(f'(?:{p})' for p in first)})"))
        return reduce(lambda a, b: a | b, parts)

    return let(c, found)


def contains_one(c: Column, parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in parts])


def guarded(c: Column, lower: Column, pattern: str, needed: Sequence[str]) -> Column:
    """``matches(c, pattern)``, looked for only where ``lower`` (c in lower case) has one of the parts that every match has.

    A search for fixed parts is many times cheaper than a pattern with look-arounds.
    """
    found = c.rlike(rule(pattern))
    return contains_one(lower, needed) & found if needed else found


def first_rule(c: Column, patterns: Sequence[str], lower: Column | None = None, needed: dict[str, Sequence[str]] | None = None) -> Column:
    """Number (from 0) of the first pattern found in ``c``; null if none is. ``needed`` gives parts for ``guarded``."""
    found = F.when(F.lit(False), F.lit(0))
    for i, p in enumerate(patterns):
        found = found.when(c.rlike(rule(p)) if lower is None else guarded(c, lower, p, (needed or {}).get(p, ())), F.lit(i))
    return found


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` computed once, however often ``f`` uses it.

    Rules build on each other; written out, a text that is used three times at each of five levels
    would stand 243 times in the plan.
    """
    return F.get(F.transform(F.array(c), f), F.lit(0))


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def filled(c: Column) -> Column:
    """Trimmed text, or null if nothing remains."""
    return F.nullif(trimmed(c), F.lit(""))


def squeezed(c: Column) -> Column:
    """Runs of white space as one space, none at the ends; printable ASCII without two spaces in a row has nothing to replace."""

    def squeeze(t: Column) -> Column:
        return F.trim(F.when(F.contains(t, F.lit("  ")) | t.rlike("[^ -~]"), F.regexp_replace(t, f"{SPACE}+", " ")).otherwise(t))

    return let(c, squeeze)


def shortened(c: Column, size: int, trim_cut: bool = True) -> Column:
    """Squeezed text of at most ``size`` characters; a cut one ends in three dots."""

    def cut(t: Column) -> Column:
        head = F.substring(t, 1, size - 3)
        return F.when(F.length(t) <= size, t).otherwise(F.concat(F.rtrim(head) if trim_cut else head, F.lit("...")))

    return let(squeezed(c), cut)


def compacted(c: Column) -> Column:
    """Blanks and tabs squeezed, at most one empty line in a row, ends trimmed."""

    def compact(t: Column) -> Column:
        blanks = F.contains(t, F.lit("  ")) | F.contains(t, F.lit("\t")) | F.contains(t, F.lit("\n\n\n"))
        return F.when(blanks, F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")).otherwise(t)

    return trimmed(let(c, compact))


def head_excerpt(c: Column, size: int) -> Column:
    return let(compacted(c), lambda t: F.when(F.length(t) <= size, t).otherwise(F.concat(F.substring(t, 1, size - 3), F.lit("..."))))


def excerpt_around(c: Column, pattern: str | Column, size: int) -> Column:
    """At most ``size`` characters of ``c`` that show the first match of ``pattern``.

    ``pattern`` is a rule, or a column of Java patterns. The excerpt starts at the match's line, or a third of its size before a match that lies deep
    in a long line; dots stand for what is left out.
    """
    place = F.struct
    java = F.lit(rule(pattern)) if isinstance(pattern, str) else pattern

    def located(t: Column) -> Column:
        at = F.greatest(F.regexp_instr(t, java), F.lit(1)) - 1
        head = F.reverse(F.substring(t, F.lit(1), at))
        return place(t.alias("t"), at.alias("at"), F.locate("\n", head).alias("back"))

    def started(x: Column) -> Column:
        line = F.when(x.back > 0, x["at"] - x.back + 1).otherwise(F.lit(0))
        start = F.when(x["at"] - line >= size - 6, x["at"] - size // 3).otherwise(line)
        return place(x.t.alias("t"), start.alias("start"))

    def ended(x: Column) -> Column:
        end = F.least(F.length(x.t), x.start + size - F.when(x.start > 0, 3).otherwise(0))
        return place(x.t.alias("t"), x.start.alias("start"), end.alias("end"))

    def shown(x: Column) -> Column:
        more = x.end < F.length(x.t)
        end = F.when(more, F.greatest(x.start, x.end - 3)).otherwise(x.end)
        body = trimmed(F.substring(x.t, x.start + 1, end - x.start))
        parts = F.concat(F.when(x.start > 0, F.lit("...")).otherwise(F.lit("")), body, F.when(more, F.lit("...")).otherwise(F.lit("")))
        return F.when(F.length(x.t) <= size, x.t).otherwise(parts)

    return let(let(let(let(compacted(c), located), started), ended), shown)


def head_and_tail(c: Column, size: int) -> Column:
    """The first third and the end of a squeezed text that is longer than ``size``."""
    head = (size - 5) // 3
    tail = size - 5 - head

    def cut(t: Column) -> Column:
        return F.when(F.length(t) <= size, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, head)), F.lit(" ... "), F.ltrim(F.substring(t, -tail, tail))))

    return let(squeezed(c), cut)


def text_lines(c: Column) -> Column:
    """Trimmed lines that are not empty."""
    return F.filter(F.transform(F.split(c, "\n"), trimmed), lambda x: F.length(x) > 0)


def capped_bytes(c: Column, size: int = 512) -> Column:
    """Squeezed text of at most ``size`` UTF-8 bytes, cut between characters, with an ellipsis.

    Bytes are cut first and a torn last character is then dropped.
    """
    def cut(t: Column) -> Column:
        data = F.encode(t, "UTF-8")
        # Of a torn character 1 to 3 bytes remain at the end; without them the rest is valid.
        whole = F.coalesce(*(F.try_validate_utf8(F.substring(data, 1, size - 3 - torn).cast("string")) for torn in range(4)))
        return F.when(F.octet_length(t) <= size, t).otherwise(F.concat(F.rtrim(whole), F.lit("…")))

    return let(squeezed(c), cut)


def listed(*flags: tuple[str, Column]) -> Column:
    """Names of the flags that hold, in order."""
    return F.array_compact(F.array(*(F.when(on, F.lit(name)) for name, on in flags)))
