"""What comes back from providers and reviewers, as columns: verdicts, triggers, errors; and small text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.prompts import cleaned_statement
from loomline.functions.text import filled, squeezed

# Fixed values.
VERDICTS, DURABILITIES = ["keep", "reject", "rewrite"], ["durable", "transient", "process", "duplicate", "unclear"]
MISSING, REJECTED = "__missing_statement__", "Rejected learning"
RELEVANT, WHEN_REJECTED = "When this reviewed learning is relevant.", "When reviewing rejected learning output."
TERMINAL_ERRORS = ["(401)", "(403)", "(429)", "limit exceeded", "key limit", "quota"]
KINDS, LEVELS = ["skill", "rule", "workflow_doc", "none"], ["strong", "medium", "weak", "contradicted"]
UUID = r"(?i)^rollout-(?:\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}-)?([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$"


def _typed(v: Column, name: str, kind: str) -> Column:
    """A field in its own type, or null."""
    value = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == kind.upper(), F.try_variant_get(v, f"$.{name}", kind))


def json_part(answer: Column) -> Column:
    """The text from the first to the last brace, as a variant; null if that is no JSON."""
    return F.try_parse_json(F.nullif(F.regexp_extract(answer, r"(?s)\{.*\}", 0), F.lit("")))


def reviewed(answer: Column) -> Column:
    """A review as a struct: error (null if it is valid), verdict, durability, keep, reason, statement, trigger."""
    v = F.try_parse_json(answer)
    keep, verdict, durability = _typed(v, "keep", "boolean"), _typed(v, "verdict", "string"), _typed(v, "durability", "string")
    reason = filled(_typed(v, "reason", "string"))
    statement = F.coalesce(filled(_typed(v, "statement", "string")), F.when(keep, MISSING).otherwise(REJECTED))
    trigger = F.coalesce(F.nullif(squeezed(_typed(v, "trigger", "string")), F.lit("")), F.when(keep, RELEVANT).otherwise(WHEN_REJECTED))

    def no(test: Column) -> Column:
        return ~F.coalesce(test, F.lit(False))

    error = F.when(v.isNull(), "no JSON").when(no(verdict.isin(VERDICTS)), "verdict").when(no(durability.isin(DURABILITIES)), "durability").when(keep.isNull(), "keep").when(reason.isNull(), "reason")
    parts = {"verdict": verdict, "durability": durability, "keep": keep, "reason": reason, "statement": statement, "trigger": trigger}
    return F.struct(error.alias("error"), *(F.when(error.isNull(), p).alias(n) for n, p in parts.items()))


def promotion_verdict(answer: Column) -> Column:
    """A judge's verdict on a record as a struct: general, confidence, reason; all null if it is not valid."""
    v = json_part(answer)
    certain = F.try_variant_get(v, "$.confidence", "double")
    general, reason = _typed(v, "global", "boolean"), _typed(v, "reason", "string")
    valid = F.coalesce((certain >= 0) & (certain <= 1), F.lit(False)) & general.isNotNull() & reason.isNotNull()
    return F.struct(F.when(valid, general).alias("general"), F.when(valid, certain).alias("confidence"), F.when(valid, reason).alias("reason"))


def workflow_verdict(answer: Column) -> Column:
    """A judge's verdict on mined guidance as a struct: wording_ok, suggested_guidance, artifact_kind, confidence, reason; nulls if it is not valid."""
    v = json_part(answer)
    parts = {n: _typed(v, n, "string") for n in ("suggested_guidance", "artifact_kind", "confidence", "reason")}
    ok = _typed(v, "wording_ok", "boolean")
    valid = ok.isNotNull() & F.coalesce(parts["artifact_kind"].isin(KINDS) & parts["confidence"].isin(LEVELS), F.lit(False)) & parts["reason"].isNotNull()
    return F.struct(F.when(valid, ok).alias("wording_ok"), *(F.when(valid, p).alias(n) for n, p in parts.items()))


def generated_topic(answer: Column) -> Column:
    """The topic of an answer, at most 120 characters; null if there is none."""
    said = squeezed(_typed(F.try_parse_json(answer), "topic", "string"))
    bare = F.nullif(squeezed(F.regexp_replace(said, "^[\"']|[\"']$", "")), F.lit(""))
    return F.when(F.length(bare) <= 120, bare).otherwise(F.concat(F.rtrim(F.substring(bare, 1, 117)), F.lit("...")))


def terminal_error(message: Column) -> Column:
    """Whether a provider's error makes further calls pointless."""
    t, hit = F.lower(message), F.lit(False)
    for part in TERMINAL_ERRORS:
        hit = hit | F.contains(t, F.lit(part))
    return hit


def trigger_or(reviewed_trigger: Column, original: Column) -> Column:
    return F.coalesce(F.nullif(squeezed(reviewed_trigger), F.lit("")), original)


def preference_statement(c: Column) -> Column:
    """A user's preference as a sentence: without numbering and final stops; empty if nothing is left."""
    t = F.regexp_replace(cleaned_statement(c), r"\A\d+\s*[\].):-]\s*", "")
    t = squeezed(F.regexp_replace(t, r"[.!?]+\z", ""))
    return F.when(F.length(t) == 0, "").otherwise(F.concat(t, F.lit(".")))


def without_frontmatter(c: Column) -> Column:
    """A text without the block between its first line of three dashes and the next one."""
    end = F.instr(F.substring(c, F.lit(4), F.length(c)), "\n---") + 3  # place of the line feed, or 3
    rest = F.substring(c, end + 1, F.length(c))
    after = F.when(F.instr(rest, "\n") > 0, F.substring(rest, F.instr(rest, "\n") + 1, F.length(rest))).otherwise("")
    return F.when(F.startswith(c, F.lit("---")) & (end > 3), after).otherwise(c)


def has_bullet(c: Column) -> Column:
    return c.rlike(r"(?m)^- ")


def source_uuid(tool: Column, path: Column, session_id: Column) -> Column:
    """The id that a source's file name carries, or its name, or the session's id."""
    name = F.substring_index(path, "/", -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")
    bare = F.coalesce(F.nullif(F.regexp_extract(stem, UUID, 1), F.lit("")), F.nullif(F.regexp_replace(stem, r"\Arollout-", ""), F.lit("")))
    return F.coalesce(F.when(tool == "codex-cli", bare).otherwise(F.nullif(stem, F.lit(""))), session_id)
