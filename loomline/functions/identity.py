"""Keys and ids made from text: merge keys, record ids, project ids, hashes of canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.text import let

# Fixed values.
STOP_WORDS = ["a", "an", "and", "as", "at", "be", "but", "by", "do", "for", "from", "in", "is", "it", "of", "on", "or", "so", "that", "the", "this", "to", "when", "where", "while", "with"]


def words(c: Column) -> Column:
    """Lower-cased words of ASCII letters, digits and hyphens, without stop words."""
    plain = F.regexp_replace(F.lower(c), r"[^a-z0-9\s-]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda w: (w != "") & ~w.isin(STOP_WORDS))


def stem(w: Column) -> Column:
    """A word without its commonest plural or tense ending."""
    size = F.length(w)

    def cut(n: int) -> Column:
        return F.substring(w, F.lit(1), size - n)

    return (
        F.when((size > 4) & F.endswith(w, F.lit("ing")), cut(3))
        .when((size > 4) & F.endswith(w, F.lit("ed")), cut(2))
        .when((size > 3) & F.endswith(w, F.lit("es")), cut(2))
        .when((size > 3) & F.endswith(w, F.lit("s")) & ~F.endswith(w, F.lit("ss")), cut(1))
        .otherwise(w)
    )


def stems(c: Column) -> Column:
    """The distinct stems of a text's words; each word is stemmed once, however often it stands there."""
    return F.array_distinct(F.filter(F.transform(F.array_distinct(words(c)), stem), lambda w: (w != "") & ~w.isin(STOP_WORDS)))


def canonical_key(trigger: Column, finding: Column) -> Column:
    """The same for texts that differ only in word order, endings, stop words and punctuation."""
    return F.array_join(F.array_sort(stems(F.concat(trigger, F.lit(" "), finding))), "-")


def slug(c: Column) -> Column:
    """The first eight words, none equal to the one before it."""

    def fresh(found: Column) -> Column:
        return F.filter(found, lambda w, i: (i == 0) | (w != F.get(found, i - 1)))

    return F.array_join(F.slice(let(words(c), fresh), 1, 8), "-")


def record_id(trigger: Column, finding: Column) -> Column:
    """A readable id: slug of the finding (or trigger), then eight hexadecimal digits of both."""
    digest = F.substring(F.sha2(F.concat(trigger, F.lit("|"), finding).cast("binary"), 256), 1, 8)
    named = F.coalesce(F.nullif(slug(F.when(F.length(finding) > 0, finding).otherwise(trigger)), F.lit("")), F.lit("instinct"))

    def cut(whole: Column) -> Column:
        return F.when(F.length(whole) <= 80, whole).otherwise(F.concat(F.substring(whole, 1, 72), F.lit("-"), digest))

    return let(F.concat(named, F.lit("-"), digest), cut)


def normal_remote(url: Column) -> Column:
    """A repository address in lower case, without scheme or user, .git and final slashes."""
    t = F.regexp_replace(F.lower(F.trim(url)), r"\A(?:https?://|git@|ssh://)", "")
    t = F.regexp_replace(t, r"\A([^:]*):", "$1/")
    return F.regexp_replace(F.regexp_replace(t, r"\.git\z", ""), r"/+\z", "")


def project_id(normalised: Column) -> Column:
    return F.substring(F.sha2(normalised.cast("binary"), 256), 1, 12)


def file_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def json_hash(**fields: Column) -> Column:
    """Hash of the fields as JSON with sorted keys; nulls count."""
    row = F.struct(*(fields[k].alias(k) for k in sorted(fields)))
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}).cast("binary"), 256)
