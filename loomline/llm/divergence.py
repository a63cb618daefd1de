"""Source divergence audit: how far the sources of a language are from each other, and by which terms.

Terms are runs of letters (ASCII letters and everything beyond ASCII), A-Z lower-cased. A language
keeps the terms found in at least ``least_docs`` of its rows. With V kept terms, each group (a
language and source) and each language gives every kept term the level
p = 1 + floor(SCALE (count + 1) / (N + V)), where N sums the counts of its kept terms. The divergence
of a group from levels q is the sum of floor((p - q)^2 / q).

Each term becomes one wide vector: the counts of its sources, indexed by the source's number in
its language, with absent sources left out, as a rare term has few. Higher-order functions turn a
vector into the pairs of the sources that hold the term, and map-side aggregation sums their
contributions to a row a pair. What the absent ones add is known without visiting them: with p0 the
level of a count of 0,

    sum over all terms of f(p, q) = sum over terms in both of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)
                                  + sum over terms in the first of f(p, q0) + sum over terms in the second of f(p0, q)
                                  + (V - terms in the first - terms in the second) f(p0, q0),

and the two sums in the middle need only the number of terms for each count. All arithmetic is on
whole numbers; counts of 9e9 and more, which a product with SCALE would not hold, take decimals.

Nothing is gathered by language or source: counts are summed by term and source before the
shuffle (by a short pass over the bytes of each text), vectors meet by term (at most a row a source), sums have a row a pair, and of a group's
terms each task passes on its best ``top`` only.

Defined cases: null text, lang and source count as ''; each row is a document of its own, so
repeated rows count again; a group without terms has levels too; a language without kept terms has
pairs of value 0 and no terms; a language with one source has no pairs; ties are ranked by the
item's UTF-8 bytes; an empty table gives an empty table; other columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import slices, stored

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of UTF-8 as terms have them: A-Z in lower case, other ASCII characters that are no letters as blanks, the rest as it is.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
BREAK = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
#: Rows taken from Arrow, bytes of a text split, and terms of all groups held at once in a task.
ROWS_AT_ONCE, PIECE, MOST_HELD = 1_000, 1 << 20, 300_000
SCALE = 1_000_000_000
LEAST_DOCS, TOP = 3, 200
#: Groups (a language and source), in rows of some 50 bytes, up to which their table is broadcast.
MAX_BROADCAST = 1_000_000


def level(count: str, total: str, kept: str) -> str:
    """SQL of a term's level; null where there is no kept term."""
    short = f"({SCALE}L * ({count} + 1L)) div nullif({total} + {kept}, 0L)"
    long = f"(cast({SCALE} as decimal(10,0)) * cast({count} + 1L as decimal(19,0))) div cast(nullif({total} + {kept}, 0L) as decimal(19,0))"
    return f"(1L + case when {count} < 9000000000L then {short} else {long} end)"


def apart(p: str, q: str) -> str:
    """SQL of what one term adds to the divergence of levels p from q."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def _plain(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def groups(documents: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Every language and source that occurs, with the language's number and the source's number in its language."""
    names = documents.select(_plain(lang).alias("lang"), _plain(source).alias("source")).distinct()
    numbers = {"l": F.dense_rank().over(Window.orderBy("lang")), "at": F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1}
    return names.withColumns(numbers)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial n and docs by l, at and term of rows l, at and text (UTF-8), passed on whenever ``MOST_HELD`` terms are held."""
    found, held = {}, 0
    for batch in slices(batches, ROWS_AT_ONCE):
        for l, at, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            n, docs = found.setdefault((l, at), (Counter(), Counter()))
            before, own, start = len(n), set(), 0
            while start < len(text):
                # Long texts in pieces that end where a term cannot go on.
                stop = BREAK.search(text, start + PIECE)
                end = stop.end() if stop else len(text)
                words = text[start:end].translate(LETTERS).split()
                n.update(words)
                own.update(words)
                start = end
            docs.update(own)
            held += len(n) - before
            if held >= MOST_HELD:
                yield from _partial(found)
                found, held = {}, 0
    yield from _partial(found)


def _partial(found: dict) -> Iterator[pa.RecordBatch]:
    """What has been counted, a batch a group."""
    for (l, at), (n, docs) in found.items():
        if n:
            size = len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([l] * size, pa.int32()), pa.array([at] * size, pa.int32()), pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())],
                names=["l", "at", "term", "n", "docs"],
            )


def term_counts(documents: DataFrame, numbered: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """l, at, term, n (occurrences) and docs (rows that hold the term)."""
    named = documents.select(_plain(lang).alias("lang"), _plain(source).alias("source"), _plain(text).alias("text"))
    # Texts are joined with a table of names, which is broadcast unless it is very long.
    known = F.broadcast(numbered) if numbered.count() <= MAX_BROADCAST else numbered
    texts = named.join(known, ["lang", "source"]).select("l", "at", F.col("text").cast("binary").alias("text"))
    # One pass over the bytes counts occurrences and rows; of each task's terms only sums are shuffled.
    each = texts.mapInArrow(_counted, "l int, at int, term binary, n long, docs long")
    summed = each.groupBy("l", "at", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return summed.withColumn("term", F.col("term").cast("string"))


def vectors(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """l, term, n and held: the (at, n) of each source that has the term, for kept terms."""
    made = counts.groupBy("l", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("at", "n"))).alias("held"))
    return made.where(F.col("docs") >= least_docs).drop("docs")


def levels(vector: DataFrame, numbered: DataFrame) -> DataFrame:
    """A row a language: kept and total, and by source number totals, present (kept terms it has) and zero (level of a count of 0)."""
    of_group = vector.select("l", F.explode("held").alias("e")).groupBy("l", F.col("e.at").alias("at")).agg(F.sum("e.n").alias("total"), F.count("*").alias("present"))
    of_lang = vector.groupBy("l").agg(F.count("*").alias("kept"), F.sum("n").alias("total"))
    rows = numbered.join(of_group, ["l", "at"], "left").select("l", F.struct("at", F.expr("coalesce(total, 0L) as total"), F.expr("coalesce(present, 0L) as present")).alias("e"))
    wide = rows.groupBy("l").agg(F.sort_array(F.collect_list("e")).alias("e")).selectExpr("l", "e.total as totals", "e.present as present")
    out = wide.join(of_lang, "l", "left").selectExpr("l", "coalesce(kept, 0L) as kept", "coalesce(total, 0L) as total", "totals", "present")
    return out.withColumn("zero", F.expr(f"transform(totals, t -> {level('0L', 't', 'kept')})"))


def pair_sums(vector: DataFrame, level_rows: DataFrame) -> DataFrame:
    """l, at, other and value of every pair of sources."""
    with_levels = vector.join(level_rows.select("l", "kept", "totals", "zero"), "l")
    own = with_levels.select("l", F.expr(f"transform(held, e -> struct(e.at as at, {level('e.n', 'totals[e.at]', 'kept')} as p, zero[e.at] as p0))").alias("held"))
    one = own.select("l", "held", F.posexplode("held").alias("place", "a"))
    # Each pair once, with the levels of both sides; compiled code makes both directions' values of them.
    later = "transform(slice(held, place + 2, size(held)), b -> struct(b.at as other, b.p as q, b.p0 as q0))"
    meeting = one.select("l", "a.at", "a.p", "a.p0", F.explode(F.expr(later)).alias("b")).select("l", "at", "p", "p0", "b.other", "b.q", "b.q0")
    there = f"{apart('p', 'q')} - {apart('p', 'q0')} - {apart('p0', 'q')} + {apart('p0', 'q0')}"
    back = f"{apart('q', 'p')} - {apart('q', 'p0')} - {apart('q0', 'p')} + {apart('q0', 'p0')}"
    met = meeting.groupBy("l", "at", "other").agg(F.sum(F.expr(there)).alias("there"), F.sum(F.expr(back)).alias("back"))
    both = met.select("l", F.explode(F.expr("array(struct(at, other, there as value), struct(other as at, at as other, back as value))")).alias("c"))

    # Terms of one source against the other's level of 0, both ways, by number of terms for each count.
    shape = vector.select("l", F.explode("held").alias("e")).groupBy("l", F.col("e.at").alias("at"), F.col("e.n").alias("n")).agg(F.count("*").alias("m"))
    shaped = shape.join(level_rows.select("l", "kept", "totals", "zero"), "l").withColumn("p", F.expr(level("n", "totals[at]", "kept")))
    sided = f"""flatten(transform(zero, (z, o) -> if(o = at, array(), array(
        struct(at as at, o as other, m * {apart("p", "z")} as value), struct(o as at, at as other, m * {apart("z", "p")} as value)))))"""
    single = shaped.select("l", F.explode(F.expr(sided)).alias("c"))

    absent = level_rows.select("l", "kept", "present", "zero", F.posexplode("zero").alias("at", "p"))
    rest = f"transform(zero, (z, o) -> struct(at as at, o as other, coalesce((kept - present[at] - present[o]) * {apart('p', 'z')}, 0L) as value))"
    neither = absent.select("l", F.explode(F.expr(rest)).alias("c")).where("c.at <> c.other")

    every = both.unionByName(single).unionByName(neither).select("l", "c.at", "c.other", "c.value")
    return every.groupBy("l", "at", "other").agg(F.sum("value").alias("value"))


def term_parts(vector: DataFrame, level_rows: DataFrame) -> DataFrame:
    """l, at, term and value of the terms that a source has more often than its language."""
    each = vector.join(level_rows.select("l", "kept", F.col("total").alias("of_lang"), "totals"), "l").select("*", F.explode("held").alias("e"))
    compared = each.select("l", "term", F.col("e.at").alias("at"), F.expr(level("e.n", "totals[e.at]", "kept")).alias("p"), F.expr(level("n", "of_lang", "kept")).alias("q"))
    return compared.where("p > q").select("l", "at", "term", F.expr(apart("p", "q")).alias("value"))


def audit(documents: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item (other source, or term), value and rank in the group and part."""
    numbered = stored(groups(documents, lang, source), "groups")
    vector = stored(vectors(term_counts(documents, numbered, text, lang, source), least_docs), "vectors")
    level_rows = stored(levels(vector, numbered), "levels")
    best = Window.partitionBy("l", "at", "part").orderBy(F.desc("value"), "item")

    other = numbered.select("l", F.col("at").alias("other"), F.col("source").alias("item"))
    pairs = pair_sums(vector, level_rows).join(other, ["l", "other"]).select("l", "at", F.lit("pair").alias("part"), "item", "value")
    terms = term_parts(vector, level_rows).select("l", "at", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    ranked = pairs.withColumn("rank", F.row_number().over(best)).unionByName(terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top))
    return ranked.join(numbered, ["l", "at"]).select("lang", "source", "part", "item", "value", "rank")
