"""Fill-in-the-middle: texts cut in three at line ends and rearranged between sentinels, in Spark SQL alone.

A text is n units (lines with their line ends). Four 32-bit numbers h1 to h4 come from the sha256
of the seed and the document's id: the prefix ends after the smaller and the middle after the
larger of h1 % (n + 1) and h2 % (n + 1) units; h3 says whether the text is transformed at all
(``rate`` per cent), h4 which form it takes (``spm_rate`` per cent spm, else psm):

    psm    <P>prefix<S>suffix<M>middle
    spm    <S>suffix<P>prefix<M>middle
    plain  the text

Texts that are empty or hold a sentinel stay plain, so that parsing an output by its sentinels
always gives the text back: no two pieces can make up a sentinel at their seam, as each starts
with the only '<' in it. The numbers depend on nothing but seed and id, so a lost task gives the
same again; there is no shuffle.

Defined cases: a null text counts as empty and is plain, with n 0; a null id counts as an empty
string in the hash; repeated rows are cut alike; a text in one line has one unit, and any part may
be empty; an empty table gives an empty table; other columns are passed through and those named
like the results replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import free

UNIT = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RESULTS = ("n", "form", "prefix", "middle", "suffix", "output")
SEED, RATE, SPM_RATE = 7, 100, 50


def number(digest: Column, k: int) -> Column:
    """The k-th group of eight hex digits as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def between(text: Column, start: str, end: str) -> Column:
    """The text after the first ``start`` and up to the first ``end``."""
    head = F.substring_index(text, end, 1)
    return F.substring(head, F.locate(start, head) + F.lit(len(start)), F.length(head))


def after(text: Column, mark: str) -> Column:
    return F.substring(text, F.locate(mark, text) + F.lit(len(mark)), F.length(text))


def transform(documents: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with n (units), form, prefix, middle, suffix (null if plain) and output."""
    passed = F.struct(*(F.col(f"`{c}`") for c in documents.columns if c.lower() not in RESULTS), F.lit(0).alias(free("_", documents.columns)))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))).cast("binary"), 256)
    units = F.regexp_extract_all("_text", F.lit(UNIT), F.lit(0))
    read = documents.select(passed.alias("_passed"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"), digest.alias("_digest")).withColumn("_units", units)
    sized = read.withColumn("n", F.size("_units").cast("long"))
    one, two = number(F.col("_digest"), 0) % (F.col("n") + 1), number(F.col("_digest"), 1) % (F.col("n") + 1)
    cut = sized.withColumns({"_from": F.least(one, two).cast("int"), "_to": F.greatest(one, two).cast("int")})

    marked = F.col("_text").contains(PREFIX) | F.col("_text").contains(SUFFIX) | F.col("_text").contains(MIDDLE)
    plain = (F.col("_text") == "") | marked | (number(F.col("_digest"), 2) % 100 >= rate)
    form = F.when(plain, "plain").when(number(F.col("_digest"), 3) % 100 < spm_rate, "spm").otherwise("psm")

    def piece(start: Column, length: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("_units", start + 1, length), ""))

    parts = cut.withColumn("form", form).withColumns(
        {
            "prefix": piece(F.lit(0), F.col("_from")),
            "middle": piece(F.col("_from"), F.col("_to") - F.col("_from")),
            "suffix": piece(F.col("_to"), F.col("n").cast("int") - F.col("_to")),
        }
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("_text"))
    own = [F.col(f"_passed.`{c}`") for c in documents.columns if c.lower() not in RESULTS]
    return parts.withColumn("output", output).select(*own, *RESULTS)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the form came from, by its sentinels."""
    middle = after(output, MIDDLE)
    psm = F.concat(between(output, PREFIX, SUFFIX), middle, between(output, SUFFIX, MIDDLE))
    spm = F.concat(between(output, PREFIX, MIDDLE), middle, between(output, SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
