"""Lines that repeat across documents, found by range-partitioned hashes; the answer is a keep bitmap for each document.

A line's key is the line without white space at both ends, A-Z lower-cased, known by two 64-bit
hashes. Occurrences are range-partitioned by hash and slice (a part of the documents, so that a
key with a third of all rows spreads over many partitions), sorted by document and position, and
streamed once: each slice gives its first occurrence and its number of documents. Slices are then
summed with partial aggregation. Only hashes and positions are shuffled, never text.

A bitmap lists, for every dropped line in order, how many kept lines stand before it since the
last dropped one; documents that keep every line have none. Everything is DataFrame functions.

Defined cases: a null or empty text is one empty line; rows with equal id and text are one
document and get the same bitmap; rows with a null id are documents like others; keys shorter than
``min_chars`` code points are never dropped; an empty table gives an empty table; other columns,
whatever their names, are passed through by ``apply`` and ignored by ``bitmaps``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import WHITE_CHARS, ascii_lower, stored

SLICES = 1024


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_hash(text: Column) -> Column:
    """Tells apart the texts of rows that share an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def occurrences(documents: DataFrame, min_chars: int, doc_id: str, text: str) -> DataFrame:
    """doc_id, doc_hash, h1, h2, pos of every line whose key is long enough."""
    body, number = F.col(f"`{text}`"), F.col(f"`{doc_id}`").cast("long")
    rows = documents.select(number.alias("doc_id"), text_hash(body).alias("doc_hash"), F.posexplode(lines(body)).alias("pos", "line"))
    keyed = rows.withColumn("key", ascii_lower(F.btrim("line", F.lit(WHITE_CHARS)))).where(F.length("key") >= min_chars)
    return keyed.select("doc_id", "doc_hash", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "pos")


def bitmaps(documents: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, doc_hash, gaps (the bitmap), n_dropped of the documents that lose lines.

    Lines whose key is in at least ``min_docs`` documents are dropped: everywhere if ``keep`` is
    "none", everywhere but at the first occurrence by document and position if it is "first".
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep is none or first, not {keep}")
    seen = stored(occurrences(documents, min_chars, doc_id, text), "occurrences")
    slice_of = F.pmod("doc_hash", F.lit(SLICES)).alias("slice")
    place = ["doc_id", "doc_hash", "pos"]
    sorted_rows = seen.select("h1", "h2", slice_of, *place).repartitionByRange("h1", "h2", "slice").sortWithinPartitions("h1", "h2", "slice", *place)
    stream = Window.partitionBy("h1", "h2", "slice").orderBy(*place)
    before = F.lag(F.struct("doc_id", "doc_hash")).over(stream)
    marked = sorted_rows.withColumn("new", F.when(before.eqNullSafe(F.struct("doc_id", "doc_hash")), 0).otherwise(1))
    sliced = marked.groupBy("h1", "h2", "slice").agg(F.sum("new").alias("docs"), F.min(F.struct(*place)).alias("first"))
    keys = sliced.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.min("first").alias("first"))
    frequent = stored(keys.where(F.col("docs") >= min_docs).select("h1", "h2", "first"), "frequent")
    lost = seen.join(frequent, ["h1", "h2"])
    if keep == "first":
        lost = lost.where(~F.struct(*place).eqNullSafe(F.col("first")))
    by_doc = lost.groupBy("doc_id", "doc_hash").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    last = F.concat(F.array(F.lit(-1)), F.slice("at", 1, F.size("at") - 1))
    gaps = F.zip_with("at", last, lambda a, b: a - b - 1)
    return by_doc.select("doc_id", "doc_hash", gaps.alias("gaps"), F.size("at").alias("n_dropped"))


def apply(documents: DataFrame, maps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with the kept text in place of the text, and the columns _n_lines and _n_dropped."""
    held = maps.select(F.col("doc_id").alias("_id"), F.col("doc_hash").alias("_hash"), F.col("gaps").alias("_gaps"), F.col("n_dropped").alias("_n"))
    same = F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col("_id")) & (text_hash(F.col(f"`{text}`")) == F.col("_hash"))
    joined = documents.join(held, same, "left").withColumn("_lines", lines(F.col(f"`{text}`")))
    flags = F.flatten(F.transform("_gaps", lambda g: F.concat(F.array_repeat(F.lit(True), g), F.array(F.lit(False)))))
    left = F.array_compact(F.zip_with("_lines", flags, lambda line, flag: F.when(F.coalesce(flag, F.lit(True)), line)))
    kept = F.when(F.col("_gaps").isNull(), F.coalesce(F.col(f"`{text}`"), F.lit(""))).otherwise(F.array_join(left, "\n"))
    counts = {"_n_lines": F.size("_lines").cast("long"), "_n_dropped": F.coalesce(F.col("_n"), F.lit(0)).cast("long")}
    return joined.withColumns({**counts, text: kept}).drop("_id", "_hash", "_gaps", "_n", "_lines")


def dedup(documents: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return apply(documents, stored(bitmaps(documents, min_docs, min_chars, keep, doc_id, text), "bitmaps"), doc_id, text)
