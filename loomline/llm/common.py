"""What the corpus operators share: scratch tables, text helpers, rows' identity."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.sources.scratch import delete, dropped, new_path, shared_dir, spread, stored  # noqa: F401

#: White space of the word rules, as a Java regex class and as plain characters.
WHITE = r"[\x20\x09-\x0D]"
NOT_WHITE = r"[^\x20\x09-\x0D]"
WHITE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; ``lower`` would change other alphabets too, but is much faster where there are none."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra or clashing columns of the caller never matter."""
    return df.select(*(F.col(f"`{c}`") for c in columns))


def free(name: str, columns: list[str]) -> str:
    """``name``, or with underscores after it the first such name that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def tidy() -> None:
    """Give memory that is free back to the machine: Spark keeps Python workers, and what they hold counts against later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library on Linux
    if trim:
        trim(0)


def slices(batches: Iterator, size: int) -> Iterator:
    """Arrow batches in pieces of at most ``size`` rows: bounds what one step holds in Python."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)
    tidy()
