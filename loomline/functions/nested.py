"""Walking JSON values of any depth in SQL expressions.

A value is a list of nodes; a round opens every array and object in it, and a fold goes on until
nothing is closed. It has as many rounds as the caller says there are levels at most (such as
brackets in the text), of which those after the last opening do nothing. The walk stays within the
row: no Python, no join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.text import filled, let, trimmed

#: Levels at most; a parsed value has fewer.
DEEPEST = 1000
# How a step into an object's own text, or one of the keys that stand for it, is numbered.
OWN_TEXT, STAND_INS = -10, {"content": -9, "message": -8, "body": -7}


def as_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def as_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def string_of(v: Column) -> Column:
    """The value if it is a string, else null."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _node(path: Column, v: Column, s: Column, direct: Column) -> Column:
    return F.struct(path.alias("path"), v.alias("v"), s.alias("s"), direct.alias("direct"))


def _opened(nodes: Column, inner: Callable[[Column, Column, Column], Column]) -> Column:
    """One round: ``inner`` gives the nodes of an array or object; strings become leaves, other values go."""
    none = F.filter(nodes, lambda n: F.lit(False))

    def one(n: Column) -> Column:
        leaf = let(string_of(n.v), lambda s: F.when(s.isNotNull(), F.array(_node(n.path, F.lit(None).cast("variant"), s, n.direct))).otherwise(none))
        parts = F.struct(as_array(n.v).alias("a"), as_object(n.v).alias("o"))
        return F.when(n.s.isNotNull(), F.array(n)).otherwise(let(parts, lambda p: F.when(p.a.isNotNull() | p.o.isNotNull(), inner(n, p.a, p.o)).otherwise(leaf)))

    return F.flatten(F.transform(nodes, one))


def levels_in(raw: Column) -> Column:
    """How many levels a JSON text may have: its opening brackets."""
    return F.least(F.lit(DEEPEST), F.regexp_count(raw, F.lit(r"[\[{]")) + 1)


def _walked(v: Column, path_type: str, inner: Callable[[Column, Column, Column], Column], levels: Column | None) -> Column:
    def closed(nodes: Column) -> Column:
        return F.exists(nodes, lambda n: n.s.isNull())

    nodes = F.array(_node(F.array().cast(f"array<{path_type}>"), v, F.lit(None).cast("string"), F.lit(False)))
    rounds = F.sequence(F.lit(1), F.lit(DEEPEST) if levels is None else levels)
    return F.aggregate(rounds, nodes, lambda st, _: F.when(closed(st), _opened(st, inner)).otherwise(st))


def string_leaves(v: Column, levels: Column | None = None) -> Column:
    """The strings in a value as structs of path (the keys above, arrays left out), s, and direct (whether an object holds it, not an array)."""

    def inner(n: Column, a: Column, o: Column) -> Column:
        of_array = F.transform(a, lambda x: _node(n.path, x, F.lit(None).cast("string"), F.lit(False)))
        of_object = F.transform(F.map_entries(o), lambda e: _node(F.concat(n.path, F.array(e.key)), e.value, F.lit(None).cast("string"), F.lit(True)))
        return F.coalesce(of_array, of_object)

    return F.transform(_walked(v, "string", inner, levels), lambda n: F.struct(n.path.alias("path"), n.s.alias("s"), n.direct.alias("direct")))


def flat_text(v: Column, between: str = "\n\n", levels: Column | None = None) -> Column:
    """The text of a value: a string, the texts of an array, or of an object its text, else the first of content, message and body that has any."""
    none = F.lit(None).cast("string")

    def inner(n: Column, a: Column, o: Column) -> Column:
        of_array = F.transform(a, lambda x, i: _node(F.concat(n.path, F.array(i)), x, none, F.lit(False)))
        own = F.array(_node(F.concat(n.path, F.array(F.lit(OWN_TEXT))), o["text"], none, F.lit(True)))
        others = F.array(*(_node(F.concat(n.path, F.array(F.lit(k))), o[key], none, F.lit(True)) for key, k in STAND_INS.items()))
        of_object = F.when(F.length(trimmed(string_of(o["text"]))) > 0, own).otherwise(F.filter(others, lambda x: x.v.isNotNull()))
        return F.when(a.isNotNull(), of_array).otherwise(of_object)

    leaf = "struct<path: array<int>, s: string>"
    found = F.transform(_walked(v, "int", inner, levels), lambda n: F.struct(n.path.alias("path"), trimmed(n.s).alias("s")))
    in_order = F.array_sort(F.filter(found, lambda n: F.length(n.s) > 0))

    def lower(kept: Column, n: Column) -> Column:
        """Whether a leaf lies under a later stand-in of an object whose text the last kept leaf is part of."""
        last = F.element_at(kept, -1)
        apart = F.array_position(F.zip_with(last.path, n.path, lambda x, y: x == y), F.lit(False))
        return (F.size(kept) > 0) & (apart > 0) & (F.get(n.path, (apart - 1).cast("int")) < 0)

    def chosen(x: Column) -> Column:
        kept = F.aggregate(x, F.array().cast(f"array<{leaf}>"), lambda out, n: F.when(lower(out, n), out).otherwise(F.concat(out, F.array(n))))
        return F.when(F.size(x) <= 1, x).otherwise(kept)  # most values have one text, which needs no comparison

    return filled(F.array_join(F.transform(let(in_order, chosen), lambda n: n.s), between))
