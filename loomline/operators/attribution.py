"""Which sessions, conversations and workspaces an editor's key-value entries speak of, whatever their nesting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.nested import levels_in, string_leaves
from loomline.functions.text import trimmed

# Keys in lower case by what their strings name, and patterns of absolute paths.
KEYS = {
    "composerid": "active_composer",
    "conversationid": "conversation",
    "requestid": "request",
    "sessionid": "session",
    "workspaceid": "workspace",
    "workspacestorageid": "workspace_storage",
}
POSIX_PATH = r"/(?:Users|home|tmp|var|opt|private|Volumes)/[^\s\"'`]+"
WINDOWS_PATH = r"[A-Za-z]:\\[^\s\"'`]+"
TELLING = ["composer", "workspace", "session", "conversation", "request"]


def relevant(key: Column) -> Column:
    """Whether an entry's key is worth looking into."""
    low, hit = F.lower(key), F.lit(False)
    for part in TELLING:
        hit = hit | F.contains(low, F.lit(part))
    return hit


def attributed(entries: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """kind and name of every id and path in ``entries``, each once; kind ``entry`` has the keys themselves.

    A value that is not JSON is a string of its own. Ids are strings that an object holds under a
    telling key, and under ``id`` where the entry's key or one above speaks of what is active. Paths are
    absolute ones anywhere in a string, and whole strings below a key ``path`` or in a workspace's entry.
    """
    text = trimmed(F.col(f"`{value}`"))
    parsed = F.coalesce(F.try_parse_json(F.nullif(text, F.lit(""))), F.to_variant_object(F.array(F.col(f"`{value}`"))))
    name = F.lower(F.col(f"`{key}`"))
    leaves = entries.where(f"`{key}` is not null and `{value}` is not null").select(name.alias("entry"), F.explode(string_leaves(parsed, 1 + levels_in(F.col(f"`{value}`")))).alias("leaf"))
    path, s = F.col("leaf.path"), F.col("leaf.s")
    last = F.lower(F.element_at(path, -1))
    above = F.slice(path, 1, F.size(path) - 1)
    active = F.contains("entry", F.lit("active")) | F.exists(above, lambda p: F.contains(F.lower(p), F.lit("active")))
    kind = F.when((last == "id") & active, "active_composer")
    for k, v in KEYS.items():
        kind = F.when(last == k, v).otherwise(kind)
    ids = leaves.where("leaf.direct").select(kind.alias("kind"), s.alias("name")).where("kind is not null")
    inside = F.concat(F.regexp_extract_all(s, F.lit(POSIX_PATH), F.lit(0)), F.regexp_extract_all(s, F.lit(WINDOWS_PATH), F.lit(0)))
    placed = F.exists(path, lambda p: F.lower(p) == "path") | F.contains("entry", F.lit("workspace"))
    bare = trimmed(s)
    whole = F.when(placed & (F.startswith(bare, F.lit("/")) | bare.rlike(r"\A[A-Za-z]:\\")), F.array(bare)).otherwise(F.array().cast("array<string>"))
    paths = leaves.select(F.lit("workspace_path").alias("kind"), F.explode(F.concat(inside, whole)).alias("name"))
    keys = entries.where(f"`{key}` is not null").select(F.lit("entry").alias("kind"), F.col(f"`{key}`").alias("name"))
    return ids.unionByName(paths).unionByName(keys).distinct()
