"""Rules and block lists for URLs: a blocked Bloom filter lets possible hits through to an exact hash join.

A rule is a host with an optional path, written like ``net/de/``. It fits its host and all
subdomains where the path starts with the rule's path, both as the URL spells them. A listed entry
is a host, which stands for itself and its subdomains, or a URL without its scheme, which stands
for that page alone. Listed entries and URLs are compared in canonical form: no user part or port,
no dots at the host's end, A-Z of the host in lower case, percent-encoded characters of the path
decoded, runs of slashes as one, an empty path as ``/``.

So a URL's possible keys are the suffixes of its host with those prefixes of its path whose length
some rule has, the suffixes of its canonical host, and its canonical form. All of them are hashed
into a blocked Bloom filter (a block of eight 64-bit words, one bit in each), sized by the number of
entries, and the few that may be listed go to an exact join. The longest rule wins (of equal length:
the longer host); without a rule, a listed entry decides, and everything else is allowed.

Distinct URLs are judged once and joined back. The filter and the entries are broadcast below a
stated number of blocks and entries, and shuffled beyond it. Everything is DataFrame functions.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits nothing and is
allowed; a path that is not valid percent-encoding is compared as it is; repeated URLs get equal
verdicts; repeated entries count once, and of entries that differ in the verdict alone the
alphabetically last decides; no entries allow everything; an empty table gives an empty table;
other columns are passed through (host, path, rule and verdict are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import ascii_lower, dropped, stored

WORDS = 8
BITS_PER_ENTRY = 16
#: Broadcast bounds: a block takes about 100 bytes, an entry about 200, so both stay under 10 MB.
MAX_BLOCKS, MAX_ENTRIES = 100_000, 50_000


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical_host(host: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(ascii_lower(host), r"^.*@", ""), r":[0-9]*$", "")
    return F.rtrim(bare, F.lit("."))


def canonical_path(path: Column) -> Column:
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(decoded, r"^/+", ""), r"/+", "/"))


def entries(spark, rules: dict[str, str], listed: list[str]) -> DataFrame:
    """Entries given as text: rules with their verdicts, then listed hosts and URLs."""
    rows = [(e, v, True) for e, v in rules.items()] + [(e, "block", False) for e in listed]
    return spark.createDataFrame(rows, "entry string, verdict string, is_rule boolean")


def keyed(listing: DataFrame) -> DataFrame:
    """key, size (of a rule's path), host_size, verdict, is_rule: what URLs' keys are compared with."""
    h, p = F.regexp_extract("entry", r"^[^/]*", 0), F.regexp_extract("entry", r"(?s)^[^/]*(.*)$", 1)
    page = F.concat(F.lit("u "), canonical_host(h), canonical_path(F.regexp_extract(p, r"^[^?#]*", 0)))
    key = F.when(F.col("is_rule"), F.concat(F.lit("r "), ascii_lower(h), p)).when(p != "", page).otherwise(F.concat(F.lit("h "), canonical_host(h)))
    rows = listing.where("entry is not null and entry <> ''").select(key.alias("key"), F.when(F.col("is_rule"), F.length(p)).alias("size"), F.length(h).alias("host_size"), "verdict", "is_rule")
    return rows.groupBy("key", "is_rule").agg(F.first("size").alias("size"), F.max("host_size").alias("host_size"), F.max("verdict").alias("verdict"))


def _bits(key: Column) -> list[Column]:
    """The bit in each word of a key's block."""
    h = F.xxhash64(F.lit(1), key)
    return [F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """block and its words, from a table with a column key."""
    placed = keys.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), *(b.alias(f"b{i}") for i, b in enumerate(_bits(F.col("key")))))
    words = [F.bit_or(F.expr(f"shiftleft(1L, b{i})")).alias(f"w{i}") for i in range(WORDS)]
    return placed.groupBy("block").agg(*words)


def maybe(rows: DataFrame, filled: DataFrame, blocks: int) -> DataFrame:
    """The rows whose key may be among the filter's keys."""
    probes = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    side = F.broadcast(filled) if blocks <= MAX_BLOCKS else filled
    hit = F.lit(True)
    for i, bit in enumerate(_bits(F.col("key"))):
        hit = hit & (F.getbit(F.col(f"w{i}"), bit) == 1)
    return probes.join(side, "block").where(hit).drop("block", *(f"w{i}" for i in range(WORDS)))


def judge(pages: DataFrame, listing: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (the longest fitting one, or null) and verdict.

    ``listing`` has the columns entry, verdict and is_rule, as ``entries`` makes them.
    """
    known = stored(keyed(listing), "entries")
    sizes = [r[0] for r in known.where("is_rule").select("size").distinct().collect()]  # as many as rules' paths have lengths
    count = known.count()
    blocks = 1 << max(0, -(-count * BITS_PER_ENTRY // (64 * WORDS)) - 1).bit_length()
    address = F.col(f"`{url}`")
    hosts = pages.select(address.alias("_url")).where(F.instr("_url", "://") > 0).distinct()
    hosts = hosts.select("_url", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    hosts = hosts.withColumn("bare", canonical_host(F.col("host")))
    fit = F.filter(F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>"), lambda s: s <= F.length("path"))

    def suffixes(host: str) -> Column:
        labels = F.split(host, r"\.")
        return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))

    of_rules = F.flatten(F.transform(suffixes("host"), lambda s: F.transform(fit, lambda n: F.concat(F.lit("r "), s, F.substring(F.col("path"), F.lit(1), n)))))
    of_hosts = F.transform(suffixes("bare"), lambda s: F.concat(F.lit("h "), s))
    of_page = F.array(F.concat(F.lit("u "), "bare", canonical_path(F.col("path"))))
    filled = stored(bloom(known, blocks), "bloom")
    possible = maybe(hosts.select("_url", F.explode(F.concat(of_rules, of_hosts, of_page)).alias("key")), filled, blocks)
    exact = F.broadcast(known) if count <= MAX_ENTRIES else known.hint("shuffle_hash")
    hits = possible.join(exact, "key")
    best = F.max_by(F.struct("key", "verdict", "is_rule"), F.struct("is_rule", F.length("key"), "host_size", "key"))
    judged = stored(hits.groupBy("_url").agg(best.alias("_best")), "judged")
    dropped(known)
    dropped(filled)
    passed = [f"`{c}`" for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    return pages.join(judged, address == F.col("_url"), "left").select(
        *passed,
        F.coalesce(host_of(address), F.lit("")).alias("host"),
        F.coalesce(path_of(address), F.lit("")).alias("path"),
        F.when(F.col("_best.is_rule"), F.expr("substring(_best.key, 3)")).alias("rule"),
        F.coalesce(F.col("_best.verdict"), F.lit("allow")).alias("verdict"),
    )
