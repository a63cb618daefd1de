"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Shingles are hashed into a circle of 2 ** 20 places. One permutation scatters the places; a second
one, shifted by k along the circle, gives signature coordinate k. So a shingle's values in all
coordinates are one run of the second permutation, and a signature is the minimum over such runs.

The candidates of a band's bucket are never multiplied out. Texts with equal shingle sets are one
class, a node of the graph with a number of its own; links and bounds are between classes, and the
classes of an id that comes with several texts are linked. A class's ``own`` shingles occur in no other compared
class, so they can be in no intersection; with the sizes they bound the similarity of a pair from
above, and pairs (or whole classes) that cannot reach the threshold are left out without a loss.
Every bucket compares all members with its leader, the member with the smallest share of own
shingles, which is the text that others derive from, and notes which of the leader's shingles each
member has. Components of the confirmed links are formed. Members outside a bucket's largest
component then meet all members that no chain of links reaches yet, in blocks of bounded size: the
notes give their common part within the leader exactly, and what lies outside it bounds the rest.
Pairs that this decides are links at once, and those that can still reach the threshold are
compared in full. Links inside a component cannot change the result, so none is lost.

Defined cases: a null, empty or blank text has no shingles and is linked with nothing; a text with
fewer words than a shingle is one shingle; rows with a null id are kept and have no component;
rows with the same id are one document that has the links of all its texts; equal texts link
unless empty; an empty table gives an empty table; only the columns of id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import dropped, slices, stored
from loomline.llm.components import components

CIRCLE = 1 << 20
BANDS, ROWS_PER_BAND = 32, 5
SEED = 20240607
ROWS = 200
#: Members of a bucket in one block.
BLOCK = 256


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; A-Z lower-cased, ASCII white space."""
    found = (text or "").encode().lower().split()
    if len(found) > words:
        runs = zip(*(found[i:] for i in range(words)), strict=False)
        hashes = list(map(xxhash.xxh3_64_intdigest, map(b" ".join, runs)))
    else:
        hashes = [xxhash.xxh3_64_intdigest(b" ".join(found))] if found else []
    return np.unique(np.array(hashes, np.uint64))


class Circulant:
    """The two permutations and the signatures they give."""

    def __init__(self, coordinates: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.scatter = rng.permutation(CIRCLE).astype(np.uint32)
        shifted = rng.permutation(CIRCLE).astype(np.uint32)
        self.runs = sliding_window_view(np.concatenate([shifted, shifted[: coordinates - 1]]), coordinates)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        places = self.scatter[hashes & np.uint64(CIRCLE - 1)]
        least = [self.runs[places[at : at + 1024]].min(axis=0) for at in range(0, len(places), 1024)]
        return np.minimum.reduce(least)


_circles: dict[int, Circulant] = {}


def circle(coordinates: int) -> Circulant:
    if coordinates not in _circles:
        _circles[coordinates] = Circulant(coordinates)
    return _circles[coordinates]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    whole = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return _signed(whole >> 64), _signed(whole & (1 << 64) - 1)


def signatures(documents: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS_PER_BAND) -> DataFrame:
    """doc_id, n_shingles, f1 and f2 (128-bit fingerprint of the set), bands (array of bucket keys)."""
    names = ["doc_id", "n_shingles", "f1", "f2", "bands"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def of(text: str | None) -> tuple:
        hashes = shingle_hashes(text, words)
        if not len(hashes):
            return 0, None, None, []
        signature = circle(bands * rows).signature(hashes)
        keys = [_signed(xxhash.xxh3_64_intdigest(signature[b * rows : (b + 1) * rows].tobytes(), b)) for b in range(bands)]
        return len(hashes), *_fingerprint(hashes), keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            made = zip(*map(of, batch.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([batch.column(0), *made], types, strict=True)], names=names)

    return documents.mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """node, again, shingles (array of hashes) of the rows of node, again, f1, f2, text whose text has that fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            sets = [shingle_hashes(t, words) for t in batch.column(4).to_pylist()]
            same = [len(s) > 0 and _fingerprint(s) == key for s, key in zip(sets, zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True), strict=True)]
            made = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "again", "shingles"])
            yield made.filter(pa.array(same, pa.bool_()))

    return texts.select("node", "again", "f1", "f2", "text").mapInArrow(run, "node long, again boolean, shingles array<long>")


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, linked, common and bits of pairs: whether their full sets reach the threshold, and which of a's shingles b has."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            has = [np.isin(x.values.to_numpy(), y.values.to_numpy(), assume_unique=True) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            common = [int(h.sum()) for h in has]
            linked = [100 * c >= percent * (len(x) + len(y) - c) for c, x, y in zip(common, batch.column(2), batch.column(3), strict=True)]
            columns = [batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(common, pa.int64()), pa.array([np.packbits(h).tobytes() for h in has], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "linked", "common", "bits"])

    return both.mapInArrow(run, "a long, b long, linked boolean, common long, bits binary")


def _open_pairs(percent: int):
    """For a block of askers and one of members of the same bucket: pairs of different components that may link.

    A pair whose common part lies within the leader is decided here; of such links, those that
    join components still apart are given as sure. The others are given for a full comparison.
    """

    def run(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "sure": pd.Series(dtype="bool")})
        if ask.empty or have.empty:
            return empty

        def both(name: str) -> tuple[np.ndarray, np.ndarray]:
            return ask[name].to_numpy()[:, None], have[name].to_numpy()[None, :]

        width = max(1, *map(len, ask["bits"]), *map(len, have["bits"]))

        def inside(rows: pd.DataFrame) -> np.ndarray:
            packed = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in rows["bits"]), np.uint8).reshape(len(rows), width)
            return np.unpackbits(packed, axis=1).astype(np.float32)

        extra, most, noted = np.minimum(*both("extra")), np.minimum(*both("most")), np.logical_and(*both("noted"))
        within = np.rint(inside(ask) @ inside(have).T).astype(np.int64)
        bound = np.where(noted, np.minimum(within + extra, most), most)
        (n, m), (node, other), (mine, theirs) = both("n"), both("node"), both("component")
        once = ~have["asks"].to_numpy()[None, :] | (node < other)  # two that both ask meet once
        i, j = np.nonzero((mine != theirs) & once & (100 * bound >= percent * (n + m - bound)))
        if len(i):
            left, right = np.stack(ask["bands"].to_list()), np.stack(have["bands"].to_list())
            first = (left[i] == right[j]).argmax(axis=1) == int(ask["band"].iloc[0])  # in other buckets they meet again
            i, j = i[first], j[first]
        if not len(i):
            return empty
        decided = (noted & (extra == 0))[i, j]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := root.setdefault(x, x)) != x:
                root[x] = root[y]
                x = root[y]
            return x

        a, b = ask["node"].to_numpy()[i].tolist(), have["node"].to_numpy()[j].tolist()
        ca, cb = ask["component"].to_numpy()[i].tolist(), have["component"].to_numpy()[j].tolist()
        out = []
        for k in np.flatnonzero(decided).tolist():
            p, q = find(ca[k]), find(cb[k])
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((a[k], b[k], True))
        out += [(a[k], b[k], False) for k in np.flatnonzero(~decided).tolist() if find(ca[k]) != find(cb[k])]
        return pd.DataFrame(out, columns=["a", "b", "sure"]) if out else empty

    return run


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked id), kept (whether that is the row's own id)."""
    docs = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    scratch = []

    def held(df: DataFrame, name: str) -> DataFrame:
        scratch.append(stored(df, name))
        return scratch[-1]

    signed = stored(signatures(docs, words), "signatures")
    able = signed.where("n_shingles > 0 and doc_id is not null")
    classes = able.groupBy("f1", "f2").agg(F.min("doc_id").alias("least_id"), F.first("bands").alias("bands"), F.first("n_shingles").alias("n"))
    # The numbers are unique, and the stored table keeps them.
    classes = held(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    again = held(able.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "again")

    entries = classes.select(F.posexplode("bands").alias("band", "key"), "node", "n")
    sizes = entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").drop("size")
    shared = held(entries.join(sizes, "key"), "shared")
    wanted = classes.join(shared.select("node").distinct(), "node").select("node", "f1", "f2", F.col("least_id").alias("doc_id"))
    wanted = wanted.join(again.withColumn("again", F.lit(True)), "doc_id", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    sets = held(shingle_sets(docs.join(wanted, "doc_id"), words), "sets")
    repeated = sets.where("again")
    if repeated.take(1):  # rows that repeat an id and text give a set each
        once = repeated.groupBy("node").agg(F.first("again").alias("again"), F.first("shingles").alias("shingles"))
        sets = held(sets.where("not again").unionByName(once), "sets")
    alone = sets.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("sets"), F.min("node").alias("node")).where("sets = 1")
    own = held(alone.groupBy("node").agg(F.count("*").alias("own")), "own")
    members = shared.join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    able_to_link = f"100 * (n - own) >= {percent} * n"  # else its own shingles alone rule every link out
    rank = F.struct(F.floor(1000 * F.col("own") / F.col("n")).alias("share"), "node")
    members = held(members.where(able_to_link).select("key", "band", "node", "n", "own", rank.alias("rank")), "members")
    leaders = members.groupBy("key").agg(F.min(F.struct("rank", "n", "own")).alias("l"), F.min("n").alias("least"))
    leaders = held(leaders.select("key", F.col("l.rank.node").alias("leader"), F.col("l.n").alias("pn"), F.col("l.own").alias("pown"), "least"), "leaders")
    # An upper bound of the intersection in place of it: 100 c >= percent (n + pn - c).
    near = f"{100 + percent} * least(n - own, pn - pown) >= {percent} * (n + pn)"
    first = members.join(leaders, "key").where(near).where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    against = held(compared(first, sets, percent), "against-leaders")
    of_id = able.join(again, "doc_id").join(classes.select("f1", "f2", "node"), ["f1", "f2"]).select("doc_id", "node").distinct()
    first_of_id = of_id.groupBy("doc_id").agg(F.min("node").alias("a"))
    same_id = of_id.join(first_of_id, "doc_id").where("a <> node").select("a", F.col("node").alias("b"))
    links = held(against.where("linked").select("a", "b").unionByName(same_id), "confirmed")
    found = components(links)

    # The largest partner that a member's own shingles allow must not be smaller than the bucket's smallest.
    partner = f"floor({100 + percent} * (n - own) / {percent}) - n >= least"
    named = members.drop("rank").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = named.groupBy("key", "component").agg(F.count("*").alias("size"))
    largest = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("size", "component")).alias("main")).where("parts > 1").drop("parts")
    mixed = named.join(largest.join(leaders.select("key", "leader", "least"), "key"), "key").where(partner).drop("least")
    mixed = held(mixed.withColumn("asks", F.col("component") != F.col("main")).drop("main"), "mixed")
    # What was compared with the leader is settled, so the leader meets nobody again.
    mixed = mixed.where("node <> leader")
    counts = mixed.groupBy("key").agg(F.count("*").alias("all"), F.count_if("asks").alias("asking")).where("asking > 0 and `all` > 1")

    def blocks(c: str) -> Column:
        return F.ceil(F.col(c) / F.lit(BLOCK)).cast("int")

    counts = held(counts.select("key", blocks("all").alias("blocks"), blocks("asking").alias("lots")), "counts")
    noted = against.select(F.col("a").alias("leader"), F.col("b").alias("node"), "common", "bits")
    full = mixed.join(counts, "key").join(noted, ["leader", "node"], "left").join(classes.select("node", "bands"), "node")
    place = F.xxhash64("node")
    full = full.select(
        *("key", "band", "node", "n", "component", "asks", "bands", "blocks", "lots"),
        F.col("bits").isNotNull().alias("noted"),
        F.coalesce("bits", F.lit(b"")).alias("bits"),
        (F.col("n") - F.coalesce("common", F.lit(0)) - F.col("own")).alias("extra"),
        (F.col("n") - F.col("own")).alias("most"),
        F.pmod(place, "blocks").cast("int").alias("block"),
        F.pmod(F.xxhash64(place), "lots").cast("int").alias("lot"),
    )
    full = held(full, "full")
    asking = full.where("asks").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    facing = full.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    meet = ["key", "block", "lot"]
    open_pairs = held(asking.groupBy(*meet).cogroup(facing.groupBy(*meet)).applyInPandas(_open_pairs(percent), "a long, b long, sure boolean"), "open")
    checked = compared(open_pairs.where("not sure").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sets, percent)
    more = held(open_pairs.where("sure").select("a", "b").unionByName(checked.where("linked").select("a", "b")), "more")
    if more.take(1):
        dropped(found)
        found = components(links.unionByName(more))
    scratch.append(found)
    named = classes.select("f1", "f2", "node", "least_id").join(found, "node", "left")
    least = named.where("component is not null").groupBy("component").agg(F.min("least_id").alias("smallest"))
    homes = stored(named.join(least, "component", "left").select("f1", "f2", F.coalesce("smallest", "least_id").alias("component_id")), "homes")
    for table in scratch:
        dropped(table)
    # A document without shingles is its own component.
    component = F.coalesce("component_id", "doc_id")
    joined = signed.drop("bands").join(homes, ["f1", "f2"], "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return joined.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
