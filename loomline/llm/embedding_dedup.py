"""Near-duplicate embeddings by product quantisation: inverted lists, residual codes, exact rerank.

Equal vectors with equal labels are one class with a multiplicity. Class vectors, scaled to length
1, go to the list of their nearest coarse centre and are stored as codes of their residual in
small subspaces, with the length of the coding error. Centres and codes are fitted on a bounded
sample; every vector is indexed and every vector is a query.

Probes are sufficient, not a fixed number: the plane halfway between two centres separates their
lists, so the distances of two linked vectors from it sum up to the link distance at most, and one
of them lies within half of it. That one asks the other's list: every vector asks its own list and
those whose plane is within half the link distance. A pair found from both ends counts once. In an
asked list, table look-ups give the distance from the asker to each coded vector; less the stored
coding error it is a lower bound. The first subspaces rule most vectors out before the others are
looked up, and only vectors whose bound is within the link distance are reranked by the exact cosine
in double precision. So quantisation loses no link; recall is limited by rounding alone.

Lists and their queries meet in blocks of bounded size, however many vectors a list has, and a
block returns counts and a spanning forest of its links instead of the links themselves.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows
with a null label or id, link with nothing and have no links; vectors of different lengths never
link; rows that repeat an id are separate vectors, of which n_links shows the most linked one, and
share a component; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import dropped, slices, stored
from loomline.llm.components import components

SAMPLE, ROUNDS, SEED = 20_000, 12, 20240607
CODES = 256
SUBSPACE = 4
#: Subspaces looked up first.
HEAD = 4
#: Vectors of a list in one block, and rows of one step.
BLOCK, ROWS = 2048, 2000
#: Coarse centres grow with the root of the number of classes, up to a number whose table is small enough to send to every task.
PER_ROOT, MOST_CENTRES = 0.25, 2048


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means centres of ``x``; empty cells keep their centre."""
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = (x @ centres.T - 0.5 * (centres**2).sum(axis=1)).argmax(axis=1)
        for c in np.unique(near):
            centres[c] = x[near == c].mean(axis=0)
    return centres


class Quantiser:
    """Coarse centres and a codebook for each subspace of the residuals."""

    def __init__(self, sample: np.ndarray, centres: int):
        rng = np.random.default_rng(SEED)
        self.centres = _means(sample, centres, rng)
        residual = sample - self.centres[self.nearest(sample)]
        self.parts = [slice(a, min(a + SUBSPACE, sample.shape[1])) for a in range(0, sample.shape[1], SUBSPACE)]
        self.books = [_means(residual[:, p], CODES, rng) for p in self.parts]
        apart = ((self.centres[:, None] - self.centres[None]) ** 2).sum(axis=2)
        self.apart = np.sqrt(np.maximum(apart, 1e-18))

    def squares(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ self.centres.T + (self.centres**2).sum(axis=1), 0)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return self.squares(x).argmin(axis=1)

    def coded(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of each vector, the length of the error in the first subspaces and in all."""
        residual = x - self.centres[lists]
        codes = np.empty((len(x), len(self.parts)), np.uint8)
        error = head = np.zeros(len(x))
        for k, (p, book) in enumerate(zip(self.parts, self.books, strict=True)):
            d = ((residual[:, p] ** 2).sum(axis=1)[:, None] - 2 * residual[:, p] @ book.T) + (book**2).sum(axis=1)
            codes[:, k] = d.argmin(axis=1)
            error = error + ((residual[:, p] - book[codes[:, k]]) ** 2).sum(axis=1)
            head = error if k < HEAD else head
        return codes, np.sqrt(head), np.sqrt(error)

    def probes(self, x: np.ndarray, within: float) -> np.ndarray:
        """Which lists each of ``x`` asks, so that of two vectors within a distance one asks the other's list."""
        d = self.squares(x)
        own = d.argmin(axis=1)
        beyond = (d - d[np.arange(len(x)), own][:, None]) / (2 * self.apart[own])
        near = beyond <= within / 2 + 1e-6
        near[np.arange(len(x)), own] = True
        return near

    def tables(self, x: np.ndarray, centre: int) -> list[np.ndarray]:
        """For each subspace, squared distances from the queries' residuals to all codes."""
        r = x - self.centres[centre]
        return [((r[:, p] ** 2).sum(axis=1)[:, None] - 2 * r[:, p] @ book.T) + (book**2).sum(axis=1) for p, book in zip(self.parts, self.books, strict=True)]


def usable(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """id, label, dim and v (array of double) of the rows that can link."""
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where("id is not null and label is not null").where(finite & F.exists("v", lambda c: c != 0)).withColumn("dim", F.size("v"))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def _rows(values: pa.Array | list) -> np.ndarray:
    """Vectors of equal length from their bytes."""
    return np.frombuffer(b"".join(values.to_pylist() if isinstance(values, pa.Array) else values), np.float64).reshape(len(values), -1)


def _forest(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the given links connect, at most one for each node."""
    root: dict[int, int] = {}

    def find(a: int) -> int:
        while (b := root.setdefault(a, a)) != a:
            root[a] = root[b]
            a = root[a]
        return a

    out = []
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        p, q = find(a), find(b)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((a, b))
    return out


def _links(classes: DataFrame, quantiser: Quantiser, cosine: float) -> DataFrame:
    """kind "count": class id and number of linked vectors in a block; kind "link": two class ids."""
    model = classes.sparkSession.sparkContext.broadcast(quantiser)  # at most MOST_CENTRES centres and SUBSPACE-wide codebooks
    within = float(np.sqrt(2 - 2 * cosine)) + 1e-9

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = model.value
        for batch in slices(batches, ROWS):
            x = _unit(batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            lists = q.nearest(x)
            codes, head, error = q.coded(x, lists)
            packed = np.packbits(q.probes(x, within), axis=1)
            columns = [batch.column(0), pa.array(lists, pa.int32()), batch.column(1), batch.column(2)]
            columns += [pa.array([r.tobytes() for r in rows], pa.binary()) for rows in (x, packed, codes)] + [pa.array(head), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "list", "id", "n", "u", "asks", "codes", "head", "error"])

    index = classes.select("label", "id", "n", "v").mapInArrow(indexed, "label string, list int, id long, n long, u binary, asks binary, codes binary, head double, error double")
    index = stored(index, "index")
    sizes = index.groupBy("label", "list").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    sizes = stored(sizes, "list-sizes")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    held = index.join(sizes, ["label", "list"]).withColumn("block", block)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            bits = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            who, where = np.nonzero(np.unpackbits(bits, axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), pa.array(where, pa.int32()), *(batch.column(i).take(pa.array(who)) for i in (1, 2, 3, 4))], names=["label", "list", "own", "id", "n", "u"])

    queries = index.select("label", "list", "id", "n", "u", "asks").mapInArrow(asked, "label string, list int, own int, id long, n long, u binary")
    # Queries of a list go to each of its blocks, in lots of about BLOCK themselves.
    lots = queries.groupBy("label", "list").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("lots"))
    lots = stored(lots.join(sizes, ["label", "list"]), "lots")
    lot = F.pmod(F.xxhash64("id", F.lit(1)), F.col("lots")).cast("int")
    dealt = queries.join(lots, ["label", "list"]).select("label", "list", "own", "id", "n", "u", lot.alias("lot"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    copies = held.join(lots.select("label", "list", "lots"), ["label", "list"]).select("label", "list", "block", "id", "n", "u", "asks", "codes", "head", "error", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))

    def compared(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"kind": pd.Series(dtype=object), "a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})]
        if len(ask) and len(have):
            q, centre = model.value, int(have["list"].iloc[0])
            x, y = _rows(ask["u"].to_list()), _rows(have["u"].to_list())
            codes = np.frombuffer(b"".join(have["codes"]), np.uint8).reshape(len(have), -1)
            bits = np.frombuffer(b"".join(have["asks"]), np.uint8).reshape(len(have), -1)
            ids, others = ask["id"].to_numpy(), have["id"].to_numpy()
            times, other_times = ask["n"].to_numpy(), have["n"].to_numpy()
            own = ask["own"].to_numpy()
            head, error = have["head"].to_numpy(), have["error"].to_numpy()
            for at in range(0, len(ask), 256):
                tables = q.tables(x[at : at + 256], centre)
                near = tables[0][:, codes[:, 0]]
                for k in range(1, min(HEAD, len(tables))):
                    near += tables[k][:, codes[:, k]]
                i, j = np.nonzero(near <= (head + within + 1e-6) ** 2)
                far = near[i, j]
                for k in range(HEAD, len(tables)):
                    far = far + tables[k][i, codes[j, k]]
                close = np.sqrt(np.maximum(far, 0)) - error[j] <= within + 1e-6
                i, j = i[close] + at, j[close]
                # Inside one list both ends ask; the smaller id counts the link. Of two lists that ask each other, the lower one's vector does.
                mutual = (bits[j, own[i] >> 3] >> (7 - (own[i] & 7))) & 1
                once = np.where(own[i] == centre, ids[i] < others[j], (mutual == 0) | (own[i] < centre))
                i, j = i[once], j[once]
                linked = (x[i] * y[j]).sum(axis=1) >= cosine
                i, j = i[linked], j[linked]
                counts = pd.DataFrame({"a": np.concatenate([ids[i], others[j]]), "b": np.concatenate([other_times[j], times[i]])}).groupby("a", as_index=False)["b"].sum()
                out.append(counts.assign(kind="count"))
                forest = _forest(ids[i], others[j])
                out.append(pd.DataFrame(forest, columns=["a", "b"], dtype="int64").assign(kind="link"))
        return pd.concat(out, ignore_index=True)[["kind", "a", "b"]].astype({"a": "int64", "b": "int64"})

    key = ["label", "list", "block", "lot"]
    found = stored(dealt.groupBy(*key).cogroup(copies.groupBy(*key)).applyInPandas(compared, "kind string, a long, b long"), "links")
    for table in (index, sizes, lots):
        dropped(table)
    return found


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest linked id), kept."""
    able = stored(usable(vectors, vec_id, embedding, label), "vectors")
    key = ["label", "dim", "v"]
    # The numbers are unique, and the stored table keeps them.
    classes = able.groupBy(*key).agg(F.min("id").alias("least_id"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id())
    classes = stored(classes, "classes")
    again = able.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id")
    of_id = able.join(again, "id").select(F.col("id").alias("vec"), *key).join(classes.select(*key, "id"), key).select("vec", "id").distinct()
    same_id = of_id.join(of_id.groupBy("vec").agg(F.min("id").alias("a")), "vec").where("a <> id").select("a", F.col("id").alias("b"))
    parts = []
    for dim, size in sorted(classes.groupBy("dim").count().collect()):  # a row for each vector length
        own = classes.where(F.col("dim") == dim)
        sample = own.orderBy(F.xxhash64("v", "label"), "v").limit(SAMPLE).select("v").toPandas()["v"]
        centres = int(min(MOST_CENTRES, max(1, PER_ROOT * size**0.5)))
        parts.append(_links(own, Quantiser(_unit(np.array(sample.to_list(), np.float64)), centres), cosine))
    if not parts:
        counts = vectors.sparkSession.createDataFrame([], "id long, others long")
        homes = vectors.sparkSession.createDataFrame([], "node long, component long")
    else:
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        counts = stored(found.where("kind = 'count'").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("others")), "counts")
        homes = components(found.where("kind = 'link'").select("a", "b").unionByName(same_id))
    named = classes.join(counts, "id", "left").join(homes.select(F.col("node").alias("id"), "component"), "id", "left")
    least = named.where("component is not null").groupBy("component").agg(F.min("least_id").alias("smallest"))
    named = named.join(least, "component", "left").select(*key, (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("smallest", "least_id").alias("home"))
    of_class = stored(named, "of-class")
    linked = able.join(of_class, key).select("id", "links", "home")
    out = stored(linked.groupBy("id").agg(F.max("links").alias("n_links"), F.min("home").alias("component_id")), "linked")
    for table in (able, classes, of_class, *parts, *([counts, homes] if parts else [])):
        dropped(table)
    number = F.col(f"`{vec_id}`").cast("long")
    joined = vectors.select(number.alias("vec_id")).join(out.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
