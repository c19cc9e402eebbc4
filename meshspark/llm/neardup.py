"""Near-duplicate embeddings by collision counting on one-dimensional projections."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import map_arrow, map_groups, materialize, mixed, only
from .components import connected_components
from .vectors import cosines, dtype_of, matrix, parsed

#: Projections whose windows are counted, first some and then all; rows of a block; steps of a unit; half a window in deviations.
N_PROJECTIONS, N_FIRST, BLOCK, SCALE, HALF_WINDOW = 48, 16, 4096, 2000.0, 2.0
#: Width of a cell in deviations, share of pairs at the threshold that cells or counts may miss, and how many comparisons in a cell cost what a row's travel to one more cell does (measured).
CELL, MISS, LOAD = 8.0, 1e-6, 8192
#: Projections that make a cell, to choose from.
DEPTHS = (0, 1, 2, 3, 4, 6, 8, 12, 16, 24)


def directions(dim: int, seed: int = 17) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, N_PROJECTIONS))


def n_tables(depth: int) -> int:
    """How many tables of cells all but MISS of pairs at the threshold need to share a cell in one of them."""
    if depth == 0:
        return 1
    one = math.erf(CELL / math.sqrt(2)) - 2 / (CELL * math.sqrt(2 * math.pi)) * (1 - math.exp(-CELL * CELL / 2))
    return math.ceil(math.log(MISS) / math.log(1 - one**depth))


def cell_keys(unit: np.ndarray, depth: int, tables: int, width: float) -> np.ndarray:
    """rows x tables: the cell of each vector, of `depth` sorted projections cut at equal widths from a random start."""
    out = np.repeat(np.arange(tables, dtype=np.uint64)[None], len(unit), 0) + np.uint64(unit.shape[1] << 32)
    if depth:
        rng = np.random.default_rng([23, unit.shape[1], depth])
        start = rng.uniform(0, width, (n_tables(depth), depth))[:tables]
        d = rng.standard_normal((n_tables(depth), depth, unit.shape[1]))[:tables]
        cells = np.floor((np.einsum("nd,tkd->ntk", unit, d, optimize=True) + start) / width).astype(np.int64).astype(np.uint64)
        for k in range(depth):
            out = mixed(out) + cells[:, :, k]
    return mixed(out)


def calibrated(n: int, inside: float, miss: float) -> int:
    """The largest count that a pair at the threshold reaches with probability 1 - miss: of n windows, each holds it with `inside`."""
    below = 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * inside**k * (1 - inside) ** (n - k)
        if below > miss:
            return k
    return n


class Forest:
    """Trees over positions, grown from arrays of pairs; keeps the pairs that joined trees."""

    def __init__(self, n: int):
        self.label, self.edges = np.arange(n), []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            hi, lo = np.maximum(a, b), np.minimum(a, b)
            order = np.lexsort((lo, hi))
            first = order[np.concatenate([[True], np.diff(hi[order]) != 0])]
            self.edges += zip(i[first].tolist(), j[first].tolist(), strict=True)
            to = np.arange(len(self.label))
            to[hi[first]] = lo[first]
            while (to[to] != to).any():
                to = to[to]
            self.label = to[self.label]


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector; links are cosines >= threshold.

    Equal vectors are one class. A pair at the threshold differs on a random projection of unit
    length by a normal deviate of standard deviation sqrt(2 - 2 threshold). Collisions on single
    projections would be a fixed share of all pairs, so several sorted projections are cut together:
    a table of cells has the classes that fall between the same cuts of `depth` projections, and
    there are so many tables that all but MISS of pairs at the threshold share a cell of one. The
    depth is the one with the least work for the cells' sizes as counted on the whole table; it grows
    with the logarithm of the table, and the tables with a small power of it.

    In a cell, each class's windows of HALF_WINDOW deviations are counted over projections, first
    N_FIRST, then all; the counts that pass are those that all but MISS of pairs at the threshold
    reach. Pairs that pass are verified exactly, and counted in the first table that they share. A
    cell of over BLOCK classes is cut into blocks that meet two by two. A cell yields link counts
    and a spanning forest, never its pairs.

    Vectors that are null, empty, zero or hold null or non-finite components, and vectors of other
    dimensions, link with nothing. Rows with equal ids are vectors of their own, but their component
    is their id's. A null id has null component and kept. An empty table gives no rows. Other columns
    are ignored.
    """
    dtype = dtype_of(vectors, embedding)
    base = parsed(vectors, vec_id, embedding)
    sigma = math.sqrt(2 - 2 * threshold)
    width = CELL * sigma
    inside = math.erf(HALF_WINDOW / math.sqrt(2))
    first_count, full_count = calibrated(N_FIRST, inside, MISS), calibrated(N_PROJECTIONS, inside, MISS)
    half = math.ceil(HALF_WINDOW * sigma * SCALE) + 1

    def units(column) -> np.ndarray:
        x = matrix(column, dtype)
        return x / np.sqrt((x * x).sum(1))[:, None]

    def by_dimension(batch: pa.RecordBatch, fn) -> list:
        """fn(unit vectors) for the rows of each dimension, back in their order."""
        dims, out = np.array(batch.column(batch.schema.get_field_index("dim")).to_pylist()), [None] * batch.num_rows
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            for i, x in zip(rows.tolist(), fn(units(batch.column(batch.schema.get_field_index("vec")).take(pa.array(rows)))), strict=True):
                out[i] = x
        return out

    def trials(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = by_dimension(batch, lambda x: np.hstack([cell_keys(x, d, 1, width) for d in DEPTHS]).astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.list_(pa.int64()))], ["keys"])

    classes = base.groupBy("dim", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).select("rep", F.xxhash64("dim", "vec").alias("c"), F.xxhash64(F.lit(1), "vec", "dim").alias("c2"), "dim", "vec", "n")
    classes = materialize(classes, "classes")
    cells = map_arrow(classes.select("dim", "vec"), trials, "keys array<long>", 2048).select(F.posexplode("keys").alias("d", "key")).groupBy("d", "key").count()
    loads = {r.d: r.load for r in cells.groupBy("d").agg((F.sum(F.col("count").cast("double") * F.col("count")) / F.sum("count")).alias("load")).collect()}  # a row for each of DEPTHS
    depth = min(DEPTHS, key=lambda d: n_tables(d) * (loads.get(DEPTHS.index(d), 0.0) + LOAD))
    tables = n_tables(depth)

    def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = by_dimension(batch, lambda x: cell_keys(x, depth, tables, width).astype(np.int64))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))], ["rep", "c", "keys"])

    def joined(table: pa.Table) -> pa.Table:
        key, i, j = (table.column(c)[0].as_py() for c in ("key", "i", "j"))
        home, rep, c, n = (table.column(x).to_numpy() for x in ("home", "rep", "c", "n"))
        order = np.lexsort((c, rep, home))
        home, rep, c, n = home[order], rep[order], c[order], n[order]
        x = matrix(table.column("vec"), dtype)[order]
        unit = x / np.sqrt((x * x).sum(1))[:, None]
        q = np.rint(unit @ directions(x.shape[1]) * SCALE).astype(np.int16)
        left = np.flatnonzero(home == i)
        right = left if i == j else np.flatnonzero(home == j)
        links, forest = np.zeros(len(x), np.int64), Forest(len(x))
        ql, qr = np.ascontiguousarray(q[left].T), np.ascontiguousarray(q[right].T)
        for at in range(0, len(left), 256):
            count = np.zeros((len(left[at : at + 256]), len(right)), np.int8)
            for k in range(N_FIRST):
                count += np.abs(ql[k, at : at + 256, None] - qr[k, None, :]) <= half
            a, b = np.nonzero(count >= first_count)
            a = a + at
            if i == j:
                a, b = a[a < b], b[a < b]
            for part in range(0, len(a), 1 << 16):
                u, v = left[a[part : part + (1 << 16)]], right[b[part : part + (1 << 16)]]
                passed = (np.abs(q[u] - q[v]) <= half).sum(1) >= full_count
                u, v = u[passed], v[passed]
                similar = cosines(x[u], x[v]) >= threshold
                u, v = u[similar], v[similar]
                if tables > 1 and len(u):
                    ends, at_end = np.unique(np.concatenate([u, v]), return_inverse=True)
                    shared = cell_keys(unit[ends], depth, tables, width).astype(np.int64)  # of linked rows alone
                    su, sv = shared[at_end[: len(u)]], shared[at_end[len(u) :]]
                    own = su[np.arange(len(u)), (su == sv).argmax(1)] == key
                    u, v = u[own], v[own]
                links += np.bincount(u, n[v], len(x)).astype(np.int64) + np.bincount(v, n[u], len(x)).astype(np.int64)
                forest.add(u, v)
        hit = np.flatnonzero(links)
        ends = np.array(forest.edges, np.int64).reshape(-1, 2)
        ids, codes = (np.concatenate([v[hit], v[ends[:, 0]]]) for v in (rep, c))
        counts = pa.array([*links[hit].tolist(), *[None] * len(ends)], pa.int64())
        peers = pa.array([*[None] * len(hit), *rep[ends[:, 1]].tolist()], pa.int64())
        return pa.table([pa.array(ids, pa.int64()), pa.array(codes, pa.int64()), counts, peers], names=["rep", "c", "links", "peer"])

    places = materialize(map_arrow(classes.select("rep", "c", "dim", "vec"), keyed, "rep long, c long, keys array<long>", 1024), "places")
    places = places.select("rep", "c", F.explode("keys").alias("key"))
    sizes = places.groupBy("key").count().filter("count > 1").select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    shared = places.join(sizes, "key").groupBy("rep", "c").agg(F.collect_list(F.struct("key", "blocks")).alias("in"))  # at most one for each table
    met = shared.join(classes.drop("c2"), ["rep", "c"]).select("rep", "c", "vec", "n", F.explode("in").alias("in")).select("rep", "c", "vec", "n", "in.*")
    met = met.withColumn("home", F.pmod(F.xxhash64("rep", "c"), "blocks").cast("int")).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("home", "at").alias("i"), F.greatest("home", "at").alias("j"), "home", "rep", "c", "vec", "n")
    found = materialize(map_groups(met, ["key", "i", "j"], joined, "rep long, c long, links long, peer long"), "links")
    counts = found.filter("links IS NOT NULL").groupBy("rep", "c").agg(F.sum("links").alias("links"))
    comps = connected_components(found.filter("peer IS NOT NULL"), "rep", "peer")
    rows = base.select("vec_id", F.xxhash64("dim", "vec").alias("c"), F.xxhash64(F.lit(1), "vec", "dim").alias("c2")).join(classes.select("c", "c2", "rep", "n"), ["c", "c2"]).select("vec_id", "rep", "c", "n")
    rows = rows.join(counts, ["rep", "c"], "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    linked = rows.select("vec_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rest = only(vectors, vec_id=vec_id, embedding=embedding).withColumn("vec_id", F.col("vec_id").cast("long")).filter(F.col("vec_id").isNull() | ~usable(F.col("embedding")))
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def usable(embedding):
    """Whether parsed() takes a vector, as a column."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.coalesce(embedding.isNotNull() & ~F.exists(embedding, bad) & F.exists(embedding, lambda c: c != 0), F.lit(False))
