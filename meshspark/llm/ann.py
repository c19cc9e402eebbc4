"""Approximate nearest neighbours by learned partitions."""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import discard, map_arrow, map_groups, materialize
from .vectors import cosines, dtype_of, matrix, parsed

#: Rows that a router is fitted on at most, rows of a part as aimed at, parts that one router tells apart.
SAMPLE, ROWS_PER_PART, FAN = 5000, 2048, 256
NEIGHBOURS, HIDDEN, CHUNK, AIM = 10, 64, 4096, 0.97


@dataclass
class Router:
    """A classifier of one hidden layer from a unit vector to the parts, and how many parts a query visits."""

    weights: list[np.ndarray]
    probes: int

    def scores(self, unit: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum(unit @ w1 + b1, 0) @ w2 + b2

    def best(self, x: np.ndarray, most: int) -> np.ndarray:
        """The most probable parts of each vector, best first."""
        scores = self.scores(x / np.sqrt((x * x).sum(1))[:, None])
        return np.argsort(-scores, axis=1, kind="stable")[:, :most]


def bisected(x: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Labels of equally large parts: halves along the direction of most variance, again and again."""
    label = np.zeros(len(x), np.int64)
    for _ in range(parts.bit_length() - 1):
        new = np.empty_like(label)
        for p in np.unique(label):
            rows = np.flatnonzero(label == p)
            y = x[rows] - x[rows].mean(0)
            v = rng.standard_normal(x.shape[1])
            for _ in range(20):
                v = y.T @ (y @ v)
                v /= np.linalg.norm(v) or 1.0
            rank = np.argsort(np.argsort(y @ v, kind="stable"), kind="stable")
            new[rows] = 2 * p + (rank >= len(rows) // 2)
        label = new
    return label


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 8, slack: float = 1.1) -> np.ndarray:
    """Cut the neighbour graph into parts of nearly equal size: vertices move to where most neighbours are while it has room."""
    label = bisected(x, parts, rng)
    room = np.full(parts, math.ceil(slack * len(x) / parts)) - np.bincount(label, minlength=parts)
    back = [[] for _ in range(len(x))]
    for i, row in enumerate(near.tolist()):
        for j in row:
            back[j].append(i)
    around = [np.array([*a, *b]) for a, b in zip(near.tolist(), back, strict=True)]
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(len(x)).tolist():
            votes = np.bincount(label[around[i]], minlength=parts)
            votes[room <= 0] = -1
            best, own = int(votes.argmax()), int(label[i])
            if best != own and votes[best] > np.count_nonzero(label[around[i]] == own):
                label[i], moved = best, moved + 1
                room[own] += 1
                room[best] -= 1
        if not moved:
            break
    return label


def fitted(x: np.ndarray, target: np.ndarray, rng: np.random.Generator, epochs: int = 40, batch: int = 256, rate: float = 3e-3) -> list[np.ndarray]:
    """Cross-entropy to soft targets, by Adam."""
    d, parts = x.shape[1], target.shape[1]
    w = [rng.standard_normal((d, HIDDEN)) * math.sqrt(2 / d), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) * math.sqrt(1 / HIDDEN), np.zeros(parts)]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            h = np.maximum(x[rows] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            z = np.exp(z - z.max(1, keepdims=True))
            g = (z / z.sum(1, keepdims=True) - target[rows]) / len(rows)
            gh = (g @ w[2].T) * (h > 0)
            step += 1
            for k, grad in enumerate((x[rows].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w


def learned(sample: np.ndarray, parts: int, aim: float, k: int, seed: int = 5) -> Router:
    """Fit parts and router on four fifths of the sample; the rest are queries that set the number of parts to visit."""
    rng = np.random.default_rng(seed)
    unit = sample / np.sqrt((sample * sample).sum(1))[:, None]
    held = max(1, len(unit) // 5)
    queries, x = unit[:held], unit[held:] if len(unit) > held else unit
    parts = min(parts, 1 << max(0, int(math.log2(max(1, len(x) // 8)))))
    near_k = min(NEIGHBOURS, len(x) - 1)
    if parts < 2 or near_k < 1:
        return Router([np.zeros((x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, 1)), np.zeros(1)], 1)
    sims = (x @ x.T).astype(np.float32)
    np.fill_diagonal(sims, -2)
    near = np.argpartition(-sims, near_k - 1, axis=1)[:, :near_k]
    label = balanced_parts(x, near, parts, rng)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), label), near_k)
    np.add.at(target, (np.repeat(np.arange(len(x)), near_k), label[near].ravel()), 1)
    router = Router(fitted(x, target / target.sum(1, keepdims=True), rng), parts)
    home = router.scores(x).argmax(1)
    top = np.argsort(-(queries @ x.T), axis=1)[:, :k]
    rank = np.argsort(np.argsort(-router.scores(queries), axis=1), axis=1)
    needed = np.take_along_axis(rank, home[top], axis=1)
    router.probes = next(t for t in range(1, parts + 1) if (needed < t).mean() >= aim)
    return router


def _refined(routed: DataFrame, queries: DataFrame, big: DataFrame, dtype: str, rows_per_part: int, fan: int, sample: int, aim: float, k: int) -> tuple[DataFrame, DataFrame]:
    """The big parts (part, n) cut again by routers of their own, each fitted on a bounded sample of its part."""
    keep = F.xxhash64("vec", F.lit(1)) % (1 << 40) <= (F.lit(2.0 * sample * (1 << 40)) / F.col("n"))  # about twice the sample
    some = routed.join(big, "part").filter((F.col("n") <= 4 * sample) | keep).select("part", "n", "vec")
    some = some.withColumn("_nth", F.row_number().over(W.partitionBy("part").orderBy(F.xxhash64("vec"), "vec"))).filter(F.col("_nth") <= sample).drop("_nth")

    def fit(table: pa.Table) -> pa.Table:
        n = table.column("n")[0].as_py()
        router = learned(matrix(table.column("vec"), dtype), _parts_for(n, rows_per_part, fan), aim, k)
        return pa.table([table.column("part")[:1], pa.array([pickle.dumps(router)], pa.binary())], names=["part", "router"])

    routers = materialize(map_groups(some, ["part"], fit, "part long, router binary"), "routers")
    names = {"index": ("vec", "ids"), "queries": ("vec", "query_id")}

    def again(rows: DataFrame, what: str) -> DataFrame:
        """Rows of big parts in chunks, each of which reads its part's router."""
        last = names[what][1]
        types = {f.name: f.dataType.simpleString() for f in rows.schema}
        chunks = materialize(rows.join(big.select("part"), "part").groupBy("part").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "chunks")
        cut = rows.join(chunks, "part").withColumn("chunk", F.pmod(F.xxhash64(*names[what]), "chunks").cast("int")).select("part", "chunk", *names[what])
        with_router = routers.join(chunks.select(F.col("part").alias("_p"), "chunks"), F.col("part") == F.col("_p")).drop("_p").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("part", "chunk", "router")

        def route(given: pa.Table, router: pa.Table) -> pa.Table:
            empty = pa.table([pa.array([], pa.int64()), given.column("vec")[:0], given.column(last)[:0]], names=["part", "vec", last])
            if not given.num_rows or not router.num_rows:
                return empty
            r = pickle.loads(router.column("router")[0].as_py())  # written by fit above, from numbers alone
            order = r.best(matrix(given.column("vec"), dtype), 1 if what == "index" else r.probes)
            at = np.repeat(np.arange(len(order)), order.shape[1])
            part = (given.column("part")[0].as_py() + 1) * 1000 + order.ravel()
            return pa.table([pa.array(part, pa.int64()), given.column("vec").take(pa.array(at)), given.column(last).take(pa.array(at))], names=["part", "vec", last])

        new = cut.groupBy("part", "chunk").cogroup(with_router.groupBy("part", "chunk")).applyInArrow(route, f"part long, vec binary, {last} {types[last]}")
        return materialize(rows.join(big, "part", "left_anti").select("part", *names[what]).unionByName(new), what)

    return again(routed, "index"), again(queries, "queries")


def _parts_for(n: int, rows_per_part: int, fan: int) -> int:
    return max(2, min(fan, 1 << round(math.log2(max(2, n / rows_per_part)))))


def _classes(base: DataFrame, k: int) -> DataFrame:
    """Equal vectors and their k + 1 smallest ids: vec, ids."""
    nth = F.row_number().over(W.partitionBy("vec").orderBy("vec_id"))
    least = base.select("vec", "vec_id").distinct().withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    return least.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _unrouted(base: DataFrame, dtype: str, k: int, every: int) -> tuple[DataFrame, DataFrame]:
    """Index and queries of rare dimensions: each dimension is one part."""
    dim = (F.octet_length("vec") / np.dtype(dtype).itemsize).cast("int").alias("dim")
    index = _classes(base, k).select(F.lit(0).cast("long").alias("part"), "vec", "ids", dim)
    return index, base.filter(F.col("vec_id") % every == 0).select(F.lit(0).cast("long").alias("part"), "vec", F.col("vec_id").alias("query_id"), "dim")


def _routed(base: DataFrame, dtype: str, k: int, every: int, sample: int, aim: float, rows_per_part: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """Index (part, vec, ids) and queries (part, vec, query_id) of one dimension, routed level by level."""
    classes = materialize(_classes(base, k), "classes")
    n = classes.count()
    picked = classes.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(sample).toArrow()
    router = learned(matrix(picked.column(0), dtype), _parts_for(n, rows_per_part, fan), aim, k)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(router.best(matrix(batch.column(0), dtype), 1)[:, 0], pa.int64())], ["vec", "ids", "part"])

    def visit(batch: pa.RecordBatch) -> pa.RecordBatch:
        order = router.best(matrix(batch.column(0), dtype), router.probes)
        parts = pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1, dtype=np.int32) * order.shape[1]), pa.array(order.ravel(), pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), parts], ["vec", "query_id", "parts"])

    index = materialize(map_arrow(classes, place, "vec binary, ids array<long>, part long", 4096).select("part", "vec", "ids"), "index")
    queries = base.filter(F.col("vec_id") % every == 0).select("vec", F.col("vec_id").alias("query_id"))
    queries = map_arrow(queries, visit, "vec binary, query_id long, parts array<long>", 4096).select(F.explode("parts").alias("part"), "vec", "query_id")
    queries = materialize(queries, "queries")
    largest = n
    while True:
        big = materialize(index.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") > 4 * rows_per_part), "big")
        most = big.agg(F.max("n")).first()[0]
        if most is None or most > 0.9 * largest:  # no larger part left, or routers can't tell its rows apart: chunks do the rest
            break
        largest, old = most, (index, queries)
        index, queries = _refined(index, queries, big, dtype, rows_per_part, fan, sample, aim, k)
        discard(*old)
    discard(classes)
    return index, queries


def nearest(vectors: DataFrame, *, k: int = 5, every: int = 50, sample: int = SAMPLE, aim: float = AIM, rows_per_part: int = ROWS_PER_PART, fan: int = FAN, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each vector whose id `every` divides.

    Equal vectors are one class that keeps its k + 1 smallest ids (enough for any answer). A sample
    of at most `sample` classes, the first by hash, gives a neighbour graph that is cut into balanced
    parts; a small classifier learns a vector's and its neighbours' parts. Every class is indexed in
    its most probable part. Queries visit so many of their most probable parts that held-out queries
    find `aim` of their true neighbours in the sample. One router tells at most `fan` parts apart;
    parts that are still over four times rows_per_part are cut again by routers of their own, level
    by level, so that parts don't grow with the table. Parts are searched in chunks of about CHUNK
    classes and blocks of as many queries, so no group grows with the table; each yields k candidates
    a query with exact cosines, and the best k of all are kept, ties to the smaller id.

    Vectors that are null, empty, zero or hold null or non-finite components and null ids take no
    part. Vectors are neighbours within their dimension: the commonest and all of more than four
    parts' rows have routers of their own, rarer ones are searched whole. An id with several
    rows is one candidate, at its nearest row, and one query, from all of its rows; none is a
    neighbour of its own id. An empty table gives no rows. Other columns are ignored.
    """
    dtype = dtype_of(vectors, embedding)
    base = materialize(parsed(vectors, vec_id, embedding), "vectors")
    out_schema = "query_id long, vec_id long, score double"
    by_size = base.groupBy("dim").count().orderBy(F.desc("count"), "dim")
    common = by_size.first()
    if common is None:
        return base.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Few by nature: each stands for over four parts of rows. Rarer dimensions are one part each.
    large = [common["dim"], *(r["dim"] for r in by_size.filter(F.col("count") > 4 * rows_per_part).collect() if r["dim"] != common["dim"])]
    index, queries = (materialize(t, "rare") for t in _unrouted(base.filter(~F.col("dim").isin(large)), dtype, k, every))
    for dim in large:
        more, asked = _routed(base.filter(F.col("dim") == dim), dtype, k, every, sample, aim, rows_per_part, fan)
        index, queries = index.unionByName(more.withColumn("dim", F.lit(dim))), queries.unionByName(asked.withColumn("dim", F.lit(dim)))
    # A row for each part.
    cuts = index.groupBy("dim", "part").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    blocks = queries.groupBy("dim", "part").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("blocks"))
    plan = materialize(cuts.join(blocks, ["dim", "part"]), "plan")
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    index = index.join(plan, ["dim", "part"]).select("dim", "part", F.pmod(F.xxhash64("vec"), "chunks").cast("int").alias("chunk"), all_of("blocks").alias("block"), "vec", "ids")
    queries = queries.join(plan, ["dim", "part"]).select("dim", "part", all_of("chunks").alias("chunk"), F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block"), "vec", "query_id")

    def best(asked: pa.Table, rows: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if asked.num_rows and rows.num_rows:
            q, x = matrix(asked.column("vec"), dtype), matrix(rows.column("vec"), dtype)
            ids, ask = rows.column("ids").to_pylist(), asked.column("query_id").to_pylist()
            qu, xu = (a / np.sqrt((a * a).sum(1))[:, None] for a in (q, x))
            # So many classes hold k + 1 different ids for certain, also where ids have several vectors.
            enough = k + 1 + sum(map(len, ids)) - len({v for each in ids for v in each})
            for at in range(0, len(q), 256):
                s = qu[at : at + 256] @ xu.T
                least = np.partition(s, -min(enough, s.shape[1]), axis=1)[:, -min(enough, s.shape[1])]
                a, b = np.nonzero(s >= least[:, None] - 1e-9)
                exact = cosines(q[a + at], x[b])
                each: dict[int, dict[int, float]] = {}
                for i, j, score in zip(a.tolist(), b.tolist(), exact.tolist(), strict=True):
                    mine = each.setdefault(i, {})
                    for v in ids[j]:
                        if v != ask[i + at] and score > mine.get(v, -2.0):
                            mine[v] = score
                for i, scores in each.items():
                    found += [(ask[i + at], v, -s) for s, v in sorted((-s, v) for v, s in scores.items())[:k]]
        return pa.table([pa.array([f[c] for f in found], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    keys = ["dim", "part", "chunk", "block"]
    found = queries.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInArrow(best, out_schema)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
