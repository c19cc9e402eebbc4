"""Similarity self-join on sets of word n-grams, by signature trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, holding, map_arrow, materialize, mixed, only, rolling, utf8, word_hashes
from .components import connected_components

#: A set has N_BANDS keys, each of BAND minimal hashes; sets that share a key meet below one node.
N_BANDS, BAND = 32, 3
BLOCK, LEAF, FAN = 1024, 16, 8
#: Sets of at most so many classes are fetched by a broadcast of their ids (8 bytes each), of more by a shuffle.
FEW = 1_000_000
_MINIMA = mixed(np.arange(1, N_BANDS * BAND + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-word shingles; with fewer words, of all of them."""
    words = text.lower().split()  # of bytes: A-Z only
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    return np.unique(rolling(h, n) if len(h) >= n else rolling(h, len(h)) ^ np.uint64(len(h)))


def band_keys(each: list[np.ndarray]) -> np.ndarray:
    """sets x N_BANDS keys: sets of similarity s share one of them with 1 - (1 - s^BAND)^N_BANDS."""
    lengths = np.array([len(s) for s in each])
    out = np.zeros((len(each), N_BANDS), np.uint64)
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    flat, starts = np.concatenate(each), (np.cumsum(lengths) - lengths)[full]
    for k in range(N_BANDS):
        key = np.full(len(full), k, np.uint64)
        for m in _MINIMA[k * BAND : (k + 1) * BAND]:
            key = mixed(key) + np.minimum.reduceat(flat * m, starts)
        out[full, k] = mixed(key)
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """A bitmap of a set, as bytes: four to eight bits an element, a power of two, at least 64."""
    width = max(64, 1 << (4 * len(s) - 1).bit_length()) if len(s) else 64
    bits = np.zeros(width, bool)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits)


def _xor(s: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(s)) if len(s) else 0


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).astype(np.int64))


class Tree:
    """Sets with bitmaps of one width, like ones together in leaves; a node has the OR of its bitmaps, its range of sizes, and by how much a set of it exceeds its bits at most."""

    def __init__(self, members: np.ndarray, size: np.ndarray, maps: np.ndarray):
        # Neighbours in this order have the same first bits under two fixed orders of some columns.
        order = np.arange(len(members))
        if len(members) > LEAF:
            some = np.unpackbits(maps[:, :64].view(np.uint8), axis=1)
            rng = np.random.default_rng(some.shape[1])
            firsts = [some[:, rng.permutation(some.shape[1])].argmax(1) for _ in range(2)]
            order = np.lexsort((size, firsts[1], firsts[0]))
        self.members, self.size, self.maps = members[order], size[order], maps[order]
        self._grow()

    def _grow(self) -> None:
        self.excess = self.size - np.bitwise_count(self.maps).sum(1, dtype=np.int64)
        starts = np.arange(0, len(self.members), LEAF)
        level = (np.bitwise_or.reduceat(self.maps, starts), np.minimum.reduceat(self.size, starts), np.maximum.reduceat(self.size, starts), np.maximum.reduceat(self.excess, starts))
        self.levels = [level]
        while len(level[0]) > 1:
            starts = np.arange(0, len(level[0]), FAN)
            level = tuple(f.reduceat(x, starts) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.maximum), level, strict=True))
            self.levels.append(level)

    def folded(self) -> Tree:
        """The same members under bitmaps half as wide."""
        out = object.__new__(Tree)
        half = self.maps.shape[1] // 2
        out.members, out.size, out.maps = self.members, self.size, self.maps[:, :half] | self.maps[:, half:]
        out._grow()
        return out

    def leaf(self, i: int) -> slice:
        return slice(i * LEAF, (i + 1) * LEAF)


def _possible(common: np.ndarray, excess_a: np.ndarray, excess_b: np.ndarray, lo_a: np.ndarray, lo_b: np.ndarray, hi_a: np.ndarray, hi_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets below two nodes may be similar.

    Elements that two sets share have their bits in both bitmaps; so at most as many as the common
    bits and what the smaller excess of elements over bits adds. The union is at least the larger
    set, and both less what is shared.
    """
    most = np.minimum(common + np.minimum(excess_a, excess_b), np.minimum(hi_a, hi_b))
    return 100 * most >= percent * np.maximum(np.maximum(lo_a, lo_b), lo_a + lo_b - most)


def leaf_pairs(a: Tree, b: Tree, percent: int) -> list[tuple[int, int]]:
    """Pairs of leaves that may hold similar sets: both trees are descended together, and pairs of nodes without a possible pair are left out."""
    top = max(len(a.levels), len(b.levels)) - 1
    i = j = np.zeros(1, np.int64)
    for depth in range(top, -1, -1):
        at = [t.levels[min(depth, len(t.levels) - 1)] for t in (a, b)]
        kept = []
        for part in range(0, len(i), 4096):
            p, q = i[part : part + 4096], j[part : part + 4096]
            common = np.zeros(len(p), np.int64)
            for word in range(0, at[0][0].shape[1], 64):
                common += np.bitwise_count(at[0][0][p, word : word + 64] & at[1][0][q, word : word + 64]).sum(1, dtype=np.int64)
            kept.append(_possible(common, at[0][3][p], at[1][3][q], at[0][1][p], at[1][1][q], at[0][2][p], at[1][2][q], percent))
        good = np.concatenate(kept) if kept else np.empty(0, bool)
        i, j = i[good], j[good]
        if depth == 0 or not len(i):
            break
        kids = [(n[:, None] * FAN + np.arange(FAN) if depth < len(t.levels) else n[:, None], len(t.levels[depth - 1][0]) if depth < len(t.levels) else len(t.levels[-1][0])) for t, n in ((a, i), (b, j))]
        (x, nx), (y, ny) = kids
        i, j = (np.broadcast_to(v, (len(x), x.shape[1], y.shape[1])).ravel() for v in (x[:, :, None], y[:, None, :]))
        inside = (i < nx) & (j < ny) if a is not b else (i < nx) & (j < ny) & (i <= j)
        i, j = i[inside], j[inside]
    return sorted(zip(i.tolist(), j.tolist(), strict=True), key=lambda p: p[1] - p[0])


def each_near(size: np.ndarray, maps: list[np.ndarray], percent: int, visit: Callable[[np.ndarray, np.ndarray, np.ndarray], None], skip: Callable[[np.ndarray, np.ndarray], bool]) -> None:
    """Call visit(x, y, near) for leaves of sets that may be similar: positions and the matrix of possible pairs.

    Sets with bitmaps of one width make a tree; it is joined with itself and, folded, with the next
    narrower one, as similar sets differ in size by less than two times.
    """
    widths = np.array([len(m) for m in maps])
    trees = {}
    for w in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == w)
        trees[w] = Tree(rows, size[rows], np.stack([maps[r] for r in rows]))
    joins = [(t, t) for t in trees.values()] + [(t, trees[2 * w].folded()) for w, t in trees.items() if 2 * w in trees]
    for a, b in joins:
        for i, j in leaf_pairs(a, b, percent):
            u, v = a.leaf(i), b.leaf(j)
            x, y = a.members[u], b.members[v]
            if skip(x, y):
                continue
            common = np.zeros((len(x), len(y)), np.int64)
            for word in range(0, a.maps.shape[1], 256):
                common += np.bitwise_count(a.maps[u, None, word : word + 256] & b.maps[None, v, word : word + 256]).sum(-1, dtype=np.int64)
            sx, sy = a.size[u][:, None], b.size[v][None, :]
            near = _possible(common, a.excess[u][:, None], b.excess[v][None, :], sx, sy, sx, sy, percent)
            if a is b and i == j:
                near = np.triu(near, 1)
            if near.any():
                visit(x, y, near)


def similar_forest(sets: list[np.ndarray], label: np.ndarray, percent: int, wanted: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of positions that link what is similar and not united by label yet: a forest, never all pairs."""
    label, edges = label.copy(), []
    size = np.array([len(s) for s in sets], np.int64)

    def visit(x: np.ndarray, y: np.ndarray, near: np.ndarray) -> None:
        near &= label[x][:, None] != label[y][None, :]
        if wanted is not None:
            near &= wanted[x][:, None] | wanted[y][None, :]
        for i, j in zip(*np.nonzero(near), strict=True):
            p, q = int(x[i]), int(y[j])
            if label[p] != label[q]:
                s, t = sets[p], sets[q]
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    edges.append((p, q))
                    label[label == label[q]] = label[p]

    def united(x: np.ndarray, y: np.ndarray) -> bool:
        return bool((label[x] == label[x[0]]).all() and (label[y] == label[x[0]]).all())

    each_near(size, [signature(s).view(np.uint64) for s in sets], percent, visit, united)
    return edges


def may_link(size: np.ndarray, maps: list[np.ndarray], label: np.ndarray, percent: int, wanted: np.ndarray) -> np.ndarray:
    """Which positions may have a similar set of another label, by bitmaps alone."""
    out = np.zeros(len(size), bool)

    def visit(x: np.ndarray, y: np.ndarray, near: np.ndarray) -> None:
        near &= (label[x][:, None] != label[y][None, :]) & (wanted[x][:, None] | wanted[y][None, :])
        out[x[near.any(1)]] = True
        out[y[near.any(0)]] = True

    def idle(x: np.ndarray, y: np.ndarray) -> bool:
        return not (wanted[x].any() or wanted[y].any()) or bool((label[x] == label[x[0]]).all() and (label[y] == label[x[0]]).all())

    each_near(size, maps, percent, visit, idle)
    return out


def _by_group(rows: DataFrame, done: Callable[[list], list[tuple]], names: list[str], schema: str) -> DataFrame:
    """done on the rows of each (gid, block), a partition's groups one after the other."""
    rows = rows.repartition("gid", "block").sortWithinPartitions("gid", "block", "rep")

    def table(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(_TYPES[c.split()[1]] for c in schema.split(", "))], [c.split()[0] for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        place = None
        for batch in batches:
            found: list = []
            for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names), strict=True):
                if row[:2] != place:
                    if len(held) > 1:
                        found += done(held)
                    held, place = [], row[:2]
                held.append(row)
            if found:
                yield table(found)
        yield table(done(held) if len(held) > 1 else [])

    return rows.mapInArrow(run, schema)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def _fetched(places: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """The places with their sets: a text is read once, however many places its set has."""
    wanted = places.groupBy("rep").agg(F.collect_list(F.struct("gid", "block", "h1", "comp", "query")).alias("places"))  # at most a few for each key of a class
    if places.count() <= FEW:
        texts = texts.join(F.broadcast(places.select("rep").distinct()), "rep", "left_semi")

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        holding("jaccard")
        each = [shingle_set(t, n) for t in utf8(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in each], pa.binary()), _signed([_xor(s) for s in each]), batch.column(2)], ["rep", "shingles", "own", "places"])

    placed = wanted.join(texts, "rep").select("rep", "text", "places")
    placed = map_arrow(placed, sets, "rep long, shingles binary, own long, places array<struct<gid:long,block:int,h1:long,comp:long,query:boolean>>", 256)
    rows = placed.select("rep", "own", "shingles", F.explode("places").alias("p")).filter("own = p.h1")
    return rows.select("p.gid", "p.block", "rep", "p.comp", "p.query", "shingles")


def _joined(places: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Edges (a, b) that unite the similar sets of each place. places: gid, block, rep, h1, comp, query."""

    def done(held: list) -> list[tuple[int, int]]:
        sets = [np.frombuffer(r[5], np.uint64) for r in held]
        label = np.unique([r[3] for r in held], return_inverse=True)[1]
        return [(held[i][2], held[j][2]) for i, j in similar_forest(sets, label, percent, np.array([r[4] for r in held], bool))]

    return _by_group(_fetched(places, texts, n), done, ["gid", "block", "rep", "comp", "query", "shingles"], "a long, b long")


def _screened(places: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The rows of places that may have a partner there, by bitmaps and sizes."""
    rows = places.join(classes.select(F.col("class_id").alias("rep"), "h1", F.col("n_shingles").alias("size"), "map"), ["rep", "h1"])
    names = ["gid", "block", "rep", "h1", "comp", "query", "size", "map"]

    def done(held: list) -> list[tuple]:
        size = np.array([r[6] for r in held], np.int64)
        maps = [np.frombuffer(r[7], np.uint64) for r in held]
        label = np.unique([r[4] for r in held], return_inverse=True)[1]
        flags = may_link(size, maps, label, percent, np.array([r[5] for r in held], bool))
        return [r[:6] for r, f in zip(held, flags.tolist(), strict=True) if f]

    return _by_group(rows.select(*names), done, names, "gid long, block int, rep long, h1 long, comp long, query boolean")


def _members(places: DataFrame, *counted: str) -> DataFrame:
    """gid, n and counted sums of groups of two or more, one for each set of members. The members of a group enter as sums of their hashes."""
    who = F.xxhash64("rep", "h1")
    sums = [F.sum(F.col(c).cast("long")).alias(c) for c in counted]
    marks = places.groupBy("gid").agg(F.count("*").alias("n"), F.bit_xor(who).alias("x"), F.sum(F.xxhash64(who, F.lit(1)).cast("decimal(38,0)")).alias("s"), *sums).filter("n > 1")
    return marks.groupBy("n", "x", "s").agg(F.min("gid").alias("gid"), *(F.max(c).alias(c) for c in counted)).select("gid", "n", *counted)


def _parted(wide: DataFrame, classes: DataFrame) -> DataFrame:
    """Subgroups of the groups (gid, rep, h1, comp, query): members that share a second key, and a query."""
    keyed = classes.select(F.col("class_id").alias("rep"), "h1", F.posexplode("bands").alias("k", "key"))
    placed = wide.join(keyed, ["rep", "h1"]).filter(F.col("gid") != F.xxhash64("k", "key"))
    placed = materialize(placed.withColumn("gid", F.xxhash64("gid", "k", "key")).drop("k", "key"), "parts")
    return placed.join(_members(placed, "query").filter("query > 0").withColumnRenamed("query", "q"), "gid")


def _left_over(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """Where the members outside their group's largest component meet the group: gid, block, rep, h1, comp, query.

    A place is two blocks of the group, or one of these members and one of the group, whichever moves
    fewer sets; it never holds more than two blocks.
    """
    blocks, rests = (F.ceil(F.col(c) / BLOCK).cast("long") for c in ("n", "q"))
    aside, paired = rests * F.col("n") + blocks * F.col("q"), F.greatest(blocks - 1, F.lit(1)) * F.col("n")
    met = groups.withColumn("query", F.col("comp") != F.col("most")).select("gid", "n", "q", "rep", "h1", "comp", "query")
    wide = F.least(aside, paired) > N_BANDS * F.col("n")
    if not met.filter(wide).isEmpty():
        parted = _parted(met.filter(wide).drop("n", "q"), classes)
        met = materialize(met.filter(~wide).unionByName(parted), "parted")
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), count - 1))
    one = lambda seed, count: F.pmod(F.xxhash64("rep", F.lit(seed)), count)
    met = met.withColumn("_own", one(2, blocks)).withColumn("_paired", paired <= aside)
    pairs = met.filter("_paired").withColumn("_at", every(blocks)).filter((F.col("_at") != F.col("_own")) | (blocks == 1))
    pairs = pairs.withColumn("block", F.least("_own", "_at") * blocks + F.greatest("_own", "_at"))
    apart = met.filter("NOT _paired")
    whole = apart.withColumn("_at", every(rests)).withColumn("block", F.col("_at") * blocks + F.col("_own")).withColumn("query", F.lit(False))
    asked = apart.filter("query").withColumn("_at", every(blocks)).withColumn("block", one(3, rests) * blocks + F.col("_at"))
    aside_places = whole.unionByName(asked).groupBy("gid", "_at", "block", "rep", "h1", "comp").agg(F.max("query").alias("query"))
    names = ["gid", F.col("block").cast("int").alias("block"), "rep", "h1", "comp", "query"]
    return pairs.select(*names).unionByName(aside_places.select(*names))


def jaccard_components(docs: DataFrame, *, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id, component_id of every document.

    Documents link when 100 * intersection >= percent * union of their sets of n-word shingles
    (A-Z lower-cased, words between ASCII white space; fewer words than n: the whole sequence).
    percent is 50 to 100. Shingles are compared by 64-bit hashes: two sets are misjudged only if
    hashes of these two collide.

    Equal sets are one class, its smallest doc_id the representative. The upper nodes of the tree are
    distributed: a node holds the sets that share one of N_BANDS keys of BAND minimal hashes. A link
    at similarity s is in no node with (1 - s^BAND)^N_BANDS: 1e-10 at 0.8, 6e-14 at 0.85. Nodes with
    the same members are joined once. Below, sets are leaves of a signature tree whose nodes hold the
    OR of their bitmaps and the range of their sizes; pairs of nodes are descended together and left
    out when no pair of sets below can overlap enough. What remains is compared exactly.

    First each set goes, whole, to its two largest nodes, which unites most copies. Then only nodes
    with more than one component count, and only bitmaps travel, a tenth of a set's size; whole sets
    follow for the members that the trees found a possible partner for. A node of over BLOCK members
    is cut into blocks by a hash of the id: what its largest component has not absorbed meets every
    block, no place holding more than two blocks, so that no link between components is lost. A node
    whose members would meet over N_BANDS blocks (very many unlike documents with one passage in
    common) is parted by a second key, at the same chance of a miss again. The result is a spanning
    forest of the links, never all pairs.

    Null, empty and wordless texts have no shingles and link with nothing; n_shingles is 0. Whole
    texts count, however long. Rows with equal ids are documents of their own, each in the class of
    its set. A null id gets a null class and component. An empty table gives no rows. Other columns
    are ignored.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    d = only(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        holding("jaccard")
        each = [shingle_set(t, n) for t in utf8(batch.column(1))]
        two = [int(mixed(s).sum(dtype=np.uint64)) for s in each]
        keys = band_keys(each).astype(np.int64)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(each) + 1, dtype=np.int32) * N_BANDS), pa.array(keys.ravel()))
        maps = pa.array([signature(s).tobytes() for s in each], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in each], pa.int64()), _signed([_xor(s) for s in each]), _signed(two), flat, maps], ["doc_id", "n_shingles", "h1", "h2", "bands", "map"])

    sets = materialize(map_arrow(d, digest, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, map binary", 256), "sets")
    whole = sets.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = whole.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("class_id"), F.first("bands").alias("bands"), F.first("map").alias("map"))
    classes = materialize(classes, "classes")

    keyed = classes.select(F.col("class_id").alias("rep"), "h1", F.posexplode("bands").alias("k", "key")).select("rep", "h1", F.xxhash64("k", "key").alias("gid"))
    groups = materialize(keyed.join(_members(keyed), "gid").select("gid", "n", "rep", "h1"), "groups")

    texts = d.select(F.col("doc_id").alias("rep"), "text")
    block = F.pmod(F.xxhash64("rep", F.lit(2)), F.ceil(F.col("g.n") / BLOCK).cast("long")).cast("int")
    largest = groups.groupBy("rep", "h1").agg(F.sort_array(F.collect_list(F.struct("n", "gid")), asc=False).alias("gs"))  # at most N_BANDS for each class
    first = largest.select("rep", "h1", F.explode(F.slice("gs", 1, 2)).alias("g"))
    first = materialize(first.select("g.gid", block.alias("block"), "rep", "h1", F.col("rep").alias("comp"), F.lit(True).alias("query")), "first")
    edges = materialize(_joined(first, texts, n, percent), "links")
    comps = materialize(connected_components(edges), "components")

    known = groups.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("gid", "rep", "h1", F.coalesce("component", "rep").alias("comp"))
    known = materialize(known, "known")
    parts = known.groupBy("gid", "comp").agg(F.count("*").alias("c")).groupBy("gid")
    parts = parts.agg(F.max_by("comp", F.struct("c", "comp")).alias("most"), F.sum("c").alias("n"), (F.sum("c") - F.max("c")).alias("q")).filter("q > 0")
    second = _left_over(known.join(parts, "gid"), classes)
    flagged = materialize(_screened(second, classes, percent), "flagged")
    more = materialize(_joined(flagged, texts, n, percent), "links")
    discard(groups, first, known, flagged, comps)
    comps = materialize(connected_components(edges.unionByName(more)), "components")
    discard(edges, more)

    out = sets.select("doc_id", "n_shingles", "h1", "h2").join(classes.select("n_shingles", "h1", "h2", "class_id"), ["n_shingles", "h1", "h2"], "left")
    out = out.withColumn("class_id", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("class_id")).otherwise(F.col("doc_id")))
    out = out.join(comps.withColumnRenamed("id", "class_id"), "class_id", "left")
    return out.select("doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that represent their component (its smallest id); all columns stay.

    Rows with equal ids stay or go together: they go if any of them is in the group of a smaller id.
    Documents with null ids and those without words stay; an empty table stays empty.
    """
    found = jaccard_components(docs, doc_id=doc_id, text=text, **options)
    gone = materialize(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(gone, docs[doc_id] == gone["_gone"], "left_anti")
