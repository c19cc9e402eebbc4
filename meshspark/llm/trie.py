"""Prefix trie of conversations: sorted shards build its nodes, a skeleton of splitter paths holds those that shards share."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import discard, materialize, only

#: Conversations of a family share the first turns of its first one; at most SPLICE - 1 of them.
FAMILY, SPLICE = 5, 9
#: Turns aimed at for a shard; shards at most, as the skeleton has a path for each; sampled paths a shard; bytes of sampled paths on the driver; bytes of a path that may split.
SHARD, SHARDS, SAMPLES, SAMPLE_BYTES, SPLIT_BYTES = 1_000, 1 << 14, 16, 1 << 24, 1 << 20
#: Bytes of a turn's digest, the step of a path.
STEP = 32
#: Ids that one piece of a list of members spans.
SPAN_BITS = 8
EMPTY = hashlib.sha256(b"").hexdigest()

NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, digests, sizes of each conversation: 32 bytes and the text's length for every turn, in order. Texts don't move."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turns = conversations.filter(F.col("conv_id").isNotNull())
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("has"), "turn", digest.alias("digest"), F.octet_length(text).alias("size")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", F.col("t.digest").alias("digests"), F.col("t.size").alias("sizes"))


def spliced(seqs: DataFrame, family: int = FAMILY, splice: int = SPLICE) -> DataFrame:
    """conv_id, path, sizes: every conversation with its first turns taken from the first one of its family.

    Of conversation c the first h = crc32(decimal c) % splice turns are those of c - c % family (all of
    them if there are fewer, none if it isn't there), and its own after the first h follow. A family has at
    most `family` rows.
    """
    base = F.col("conv_id") - F.col("conv_id") % family
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % splice).cast("int")
    heads = seqs.filter(base == F.col("conv_id")).select(F.col("conv_id").alias("_base"), F.slice("digests", 1, splice - 1).alias("_digests"), F.slice("sizes", 1, splice - 1).alias("_sizes"))
    both = seqs.withColumn("_base", base).withColumn("_h", h).join(heads, "_base", "left")
    join = lambda head, own: F.concat(F.coalesce(F.slice(head, 1, F.col("_h")), F.slice(own, 1, 0)), F.slice(own, F.col("_h") + 1, F.size(own)))
    both = both.select("conv_id", join("_digests", "digests").alias("digests"), join("_sizes", "sizes").alias("sizes"))
    return both.select("conv_id", F.unhex(F.array_join(F.transform("digests", F.hex), "")).alias("path"), "sizes")


def members(paths: DataFrame) -> DataFrame:
    """path_id, n, first, ends_sha256 of paths(path_id, conv_id): how many end there, the smallest id, and the digest of the list of ids.

    Ids meet in pieces of 256 neighbours; a path's pieces pass through its task in order, one after the
    other, and only the state of the digest stays.
    """
    piece = F.shiftright("conv_id", SPAN_BITS).alias("piece")
    ids = F.array_sort(F.collect_list("conv_id"))
    pieces = paths.groupBy("path_id", piece).agg(ids.alias("ids"))
    pieces = pieces.select("path_id", "piece", F.size("ids").alias("n"), F.get("ids", F.lit(0)).alias("first"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("list"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, first, state = None, 0, 0, None
        for batch in batches:
            out: list[tuple] = []
            for path_id, many, low, ids in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if path_id != last:
                    if state is not None:
                        out.append((last, n, first, state.hexdigest()))
                    last, n, first, state = path_id, 0, low, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
                n += many
            if out:
                yield table(out)
        if state is not None:
            yield table([(last, n, first, state.hexdigest())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.binary(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["path_id", "n", "first", "ends_sha256"])

    return pieces.repartition("path_id").sortWithinPartitions("path_id", "piece").mapInArrow(run, "path_id binary, n long, first long, ends_sha256 string")


def shared_steps(a: bytes, b: bytes) -> int:
    """Steps that two paths share from the root on."""
    most = min(len(a), len(b)) // STEP
    if a[: most * STEP] == b[: most * STEP]:
        return most
    x, y = (np.frombuffer(p, f"V{STEP}", most) for p in (a, b))
    return int(np.argmax(x != y))


def splitters(paths: DataFrame, shard: int, most: int) -> list[bytes]:
    """Rising paths that cut the sorted paths into shards of about `shard` turns, and `most` shards.

    Taken from a sample by hash, whose bytes are bounded. A splitter is the shortest start of a sampled
    path that lies above the one before. They only balance: any choice gives the same trie.
    """
    turns, n, size = paths.filter(F.octet_length("path") <= SPLIT_BYTES).agg(F.sum(F.greatest(F.size("sizes"), F.lit(1))), F.count("*"), F.sum(F.octet_length("path"))).first()
    shards = min(most, (turns or 0) // shard + 1)
    if shards < 2:
        return []
    share = min(1.0, SAMPLES * shards / n, SAMPLE_BYTES / max(size, 1))
    drawn = paths.filter((F.octet_length("path") <= SPLIT_BYTES) & (F.pmod(F.xxhash64("path_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1))
    sample = sorted((bytes(p), k) for p, k in drawn.select("path", F.greatest(F.size("sizes"), F.lit(1))).collect())
    step, seen, out = sum(k for _, k in sample) / shards, 0, []
    for (before, k), (path, _) in zip(sample, sample[1:], strict=False):
        seen += k
        if seen >= step * (len(out) + 1):
            out.append(path[: (shared_steps(before, path) + 1) * STEP])
    return sorted({*out})


def skeleton_of(splits: list[bytes]) -> dict[bytes, int]:
    """Numbers of the nodes on splitter paths, the root (0) among them; parents come before their children."""
    found: dict[bytes, int] = {b"": 0}
    for path in splits:
        for at in range(STEP, len(path) + 1, STEP):
            found.setdefault(path[:at], len(found))
    return found


class _Node:
    """A node on the path that is read: what is known of it so far. done: its finished children, which wait for its smallest member."""

    __slots__ = ("children", "done", "ends", "first", "leaves", "n", "saved", "size", "skeleton")

    def __init__(self, size: int, skeleton: int | None):
        self.size, self.skeleton = size, skeleton
        self.n = self.children = self.leaves = self.saved = 0
        self.first: int | None = None
        self.ends: str = EMPTY
        self.done: list[tuple] = []


class Builder:
    """Nodes from rising distinct paths.

    A node that is no start of a splitter has all its paths in one shard and is finished there. What a
    shard knows of a skeleton node leaves as a partial row: members, smallest one, children outside of
    the skeleton, and leaves and savings of what is below, without the skeleton's own. Held are the nodes
    of one path and the finished children of those.
    """

    def __init__(self, skeleton: dict[bytes, int]):
        self.skeleton, self.rows = skeleton, []
        self.last, self.open = b"", [_Node(0, 0)]

    def add(self, path: bytes, sizes: list[int], n: int, first: int, ends: str) -> None:
        shared = shared_steps(self.last, path)
        self.close(shared)
        # below the last skeleton node of a path there is none
        inside = self.open[-1].skeleton is not None
        for d in range(shared, len(path) // STEP):
            number = self.skeleton.get(path[: (d + 1) * STEP]) if inside else None
            inside = number is not None
            self.open.append(_Node(sizes[d], number))
        self.last = path
        top = self.open[-1]
        top.n, top.first, top.ends = n, first, ends

    def close(self, depth: int) -> None:
        """Finish the open nodes below a depth, deepest first."""
        while len(self.open) > depth + 1:
            node, at = self.open.pop(), len(self.open)
            parent = self.open[-1]
            parent.n += node.n
            parent.first = node.first if parent.first is None else min(parent.first, node.first)
            if node.skeleton is not None:
                self.part(node, at)
                continue
            leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.size
            self.rows += [(*row, node.first, None, None, None) for row in node.done]
            row = (node.first, at, node.n, node.children, leaves, saved, node.ends)
            if parent.skeleton is None:
                parent.done.append(row)
            else:
                self.rows.append((*row, None, parent.skeleton, None, None))
            parent.children += 1
            parent.leaves += leaves
            parent.saved += saved

    def part(self, node: _Node, depth: int) -> None:
        self.rows.append((node.first, depth, node.n, node.children, node.leaves, node.saved, node.ends, None, None, node.skeleton, node.size))

    def finish(self) -> None:
        self.close(0)
        self.part(self.open.pop(), 0)


BUILT = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, parent_conv_id long, parent_skeleton long, skeleton long, size long"


def built_nodes(paths: DataFrame, splits: list[bytes], skeleton: dict[bytes, int]) -> DataFrame:
    """Finished nodes and the skeleton's partial rows, from paths(path, sizes, n, first, ends_sha256), each path once."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_right(splits, p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], [*batch.schema.names, "shard"])

    names = [x.split()[0] for x in BUILT.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in BUILT.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder, last = None, None
        for batch in batches:
            for at, path, sizes, n, first, ends in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "sizes", "n", "first", "ends_sha256")), strict=True):
                if at != last:
                    if builder is not None:
                        builder.finish()
                        yield table(builder.rows)
                    builder, last = Builder(skeleton), at
                builder.add(path, sizes, n, first, ends)
                if len(builder.rows) > 10_000:
                    yield table(builder.rows)
                    builder.rows = []
        if builder is not None:
            builder.finish()
            yield table(builder.rows)

    dealt = paths.mapInArrow(shard, "path binary, sizes array<int>, n long, first long, ends_sha256 string, shard int")
    return dealt.repartition(len(splits) + 1, "shard").sortWithinPartitions("shard", "path").mapInArrow(build, BUILT)


def skeleton_rows(parts: dict[int, tuple], skeleton: dict[bytes, int]) -> list[tuple]:
    """(number, *a node) of each skeleton node, from its summed parts (first, n, children, leaves, saved, ends, size); children before parents."""
    up = {number: skeleton[path[:-STEP]] for path, number in skeleton.items() if path}
    depth = {number: len(path) // STEP for path, number in skeleton.items()}
    total = {k: list(parts[k]) for k in skeleton.values() if k in parts}
    for k in sorted(total, reverse=True):
        first, n, children, leaves, saved, ends, size = total[k]
        total[k] = [first, n, children, leaves or (not children), saved + (n - 1) * size, ends, size]
        if k:
            above = total[up[k]]
            above[2], above[3], above[4] = above[2] + 1, above[3] + total[k][3], above[4] + total[k][4]
    return [(k, first, depth[k], total[up[k]][0] if k else None, n, children, int(leaves), saved, ends) for k, (first, n, children, leaves, saved, ends, _) in total.items()]


def prefix_trie(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", family: int = FAMILY, splice: int = SPLICE, shard: int = SHARD, shards: int = SHARDS) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations: each distinct start (role, text) of any, from the textless root.

    Turns become digests of 32 bytes, so paths are byte strings whose order keeps equal starts
    together. Equal conversations count once, with their number and smallest id. Splitters cut the sorted paths
    into shards; the trie of their paths, the skeleton, is broadcast. A shard finishes every node outside of
    it by itself; skeleton nodes are summed over shards by an aggregation, and their few rows are
    put together on the driver: at most `shards` splitters, each as long as its start in common with the
    path sampled before it, and one step.

    Nulls: turns without a conv_id belong to no conversation and are left out; a null turn comes first; a null
    role or text is an empty one. Turns with equal numbers are ordered by the digest of role and text. An
    empty table has no nodes. Other columns are ignored. A conversation's path (32 bytes a turn) is
    one record. Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.
    """
    turns = only(conversations, conv_id=conv_id, turn=turn, role=role, text=text)
    seqs = materialize(sequences(turns), "sequences")
    path_id = F.unhex(F.sha2("path", 256)).alias("path_id")
    rebuilt = materialize(spliced(seqs, family, splice).select("conv_id", path_id, "path", "sizes"), "rebuilt")
    discard(seqs)
    distinct = rebuilt.groupBy("path_id").agg(F.first("path").alias("path"), F.first("sizes").alias("sizes"))
    paths = materialize(distinct.join(members(rebuilt.select("path_id", "conv_id")), "path_id"), "paths")
    discard(rebuilt)
    splits = splitters(paths, shard, shards)
    skeleton = skeleton_of(splits)
    built = materialize(built_nodes(paths.select("path", "sizes", "n", "first", "ends_sha256"), splits, skeleton), "nodes")
    discard(paths)

    sums: list[Column] = [F.min("conv_id"), F.sum("n_convs"), F.sum("n_children"), F.sum("n_leaves"), F.sum("saved_tokens"), F.max(F.when(F.col("ends_sha256") != EMPTY, F.col("ends_sha256"))), F.max("size")]
    parts = {k: (*row[:5], row[5] or EMPTY, row[6]) for k, *row in built.filter("skeleton IS NOT NULL").groupBy("skeleton").agg(*sums).collect()}  # a row for each node of the skeleton
    top = conversations.sparkSession.createDataFrame(skeleton_rows(parts, skeleton), f"parent_skeleton long, {NODES}")
    names = [x.split()[0] for x in NODES.split(", ")]
    above = top.select("parent_skeleton", F.col("conv_id").alias("_above"))
    low = built.filter("skeleton IS NULL").join(F.broadcast(above), "parent_skeleton", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_above"))
    return low.select(names).unionByName(top.select(names))
