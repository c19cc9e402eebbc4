"""Removal of long word passages that occur more than once, by fixed-block anchors."""

from __future__ import annotations

import hashlib
import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import mixed, only, rolling, utf8, word_hashes

#: Documents and bytes of a chunk at most (a longer document is a chunk), documents for each bucket of hashes.
WINDOW, DOCS_PER_CHUNK, BYTES_PER_CHUNK, DOCS_PER_BUCKET = 35, 1000, 1 << 22, 1000
#: A full window's two hashes, of independent multipliers: equal words are taken for granted at 96 equal bits.
PAIR = np.dtype([("a", "<u8"), ("b", "<u4")])
PACKED, FOUND = "bucket long, chunk long, n long, hashes binary, flags binary", "bucket long, chunk long, hashes binary"
AGAIN, BLOCK = 1, 2


class Chunk:
    """The words of a chunk of documents, in a fixed order, as one sequence."""

    def __init__(self, docs: pa.Table):
        ids, texts = docs.column("doc_id").to_pylist(), utf8(docs.column("text").combine_chunks())
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
        self.ids = [ids[i] for i in order]
        self.words = [texts[i].split() for i in order]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        self.n = int(self.sizes.sum())
        self.words_hashed = None

    def hashed(self) -> np.ndarray:
        if self.words_hashed is None:
            self.words_hashed = word_hashes(list(chain.from_iterable(self.words)))
        return self.words_hashed

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the k-word windows that don't cross documents, and the windows' hashes."""
        hashes = rolling(self.hashed(), k)
        inside = np.arange(len(hashes)) + k <= np.repeat(self.ends, self.sizes)[: len(hashes)]
        return np.flatnonzero(inside), hashes[inside]

    def second(self, at: np.ndarray, k: int) -> np.ndarray:
        """Another hash of the k words from each start."""
        h, out = mixed(self.hashed() + np.uint64(0x9E3779B97F4A7C15)), np.zeros(len(at), np.uint64)
        for j in range(k):
            out = out * np.uint64(0xC2B2AE3D27D4EB4F) + h[at + j]
        return mixed(out) >> np.uint64(32)

    def pairs(self, at: np.ndarray, h: np.ndarray, k: int) -> np.ndarray:
        out = np.empty(len(at), PAIR)
        out["a"], out["b"] = h, self.second(at, k)
        return out

    def offset(self, at: np.ndarray) -> np.ndarray:
        """Of words of the chunk: the position in their document."""
        return at - np.repeat(self.begins, self.sizes)[at]


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash (all bits but the lowest, which tells a block) once, rising, and its flags."""
    h = np.sort(h)
    starts = np.flatnonzero(np.concatenate([[True], h[1:] >> np.uint64(1) != h[:-1] >> np.uint64(1)])) if len(h) else np.empty(0, np.int64)
    ends = np.append(starts[1:], len(h))[: len(starts)] - 1
    return h[ends], ((ends > starts) * AGAIN + (h[ends] & np.uint64(1)).astype(np.int64) * BLOCK).astype(np.uint8)


def _packed(chunk: int, bucket: np.ndarray, hashes: np.ndarray, flags: np.ndarray) -> pa.Table:
    """A row for each bucket: the hashes and their flags."""
    order = np.argsort(bucket, kind="stable")
    bucket, hashes, flags = bucket[order], hashes[order], flags[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    rows = []
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)], strict=True):
        if a < b:
            rows.append((int(bucket[a]), chunk, b - a, hashes[a:b].tobytes(), flags[a:b].tobytes()))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["bucket", "chunk", "n", "hashes", "flags"])


def _matches(table: pa.Table, kind: np.dtype | str, blocks: bool) -> pa.Table:
    """Of a bucket's records, the hashes that occur again; with blocks, of which one is a block."""
    chunks, ns = table.column("chunk").to_pylist(), table.column("n").to_pylist()
    hashes = np.concatenate([np.frombuffer(x.as_py(), kind) for x in table.column("hashes")])
    flags = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("flags")])
    if kind == "<u4":
        order = np.sort(hashes.astype(np.uint64) << np.uint64(32) | np.arange(len(hashes), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)
        order = order.astype(np.int64)
    else:
        order = np.lexsort((hashes["b"], hashes["a"]))
    ordered = hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    counts = np.diff(np.append(starts, len(ordered)))
    any_of = np.bitwise_or.reduceat(flags[order], starts)
    good = (counts > 1) | (any_of & AGAIN > 0)
    if blocks:
        good &= any_of & BLOCK > 0
    hit = np.sort(order[np.repeat(good, counts)])
    owner = np.searchsorted(np.cumsum(ns), hit, "right")
    cuts = np.flatnonzero(np.diff(owner)) + 1
    rows = []
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(hit)], strict=True):
        if a < b:
            rows.append((table.column("bucket")[0].as_py(), chunks[int(owner[a])], hashes[hit[a:b]].tobytes()))
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.binary()])], names=["bucket", "chunk", "hashes"])


def _among_pairs(c: Chunk, at: np.ndarray, h: np.ndarray, some: np.ndarray, k: int) -> np.ndarray:
    """Of windows with hashes h, the starts of those whose pairs are in some."""
    at, h = at[(maybe := _among(h, [some["a"]]))], h[maybe]
    own = c.pairs(at, h, k)
    both = np.concatenate([np.unique(some), own])
    order = np.lexsort((np.arange(len(both)), both["b"], both["a"]))  # what is in some comes first among equals
    new = np.concatenate([[True], both[order][1:] != both[order][:-1]])
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    found = np.empty(len(both), bool)
    found[order] = first < len(both) - len(own)
    return at[found[len(both) - len(own) :]]


def _among(h: np.ndarray, some: list[np.ndarray]) -> np.ndarray:
    """Which of h are in some."""
    some = np.unique(np.concatenate(some))
    return some[np.minimum(np.searchsorted(some, h), len(some) - 1)] == h


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every document.

    A word goes if a window of `window` consecutive words covers it whose word sequence starts
    anywhere else too, in this or another document; windows are judged on the input.

    Every document's non-overlapping blocks of (window + 1) // 2 words are the index; every window
    of that length probes it. Two equal passages of `window` words hold a whole block of either, so
    each repeated window has a hit among its first starts. Around hits the passage is extended: the
    windows with a hit are counted by their full hash, and runs of repeated windows are the maximal
    repeats. Each chunk of documents sends each of its hashes once, packed by ranges of the hash,
    with flags for more than one place and for a block; it gets back which of them repeat and marks
    its own places. So a passage that a third of the documents share is one hash a chunk; no list of
    a passage's places or of pairs is made. What meets in one task for such a hash are 5 bytes (13 in
    the last round) a chunk of 1,000 documents. Blocks are found by 64-bit hashes, which only adds
    candidates; windows are equal if a 64-bit and a 32-bit hash of their words are: that any two of
    1e13 different windows are taken for equal has a chance of about 1 in 1,600.

    Whole texts count, however long. Null, empty and short texts lose nothing. Equal rows are documents of their own: each makes the
    other's windows repeat. Rows are told apart by place, so ids may be null or repeat. Kept words
    are joined by one space. An empty table gives no rows. Other columns are ignored.
    """
    return _removed(docs, window, doc_id, text, "kept_text binary", lambda kept: kept).withColumn("kept_text", F.col("kept_text").cast("string"))


def digest_repeats(docs: DataFrame, *, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """As remove_repeats, with kept_sha256, lowercase hex, in place of the kept text."""
    return _removed(docs, window, doc_id, text, "kept_sha256 string", lambda kept: hashlib.sha256(kept).hexdigest())


def _removed(docs: DataFrame, window: int, doc_id: str, text: str, last: str, of_kept) -> DataFrame:
    d = only(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    n, size = d.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_chunks, n_buckets, block = max(1, math.ceil(n / DOCS_PER_CHUNK), math.ceil(size / BYTES_PER_CHUNK)), max(8, math.ceil(n / DOCS_PER_BUCKET)), (window + 1) // 2
    d = d.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks))).repartition("chunk")
    low = np.uint64(0xFFFFFFFF)

    def bucket(h: np.ndarray) -> np.ndarray:
        return ((h & low) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)

    def short(h: np.ndarray) -> np.ndarray:
        return bucket(h).astype(np.uint64) << np.uint64(32) | h >> np.uint64(32)

    def probes(table: pa.Table) -> pa.Table:
        c = Chunk(table)
        at, h = c.windows(block)
        is_block = c.offset(at) % block == 0 if len(at) else at
        h, flags = _distinct(h & ~np.uint64(1) | is_block.astype(np.uint64))
        return _packed(table.column("chunk")[0].as_py(), bucket(h & ~np.uint64(1)), (h >> np.uint64(32)).astype("<u4"), flags)

    def hits(table: pa.Table) -> pa.Table:
        return _matches(table, "<u4", True)

    def candidates(table: pa.Table, found: pa.Table) -> pa.Table:
        if not found.num_rows or not table.num_rows:
            return _packed(0, np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint8))
        c = Chunk(table)
        at, h = c.windows(block)
        buckets = found.column("bucket").to_pylist()
        some = [np.uint64(b << 32) | np.frombuffer(x.as_py(), "<u4").astype(np.uint64) for b, x in zip(buckets, found.column("hashes"), strict=True)]
        marks = np.zeros(c.n + 1, np.int64)
        marks[at[_among(short(h & ~np.uint64(1)), some)]] = 1
        marks = np.concatenate([[0], np.cumsum(marks[:-1])])
        at, h = c.windows(window)
        near = marks[at + window - block + 1] > marks[at]
        pairs = c.pairs(at[near], h[near], window)
        pairs = pairs[np.lexsort((pairs["b"], pairs["a"]))]
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.empty(0, np.int64)
        times, pairs = np.diff(np.append(first, len(pairs))), pairs[first]
        return _packed(table.column("chunk")[0].as_py(), bucket(pairs["a"]), pairs, ((times > 1) * AGAIN).astype(np.uint8))

    def repeats(table: pa.Table) -> pa.Table:
        return _matches(table, PAIR, False)

    def kept(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary() if "binary" in last else pa.string())], names=names)
        c = Chunk(table)
        starts = np.zeros(c.n + window + 1, np.int64)
        if found.num_rows:
            at, h = c.windows(window)
            at = _among_pairs(c, at, h, np.concatenate([np.frombuffer(x.as_py(), PAIR) for x in found.column("hashes")]), window)
            starts[at] += 1
            starts[at + window] -= 1
        stays = np.cumsum(starts)[: c.n] == 0
        removed, out = [], []
        for words, a, b in zip(c.words, c.begins.tolist(), c.ends.tolist(), strict=True):
            here = stays[a:b]
            left = int(here.sum())
            removed.append(b - a - left)
            out.append(of_kept(b" ".join(words if left == b - a else [w for w, s in zip(words, here.tolist(), strict=True) if s])))
        return pa.table([pa.array(c.ids, pa.int64()), pa.array(c.sizes), pa.array(removed, pa.int64()), pa.array(out)], names=names)

    names = ["doc_id", "n_words", "n_removed", last.split()[0]]
    by_chunk = d.groupBy("chunk")
    found = by_chunk.applyInArrow(probes, PACKED).groupBy("bucket").applyInArrow(hits, FOUND)
    windows = by_chunk.cogroup(found.groupBy("chunk")).applyInArrow(candidates, PACKED)
    again = windows.groupBy("bucket").applyInArrow(repeats, FOUND)
    return by_chunk.cogroup(again.groupBy("chunk")).applyInArrow(kept, f"doc_id long, n_words long, n_removed long, {last}")
