"""Token ids in grammar-compressed files with random access."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import holding, only

BLOCK_IDS, ROUNDS, LEAST, SYMBOLS = 1 << 20, 5, 8, 1 << 16
CACHED, CACHED_BYTES = 600_000, 1 << 26
BLOCK_SCHEMA = "shard int, block int, n_ids long, n_docs int, doc_ids binary, doc_symbols binary, rules binary, lengths binary, symbols binary"


def compress(symbols: np.ndarray, n_terminals: int, fixed: int, rounds: int = ROUNDS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Re-Pair in rounds: (symbols left, rules as pairs, rule i being the symbol n_terminals + i).

    Each round counts all neighbouring pairs and replaces the frequent ones, at least `least` times
    there, most frequent first, while symbols of 16 bits last. Overlapping pairs are taken from the
    left. Pairs that hold the symbol `fixed` (a document's end) stay, so no rule crosses documents.
    """
    rules: list[np.ndarray] = []
    made, s = 0, symbols.astype(np.uint32)
    for left in range(rounds, 0, -1):
        if len(s) < 2:
            break
        room = (SYMBOLS - n_terminals - made) // left if left > 1 else SYMBOLS - n_terminals - made
        pairs = s[:-1] << np.uint32(16) | s[1:]
        inner = (s[:-1] != fixed) & (s[1:] != fixed)
        ordered = np.sort(pairs[inner])
        if not len(ordered):
            break
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.append(starts, len(ordered)))
        often = np.flatnonzero(counts >= least)
        often = often[np.argsort(-counts[often], kind="stable")][:room]
        chosen = ordered[starts[often]]
        # A small hash table from pair to rule; of pairs that meet in a slot the most frequent goes first, others wait for the next round.
        slot = (chosen * np.uint32(2654435761)) >> np.uint32(14)
        _, first = np.unique(slot, return_index=True)
        chosen, slot = chosen[np.sort(first)], slot[np.sort(first)]
        if not len(chosen):
            break
        table, owner = np.full(1 << 18, -1, np.int32), np.zeros(1 << 18, np.uint32)
        table[slot], owner[slot] = np.arange(len(chosen)), chosen
        at = (pairs * np.uint32(2654435761)) >> np.uint32(14)
        hit = (owner[at] == pairs) & (table[at] >= 0) & inner
        where = np.flatnonzero(hit)
        run = np.concatenate([[True], np.diff(where) != 1]) if len(where) else np.empty(0, bool)
        head = np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))
        where = where[(np.arange(len(where)) - head) % 2 == 0]
        s[where] = n_terminals + made + table[at[where]]
        keep = np.ones(len(s), bool)
        keep[where + 1] = False
        s = s[keep]
        rules.append(np.stack([chosen >> np.uint32(16), chosen & np.uint32(0xFFFF)], 1))
        made += len(chosen)
    return s.astype(np.uint16), (np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)).astype(np.uint16)


def expansion_lengths(rules: np.ndarray, n_terminals: int) -> np.ndarray:
    """How many ids each symbol, terminal or rule, stands for."""
    lengths = [1] * n_terminals
    for a, b in rules.tolist():
        lengths.append(lengths[a] + lengths[b])
    return np.array(lengths, np.uint32)


class Block:
    """A block of the file: ids of whole documents in order, as symbols of one grammar."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray, n_terminals: int):
        self.symbols, self.lengths = symbols, np.concatenate([np.ones(n_terminals, np.uint32), lengths])
        self.starts = np.cumsum(self.lengths, dtype=np.int64) - self.lengths
        flat = np.empty(int(self.lengths.sum()), np.uint32)
        flat[:n_terminals] = np.arange(n_terminals)
        at = self.starts.tolist()
        size = self.lengths.tolist()
        for i, (a, b) in enumerate(rules.tolist(), n_terminals):
            to = at[i]
            flat[to : to + size[a]] = flat[at[a] : at[a] + size[a]]
            flat[to + size[a] : to + size[i]] = flat[at[b] : at[b] + size[b]]
        self.flat = flat

    def expand(self, start: int, end: int) -> np.ndarray:
        """The ids of symbols[start:end]."""
        s = self.symbols[start:end]
        n = self.lengths[s].astype(np.int64)
        to = np.cumsum(n) - n
        return self.flat[np.repeat(self.starts[s] - to, n) + np.arange(int(n.sum()))]

    def at(self, first: int, n: int) -> np.ndarray:
        """n ids from position first of the block, expanding only the symbols that hold them."""
        ends = np.cumsum(self.lengths[self.symbols], dtype=np.int64)
        a = int(np.searchsorted(ends, first, "right"))
        b = int(np.searchsorted(ends, first + n - 1, "right")) + 1 if n else a
        return self.expand(a, b)[first - (int(ends[a - 1]) if a else 0) :][:n]


#: Runs of ASCII punctuation between letters, digits and white space are pieces of their own.
_PUNCTUATION = re.compile(rb"[!-&(-/:-@\[-`{-~](?<![\x80-\xff!-/:-@\[-`{-~][!-/:-@\[-`{-~])[!-&(-/:-@\[-`{-~]*+(?![\x80-\xff'])")
#: Bytes of texts that are cut at white space alone: control bytes count as punctuation, combining marks (U+0300 to U+036F) compose, special tokens are matched before lower-casing.
_CONTROL, _OTHER = bytes([*range(9), *range(14, 32), 127]), (b"\xcc", b"\xcd", b"<|")
_JOINED = 256


class WordEncoder:
    """Ids of whole texts by a tokenizers file that lower-cases and whose tokens don't cross ASCII white space.

    Texts are cut into words, also at punctuation where that changes nothing. The distinct words of a
    batch are looked up among those kept, at most `cached` of them or CACHED_BYTES; words of
    Latin letters alone, which the tokenizer leaves whole, are encoded many in one call: a token that
    ends a word tells where each ends.
    """

    def __init__(self, path: str, cached: int = CACHED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cached = Tokenizer.from_file(path), cached
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.held = 0
        self.pool, self.sizes = np.empty(0, np.uint16), np.empty(0, np.int64)

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and how many each has."""
        plain = np.fromiter((w.isalpha() or (not w.isascii() and _latin(w.decode())) for w in words), bool, len(words))
        at = np.flatnonzero(plain)
        groups = [at[i : i + _JOINED] for i in range(0, len(at), _JOINED)]
        sizes, order, ids = np.zeros(len(words), np.int64), [], []
        alone = [np.flatnonzero(~plain)]
        for group, got in zip(groups, self._encoded([b" ".join([words[i] for i in g.tolist()]).decode() for g in groups]), strict=True):
            cuts = np.flatnonzero(self.ends[got]) + 1
            if len(cuts) == len(group):
                sizes[group] = np.diff(cuts, prepend=0)
                order.append(group)
                ids.append(got)
            else:
                alone.append(group)
        rest = np.concatenate(alone)
        for i, got in zip(rest.tolist(), self._encoded([words[i].decode() for i in rest.tolist()]), strict=True):
            sizes[i] = len(got)
            ids.append(got)
        order = np.concatenate([*order, rest])
        flat = np.concatenate([*ids, np.empty(0, np.uint16)])
        starts = np.empty(len(words), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        return flat[_ranges(starts, sizes)], sizes

    @staticmethod
    def split(text: bytes) -> bytes:
        if any(x in text for x in _OTHER) or len(text.translate(None, _CONTROL)) < len(text):
            return text
        return _PUNCTUATION.sub(rb" \g<0> ", text.lower())

    def ids(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the id end behind it, in one array, and how many each has."""
        given = pa.array([self.split(t) if t else b"" for t in texts.cast(pa.binary()).to_pylist()], pa.large_binary())
        split = pc.ascii_split_whitespace(given.view(pa.large_string()))
        flat = split.flatten().dictionary_encode()
        distinct = flat.dictionary.cast(pa.large_binary()).to_pylist()
        missing = [w for w in distinct if w not in self.index]
        if len(self.index) + len(missing) > self.cached or self.held > CACHED_BYTES:
            self._forget()
            missing = distinct
        got, sizes = self.many(missing)
        self.held += sum(map(len, missing))
        self.index.update(zip(missing, range(len(self.sizes), len(self.sizes) + len(missing)), strict=True))
        self.pool, self.sizes = np.concatenate([self.pool, got]), np.concatenate([self.sizes, sizes])
        where = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))
        starts = np.append((np.cumsum(self.sizes) - self.sizes)[where], len(self.pool))
        sizes = np.append(self.sizes[where], 1)
        ends = np.asarray(split.offsets)[1:] - split.offsets[0].as_py()
        order = np.insert(np.asarray(flat.indices).astype(np.int64), ends, len(distinct))
        n = sizes[order]
        out = np.append(self.pool, np.uint16(end))[_ranges(starts[order], n)]
        last = np.cumsum(n)[ends + np.arange(len(ends))]
        return out, np.diff(last, prepend=0)


def _latin(word: str) -> bool:
    return word.isalpha() and max(word) < "\u0250" and word.lower().isalpha()


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... of each range, one range after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_token_files(docs: DataFrame, out: str, tokenizer: str, *, n_terminals: int, end: int = 1, doc_id: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Write every document's ids, each followed by the id end, in ascending order of doc_id.

    Documents are range-partitioned by id and sorted in their shard; a shard is a sequence of blocks
    of at least block_ids ids (whole documents), each with its own Re-Pair grammar: the rules, their
    expansion lengths, the symbols left, and where each document's symbols start. The blocks are rows
    of Parquet, so any store that Spark writes to holds them and lost tasks are repeated.

    A grammar stops after ROUNDS rounds, at pairs seen under LEAST times and at symbols of 16 bits: that
    costs compression, no data. Null and empty texts have the end id only; whole texts are encoded,
    however long, and special tokens written out in a text are those tokens. Null ids come first;
    equal ids are ordered by text, and equal rows are documents of their own. Ids must be of an
    integer type. An empty table gives no blocks. n_terminals must be under 65536. Other columns are
    ignored.
    """
    d = only(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    d = d.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def block(shard: int, number: int, ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        flat = np.concatenate(parts)
        symbols, rules = compress(flat, n_terminals, end)
        ends = np.flatnonzero(symbols == end) + 1
        if len(ends) != len(parts):  # the end id is also an id of some text: count by expansion
            total = np.cumsum(expansion_lengths(rules, n_terminals)[symbols])
            ends = np.searchsorted(total, np.cumsum([len(p) for p in parts])) + 1
        lengths = expansion_lengths(rules, n_terminals)[n_terminals:]
        index = np.array([(0 if x is None else x, x is None) for x in ids], np.int64)
        row = [shard, number, len(flat), len(ids), index.tobytes(), ends.astype("<i8").tobytes(), rules.astype("<u2").tobytes(), lengths.astype("<u4").tobytes(), symbols.astype("<u2").tobytes()]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], [c.split()[0] for c in BLOCK_SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding("tokens", word_encoder.cache_clear)
        encoder, shard, number = word_encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids: list = []
        parts: list[np.ndarray] = []
        held = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                flat, sizes = encoder.ids(batch.column(1), end)
                for one, part in zip(batch.column(0).to_pylist(), np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
                    ids.append(one)
                    parts.append(part)
                    held += len(part)
                    if held >= block_ids:
                        yield block(shard, number, ids, parts)
                        ids, parts, held, number = [], [], 0, number + 1
        if ids:
            yield block(shard, number, ids, parts)

    d.mapInArrow(run, BLOCK_SCHEMA).write.parquet(out)


def read_token_files(spark: SparkSession, path: str, *, n_terminals: int) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids array<int>, in no set order.

    A row for each document written, null and repeated ids included; no blocks give no rows.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    return _documents(blocks, n_terminals, digest=False)


def digest_token_files(spark: SparkSession, path: str, *, n_terminals: int) -> DataFrame:
    """As read_token_files, with ids_crc32 (of the ids as little-endian unsigned 32-bit integers) in place of the ids."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    return _documents(blocks, n_terminals, digest=True)


def _documents(blocks: DataFrame, n_terminals: int, digest: bool) -> DataFrame:
    last = "ids_crc32 long" if digest else "ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(np.frombuffer(row["rules"], "<u2").reshape(-1, 2), np.frombuffer(row["lengths"], "<u4"), np.frombuffer(row["symbols"], "<u2"), n_terminals)
                ends = np.frombuffer(row["doc_symbols"], "<i8")
                index = np.frombuffer(row["doc_ids"], "<i8").reshape(-1, 2)
                each = [block.expand(a, b) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                n = np.array([len(x) for x in each], np.int64)
                seen = pa.array([zlib.crc32(x.astype("<u4")) for x in each], pa.int64()) if digest else pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32()))
                ids = pa.array(index[:, 0], mask=index[:, 1] == 1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(n), row["shard"], np.int32)), pa.array(np.full(len(n), row["block"], np.int32)), pa.array(np.cumsum(n) - n), pa.array(n), seen], ["doc_id", "shard", "block", "inside", "n_tokens", last.split()[0]])

    docs = blocks.select("shard", "block", "doc_ids", "doc_symbols", "rules", "lengths", "symbols").mapInArrow(run, f"doc_id long, shard int, block int, inside long, n_tokens long, {last}")
    # Offsets in two levels: over shards (one row each), then over the blocks of a shard.
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    inner = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select("shard", "block", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)).alias("block_start")).join(shards, "shard")
    docs = docs.join(starts, ["shard", "block"])
    return docs.select("doc_id", (F.col("shard_start") + F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", last.split()[0])
