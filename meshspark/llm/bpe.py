"""Byte-level BPE by prefix dynamic programming."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Recent, holding, map_arrow, only

CACHED = 150_000


class PrefixEncoder:
    """Ids of byte strings under merge ranks, from the last token of every prefix.

    Each prefix of a piece has one valid encoding, and so one valid last token: the one token that
    ends there and may follow the last token of the prefix before it. Whether a token may follow
    another is decided by undoing merges on both sides of the seam: no earlier merge across it.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.bytes[r] = b
        self.left, self.right = list(range(len(self.bytes))), list(range(len(self.bytes)))
        self.tails: dict[bytes, int] = {}  # every suffix of a usable token: its own id, or -1
        for b, r in sorted(ranks.items(), key=lambda x: x[1]):
            if len(b) > 1:
                split = self._halves(b, r)
                if split is None:
                    continue  # no merges lead to it: only a whole piece can be this token
                self.left[r], self.right[r] = split
            for i in range(1, len(b)):
                self.tails.setdefault(b[i:], -1)
            self.tails[b] = r
        self.longest = max(map(len, self.tails))
        self.follows: dict[int, bool] = {}

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one last."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min(((self.ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1)), default=(rank, 0))
            if best >= rank:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def may_follow(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > 2_000_000:
                self.follows.clear()
            known = self.follows[key] = self._may_follow(a, b)
        return known

    def _may_follow(self, a: int, b: int) -> bool:
        limit = 1 << 60
        while True:
            across = self.ranks.get(self.bytes[a] + self.bytes[b])
            if across is not None and across < limit:
                return False
            # Undo the later merge of the two; of equal ones the right one was made last.
            if a > b:
                limit, down = a, self.right[a]
                if down != a:
                    a = down
                    continue
                limit, down = b + 1, self.left[b]
                if down == b:
                    return True
                b = down
            else:
                limit, down = b + 1, self.left[b]
                if down != b:
                    b = down
                    continue
                limit, down = a, self.right[a]
                if down == a:
                    return True
                a = down

    def extend(self, piece: bytes, last: list[int], upto: int | None = None) -> list[int]:
        """Continue last, the last tokens of piece's first prefixes, to all of them (in place)."""
        tail, follows, may_follow = self.tails.get, self.follows.get, self.may_follow
        for end in range(len(last) + 1, (len(piece) if upto is None else upto) + 1):
            found, start = -1, end - 1
            while start >= 0 and (token := tail(piece[start:end])) is not None:
                if token >= 0:
                    if start == 0:
                        found = token
                    elif (before := last[start - 1]) >= 0:
                        good = follows(before << 32 | token)
                        if good or (good is None and may_follow(before, token)):
                            found = token
                            break
                start -= 1
            last.append(found)
        return last

    def tokens(self, piece: bytes, last: list[int]) -> list[int]:
        """The ids of a piece, read backwards from its prefixes' last tokens."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        out, at = [], len(piece)
        while at:
            out.append(last[at - 1])
            at -= len(self.bytes[last[at - 1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.tokens(piece, self.extend(piece, []))

    def edited(self, piece: bytes, last: list[int], at: int, removed: int, added: bytes) -> tuple[bytes, list[int]]:
        """The piece with piece[at:at+removed] replaced, and its prefixes' last tokens.

        Prefixes before the edit keep theirs. After it, they are computed anew only until as many
        in a row as the longest token has bytes agree with the old ones: the rest then does too.
        """
        new, fresh = piece[:at] + added + piece[at + removed :], last[:at]
        shift, same = len(added) - removed, 0
        for end in range(at + 1, len(new) + 1):
            self.extend(new, fresh, end)
            old = end - shift
            same = same + 1 if end > at + len(added) and 0 < old <= len(last) and last[old - 1] == fresh[-1] else 0
            if same >= self.longest:
                fresh += last[old:]
                break
        return new, fresh

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


#: One space at most, then what isn't white space; a run of white space before a word leaves its last character to it. No match of the public pattern crosses such a unit.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNITS = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


class TextEncoder:
    """Ids of texts: the pattern's matches, each encoded by a PrefixEncoder; frequent units are kept.

    New pieces of a batch are encoded in sorted order, so that a prefix that several share is done once.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, cached: int = CACHED):
        self.prefixes = PrefixEncoder(ranks)
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.dtype = np.dtype("<u2" if len(self.prefixes.bytes) <= 1 << 16 else "<u4")
        self.pieces = Recent(lambda p: self._encoded([p])[0], cached)
        self.units = Recent(lambda u: self._joined([u])[0], cached)

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces in sorted order."""
        out, last, before, as_bytes = [], [], b"", np.array
        for piece in pieces:
            p = piece.encode()
            whole = self.prefixes.ranks.get(p)
            if whole is None:
                same = len(os.path.commonprefix((before, p)))
                del last[same:]
                self.prefixes.extend(p, last)
                before = p
                ids = self.prefixes.tokens(p, last)
            else:
                ids = [whole]
            out.append(as_bytes(ids, self.dtype).tobytes())
        return out

    def _joined(self, units: list[str]) -> list[bytes]:
        split = [self.pattern.findall(u) for u in units]
        self.pieces.load(sorted({p for pieces in split for p in pieces}), self._encoded)
        return [b"".join([self.pieces[p] for p in pieces]) for pieces in split]

    def many(self, texts: list[str]) -> list[np.ndarray]:
        units = [_UNITS.findall(t) for t in texts]
        self.units.load(sorted({u for some in units for u in some}), self._joined)
        return [np.frombuffer(b"".join(map(self.units.__getitem__, some)), self.dtype) for some in units]

    def ids(self, text: str) -> np.ndarray:
        return self.many([text])[0]

    def appended(self, text: str, ids: np.ndarray, more: str) -> np.ndarray:
        """The ids of text + more from those of text: only text's last match is encoded again."""
        starts = [m.start() for m in self.pattern.finditer(text)]
        if not starts:
            return self.ids(text + more)
        tail = len(self.prefixes.encode(text[starts[-1] :].encode()))
        return np.concatenate([ids[: len(ids) - tail], self.ids(text[starts[-1] :] + more)])


@lru_cache(maxsize=2)
def text_encoder(path: str, pattern: str) -> TextEncoder:
    return TextEncoder(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids array<int>, n_tokens long of every whole text.

    Null and empty texts give no ids. Rows are independent: repeated ids and texts stay as many
    rows; nothing is shuffled. path is the rank file on every worker. Other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        holding("bpe", text_encoder.cache_clear)
        t = text_encoder(path, pattern)
        each = t.many([x or "" for x in batch.column(1).to_pylist()])
        offsets = np.cumsum([0, *map(len, each)])
        flat = np.concatenate([np.empty(0, t.dtype), *each]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
        return pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(np.diff(offsets).astype(np.int64))], ["doc_id", "ids", "n_tokens"])

    return map_arrow(only(docs, doc_id=doc_id, text=text), run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, ids array<int>, n_tokens long", 128)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> pa.BinaryArray:
    """The bytes of every id, in order; ids without a token have none."""
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return pa.array(out, pa.binary())


def decode(encoded: DataFrame, path: str, *, ids: str = "ids") -> DataFrame:
    """encoded with a column decoded, the bytes of its ids.

    Null ids give null, no ids no bytes. All rows and columns stay, repeated ones too; a column
    decoded must not be there. An empty table stays empty.
    """
    names = encoded.columns
    schema = encoded.withColumn("decoded", F.lit(None).cast("binary")).schema

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(names.index(ids))
        taken = token_bytes(path).take(column.flatten())
        # The tokens of all ids lie one after another: a document's bytes are a stretch of them.
        ends = np.cumsum([0, *(n or 0 for n in pc.list_value_length(column).to_pylist())])
        starts = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset :] if len(taken) else np.zeros(1, np.int32)
        data = taken.buffers()[2] if len(taken) else pa.py_buffer(b"")
        whole = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(starts[ends]), data])
        decoded = pc.if_else(pc.is_valid(column), whole, pa.scalar(None, pa.binary()))
        return pa.RecordBatch.from_arrays([*batch.columns, decoded], [*names, "decoded"])

    return map_arrow(encoded, run, schema, 256)
