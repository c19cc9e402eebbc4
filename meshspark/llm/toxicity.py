"""Toxicity by a subsequence string-kernel machine on Nyström landmarks."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Recent, holding, map_arrow, only, utf8

#: Rows of either label that the machine is fitted on at most, the first by hash.
SAMPLE = 8000
LANDMARKS, POWER, DECAY, STEP, PIECE, CACHED, CUTOFF, TELLING = 128, 3, 0.5, 3, 32, 150_000, 0.3, 6.0
#: Rounds of fitting; words in a block; words of a text that its score rests on; words that stand for toxic documents in fitting at most.
ROUNDS, BLOCK, WORST, WITNESSES = 4, 4096, 3, 4000
_GAP, _BEGIN, _END, _SYMBOLS = 0, 1, 2, 64
_PATTERNS = [(a, b, DECAY ** (a + b - 2)) for a in range(1, STEP + 1) for b in range(1, STEP + 1)]
_TRIM = re.compile(r"^[\W_]+|[\W_]+$")
#: Single characters that spell a word, as in "a b c d".
_SPELT = re.compile(r"(?:(?<=\s)|^)(?:\w\W{1,3}){3,}\w(?=\W|$)")


class _Codes(dict):
    """From a character to its symbol: letters a-z, digits and a few classes of the other letters; all else is a gap."""

    def __missing__(self, o: int) -> str:
        c = chr(o)
        code = o - 94 if 97 <= o <= 122 else 29 + o - 48 if 48 <= o <= 57 else 39 + o % 25 if c.isalnum() else _GAP
        self[o] = chr(code)
        return self[o]


_CODES = _Codes()


def normal(token: str) -> str:
    """Lower-cased, without marks at the ends; marks inside stay and count as gaps."""
    return token.lower() if token.isalnum() else _TRIM.sub("", token.lower())


def pieces(word: str, begin: bool = True, end: bool = True) -> list[bytes]:
    """A word's symbols with marks for its ends, as overlapping pieces of at most PIECE + 2."""
    s = b"\x01" * begin + word.translate(_CODES).encode("latin-1") + b"\x02" * end
    if len(s) <= PIECE + 2:
        return [s]
    return [s[i : i + PIECE] for i in range(0, len(s) - PIECE // 2, PIECE // 2)]


def _padded(words: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(words), width + 2 * STEP), np.int32)
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        out[rows, :n] = np.frombuffer(b"".join([words[i] for i in rows]), np.uint8).reshape(-1, n)
    return out


def subsequences(words: list[bytes]) -> Iterator[tuple[float, np.ndarray]]:
    """Weight and codes (words x starts, -1: none) of all subsequences of three symbols, by their steps."""
    width = max(map(len, words))
    s = _padded(words, width)
    for a, b, weight in _PATTERNS:
        x, y, z = s[:, :width], s[:, a : a + width], s[:, a + b : a + b + width]
        yield weight, np.where((x > 0) & (y > 0) & (z > 0), (x * _SYMBOLS + y) * _SYMBOLS + z, -1)


def norms(words: list[bytes]) -> np.ndarray:
    n = np.array([len(w) for w in words])
    return np.sqrt(sum(np.maximum(n - a - b, 0) * w * w for a, b, w in _PATTERNS) + 1e-9)


class Kernel:
    """The kernel of words with fixed landmarks.

    k(x, y) = sum over subsequences u of x_u * y_u, where x_u adds DECAY for every symbol skipped
    (at most STEP - 1 in a row), over the norms by length, to the power POWER: a product of kernels,
    so a kernel. A landmark's subsequences are rows of a table, found by their code.
    """

    def __init__(self, landmarks: list[bytes]):
        self.landmarks = landmarks
        self.index = np.full(_SYMBOLS**3, -1, np.int32)
        codes, owners, weights = [], [], []
        for i, w in enumerate(landmarks):
            for weight, c in subsequences([w]):
                c = c[c >= 0]
                codes.append(c)
                owners.append(np.full(len(c), i))
                weights.append(np.full(len(c), weight))
        c, o, w = np.concatenate(codes), np.concatenate(owners), np.concatenate(weights)
        distinct, row = np.unique(c, return_inverse=True)
        self.index[distinct] = np.arange(len(distinct))
        flat, where = np.unique(row * len(landmarks) + o, return_inverse=True)
        self.owner = flat % len(landmarks)
        self.value = np.bincount(where, w) / norms(landmarks)[self.owner]
        self.count = np.bincount(flat // len(landmarks), minlength=len(distinct))
        self.start = np.cumsum(self.count) - self.count

    def __call__(self, words: list[bytes]) -> np.ndarray:
        m = len(self.landmarks)
        out = np.zeros((len(words), m))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for at in range(0, len(order), 1024):
            block = order[at : at + 1024]
            some = [words[i] for i in block]
            who, rows, weights = [], [], []
            for weight, c in subsequences(some):
                r = np.where(c >= 0, self.index[c], -1)
                i, j = np.nonzero(r >= 0)
                who.append(i)
                rows.append(r[i, j])
                weights.append(np.full(len(i), weight))
            who, rows, weights = np.concatenate(who), np.concatenate(rows), np.concatenate(weights)
            n = self.count[rows]
            entry = np.repeat(self.start[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            got = np.bincount(np.repeat(who, n) * m + self.owner[entry], np.repeat(weights, n) * self.value[entry], len(some) * m)
            out[block] = got.reshape(-1, m) / norms(some)[:, None]
        return out**POWER


def linear_machine(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Squared-hinge machine by Newton steps with step halving; y in -1, 1; the last column of z is 1."""
    w = np.zeros(z.shape[1])
    penalty = np.append(np.full(z.shape[1] - 1, ridge), 1e-6)

    def loss(w: np.ndarray) -> float:
        return float((weight * np.maximum(0, 1 - y * (z @ w)) ** 2).sum() + penalty @ (w * w))

    for _ in range(100):
        slack = np.maximum(0, 1 - y * (z @ w))
        active, gram = weight * (slack > 0), np.diag(penalty)
        for at in range(0, len(z), BLOCK):
            part = z[at : at + BLOCK]
            gram += (part * active[at : at + BLOCK, None]).T @ part
        step = np.linalg.solve(gram, penalty * w - z.T @ (weight * y * slack))
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


@dataclass
class Machine:
    kernel: Kernel
    alpha: np.ndarray
    bias: float
    slopes: np.ndarray
    shift: float

    def margins(self, words: list[str]) -> np.ndarray:
        """A word's margin is that of its best piece, on a logarithmic scale either side of 0."""
        blocks = [self._margins(words[at : at + BLOCK]) for at in range(0, len(words), BLOCK)]
        return np.concatenate(blocks) if blocks else np.empty(0)

    def _margins(self, words: list[str]) -> np.ndarray:
        each = [pieces(w) for w in words]
        f = self.kernel(list(itertools.chain.from_iterable(each))) @ self.alpha + self.bias
        best = np.maximum.reduceat(f, np.cumsum([0, *map(len, each)])[:-1])
        return np.sign(best) * np.log1p(np.abs(best))

    def worst(self, margins: Iterable[float]) -> list[float]:
        """The WORST largest different margins of a text, the machine's bias where it has fewer."""
        return [*sorted({*margins}, reverse=True)[:WORST], *[self.bias] * WORST][:WORST]

    def scored(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(worst @ self.slopes + self.shift, -30, 30)))


def sentence_words(text: str) -> list[str]:
    return [*text.split(), *(re.sub(r"\W", "", m[0]) for m in _SPELT.finditer(text))]


def _disguised(word: str, rng: np.random.Generator) -> list[str]:
    """A word with a letter put in, and one with a mark."""
    at = [int(x) for x in rng.integers(1, max(2, len(word)), 2)]
    return [word[: at[0]] + "abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))] + word[at[0] :], word[: at[1]] + "." + word[at[1] :]]


def learned(docs: list[tuple[str, ...]], toxic: np.ndarray, seed: int = 3) -> Machine | None:
    """Fit on documents as their distinct words. None without documents of either label.

    A toxic document has at least one toxic sentence, and that a toxic word, but which is not told:
    as in multiple-instance learning, the words with positive margins, else the best one, stand for
    their document, the others are left out; all words of clean documents are clean. The first guess
    are the words whose document counts, or whose beginning's, tell. A logistic curve over the WORST
    largest margins turns them into a score.
    """
    rng = np.random.default_rng(seed)
    if not toxic.any() or toxic.all():
        return None
    fit = rng.random(len(docs)) < 0.8
    if not toxic[fit].any() or toxic[fit].all():
        fit[:] = True
    counts = [Counter(), Counter()]
    # Beginnings of words count only where toxic documents have them, so that the clean ones' don't fill the memory.
    starts = lambda w: (w[:m] + "*" for m in range(4, min(len(w), 10)))
    for words in itertools.compress(docs, fit & toxic):
        counts[1].update({*words, *itertools.chain.from_iterable(map(starts, words))})
    for s in [s for s, c in counts[1].items() if c < 3 and s.endswith("*")]:
        del counts[1][s]
    for words in itertools.compress(docs, fit & ~toxic):
        counts[0].update({*words, *(s for w in words for s in starts(w) if s in counts[1])})
    n = [max(1, int((~toxic[fit]).sum())), max(1, int(toxic[fit].sum()))]

    def telling(s: str) -> float:
        a, b = counts[1][s], counts[0][s]
        p = (a + b + 1) / (n[0] + n[1] + 2)
        return (a / n[1] - b / n[0]) / math.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]))

    z = {s: telling(s) for s, c in counts[1].items() if c >= 3}
    chosen: list[bytes] = []
    made: Kernel | None = None
    for s in sorted(z, key=lambda s: (-z[s], s))[:1500]:
        if z[s] < TELLING or len(chosen) >= LANDMARKS // 2:
            break
        p = pieces(s.rstrip("*"), end=not s.endswith("*"))[0]
        if made is None or made([p]).max() < 0.75**POWER:
            chosen.append(p)
            made = Kernel(chosen)
    clean = sorted((w for w in counts[0] if not w.endswith("*") and w), key=lambda w: (-counts[0][w], w))
    every_clean = clean or ["a"]
    clean = list(dict.fromkeys(every_clean[:5000] + [every_clean[i] for i in rng.choice(len(every_clean), min(len(every_clean), 10000), replace=False)]))
    if made is not None:
        hard = sorted(range(len(clean)), key=lambda i, k=made([pieces(w)[0] for w in clean]).max(1): -k[i])
        chosen += [pieces(clean[i])[0] for i in hard[: LANDMARKS // 4]]
    chosen += [pieces(w)[0] for w in clean[: LANDMARKS - len(chosen)]]
    kernel = Kernel(chosen)
    values, vectors = np.linalg.eigh(kernel(chosen))
    root = vectors * (1 / np.sqrt(np.maximum(values, 1e-2)))  # Nyström features are kernel(x) @ root
    guess = lambda w: max([z.get(w, -9.0), *(z.get(w[:m] + "*", -9.0) for m in range(4, min(len(w), 10)))])
    bad = [sorted(d) for d, f, t in zip(docs, fit.tolist(), toxic.tolist(), strict=True) if f and t and d]
    bad = [words for words in bad if guess(max(words, key=guess)) >= TELLING] or bad
    witness = [[w for w in words if guess(w) >= TELLING] or [max(words, key=guess)] for words in bad]
    more = lambda w: counts[1][w] / n[1] > counts[0][w] / n[0]
    machine = None
    for _ in range(ROUNDS):
        count = Counter(itertools.chain.from_iterable(witness))
        forms = [(f, c) for w, c in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:WITNESSES] for f in (w, *_disguised(w, rng))]
        words = [*(f for f, _ in forms), *clean]
        x = np.ones((len(words), len(chosen) + 1))
        for at in range(0, len(words), BLOCK):
            x[at : at + BLOCK, :-1] = kernel([pieces(w)[0] for w in words[at : at + BLOCK]]) @ root
        y = np.where(np.arange(len(words)) < len(forms), 1.0, -1.0)
        weight = np.concatenate([np.sqrt([c for _, c in forms]), np.sqrt([max(1, counts[0][w]) for w in clean])])
        weight[: len(forms)] *= 0.5 * weight[len(forms) :].sum() / weight[: len(forms)].sum()
        w, bias = linear_machine(x, y, weight)
        machine = Machine(kernel, root @ w, bias, np.zeros(WORST), 0.0)
        every = sorted({w for words in bad for w in words})
        margin = dict(zip(every, machine.margins(every).tolist(), strict=True))
        witness = [[w for w in words if margin[w] > 0 and more(w)] or [max(words, key=lambda w: (margin[w], w))] for words in bad]
        # Clean words that look worst join the next round.
        worst = machine.margins(every_clean)
        clean = list(dict.fromkeys(clean + [every_clean[i] for i in np.argsort(-worst, kind="stable")[:3000] if worst[i] > -1]))
    every = sorted({w for d in docs for w in d})
    margin = dict(zip(every, machine.margins(every).tolist(), strict=True))
    worst = np.array([machine.worst([margin[w] for w in d]) for d in docs])
    machine.slopes, machine.shift = _calibrated(worst, toxic.astype(float), ~fit)
    return machine


def _calibrated(margins: np.ndarray, label: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic curve from margins to labels, with smoothed targets; no slope is under 0.

    Its place is the mean of the best for all rows and for those kept apart in fitting: the former
    sees too little error, the latter are few.
    """
    up, down = label.sum(), len(label) - label.sum()
    target = np.where(label > 0, (up + 1) / (up + 2), 1 / (down + 2))
    used = np.arange(margins.shape[1])
    while True:
        z = np.hstack([margins[:, used], np.ones((len(margins), 1))])
        w = _logistic(z, target)
        if (w[:-1] >= 0).all():
            slopes = np.zeros(margins.shape[1])
            slopes[used] = w[:-1]
            f = z @ w
            return slopes, float(w[-1]) + (_moved(f, label) + _moved(f[apart], label[apart])) / 2
        used = np.delete(used, w[:-1].argmin())


def _moved(f: np.ndarray, label: np.ndarray) -> float:
    """What to add to the curve's argument so that the cutoff parts labels best (most F1); 0 with few rows of a label."""
    if min(label.sum(), len(label) - label.sum()) < 10:
        return 0.0
    order = np.argsort(-f, kind="stable")
    found = np.cumsum(label[order])
    f1 = 2 * found / (np.arange(1, len(f) + 1) + label.sum())
    cut = np.append(f[order][:-1] > f[order][1:], True)
    at = int(np.where(cut, f1, -1).argmax())
    above, below = f[order[at]], f[order[min(at + 1, len(f) - 1)]]
    level = below + 0.3 * (above - below)  # disguises score a little less than the words they stand for
    return math.log(CUTOFF / (1 - CUTOFF)) - float(level)


def _logistic(z: np.ndarray, target: np.ndarray) -> np.ndarray:
    w = np.zeros(z.shape[1])

    def loss(w: np.ndarray) -> float:
        f = z @ w
        return float((np.logaddexp(0, f) - target * f).sum() + 1e-3 * w @ w)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 2e-3 * np.eye(len(w)), z.T @ (p - target) + 2e-3 * w)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def words_of(text: bytes) -> set[str]:
    return {normal(w) for w in sentence_words(text.decode())} - {""}


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learned from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_machine(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Machine | None:
    """Learn from at most `sample` labelled documents of either label, the first by hash, none held out; of rows with equal ids, from the one whose text has the smallest hash."""
    known = only(labels, id=doc_id, toxic="toxic").dropna().filter(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    some = [known.filter(F.col("toxic") == v).orderBy(F.xxhash64("id"), "id").limit(sample) for v in (0, 1)]
    some = some[0].unionByName(some[1])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(["\n".join(sorted(words_of(t))) for t in utf8(batch.column(0))], pa.string()), batch.column(1)], ["words", "toxic"])

    # At most 2 * sample rows.
    found = only(docs, id=doc_id, text=text).join(F.broadcast(some), "id")
    found = found.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").cast("int").alias("toxic")).select("text", "toxic")
    got = map_arrow(found, run, "words string, toxic int").toArrow()
    rows = sorted(zip(got.column("words").to_pylist(), got.column("toxic").to_pylist(), strict=True))
    del got
    same: dict[str, str] = {}  # one object for each word, however many documents have it
    each = [tuple(same.setdefault(w, w) for w in words.split("\n") if w) for words, _ in rows]
    toxic = np.array([t == 1 for _, t in rows], bool)
    del rows
    return learned(each, toxic)


_scorers: dict = {}


def _scorer(machine: Machine) -> Recent:
    key = zlib.crc32(machine.alpha.tobytes())
    if key not in _scorers:
        _scorers.clear()
        many = lambda tokens: machine.margins([normal(t.decode()) for t in tokens]).tolist()
        _scorers[key] = Recent(lambda t: many([t])[0], CACHED)
        _scorers[key].many = many
    return _scorers[key]


def score(docs: DataFrame, machine: Machine | None, *, doc_id: str = "doc_id", text: str = "text", name: str = "score") -> DataFrame:
    """docs with a column score (or another name), 0 to 1, of every whole text.

    A text's score rests on its WORST largest margins of words, words spelt in single characters
    included; null, empty and wordless texts have the machine's bias alone. Without a machine (no
    labels of both kinds) every score is 0. Only the text is read, whole; rows are independent, so
    repeated ones score alike and an empty table stays empty. A column of that name must not be there. The
    machine's arrays are broadcast; their size is fixed.
    """
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs has a column {name} already")
    if machine is None:
        return docs.withColumn(name, F.lit(0.0))
    held = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        holding("toxicity", _scorers.clear)
        m = held.value
        cache = _scorer(m)
        texts = utf8(batch.column(at))
        split = [{*t.lower().split(), *(re.sub(r"\W", "", x[0]).encode() for x in _SPELT.finditer(t.decode()))} for t in texts]
        cache.load(set().union(*split), cache.many)
        worst = np.array([m.worst(map(cache.__getitem__, words)) for words in split], np.float64).reshape(-1, WORST)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(m.scored(worst))], [*batch.schema.names, name])

    schema = docs.withColumn(name, F.lit(0.0)).schema
    return map_arrow(docs, run, schema, 1024)


def clean_documents(docs: DataFrame, labels: DataFrame, *, cutoff: float = CUTOFF, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that score under the cutoff; all columns stay."""
    machine = fit_machine(docs, labels, doc_id=doc_id, text=text)
    name = "score"
    while name.lower() in (c.lower() for c in docs.columns):
        name = f"_{name}"
    return score(docs, machine, doc_id=doc_id, text=text, name=name).filter(F.col(name) < cutoff).drop(name)
