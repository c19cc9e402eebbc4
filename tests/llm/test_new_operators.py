"""Importance resampling, the prefix trie and web archives, against brute force, round trips and SQL."""

import base64
import gzip
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from meshspark.llm import importance, queries, toxicity, trie, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_prefix_trie", "op13_warc"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    theirs = con.execute(queries.oracle_sql()[name]).df()
    ours = queries.queries()[name](spark, SF).toPandas()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns) and len(ours) == len(theirs)
    a, b = (d[columns].sort_values(columns).reset_index(drop=True) for d in (ours, theirs))
    for c in columns:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


# importance resampling


def _words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _features(text, order):
    w = _words(text)
    return [" ".join(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)]


def _resampled(docs, target, order, buckets, seed, min_words, percent):
    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(at(f) for x in texts for f in _features(x, order)) for texts in ([x for _, x in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for i, x in docs:
        f = _features(x, order)
        w = sum(gain(at(y)) for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(_words(x)), len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    drawn = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for place, r in enumerate(drawn[: len(drawn) * percent // 100], 1):
        r.append(place)
    return sorted((tuple(r if len(r) == 6 else [*r, None]) for r in rows), key=str)


RESAMPLED = [(0, "The cat, THE cat; the Dog!"), (1, "Ünicode é中 ÀB\x00c x" * 9), (2, None), (3, ""), (4, " \t,.;"), (5, "cat"), (5, "cat"), (None, "a dog sat on the mat"), (7, "word " * 5000), (8, "a" * 50_000), (9, "the dog sat on the mat"), *((i, "the dog " * (i % 7)) for i in range(10, 60))]


@pytest.mark.parametrize(("order", "buckets"), [(2, 10_000), (3, 50), (1, 7)])
def test_resampling_equals_brute_force(spark, order, buckets):
    target = ["The dog sat on the mat.", None, "a mat"]
    docs = spark.createDataFrame([(i, x, "x", 1) for i, x in RESAMPLED], "doc_id long, text string, score string, rank int")
    tables = docs, spark.createDataFrame([(x, 1) for x in target], "text string, n int")
    got = importance.resample(*tables, order=order, buckets=buckets, seed=7, min_words=2, percent=40)
    got = sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)
    assert got == _resampled(RESAMPLED, target, order, buckets, 7, 2, 40)


def test_features_don_t_depend_on_blocks():
    text = " ".join(random.Random(1).choices(["a", "bc", "déf", "ghij"], k=300)).encode()
    whole = sorted(x for _, f in importance.feature_buckets(text, 3, 1000) for x in f.tolist())
    for block in (1, 7, 64):
        assert sorted(x for _, f in importance.feature_buckets(text, 3, 1000, block) for x in f.tolist()) == whole


def test_resampling_without_rows_and_with_equal_rows(spark):
    schema = "doc_id long, text string"
    none, same = spark.createDataFrame([], schema), spark.createDataFrame([(None, "one two three")] * 200, schema)
    assert importance.resample(none, none).count() == 0
    assert sorted(r.rank for r in importance.resample(same, none, min_words=3, percent=50).collect() if r.rank) == [*range(1, 101)]


# prefix trie


def _trie(rows, family=5, splice=9):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns, key=lambda x: (x[0], x[1], hashlib.sha256(f"{len(x[2].encode())}:{x[2]}{x[3]}".encode()).digest()))] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % splice
        base = c - int(math.fmod(c, family))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = {}
    for c, path in whole.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    out = []
    for p, found in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        kids = lambda q: sum(len(x) == len(q) + 1 and x[: len(q)] == q for x in nodes)
        ends = ",".join(str(c) for c in sorted(found) if whole[c] == p)
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out.append((min(found), len(p), min(nodes[p[:-1]]) if p else None, len(found), kids(p), sum(not kids(q) for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def _conversations(seed):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", None, "é"]), rng.choice(["a", "bb", "", None, "déjà vu"])) for c in range(-12, 60) if c % 10 for t in range(rng.choice([1, 2, 3, 12]))]
    rows += [(c, t, "user", "same") for c in range(100, 400, 3) for t in range(3)]
    rows += [(500, t, "user", "long") for t in range(60)] + [(505, t, "user", "long") for t in range(50)]
    rows += [(None, 0, "user", "a")] * 9 + [(600, None, "user", "b"), (600, 0, "user", "a"), (600, 0, "user", "a"), (600, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard", [1, 5, 40, 10**6])
def test_trie_equals_brute_force(spark, shard):
    rows = _conversations(shard)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, path string")
    got = trie.prefix_trie(table, shard=shard).collect()
    assert sorted((tuple(r) for r in got), key=str) == _trie(rows)


def test_trie_without_rows_and_without_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "a")], schema)).count() == 0
    alone = [c for c in range(1, 60) if c % 5 and zlib.crc32(str(c).encode()) % 9][:1]
    rows = [(c, 0, "user", "a") for c in alone]  # its one turn goes and its family has no first
    got = trie.prefix_trie(spark.createDataFrame(rows, schema)).collect()
    assert [tuple(r) for r in got] == _trie(rows) == [(alone[0], 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone[0]).encode()).hexdigest())]


def test_splitters_balance_and_are_bounded(spark):
    paths = [(bytes([i % 7]) * 32 + bytes([i // 7]) * 32 + os.urandom(32), [1, 1, 1]) for i in range(700)]
    table = spark.createDataFrame([(hashlib.sha256(p).digest(), p, s) for p, s in paths], "path_id binary, path binary, sizes array<int>")
    splits = trie.splitters(table, 100, 1000)
    assert 10 <= len(splits) <= 21 and splits == sorted(set(splits))
    shards = Counter(sum(p >= s for s in splits) for p, _ in paths)
    assert max(shards.values()) < 150
    assert len(trie.splitters(table, 1, 8)) <= 8


# web archives

PAGES = [(5, "http://a/5", "<p>same</p>"), (3, "http://a/3", "<p>same</p>"), (None, "http://a/n", "<p>same</p>"), (3, "http://a/3", "<p>same</p>"), (7, None, None), (8, "", ""), (9, "http://a/\r\nX: y", "WARC/1.1\r\n\r\n\r\n0\r\n\r\n" * 40), (10, "http://é/", "é中" * 3000), (None, "u", "only"), (None, "u", "only"), (11, "u", "x" * 300_000)]


def _pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, block string")


def _archived(rows, min_bytes=0):
    heads = {}
    for i, _, html in rows:
        heads.setdefault(html or "", []).append(i)
    out = []
    for i, _, html in rows:
        payload, head = (html or "").encode(), min((x for x in heads[html or ""] if x is not None), default=None)
        first = i == head or len(payload) < min_bytes
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if first else "revisit", None if first else head))
    return sorted(out, key=str)


@pytest.mark.parametrize("few", [100, 0])
@pytest.mark.parametrize("min_bytes", [0, 10])
@pytest.mark.parametrize("segment", [64, 1 << 14])
def test_archives_round_trip(spark, tmp_path, few, min_bytes, segment):
    warc.write_archives(_pages(spark), f"{tmp_path}/w", min_bytes=min_bytes, segment=segment, few=few)
    got = warc.read_archives(spark, f"{tmp_path}/w").collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == _archived(PAGES, min_bytes)
    texts = {r.page_id: r.payload for r in got if r.record_type == "response" and r.page_id is not None}
    assert all(bytes(texts[i]) == (h or "").encode() for i, _, h in PAGES if i in texts) and texts.keys() >= {3, 9, 10, 11}
    assert {r.page_id: r.url for r in got}[9] == "http://a/%0D%0AX: y"
    assert all(r.problem is None for r in got)


def test_no_pages(spark, tmp_path):
    warc.write_archives(_pages(spark, []), f"{tmp_path}/w")
    assert warc.read_archives(spark, f"{tmp_path}/w").count() == 0


def test_hot_payloads_are_broadcast_and_others_shuffled(spark):
    rows = [(i, "u", "hot" if i % 2 else f"cold {i % 1200}") for i in range(3000)]
    got = warc.with_heads(_pages(spark, rows).drop("block"), 0, few=0).collect()
    smallest = {}
    for i, _, h in rows:
        smallest.setdefault(h, []).append(i)
    assert len(got) == len(rows)
    assert all((r._head, r._many) == ((min(smallest[r.html]), len(smallest[r.html])) if len(smallest[r.html]) > 1 else (None, None)) for r in got)


def _record(kind, name, block, *more):
    return warc.record([("WARC-Type", kind), ("WARC-Record-ID", f"<{name}>"), *more], block) + warc.END


def test_segments_from_many_files_and_damaged_records(spark, tmp_path):
    payload = b"<p>" + b"abc \r\n\r\n" * 50
    http = b"HTTP/1.1 200 OK\r\ntransfer-encoding: Chunked" + warc.END + warc.chunked(payload, 64)
    parts = [http[i : i + 100] for i in range(0, len(http), 100)]

    def segment(name, k, total=len(http)):
        own = [("WARC-Segment-Number", k + 1)]
        if k:
            own.append(("WARC-Segment-Origin-ID", f"<{name}>"))
        if k == len(parts) - 1:
            own.append(("WARC-Segment-Total-Length", total))
        return _record("continuation" if k else "response", f"{name}-{k}" if k else name, parts[k], *own, *([] if k else [("Page-Id", {"good": 1, "gap": 2, "short": 3, "other": 5, "tail": 6}[name])]))

    records = [segment("good", k) for k in range(len(parts))] + [segment("gap", k) for k in range(len(parts)) if k != 1] + [segment("short", k, len(http) - 1) for k in range(len(parts))] + [segment("tail", k) for k in range(len(parts) - 1)]
    records.append(_record("continuation", "lost-2", b"x", ("WARC-Segment-Number", 2), ("WARC-Segment-Origin-ID", "<lost>")))
    records.append(_record("response", "other", b"HTTP/1.1 200 OK\r\n\r\nplain", ("Page-Id", 5), ("WARC-Payload-Digest", "sha1:AAAA")))
    records.append(_record("warcinfo", "info", b"software: none"))
    records.append(_record("response", "plain", b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nplain", ("Page-Id", 4)))
    random.Random(2).shuffle(records)
    os.makedirs(f"{tmp_path}/w")
    third = len(records) // 3
    for i, some in enumerate((records[:third], records[third : 2 * third], records[2 * third :])):
        data = b"".join(some) if i else b"".join(map(gzip.compress, some))  # a member for each record, and plain files
        with open(f"{tmp_path}/w/{i}.warc", "wb") as f:
            f.write(data)
    got = {r.page_id: r for r in warc.read_archives(spark, f"{tmp_path}/w", strict=False).collect()}
    assert got.keys() == {1, 2, 3, 4, 5, 6, None}
    assert bytes(got[1].payload) == payload and bytes(got[4].payload) == b"plain" and got[1].problem is got[4].problem is None
    assert all(got[i].payload is None and got[i].problem for i in (2, 3, 5, 6, None))
    with pytest.raises(Exception, match="record <"):
        warc.read_archives(spark, f"{tmp_path}/w").filter(F.col("page_id") == 2).collect()
    for body in (b"5\r\nab", b"2\r\nabX\r\n0\r\n\r\n", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(body)
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nT: v\r\n\r\n") == b"abc"


# What earlier operators were found to get wrong


def test_clean_documents_keeps_columns_of_its_own_names(spark):
    rng = random.Random(3)
    words = ["river", "stone", "table", "green", "letter", "window"]
    rows = [(i, " ".join(rng.choices(words, k=8)) + (" zurbokli" if i % 3 == 0 else ""), float(i), -float(i)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, _score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    got = toxicity.clean_documents(docs, labels)
    assert got.columns == docs.columns
    kept = got.collect()
    assert {r.doc_id for r in kept} >= {i for i in range(120) if i % 3} and all((r.score, r._score) == (r.doc_id, -r.doc_id) for r in kept)
    bare = toxicity.clean_documents(docs, labels.limit(0)).collect()
    assert len(bare) == 120 and all((r.score, r._score) == (r.doc_id, -r.doc_id) for r in bare)


def test_documents_of_one_id_are_learned_from_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "learned", lambda each, toxic: seen.append(len(each)))
    docs = spark.createDataFrame([(0, f"word{k}") for k in range(50)] + [(1, "a"), (3, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (3, 0)], "doc_id long, toxic int")
    toxicity.fit_machine(docs, labels)
    assert seen == [sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in (0, 1, 3))]
