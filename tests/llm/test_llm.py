"""The operators against brute force, round trips and held-out accuracy, on small inputs."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from meshspark.llm import ann, bpe, html_text, jaccard, mixing, neardup, pii, substring, token_files, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _docs(spark, texts):
    rows = [(i, t, "en", "ab"[i % 2] if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


WORDS = ["the", "cat", "sat", "on", "a", "mat", "and", "then", "left"]


def _texts():
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice(WORDS, 60)) for _ in range(12)]
    near = [b + " end" for b in base[:4]]
    return [*base, *near, base[0], base[0].upper(), None, "", "  ", "one two", "one two", "é中 a b \U0001f600 12345", "x" * 5000]


def test_pseudonyms_are_linked_valid_and_can_be_undone(spark):
    texts = ["mail bob@x.org or 4111 1111 1111 1111 on 2021-03-04", "again bob@x.org, 4111111111111111", "not a card 4111111111111112, id 300.1.2.3", None, ""]
    out = [r.text for r in pii.pseudonymize(_docs(spark, texts), key=b"k").orderBy("doc_id").collect()]
    cards = [re.sub(r"\D", "", re.search(r"\d[\d ]{14,18}\d", t)[0]) for t in out[:2]]
    assert cards[0] == cards[1] != "4111111111111111" and pii.luhn(cards[0][:-1]) == int(cards[0][-1])
    assert re.search(r"\S+@x\.org", out[0])[0] == re.search(r"\S+@x\.org", out[1])[0].rstrip(",") != "bob@x.org"
    assert "2021-03-04" not in out[0] and out[2:] == texts[2:]
    f = pii.Feistel(b"k")
    for n in (2, 3, 10, 97):
        image = [f.other(x, n, "t") for x in range(n)]
        assert sorted(image) == list(range(n)) and all(x != y for x, y in enumerate(image))
        assert [f.other(y, n, "t", back=True) for y in image] == list(range(n))


def test_bpe_equals_the_public_library_and_decodes(spark):
    texts = _texts()
    truth = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(RANKS), special_tokens={})
    rows = bpe.decode(bpe.encode(_docs(spark, texts), RANKS, public_tokenizers.PATTERN), RANKS).collect()
    for r in rows:
        t = texts[r.doc_id] or ""
        assert r.ids == truth.encode_ordinary(t) and bytes(r.decoded) == t.encode()


def _shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def _least(n, links):
    at = list(range(n))
    for _ in range(n):
        for a, b in links:
            at[a] = at[b] = min(at[a], at[b])
    return at


def test_jaccard_components(spark):
    texts = _texts()
    sets = [_shingles(t, 4) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    rows = jaccard.jaccard_components(_docs(spark, texts), n=4, percent=85).orderBy("doc_id").collect()
    assert [r.component_id for r in rows] == _least(len(sets), links)
    assert [r.n_shingles for r in rows] == [len(s) for s in sets]


def test_repeated_windows(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[:100]), " ".join(["x", *words[20:80], "y"]), " ".join(words[150:190]), None, "", "short"]
    out = {r.doc_id: r for r in substring.digest_repeats(_docs(spark, texts), window=35).collect()}
    assert [out[i].n_removed for i in range(6)] == [60, 60, 0, 0, 0, 0]
    assert [out[i].n_words for i in range(6)] == [100, 62, 40, 0, 0, 1]


def test_repeats_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring, "DOCS_PER_CHUNK", 7)
    rng = np.random.default_rng(12)
    pool = [[f"p{k}_{i}" for i in range(int(n))] for k, n in enumerate(rng.integers(20, 90, 12))]
    texts = []
    for _ in range(90):
        words = []
        for _ in range(int(rng.integers(1, 5))):
            words += rng.choice(WORDS, int(rng.integers(0, 40))).tolist()
            p = pool[int(rng.integers(12))]
            a = int(rng.integers(0, 15))
            words += p[a : a + int(rng.integers(10, 80))]
        texts.append("  ".join(words))
    texts += [None, "", " ".join(["again"] * 80), texts[0]]
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    rows = {r.doc_id: r for r in substring.digest_repeats(_docs(spark, texts), window=35).collect()}
    kept_text = {r.doc_id: r.kept_text for r in substring.remove_repeats(_docs(spark, texts), window=35).collect()}
    for i, w in enumerate(split):
        gone = {k for a in range(len(w) - 34) if seen[tuple(w[a : a + 35])] > 1 for k in range(a, a + 35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (rows[i].n_words, rows[i].n_removed, rows[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
        assert kept_text[i] == kept


def test_token_files_come_back(spark, tmp_path):
    rng = np.random.default_rng(8)
    texts = [*_texts(), "hello <|endoftext|> world", "<|startoftext|>a<|ENDOFTEXT|>", "Z\x1c.0 a\x00b.\x7f", "don't stop -- it's", "e\u0301a, \u0130stanbul \u03a3\u03a3"]
    texts += [" ".join(rng.choice(["alpha,", "beta", "(gamma)", "delta's", "x9", "\u4e2d\u6587"], 40_000)), *(" ".join(rng.choice(WORDS, 300)) for _ in range(40))]
    out, path = f"{tmp_path}/tokens", public_tokenizers.path("word_bpe_49k.json")
    token_files.write_token_files(_docs(spark, texts), out, path, n_terminals=49_408, end=1, block_ids=5000)
    from tokenizers import Tokenizer

    truth = Tokenizer.from_file(path)
    expected = [np.array([*truth.encode(t or "", add_special_tokens=False).ids, 1]) for t in texts]
    starts = np.cumsum([0, *map(len, expected)])
    for r, ids, start in zip(token_files.digest_token_files(spark, out, n_terminals=49_408).orderBy("doc_id").collect(), expected, starts, strict=False):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
    for r, ids, start in zip(token_files.read_token_files(spark, out, n_terminals=49_408).orderBy("doc_id").collect(), expected, starts, strict=False):
        assert (r.start, r.ids) == (start, ids.tolist())
    blocks = spark.read.parquet(out).orderBy("shard", "block").collect()
    assert len(blocks) > 3 and any(len(b.rules) for b in blocks)
    everything, at = np.concatenate(expected), 0
    for b in blocks:  # random access within blocks
        block = token_files.Block(np.frombuffer(b.rules, "<u2").reshape(-1, 2), np.frombuffer(b.lengths, "<u4"), np.frombuffer(b.symbols, "<u2"), 49_408)
        for first in [0, b.n_ids - 1, *rng.integers(0, b.n_ids, 20).tolist()]:
            n = int(rng.integers(0, min(50, b.n_ids - first) + 1))
            assert block.at(first, n).tolist() == everything[at + first : at + first + n].tolist()
        at += b.n_ids


def test_word_encoder_equals_the_library_on_odd_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    truth, encoder, rng = Tokenizer.from_file(path), token_files.WordEncoder(path, cached=500), random.Random(1)
    letters = [*"abZ .,'!-\n\t\x0b\x1c\x00\x7f09<|>_\"s", "\u00e9", "\u0301", "\u00df", "\u03a3", "\u0130", "\u00a0", "\u4e2d", "\U0001f600", "<|endoftext|>", "<|ENDOFTEXT|>", "'re", " hello "]
    for _ in range(20):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(200)]
        ids, sizes = encoder.ids(pa.array([*texts, None]), 1)
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        assert [p.tolist() for p in parts] == [[*truth.encode(t, add_special_tokens=False).ids, 1] for t in [*texts, ""]]


def _vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((120, 16))
    x[100:] = x[:20] + 0.05 * rng.standard_normal((20, 16))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(120, None), (121, [0.0] * 16), (122, [float("nan")] * 16)]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>"), unit @ unit.T


def test_embedding_links(spark):
    df, sims = _vectors(spark)
    links = [(a, b) for a, b in itertools.combinations(range(120), 2) if sims[a, b] >= 0.95]
    rows = neardup.near_duplicates(df, threshold=0.95).orderBy("vec_id").collect()
    assert [r.component_id for r in rows] == [*_least(120, links), 120, 121, 122]
    assert [r.n_links for r in rows][:120] == [sum(i in p for p in links) for i in range(120)]


def test_nearest_recall(spark):
    df, sims = _vectors(spark)
    np.fill_diagonal(sims, -2)
    got = {}
    for r in ann.nearest(df, k=5, every=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = sum(len(set(v) & set(np.argsort(-sims[q])[:5].tolist())) for q, v in got.items())
    assert sorted(got) == list(range(0, 120, 10)) and hits >= 0.9 * 5 * len(got)


def test_embedding_links_across_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LOAD", 16)
    monkeypatch.setattr(neardup, "BLOCK", 32)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1200, 16))
    x[900:1100] = x[:200] + rng.uniform(0.05, 0.4, (200, 1)) * rng.standard_normal((200, 16))
    x[1100:] = x[0] + 0.05 * rng.standard_normal((100, 16))  # a cell of many blocks
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = np.triu(unit @ unit.T >= 0.95, 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = neardup.near_duplicates(df, threshold=0.95).orderBy("vec_id").collect()
    assert [r.n_links for r in rows] == (near.sum(0) + near.sum(1)).tolist()
    assert [r.component_id for r in rows] == _least(1200, list(zip(*map(list, np.nonzero(near)), strict=True)))


def test_nearest_with_routers_of_two_levels(spark):
    rng = np.random.default_rng(10)
    centres = rng.standard_normal((40, 16))
    x = centres[rng.integers(0, 40, 3000)] + 0.4 * rng.standard_normal((3000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    got = {}
    for r in ann.nearest(df, k=5, every=20, rows_per_part=40, fan=4, sample=600).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.score - sims[r.query_id, r.vec_id]) < 1e-12
    hits = sum(len(set(v) & set(np.argsort(-sims[q])[:5].tolist())) for q, v in got.items())
    assert sorted(got) == list(range(0, 3000, 20)) and hits >= 0.9 * 5 * len(got)


def test_nearest_with_repeated_ids_and_ties(spark):
    a, b = [1.0, 0.0, 0.0], [0.9, 0.1, 0.0]
    rows = [*[(200, a)] * 8, (300, a), (301, b), (302, b), (400, b), (7, [0.0, 1.0, 0.0]), (7, a)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, every=50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {200: [7, 300, 301], 300: [7, 200, 301], 400: [301, 302, 7]}


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    page = html_text.parsed("<body><div class=ad>x</div><article><p>one</p><p>two</p></article></body>")
    t = html_text.Trees([page])
    model = html_text.Model(rng.standard_normal((html_text.FEATURES, 2)), rng.standard_normal((html_text.EDGES, 2, 2)))
    n, theta = len(page.parent), t.x @ model.unary
    total, ones = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        s = sum(theta[i, y[i]] + (model.pair[t.kind[i], y[t.parent[i]], y[i]] if t.parent[i] >= 0 else 0) for i in range(n))
        total += np.exp(s)
        ones += np.exp(s) * np.array(y)
    marginal, _, z = model.sums(t)
    assert np.allclose(marginal[:, 1], ones / total) and np.isclose(z, np.log(total))


def test_pages(spark):
    body = "<p>A first paragraph of the article that is long enough.<p>Caf&eacute; &amp;\n  <b>more</b>.<br></p>"
    rows = [(0, "u", f"<html><head><title>T</title><script>var t='</p>'</script></head><body><nav><a href=x>Home</a></nav><div class='ad'>Buy now</div><article><h1>Head</h1>{body}</article><footer>&copy; us</footer>"), (1, None, None), (2, "v", "")]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert out[0].text == "Head\nA first paragraph of the article that is long enough.\nCafé & more."
    assert [r.n_chars for r in out] == [len(out[0].text), 0, 0]


def test_pages_of_other_forms(spark):
    long = "A plain sentence of the text that runs on for a while, as sentences do, before it comes to its end. " * 3
    rows = [
        (0, "<article><p>Hello <script>x()</script>big <svg/>world, <button>b</button>and more</p><p>that is <math><mi>x</mi><mo>=</mo><mn>1</mn></math> there</p></article>"),
        (1, f"<p>{long}</p><p>{long}</p>"),
        (2, f"<html><body><p>{long}</p><p>{long}</p></body></html>"),
        (3, "<article>" + "<div>" * 20_000 + f"<p>{long}</p></article>"),
        (4, f"<article><p>{long}</p>" + "<b>" * 15_000 + "</i>" * 15_000 + "</article>"),
    ]
    out = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")).collect()}
    line = " ".join(long.split())
    assert out[0] == "Hello big world, and more\nthat is x=1 there"
    assert out[1] == out[2] == f"{line}\n{line}"
    assert out[3] == out[4] == line  # deep pages take linear time


SENTENCE = "A sentence of eighty letters or so, that says one thing and then comes to an end."


def page_forms():
    """(page, main text): pages unlike the given ones, with and without marks, short and long."""
    a, b, c = f"<p>{SENTENCE}</p>", f"<h1>Title</h1><p>{SENTENCE}</p>", f"Title\n{SENTENCE}"
    yield f"<body><nav><a href=a>x</a></nav><article>{b}</article><aside><h3>More</h3>{a}</aside></body>", c
    yield f"<body><article>{b}<ol class=commentlist><li>{a}</li><li>me too</li></ol></article></body>", c
    yield f"<body><article>{b}</article><ol class=commentlist><li>{a}</li><li>me too</li></ol></body>", c
    yield f"<body><article>{b}<div class=newsletter>{a}</div><p>End.</p></article></body>", f"{c}\nEnd."
    yield f"<body><main><article>{b}<section id=comments><article class=comment>{a}</article></section></article></main></body>", c
    yield f"<body><header><h1>Site</h1></header><article><header><h1>Title</h1></header>{a}<footer>by me</footer></article></body>", c
    yield f"<body><div class=cookie-banner>We use cookies. {SENTENCE}</div><div>{b}</div></body>", c
    yield SENTENCE, SENTENCE
    yield "Some <b>bold</b> text", "Some bold text"
    yield f"<body>{b}</body>", c
    yield f"<body>{b}{a}</body>", f"{c}\n{SENTENCE}"
    yield "<body><nav><ul><li><a href=a>A</a></li></ul></nav><footer>c</footer></body>", ""
    for depth in (1, 5, 30, 1000):
        yield "<body>" + "<div>" * depth + b + "</div>" * depth + "</body>", c
        yield "<body>" + "<section>" * depth + b + "</section>" * depth + "</body>", c
    for size in (SENTENCE[:40], SENTENCE, SENTENCE * 2, SENTENCE * 5):
        for begin, end in (("<article>", "</article>"), ("<main>", "</main>"), ("<div id=content>", "</div>"), ("<div>", "</div>"), ("", "")):
            for before, after in (
                ("<header><a href=x>Logo</a></header><nav><a href=a>a</a> <a href=b>b</a></nav>", "<footer><p>c 2020</p></footer>"),
                ("<div class=topnav><a href=a>a</a></div>", f"<div class=related-posts><h3>Also</h3>{a}</div><div class=site-footer>{a}</div>"),
                ("", f"<aside>{a}</aside><section class=comments>{a}</section>"),
            ):
                for amid in ("", f"<div class=advertisement>{SENTENCE}</div>", f"<aside>{SENTENCE}</aside>", f"<form><label>x</label> {SENTENCE}</form>", "<ul class=share-buttons><li>a</li></ul>"):
                    yield f"<head><title>t</title></head><body>{before}{begin}<h1>Title</h1><p>{size}</p>{amid}<h2>Sub</h2><p>{size}</p><ul><li>One</li><li>{size}</li></ul>{end}{after}</body>", f"Title\n{size}\nSub\n{size}\nOne\n{size}"


@pytest.mark.parametrize("marked", [0, 400])
def test_pages_unlike_the_given(spark, marked):
    """By the module's own labelled pages alone, and with the given ones beside them."""
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(marked)
    model = html_text.fit_model(given)
    forms = list(page_forms())
    pages = [html_text.parsed(h) for h, _ in forms]
    got = [html_text.main_text(p, c) for p, c in zip(pages, model.content(pages), strict=True)]
    assert [(h[:200], g) for (h, w), g in zip(forms, got, strict=True) if g != w] == []


def test_pages_equal_a_plain_cut_of_the_article(spark):
    """On the given pages, whose article is marked: its blocks by regular expressions, model aside."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    import html as entities

    def plain(source):
        inner = re.search(r"<article[^>]*>(.*?)</article>", source, re.S)[1]
        inner = re.sub(r"<(script|style)[^>]*>.*?</\1>|<!--.*?-->", "", inner, flags=re.S)
        inner = re.sub(r"<(div|aside|form|section)\b[^>]*>.*?</\1>", "", inner, flags=re.S)
        blocks = re.split(r"</?(?:p|h\d|ul|ol|li|div|article|blockquote|pre)\b[^>]*>", inner)
        lines = [" ".join(entities.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br[^>]*>", " ", b))).split()) for b in blocks]
        return "\n".join(x for x in lines if x)

    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    wrong = [r.page_id for r in pages.collect() if got[r.page_id] != plain(r.html)]
    assert len(wrong) == 0


def test_toxic_words_are_learned_and_disguises_found(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("aeioubdlmnrst"), 6)) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary, 20)) + (" zgrokvix" if i % 3 == 0 else "") for i in range(300)]
    texts += ["hello zgr.okvix there", "hello zgroxkvix there", " ".join(vocabulary[:10]), None, ""]
    docs = _docs(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    machine = toxicity.fit_machine(docs, labels)
    score = {r.doc_id: r.score for r in toxicity.score(docs, machine).select("doc_id", "score").collect()}
    assert all((score[i] >= 0.3) == (i % 3 == 0) for i in range(300))
    assert score[300] >= 0.3 and score[301] >= 0.3 and max(score[i] for i in (302, 303, 304)) < 0.3


def test_mix(spark):
    rows = mixing.mix(_docs(spark, _texts())).collect()
    for source in {r.source for r in rows}:
        part = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in part) - part[0].target) <= 1 and all(0 <= r.taken <= 2 * r.size for r in part)


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    docs = _docs(spark, _texts())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, given, str(tmp_path))
            assert out.columns == docs.columns, name
            assert out.agg(F.count("*")).first()[0] >= 0
    ids = corpus_pipeline.run(spark, str(tmp_path))
    assert ids.columns == ["doc_id", "ids", "n_tokens"] and ids.count() > 0


@pytest.mark.parametrize("block", [32, 8], ids=["paired", "parted"])
def test_no_task_holds_a_whole_group_of_unlike_documents(spark, monkeypatch, block):
    rng = np.random.default_rng(5)
    shared = " ".join(f"s{i}" for i in range(60))
    texts = [f"{shared} " + " ".join(f"u{x}" for x in rng.integers(0, 10**9, 30)) for _ in range(300)]
    texts += [t + " end" for t in texts[:20]]
    held = []

    def watched(inner):
        def seen(places, *args, **options):
            held.append(places.groupBy("gid", "block").count().agg(F.max("count")).first()[0] or 0)
            return inner(places, *args, **options)

        return seen

    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "_joined", watched(jaccard._joined))
    monkeypatch.setattr(jaccard, "_screened", watched(jaccard._screened))
    rows = jaccard.jaccard_components(_docs(spark, texts), n=4, percent=85).orderBy("doc_id").collect()
    assert [r.component_id for r in rows] == [*range(300), *range(20)]
    assert len(held) == 3 and max(held) <= 4 * block  # two blocks, dealt by a hash


def test_jaccard_of_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(1500):  # over BLOCK: chains of copies that change a word at a time
        words = [*base]
        words[int(rng.integers(100))] = f"x{i}"
        texts.append(" ".join(words))
    texts += [" ".join([*base[:50], *(f"y{i}{j}" for j in range(50))]) for i in range(200)]  # unlike, with one passage in common
    texts += [texts[1500] + " end", *(" ".join(f"z{rng.integers(40)}" for _ in range(int(k))) for k in rng.integers(1, 60, 200))]
    sets = [_shingles(t, 4) for t in texts]
    links = []
    for a, b in itertools.combinations(range(len(sets)), 2):
        if min(len(sets[a]), len(sets[b])) * 100 >= 85 * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            links.append((a, b))
    rows = jaccard.jaccard_components(_docs(spark, texts), n=4, percent=85).orderBy("doc_id").collect()
    roots = list(range(len(sets)))

    def root(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for a, b in links:
        u, v = sorted((root(a), root(b)))
        roots[v] = u
    assert [r.component_id for r in rows] == [root(x) for x in range(len(sets))]


def test_telephone_numbers_of_every_leading_digit():
    names, numbers = pii.Pseudonyms(b"k"), [f"{d}17{rest}" for d in range(10) for rest in ("5557713", "5550000")]
    news = set()
    for n in numbers:
        forms = [f"+1 ({n[:3]}) {n[3:6]}-{n[6:]}", f"({n[:3]}) {n[3:6]}-{n[6:]}", f"{n[:3]}-{n[3:6]}-{n[6:]}", f"+1 {n[:3]} {n[3:6]} {n[6:]}"]
        made = [pii.pseudonymized(f"call {f} now", names) for f in forms]
        assert all(c == {"phone": 1} for _, c in made)
        digits = {re.sub(r"\D", "", t)[-10:] for t, _ in made}
        assert len(digits) == 1 and (new := digits.pop()) != n and (new[0] < "2") == (n[0] < "2")
        news.add(new)
    assert len(news) == len(numbers)


def test_numbers_followed_by_others_are_found_and_stay_equal():
    names = pii.Pseudonyms(b"k")
    pairs = [("4111 1111 1111 1111", ["123", "12", "7 2024"]), ("4111111111111111", ["12", "1"]), ("4111-1111-1111-1111", ["12"])]
    pairs += [("ES91 2100 0418 4502 0005 1332", ["EUR", "PAID", "12"]), ("ES9121000418450200051332", ["EUR"]), ("GB82 WEST 1234 5698 7654 32", ["EUR"])]
    pairs += [("+33 1 23 45 67 89", ["12", "7"]), ("+44 20 7946 0958", ["12"])]
    for number, after in pairs:
        alone, counts = pii.pseudonymized(f"pay {number}, now", names)
        assert sum(counts.values()) == 1 and number not in alone
        new = alone[4:-5]
        for more in after:
            assert pii.pseudonymized(f"pay {number} {more}, now", names)[0] == f"pay {new} {more}, now"
    # A number before a card doesn't take a part of it away; mixed separators are still found.
    card = pii.pseudonymized("4111 1111 1111 1111", names)[0]
    for before in range(100):
        assert pii.pseudonymized(f"no {before:02d} 4111 1111 1111 1111.", names)[0] == f"no {before:02d} {card}."
    assert pii.pseudonymized("4111 1111-1111 1111", names)[1] == {"card": 1}


def test_more_kinds_of_values():
    names = pii.Pseudonyms(b"k")
    body = "MIIEpAIBAAKCAQEA7" * 12
    pairs = ["2021-03-04T12:00:00Z", "2001:db8:0:0:1:0:0:1", "2001:db8::1:0:0:1", "fe80::1ff:fe23:4567:890a", "4 March 2021", "March 4, 2021", "4th Mar 2021", "ghp_" + "a1B2" * 9, "sk_live_" + "x9Y8" * 6, f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"]
    for value in pairs:
        out, counts = pii.pseudonymized(f"see {value}, ok", names)
        assert sum(counts.values()) == 1 and value not in out and out.startswith("see ") and out.endswith(", ok"), value
        again, _ = pii.pseudonymized(f"and {value}.", names)
        assert again[4:-1] == out[4:-4], value
    assert pii.pseudonymized(pairs[1], names)[0] == pii.pseudonymized(pairs[2], names)[0]  # one address
    assert pii.pseudonymized("2021-03-04T12:00:00Z", names)[0][10:] == "T12:00:00Z"
    for clean in ("at 12:30:45 and 1:2", "std::vector", "30 February 2021", "sk-short"):
        assert pii.pseudonymized(clean, names) == (clean, {})
    rng = np.random.default_rng(1)  # long values are permuted as a whole: their ends change too
    for size in (20, 60, 400):
        s = "".join(rng.choice(list("abcdefghij"), size))
        new = names.text(s, "t")
        assert new[:10] != s[:10] and new[-10:] != s[-10:] and len(new) == size


def test_a_common_passage_is_sent_once_a_chunk(spark, monkeypatch):
    words = [f"w{i}" for i in range(41)]
    texts = [" ".join(words * 60) for _ in range(10)] + [" ".join(["x", *words[:36], "y", "z"]), " ".join(f"u{i}" for i in range(60)), " ".join(["v"] * 36)]
    docs, sent = _docs(spark, texts), []
    group = type(docs).groupBy

    def seen(df, *cols):
        if cols == ("bucket",):
            sent.append(df)
        return group(df, *cols)

    monkeypatch.setattr(type(docs), "groupBy", seen)
    out = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(docs, window=35).collect()}
    assert out == {i: (41 * 60, 41 * 60) for i in range(10)} | {10: (39, 36), 11: (60, 0), 12: (36, 36)}
    blocks, windows = (df.agg(F.sum("n")).first()[0] for df in sent)
    assert blocks <= 41 + 22 + 43 + 1 and windows <= 41 + 5 + 1
