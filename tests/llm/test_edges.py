"""Nulls, empty and very long texts, repeated rows, empty tables and columns with clashing names: no crash, a defined result."""

import numpy as np
import public_tokenizers
import pytest

from meshspark.llm import ann, bpe, html_text, jaccard, mixing, neardup, pii, substring, token_files, toxicity

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS_FILE = public_tokenizers.path("word_bpe_49k.json")
#: Names that the operators use inside.
CLASH = ["n", "key", "part", "chunk", "rep", "score", "size", "h1", "skey", "keys", "target", "taken", "ids", "class_id", "component", "_skey", "_cut", "_times", "_copy", "_gone", "words"]
TEXTS = [(None, None), (None, None), (1, ""), (1, ""), (2, " \n\t "), (3, "word " * 30_000), (4, "word " * 30_000), (5, "one two three four five six"), (5, "one two three four five six"), (None, "one two three four five six")]


def _docs(spark, texts):
    schema = ", ".join(["doc_id long, text string, source string", *(f"`{c}` string" for c in CLASH)])
    return spark.createDataFrame([(i, t, None, *["x"] * len(CLASH)) for i, t in texts], schema)


def _token_files(docs, tmp_path):
    out = f"{tmp_path}/tokens"
    token_files.write_token_files(docs, out, WORDS_FILE, n_terminals=49_408, end=1)
    return token_files.digest_token_files(docs.sparkSession, out, n_terminals=49_408)


#: Operators that give a row for each document.
EACH = {
    "pii": lambda d, p: pii.pseudonymize(d, key=b"k", counted="n"),
    "bpe": lambda d, p: bpe.decode(bpe.encode(d, RANKS, public_tokenizers.PATTERN), RANKS),
    "jaccard": lambda d, p: jaccard.jaccard_components(d),
    "tokens": _token_files,
    "mix": lambda d, p: mixing.mix(d),
    "substring": lambda d, p: substring.remove_repeats(d),
}


@pytest.mark.parametrize("name", EACH)
@pytest.mark.parametrize("texts", [TEXTS, []], ids=["edges", "empty"])
def test_a_row_for_each_document(spark, tmp_path, name, texts):
    got = EACH[name](_docs(spark, texts), tmp_path).collect()
    assert len(got) == len(texts)
    assert sorted(map(str, (r["doc_id"] for r in got))) == sorted(str(i) for i, _ in texts)


def test_jaccard_edges(spark):
    rows = jaccard.jaccard_components(_docs(spark, TEXTS)).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {(None, None), (1, 1), (2, 2), (3, 3), (4, 3), (5, 5)}
    assert {r.n_shingles for r in rows if r.doc_id in (1, 2)} == {0}


def test_substring_edges(spark):
    rows = {(r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(_docs(spark, TEXTS)).collect()}
    assert rows == {(None, 0, 0), (None, 6, 0), (1, 0, 0), (2, 0, 0), (3, 30_000, 30_000), (4, 30_000, 30_000), (5, 6, 0)}


def test_stages_keep_clashing_columns(spark):
    docs = _docs(spark, TEXTS)
    labels = spark.createDataFrame([(5, None, None), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")
    for given in (docs, docs.limit(0)):
        for out in (toxicity.clean_documents(given, labels), jaccard.one_of_each(given), mixing.mixed_documents(given)):
            assert out.columns == docs.columns
            assert all(r[c] == "x" for r in out.collect() for c in CLASH)
    kept = sorted(str(r.doc_id) for r in jaccard.one_of_each(docs).collect())
    assert kept == sorted(map(str, [None, None, None, 1, 1, 2, 3, 5, 5]))


VECTORS = [(None, [1.0, 0.0]), (0, None), (50, [0.0, 0.0]), (100, [float("inf"), 1.0]), (150, [1.0, None]), (200, [1.0, 0.0]), (200, [1.0, 0.0]), (7, [2.0, 0.0]), (8, [0.0, 1.0]), (9, []), (10, [1.0, 0.0, 0.0])]


def _vectors(spark, rows):
    names = ["rep", "dim", "vec", "n", "p", "part", "ids", "links", "peer", "component", "label"]
    schema = ", ".join(["vec_id long, embedding array<double>", *(f"`{c}` string" for c in names)])
    return spark.createDataFrame([(i, v, *["x"] * len(names)) for i, v in rows], schema)


def test_embedding_edges(spark):
    rows = neardup.near_duplicates(_vectors(spark, VECTORS)).collect()
    got = {(r.vec_id, r.n_links, r.component_id) for r in rows}
    assert len(rows) == len(VECTORS)
    assert {(0, 0, 0), (50, 0, 50), (100, 0, 100), (150, 0, 150), (200, 2, 7), (7, 2, 7), (8, 0, 8), (9, 0, 9), (10, 0, 10)} <= got
    assert neardup.near_duplicates(_vectors(spark, [])).count() == 0


def test_nearest_edges(spark):
    rows = ann.nearest(_vectors(spark, VECTORS), k=5, every=50).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in rows] == [(200, 1, 7), (200, 2, 8)]
    assert ann.nearest(_vectors(spark, []), k=5).count() == 0


def test_page_edges(spark):
    rows = [(None, None, None, "x"), (None, None, None, "x"), (1, "u", "", "x"), (2, "u", "<p>" * 3000 + "a", "x"), (3, "u", "<article>" + "<p>one word more.</p>" * 5000 + "</article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert len(got) == 5 and {r.text for r in got if r.page_id in (None, 1)} == {""}
    assert next(r.text for r in got if r.page_id == 3).count("\n") == 4999
    assert html_text.extract(pages.limit(0)).count() == 0


def test_neighbours_of_every_dimension(spark):
    """A common dimension, one with routers of its own and rare ones: each query's neighbours are of its own dimension."""
    rng = np.random.default_rng(8)
    dims = [8] * 500 + [5] * 200 + [3] * 7 + [2]
    rows = [(i, rng.standard_normal(d).tolist()) for i, d in enumerate(dims)]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=1, rows_per_part=32).collect()
    got = {}
    for r in out:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    found = total = 0
    for i, v in rows:
        x = np.array(v)
        all_of = sorted((-(x @ np.array(w)) / np.sqrt((x @ x) * (np.array(w) @ np.array(w))), j) for j, w in rows if j != i and len(w) == len(v))[:5]
        mine = sorted(got.get(i, []))
        assert all(dims[j] == dims[i] for _, j, _ in mine) and [r for r, _, _ in mine] == list(range(1, len(mine) + 1))
        if dims[i] < 5:
            assert [j for _, j, _ in mine] == [j for _, j in all_of]
        found, total = found + len({j for _, j, _ in mine} & {j for _, j in all_of}), total + len(all_of)
    assert found >= 0.9 * total
