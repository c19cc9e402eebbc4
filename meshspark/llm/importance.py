"""Importance resampling of documents towards a target distribution, by hashed word n-grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import materialize, only, utf8

BUCKETS, ORDER, SEED, MIN_WORDS, PERCENT = 10_000, 2, 7, 20, 25
#: Bytes of a text that are held as words at a time.
BLOCK = 1 << 20

#: Lower-cases A-Z, blanks the other ASCII bytes but digits and letters; bytes from 0x80 on are parts of UTF-8 letters and stay.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_blocks(text: bytes, block: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists for about `block` bytes each, cut at blanks."""
    clean, at = text.translate(TABLE), 0
    while at < len(clean):
        end = at + block
        if end < len(clean):
            end = clean.find(b" ", end)
            end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end


def feature_buckets(text: bytes, order: int, buckets: int, block: int = BLOCK) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end in them) for each block of a text.

    The crc32 of a run of words is that of the run without its last word, carried on over a blank
    and that word; the last order - 1 words of a block go before the next one.
    """
    tail: list[bytes] = []
    for words in word_blocks(text, block):
        every = tail + words
        spaced = [b" " + w for w in every]
        crcs = list(map(crc32, every))
        out = crcs[len(tail) :]
        for k in range(2, order + 1):
            crcs = list(map(crc32, spaced[k - 1 :], crcs))
            out += crcs[max(0, len(tail) - k + 1) :]
        yield len(words), np.array(out, np.uint32) % np.uint32(buckets)
        tail = every[-(order - 1) :] if order > 1 else []


def bucket_counts(texts: DataFrame, order: int, buckets: int) -> DataFrame:
    """bucket, n: features of all texts(text) by bucket. A task sends one row for each bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for batch in batches:
            found = (f for text in utf8(batch.column(0)) for _, f in feature_buckets(text, order, buckets))
            while len(some := [*islice(found, 256)]):
                at, n = np.unique(np.concatenate(some), return_counts=True)
                seen.update(dict(zip(at.tolist(), n.tolist(), strict=True)))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(seen.keys(), pa.int32()), "n": pa.array(seen.values(), pa.int64())})

    return texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """bucket, gain of every bucket: floor(1000 ln) of its share among the target's features against the source's, both plus one a bucket."""
    both = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    both = both.select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"))
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("gain"))


def weights(docs: DataFrame, gains: np.ndarray, order: int) -> DataFrame:
    """docs(doc_id, text) as doc_id, n_words, n_features, weight; the weight is the floored mean of the gains of a text's features, 0 without any."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in utf8(batch.column(1)):
                n_words = n = total = 0
                for new, found in feature_buckets(text, order, len(gains)):
                    n_words, n, total = n_words + new, n + len(found), total + int(gains[found].sum())
                rows.append((n_words, n, total // n if n else 0))
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """A Gumbel variate of the id, in floored thousandths; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df with rank, from 1 in the order given, ties in any order; a running number in ranges of the order, not in one window.

    The rows are written in their ranges with their places there; a row's rank is its place on top
    of the sizes of the ranges before. Equal rows are told apart by a number, so that any many of them
    spread over ranges.
    """
    free = F.monotonically_increasing_id()
    ranges = df.withColumn("_tie", free).repartitionByRange(*order, F.col("_tie")).sortWithinPartitions(*order, F.col("_tie"))
    placed = materialize(ranges.drop("_tie").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranked")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn("rank", (F.col("_start") + F.col("_at") + 1).cast("long")).drop("_part", "_at", "_start")


def resample(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """Every document with its importance for the target texts, and the rank of those drawn.

    Features are all runs of 1 to `order` consecutive words; their buckets are counted over all
    documents and all target texts, and each bucket gets a gain. A document's weight is its mean gain,
    its score the weight plus Gumbel noise of its id, so that the highest scores are a sample without
    replacement, drawn in proportion to the weights' exponentials. Of the documents with min_words
    words or more, `percent` in a hundred are drawn. The texts are read twice and never move; counts of
    `buckets` rows meet, and of the documents only numbers are sorted.

    Nulls: a null text has no words; a null id counts as empty in the noise and is the smallest in
    ties. Empty texts have weight 0. Rows with equal ids are documents of their own; where score and
    id tie, any goes first. Without target texts, or without documents, gains follow from counts of 0.
    Other columns are ignored. Returns doc_id, n_words, n_features, weight, score, rank (null where
    not drawn).
    """
    d, t = only(docs, doc_id=doc_id, text=text), only(target, text=target_text)
    gains = bucket_gains(bucket_counts(d, order, buckets), bucket_counts(t, order, buckets), buckets)
    table = np.zeros(buckets, np.int64)
    for bucket, gain in gains.collect():  # as many rows as buckets
        table[bucket] = gain
    scored = weights(d, table, order).withColumn("score", (F.col("weight") + noise(F.col("doc_id"), seed)).cast("long"))
    scored = materialize(scored, "scored")
    enough = F.col("n_words") >= min_words
    drawn = scored.filter(enough).count() * percent // 100
    places = ranked(scored.filter(enough), F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    places = places.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(~enough).withColumn("rank", F.lit(None).cast("long"))
    return places.unionByName(rest)
