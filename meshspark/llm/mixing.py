"""Mixing sources to target weights, in DataFrame functions alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import WORD, materialize, only

WEIGHTS = (5, 2, 1)
SHARE, MAX_EPOCHS, ROWS_PER_RANGE, KEY_BITS = 1.5, 2, 4096, 60


def word_count(text: Column | str) -> Column:
    """Words of a text; null: 0."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def hash_key(doc_id: Column, seed: str) -> Column:
    """A uniform key of 60 bits from the id alone, so that reruns agree."""
    digest = F.md5(F.concat(F.lit(seed), F.lit("|"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sources: DataFrame, share: float, max_epochs: int, weights: tuple[int, ...]) -> DataFrame:
    """sources(skey, source, source_size) with weight and target.

    Water filling in closed form: by rising cap/weight, a source is capped as long as filling all
    to its level takes no more than the budget. One row for each source, so one small window.
    """
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    by_level = W.orderBy("level", F.col("source").asc_nulls_last())
    whole = W.partitionBy()
    s = sources.withColumn("weight", F.get(cycle, nth % len(weights))).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    s = s.withColumn("level", F.col("cap") / F.col("weight")).withColumn("budget", F.sum("source_size").over(whole) * F.lit(share))
    below = F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    above = F.sum("weight").over(by_level.rowsBetween(W.currentRow, W.unboundedFollowing))
    s = s.withColumn("capped", below + F.col("level") * above <= F.col("budget"))
    taken = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(whole), F.lit(0.0))
    free = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(whole)
    s = s.withColumn("fill", (F.col("budget") - taken) / free)
    return s.select("skey", "source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("fill")).alias("target"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", share: float = SHARE, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """Words that a mix of the sources takes from every document.

    Every document gets a hash-random key from its id. Keys are uniform, so equal intervals of them
    are even ranges: each source is range-sorted by (source, interval) and prefix sums of sizes run
    within an interval, on top of the sums of the intervals before it. The source's target is then
    cut at its exact word: whole epochs first, then documents in key order, the last one in part.

    Nulls: a null source is a source of its own, last in order; a null text has size 0; a null id is
    hashed as an empty one. Rows with equal ids tie in the key and are ordered by size. An empty
    table gives no rows. Other columns are ignored.

    Returns doc_id, source, key, size, source_size, target, epochs, taken.
    """
    d = only(docs, doc_id=doc_id, source=source, text=text)
    d = d.select("doc_id", "source", word_count("text").alias("size"), hash_key(F.col("doc_id"), seed).alias("key"))
    d = materialize(d, "mix")
    skey = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    ranges = max(16, math.ceil(d.count() / ROWS_PER_RANGE))
    d = d.withColumn("skey", skey).withColumn("part", F.expr(f"key div {2**KEY_BITS // ranges + 1}"))

    parts = d.groupBy("skey", "part").agg(F.first("source").alias("source"), F.sum("size").alias("part_size"))
    before = W.partitionBy("skey").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select("skey", "part", F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("start"))
    sources = parts.groupBy("skey").agg(F.first("source").alias("source"), F.sum("part_size").alias("source_size"))
    targets = source_targets(sources, share, max_epochs, weights).drop("source")
    plan = starts.join(targets, "skey")

    within = W.partitionBy("skey", "part").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    d = d.join(plan, ["skey", "part"]).withColumn("cum", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    d = d.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    rest = F.floor(F.col("target")) - F.col("epochs") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("cum")))
    return d.select("doc_id", "source", "key", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, *, most_sources: int = 100_000, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken; all columns stay.

    The texts don't move: a source's cut is a key, and the small table of cuts goes to the documents
    (broadcast while it has at most most_sources rows, else joined). A document at the cut is in if
    at least half of its words are. Documents without words follow their key. Columns of docs keep
    their names and values whatever they are called.
    """
    doc_id, source = options.get("doc_id", "doc_id"), options.get("source", "source")
    seed = options.get("seed", "mix")
    taken = mix(docs, **options)
    skey = lambda c: F.when(c.isNull(), "n").otherwise(F.concat(F.lit("s"), c))
    extra = F.col("taken") - F.col("epochs") * F.col("size")
    inside = (F.col("size") > 0) & (2 * extra >= F.col("size"))
    stem = "_"
    while any(c.startswith(stem) for c in docs.columns):
        stem += "_"
    key, epochs, cut, times = (f"{stem}{c}" for c in ("skey", "epochs", "cut", "times"))
    cuts = taken.groupBy(skey(F.col("source")).alias(key)).agg(F.max("epochs").alias(epochs), F.max(F.when(inside, F.col("key"))).alias(cut))
    cuts = materialize(cuts, "cuts")
    cuts = F.broadcast(cuts) if cuts.count() <= most_sources else cuts
    again = F.when(hash_key(F.col(f"`{doc_id}`"), seed) <= F.col(cut), 1).otherwise(0)
    out = docs.withColumn(key, skey(F.col(f"`{source}`"))).join(cuts, key)
    out = out.withColumn(times, (F.col(epochs) + again).cast("int")).filter(F.col(times) > 0)
    return out.withColumn(f"{stem}copy", F.explode(F.sequence(F.lit(1), F.col(times)))).select(*(F.col(f"`{c}`") for c in docs.columns))
