"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every id of an edge, the smallest id that it reaches.

    Rounds of large-star and small-star: every node points its larger, then its smaller neighbours
    and itself, at its smallest neighbour, until the edges are stars. Each half is a partial minimum
    and one join on the node, so a hub's edges are never gathered; skewed joins are split by Spark.
    Every round is written to the shared folder and replaces the last there. Null ends and loops give no edges.
    """
    hi, lo = F.greatest(a, b), F.least(a, b)
    e = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(hi.alias("u"), lo.alias("v")).distinct()
    e = table = materialize(e, "edges")
    before = _state(e)
    while True:
        # Large star: neighbours above a node go to the smallest of the node and its neighbours.
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        up = e.join(low.withColumnRenamed("u", "v"), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
        e = up.distinct()
        # Small star: a node and its neighbours below it go to the smallest of them.
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        down = e.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m")), F.struct(F.col("v").alias("u"), F.col("m")))).alias("x")).select("x.u", F.col("x.m").alias("v"))
        last, e = table, materialize(down.filter("u <> v").distinct(), "edges")
        table = e
        discard(last)
        after = _state(e)
        if after == before:
            break
        before = after
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return stars.unionByName(roots)
