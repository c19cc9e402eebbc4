"""Matrices with a few dense rows and columns, kept beside a sparse core, and blocks by the slices of a packed state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constraints import AffineMap, Constraints, reduce_matrix, to_free
from .matrices import matvec
from .states import Layout

#: Shared unknowns that may have a dense row and column: their values are broadcast.
MOST_SHARED = 10_000


@dataclass(frozen=True)
class Bordered:
    """core(row, col, v) between unknowns that few others meet; rows(row, col, v) and cols(row, col, v) of shared unknowns with the others, corner(row, col, v) among shared ones, shared(dof).

    A shared unknown's row and column are vectors: its column meets the one value of x by a broadcast, and its
    row is a sum over all unknowns that combines before it moves, so that neither is a hot key.
    """

    core: DataFrame
    rows: DataFrame
    cols: DataFrame
    corner: DataFrame
    shared: DataFrame

    def coo(self) -> DataFrame:
        """row, col, v of all entries."""
        return self.core.unionByName(self.rows).unionByName(self.cols).unionByName(self.corner)

    def matvec(self, x: DataFrame) -> DataFrame:
        """row, v of the product with x(dof, v); rows without entries are absent."""
        few = F.broadcast(x.join(F.broadcast(self.shared), "dof", "left_semi").select(F.col("dof").alias("col"), F.col("v").alias("_x")))
        by_shared = self.cols.unionByName(self.corner).join(few, "col").select("row", (F.col("v") * F.col("_x")).alias("v"))
        parts = matvec(self.core, x).unionByName(by_shared).unionByName(matvec(self.rows, x))
        return parts.groupBy("row").agg(F.sum("v").alias("v"))

    def reduced(self, free: DataFrame, constraints: Constraints | AffineMap) -> Bordered:
        """T'KT in reduced numbers; shared unknowns must be free. Borders map their long end alone."""
        if not self.shared.join(free, "dof", "left_anti").isEmpty():
            raise ValueError("a shared unknown is constrained")
        to = to_free(free, constraints)
        number = F.broadcast(self.shared.join(free, "dof").select("dof", "reduced"))

        def border(entries: DataFrame, short: str, long: str) -> DataFrame:
            e = entries.join(number.select(F.col("dof").alias(short), F.col("reduced").alias("_s")), short)
            e = e.join(to.select(F.col("dof").alias(long), F.col("reduced").alias("_l"), "weight"), long)
            return e.groupBy(F.col("_s").alias(short), F.col("_l").alias(long)).agg(F.sum(F.col("v") * F.col("weight")).alias("v")).select("row", "col", "v")

        corner = self.corner.join(number.select(F.col("dof").alias("row"), F.col("reduced").alias("_r")), "row").join(number.select(F.col("dof").alias("col"), F.col("reduced").alias("_c")), "col")
        corner = corner.select(F.col("_r").alias("row"), F.col("_c").alias("col"), "v")
        return Bordered(reduce_matrix(self.core, free, constraints), border(self.rows, "row", "col"), border(self.cols, "col", "row"), corner, number.select(F.col("reduced").alias("dof")))


def bordered(coo: DataFrame, shared: DataFrame, most: int = MOST_SHARED) -> Bordered:
    """A matrix(row, col, v) parted by its shared(dof) unknowns, of which there may be `most`."""
    shared = shared.select("dof").distinct()
    if (n := shared.count()) > most:
        raise ValueError(f"{n} shared unknowns are too many for a border of {most}")
    mark = lambda end: F.broadcast(shared.select(F.col("dof").alias(end), F.lit(True).alias(f"_{end}")))
    marked = coo.select("row", "col", "v").join(mark("row"), "row", "left").join(mark("col"), "col", "left")
    part = lambda r, c: marked.filter(F.col("_row").isNotNull() if r else F.col("_row").isNull()).filter(F.col("_col").isNotNull() if c else F.col("_col").isNull()).select("row", "col", "v")
    return Bordered(part(False, False), part(True, False), part(False, True), part(True, True), shared)


def block_of(lay: Layout, dof: Column) -> Column:
    """The number of the root slice of a packed state that holds an unknown; null outside of the state."""
    starts = {}
    for p in lay.places.values():
        starts[p.block] = min(starts.get(p.block, p.base), p.base)
    out = F.lit(None).cast("int")
    for block, base in sorted(starts.items(), key=lambda x: x[1]):  # a slice for each field at most
        out = F.when(dof >= base, F.lit(block)).otherwise(out)
    return F.when((dof >= 0) & (dof < lay.size), out)


def block_counts(coo: DataFrame, lay: Layout) -> DataFrame:
    """block_row, block_col, n: entries by pair of root slices."""
    return coo.groupBy(block_of(lay, F.col("row")).alias("block_row"), block_of(lay, F.col("col")).alias("block_col")).agg(F.count("*").alias("n"))


def block_entries(coo: DataFrame, lay: Layout, block_row: int, block_col: int) -> DataFrame:
    """The entries of one block, in numbers of its slices."""
    base = {}
    for p in lay.places.values():
        base[p.block] = min(base.get(p.block, p.base), p.base)
    mine = coo.filter((block_of(lay, F.col("row")) == block_row) & (block_of(lay, F.col("col")) == block_col))
    return mine.withColumn("row", F.col("row") - F.lit(base[block_row])).withColumn("col", F.col("col") - F.lit(base[block_col]))


def layout_entries(elements: DataFrame, lay: Layout, subsets: dict[str, DataFrame] | None = None) -> DataFrame:
    """row, col of a packed state: nodal fields, on all nodes or on some, couple within elements; other unknowns with themselves alone.

    An element's unknowns are those of its nodes that a field has: subsets names, by field, the tables
    node_id, item of fields on some nodes (states.subset_items). Each pair is made unique as unknowns, so that a node which a
    field lacks costs nothing.
    """
    ends = elements.select("elem_id", F.explode("conn").alias("node_id"))
    at = None
    for name, p in lay.places.items():
        if p.field.kind != "nodal":
            continue
        items = ends.withColumn("item", F.col("node_id")) if p.field.nodes is None else ends.join((subsets or {})[name], "node_id")
        comps = F.explode(F.sequence(F.lit(0), F.lit(p.field.components - 1)))
        one = items.withColumn("_c", comps).select("elem_id", (F.lit(p.base).cast("long") + F.col("item") * p.stride + F.col("_c")).alias("dof"))
        at = one if at is None else at.unionByName(one)
    sets = at.groupBy("elem_id").agg(F.collect_set("dof").alias("_d"))  # the unknowns of one element
    out = sets.select(F.explode("_d").alias("row"), "_d").select("row", F.explode("_d").alias("col"))
    for p in lay.places.values():
        if p.field.kind != "nodal":
            alone = elements.sparkSession.range(p.base, p.base + p.field.shape[0] * p.field.components)
            out = out.unionByName(alone.select(F.col("id").alias("row"), F.col("id").alias("col")))
    return out.distinct()
