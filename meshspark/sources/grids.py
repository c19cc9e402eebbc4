"""Structured grids, and tables of the driver's schema read as grids."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mesh:
    """nodes(node_id, x, y[, z]), elements(elem_id, conn array<long>) and the element type."""

    nodes: DataFrame
    elements: DataFrame
    etype: str


def _cells(spark: SparkSession, nx: int, ny: int) -> DataFrame:
    cell = spark.range(nx * ny).select(F.col("id").alias("cell"), F.expr(f"id div {max(ny, 1)}").alias("i"), F.expr(f"id % {max(ny, 1)}").alias("j"))
    at = lambda di, dj: (F.col("i") + di) * F.lit(ny + 1) + F.col("j") + dj
    return cell.select("cell", at(0, 0).alias("sw"), at(1, 0).alias("se"), at(1, 1).alias("ne"), at(0, 1).alias("nw"))


def grid_nodes(spark: SparkSession, x: tuple[float, float], y: tuple[float, float], nx: int, ny: int) -> DataFrame:
    """(nx + 1)(ny + 1) nodes; the id counts along y first."""
    i, j = F.expr(f"id div {ny + 1}"), F.expr(f"id % {ny + 1}")
    span = lambda k, lo, hi, n: F.lit(float(lo)) + k / F.lit(float(max(n, 1))) * F.lit(float(hi - lo))
    return spark.range((nx + 1) * (ny + 1)).select(F.col("id").alias("node_id"), span(i, *x, nx).alias("x"), span(j, *y, ny).alias("y"))


def _triangles(cells: DataFrame) -> DataFrame:
    both = F.posexplode(F.array(F.array("sw", "se", "ne"), F.array("sw", "ne", "nw"))).alias("half", "conn")
    return cells.select("cell", both).select((2 * F.col("cell") + F.col("half")).alias("elem_id"), "conn")


def _quads(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("cell").alias("elem_id"), F.array("sw", "se", "ne", "nw").alias("conn"))


def triangles(spark: SparkSession, nx: int, ny: int) -> DataFrame:
    """Two triangles for each of nx * ny cells, cut along the rising diagonal, counter-clockwise."""
    return _triangles(_cells(spark, nx, ny))


def quads(spark: SparkSession, nx: int, ny: int) -> DataFrame:
    """One counter-clockwise quadrilateral for each of nx * ny cells."""
    return _quads(_cells(spark, nx, ny))


def rectangle(spark: SparkSession, x: tuple[float, float], y: tuple[float, float], nx: int, ny: int, kind: str = "tri3") -> Mesh:
    return Mesh(grid_nodes(spark, x, y, nx, ny), (triangles if kind == "tri3" else quads)(spark, nx, ny), kind)


def cells_per_side(rows: int) -> int:
    """Cells per side of the largest square grid that so many rows have nodes for; 0 if too few."""
    return max(math.isqrt(rows) - 1, 0)


def table_cells(spark: SparkSession, rows: int, n: int) -> DataFrame:
    """The cells of a grid of n cells in y whose four nodes are among the first so many rows."""
    columns = max(-(-rows // (n + 1)) - 1, 0) if n else 0
    return _cells(spark, columns, n).filter(F.col("ne") < rows)


def table_grid(table: DataFrame, key: str, kind: str = "tri3") -> Mesh:
    """A table with dense ids as nodes of columns of a unit square, the last one partly filled: all rows are nodes. The rows are only counted here."""
    spark, rows = table.sparkSession, table.count()
    n = cells_per_side(rows)
    m, cells = n + 1, table_cells(spark, rows, n)
    unit = F.lit(float(max(n, 1)))
    nodes = table.select(F.col(key).cast("long").alias("node_id"), (F.expr(f"`{key}` div {m}") / unit).alias("x"), (F.expr(f"`{key}` % {m}") / unit).alias("y"))
    return Mesh(nodes, (_triangles if kind == "tri3" else _quads)(cells), kind)


def unit_square(spark: SparkSession, nx: int, ny: int, kind: str = "tri3", dim: int = 2) -> Mesh:
    """The unit square; with dim 3 at z = 0."""
    mesh = rectangle(spark, (0.0, 1.0), (0.0, 1.0), nx, ny, kind)
    return mesh if dim == 2 else replace(mesh, nodes=mesh.nodes.withColumn("z", F.lit(0.0)))


def line_mesh(spark: SparkSession, n: int, length: float = 1.0) -> Mesh:
    """n nodes on a line in two dimensions."""
    nodes = spark.range(n).select(F.col("id").alias("node_id"), (F.col("id") / F.lit(float(max(n - 1, 1))) * F.lit(float(length))).alias("x"), F.lit(0.0).alias("y"))
    return Mesh(nodes, spark.range(max(n - 1, 0)).select(F.col("id").alias("elem_id"), F.array("id", F.col("id") + 1).alias("conn")), "line2")


def box(spark: SparkSession, lengths: tuple[float, float, float], cells: tuple[int, int, int], kind: str = "tet4") -> Mesh:
    """A box of hexahedra, or of six tetrahedra to a cell, one for each order of the axes; z counts first."""
    nx, ny, nz = cells
    step = {"x": (ny + 1) * (nz + 1), "y": nz + 1, "z": 1}
    i, j, k = F.expr(f"id div {step['x']}"), F.expr(f"id div {nz + 1} % {ny + 1}"), F.expr(f"id % {nz + 1}")
    at = lambda c, n, length: c / F.lit(float(max(n, 1))) * F.lit(float(length))
    nodes = spark.range((nx + 1) * step["x"]).select(F.col("id").alias("node_id"), at(i, nx, lengths[0]).alias("x"), at(j, ny, lengths[1]).alias("y"), at(k, nz, lengths[2]).alias("z"))
    low = F.expr(f"id div {max(ny * nz, 1)} * {step['x']} + id div {max(nz, 1)} % {max(ny, 1)} * {step['y']} + id % {max(nz, 1)}")
    cell = spark.range(nx * ny * nz).select(F.col("id").alias("cell"), low.alias("low"))
    if kind == "hex8":
        ring = [(0, 0), (1, 0), (1, 1), (0, 1)]
        ends = F.array(*(F.col("low") + a * step["x"] + b * step["y"] + c for c in (0, 1) for a, b in ring))
        return Mesh(nodes, cell.select(F.col("cell").alias("elem_id"), ends.alias("conn")), kind)
    paths = []
    for order in itertools.permutations("xyz"):
        at_one = [0, step[order[0]], step[order[0]] + step[order[1]], sum(step.values())]
        if order not in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y")):  # odd: turned round
            at_one[1], at_one[2] = at_one[2], at_one[1]
        paths.append(F.array(*(F.col("low") + o for o in at_one)))
    six = cell.select("cell", F.posexplode(F.array(*paths)).alias("part", "conn"))
    return Mesh(nodes, six.select((6 * F.col("cell") + F.col("part")).alias("elem_id"), "conn"), "tet4")


def read_mesh(nodes: DataFrame, elements: DataFrame, etype: str, check: bool = True) -> Mesh:
    """A mesh of given tables nodes(node_id, x[, y, z]) and elements(elem_id, conn), cast; unsound ones are an error if checked."""
    axes = [c for c in ("x", "y", "z") if c in nodes.columns]
    n = nodes.select(F.col("node_id").cast("long").alias("node_id"), *(F.col(c).cast("double").alias(c) for c in axes))
    e = elements.select(F.col("elem_id").cast("long").alias("elem_id"), F.col("conn").cast("array<bigint>").alias("conn"))
    mesh = Mesh(n, e, etype)
    if check and (bad := validate(mesh).filter("n > 0").collect()):  # a row for each kind of problem
        raise ValueError("unsound mesh: " + ", ".join(f"{r.problem}: {r.n}" for r in bad))
    return mesh


def set_coords(mesh: Mesh, new: DataFrame) -> Mesh:
    """The mesh with new(node_id, x[, y, z]) for the nodes that it names; the others stay, unknown ids are left out."""
    axes = [c for c in ("x", "y", "z") if c in mesh.nodes.columns]
    given = new.select("node_id", *(F.col(c).alias(f"_{c}") for c in axes))
    moved = mesh.nodes.join(given, "node_id", "left").select("node_id", *(F.coalesce(f"_{c}", c).alias(c) for c in axes))
    return replace(mesh, nodes=moved)


def select_nodes(mesh: Mesh, axis: str, at: str | float) -> DataFrame:
    """node_id where a coordinate is near a value, or its own "min" or "max"; near as 1e-8 + 1e-5 of the value."""
    value = F.lit(at) if not isinstance(at, str) else F.col("_v")
    nodes = mesh.nodes if not isinstance(at, str) else mesh.nodes.crossJoin(F.broadcast(mesh.nodes.agg(F.expr(f"{at}({axis})").alias("_v"))))  # one row
    return nodes.filter(F.abs(F.col(axis) - value) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(value)).select("node_id")


def pair_boundaries(mesh: Mesh, left: DataFrame, right: DataFrame, by: str, width: float | None = None) -> DataFrame:
    """dof, master: nodes of two sides in the order of a coordinate, ties by id: the first with the first, and so on.

    Sides are ranked in slots of the coordinate, on top of the counts of the slots before; without a
    width a slot is a 4096th of the sides' extent. Each slot is sorted by itself.
    """
    every = mesh.nodes.select("node_id", F.col(by).alias("_c"))
    sides = every.join(left.unionByName(right).distinct(), "node_id", "left_semi")
    low, high = sides.agg(F.min("_c"), F.max("_c")).first()
    width = width or max(((high or 0.0) - (low or 0.0)) / 4096, 1e-300)
    slot = F.floor((F.col("_c") - F.lit(low or 0.0)) / F.lit(width)).cast("long").alias("_slot")

    def ranked(side: DataFrame, name: str) -> DataFrame:
        s = every.join(side.select("node_id").distinct(), "node_id", "left_semi").select("node_id", "_c", slot)
        before = F.coalesce(F.sum("_n").over(W.orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        starts = s.groupBy("_slot").agg(F.count("*").alias("_n")).select("_slot", before.alias("_start"))  # a row for each slot
        within = F.row_number().over(W.partitionBy("_slot").orderBy("_c", "node_id"))
        return s.withColumn("_in", within).join(F.broadcast(starts), "_slot").select(F.col("node_id").alias(name), (F.col("_start") + F.col("_in")).alias("_r"))

    return ranked(left, "dof").join(ranked(right, "master"), "_r").select("dof", "master")


def validate(mesh: Mesh) -> DataFrame:
    """problem, n: nulls, repeated ids, elements of a wrong size, ends without a node. All n are 0 in a sound mesh."""
    from ..functions.basis import ELEMENTS

    nodes, elements, size = mesh.nodes, mesh.elements, len(ELEMENTS[mesh.etype].nodes)
    ends = elements.select(F.explode("conn").alias("node_id"))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
    parts = [
        count(nodes.filter(F.expr("node_id IS NULL OR node_id < 0 OR " + " OR ".join(f"{c} IS NULL OR isnan({c}) OR abs({c}) = double('inf')" for c in ("x", "y", "z") if c in nodes.columns))), "bad node"),
        count(nodes.groupBy("node_id").count().filter("count > 1"), "repeated node"),
        count(elements.groupBy("elem_id").count().filter("count > 1"), "repeated element"),
        count(elements.filter(F.col("conn").isNull() | (F.size("conn") != size)), "wrong size"),
        count(ends.join(nodes.select("node_id"), "node_id", "left_anti"), "missing node"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
