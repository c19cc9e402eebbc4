"""One query for each operator, over whole tables read as grids, points and matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, fields, locate, matrices, parts
from ..operators import constraints as C
from ..operators.cut import written
from ..sources.grids import Mesh, cells_per_side, table_grid, validate

PARTS = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _grid(spark: SparkSession, sf_dir: str, kind: str = "tri3") -> Mesh:
    return table_grid(_table(spark, sf_dir, "part"), "p_partkey", kind)


def _field(spark: SparkSession, sf_dir: str, column: str = "p_retailprice") -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("node_id"), F.col(column).cast("double").alias("v"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda by, mod: (F.col("event_id") * by % mod) / F.lit(float(mod)) * F.lit(1.2) - F.lit(0.1)
    return _table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("point_id"), at(7919, 1009).alias("px"), at(104729, 1013).alias("py"))


def _quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").cast("long").alias("elem_id"))
    return items.agg(F.sum(F.col("l_quantity").cast("double")).alias("quantity"))


def _coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("long").alias("row"), F.col("l_partkey").cast("long").alias("col"))
    return items.agg(F.sum(F.col("l_quantity").cast("double")).alias("v"))


def _parted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as elements whose nodes are the parts ordered, with the part of each: eight runs of orders."""
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    items = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("elem_id")).agg(lines.alias("_l"))
    n = _table(spark, sf_dir, "orders").count()
    return items.select("elem_id", F.col("_l.l_partkey").cast("array<bigint>").alias("conn"), parts.chunks(F.col("elem_id"), n, PARTS).alias("part"))


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The same as elements, and the partition of them."""
    both = _parted_orders(spark, sf_dir)
    return both.select("elem_id", "conn"), both.select("elem_id", "part")


def _r(c: Column | str, places: int = 6) -> Column:
    return F.round(c, places)


def s2_rectangle_tri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).elements.select("elem_id", *(F.col("conn")[k].alias(f"n{k}") for k in range(3)))


def s3_rectangle_quad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir, "quad4").elements.select("elem_id", *(F.col("conn")[k].alias(f"n{k}") for k in range(4)))


def s6_validate_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(_grid(spark, sf_dir))


def e14_diameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.diameters(_grid(spark, sf_dir)).select("elem_id", _r("diameter", 9).alias("diameter"))


def a3_mesh_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.diameters(_grid(spark, sf_dir, "quad4")).agg(_r(F.min("diameter"), 9).alias("hmin"), _r(F.max("diameter"), 9).alias("hmax"))


def g3_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.evaluate(_grid(spark, sf_dir, "quad4"), _field(spark, sf_dir)).select("elem_id", "q", _r("v").alias("v"))


def g4_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.gradient(_grid(spark, sf_dir), _field(spark, sf_dir)).select("elem_id", "q", "d", _r("v", 4).alias("v"))


def g5_quad_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.quad_points(_grid(spark, sf_dir, "quad4")).select("elem_id", "q", _r("x", 9).alias("x"), _r("y", 9).alias("y"))


def g6_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.integration_weights(_grid(spark, sf_dir, "quad4")).select("elem_id", "q", _r("wt", 9).alias("wt"))


def g7_map_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The field at each point times the quantity ordered of the element's part (its id modulo their number); null where none was ordered."""
    mesh, n = _grid(spark, sf_dir), _table(spark, sf_dir, "part").count()
    kernel = lambda mesh: fields.value(mesh, "u") * F.col("quantity")
    quantity = mesh.elements.select("elem_id", (F.col("elem_id") % n).alias("_p")).join(_quantity(spark, sf_dir).withColumnRenamed("elem_id", "_p"), "_p").drop("_p")
    return fields.map_quads(mesh, kernel, quantity=quantity, u=_field(spark, sf_dir)).select("elem_id", "q", _r("v", 4).alias("v"))


def g8_map_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = F.array_max("u") - F.array_min("u")
    return fields.map_elements(_grid(spark, sf_dir), spread, u=_field(spark, sf_dir)).select("elem_id", _r("v").alias("v"))


def a1_integrate_per_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = fields.map_quads(_grid(spark, sf_dir, "quad4"), lambda m: fields.value(m, "u"), u=_field(spark, sf_dir))
    return fields.per_element(mapped).select("elem_id", _r("v").alias("v"))


def a2_integrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = fields.map_quads(_grid(spark, sf_dir), lambda m: fields.value(m, "u"), u=_field(spark, sf_dir))
    return mapped.agg(_r(F.sum("wt")).alias("measure"), _r(F.sum(F.col("v") * F.col("wt")), 4).alias("integral"))


def a2_dirichlet_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = fields.map_quads(_grid(spark, sf_dir), fields.dirichlet, u=_field(spark, sf_dir))
    return mapped.agg(F.count("*").alias("n_points"), _r(F.sum(F.col("v") * F.col("wt")), 2).alias("energy"))


def k3_linear_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = fields.map_quads(_grid(spark, sf_dir), fields.linear_energy(*fields.lame(1.0, 0.3)), u=_field(spark, sf_dir), w=_field(spark, sf_dir, "p_size"))
    return fields.per_element(mapped).select("elem_id", _r("v", 4).alias("v"))


def p11_linear_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = _grid(spark, sf_dir)
    return fields.linear_form(mesh, fields.value(mesh, "u"), u=_field(spark, sf_dir)).select("node_id", _r("v").alias("v"))


def p12_stiffness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.bilinear_form(_grid(spark, sf_dir), stiffness=F.lit(1.0)).select("row", "col", (_r("v", 9) + 0.0).alias("v"))


def p13_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.bilinear_form(_grid(spark, sf_dir, "quad4"), mass=F.lit(1.0)).select("row", "col", _r("v", 9).alias("v"))


def p1_mesh_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrices.mesh_pattern(_orders(spark, sf_dir)[0], dofs=2)


def p3_term_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    dep = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("term_id"), F.col("l_partkey").cast("long").alias("dof"))
    return matrices.term_pattern(dep)


def u5_asymmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrices.asymmetric(_coo(spark, sf_dir).select("row", "col"))


def a7_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrices.row_counts(_coo(spark, sf_dir), _table(spark, sf_dir, "supplier").count())


def w3_row_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrices.row_pointer(_coo(spark, sf_dir), _table(spark, sf_dir, "supplier").count())


def p14_matvec(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _field(spark, sf_dir).withColumnRenamed("node_id", "dof")
    return matrices.matvec(_coo(spark, sf_dir), x).select("row", _r("v", 2).alias("v"))


def j1_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.locate(_grid(spark, sf_dir), _points(spark, sf_dir))


def j2_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate.interpolate(_grid(spark, sf_dir), _field(spark, sf_dir), _points(spark, sf_dir)).select("point_id", "elem_id", _r("v").alias("v"))


def a6_node_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.node_owner(*_orders(spark, sf_dir))


def w1_local_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.local_nodes(_parted_orders(spark, sf_dir))


def w2_part_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.offsets(w1_local_nodes(spark, sf_dir))


def j8_halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.halo(w1_local_nodes(spark, sf_dir))


def _constrained(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, C.Constraints]:
    """The grid's unknowns, one a node, with the price: fixed to 0 at the bottom, left side tied to the right."""
    mesh = _grid(spark, sf_dir)
    n = cells_per_side(_table(spark, sf_dir, "part").count())
    vec = mesh.nodes.select("node_id").join(_field(spark, sf_dir), "node_id").select(F.col("node_id").alias("dof"), "v")
    dofs = mesh.nodes.select(F.col("node_id").alias("dof"))
    fixed = C.Fixed(dofs.filter(F.col("dof") % (n + 1) == 0).select("dof", F.lit(0.0).alias("value")))
    tied = C.Periodic(dofs.filter(F.col("dof") <= n).select("dof", (F.col("dof") + n * (n + 1)).alias("master")))
    return dofs, vec, [fixed, tied]


def w7_free_dofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    dofs, _, cs = _constrained(spark, sf_dir)
    return C.free_dofs(dofs, cs).select("dof", "reduced")


def l2_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    dofs, vec, cs = _constrained(spark, sf_dir)
    free = C.free_dofs(dofs, cs)
    lifted = C.lift(C.reduce(vec, free), dofs.withColumn("v", F.lit(0.0)), free, cs)
    return lifted.select("dof", _r("v").alias("v"))


def l5_reduce_adjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    dofs, vec, cs = _constrained(spark, sf_dir)
    return C.reduce_adjoint(vec, C.free_dofs(dofs, cs), cs).select("reduced", _r("v").alias("v"))


def l14_reduce_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reduced tangent of mass and stiffness: elements are summed by pairs of nodes before they meet the constraints."""
    dofs, _, cs = _constrained(spark, sf_dir)
    resolved = C.composed(cs).kept()
    form = lambda p: blocks.Form(mass=np.ones((1, 1)), diffusion=np.eye(2)[None, :, None, :])
    k = blocks.entries(blocks.block_matrix(_grid(spark, sf_dir), form, 1, 1), [(0, 1)], [(0, 1)])
    free = written(C.free_dofs(dofs, resolved), "free")
    return C.reduce_matrix(k, free, resolved).select("row", "col", (_r("v", 9) + 0.0).alias("v"))


QUERIES = {
    f.__name__: f
    for f in (
        s2_rectangle_tri, s3_rectangle_quad, s6_validate_mesh, e14_diameter, a3_mesh_size, g3_evaluate, g4_gradient, g5_quad_points, g6_weights, g7_map_quads, g8_map_elements,
        a1_integrate_per_element, a2_integrate, a2_dirichlet_energy, k3_linear_energy, p11_linear_form, p12_stiffness, p13_mass, p1_mesh_pattern, p3_term_pattern, u5_asymmetric,
        a7_row_counts, w3_row_pointer, p14_matvec, j1_locate, j2_interpolate, a6_node_owner, w1_local_nodes, w2_part_offsets, j8_halo, w7_free_dofs, l2_lift, l5_reduce_adjoint, l14_reduce_matrix,
    )
}
