"""Queries of sources, packed states, constraints, patterns, solvers and exchanges between parts."""

from __future__ import annotations

import math
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.basis import with_quadrature
from ..operators import constraints as C
from ..operators import fields, matrices, parts, states
from ..operators.cut import folder, written
from ..sources import grids
from ..sources.grids import Mesh
from .work import PARTS, _constrained, _coo, _field, _grid, _orders, _parted_orders, _r, _table, w1_local_nodes


def _parts_count(spark: SparkSession, sf_dir: str) -> int:
    return _table(spark, sf_dir, "part").count()


def _long(name: str) -> Column:
    return F.col(name).cast("long")


# Sources and elements.


def s1_read_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _grid(spark, sf_dir)
    text = given.nodes.select(*(F.col(c).cast("string").alias(c) for c in given.nodes.columns))
    mesh = grids.read_mesh(text, given.elements.withColumn("conn", F.col("conn").cast("array<int>")), "tri3")
    return mesh.elements.select("elem_id", *(F.col("conn")[k].alias(f"n{k}") for k in range(3)))


def s4_unit_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A square with room for all rows, and their values on its nodes; nodes of the last column that no row fills have none."""
    rows = _parts_count(spark, sf_dir)
    n = grids.cells_per_side(rows)
    mesh = grids.unit_square(spark, max(-(-rows // (n + 1)) - 1, 0), n, "quad4", dim=3)
    return mesh.nodes.join(_field(spark, sf_dir), "node_id", "left").select("node_id", _r("x", 9).alias("x"), _r("y", 9).alias("y"), "z", "v")


def s7_set_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = _grid(spark, sf_dir)
    big = _field(spark, sf_dir, "p_size").filter("v > 25")
    new = mesh.nodes.join(big, "node_id").select("node_id", (F.col("x") + 0.25).alias("x"), F.when(F.col("node_id") % 2 == 0, F.col("y") * 2).alias("y"))
    return grids.set_coords(mesh, new).nodes.select("node_id", _r("x", 9).alias("x"), _r("y", 9).alias("y"))


def _balance(spark: SparkSession, sf_dir: str, table: str, key: str, column: str) -> DataFrame:
    return _table(spark, sf_dir, table).select(_long(key).alias("node_id"), F.col(column).cast("double").alias("v"))


def _integral(mesh: Mesh, field: DataFrame, places: int = 6) -> DataFrame:
    mapped = fields.map_quads(mesh, lambda m: fields.value(m, "u"), u=field)
    return fields.per_element(mapped).select("elem_id", _r("v", places).alias("v"))


def _line(spark: SparkSession, sf_dir: str) -> Mesh:
    return grids.line_mesh(spark, _table(spark, sf_dir, "supplier").count())


def e1_line2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _integral(_line(spark, sf_dir), _balance(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal"))


def e2_line3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements over two cells of a line each; the last one overlaps the one before where the number of cells is odd."""
    mesh, n = _line(spark, sf_dir), _table(spark, sf_dir, "supplier").count()
    at = F.least(F.col("id") * 2, F.lit(n - 3))
    pairs = spark.range(n // 2 if n > 2 else 0).select(F.col("id").alias("elem_id"), F.array(at, at + 2, at + 1).alias("conn"))
    return _integral(fields.on_elements(mesh, pairs, "line3"), _balance(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal"))


def _double_cells(spark: SparkSession, sf_dir: str, offsets: list[tuple[int, int]], etype: str) -> Mesh:
    """Elements over two by two cells of the grid, with nodes at steps (x, y) from the lower corner.

    The last ones in each direction overlap those before where the number of cells is odd; in the
    partly filled column, elements whose nodes are all there.
    """
    mesh, rows = _grid(spark, sf_dir), _parts_count(spark, sf_dir)
    m = grids.cells_per_side(rows) + 1
    full, columns = rows // m, -(-rows // m)
    x = [*range(0, full - 3, 2), full - 3, *([columns - 3] if columns > full else [])] if full > 2 else []
    y = [*range(0, m - 3, 2), m - 3] if m > 2 else []
    ids = spark.range(len(x) * len(y)).withColumn("i", F.expr(f"int(id div {max(len(y), 1)})")).withColumn("j", F.expr(f"int(id % {max(len(y), 1)})"))
    start = lambda c, last, cells: F.when(c < cells, F.least(c * 2, F.lit(last))).otherwise(F.lit(columns - 3))
    whole = len(x) - (columns > full)
    low = start(F.col("i"), full - 3, whole).cast("long") * m + F.least(F.col("j") * 2, F.lit(m - 3))
    elements = ids.select(F.col("id").alias("elem_id"), low.alias("low")).filter(F.col("low") + 2 * m + 2 < rows)
    return fields.on_elements(mesh, elements.select("elem_id", F.array(*(F.col("low") + i * m + j for i, j in offsets)).alias("conn")), etype)


TRI6 = [(0, 0), (2, 0), (2, 2), (1, 0), (2, 1), (1, 1)]
QUAD8 = [(0, 0), (2, 0), (2, 2), (0, 2), (1, 0), (2, 1), (1, 2), (0, 1)]


def e4_tri6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _integral(_double_cells(spark, sf_dir, TRI6, "tri6"), _field(spark, sf_dir))


def e6_quad8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _integral(_double_cells(spark, sf_dir, QUAD8, "quad8"), _field(spark, sf_dir))


def _box(spark: SparkSession, sf_dir: str, kind: str) -> Mesh:
    """Customers as the nodes of layers of a box, the last one partly filled; elements whose nodes are all there."""
    rows, n = _table(spark, sf_dir, "customer").count(), 0
    while (n + 2) ** 3 <= rows:
        n += 1
    layers = -(-rows // (n + 1) ** 2)
    mesh = grids.box(spark, (1.0, 2.0, 3.0), (layers - 1, n, n), kind)
    return Mesh(mesh.nodes, mesh.elements.filter(F.array_max("conn") < rows), kind)


def e7_tet4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _integral(_box(spark, sf_dir, "tet4"), _balance(spark, sf_dir, "customer", "c_custkey", "c_acctbal"), 10)


def e8_hex8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The integral of pi times the balance (so that no value lies between two rounded ones)."""
    balance = _balance(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    mapped = fields.map_quads(_box(spark, sf_dir, "hex8"), lambda m: fields.value(m, "u") * F.lit(math.pi), u=balance)
    return fields.per_element(mapped).select("elem_id", _r("v", 5).alias("v"))


def x3_own_quadrature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The integral of the squared field by a quadrature of one's own, in the middles of the sides."""
    etype = with_quadrature("tri3", [[0.5, 0.0], [0.5, 0.5], [0.0, 0.5]], [1 / 6] * 3)
    given = _grid(spark, sf_dir)
    mesh = fields.on_elements(given, given.elements, etype)
    mapped = fields.map_quads(mesh, lambda m: fields.value(m, "u") * fields.value(m, "u"), u=_field(spark, sf_dir))
    return fields.per_element(mapped).select("elem_id", _r("v", 3).alias("v"))


def x2_map_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    kernel = lambda b: pc.max_element_wise(pc.subtract(b.column(3), pa.scalar(1400.0)), pa.scalar(0.0))
    mapped = fields.map_points(_grid(spark, sf_dir, "quad4"), kernel, u=_field(spark, sf_dir))
    return mapped.select("elem_id", "q", _r("v").alias("v"))


# Fields of several components, boundaries.


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[Mesh, DataFrame]:
    table = _table(spark, sf_dir, "embeddings")
    field = table.select(_long("vec_id").alias("node_id"), F.col("embedding").cast("array<double>").alias("v"))
    return grids.table_grid(table, "vec_id"), field


def g4_vector_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.gradient_components(*_vectors(spark, sf_dir)).select("elem_id", "c", "d", _r("v", 4).alias("v"))


def a1_vector_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = fields.evaluate_components(*_vectors(spark, sf_dir))
    return fields.per_element_components(mapped).select("elem_id", "c", _r("v", 8).alias("v"))


def a1_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.integrate(_grid(spark, sf_dir), 3.0).select("elem_id", _r("v", 9).alias("v"))


def _bottom(spark: SparkSession, sf_dir: str) -> Mesh:
    mesh, n = _grid(spark, sf_dir), grids.cells_per_side(_parts_count(spark, sf_dir))
    m = n + 1
    lines = mesh.nodes.filter((F.col("node_id") % m == 0) & (F.col("node_id") >= m)).select(F.expr(f"node_id div {m} - 1").alias("elem_id"), F.array(F.col("node_id") - m, F.col("node_id")).alias("conn"))
    return fields.on_elements(mesh, lines, "line2")


def g9_boundary_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _integral(_bottom(spark, sf_dir), _field(spark, sf_dir))


def g10_select_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.select_nodes(_grid(spark, sf_dir), "y", "max")


def g11_pair_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = _grid(spark, sf_dir)
    return grids.pair_boundaries(mesh, grids.select_nodes(mesh, "y", "min"), grids.select_nodes(mesh, "y", "max"), "x")


# Materials.


def _slopes(mesh: Mesh, scale: float = 1.0) -> list[list[Column]]:
    return [[fields.slope(mesh, f, d) * F.lit(scale) for d in range(2)] for f in ("u", "w")]


def _two(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {"u": _field(spark, sf_dir), "w": _field(spark, sf_dir, "p_size")}


def k1_strain(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = _grid(spark, sf_dir)
    e = fields.strain(_slopes(mesh))
    return fields.at_quads(mesh, **_two(spark, sf_dir)).select("elem_id", _r(e[0][0], 4).alias("xx"), _r(e[1][1], 4).alias("yy"), _r(e[0][1], 4).alias("xy"))


def k2_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = _grid(spark, sf_dir)
    s = fields.stress(fields.strain(_slopes(mesh)), 1.5, 0.75)
    return fields.at_quads(mesh, **_two(spark, sf_dir)).select("elem_id", _r(s[0][0], 3).alias("xx"), _r(s[1][1], 3).alias("yy"), _r(s[0][1], 3).alias("xy"))


def k4_neo_hookean(spark: SparkSession, sf_dir: str) -> DataFrame:
    kernel = lambda m: fields.neo_hookean(_slopes(m, 1e-5), 500.0, 1000.0)
    return fields.map_quads(_grid(spark, sf_dir), kernel, **_two(spark, sf_dir)).select("elem_id", _r("v", 4).alias("v"))


def k5_plane_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    kernel = fields.linear_energy(*fields.lame(1.0, 0.3, plane_stress=True))
    return fields.per_element(fields.map_quads(_grid(spark, sf_dir), kernel, **_two(spark, sf_dir))).select("elem_id", _r("v", 5).alias("v"))


def k7_active_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = _bottom(spark, sf_dir)
    active = mesh.elements.select("elem_id", (F.col("elem_id") % 2 == 0).alias("active"))
    kernel = lambda m: fields.active_set_potential(fields.value(m, "u"), fields.value(m, "w"), F.col("active"))
    return fields.map_quads(mesh, kernel, quantity=active, **_two(spark, sf_dir)).select("elem_id", _r("v", 3).alias("v"))


def k8_mean_parameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = fields.map_quads(_grid(spark, sf_dir), lambda m: fields.value(m, "u"), u=_field(spark, sf_dir))
    return fields.scaled_by_mean(mapped, _table(spark, sf_dir, "part"), "p_size").select("elem_id", _r("v", 6).alias("v"))


# Forms, products, solvers.


def p11_flux_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    mesh = _grid(spark, sf_dir)
    flux = [fields.slope(mesh, "u", d) for d in range(2)]
    return fields.linear_form(mesh, flux=flux, u=_field(spark, sf_dir)).select("node_id", (_r("v", 4) + 0.0).alias("v"))


def p12_full_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda v: F.lit(float(v))
    k = fields.bilinear_form(_grid(spark, sf_dir), mass=one(1), diffusion=[[one(1), one(0.5)], [one(0), one(2)]], ahead=[one(1), one(0)], behind=[one(0), one(1)])
    return k.select("row", "col", (_r("v", 8) + 0.0).alias("v"))


def p15_matvec_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _field(spark, sf_dir).withColumnRenamed("node_id", "dof")
    return fields.matvec_free(_grid(spark, sf_dir), x, mass=1.0, stiffness=1.0).select("row", (_r("v", 4) + 0.0).alias("v"))


def p10_residual_and_tangent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reaction and diffusion, w . grad u + w u^3, at u a thousandth of the price: residual, and the sums of the tangent's rows."""
    mesh = _grid(spark, sf_dir)
    u = fields.value(mesh, "u")
    one, zero = F.lit(1.0), F.lit(0.0)
    small = _field(spark, sf_dir).withColumn("v", F.col("v") / 1000)
    residual, tangent = fields.residual_and_tangent(mesh, source=u * u * u, flux=[fields.slope(mesh, "u", d) for d in range(2)], mass=F.lit(3.0) * u * u, diffusion=[[one, zero], [zero, one]], u=small)
    rows = tangent.groupBy(F.col("row").alias("node_id")).agg(F.sum("v").alias("t"))
    return residual.join(rows, "node_id").select("node_id", (_r("v", 6) + 0.0).alias("residual"), (_r("t", 7) + 0.0).alias("tangent"))


def p16_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    plane = lambda m: fields.value(m, "x") + F.lit(2.0) * fields.value(m, "y")
    return fields.project(_grid(spark, sf_dir, "quad4"), plane).select("dof", (_r("x", 5) + 0.0).alias("v"))


def p17_solve_cg(spark: SparkSession, sf_dir: str) -> DataFrame:
    mass = written(fields.bilinear_form(_grid(spark, sf_dir, "quad4"), mass=F.lit(1.0)), "mass")
    x = _field(spark, sf_dir).withColumnRenamed("node_id", "dof")
    rhs = matrices.matvec(mass, x).withColumnRenamed("row", "dof")
    return matrices.solve_cg(mass, rhs).select("dof", _r("x", 3).alias("v"))


# Matrices and patterns.


def s8_to_coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrices.to_coo(matrices.to_csr(_coo(spark, sf_dir)))


def s9_to_csr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrices.to_csr(_coo(spark, sf_dir))
    total = F.aggregate("vals", F.lit(0.0), lambda a, v: a + v)
    return rows.select("row", F.size("cols").cast("long").alias("n"), F.col("cols")[0].alias("first"), F.element_at("cols", -1).alias("last"), total.alias("total"))


def s10_dense_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense rows in tiles; of tiles without an entry, which are not made, the zeros are those that the row still lacks."""
    n = _parts_count(spark, sf_dir)
    tiles = matrices.dense_tiles(_coo(spark, sf_dir), n)
    zeros = F.size(F.filter("vals", lambda v: v == 0)).cast("long")
    each = tiles.select("row", F.size("vals").cast("long").alias("n"), zeros.alias("zeros"), F.aggregate("vals", F.lit(0.0), lambda a, v: a + v).alias("total"))
    rows = each.groupBy("row").agg(F.sum("n").alias("made"), F.sum("zeros").alias("zeros"), F.sum("total").alias("total"))
    return rows.select("row", F.lit(n).cast("long").alias("n"), (F.lit(n) - F.col("made") + F.col("zeros")).cast("long").alias("zeros"), "total")


def s11_write_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{folder(spark)}/sorted-{uuid.uuid4().hex}"
    matrices.write_sorted(_coo(spark, sf_dir), path)
    return spark.read.parquet(path)


def _order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(_long("l_orderkey").alias("row"), _long("l_partkey").alias("col"), F.col("l_quantity").cast("double").alias("v"))


def t1_sorted_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrices.sorted_pattern(_order_items(spark, sf_dir))


def t3_degree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrices.degree_order(_order_items(spark, sf_dir))


def u3_union_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrices.union_patterns(_order_items(spark, sf_dir), _coo(spark, sf_dir))


def u4_missing_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrices.missing_entries(_order_items(spark, sf_dir), _coo(spark, sf_dir))


def p2_layout_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    lay = _layout(spark, sf_dir)
    nodal = [(lay.places[f].base, lay.places[f].stride, lay.places[f].field.components) for f in ("u", "phi")]
    shared = lay.places["s"]
    return matrices.layout_pattern(_orders(spark, sf_dir)[0], nodal, [(shared.base, shared.field.shape[0])])


def p4_split_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    dep = _order_items(spark, sf_dir).select(F.col("row").alias("term_id"), F.col("col").alias("dof"))
    return matrices.split_pattern(dep, _parts_count(spark, sf_dir) // 2)


def a13_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = matrices.sorted_pattern(_order_items(spark, sf_dir))
    return p.agg(F.count("*").alias("pairs"), F.count_distinct("col").alias("cols"), (F.max("col") + 1).alias("size"))


def a4_scatter_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrices.scatter_add(_order_items(spark, sf_dir).select((F.col("col") - 5).alias("dof"), "v"))


def a5_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem")
    entries = items.select((_long("l_suppkey") - 3).alias("row"), (_long("l_partkey") - 5).alias("col"), F.col("l_quantity").cast("double").alias("v"))
    return matrices.assemble_matrix(entries)


def p5_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows see a colour twice, and how many columns have none: 0 in a sound colouring."""
    p = _order_items(spark, sf_dir)
    colors = matrices.colour(p)
    bare = p.select(F.col("col").alias("dof")).distinct().join(colors, "dof", "left_anti")
    return matrices.colour_conflicts(p, colors).agg(F.count("*").alias("conflicts")).crossJoin(bare.agg(F.count("*").alias("bare")))  # two rows of counts


def p9_decompress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of orders and parts, back from its compressed form."""
    coo = matrices.assemble_matrix(_order_items(spark, sf_dir))
    colors = matrices.colour(coo)
    return matrices.decompress(coo, colors, matrices.compress(coo, colors))


# Packed states.


def _layout(spark: SparkSession, sf_dir: str) -> states.Layout:
    """As many nodes as orders; parts are the first of them."""
    fields_ = [states.Field("u", (states.AUTO, 2)), states.Field("s", (_table(spark, sf_dir, "nation").count(),), "shared"), states.Field("phi", (states.AUTO,))]
    return states.layout(fields_, _table(spark, sf_dir, "orders").count())


def _state(spark: SparkSession, sf_dir: str) -> tuple[states.Layout, DataFrame]:
    lay, part = _layout(spark, sf_dir), _table(spark, sf_dir, "part")
    u = part.select(_long("p_partkey").alias("item"), F.array(F.col("p_retailprice").cast("double"), F.col("p_size").cast("double")).alias("v"))
    phi = _table(spark, sf_dir, "orders").select(_long("o_orderkey").alias("item"), F.col("o_totalprice").cast("double").alias("v"))
    return lay, states.pack(spark, lay, {"u": u, "phi": phi}, default=7.0)


def c1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir)[1]


def c2_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    lay, vec = _state(spark, sf_dir)
    return states.unpack(lay, vec, "u")


def c3_set_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    lay, vec = _state(spark, sf_dir)
    some = _field(spark, sf_dir, "p_size").filter("node_id % 3 = 0").withColumnRenamed("node_id", "item")
    return states.set_field(spark, lay, vec, "phi", some)


def c4_add_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    lay, vec = _state(spark, sf_dir)
    return states.add_states(vec, vec.filter("dof % 2 = 0").withColumn("v", F.col("v") * 0.5)).select("dof", _r("v", 4).alias("v"))


def c5_natural_dofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.natural_dofs(_layout(spark, sf_dir), w1_local_nodes(spark, sf_dir))


def j10_select_dofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third node from the ninth last back to the first, second component first, with the state's values there."""
    lay, vec = _state(spark, sf_dir)
    return states.select_dofs(spark, lay, "u", slice(-9, None, -3), [1, 0]).join(vec, "dof").select("pos", "dof", "v")


def _subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").filter("p_size > 25").select(_long("p_partkey").alias("node_id"))


def w4_subset_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.subset_items(_subset(spark, sf_dir))


def j11_global_dofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lay = states.layout([states.Field("u", (states.AUTO, 2)), states.Field("l", (states.AUTO, 3), nodes=_subset(spark, sf_dir))], _parts_count(spark, sf_dir))
    wanted = _table(spark, sf_dir, "part").select(_long("p_partkey").alias("node_id"))
    return states.global_dofs(lay, "l", wanted, comp=2, on_missing="null")


# Constraints.


def u1_constrained_dofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    dofs, _, cs = _constrained(spark, sf_dir)
    return C.constrained_dofs(C.checked(cs, dofs))


def l9_with_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price, with the bottom set to the least price by a value given at run time and the left side tied to the right."""
    dofs, vec, cs = _constrained(spark, sf_dir)
    bottom = C.Valued(cs[0].table.select("dof", F.lit("bottom").alias("key")))
    least = vec.agg(F.min("v").alias("value")).select(F.lit("bottom").alias("key"), "value")
    bound = C.with_values([bottom, cs[1]], least)
    free = C.free_dofs(dofs, bound)
    return C.lift(C.reduce(vec, free), dofs.withColumn("v", F.lit(0.0)), free, bound).select("dof", _r("v").alias("v"))


def _pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrices.mesh_pattern(_grid(spark, sf_dir).elements)


def l10_augment_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.augment_pattern(_pattern(spark, sf_dir), _constrained(spark, sf_dir)[2])


def l11_reduce_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    dofs, _, cs = _constrained(spark, sf_dir)
    return C.reduce_pattern(_pattern(spark, sf_dir), C.free_dofs(dofs, cs))


def l12_adapt_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    dofs, _, cs = _constrained(spark, sf_dir)
    return C.adapt_pattern(_pattern(spark, sf_dir), C.free_dofs(dofs, cs), cs)


def l13_lifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    dofs, vec, cs = _constrained(spark, sf_dir)
    free = C.free_dofs(dofs, cs)
    job = C.lifted(lambda full: full.withColumn("v", F.col("v") * 2), free, cs, dofs.withColumn("v", F.lit(0.0)), "dual")
    return job(C.reduce(vec, free)).select("reduced", _r("v").alias("v"))


# Parts.


def _dofs(spark: SparkSession, sf_dir: str, components: int = 2) -> DataFrame:
    return parts.dof_layout(w1_local_nodes(spark, sf_dir), components)


def _periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _parts_count(spark, sf_dir)
    return _table(spark, sf_dir, "part").filter("p_partkey % 10 = 0").select(_long("p_partkey").alias("dof"), ((_long("p_partkey") + n // 2) % n).alias("master")).filter("dof <> master")


def a8_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.totals(w1_local_nodes(spark, sf_dir)).select(F.coalesce("part", F.lit(-1)).alias("part"), "n_local", "n_owned")


def a9_n_nodes_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.n_nodes_global(w1_local_nodes(spark, sf_dir))


def w5_dof_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dofs(spark, sf_dir)


def w6_reduced_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.reduced_layout(_dofs(spark, sf_dir), _periodic(spark, sf_dir).select((F.col("dof") * 2).alias("dof")))


def l8_missing_masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.missing_masters(_dofs(spark, sf_dir, 1), _periodic(spark, sf_dir))


def j3_global_to_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _table(spark, sf_dir, "part").select((F.col("p_partkey") % PARTS).cast("int").alias("part"), _long("p_partkey").alias("node_id"))
    return parts.global_to_local(ids, w1_local_nodes(spark, sf_dir))


def j5_ghost_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    dofs = _dofs(spark, sf_dir, 1)
    price = _field(spark, sf_dir).withColumnRenamed("node_id", "natural_dof")
    owned = dofs.filter("is_owned").join(price, "natural_dof").select("global_dof", "v")
    return parts.ghost_fill(dofs, owned)


def _local_values(spark: SparkSession, sf_dir: str, dofs: DataFrame) -> DataFrame:
    price = _field(spark, sf_dir).withColumnRenamed("node_id", "natural_dof")
    return dofs.join(price, "natural_dof").select("part", "local_dof", (F.col("v") * (F.col("part") + 1)).alias("v"))


def j6_ghost_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    dofs = _dofs(spark, sf_dir, 1)
    return parts.ghost_add(dofs, _local_values(spark, sf_dir, dofs)).select("global_dof", _r("v", 4).alias("v"))


def a12_gather_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    dofs = _dofs(spark, sf_dir, 1)
    return parts.gather_global(dofs, _local_values(spark, sf_dir, dofs)).select("natural_dof", _r("v", 4).alias("v"))


def j7_ghost_add_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two parts share an order, added up from each part's own numbers."""
    layout = written(w1_local_nodes(spark, sf_dir), "layout")
    ends = _parted_orders(spark, sf_dir).select("part", "elem_id", F.explode("conn").alias("node_id"))
    local = ends.join(layout.select("part", "node_id", F.col("local_id").alias("local_dof")), ["part", "node_id"])
    return parts.ghost_add_elements(parts.dof_layout(layout), local.select("part", "elem_id", "local_dof"))


def j9_dof_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _parts_count(spark, sf_dir)
    part = parts.block_of(n, PARTS, _long("p_partkey"))
    return _table(spark, sf_dir, "part").select(_long("p_partkey").alias("dof"), part.alias("part"), parts.block_start(n, PARTS, part).cast("long").alias("start"))


def _replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's quantities by part, as replicas of a vector."""
    return _coo(spark, sf_dir)


def a10_merge_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.merge_replicas(_replicas(spark, sf_dir).select(F.col("col").alias("dof"), "v"), _parts_count(spark, sf_dir), PARTS)


def a11_merge_replica_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem")
    replicas = items.groupBy("l_linenumber", _long("l_partkey").alias("row"), _long("l_suppkey").alias("col")).agg(F.sum(F.col("l_quantity").cast("double")).alias("v"))
    return parts.merge_replica_matrices(replicas, _parts_count(spark, sf_dir), PARTS)


QUERIES = {
    f.__name__: f
    for f in (
        s1_read_mesh, s4_unit_square, s7_set_coords, e1_line2, e2_line3, e4_tri6, e6_quad8, e7_tet4, e8_hex8, x2_map_points, x3_own_quadrature, g4_vector_gradient, a1_vector_integral, a1_number,
        g9_boundary_integral, g10_select_nodes, g11_pair_boundaries, k1_strain, k2_stress, k4_neo_hookean, k5_plane_stress, k7_active_set, k8_mean_parameter, p11_flux_form, p12_full_form,
        p15_matvec_free, p10_residual_and_tangent, p16_project, p17_solve_cg, s8_to_coo, s9_to_csr, s10_dense_rows, s11_write_sorted, t1_sorted_pattern, t3_degree_order, u3_union_patterns,
        u4_missing_entries, p2_layout_pattern, p4_split_pattern, a13_distinct_counts, a4_scatter_add, a5_assemble, p5_colour, p9_decompress, c1_pack, c2_unpack, c3_set_field, c4_add_states,
        c5_natural_dofs, j10_select_dofs, w4_subset_rank, j11_global_dofs, u1_constrained_dofs, l9_with_values, l10_augment_pattern, l11_reduce_pattern, l12_adapt_pattern, l13_lifted, a8_totals,
        a9_n_nodes_global, w5_dof_layout, w6_reduced_layout, l8_missing_masters, j3_global_to_local, j5_ghost_fill, j6_ghost_add, a12_gather_global, j7_ghost_add_matrix, j9_dof_range,
        a10_merge_replicas, a11_merge_replica_matrices,
    )
}
