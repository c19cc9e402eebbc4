"""Queries of vector and mixed forms, ordered colourings, composed constraints, solutions for many components, and whole local meshes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, bordered, fields, locate, matrices, parts, selections, states, terms
from ..operators import constraints as C
from ..operators.cut import written
from ..sources import grids
from ..sources.grids import Mesh
from .more import QUAD8, _dofs, _double_cells, _layout, _parts_count, _periodic, _state, _subset, _two
from .work import _field, _grid, _orders, _points, _r, _table, w1_local_nodes

MU, LAM = fields.lame(1.0, 0.3)


def _v(c: Column | str, places: int) -> Column:
    return (_r(c, places) + 0.0).alias("v")


# Vector and mixed forms.


def _elastic(mesh: Mesh) -> DataFrame:
    return blocks.block_matrix(mesh, lambda p: blocks.Form(diffusion=blocks.elasticity(MU, LAM, 2)), 2, 2)


def p12_elasticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stiffness of an elastic body on the grid, two unknowns a node."""
    both = blocks.interleaved(2)
    return blocks.entries(_elastic(_grid(spark, sf_dir)), both, both).select("row", "col", _v("v", 8))


def p12_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velocity and pressure: grad w : grad v + div w p + q div v. Test unknowns lie side by side at a node, of trial unknowns the pressures come last."""

    def kernel(_: blocks.Points) -> blocks.Form:
        diffusion, behind, ahead = np.zeros((3, 2, 3, 2)), np.zeros((3, 2, 3)), np.zeros((3, 3, 2))
        for i in range(2):
            behind[i, i, 2] = ahead[2, i, i] = 1
            for d in range(2):
                diffusion[i, d, i, d] = 1
        return blocks.Form(diffusion=diffusion, behind=behind, ahead=ahead)

    trial = [*blocks.interleaved(2), (2 * _parts_count(spark, sf_dir), 1)]
    return blocks.entries(blocks.block_matrix(_grid(spark, sf_dir), kernel, 3, 3), blocks.interleaved(3), trial).select("row", "col", _v("v", 8))


def p10_elasticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hyperelastic body displaced by a millionth of price and size: its residual, and its tangent times the places of the nodes, from one pass."""
    mesh = _grid(spark, sf_dir)

    def kernel(p: blocks.Points) -> blocks.Form:
        flux, diffusion = blocks.neo_hookean(np.stack([p.slope["u"], p.slope["w"]], axis=2) * 1e-6, 500.0, 1000.0)
        return blocks.Form(flux=flux, diffusion=diffusion)

    residual, tangent = blocks.block_system(mesh, kernel, 2, **_two(spark, sf_dir))
    both = blocks.interleaved(2)
    places = mesh.nodes.select(F.inline(F.array(*(F.struct((F.col("node_id") * 2 + c).alias("dof"), F.col(x).alias("v")) for c, x in enumerate("xy")))))
    action = matrices.matvec(blocks.entries(tangent, both, both), places).select(F.col("row").alias("dof"), F.col("v").alias("a"))
    out = blocks.unknowns(residual, both).join(action, "dof")
    return out.select("dof", _v("v", 6), (_r("a", 5) + 0.0).alias("action"))


def p12_quad8_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row sums of the mass of elements of eight nodes, by blocks."""
    mesh = _double_cells(spark, sf_dir, QUAD8, "quad8")
    m = blocks.block_matrix(mesh, lambda p: blocks.Form(mass=np.ones((1, 1))), 1, 1)
    return m.groupBy(F.col("row").alias("node_id")).agg(_v(F.sum("v_0"), 10))


# Colourings of the sequential greedy.


def _ordered(spark: SparkSession, sf_dir: str, order: str) -> DataFrame:
    return matrices.colour_in_order(matrices.mesh_pattern(_grid(spark, sf_dir).elements), order)


def p5_index_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(spark, sf_dir, "index")


def p5_degree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(spark, sf_dir, "degree")


# Composed constraints: fixed, tied and weighted unknowns in several orders, two unknowns a node.

ORDERS = ("FPW", "PWF", "WFP", "WPF")


def _ruled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, dict[str, C.Constraint]]:
    """All unknowns, their values (price, size), and: F the bottom fixed, P the left side tied to the right, W the second component of the second column made of its neighbours."""
    n = grids.cells_per_side(_parts_count(spark, sf_dir))
    m = n + 1
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("node"), F.col("p_retailprice").cast("double").alias("u"), F.col("p_size").cast("double").alias("w"))
    vec = part.select(F.inline(F.array(*(F.struct((F.col("node") * 2 + c).alias("dof"), F.col(f).alias("v")) for c, f in enumerate("uw")))))
    dofs = vec.select("dof")
    node, comp = F.expr("dof div 2"), F.expr("dof % 2")
    fixed = C.Fixed(dofs.filter(node % m == 0).select("dof", (comp + 1.5).alias("value")))
    tied = C.Periodic(dofs.filter(node < m).select("dof", (F.col("dof") + 2 * n * m).alias("master")))
    column = dofs.filter((node >= m) & (node < 2 * m) & (comp == 1))
    masters = F.inline(F.array(*(F.struct((F.col("dof") + s * 2 * m).alias("master"), F.lit(w).alias("weight")) for s, w in ((-1, 0.5), (1, 0.25)))))
    weighted = C.Weighted(column.select("dof", masters), column.withColumn("value", F.lit(2.0)))
    return dofs, vec, {"F": fixed, "P": tied, "W": weighted}


def _each_order(spark: SparkSession, sf_dir: str, job) -> DataFrame:
    dofs, vec, rules = _ruled(spark, sf_dir)
    out = None
    for order in ORDERS:
        resolved = C.composed([rules[k] for k in order]).kept()
        one = job(dofs, vec, written(C.free_dofs(dofs, resolved), "free"), resolved).withColumn("ord", F.lit(order))
        out = one if out is None else out.unionByName(one)
    return out


def _orders_at_once(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, C.AffineMap]]:
    """The free unknowns, which are the same in each order, and the map of each."""
    dofs, _, rules = _ruled(spark, sf_dir)
    return written(C.free_dofs(dofs, list(rules.values())), "free"), {order: C.composed([rules[k] for k in order]) for order in ORDERS}


def l2_lift_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each_order(spark, sf_dir, lambda dofs, vec, free, cs: C.lift(C.reduce(vec, free), dofs.withColumn("v", F.lit(0.0)), free, cs).select("dof", _v("v", 6)))


def l5_adjoint_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _each_order(spark, sf_dir, lambda dofs, vec, free, cs: C.reduce_adjoint(vec, free, cs).select("reduced", _v("v", 6)))


def l10_pattern_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = matrices.mesh_pattern(_grid(spark, sf_dir).elements, dofs=2)
    return C.adapt_patterns(pattern, *_orders_at_once(spark, sf_dir)).withColumnRenamed("name", "ord")


def l14_matrix_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = blocks.interleaved(2)
    k = blocks.entries(_elastic(_grid(spark, sf_dir)), both, both)
    return C.reduce_matrices(k, *_orders_at_once(spark, sf_dir)).select(F.col("name").alias("ord"), "row", "col", _v("v", 7))


def l9_values_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bottom fixed by values given at run time: its own price for nodes of an even size, 3 for the others of the key; the right side at its default of 7."""
    part = _table(spark, sf_dir, "part")
    n = grids.cells_per_side(part.count())
    m = n + 1
    key = F.col("p_partkey").cast("long")
    bottom = part.filter(key % m == 0).select(key.alias("dof"), F.lit("bottom").alias("key"), "p_size", F.col("p_retailprice").cast("double").alias("value"))
    right = part.filter((key >= n * m) & (key < m * m) & (key % m != 0)).select(key.alias("dof"), F.lit("right").alias("key"))
    own = bottom.filter("p_size % 2 = 0").select("key", "dof", "value")
    every = spark.createDataFrame([("bottom", None, 3.0)], "key string, dof long, value double")
    cs = C.with_values([C.Valued(bottom.select("dof", "key")), C.Valued(right, default=7.0)], own.unionByName(every))
    dofs, resolved = part.select(key.alias("dof")), C.composed(cs).kept()
    free = C.free_dofs(dofs, resolved)
    return C.lift(C.reduce(dofs.withColumn("v", F.lit(1.0)), free), dofs.withColumn("v", F.lit(0.0)), free, resolved).select("dof", _v("v", 6))


# Solutions.


def p16_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three linear fields on elements of one point, in one pass."""
    kernel = lambda m: [fields.value(m, "x") + F.lit(2.0) * fields.value(m, "y"), F.lit(3.0) - fields.value(m, "y"), F.lit(1.0) + F.lit(0.5) * fields.value(m, "x")]
    x = fields.project(_grid(spark, sf_dir), kernel)
    return x.select("dof", F.posexplode("x").alias("c", "v")).select("dof", "c", _v("v", 5))


def p16_constrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fields that hold their constraints: zero at the bottom, the left side as the right."""
    mesh, n = _grid(spark, sf_dir), grids.cells_per_side(_parts_count(spark, sf_dir))
    m = n + 1
    inside = mesh.elements.select(F.explode("conn").alias("dof")).distinct()
    cs = [C.Periodic(inside.filter(F.col("dof") < m).select("dof", (F.col("dof") + n * m).alias("master"))), C.Fixed(inside.filter(F.col("dof") % m == 0).withColumn("value", F.lit(0.0)))]
    kernel = lambda m: [F.lit(3.0) * fields.value(m, "y"), -fields.value(m, "y")]
    x = fields.project(mesh, kernel, constraints=cs)
    return x.select("dof", F.posexplode("x").alias("c", "v")).select("dof", "c", _v("v", 5))


def p17_partial_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loads of a field that is zero on most nodes have rows on few unknowns; the solution has all of them."""
    mass = written(fields.bilinear_form(_grid(spark, sf_dir, "quad4"), mass=F.lit(1.0)), "mass")
    x = _field(spark, sf_dir, "p_size").filter("v > 45").withColumnRenamed("node_id", "dof")
    rhs = matrices.matvec(mass, x).withColumnRenamed("row", "dof").filter("v <> 0")
    return matrices.solve_cg(mass, rhs).select("dof", (_r("x", 4) + 0.0).alias("v"))


# Points.


def j1_quad8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of eight nodes hold points by their four corners."""
    return locate.locate(_double_cells(spark, sf_dir, QUAD8, "quad8"), _points(spark, sf_dir))


def j2_newton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two linear fields at points of a grid of skewed quadrilaterals, by several steps."""
    grid = _grid(spark, sf_dir, "quad4")
    mesh = grids.set_coords(grid, grid.nodes.select("node_id", (F.col("x") + F.lit(0.3) * F.col("x") * F.col("y")).alias("x"), (F.col("y") + F.lit(0.2) * F.col("x") * F.col("y")).alias("y")))
    field = mesh.nodes.select("node_id", F.array(F.lit(1.0) + F.lit(2.0) * F.col("x") + F.lit(3.0) * F.col("y"), F.col("x") - F.col("y")).alias("v"))
    out = locate.interpolate(mesh, field, _points(spark, sf_dir), steps=8)
    return out.select("point_id", "elem_id", (_r(F.get("v", F.lit(0)), 7) + 0.0).alias("a"), (_r(F.get("v", F.lit(1)), 7) + 0.0).alias("b"))


# Heavy terms, borders and blocks.


def p3_heavy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that meet in an order or in a brand; brands, each with a share of all parts, are never squared: for each part how many it meets, and their prices together."""
    items = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("order "), F.col("l_orderkey")).alias("term_id"), F.col("l_partkey").cast("long").alias("dof"))
    brands = _table(spark, sf_dir, "part").select(F.concat(F.lit("brand "), F.col("p_brand")).alias("term_id"), F.col("p_partkey").cast("long").alias("dof"))
    pattern = terms.pattern_of_terms(items.unionByName(brands), heavy=7)
    sums = pattern.sums(_field(spark, sf_dir).withColumnRenamed("node_id", "dof"))
    return sums.select(F.col("row").alias("dof"), "n", _v("v", 2))


def _saddle(spark: SparkSession, sf_dir: str) -> tuple[states.Layout, DataFrame]:
    """The elastic body with two shared multipliers that hold its mean displacement: entries of every node in two rows and two columns."""
    mesh = _grid(spark, sf_dir)
    lay = states.layout([states.Field("u", (states.AUTO, 2)), states.Field("m", (2,), "shared")], _parts_count(spark, sf_dir))
    both, base = blocks.interleaved(2), lay.places["m"].base
    area = fields.linear_form(mesh, F.lit(1.0))
    edge = area.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("c"), "node_id", "v").select((F.col("node_id") * 2 + F.col("c")).alias("row"), (F.col("c") + F.lit(base).cast("long")).alias("col"), "v")
    turned = edge.select(F.col("col").alias("row"), F.col("row").alias("col"), "v")
    return lay, written(blocks.entries(_elastic(mesh), both, both).unionByName(edge).unionByName(turned), "saddle")


def p2_bordered_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bordered matrix times price and size, and multipliers of 3 and 4."""
    lay, coo = _saddle(spark, sf_dir)
    base = lay.places["m"].base
    few = spark.range(2).select((F.col("id") + base).alias("dof"), (F.col("id") + 3.0).alias("v"))
    x = _ruled(spark, sf_dir)[1].unionByName(few)
    return bordered.bordered(coo, few).matvec(x).select("row", _v("v", 4))


def p2_block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lay, coo = _saddle(spark, sf_dir)
    return bordered.block_counts(coo, lay)


def p2_subset_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows' lengths in the pattern of a field on all nodes, one on the nodes of large parts, and shared unknowns."""
    some = _table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").cast("long").alias("node_id"))
    lay = states.layout([states.Field("u", (states.AUTO, 2)), states.Field("l", (states.AUTO,), nodes=some), states.Field("s", (3,), "shared")], _parts_count(spark, sf_dir))
    p = bordered.layout_entries(_grid(spark, sf_dir).elements, lay, {"l": states.subset_items(some)})
    return p.groupBy("row").agg(F.count("*").alias("n"), F.sum("col").alias("cols"))


# Local meshes.


def w1_local_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, partition = _orders(spark, sf_dir)
    local = parts.local_elements(elements, partition, parts.local_nodes(elements, partition))
    return local.select("part", "elem_id", F.posexplode("conn").alias("a", "local_id"))


def _owned_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.owned_row_counts(matrices.mesh_pattern(_orders(spark, sf_dir)[0]), w1_local_nodes(spark, sf_dir))


def w3_part_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrices.part_pointer(_owned_counts(spark, sf_dir))


def a8_owned_nnz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.owned_nnz(_owned_counts(spark, sf_dir)).select(F.coalesce("part", F.lit(-1)).alias("part"), "nnz")


def c5_all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ownership of a state with two fields on all nodes, one on the nodes of large parts, one of each part's orders and one that is shared."""
    elements, partition = _orders(spark, sf_dir)
    some = _table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").cast("long").alias("node_id"))
    kinds = [states.Field("u", (states.AUTO, 2)), states.Field("l", (states.AUTO, 2), nodes=some), states.Field("own", (1,), "local"), states.Field("s", (_table(spark, sf_dir, "nation").count(),), "shared"), states.Field("phi", (states.AUTO,))]
    own = partition.groupBy("part").agg(F.count("*").alias("n"))
    return parts.ownership(states.layout(kinds, _parts_count(spark, sf_dir)), written(parts.local_nodes(elements, partition), "local"), {"own": own})


def w6_extra_ghosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's unknowns with the masters that it lacks, without the tied ones, numbered anew."""
    dofs, tied = written(_dofs(spark, sf_dir, 1), "layout"), _periodic(spark, sf_dir)
    held = dofs.filter("is_owned").select(F.col("natural_dof").alias("master"))
    tied = tied.join(held, "master", "left_semi").select("dof", "master")
    return parts.reduced_layout(written(parts.with_extra_ghosts(dofs, tied), "ghosts"), tied)


# Selections and stacks.


def j10_intersected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third node from the ninth last back, second component first, where the unknown is a seventh one; as progressions."""
    lay = _layout(spark, sf_dir)
    backwards, sevenths = selections.of_field(spark, lay, "u", slice(-9, None, -3), [1, 0]), selections.progression(spark, 0, lay.size, 7)
    return selections.intersected(backwards, sevenths)


def j10_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of neighbours among the large parts, and how many even unknowns each run holds."""
    runs = selections.runs(_subset(spark, sf_dir).withColumnRenamed("node_id", "dof"))
    even = selections.intersected(runs, selections.progression(spark, 0, _parts_count(spark, sf_dir), 2))
    per_run = even.select((F.col("base") - F.col("at")).alias("_run"), F.col("count").alias("even"), F.col("base").alias("first_even"))
    return runs.withColumn("_run", F.col("base") - F.col("at")).join(per_run, "_run", "left").select("base", "count", "at", F.coalesce("even", F.lit(0)).cast("long").alias("even"), "first_even")


def j10_picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state's second component at each order line's part, in the lines' order."""
    lay, vec = _state(spark, sf_dir)
    lines = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("pos"), F.col("l_partkey").cast("long").alias("item"))
    return selections.picked(vec, selections.of_items(lay, "u", lines, 1))


def c4_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state but for both components of every second node."""
    lay, vec = _state(spark, sf_dir)
    return selections.without(vec, selections.of_field(spark, lay, "u", slice(None, None, 2))).select("dof", "v")


def _paired(spark: SparkSession, sf_dir: str) -> states.Layout:
    """A field on all nodes, and two on the nodes of large parts that lie side by side."""
    some = _subset(spark, sf_dir)
    kinds = [states.Field("u", (states.AUTO, 2)), states.Field("l", (states.AUTO, 2), nodes=some), states.Field("s", (3,), "shared"), states.Field("m", (states.AUTO,), nodes=some)]
    return states.layout(kinds, _parts_count(spark, sf_dir), together=(("l", "m"),))


def c1_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packed state with stacked fields: two prices of each large part beside its size."""
    large = _table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").cast("long").alias("node_id"), F.col("p_retailprice").cast("double").alias("price"), F.col("p_size").cast("double").alias("size"))
    values = large.join(states.subset_items(_subset(spark, sf_dir)), "node_id")
    return states.pack(spark, _paired(spark, sf_dir), {"l": values.select("item", F.array("price", -F.col("price")).alias("v")), "m": values.select("item", F.col("size").alias("v"))}, default=7.0)


def j11_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progressions of the stacked fields on the nodes of the second quarter of the ids."""
    lay, n = _paired(spark, sf_dir), _parts_count(spark, sf_dir)
    each = [selections.of_nodes(spark, lay, name, slice(n // 4, n // 2), comps).withColumn("name", F.lit(name)) for name, comps in (("u", [0]), ("l", [1, 0]), ("m", None))]
    return each[0].unionByName(each[1]).unionByName(each[2])


def j11_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknowns of a stacked field at the large parts on order, line by line."""
    lines = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("pos"), F.col("l_partkey").cast("long").alias("node_id"))
    wanted = lines.join(_subset(spark, sf_dir), "node_id", "left_semi")
    return selections.listed(selections.of_nodes(spark, _paired(spark, sf_dir), "l", wanted, [1, 0]))


QUERIES = {
    f.__name__: f
    for f in (
        p12_elasticity, p12_mixed, p10_elasticity, p12_quad8_mass, p5_index_order, p5_degree_order, l2_lift_orders, l5_adjoint_orders, l10_pattern_orders, l14_matrix_orders, l9_values_each,
        p3_heavy_terms, p2_bordered_product, p2_block_counts, p2_subset_pattern, p16_vector, p16_constrained, p17_partial_loads, j1_quad8, j2_newton, w1_local_elements, w3_part_pointer, a8_owned_nnz, c5_all_kinds, w6_extra_ghosts,
        j10_intersected, j10_runs, j10_picked, c4_without, c1_stacked, j11_slices, j11_listed,
    )
}
