"""Small meshes with known results."""

import pytest
from pyspark.sql import functions as F

from meshspark.operators import constraints as C
from meshspark.operators import fields, locate, matrices, parts
from meshspark.sources.grids import Mesh, box, rectangle, validate


@pytest.fixture(scope="module")
def two(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 1.0, 1.0), (3, 0.0, 1.0)], "node_id long, x double, y double")
    return Mesh(nodes, spark.createDataFrame([(0, [0, 1, 2]), (1, [0, 2, 3])], "elem_id long, conn array<long>"), "tri3")


def _values(df, *cols):
    return [tuple(r) for r in df.select(*cols).orderBy(*cols).collect()]


def test_two_triangles(two):
    ids = two.nodes.select("node_id", F.col("node_id").cast("double").alias("v"))
    assert [v for _, v in _values(fields.evaluate(two, ids), "elem_id", "v")] == pytest.approx([1, 5 / 3])
    one = fields.map_quads(two, lambda m: F.lit(4.0))
    assert _values(fields.per_element(one), "elem_id", "v") == [(0, 2.0), (1, 2.0)]
    total = fields.map_elements(two, F.aggregate("u", F.lit(0.0), lambda a, b: a + b), u=ids)
    assert _values(total, "elem_id", "v") == [(0, 3.0), (1, 5.0)]


def test_elements_without_a_quantity_stay(spark, two):
    quantity = spark.createDataFrame([(1, 2.5)], "elem_id long, quantity double")
    mapped = fields.map_quads(two, lambda m: F.col("quantity") * F.lit(2.0), quantity=quantity)
    assert sorted(((r.elem_id, r.v) for r in mapped.collect()), key=str) == [(0, None), (1, 5.0)]


def test_reserved_names_are_refused(two):
    with pytest.raises(ValueError):
        fields.at_quads(two, conn=two.nodes.select("node_id", F.col("x").alias("v")))


def test_interpolate_and_outside(spark, two):
    points = spark.createDataFrame([(0, 0.25, 0.25), (1, 0.75, 0.25), (2, 0.25, 0.75), (3, 0.5, 0.5), (4, 1.5, 0.5), (5, None, 0.5)], "point_id long, px double, py double")
    field = two.nodes.select("node_id", (F.col("x") + F.col("y")).alias("v"))
    rows = {r.point_id: r for r in locate.interpolate(two, field, points).collect()}
    assert [rows[i].v for i in range(4)] == pytest.approx([0.5, 1, 1, 1])
    assert rows[4].elem_id == rows[5].elem_id == -1 and rows[4].v is None and rows[5].v is None


def test_shared_edge_goes_to_the_smaller_id(spark):
    mesh = rectangle(spark, (0, 2), (0, 1), 2, 1, "quad4")
    points = spark.createDataFrame([(0, 0.5, 0.5), (1, 1.0, 0.5), (2, 1.5, 0.5)], "point_id long, px double, py double")
    assert _values(locate.locate(mesh, points), "point_id", "elem_id") == [(0, 0), (1, 0), (2, 1)]


def test_validate(spark, two):
    assert all(r.n == 0 for r in validate(two).collect())
    bad = Mesh(two.nodes, spark.createDataFrame([(0, [0, 1, 9]), (0, [0, 1])], "elem_id long, conn array<long>"), "tri3")
    assert {r.problem: r.n for r in validate(bad).collect()} == {"bad node": 0, "repeated node": 0, "repeated element": 1, "wrong size": 1, "missing node": 1}


def test_empty_mesh(spark, two):
    empty = Mesh(two.nodes.limit(0), two.elements.limit(0), "tri3")
    points = spark.createDataFrame([(0, 0.5, 0.5)], "point_id long, px double, py double")
    assert fields.diameters(empty).count() == 0
    assert _values(locate.locate(empty, points), "point_id", "elem_id") == [(0, -1)]


def test_constraints_apply_in_order(spark):
    dofs = spark.range(4).withColumnRenamed("id", "dof")
    fixed = C.Fixed(spark.createDataFrame([(0, 7.0)], "dof long, value double"))
    tied = C.Periodic(spark.createDataFrame([(3, 0)], "dof long, master long"))
    full = dofs.withColumn("v", F.col("dof") + 1.0)
    free = C.free_dofs(dofs, [fixed, tied])
    assert _values(free, "dof", "reduced") == [(1, 0), (2, 1)]
    zero = dofs.withColumn("v", F.lit(0.0))
    assert _values(C.lift(C.reduce(full, free), zero, free, [fixed, tied]), "dof", "v") == [(0, 7.0), (1, 2.0), (2, 3.0), (3, 7.0)]
    assert _values(C.lift(C.reduce(full, free), zero, free, [tied, fixed]), "dof", "v") == [(0, 7.0), (1, 2.0), (2, 3.0), (3, 0.0)]
    assert _values(tied.adjoint(full), "dof", "v") == [(0, 5.0), (1, 2.0), (2, 3.0), (3, 0.0)]


def test_lift_and_adjoint_are_transposes(spark):
    dofs = spark.range(6).withColumnRenamed("id", "dof")
    cs = [C.Fixed(spark.createDataFrame([(0, 0.0)], "dof long, value double")), C.Periodic(spark.createDataFrame([(5, 2), (4, 2)], "dof long, master long"))]
    free = C.free_dofs(dofs, cs)
    r = dofs.withColumn("v", F.col("dof") * 1.5 + 1)
    x = free.select("reduced", (F.col("reduced") + 2.0).alias("v"))
    lifted = C.lift(x, dofs.withColumn("v", F.lit(0.0)), free, cs)
    left = lifted.join(r.withColumnRenamed("v", "w"), "dof").agg(F.sum(F.col("v") * F.col("w"))).first()[0]
    right = C.reduce_adjoint(r, free, cs).join(x.withColumnRenamed("v", "w"), "reduced").agg(F.sum(F.col("v") * F.col("w"))).first()[0]
    assert left == pytest.approx(right)


def test_positions_cross_buckets(spark):
    ids = [0, 5, 65_535, 65_536, 200_000, 10**12]
    df = spark.createDataFrame([(i,) for i in reversed(ids)], "k long")
    assert _values(matrices.positions(df, "k"), "k", "pos") == [(k, i) for i, k in enumerate(ids)]


def test_owned_nodes_come_first(spark):
    mesh = rectangle(spark, (0, 1), (0, 1), 2, 2, "quad4")
    layout = parts.local_nodes(mesh.elements, mesh.elements.select("elem_id", F.expr("cast(elem_id div 2 as int)").alias("part")))
    rows = [tuple(r) for r in layout.orderBy("part", "local_id").select("part", "local_id", "node_id", "is_owned").collect()]
    assert rows == [(0, i, i, True) for i in range(6)] + [(1, 0, 6, True), (1, 1, 7, True), (1, 2, 8, True), (1, 3, 3, False), (1, 4, 4, False), (1, 5, 5, False)]


def test_stiffness_rows_sum_to_zero(spark):
    mesh = rectangle(spark, (0, 2), (0, 1), 4, 3)
    k = fields.bilinear_form(mesh, stiffness=F.lit(1.0))
    assert all(abs(r.s) < 1e-12 for r in k.groupBy("row").agg(F.sum("v").alias("s")).collect())
    m = fields.bilinear_form(mesh, mass=F.lit(1.0)).agg(F.sum("v")).first()[0]
    assert 0 < m <= 2.0 + 1e-12


def test_pattern_of_terms_without_and_with_repeats(spark):
    dep = spark.createDataFrame([(0, 1), (0, 2), (1, 1), (1, 2), (2, 3), (2, 3)], "term_id long, dof long")
    assert _values(matrices.term_pattern(dep), "row", "col") == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]


def test_gather_broadcasts_no_nodes_or_fields(spark):
    mesh = box(spark, (1.0, 1.0, 1.0), (2, 2, 2))
    field = mesh.nodes.select("node_id", F.col("x").alias("v"))
    plan = fields.gather(mesh, u=field)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastExchange" not in plan


def test_dense_tiles_hold_rows_of_any_length(spark):
    n = 120_001
    coo = spark.createDataFrame([(0, 3, 2.0), (0, 5, -1.0), (0, n - 1, 4.0), (7, 255, 1.5), (7, 256, 2.5)], "row long, col long, v double")
    got = {(r.row, r.tile): list(r.vals) for r in matrices.dense_tiles(coo, n).collect()}
    assert set(got) == {(0, 0), (0, (n - 1) // 256), (7, 0), (7, 1)} and [len(got[k]) for k in sorted(got)] == [256, n % 256, 256, 256]
    entries = {(r, t * 256 + c): v for (r, t), vs in got.items() for c, v in enumerate(vs) if v}
    assert entries == {(r.row, r.col): r.v for r in coo.collect()}
