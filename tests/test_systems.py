"""Vector forms, composed constraints, ordered colourings, solutions and points, against dense or sequential versions."""

import itertools
import os
import random
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshspark.functions.basis import ELEMENTS
from meshspark.jobs import more, systems
from meshspark.operators import blocks, bordered, fields, locate, matrices, parts, states, terms
from meshspark.operators import constraints as C
from meshspark.operators.cut import written
from meshspark.sources.grids import Mesh, box, line_mesh, pair_boundaries, rectangle, select_nodes


SF = "/root/testdata/sf0.001"


def _dense(coo, n, m=None):
    out = np.zeros((n, m or n))
    for r in coo.collect():
        out[r.row, r.col] += r.v
    return out


def _vector(df, n, key="dof", value="v"):
    out = np.full(n, np.nan)
    for r in df.collect():
        out[r[key]] = r[value]
    return out


# Vector and mixed forms.


@pytest.mark.parametrize("kind", ["tet4", "hex8"])
def test_elastic_bodies_resist_no_rigid_motion(spark, kind):
    mesh = box(spark, (1.0, 2.0, 1.5), (2, 1, 1), kind)
    three, n = blocks.interleaved(3), mesh.nodes.count()
    k = _dense(blocks.entries(blocks.block_matrix(mesh, lambda p: blocks.Form(diffusion=blocks.elasticity(2.0, 3.0, 3)), 3, 3), three, three), 3 * n)
    x = np.array([[r.x, r.y, r.z] for r in mesh.nodes.orderBy("node_id").collect()])
    turn = np.stack([-x[:, 1], x[:, 0], 0 * x[:, 0]], axis=1)
    assert np.allclose(k, k.T) and np.abs(k @ turn.ravel()).max() < 1e-12 and np.abs(k @ np.ones(3 * n)).max() < 1e-12
    stretched = (x * [1e-3, 0, 0]).ravel()
    assert stretched @ k @ stretched == pytest.approx(1e-6 * (2 * 2.0 + 3.0) * 3.0)


@pytest.mark.parametrize("etype", ["tri3", "quad4", "hex8"])
def test_hyperelastic_residual_and_tangent_follow_the_energy(spark, etype):
    dim = ELEMENTS[etype].dim
    mesh = box(spark, (1.0, 1.0, 1.0), (1, 1, 1), "hex8") if dim == 3 else rectangle(spark, (0, 1), (0, 1), 2, 1, etype)
    ids = [r.node_id for r in mesh.nodes.orderBy("node_id").collect()]
    rng = np.random.default_rng(3)
    u = rng.uniform(-0.05, 0.05, (len(ids), dim))

    def kernel(p):
        flux, diffusion = blocks.neo_hookean(p.slope["u"], 2.0, 3.0)
        return blocks.Form(flux=flux, diffusion=diffusion)

    def residual(u):
        field = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, u, strict=True)], "node_id long, v array<double>")
        r, t = blocks.block_system(mesh, kernel, dim, u=field)
        return _vector(blocks.unknowns(r, blocks.interleaved(dim)), u.size), t

    r, t = residual(u)
    k = _dense(blocks.entries(t, blocks.interleaved(dim), blocks.interleaved(dim)), u.size)
    step = rng.uniform(-1, 1, u.shape)
    ahead, back = (residual(u + s * 1e-6 * step)[0] for s in (1, -1))
    assert np.allclose(k, k.T) and np.allclose(k @ step.ravel(), (ahead - back) / 2e-6, atol=1e-6)
    assert np.abs(r.reshape(-1, dim).sum(axis=0)).max() < 1e-12  # no force from outside
    if dim == 2:  # the energy of the column kernel
        table = [(i, *map(float, v)) for i, v in zip(ids, u, strict=True)]

        def energy(rows):
            df = spark.createDataFrame(rows, "node_id long, a double, b double")
            slopes = lambda m: [[fields.slope(m, f, d) for d in range(2)] for f in ("a", "b")]
            mapped = fields.map_quads(mesh, lambda m: fields.neo_hookean(slopes(m), 2.0, 3.0), **{f: df.select("node_id", F.col(f).alias("v")) for f in "ab"})
            return mapped.agg(F.sum(F.col("v") * F.col("wt"))).first()[0]

        up, down = ([(i, float(a + s * 1e-6 * step[k, 0]), float(b + s * 1e-6 * step[k, 1])) for k, (i, a, b) in enumerate(table)] for s in (1, -1))
        assert (energy(up) - energy(down)) / 2e-6 == pytest.approx(r @ step.ravel(), rel=1e-5)


def test_mixed_forms_are_transposes_and_one_way_forms_are_not(spark):
    mesh = rectangle(spark, (0, 2), (0, 1), 2, 2, "quad4")

    def saddle(_):
        behind, ahead = np.zeros((3, 2, 3)), np.zeros((3, 3, 2))
        for i in range(2):
            behind[i, i, 2] = ahead[2, i, i] = 1
        return blocks.Form(behind=behind, ahead=ahead)

    three, n = blocks.interleaved(3), 9
    k = _dense(blocks.entries(blocks.block_matrix(mesh, saddle, 3, 3), three, three), 3 * n)
    assert np.allclose(k, k.T) and np.abs(k[2::3, 2::3]).max() == 0
    constant = np.zeros(3 * n)
    constant[0::3] = 1
    assert np.abs(k @ constant).max() < 1e-12  # a constant velocity has no divergence
    one_way = blocks.block_matrix(mesh, lambda p: blocks.Form(ahead=np.ones((1, 2, 2))), 1, 2)
    wide = _dense(blocks.entries(one_way, [(0, 1)], [(0, 1), (n, 1)], zeros=False), n, 2 * n)
    assert np.allclose(wide[:, :n], wide[:, n:]) and not np.allclose(wide[:, :n], wide[:, :n].T)


def test_blocks_equal_scalar_forms_and_refuse(spark):
    for mesh in (rectangle(spark, (0, 1), (0, 2), 3, 2), line_mesh(spark, 5, 2.0)):
        dim = ELEMENTS[mesh.etype].dim
        one = lambda p, dim=dim: blocks.Form(mass=np.ones((1, 1)) * p.x[..., :1, None], diffusion=np.eye(dim)[None, :, None, :])
        n = mesh.nodes.count()
        mine = _dense(blocks.entries(blocks.block_matrix(mesh, one, 1, 1), [(0, 1)], [(0, 1)]), n)
        theirs = _dense(fields.bilinear_form(mesh, mass=fields.value(mesh, "x"), stiffness=F.lit(1.0)), n)
        assert np.allclose(mine, theirs)
        load = blocks.unknowns(blocks.block_vector(mesh, lambda p: blocks.Form(source=p.value["u"][..., None]), 1, u=mesh.nodes.select("node_id", F.col("x").alias("v"))), [(0, 1)])
        assert np.allclose(_vector(load, n), _vector(fields.linear_form(mesh, fields.value(mesh, "u"), u=mesh.nodes.select("node_id", F.col("x").alias("v"))), n, "node_id"))
    with pytest.raises(ValueError):
        blocks.block_matrix(mesh, one, 1, 1, conn=mesh.nodes)
    empty = Mesh(mesh.nodes.limit(0), mesh.elements.limit(0), mesh.etype)
    assert blocks.block_matrix(empty, one, 1, 1).count() == 0


# Constraints.


@dataclass(frozen=True)
class Mirror(C.Constraint):
    """A type of one's own: dof is what its master is, with the other sign."""

    table: object

    def rows(self):
        return self.table.select("dof", "master", F.lit(-1.0).alias("weight"))

    def offsets(self):
        return self.table.select("dof", F.lit(0.0).alias("value"))


def test_every_order_follows_one_map(spark):
    n = 8
    dofs = spark.range(n).withColumnRenamed("id", "dof")
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    rules = {
        "F": (C.Fixed(table([(0, 7.0), (4, -2.0)], "dof long, value double")), lambda v: [7.0 if i == 0 else -2.0 if i == 4 else x for i, x in enumerate(v)]),
        "P": (C.Periodic(table([(5, 0), (0, 6)], "dof long, master long")), lambda v: [v[6] if i == 0 else v[0] if i == 5 else x for i, x in enumerate(v)]),
        "W": (C.Weighted(table([(1, 0, 0.5), (1, 2, 2.0), (5, 3, 1.5)], "dof long, master long, weight double"), table([(1, 3.0)], "dof long, value double")), lambda v: [0.5 * v[0] + 2 * v[2] + 3 if i == 1 else 1.5 * v[3] if i == 5 else x for i, x in enumerate(v)]),
        "M": (Mirror(table([(4, 7)], "dof long, master long")), lambda v: [-v[7] if i == 4 else x for i, x in enumerate(v)]),
    }
    k = np.array([[10.0 * i + j + 1 for j in range(n)] for i in range(n)])
    coo = spark.createDataFrame([(i, j, float(k[i, j])) for i in range(n) for j in range(n)], "row long, col long, v double")
    base = np.arange(n) * 1.5 + 1
    for order in ("PWMF", "MWFP", "FP"):
        cs = C.composed(C.checked([rules[c][0] for c in order], dofs)).kept()

        def lifted(v, order=order):
            for c in order:
                v = rules[c][1](v)
            return np.array(v)

        free = written(C.free_dofs(dofs, cs), "free")
        ids = [r.dof for r in free.orderBy("reduced").collect()]
        full = spark.createDataFrame([(i, float(base[i])) for i in range(n)], "dof long, v double")
        got = _vector(C.lift(C.reduce(full, free), full, free, cs), n)
        assert np.allclose(got, lifted(list(base))), order
        t = np.array([lifted(list(np.eye(n)[i])) - lifted([0.0] * n) for i in ids]).T
        assert np.allclose(_vector(C.reduce_adjoint(full, free, cs), len(ids), "reduced"), t.T @ base), order
        assert np.allclose(_dense(C.reduce_matrix(coo, free, cs), len(ids)), t.T @ k @ t), order
        m, f = C.reduce_system(coo, full, dofs, free, cs)
        assert np.allclose(_dense(m, len(ids)), t.T @ k @ t) and np.allclose(_vector(f, len(ids), "reduced"), t.T @ (base - k @ lifted([0.0] * n))), order
        sparse = coo.filter("(row + col) % 3 = 0").select("row", "col")
        s = np.zeros((n, n), bool)
        for r in sparse.collect():
            s[r.row, r.col] = True
        pattern = {(r.row, r.col) for r in C.adapt_pattern(sparse, free, cs).collect()}
        assert pattern == {(int(a), int(b)) for a, b in zip(*np.nonzero((t != 0).T.astype(int) @ s @ (t != 0)), strict=True)}, order
    assert C.to_free(dofs.withColumn("reduced", F.col("dof")), []).count() == n
    with pytest.raises(ValueError):
        C.checked([C.Weighted(table([(1, 99, 1.0)], "dof long, master long, weight double"))], dofs)


def test_several_maps_follow_one_pass_over_the_entries(spark):
    n = 7
    dofs = spark.range(n).withColumnRenamed("id", "dof")
    tied = C.Periodic(spark.createDataFrame([(1, 4), (2, 5)], "dof long, master long"))
    made = C.Weighted(spark.createDataFrame([(1, 2, 0.5), (1, 3, 2.0), (6, 1, -1.0), (6, 4, 0.0)], "dof long, master long, weight double"))
    fixed = C.Fixed(spark.createDataFrame([(0, 1.0), (2, 3.0)], "dof long, value double"))
    free = written(C.free_dofs(dofs, [tied, made, fixed]), "free")
    maps = {"all": [fixed, tied, made], "turned": C.composed([made, tied, fixed]).kept(), "few": [tied]}  # 0 and 6 are touched by the first two alone, and not free
    entries = [(i, j, 10.0 * i + j + 1) for i in range(n) for j in range(n) if (i + 2 * j) % 3] + [(3, 4, 0.5), (3, 5, None), (3, 3, None), (None, 3, 1.0), (9, 3, 1.0)]
    coo = spark.createDataFrame(entries, "row long, col long, v double")
    got, seen = {name: {} for name in maps}, {name: set() for name in maps}
    for r in C.reduce_matrices(coo, free, maps).collect():
        assert got[r.name].setdefault((r.row, r.col), r.v) == r.v
    for r in C.adapt_patterns(coo, free, maps).collect():
        assert (r.row, r.col) not in seen[r.name]
        seen[r.name].add((r.row, r.col))
    for name, cs in maps.items():
        to = {}
        for r in C.to_free(free, cs).collect():
            to.setdefault(r.dof, []).append((r.reduced, r.weight))
        want = {}
        for i, j, v in entries:
            for (a, s), (b, w) in itertools.product(to.get(i, []), to.get(j, [])):
                want.setdefault((a, b), []).extend([] if v is None else [v * s * w])
        assert seen[name] == want.keys()
        assert got[name].keys() == want.keys() and all(got[name][k] == (pytest.approx(sum(v)) if v else None) for k, v in want.items()), name


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_orders_of_constraints_move_the_entries_once(spark):
    for query in (systems.l10_pattern_orders, systems.l14_matrix_orders):
        assert "Union" not in _plan(query(spark, SF)), query  # one pass, not one for each order


def test_a_slave_that_is_fixed_afterwards_gives_its_master_nothing(spark):
    dofs = spark.range(3).withColumnRenamed("id", "dof")
    cs = [C.Periodic(spark.createDataFrame([(0, 2)], "dof long, master long")), C.Fixed(spark.createDataFrame([(0, 0.0)], "dof long, value double"))]
    coo = spark.createDataFrame([(i, j, 10.0 * i + j + 1) for i in range(3) for j in range(3)], "row long, col long, v double")
    free = C.free_dofs(dofs, cs)
    assert _dense(C.reduce_matrix(coo, free, cs), 2).tolist() == [[12.0, 13.0], [22.0, 23.0]]


def test_values_for_each_unknown_and_defaults(spark):
    table = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b")], "dof long, key string")
    schema = "key string, dof long, value double"
    params = lambda *rows: spark.createDataFrame(rows, schema)
    waiting = C.Valued(table, default=9.0)
    values = lambda cs: {r.dof: r.value for r in cs[0].table.collect()}
    assert values(C.with_values([waiting], params(("a", None, 1.0), ("a", 1, 2.0)))) == {0: 1.0, 1: 2.0, 2: 9.0}
    assert values(C.with_values([C.Valued(table)], params(("a", None, 1.0), ("b", 2, 5.0)))) == {0: 1.0, 1: 1.0, 2: 5.0}
    for bad in ([("a", None, 1.0)], [("a", None, 1.0), ("a", None, 2.0), ("b", None, 1.0)], [("a", None, 1.0), ("b", None, 1.0), ("c", None, 1.0)], [("a", None, 1.0), ("b", None, 1.0), ("b", 1, 3.0)]):
        with pytest.raises(KeyError):
            C.with_values([C.Valued(table)], params(*bad))


# Colourings.


def _greedy(rows, order):
    cols = sorted({c for r in rows.values() for c in r})
    near = {c: {d for r in rows.values() if c in r for d in r} - {c} for c in cols}
    if order == "degree":
        cols.sort(key=lambda c: (-len(near[c]), -c))
    colors = {}
    for c in cols:
        taken = {colors[d] for d in near[c] if d in colors}
        colors[c] = next(k for k in itertools.count() if k not in taken)
    return colors


@pytest.mark.parametrize("order", ["index", "degree"])
@pytest.mark.parametrize("block", [9, 1000])
def test_colours_are_those_of_the_sequential_greedy(spark, order, block):
    rng = random.Random(block)
    rows = {r: set(rng.sample(range(40), rng.randint(1, 4))) for r in range(35)}
    pattern = spark.createDataFrame([(r, c) for r, cs in rows.items() for c in cs], "row long, col long")
    got = {r.dof: r.color for r in matrices.colour_in_order(pattern, order, block).collect()}
    assert got == _greedy(rows, order)
    assert matrices.colour_conflicts(pattern, matrices.colour(pattern)).count() == 0


def test_no_columns_no_colours_and_seeds(spark):
    none = spark.createDataFrame([], "row long, col long")
    assert matrices.colour_in_order(none).count() == matrices.colour(none).count() == 0
    coo = spark.createDataFrame([(0, 0, 2.0), (0, 1, 3.0), (1, 1, 5.0), (2, 2, 7.0)], "row long, col long, v double")
    colors = matrices.colour_in_order(coo)
    ones = matrices.seeds(colors)
    first = matrices.matvec(coo, ones.filter("color = 0").select("dof", "v"))
    assert {(r.row, r.v) for r in first.collect()} == {(r.row, r.v) for r in matrices.compress(coo, colors).filter("color = 0").collect()}


# Solutions.


def test_conjugate_gradients(spark):
    schema = "row long, col long, v double"
    coo = spark.createDataFrame([(0, 0, 2.0), (0, 1, -1.0), (1, 0, -1.0), (1, 1, 2.0)], schema)
    load = lambda *rows: spark.createDataFrame(rows, "dof long, v double")
    assert _vector(matrices.solve_cg(coo, load((0, 1.0))), 2, value="x") == pytest.approx([2 / 3, 1 / 3])
    assert _vector(matrices.solve_cg(coo, spark.createDataFrame([], "dof long, v double")), 2, value="x") == pytest.approx([0, 0])
    many = spark.createDataFrame([(0, [1.0, 0.0, 3.0])], "dof long, v array<double>")
    got = {r.dof: r.x for r in matrices.solve_cg(coo, many).collect()}
    assert got[0] == pytest.approx([2 / 3, 0, 2]) and got[1] == pytest.approx([1 / 3, 0, 1])
    with pytest.raises(RuntimeError):
        matrices.solve_cg(coo, load((0, 1.0)), most=1)
    with pytest.raises(ValueError, match="positive"):
        matrices.solve_cg(spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, 3.0), (1, 1, 1.0)], schema), load((0, 1.0), (1, -1.0)))
    with pytest.raises(ValueError, match="diagonal"):
        matrices.solve_cg(spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0)], schema), load((0, 1.0)))
    with pytest.raises(ValueError, match="no row"):
        matrices.solve_cg(coo, load((9, 1.0)))


@pytest.mark.parametrize("etype", ["tri3", "tet4", "line2"])
def test_projection_reproduces_linear_fields(spark, etype):
    mesh = {"line2": lambda: line_mesh(spark, 6), "tet4": lambda: box(spark, (1.0, 1.0, 1.0), (2, 1, 1)), "tri3": lambda: rectangle(spark, (0, 1), (0, 2), 3, 2), "quad4": lambda: rectangle(spark, (0, 1), (0, 2), 3, 2, "quad4")}[etype]()
    x = fields.project(mesh, lambda m: [fields.value(m, "x") * 2.0 + 1.0, -fields.value(m, "x")])
    rows = mesh.nodes.join(x, mesh.nodes.node_id == x.dof).collect()
    assert len(rows) == mesh.nodes.count() and all(r["x"] is not None for r in rows)
    at = {r.node_id: r.x for r in mesh.nodes.collect()}
    assert all(r.x == pytest.approx([2 * at[r.dof] + 1, -at[r.dof]], abs=1e-7) for r in x.collect())


def test_constrained_projection_is_the_nearest_of_its_kind(spark):
    mesh = rectangle(spark, (0, 1), (0, 1), 3, 3)
    n = mesh.nodes.count()
    cs = [C.Periodic(spark.createDataFrame([(i, 12 + i) for i in range(4)], "dof long, master long")), C.Fixed(spark.createDataFrame([(4 * i, 0.5) for i in range(4)], "dof long, value double"))]
    x = fields.project(mesh, lambda m: fields.value(m, "x") * fields.value(m, "y"), constraints=cs)
    at = fields.sufficient(mesh)
    m = _dense(fields.bilinear_form(at, mass=F.lit(1.0)), n)
    b = _vector(fields.linear_form(at, fields.value(at, "x") * fields.value(at, "y")), n, "node_id")
    free = [i for i in range(n) if i > 3 and i % 4]
    t, c = np.zeros((n, len(free))), np.zeros(n)
    for k, i in enumerate(free):
        t[i, k] = 1
        if i >= 12:
            t[i - 12, k] = 1
    c[[0, 4, 8, 12]] = 0.5
    assert np.allclose(_vector(x, n, value="x"), t @ np.linalg.solve(t.T @ m @ t, t.T @ (b - m @ c)) + c, atol=1e-7)


# Points.


def test_corners_make_the_ring(spark):
    nodes = [(0, 0.0, 0.0), (1, 2.0, 0.0), (2, 0.0, 2.0), (3, 1.0, 0.0), (4, 1.0, 1.0), (5, 0.0, 1.0)]
    mesh = Mesh(spark.createDataFrame(nodes, "node_id long, x double, y double"), spark.createDataFrame([(0, list(range(6)))], "elem_id long, conn array<long>"), "tri6")
    points = spark.createDataFrame([(0, 0.2, 1.2), (1, 0.9, 0.9), (2, 0.9, 0.3), (3, 1.5, 1.5)], "point_id long, px double, py double")
    assert {r.point_id: r.elem_id for r in locate.locate(mesh, points).collect()} == {0: 0, 1: 0, 2: 0, 3: -1}
    field = mesh.nodes.select("node_id", (F.col("x") * F.col("x") - F.col("y")).alias("v"))
    got = {r.point_id: r.v for r in locate.interpolate(mesh, field, points).collect()}
    assert [got[i] for i in range(3)] == pytest.approx([0.04 - 1.2, 0.81 - 0.9, 0.81 - 0.3], abs=1e-9) and got[3] is None
    with pytest.raises(ValueError, match="outside"):
        locate.interpolate(mesh, field, points, on_outside="error")
    assert locate.interpolate(mesh, field, points.filter("point_id < 3"), on_outside="error").count() == 3


@pytest.mark.parametrize("etype", ["quad4", "quad8", "tri6"])
def test_newton_steps_meet_points_of_skewed_elements(spark, etype):
    e = ELEMENTS[etype]
    corners = np.array([[0, 0], [2, 0.3], [2.4, 2.2], [-0.2, 1.5]] if etype != "tri6" else [[0, 0], [2, 0.3], [0.4, 1.8]])
    n = len(corners)
    at = np.concatenate([corners, [(corners[i] + corners[(i + 1) % n]) / 2 + (0.05 if i == 1 else 0) for i in range(n)]])[: len(e.nodes)]
    mesh = Mesh(spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "node_id long, x double, y double"), spark.createDataFrame([(0, list(range(len(at))))], "elem_id long, conn array<long>"), etype)
    rng = np.random.default_rng(1)
    ref = rng.uniform(-0.7, 0.7, (20, 2)) if etype != "tri6" else 1 / 3 + 0.6 * (rng.dirichlet([2, 2, 2], 20)[:, :2] - 1 / 3)
    u = rng.uniform(-1, 1, (len(at), 2))
    places, values = e.values(ref) @ at, e.values(ref) @ u
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(places)], "point_id long, px double, py double")
    field = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(u)], "node_id long, v array<double>")
    got = {r.point_id: r.v for r in locate.interpolate(mesh, field, points, steps=15).collect()}
    assert all(got[i] == pytest.approx(values[i], abs=1e-9) for i in range(20))


def test_pairs_in_slots_are_those_of_one_sort(spark):
    mesh = rectangle(spark, (0, 3), (0, 1), 30, 2)
    low, high = (select_nodes(mesh, "y", w) for w in ("min", "max"))
    expected = [(3 * i, 3 * i + 2) for i in range(31)]
    for width in (None, 0.25, 10.0):
        assert sorted((r.dof, r.master) for r in pair_boundaries(mesh, low, high, "x", width).collect()) == expected


def test_local_elements_and_pointers(spark):
    mesh = rectangle(spark, (0, 1), (0, 1), 2, 2, "quad4")
    partition = mesh.elements.select("elem_id", F.expr("cast(elem_id div 2 as int)").alias("part"))
    layout = parts.local_nodes(mesh.elements, partition)
    to = {(r.part, r.local_id): r.node_id for r in layout.collect()}
    conn = {r.elem_id: r.conn for r in mesh.elements.collect()}
    for r in parts.local_elements(mesh.elements, partition, layout).collect():
        assert [to[r.part, i] for i in r.conn] == conn[r.elem_id]
    counts = parts.owned_row_counts(matrices.mesh_pattern(mesh.elements), layout)
    sizes, seen = {(r.part, r.local_id): r.n for r in counts.collect()}, {}
    for (part, _), n in sorted(sizes.items()):
        seen.setdefault(part, [0]).append(seen.get(part, [0])[-1] + n)
    assert all(seen[r.part][r.local_id] == r.ptr for r in matrices.part_pointer(counts).collect())
    assert {r.part: r.nnz for r in parts.owned_nnz(counts).collect()}[None] == sum(sizes.values())


# Heavy terms, borders, ownership.


def test_cliques_count_contain_and_multiply_as_their_pairs(spark):
    rng = random.Random(5)
    sets = {t: rng.sample(range(60), k) for t, k in enumerate([2, 3, 1, 25, 30, 4, 28, 2])}
    dep = spark.createDataFrame([(t, d) for t, ds in sets.items() for d in ds] * 2, "term_id long, dof long")
    pairs = {(a, b) for ds in sets.values() for a in ds for b in ds}
    x = spark.createDataFrame([(i, i * 0.5) for i in range(60)], "dof long, v double")
    for heavy in (0, 5, 100):
        p = terms.pattern_of_terms(dep, heavy)
        got = {r.row: (r.n, r.v) for r in p.sums(x).collect()}
        rows = {a: [b for c, b in pairs if c == a] for a, _ in pairs}
        assert got == {a: (len(bs), pytest.approx(sum(b * 0.5 for b in bs))) for a, bs in rows.items()}
        every = spark.createDataFrame([(a, b) for a in range(60) for b in range(60)], "row long, col long")
        assert {(r.row, r.col) for r in p.missing(every).collect()} == {(a, b) for a in range(60) for b in range(60)} - pairs
    assert {(r.row, r.col) for r in terms.pattern_of_terms(dep, 5).expanded().collect()} == pairs
    none = terms.pattern_of_terms(dep.limit(0), n=3)
    assert {(r.row, r.n) for r in none.sums(x).collect()} == {(0, 1), (1, 1), (2, 1)}


def test_a_term_of_very_many_unknowns_is_not_squared(spark):
    n = 10**6
    dep = spark.range(n).select(F.lit(0).cast("long").alias("term_id"), F.col("id").alias("dof"))
    got = terms.pattern_of_terms(dep).sums(dep.select("dof", F.lit(1.0).alias("v"))).agg(F.count("*"), F.min("n"), F.max("v")).first()
    assert tuple(got) == (n, n, float(n))


def test_bordered_products_and_reductions(spark):
    rng = np.random.default_rng(7)
    n, few = 9, [3, 8]
    k = np.where(rng.random((n, n)) < 0.5, rng.standard_normal((n, n)), 0)
    coo = spark.createDataFrame([(i, j, float(k[i, j])) for i in range(n) for j in range(n) if k[i, j]], "row long, col long, v double")
    shared = spark.createDataFrame([(i,) for i in few], "dof long")
    b = bordered.bordered(coo, shared)
    x = rng.standard_normal(n)
    y = _vector(b.matvec(spark.createDataFrame(list(enumerate(map(float, x))), "dof long, v double")), n, "row")
    assert np.allclose(np.nan_to_num(y), k @ x) and b.core.filter("row in (3, 8) or col in (3, 8)").count() == 0
    dofs = spark.range(n).withColumnRenamed("id", "dof")
    cs = C.composed([C.Periodic(spark.createDataFrame([(0, 5)], "dof long, master long")), C.Fixed(spark.createDataFrame([(1, 0.0)], "dof long, value double"))]).kept()
    free = C.free_dofs(dofs, cs)
    assert np.allclose(_dense(b.reduced(free, cs).coo(), n - 2), _dense(C.reduce_matrix(coo, free, cs), n - 2))
    with pytest.raises(ValueError):
        b.reduced(C.free_dofs(dofs, [C.Fixed(spark.createDataFrame([(3, 0.0)], "dof long, value double"))]), [C.Fixed(spark.createDataFrame([(3, 0.0)], "dof long, value double"))])
    with pytest.raises(ValueError):
        bordered.bordered(coo, shared, most=1)
    lay = states.layout([states.Field("u", (3, 2)), states.Field("s", (3,), "shared")], 3)
    counts = {(r.block_row, r.block_col): r.n for r in bordered.block_counts(coo, lay).collect()}
    assert counts == {(a, c): int((k[s, t] != 0).sum()) for a, s in ((0, slice(6)), (1, slice(6, 9))) for c, t in ((0, slice(6)), (1, slice(6, 9)))}
    assert np.allclose(_dense(bordered.block_entries(coo, lay, 1, 0), 3, 6), k[6:, :6])


def test_ownership_of_all_kinds(spark):
    mesh = rectangle(spark, (0, 1), (0, 1), 2, 2, "quad4")
    partition = mesh.elements.select("elem_id", F.expr("cast(elem_id div 2 as int)").alias("part"))
    some = spark.createDataFrame([(8,), (1,), (4,)], "node_id long")
    kinds = [states.Field("l", (states.AUTO,), nodes=some), states.Field("u", (states.AUTO, 2)), states.Field("own", (1, 2), "local"), states.Field("s", (2,), "shared")]
    own = spark.createDataFrame([(0, 3), (1, 1)], "part int, n long")
    rows = parts.ownership(states.layout(kinds, 9), parts.local_nodes(mesh.elements, partition), {"own": own}).collect()
    for part, n in ((0, 2 + 12 + 6 + 2), (1, 2 + 12 + 2 + 2)):
        assert sorted(r.local_dof for r in rows if r.part == part) == [*range(n)]
    owned = [r for r in rows if r.is_owned]
    assert sorted(r.global_dof for r in owned) == [*range(3 + 18 + 8 + 2)] == sorted(r.dof for r in owned)
    assert [r.global_dof for r in sorted(owned, key=lambda r: (r.part, r.local_dof))] == [*range(31)]
    number = {r.dof: r.global_dof for r in owned}
    assert all(r.global_dof == number[r.dof] for r in rows)
    assert {(r.part, r.dof) for r in rows if r.name == "s"} == {(p, 29 + i) for p in (0, 1) for i in (0, 1)} and {r.part for r in owned if r.name == "s"} == {0}
    assert {r.dof for r in rows if r.name == "own" and r.part == 1} == {27, 28}


def test_masters_on_no_part_are_an_error(spark):
    mesh = rectangle(spark, (0, 1), (0, 1), 2, 2, "quad4")
    partition = mesh.elements.select("elem_id", F.expr("cast(elem_id div 2 as int)").alias("part"))
    dofs = parts.dof_layout(parts.local_nodes(mesh.elements, partition))
    more = parts.with_extra_ghosts(dofs, spark.createDataFrame([(0, 8), (1, 8)], "dof long, master long"))
    assert [(r.part, r.local_dof) for r in more.filter("natural_dof = 8").orderBy("part").collect()] == [(0, 6), (1, 2)]
    with pytest.raises(ValueError):
        parts.with_extra_ghosts(dofs, spark.createDataFrame([(0, 99)], "dof long, master long"))


def test_a_node_that_a_field_lacks_is_an_error(spark):
    some = spark.createDataFrame([(2,), (7,)], "node_id long")
    lay = states.layout([states.Field("u", (9, 2)), states.Field("l", (states.AUTO,), nodes=some)], 9)
    wanted = spark.createDataFrame([(7,), (3,)], "node_id long")
    assert {(r.node_id, r.dof) for r in states.global_dofs(lay, "l", wanted, on_missing="null").collect()} == {(7, 19), (3, None)}
    for name, rows in (("l", wanted), ("u", spark.createDataFrame([(9,)], "node_id long"))):
        with pytest.raises(KeyError):
            states.global_dofs(lay, name, rows)
    with pytest.raises(IndexError):
        states.global_dofs(lay, "u", wanted, comp=2)


@pytest.mark.parametrize("order", ["index", "degree"])
def test_blocks_of_the_greedy_are_cut_by_columns_and_neighbours(spark, monkeypatch, order):
    monkeypatch.setattr(matrices, "BLOCK", 40)
    rng = random.Random(3)
    rows = {r: set(rng.sample(range(30), rng.randint(1, 4))) for r in range(25)}
    pattern = spark.createDataFrame([(r, c) for r, cs in rows.items() for c in cs], "row long, col long")
    got = {r.dof: r.color for r in matrices.colour_in_order(pattern, order).collect()}
    assert got == _greedy(rows, order)


def test_small_cliques_beside_a_large_one_do_not_multiply_it(spark):
    n = 99_999
    large = spark.range(n).select(F.lit(-1).cast("long").alias("term_id"), F.col("id").alias("dof"))
    threes = spark.range(n).select(F.expr("id div 3").alias("term_id"), F.col("id").alias("dof"))
    got = terms.pattern_of_terms(large.unionByName(threes), 2).sums(large.select("dof", F.lit(1.0).alias("v"))).agg(F.count("*"), F.min("n"), F.max("n"), F.max("v")).first()
    assert tuple(got) == (n, n, n, float(n))


def test_several_large_cliques_are_united_once(spark, monkeypatch):
    monkeypatch.setattr(terms, "HEAVY", 10)
    rng = random.Random(8)
    sets = {t: rng.sample(range(40), k) for t, k in enumerate([2, 3, 20, 25, 6, 8, 22, 7, 1])}
    dep = spark.createDataFrame([(t, d) for t, ds in sets.items() for d in ds], "term_id long, dof long")
    pairs = {(a, b) for ds in sets.values() for a in ds for b in ds}
    got = {r.row: (r.n, r.v) for r in terms.pattern_of_terms(dep, 5).sums(dep.select("dof", (F.col("dof") * 1.0).alias("v")).distinct()).collect()}
    assert got == {a: (sum(c == a for c, _ in pairs), float(sum(b for c, b in pairs if c == a))) for a, _ in pairs}


# What is moved and how often tables are read.


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_layouts_of_parts_read_their_elements_once_a_use(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    elements = spark.createDataFrame([(e, [e, e + 1, (e * 7) % 20]) for e in range(20)], "elem_id long, conn array<long>").mapInArrow(count, "elem_id long, conn array<long>")
    partition = spark.range(20).select(F.col("id").alias("elem_id"), (F.col("id") % 3).cast("int").alias("part"))
    dofs = parts.dof_layout(parts.local_nodes(elements, partition))
    tied = spark.createDataFrame([(3, 11), (4, 12)], "dof long, master long")
    assert parts.reduced_layout(dofs, tied).count() > 0 and parts.missing_masters(dofs, tied).count() >= 0
    assert seen.value == 20


def test_pairs_are_made_unique_one_way(spark):
    elements = spark.createDataFrame([(0, [3, 1, 2]), (1, [2, 3, 3]), (2, [5])], "elem_id long, conn array<long>")
    want = {(a, b) for c in ({1, 2, 3}, {5}) for a in c for b in c}
    rows = [tuple(r) for r in matrices.mesh_pattern(elements).collect()]
    assert len(rows) == len(want) and set(rows) == want
    pattern = spark.createDataFrame([(0, 3), (0, 1), (0, 2), (1, 2), (1, 3), (1, 3), (2, 5)], "row long, col long")
    rows = [tuple(r) for r in matrices.row_neighbours(pattern).collect()]
    assert len(rows) == 6 and set(rows) == {(a, b) for a, b in want if a != b}
    rows = [tuple(r) for r in matrices.term_pattern(pattern.toDF("term_id", "dof")).collect()]
    assert len(rows) == len(want) and set(rows) == want
    for moved in (matrices.mesh_pattern(elements), matrices.row_neighbours(pattern), matrices.term_pattern(pattern.toDF("term_id", "dof"))):
        last = _plan(moved).split("Exchange")[1]  # what the last shuffle moves is one way, and not aggregated before
        assert "REPARTITION_BY_NUM" in last and "HashAggregate" not in last.split("+-")[1]


def test_elements_of_parts_add_up_as_their_matrices(spark):
    conn = {0: (0, [3, 1, 3, 2]), 1: (0, [2]), 2: (1, [1, 4, 2]), 3: (1, [4, 4, 4]), 4: (2, [3, 2]), 5: (2, [0, 1, 3, 3])}
    elements = spark.createDataFrame([(e, p, c) for e, (p, c) in conn.items()], "elem_id long, part int, conn array<long>")
    layout = written(parts.local_nodes(elements), "layout")
    assert sorted(map(tuple, layout.collect())) == sorted(map(tuple, parts.local_nodes(elements.drop("part"), elements.drop("conn")).collect()))
    dofs = parts.dof_layout(layout)
    number = {(r.part, r.natural_dof): (r.local_dof, r.global_dof) for r in dofs.collect()}
    ends = spark.createDataFrame([(p, e, number[p, n][0]) for e, (p, c) in conn.items() for n in c], "part int, elem_id long, local_dof long")
    want, local = {}, {}
    for p, c in conn.values():
        for a, b in itertools.product(c, c):
            for table, key in ((want, (number[p, a][1], number[p, b][1])), (local, (p, number[p, a][0], number[p, b][0]))):
                table[key] = table.get(key, 0.0) + 1
    got = [tuple(r) for r in parts.ghost_add_elements(dofs, ends).collect()]
    assert sorted(got) == sorted((*k, v) for k, v in want.items())
    of_matrices = parts.ghost_add_matrix(dofs, spark.createDataFrame([(*k, v) for k, v in local.items()], "part int, row long, col long, v double"))
    assert sorted(map(tuple, of_matrices.collect())) == sorted(got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pairs_of_parts_move_once(spark):
    last = _plan(more.j7_ghost_add_matrix(spark, SF)).split("Exchange")[1]
    assert "REPARTITION_BY_NUM" in last and "Aggregate" not in last.split("+-")[1] and "Join" not in last.split("+-")[1]


def test_entries_meet_in_one_pass(spark):
    pattern = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (2, 1), (3, 3), (1, 4), (None, 2), (2, None)], "row long, col long")
    got = matrices.asymmetric(pattern)
    assert sorted(map(str, got.collect())) == sorted(map(str, pattern.filter("row IS NULL OR col IS NULL OR (row = 2 AND col = 1) OR (row = 1 AND col = 4)").collect()))
    other = spark.createDataFrame([(0, 1), (5, 5), (5, 5), (2, 1), (None, 2)], "row long, col long")
    lacking = matrices.missing_entries(pattern, other)
    assert sorted(map(str, lacking.collect())) == ["Row(row=5, col=5)", "Row(row=None, col=2)"]
    assert "Join" not in _plan(got) + _plan(lacking)


def test_colouring_moves_an_edge_once_for_its_later_end(spark, monkeypatch):
    rng = random.Random(5)
    pattern = spark.createDataFrame([(r, c) for r in range(600) for c in rng.sample(range(120), 4)], "row long, col long")
    rows = []

    def counted(df, name, *instead, **more):
        out = written(df, name, *instead, **more)
        if name in ("graph", "edges", "reached", "open"):
            rows.append(out.count())
        return out

    monkeypatch.setattr(matrices, "written", counted)
    colors = matrices.colour(pattern)
    assert colors.count() == 120 and matrices.colour_conflicts(pattern, colors).count() == 0
    assert sum(rows) < 2 * matrices.row_neighbours(pattern).count()


def test_conjugate_gradients_over_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(matrices, "TILE", 3)
    rng = np.random.default_rng(2)
    a = rng.uniform(-1, 1, (8, 8)) * (rng.uniform(size=(8, 8)) < 0.4)
    a = a + a.T + 9 * np.eye(8)
    coo = spark.createDataFrame([(i * 10, j * 10, float(a[i, j])) for i in range(8) for j in range(8) if a[i, j]], "row long, col long, v double")
    rhs = rng.uniform(-1, 1, (8, 2))
    x = matrices.solve_cg(coo, spark.createDataFrame([(i * 10, r.tolist()) for i, r in enumerate(rhs)], "dof long, v array<double>")).collect()
    assert len(x) == 8 and np.allclose([r.x for r in sorted(x)], np.linalg.solve(a, rhs))


def _shuffled(spark, action):
    """Records that the stages of the action write to shuffles."""
    before = {s.stageId() for s in _stages(spark)}
    action()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(s.shuffleWriteRecords() for s in _stages(spark) if s.stageId() not in before)


def _stages(spark):
    jvm, store = spark._jvm, spark._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return [stages.apply(i) for i in range(stages.size())]


def test_pairs_of_terms_move_once(spark):
    rng = random.Random(11)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    dep = [(f"small {t}", d) for t in range(400) for d in rng.sample(range(2000), 12)] + [(f"large {d % 2}", d) for d in range(2000)]
    table = spark.createDataFrame(dep, "term_id string, dof long").mapInArrow(count, "term_id string, dof long")
    x = spark.range(2000).select(F.col("id").alias("dof"), (F.col("id") * 1.0).alias("v"))
    got = {}
    moved = _shuffled(spark, lambda: got.update({r.row: (r.n, r.v) for r in terms.pattern_of_terms(table, 12).sums(x).collect()}))
    sets, want = {}, {d: {c for c in range(2000) if (c - d) % 2 == 0} for d in range(2000)}
    for t, d in dep[:4800]:
        sets.setdefault(t, []).append(d)
    for ds in sets.values():
        for d in ds:
            want[d].update(ds)
    assert got == {d: (len(cs), float(sum(cs))) for d, cs in want.items()}
    apart = sum((a - b) % 2 for ds in sets.values() for a in ds for b in ds)
    assert moved < apart + 8 * len(dep)  # pairs once, beside them unknowns alone
    assert seen.value <= 3 * len(dep)


def test_tables_of_unknowns_are_not_broadcast_in_sums(spark):
    dep = spark.createDataFrame([(t, d) for t in range(4) for d in range(t, 12, t + 1)], "term_id long, dof long")
    sums = terms.pattern_of_terms(dep, 3).sums(spark.range(12).select(F.col("id").alias("dof"), F.lit(1.0).alias("v")))
    assert "Broadcast" not in _plan(sums) and "SortMergeJoin" in _plan(sums)
