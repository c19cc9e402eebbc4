"""Fields over meshes: gather, evaluate, differentiate, integrate, assemble."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.basis import ELEMENTS, basis_table, dot, geometry, with_quadrature
from ..sources.grids import Mesh
from . import constraints as constrain
from .cut import written
from .matrices import solve_cg

AXES = ("x", "y", "z")


def gather(mesh: Mesh, **fields: DataFrame) -> DataFrame:
    """elem_id, conn, x, y[, z] and each field (node_id, v) as arrays in local node order.

    One pass: the ends of elements meet nodes and fields on node_id (the ends move once, all joins
    share their partitioning), then go back to their element by an aggregate of fixed width, which
    combines before it shuffles. A node without a value leaves a null; null values stay null. Nodes and
    fields grow with the mesh and are never broadcast, however small Spark takes them to be.
    """
    axes = [a for a in AXES if a in mesh.nodes.columns]
    table = mesh.nodes.select("node_id", *axes)
    for name, f in fields.items():
        table = table.join(f.select("node_id", F.col("v").alias(name)).hint("merge"), "node_id", "left")
    ends = mesh.elements.select("elem_id", F.posexplode("conn").alias("_a", "node_id"))
    names, size = ["node_id", *axes, *fields], len(ELEMENTS[mesh.etype].nodes)
    picked = [F.max(F.when(F.col("_a") == k, F.col(c))).alias(f"_{c}_{k}") for c in names for k in range(size)]
    rows = ends.join(table.hint("merge"), "node_id").groupBy("elem_id").agg(*picked)
    return rows.select("elem_id", *(F.array(*(f"_{c}_{k}" for k in range(size))).alias("conn" if c == "node_id" else c) for c in names))


def at_quads(mesh: Mesh, **fields: DataFrame) -> DataFrame:
    """Every element at every quadrature point: elem_id, q, conn, _n, _g (directions x nodes), det, wt, coordinates, fields."""
    if taken := {"elem_id", "conn", "q", "wt", "det", *AXES} & {*fields} or {f for f in fields if f.startswith("_")}:
        raise ValueError(f"reserved field names: {sorted(taken)}")
    basis = basis_table(mesh.nodes.sparkSession, mesh.etype).select("q", F.col("w").alias("_w"), F.col("n").alias("_n"), F.col("dn").alias("_dn"))
    rows = gather(mesh, **fields).crossJoin(F.broadcast(basis))
    axes = [F.col(a) for a in AXES if a in mesh.nodes.columns]
    det, grads = geometry(mesh.etype, axes, F.col("_dn"))
    out = rows.withColumn("det", det).withColumn("_g", F.array(*grads))
    return out.withColumn("wt", F.col("det") * F.col("_w")).drop("_dn", "_w")


def _k(mesh: Mesh) -> int:
    return len(ELEMENTS[mesh.etype].nodes)


def value(mesh: Mesh, name: str) -> Column:
    return dot(F.col("_n"), F.col(name), _k(mesh))


def slope(mesh: Mesh, name: str, direction: int) -> Column:
    return dot(F.col("_g")[direction], F.col(name), _k(mesh))


def values(mesh: Mesh, name: str) -> Column:
    """The components of a field of arrays at a point."""
    u, k = F.col(name), _k(mesh)
    return F.transform(u[0], lambda _, c: sum((F.col("_n")[a] * u[a][c] for a in range(1, k)), F.col("_n")[0] * u[0][c]))


def slopes(mesh: Mesh, name: str, direction: int) -> Column:
    """The slope of each component of a field of arrays along a direction."""
    u, g, k = F.col(name), F.col("_g")[direction], _k(mesh)
    return F.transform(u[0], lambda _, c: sum((g[a] * u[a][c] for a in range(1, k)), g[0] * u[0][c]))


def evaluate_components(mesh: Mesh, field: DataFrame) -> DataFrame:
    """elem_id, q, c, wt, v of a nodal field of arrays, tensors flattened by rows."""
    return at_quads(mesh, u=field).select("elem_id", "q", "wt", F.posexplode(values(mesh, "u")).alias("c", "v"))


def gradient_components(mesh: Mesh, field: DataFrame) -> DataFrame:
    """elem_id, q, c, d, v: of each component the slope along each direction."""
    rows = at_quads(mesh, u=field).withColumn("_s", F.array(*(slopes(mesh, "u", d) for d in range(ELEMENTS[mesh.etype].dim))))
    return rows.select("elem_id", "q", F.posexplode("_s").alias("d", "_v")).select("elem_id", "q", "d", F.posexplode("_v").alias("c", "v"))


def per_element_components(mapped: DataFrame) -> DataFrame:
    """elem_id, c, v: the integral of each component over each element."""
    return mapped.groupBy("elem_id", "c").agg(F.sum(F.col("v") * F.col("wt")).alias("v"))


def integrate(mesh: Mesh, number: float) -> DataFrame:
    """elem_id, v: a number's integral over each element."""
    return integration_weights(mesh).groupBy("elem_id").agg((F.sum("wt") * F.lit(float(number))).alias("v"))


def on_elements(mesh: Mesh, elements: DataFrame, etype: str) -> Mesh:
    """The same nodes under other elements, such as the lines of a boundary; fields of the nodes serve both."""
    return Mesh(mesh.nodes, elements, etype)


def evaluate(mesh: Mesh, field: DataFrame) -> DataFrame:
    """elem_id, q, v of a nodal field."""
    return at_quads(mesh, u=field).select("elem_id", "q", value(mesh, "u").alias("v"))


def gradient(mesh: Mesh, field: DataFrame) -> DataFrame:
    """elem_id, q, d, v: the slope along each direction of space."""
    dim = ELEMENTS[mesh.etype].dim
    rows = at_quads(mesh, u=field)
    slopes = F.posexplode(F.array(*(slope(mesh, "u", d) for d in range(dim)))).alias("d", "v")
    return rows.select("elem_id", "q", slopes)


def quad_points(mesh: Mesh) -> DataFrame:
    """elem_id, q and the coordinates of quadrature points."""
    axes = [a for a in AXES if a in mesh.nodes.columns]
    return at_quads(mesh).select("elem_id", "q", *(value(mesh, a).alias(a) for a in axes))


def integration_weights(mesh: Mesh) -> DataFrame:
    """elem_id, q, wt: determinant (signed) times weight."""
    return at_quads(mesh).select("elem_id", "q", "wt")


def map_quads(mesh: Mesh, kernel: Callable[[Mesh], Column], *, quantity: DataFrame | None = None, **fields: DataFrame) -> DataFrame:
    """elem_id, q, wt, v = kernel at every quadrature point; quantity(elem_id, ...) brings values of elements, null where it has none."""
    rows = at_quads(mesh, **fields)
    if quantity is not None:
        rows = rows.join(quantity, "elem_id", "left")
    return rows.select("elem_id", "q", "wt", kernel(mesh).alias("v"))


def map_points(mesh: Mesh, fn: Callable[[pa.RecordBatch], pa.Array], **fields: DataFrame) -> DataFrame:
    """elem_id, q, wt, v = fn on batches of points, for kernels that columns can't express: fn sees a column for each field's value and gives doubles."""
    rows = at_quads(mesh, **fields).select("elem_id", "q", "wt", *(value(mesh, f).alias(f) for f in fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], fn(b)], ["elem_id", "q", "wt", "v"])

    return rows.mapInArrow(run, "elem_id long, q int, wt double, v double")


def map_elements(mesh: Mesh, kernel: Column, **fields: DataFrame) -> DataFrame:
    """elem_id, v = kernel over the gathered arrays."""
    return gather(mesh, **fields).select("elem_id", kernel.alias("v"))


def per_element(mapped: DataFrame) -> DataFrame:
    """elem_id, v: the integral of v over each element."""
    return mapped.groupBy("elem_id").agg(F.sum(F.col("v") * F.col("wt")).alias("v"))


def diameters(mesh: Mesh) -> DataFrame:
    """elem_id, diameter: of the circumscribed circle or sphere of simplices, else the longest distance of nodes."""
    axes = [F.col(a) for a in AXES if a in mesh.nodes.columns]
    rows, k = gather(mesh), _k(mesh)
    across = lambda a, b: [x[b] - x[a] for x in axes]
    square = lambda v: sum((c * c for c in v[1:]), v[0] * v[0])
    cross = lambda a, b: [a[(i + 1) % 3] * b[(i + 2) % 3] - a[(i + 2) % 3] * b[(i + 1) % 3] for i in range(3)]
    tiny = F.lit(1e-12)
    if mesh.etype == "tri3":
        a, b, c = across(0, 1), across(0, 2), across(1, 2)
        area = F.abs(a[0] * b[1] - a[1] * b[0]) if len(axes) == 2 else F.sqrt(square(cross(a, b)))
        size = F.sqrt(square(a)) * F.sqrt(square(b)) * F.sqrt(square(c)) / F.greatest(area, tiny)
    elif mesh.etype == "tet4":
        a, b, c = across(0, 1), across(0, 2), across(0, 3)
        faces = [cross(b, c), cross(c, a), cross(a, b)]
        volume = F.abs(sum((p * q for p, q in zip(a[1:], faces[0][1:], strict=True)), a[0] * faces[0][0]))
        centre = [square(a) * faces[0][i] + square(b) * faces[1][i] + square(c) * faces[2][i] for i in range(3)]
        size = F.sqrt(square(centre)) / F.greatest(volume, tiny)
    else:
        size = F.sqrt(F.greatest(*(square(across(i, j)) for i in range(k) for j in range(i + 1, k)), F.lit(0.0)))
    return rows.select("elem_id", size.alias("diameter"))


# Material kernels: columns over the slopes of a displacement (u, w).


def lame(young: float, poisson: float, plane_stress: bool = False) -> tuple[float, float]:
    """mu and lambda of an isotropic material in plane strain (and in space), or in plane stress."""
    mu, lam = young / (2 * (1 + poisson)), young * poisson / ((1 + poisson) * (1 - 2 * poisson))
    return mu, 2 * mu * lam / (lam + 2 * mu) if plane_stress else lam


def strain(grad: list[list[Column]]) -> list[list[Column]]:
    """The symmetric part of a gradient, grad[i][j] the slope of component i along j."""
    n = len(grad)
    return [[(grad[i][j] + grad[j][i]) * F.lit(0.5) for j in range(n)] for i in range(n)]


def stress(eps: list[list[Column]], mu: float, lam: float) -> list[list[Column]]:
    trace = sum((eps[i][i] for i in range(1, len(eps))), eps[0][0])
    return [[F.lit(2 * mu) * eps[i][j] + (F.lit(lam) * trace if i == j else F.lit(0.0)) for j in range(len(eps))] for i in range(len(eps))]


def neo_hookean(grad: list[list[Column]], mu: float, lam: float) -> Column:
    """mu / 2 (I1 - d - 2 ln J) + lam / 2 (ln J)^2 in two or three dimensions; null where J is not positive."""
    d = len(grad)
    f = [[grad[i][j] + (F.lit(1.0) if i == j else F.lit(0.0)) for j in range(d)] for i in range(d)]
    minor = lambda a, b: f[1][a] * f[2][b] - f[1][b] * f[2][a]
    j = f[0][0] * f[1][1] - f[0][1] * f[1][0] if d == 2 else f[0][0] * minor(1, 2) - f[0][1] * minor(0, 2) + f[0][2] * minor(0, 1)
    squares = [c * c for row in f for c in row]
    log = F.ln(F.when(j > 0, j))
    return F.lit(mu / 2) * (sum(squares[1:], squares[0]) - F.lit(float(d)) - F.lit(2.0) * log) + F.lit(lam / 2) * log * log


def active_set_potential(multiplier: Column, value: Column, active: Column) -> Column:
    """multiplier * value where active, half the multiplier squared elsewhere."""
    return F.when(active, multiplier * value).otherwise(F.lit(0.5) * multiplier * multiplier)


def scaled_by_mean(mapped: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """mapped with v times the mean of a column of a whole table, which is one row and broadcast."""
    mean = table.agg(F.avg(F.col(column).cast("double")).alias("_m"))
    return mapped.crossJoin(F.broadcast(mean)).withColumn("v", F.col("v") * F.col("_m")).drop("_m")


def linear_energy(mu: float, lam: float) -> Callable[[Mesh], Column]:
    """Half of stress times strain in two dimensions."""

    def kernel(mesh: Mesh) -> Column:
        xx, yy = slope(mesh, "u", 0), slope(mesh, "w", 1)
        xy = (slope(mesh, "u", 1) + slope(mesh, "w", 0)) * F.lit(0.5)
        return F.lit(mu) * (xx * xx + yy * yy + F.lit(2.0) * xy * xy) + F.lit(lam / 2) * (xx + yy) * (xx + yy)

    return kernel


def dirichlet(mesh: Mesh) -> Column:
    """The squared length of the gradient of u."""
    dim = ELEMENTS[mesh.etype].dim
    slopes = [slope(mesh, "u", d) for d in range(dim)]
    return sum((s * s for s in slopes[1:]), slopes[0] * slopes[0])


# Assembly.


def linear_form(mesh: Mesh, source: Column | None = None, *, flux: list[Column] | None = None, **fields: DataFrame) -> DataFrame:
    """node_id, v: the integral of N_i * source + grad N_i . flux, a column for each direction."""
    g = lambda a, d: F.col("_g")[d][a]
    rows, parts = at_quads(mesh, **fields), []
    for a in range(_k(mesh)):
        terms = [] if source is None else [source * F.col("_n")[a]]
        terms += [f * g(a, d) for d, f in enumerate(flux or [])]
        parts.append(F.struct(F.col("conn")[a].alias("node_id"), (sum(terms[1:], terms[0]) * F.col("wt")).alias("v")))
    return rows.select(F.inline(F.array(*parts))).groupBy("node_id").agg(F.sum("v").alias("v"))


def bilinear_entries(mesh: Mesh, *, mass: Column | None = None, stiffness: Column | None = None, diffusion: list[list[Column]] | None = None, ahead: list[Column] | None = None, behind: list[Column] | None = None, **fields: DataFrame) -> DataFrame:
    """row, col, v of each element's matrix, not summed: integrals of mass N_i N_j + stiffness grad N_i . grad N_j + grad N_i . diffusion grad N_j + N_i ahead . grad N_j + grad N_i . behind N_j."""
    k, dim = _k(mesh), ELEMENTS[mesh.etype].dim
    n, g = F.col("_n"), [F.col("_g")[d] for d in range(dim)]
    entries = []
    for a in range(k):
        for b in range(k):
            terms = []
            if mass is not None:
                terms.append(mass * n[a] * n[b])
            if stiffness is not None:
                terms.append(stiffness * sum((s[a] * s[b] for s in g[1:]), g[0][a] * g[0][b]))
            if diffusion is not None:
                terms += [g[d][a] * diffusion[d][e] * g[e][b] for d in range(dim) for e in range(dim)]
            terms += [n[a] * c * g[d][b] for d, c in enumerate(ahead or [])]
            terms += [g[d][a] * c * n[b] for d, c in enumerate(behind or [])]
            entries.append(F.struct(F.col("conn")[a].alias("row"), F.col("conn")[b].alias("col"), (sum(terms[1:], terms[0]) * F.col("wt")).alias("v")))
    return at_quads(mesh, **fields).select(F.inline(F.array(*entries)))


def bilinear_form(mesh: Mesh, **terms) -> DataFrame:
    """row, col, v: the entries of bilinear_entries, summed.

    What is shuffled is one entry for each pair of nodes of an element at a point, combined before
    the shuffle where neighbours share a task.
    """
    return bilinear_entries(mesh, **terms).groupBy("row", "col").agg(F.sum("v").alias("v"))


def matvec_free(mesh: Mesh, x: DataFrame, *, mass: float = 0.0, stiffness: float = 0.0) -> DataFrame:
    """row, v: the product with mass * M + stiffness * K without the matrix: gather, multiply within the element, add."""
    dim = ELEMENTS[mesh.etype].dim
    field = x.select(F.col("dof").alias("node_id"), "v")
    flux = [F.lit(stiffness) * slope(mesh, "x_", d) for d in range(dim)] if stiffness else None
    return linear_form(mesh, F.lit(mass) * value(mesh, "x_"), flux=flux, x_=field).select(F.col("node_id").alias("row"), "v")


def residual_and_tangent(mesh: Mesh, *, source: Column, flux: list[Column], mass: Column | None = None, diffusion: list[list[Column]] | None = None, **fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node_id, v and row, col, v of one form and its linearization, from gathered elements that are written once."""
    gathered = written(at_quads(mesh, **fields), "points")
    k, dim = _k(mesh), ELEMENTS[mesh.etype].dim
    n, g, wt = F.col("_n"), [F.col("_g")[d] for d in range(dim)], F.col("wt")
    parts, entries = [], []
    for a in range(k):
        parts.append(F.struct(F.col("conn")[a].alias("node_id"), (sum((f * g[d][a] for d, f in enumerate(flux)), source * n[a]) * wt).alias("v")))
        for b in range(k):
            terms = [] if mass is None else [mass * n[a] * n[b]]
            terms += [g[d][a] * diffusion[d][e] * g[e][b] for d in range(dim) for e in range(dim)] if diffusion else []
            entries.append(F.struct(F.col("conn")[a].alias("row"), F.col("conn")[b].alias("col"), (sum(terms[1:], terms[0]) * wt).alias("v")))
    residual = gathered.select(F.inline(F.array(*parts))).groupBy("node_id").agg(F.sum("v").alias("v"))
    return residual, gathered.select(F.inline(F.array(*entries))).groupBy("row", "col").agg(F.sum("v").alias("v"))


#: Quadratures that determine a projection where an element's own has one point: (points, weights), fixed values.
SUFFICIENT = {
    "line2": ([[-(1 / 3) ** 0.5], [(1 / 3) ** 0.5]], [1.0, 1.0]),
    "tri3": ([[1 / 6, 1 / 6], [2 / 3, 1 / 6], [1 / 6, 2 / 3]], [1 / 6] * 3),
    "tet4": ([[(5 + 3 * 5**0.5) / 20 if c == k else (5 - 5**0.5) / 20 for c in range(3)] for k in range(4)], [1 / 24] * 4),
}


def sufficient(mesh: Mesh) -> Mesh:
    """The mesh under a quadrature that is exact for products of two shape functions, where its own has one point."""
    if len(ELEMENTS[mesh.etype].points) > 1:
        return mesh
    if mesh.etype not in SUFFICIENT:
        raise ValueError("one point an element does not determine the projection; use lumped=True or another quadrature")
    return Mesh(mesh.nodes, mesh.elements, with_quadrature(mesh.etype, *SUFFICIENT[mesh.etype]))


def project(mesh: Mesh, kernel: Callable[[Mesh], Column | list[Column]], *, constraints: list | None = None, lumped: bool = False, tol: float = 1e-10, **fields: DataFrame) -> DataFrame:
    """dof, x: the nodal field that is nearest, in the mean square, to what kernel gives at the points.

    kernel gives one column, or a list of them for a vector or tensor: then x is an array, and all components are
    solved in one pass. Elements of one point get a sufficient quadrature, at which kernel is evaluated; lumped=True
    divides by the row sums instead (another result, without a solution). With constraints on node ids the
    nearest field among those that hold them is found, each component under the same constraints. Solved by
    conjugate gradients on the unknowns that are free.
    """
    mesh = mesh if lumped else sufficient(mesh)
    given = kernel(mesh)
    columns = given if isinstance(given, list) else [given]
    k, rows = _k(mesh), at_quads(mesh, **fields)
    one = lambda a: F.struct(F.col("conn")[a].alias("dof"), *((c * F.col("_n")[a] * F.col("wt")).alias(f"v_{i}") for i, c in enumerate(columns)))
    summed = rows.select(F.inline(F.array(*map(one, range(k))))).groupBy("dof").agg(*(F.sum(f"v_{i}").alias(f"v_{i}") for i in range(len(columns))))
    rhs = summed.select("dof", F.array(*(f"v_{i}" for i in range(len(columns)))).alias("v"))
    if lumped:
        if constraints:
            raise ValueError("a lumped projection takes no constraints")
        share = linear_form(mesh, F.lit(1.0)).select(F.col("node_id").alias("dof"), F.col("v").alias("_m"))
        solved = rhs.join(share, "dof").select("dof", F.transform("v", lambda v: v / F.col("_m")).alias("x"))
    else:
        mass = bilinear_form(mesh, mass=F.lit(1.0))
        solved = _constrained_solution(mass, rhs, constraints, len(columns), tol) if constraints else solve_cg(mass, rhs, tol)
    return solved if isinstance(given, list) else solved.select("dof", F.col("x")[0].alias("x"))


def _constrained_solution(matrix: DataFrame, rhs: DataFrame, constraints: list, components: int, tol: float) -> DataFrame:
    """dof, x: every component solved under the same constraints; one reduced matrix and one solution for all."""
    matrix = written(matrix, "mass")
    dofs = written(rhs.select("dof"), "dofs")
    constraints = constrain.composed(constraints).kept()
    free = written(constrain.free_dofs(dofs, constraints), "free")
    reduced, loads = None, None
    for c in range(components):
        reduced, load = constrain.reduce_system(matrix, rhs.select("dof", F.col("v")[c].alias("v")), dofs, free, constraints)
        load = load.withColumnRenamed("v", f"v_{c}")
        loads = load if loads is None else loads.join(load, "reduced")
    x = solve_cg(reduced, loads.select(F.col("reduced").alias("dof"), F.array(*(f"v_{c}" for c in range(components))).alias("v")), tol)
    x = written(x.withColumnRenamed("dof", "reduced"), "reduced")
    zero, out = dofs.select("dof", F.lit(0.0).alias("v")), None
    for c in range(components):
        one = constrain.lift(x.select("reduced", F.col("x")[c].alias("v")), zero, free, constraints).withColumnRenamed("v", f"x_{c}")
        out = one if out is None else out.join(one, "dof")
    return out.select("dof", F.array(*(f"x_{c}" for c in range(components))).alias("x"))
