"""The element around each point, and values there."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.basis import ELEMENTS, dot
from ..sources.grids import Mesh
from .cut import written
from .fields import gather

ON_EDGE = 1e-8


def _inside(k: int) -> Column:
    """On an edge, or an odd number of edges to the right of the point; closed box first."""
    px, py = F.col("px"), F.col("py")
    touching, crossed = F.lit(False), F.lit(0)
    for a in range(k):
        x1, y1, x2, y2 = (F.col(c)[i] for i in (a, (a + 1) % k) for c in ("x", "y"))
        cross = (px - x1) * (y2 - y1) - (py - y1) * (x2 - x1)
        boxed = px.between(F.least(x1, x2), F.greatest(x1, x2)) & py.between(F.least(y1, y2), F.greatest(y1, y2))
        touching = touching | ((F.abs(cross) <= ON_EDGE) & boxed)
        straddles = ((y1 <= py) & (y2 > py)) | ((y2 <= py) & (y1 > py))
        hit = F.when(straddles, px < x1 + (py - y1) / (y2 - y1) * (x2 - x1)).otherwise(F.lit(False))
        crossed = crossed + hit.cast("int")
    return touching | (crossed % 2 == 1)


#: Corner nodes of elements whose further nodes lie on the sides between them; the others have corners alone.
CORNERS = {"tri6": 3, "quad8": 4}


def corners(etype: str) -> int:
    """How many of an element's first nodes are its ring; an element with a quadrature of its own (name@...) has the ring of its base."""
    return CORNERS.get(etype.split("@")[0], len(ELEMENTS[etype].nodes))


def _boxes(mesh: Mesh) -> DataFrame:
    """elem_id, the ring of corners x, y and its closed box."""
    n = corners(mesh.etype)
    rows = gather(mesh).select("elem_id", *(F.slice(c, 1, n).alias(c) for c in ("x", "y")))
    for c in ("x", "y"):
        rows = rows.withColumn(f"{c}0", F.array_min(c)).withColumn(f"{c}1", F.array_max(c))
    return rows


_POINT = ["point_id", "px", "py"]


def locate(mesh: Mesh, points: DataFrame) -> DataFrame:
    """point_id, elem_id of the smallest element that holds points(point_id, px, py); -1 if none does. A row for each point, repeated ids too.

    Points and elements meet in square bins, so an equi-join takes the place of the range join. An
    element uses the bins of the next power of two above its extent, at most four of them, and a
    point those of every power that occurs (few, as they are exponents); so a large element among
    small ones fills no more bins than they do. Points with null coordinates get -1.
    """
    found = _found(mesh, points)
    out = points.select(*_POINT).join(found, _POINT, "left")
    return out.select("point_id", F.coalesce("elem_id", F.lit(-1)).cast("long").alias("elem_id"))


def _found(mesh: Mesh, points: DataFrame) -> DataFrame:
    """point_id, px, py, elem_id of the points that an element holds."""
    rows = _boxes(mesh)
    extent = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-300))
    rows = written(rows.withColumn("level", F.ceil(F.log2(extent)).cast("int")), "boxes")
    levels = [r.level for r in rows.select("level").distinct().collect()]  # exponents of two
    bin_of = lambda c: F.floor(c / F.pow(F.lit(2.0), F.col("level")))
    span = lambda c: F.explode(F.sequence(bin_of(F.col(f"{c}0")), bin_of(F.col(f"{c}1"))))
    binned = rows.withColumn("bx", span("x")).withColumn("by", span("y"))
    at = points.select(*_POINT).distinct().withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    at = at.withColumn("bx", bin_of(F.col("px"))).withColumn("by", bin_of(F.col("py")))
    boxed = F.col("px").between(F.col("x0"), F.col("x1")) & F.col("py").between(F.col("y0"), F.col("y1"))
    held = at.join(binned, ["level", "bx", "by"]).filter(boxed).filter(_inside(corners(mesh.etype)))
    return held.groupBy(*_POINT).agg(F.min("elem_id").alias("elem_id"))


def _newton(mesh: Mesh, steps: int, tol: float) -> Column:
    """The reference coordinates (r, s) of a point in its element, as a fold over at most `steps` steps from the first quadrature point; a row stands still once the point is met to tol."""
    e = ELEMENTS[mesh.etype]
    k = len(e.nodes)
    coefficients = np.linalg.inv(np.prod(e.nodes[:, None, :] ** e.powers[None], axis=2))  # monomials x nodes
    power = lambda c, p: F.lit(1.0) if p == 0 else c if p == 1 else power(c, p - 1) * c

    def combined(at: Column, c: str, along: int | None) -> Column:
        """The coordinate, or its slope along a direction: a polynomial whose coefficients are sums over the nodes."""
        parts = []
        for m, exps in enumerate(e.powers.tolist()):
            factor = 1
            if along is not None:
                factor, exps = exps[along], [x - (i == along) for i, x in enumerate(exps)]
            if factor:
                weight = dot(F.array(*(F.lit(float(v * factor)) for v in coefficients[m])), F.col(c), k)
                parts.append(weight * power(at["r"], exps[0]) * power(at["s"], exps[1]))
        return sum(parts[1:], parts[0])

    def step(at: Column, _: Column) -> Column:
        dx, dy = F.col("px") - combined(at, "x", None), F.col("py") - combined(at, "y", None)
        xr, xs, yr, ys = (combined(at, c, d) for c in ("x", "y") for d in (0, 1))
        det = xr * ys - xs * yr
        moved = F.struct((at["r"] + (dx * ys - dy * xs) / det).alias("r"), (at["s"] + (dy * xr - dx * yr) / det).alias("s"))
        return F.when((dx * dx + dy * dy <= tol * tol) | (det == 0), at).otherwise(moved)

    start = F.struct(*(F.lit(float(c)).alias(n) for c, n in zip(e.points[0], "rs", strict=True)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


def interpolate(mesh: Mesh, field: DataFrame, points: DataFrame, *, steps: int = 1, tol: float = 1e-12, on_outside: str = "null") -> DataFrame:
    """point_id, elem_id, v at points; null outside (or an error with on_outside="error"). A row for each point.

    The values of field are numbers or arrays, and v is like them. One Newton step from the first quadrature point is exact for
    affine elements; more are needed elsewhere, and a point whose residual is within tol takes no more. Elements
    are looked up by their corners, so near a curved side a point may be in the neighbour's straight ring.
    """
    if on_outside not in ("null", "error"):
        raise ValueError("on_outside is null or error")
    e = ELEMENTS[mesh.etype]
    k = len(e.nodes)
    found = written(_found(mesh, points), "found")
    if on_outside == "error" and (bad := points.join(found, _POINT, "left_anti").first()) is not None:
        raise ValueError(f"point {bad['point_id']} is outside of the mesh")
    rows = found.join(gather(mesh, u=field).drop("conn"), "elem_id").withColumn("_at", _newton(mesh, steps, tol))
    coefficients = np.linalg.inv(np.prod(e.nodes[:, None, :] ** e.powers[None], axis=2))
    monomial = [F.pow(F.col("_at")["r"], F.lit(p)) * F.pow(F.col("_at")["s"], F.lit(q)) for p, q in e.powers.tolist()]
    shape = F.array(*(sum((F.lit(float(c)) * m for c, m in zip(coefficients[1:, a], monomial[1:], strict=True)), F.lit(float(coefficients[0, a])) * monomial[0]) for a in range(k)))
    rows = rows.withColumn("_n", shape)
    u = F.col("u")
    many = isinstance(field.schema["v"].dataType, ArrayType)
    v = F.transform(u[0], lambda _, c: sum((F.col("_n")[a] * u[a][c] for a in range(1, k)), F.col("_n")[0] * u[0][c])) if many else dot(F.col("_n"), u, k)
    values = rows.select(*_POINT, "elem_id", v.alias("v"))
    return points.select(*_POINT).join(values, _POINT, "left").select("point_id", F.coalesce("elem_id", F.lit(-1)).cast("long").alias("elem_id"), "v")
