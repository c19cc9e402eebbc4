"""Forms between fields of several components: each element gives dense blocks, summed over its points inside the element, then by pairs of nodes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.basis import ELEMENTS
from ..sources.grids import Mesh
from .cut import written
from .fields import AXES, gather


@dataclass(frozen=True)
class Points:
    """A batch of elements at their quadrature points: x (elements x points x directions), values of fields (... [x components]) and their slopes (... [x components] x directions)."""

    x: np.ndarray
    value: dict[str, np.ndarray]
    slope: dict[str, np.ndarray]


@dataclass(frozen=True)
class Form:
    """Coefficients at the points of a form in test components i and trial components j; each is an array that ends in the axes named and may have elements x points before.

    Linear in the test field: source[i], flux[i, d] for N source + grad N . flux.
    Bilinear: mass[i, j], ahead[i, j, e] (N_i by the trial's slope e), behind[i, d, j] (the test's slope d by N_j),
    diffusion[i, d, j, e].
    """

    source: np.ndarray | None = None
    flux: np.ndarray | None = None
    mass: np.ndarray | None = None
    ahead: np.ndarray | None = None
    behind: np.ndarray | None = None
    diffusion: np.ndarray | None = None


Kernel = Callable[[Points], Form]


def elasticity(mu: float, lam: float, dim: int) -> np.ndarray:
    """diffusion[i, d, j, e] of an isotropic material: the stress of a strain."""
    one = np.eye(dim)
    return lam * np.einsum("id,je->idje", one, one) + mu * (np.einsum("ij,de->idje", one, one) + np.einsum("ie,dj->idje", one, one))


def neo_hookean(grad: np.ndarray, mu: float, lam: float) -> tuple[np.ndarray, np.ndarray]:
    """(flux, diffusion) of the energy mu / 2 (I1 - d - 2 ln J) + lam / 2 (ln J)^2 at displacement gradients (... x i x d); nan where J is not positive."""
    dim = grad.shape[-1]
    f = grad + np.eye(dim)
    j = np.linalg.det(f)
    log = np.log(np.where(j > 0, j, np.nan))[..., None, None]
    back = np.swapaxes(np.linalg.inv(np.where(j[..., None, None] > 0, f, np.eye(dim))), -1, -2)
    flux = mu * (f - back) + lam * log * back
    both = lam * np.einsum("...id,...je->...idje", back, back) + (mu - lam * log)[..., None, None] * np.einsum("...ie,...jd->...idje", back, back)
    return flux, both + mu * np.einsum("ij,de->idje", np.eye(dim), np.eye(dim))


def _array(column: pa.Array, elements: int, k: int) -> np.ndarray:
    """An array column in local node order as elements x nodes [x components]."""
    flat = column.flatten()
    if pa.types.is_list(flat.type):
        inner = flat.flatten()
        if flat.null_count or len(flat) != elements * k or (len(flat) and len(inner) % len(flat)):
            raise ValueError("a node has no value, or values of different sizes")
        return inner.to_numpy(zero_copy_only=False).astype(float).reshape(elements, k, -1)
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(elements, k)


def _points(batch: pa.RecordBatch, etype: str, axes: list[str], fields: list[str]) -> tuple[Points, np.ndarray, np.ndarray, np.ndarray]:
    """(points, weights elements x points, values points x nodes, slopes elements x points x directions x nodes)."""
    e, n_e = ELEMENTS[etype], batch.num_rows
    k = len(e.nodes)
    column = lambda c: _array(batch.column(batch.schema.get_field_index(c)), n_e, k)
    coords = np.stack([column(a) for a in axes], axis=2)
    n, dn = e.values(e.points), e.slopes(e.points)
    jac = np.einsum("qra,ead->eqrd", dn, coords)
    if e.dim == 1:
        det = np.sqrt((jac**2).sum(axis=(2, 3)))
        g = dn[None] / det[:, :, None, None]
    else:
        det = np.linalg.det(jac)
        g = np.einsum("eqdr,qra->eqda", np.linalg.inv(jac), dn)
    value, slope = {}, {}
    for name in fields:
        u = column(name)
        value[name] = np.einsum("qa,ea...->eq...", n, u)
        slope[name] = np.einsum("eqda,ea->eqd", g, u) if u.ndim == 2 else np.einsum("eqda,eac->eqcd", g, u)
    return Points(np.einsum("qa,ead->eqd", n, coords), value, slope), det * e.weights, n, g


def _linear(form: Form, wt: np.ndarray, n: np.ndarray, g: np.ndarray, k: int) -> np.ndarray:
    """elements x nodes x k"""
    lead = wt.shape
    out = np.zeros((lead[0], n.shape[1], k))
    if form.source is not None:
        out += np.einsum("eq,qa,eqi->eai", wt, n, np.broadcast_to(form.source, (*lead, k)), optimize=True)
    if form.flux is not None:
        out += np.einsum("eq,eqda,eqid->eai", wt, g, np.broadcast_to(form.flux, (*lead, k, g.shape[2])), optimize=True)
    return out


def _bilinear(form: Form, wt: np.ndarray, n: np.ndarray, g: np.ndarray, k: int, m: int) -> np.ndarray:
    """elements x test nodes x trial nodes x k x m"""
    lead, d = wt.shape, g.shape[2]
    out = np.zeros((lead[0], n.shape[1], n.shape[1], k, m))
    for c, shape, rule, parts in (
        (form.mass, (k, m), "eq,qa,eqij,qb->eabij", (n, n)),
        (form.ahead, (k, m, d), "eq,qa,eqijf,eqfb->eabij", (n, g)),
        (form.behind, (k, d, m), "eq,eqda,eqidj,qb->eabij", (g, n)),
        (form.diffusion, (k, d, m, d), "eq,eqda,eqidjf,eqfb->eabij", (g, g)),
    ):
        if c is not None:
            out += np.einsum(rule, wt, parts[0], np.broadcast_to(c, (*lead, *shape)), parts[1], optimize=True)
    return out


def _contributions(mesh: Mesh, kernel: Kernel, test: int, trial: int, linear: bool, bilinear: bool, fields: dict[str, DataFrame]) -> DataFrame:
    """row, col (null in the linear part) and v_0, v_1, ... of every element: a row for each pair of nodes, whatever the number of points."""
    if taken := {"elem_id", "conn", *AXES} & {*fields}:
        raise ValueError(f"reserved field names: {sorted(taken)}")
    axes = [a for a in AXES if a in mesh.nodes.columns]
    element = ELEMENTS[mesh.etype]
    if element.dim > 1 and element.dim != len(axes):
        raise ValueError("areas and volumes need as many coordinates as directions")
    etype, names, nodes = mesh.etype, list(fields), len(element.nodes)
    width = test * trial if bilinear else test
    columns = ["row", "col", *(f"v_{i}" for i in range(width))]
    ELEMENTS_HERE = {etype: element}  # an element of one's own goes to the tasks with the job

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, v in ELEMENTS_HERE.items():
            ELEMENTS.setdefault(k, v)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                conn = piece.column(piece.schema.get_field_index("conn")).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, nodes)
                points, wt, n, g = _points(piece, etype, axes, names)
                form = kernel(points)
                if linear:
                    v = _linear(form, wt, n, g, test).reshape(-1, test)
                    v = np.concatenate([v, np.zeros((len(v), width - test))], axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(conn.ravel()), pa.nulls(conn.size, pa.int64()), *map(pa.array, np.ascontiguousarray(v.T))], columns)
                if bilinear:
                    v = _bilinear(form, wt, n, g, test, trial).reshape(-1, width)
                    row, col = np.repeat(conn, nodes, axis=1).ravel(), np.tile(conn, (1, nodes)).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(col), *map(pa.array, np.ascontiguousarray(v.T))], columns)

    schema = ", ".join(["row long", "col long", *(f"v_{i} double" for i in range(width))])
    return gather(mesh, **fields).mapInArrow(run, schema)


def _summed(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Blocks of fixed width by key, combined before they move."""
    return rows.groupBy(*keys).agg(*(F.sum(f"v_{i}").alias(f"v_{i}") for i in range(width)))


def block_vector(mesh: Mesh, kernel: Kernel, test: int, **fields: DataFrame) -> DataFrame:
    """row, v_0, ..., v_(test - 1): by node the integrals of N source_i + grad N . flux_i."""
    return _summed(_contributions(mesh, kernel, test, 0, True, False, fields), ["row"], test)


def block_matrix(mesh: Mesh, kernel: Kernel, test: int, trial: int, **fields: DataFrame) -> DataFrame:
    """row, col, v_0, ...: by pair of nodes the test x trial block of a bilinear form, row by row.

    An element sends one row for each pair of its nodes, with its points summed inside the element; blocks are
    summed as columns of fixed width, and become entries only afterwards (entries()).
    """
    return _summed(_contributions(mesh, kernel, test, trial, False, True, fields), ["row", "col"], test * trial)


def block_system(mesh: Mesh, kernel: Kernel, components: int, **fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Residual blocks and tangent blocks of one form and its linearization, from one pass over the elements, written once."""
    both = written(_contributions(mesh, kernel, components, components, True, True, fields), "blocks")
    width = components * components
    return _summed(both.filter("col IS NULL"), ["row"], components), _summed(both.filter("col IS NOT NULL"), ["row", "col"], width)


#: Where a component's unknown of a node is in a state: (base, stride), dof = base + stride * node.
Places = list[tuple[int, int]]


def interleaved(components: int, base: int = 0) -> Places:
    """Components side by side at each node."""
    return [(base + c, components) for c in range(components)]


def unknowns(blocks: DataFrame, test: Places) -> DataFrame:
    """dof, v of a block vector, each component at its place in the test state."""
    parts = [F.struct((F.col("row") * s + b).alias("dof"), F.col(f"v_{i}").alias("v")) for i, (b, s) in enumerate(test)]
    return blocks.select(F.inline(F.array(*parts)))


def entries(blocks: DataFrame, test: Places, trial: Places, zeros: bool = True) -> DataFrame:
    """row, col, v of a block matrix: rows at their places in the test state, columns in the trial state; without zeros only other entries."""
    parts = [
        F.struct((F.col("row") * s + b).alias("row"), (F.col("col") * t + c).alias("col"), F.col(f"v_{i * len(trial) + j}").alias("v"))
        for i, (b, s) in enumerate(test)
        for j, (c, t) in enumerate(trial)
    ]
    out = blocks.select(F.inline(F.array(*parts)))
    return out if zeros else out.filter("v <> 0")
