"""Element bases: shape functions from their defining property, so that one path serves all element types.

The shape functions of an element span its monomials and are 1 at their own node, 0 at the others;
the inverse of the Vandermonde matrix holds their coefficients.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_G2, _G3 = 1 / math.sqrt(3), math.sqrt(3 / 5)


@dataclass(frozen=True)
class Element:
    nodes: np.ndarray
    powers: np.ndarray
    points: np.ndarray
    weights: np.ndarray

    @property
    def dim(self) -> int:
        return self.nodes.shape[1]

    def _monomials(self, at: np.ndarray) -> np.ndarray:
        return np.prod(at[:, None, :] ** self.powers[None], axis=2)

    def values(self, at: np.ndarray) -> np.ndarray:
        """points x nodes"""
        return self._monomials(at) @ np.linalg.inv(self._monomials(self.nodes))

    def slopes(self, at: np.ndarray) -> np.ndarray:
        """points x directions x nodes"""
        inverse, out = np.linalg.inv(self._monomials(self.nodes)), []
        for r in range(self.dim):
            lower = self.powers.copy()
            lower[:, r] = np.maximum(lower[:, r] - 1, 0)
            out.append((np.prod(at[:, None, :] ** lower[None], axis=2) * self.powers[:, r]) @ inverse)
        return np.stack(out, axis=1)


def _element(nodes: list, degree: int, simplex: bool, points: list, weights: list, serendipity: bool = False) -> Element:
    at = np.array(nodes, float)
    powers = [p for p in itertools.product(range(degree + 1), repeat=at.shape[1]) if not simplex or sum(p) <= degree]
    if serendipity:
        powers = [p for p in powers if sum(e for e in p if e > 1) <= 2]
    return Element(at, np.array(powers), np.array(points, float), np.array(weights, float))


def _box(d: int) -> list[list[int]]:
    """Corners of a box, counter-clockwise in each layer."""
    ring = [[-1, -1], [1, -1], [1, 1], [-1, 1]]
    return ring if d == 2 else [[*c, z] for z in (-1, 1) for c in ring]


def _product(points: list[float]) -> list[list[float]]:
    """The first coordinate varies fastest."""
    return [[r, s] for s in points for r in points]


# Reference nodes in their order, and default quadrature.
ELEMENTS: dict[str, Element] = {
    "line2": _element([[-1], [1]], 1, True, [[0]], [2]),
    "line3": _element([[-1], [1], [0]], 2, True, [[-_G3], [0], [_G3]], [5 / 9, 8 / 9, 5 / 9]),
    "tri3": _element([[0, 0], [1, 0], [0, 1]], 1, True, [[1 / 3, 1 / 3]], [1 / 2]),
    "tri6": _element([[0, 0], [1, 0], [0, 1], [0.5, 0], [0.5, 0.5], [0, 0.5]], 2, True, [[1 / 6, 1 / 6], [2 / 3, 1 / 6], [1 / 6, 2 / 3]], [1 / 6] * 3),
    "quad4": _element(_box(2), 1, False, _product([-_G2, _G2]), [1] * 4),
    "quad8": _element([*_box(2), [0, -1], [1, 0], [0, 1], [-1, 0]], 2, False, _product([-_G3, 0, _G3]), [a * b / 81 for a in (5, 8, 5) for b in (5, 8, 5)], serendipity=True),
    "tet4": _element([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]], 1, True, [[1 / 4] * 3], [1 / 6]),
    "hex8": _element(_box(3), 1, False, [[_G2 * c for c in p] for p in _box(3)], [1] * 8),
}


def register_element(name: str, nodes: list, powers: list, points: list, weights: list) -> Element:
    """An element of one's own: reference nodes, exponents of its monomials (as many as nodes), quadrature. Known names are refused."""
    e = Element(np.array(nodes, float), np.array(powers), np.array(points, float), np.array(weights, float))
    if name in ELEMENTS or len(e.nodes) != len(e.powers) or len(e.points) != len(e.weights):
        raise ValueError(f"element {name}: known already, or sizes don't match")
    np.linalg.inv(e._monomials(e.nodes))  # raises if the nodes don't determine the monomials
    ELEMENTS[name] = e
    return e


def with_quadrature(etype: str, points: list, weights: list) -> str:
    """The name of the element with a quadrature of the caller's; made on first use."""
    e = ELEMENTS[etype]
    name = f"{etype}@{hash((str(points), str(weights))) & 0xFFFFFFFF:x}"
    if name not in ELEMENTS:
        register_element(name, e.nodes, e.powers, points, weights)
    return name


def basis_table(spark: SparkSession, etype: str) -> DataFrame:
    """q, w, xi, n (nodes), dn (directions x nodes): at most nine rows, so always broadcast."""
    e = ELEMENTS[etype]
    n, dn = e.values(e.points), e.slopes(e.points)
    rows = [(q, float(e.weights[q]), e.points[q].tolist(), n[q].tolist(), dn[q].tolist()) for q in range(len(e.points))]
    return spark.createDataFrame(rows, "q int, w double, xi array<double>, n array<double>, dn array<array<double>>")


def dot(a: Column, b: Column, size: int) -> Column:
    """The sum of products, written out so that it is compiled with the rest of the row."""
    out = a[0] * b[0]
    for i in range(1, size):
        out = out + a[i] * b[i]
    return out


def geometry(etype: str, coords: list[Column], dn: Column) -> tuple[Column, list[Column]]:
    """The determinant (signed; a line's: length of its tangent) and, by space direction, the array of dN/dx.

    A line has one direction, its arc.
    """
    e, k = ELEMENTS[etype], len(ELEMENTS[etype].nodes)
    j = [[dot(dn[r], x, k) for x in coords] for r in range(e.dim)]
    if e.dim == 1:
        det = F.sqrt(sum((c * c for c in j[0][1:]), j[0][0] * j[0][0]))
        return det, [F.transform(dn[0], lambda d: d / det)]
    if e.dim != len(coords):
        raise ValueError("areas and volumes need as many coordinates as directions")
    if e.dim == 2:
        det = j[0][0] * j[1][1] - j[0][1] * j[1][0]
        cof = [[j[1][1], -j[0][1]], [-j[1][0], j[0][0]]]
    else:
        minor = lambda a, b, c, d: j[a][b] * j[c][d] - j[a][d] * j[c][b]
        cof = [[minor((c + 1) % 3, (r + 1) % 3, (c + 2) % 3, (r + 2) % 3) for c in range(3)] for r in range(3)]
        det = j[0][0] * cof[0][0] + j[0][1] * cof[1][0] + j[0][2] * cof[2][0]
    grads = []
    for c in range(e.dim):
        entries = [sum((cof[c][r] * dn[r][a] for r in range(1, e.dim)), cof[c][0] * dn[0][a]) / det for a in range(k)]
        grads.append(F.array(*entries))
    return det, grads
