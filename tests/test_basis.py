"""Each element on its reference nodes: partition of unity, exact gradients of linear fields, measure."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshspark.functions.basis import ELEMENTS
from meshspark.operators import fields
from meshspark.sources.grids import Mesh

MEASURE = {"tri3": 0.5, "tri6": 0.5, "quad4": 4, "quad8": 4, "tet4": 1 / 6, "hex8": 8, "line2": 2, "line3": 2}


@pytest.mark.parametrize("etype", ELEMENTS)
def test_own_node(etype):
    e = ELEMENTS[etype]
    assert np.allclose(e.values(e.nodes), np.eye(len(e.nodes)), atol=1e-12)
    assert np.allclose(e.values(e.points).sum(1), 1)
    assert np.allclose(e.slopes(e.points).sum(2), 0)
    assert np.isclose(e.weights.sum(), MEASURE[etype])


@pytest.mark.parametrize("etype", [t for t in ELEMENTS if ELEMENTS[t].dim > 1])
def test_linear_gradient(spark, etype):
    e = ELEMENTS[etype]
    axes = ("x", "y", "z")[: e.dim]
    skew = np.eye(e.dim) + np.diag(np.full(e.dim - 1, 0.25), 1)
    at = e.nodes @ skew
    nodes = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "node_id long, " + ", ".join(f"{a} double" for a in axes))
    mesh = Mesh(nodes, spark.createDataFrame([(0, list(range(len(at))))], "elem_id long, conn array<long>"), etype)
    field = nodes.select("node_id", sum((F.col(a) * (k + 2.0) for k, a in enumerate(axes)), F.lit(1.0)).alias("v"))
    for r in fields.gradient(mesh, field).collect():
        assert abs(r.v - (r.d + 2)) < 1e-12
    total = fields.integration_weights(mesh).agg(F.sum("wt")).first()[0]
    assert np.isclose(total, MEASURE[etype])


@pytest.mark.parametrize("etype", ["line2", "line3"])
def test_lines_give_the_slope_along_the_arc(spark, etype):
    at = [(0, 0), (3, 4)] + ([(1.5, 2)] if etype == "line3" else [])
    nodes = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "node_id long, x double, y double")
    mesh = Mesh(nodes, spark.createDataFrame([(0, list(range(len(at))))], "elem_id long, conn array<long>"), etype)
    rows = fields.gradient(mesh, nodes.select("node_id", (F.col("x") * 5).alias("v"))).collect()
    assert all(abs(r.v - 3) < 1e-12 for r in rows)
    assert np.isclose(fields.integration_weights(mesh).agg(F.sum("wt")).first()[0], 5)
