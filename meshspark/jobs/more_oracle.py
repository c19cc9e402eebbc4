"""The further queries in DuckDB SQL."""

from __future__ import annotations

from .oracle import _COO, _GRID, _q

_N = "(SELECT count(*) FROM part)"
_SIDES = """nb AS (SELECT unnest([n0, n1, n2]) AS node_id, unnest([y1 - y2, y2 - y0, y0 - y1]) AS gx, unnest([x2 - x1, x0 - x2, x1 - x0]) AS gy, det, ux, uy, (u0 + u1 + u2) / 3 AS um FROM tg),
"""
_LINE = """WITH h AS (SELECT 1.0::DOUBLE / greatest(count(*) - 1, 1) AS h FROM supplier), b AS (SELECT CAST(s_suppkey AS BIGINT) AS i, CAST(s_acctbal AS DOUBLE) AS u FROM supplier)
"""
_BOX = """WITH z AS (SELECT *, (rows + m * m - 1) // (m * m) - 1 AS nx, m - 1 AS n FROM (SELECT count(*) AS rows, CAST(floor(power(count(*) + 0.5, 1.0 / 3)) AS BIGINT) AS m FROM customer)),
b AS (SELECT CAST(c_custkey AS BIGINT) AS i, CAST(c_acctbal AS DOUBLE) AS u FROM customer),
c AS (SELECT r, n, m, nx, rows, (r // (n * n)) * m * m + (r // n % n) * m + r % n AS low FROM z, range(0, nx * n * n) t(r)),
"""
_VEC = """WITH g AS (SELECT greatest(CAST(floor(sqrt(count(*))) AS BIGINT) - 1, 0) AS n, count(*) AS total FROM embeddings),
e AS (SELECT CAST(vec_id AS BIGINT) AS node_id, (vec_id // (n + 1)) / CAST(n AS DOUBLE) AS x, (vec_id % (n + 1)) / CAST(n AS DOUBLE) AS y, CAST(embedding AS DOUBLE[]) AS v FROM embeddings, g),
cells AS (SELECT r AS c, (r // n) * (n + 1) + r % n AS sw, (r // n + 1) * (n + 1) + r % n AS se FROM g, range(0, n * (n + 2)) t(r) WHERE (r // n + 1) * (n + 1) + r % n + 1 < total),
tri AS (SELECT 2 * c AS elem_id, sw AS n0, se AS n1, se + 1 AS n2 FROM cells UNION ALL SELECT 2 * c + 1, sw, se + 1, sw + 1 FROM cells),
t AS (SELECT elem_id, c, a.v[c + 1] AS u0, b.v[c + 1] AS u1, d.v[c + 1] AS u2, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, d.x AS x2, d.y AS y2,
  (b.x - a.x) * (d.y - a.y) - (b.y - a.y) * (d.x - a.x) AS det
  FROM tri JOIN e a ON a.node_id = n0 JOIN e b ON b.node_id = n1 JOIN e d ON d.node_id = n2, range(0, 64) k(c) WHERE c < len(a.v))
"""
_STATE = """WITH n AS (SELECT count(*) AS n, (SELECT count(*) FROM nation) AS s FROM orders),
vec AS (SELECT r * 3 + c AS dof, coalesce(CASE c WHEN 0 THEN CAST(p_retailprice AS DOUBLE) ELSE CAST(p_size AS DOUBLE) END, 7.0) AS v FROM n, range(0, n) t(r) LEFT JOIN part ON p_partkey = r, range(2) o(c)
UNION ALL SELECT CAST(o_orderkey AS BIGINT) * 3 + 2, CAST(o_totalprice AS DOUBLE) FROM orders
UNION ALL SELECT 3 * n + r, 7.0 FROM n, range(0, s) t(r)),
"""
_LAYOUT = """st AS (SELECT part, coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (SELECT part, count(*) FILTER (is_owned) AS n FROM layout GROUP BY part)),
own AS (SELECT node_id, CAST(s + local_id AS BIGINT) AS g FROM layout JOIN st USING (part) WHERE is_owned),
lay AS (SELECT l.part, l.local_id, l.node_id, l.is_owned, l.owner, g FROM layout l JOIN own USING (node_id)),
price AS (SELECT CAST(p_partkey AS BIGINT) AS node_id, CAST(p_retailprice AS DOUBLE) AS v FROM part),
per AS (SELECT CAST(p_partkey AS BIGINT) AS dof, CAST((p_partkey + (SELECT count(*) FROM part) // 2) % (SELECT count(*) FROM part) AS BIGINT) AS master FROM part WHERE p_partkey % 10 = 0),
"""
_PARTS = _GRID + _LAYOUT
_ITEMS = """WITH it AS (SELECT CAST(l_orderkey AS BIGINT) AS "row", CAST(l_partkey AS BIGINT) AS col, CAST(l_quantity AS DOUBLE) AS v FROM lineitem), pat AS (SELECT DISTINCT "row", col FROM it),
"""
_BLOCKS = """WITH n AS (SELECT count(*) AS n, count(*) // 8 AS low, count(*) % 8 AS more FROM part),
"""


def _block(c: str) -> str:
    return f"CAST(CASE WHEN {c} < more * (low + 1) THEN {c} // (low + 1) ELSE more + ({c} - more * (low + 1)) // greatest(low, 1) END AS INTEGER)"


#: Lower corners of elements over two by two cells.
_CORNERS = """sz AS (SELECT rows, n, m, rows // m AS full_, (rows + m - 1) // m AS cols, rows // m // 2 AS kx, m // 2 AS ky FROM (SELECT (SELECT count(*) FROM part) AS rows, n, n + 1 AS m FROM g)),
dc AS (SELECT r AS c, n, m, low FROM (SELECT r, n, m, rows, (CASE WHEN r // ky < kx THEN least(r // ky * 2, full_ - 3) ELSE cols - 3 END) * m + least(r % ky * 2, m - 3) AS low
  FROM sz, range(0, (kx + CASE WHEN cols > full_ THEN 1 ELSE 0 END) * ky) t(r)) WHERE low + 2 * m + 2 < rows),
"""


def _double(name: str, value: str) -> str:
    """Elements over two by two cells: the integral from the twelfth of the weight of each node at a step."""
    return _q(f"""SELECT c AS elem_id, round({value}, 6) AS v FROM (SELECT c, n, m, low FROM dc) c, LATERAL (
SELECT {name} FROM nodes p WHERE p.node_id IN (low, low + m, low + 2 * m, low + 1, low + m + 1, low + 2 * m + 1, low + 2, low + m + 2, low + 2 * m + 2)) x""", _GRID + _CORNERS)


def _at(step: str) -> str:
    return f"max(CASE WHEN p.node_id = low + {step} THEN u END)"


SQL = {
    "s1_read_mesh": _q("SELECT * FROM tri"),
    "s4_unit_square": _q("SELECT r AS node_id, round((r // m) / CAST(greatest(k - 1, 1) AS DOUBLE), 9) AS x, round((r % m) / CAST(m - 1 AS DOUBLE), 9) AS y, 0.0::DOUBLE AS z, u AS v FROM (SELECT n + 1 AS m, ((SELECT count(*) FROM part) + n) // (n + 1) AS k FROM g) z, range(0, m * k) t(r) LEFT JOIN nodes ON node_id = r"),
    "s7_set_coords": _q("SELECT node_id, round(CASE WHEN s > 25 THEN x + 0.25::DOUBLE ELSE x END, 9) AS x, round(CASE WHEN s > 25 AND node_id % 2 = 0 THEN y * 2 ELSE y END, 9) AS y FROM nodes"),
    "e1_line2": _LINE + "SELECT a.i AS elem_id, round((a.u + c.u) / 2 * h, 6) AS v FROM b a JOIN b c ON c.i = a.i + 1, h",
    "e2_line3": _LINE + "SELECT r AS elem_id, round((a.u + 4 * m.u + c.u) / 6 * 2 * h, 6) AS v FROM h, range(0, (SELECT count(*) FROM supplier) // 2) t(r) JOIN b a ON a.i = least(2 * r, (SELECT count(*) FROM supplier) - 3) JOIN b m ON m.i = a.i + 1 JOIN b c ON c.i = a.i + 2",
    "e4_tri6": _double(f"{_at('m')} AS a, {_at('2 * m + 1')} AS b, {_at('m + 1')} AS d", "(a + b + d) / 3 * 2 / n / n"),
    "e6_quad8": _double(f"{_at('0')} + {_at('2 * m')} + {_at('2 * m + 2')} + {_at('2')} AS corner, {_at('m')} + {_at('2 * m + 1')} + {_at('m + 2')} + {_at('1')} AS mid", "(mid / 3 - corner / 12) * 4 / n / n"),
    "e7_tet4": _BOX + """six AS (SELECT 6 * r + p AS elem_id, n, nx, rows, unnest([low, low + a, low + k, low + m * m + m + 1]) AS i FROM c, LATERAL (VALUES (0, m * m, m * m + m), (1, m * m, m * m + 1), (2, m, m + m * m), (3, m, m + 1), (4, 1, 1 + m * m), (5, 1, 1 + m)) o(p, a, k))
SELECT CAST(elem_id AS BIGINT) AS elem_id, round(sum(u) / 4 / (nx * n * n), 10) AS v FROM six LEFT JOIN b USING (i) GROUP BY elem_id, n, nx, rows HAVING max(i) < rows""",
    "e8_hex8": _BOX + """eight AS (SELECT r AS elem_id, n, nx, rows, unnest([low, low + 1, low + m, low + m + 1, low + m * m, low + m * m + 1, low + m * m + m, low + m * m + m + 1]) AS i FROM c)
SELECT elem_id, round(sum(u) / 8 * 6 / (nx * n * n) * pi(), 5) AS v FROM eight LEFT JOIN b USING (i) GROUP BY elem_id, n, nx, rows HAVING max(i) < rows""",
    "x2_map_points": _q("SELECT elem_id, q, round(greatest(u - 1400, 0.0), 6) AS v FROM qp"),
    "x3_own_quadrature": _q("SELECT elem_id, round(det / 6 * (((u0 + u1) / 2) ^ 2 + ((u1 + u2) / 2) ^ 2 + ((u2 + u0) / 2) ^ 2), 3) AS v FROM t"),
    "g4_vector_gradient": _VEC + """SELECT elem_id, CAST(c AS INTEGER) AS c, 0 AS d, round((u0 * (y1 - y2) + u1 * (y2 - y0) + u2 * (y0 - y1)) / det, 4) AS v FROM t
UNION ALL SELECT elem_id, CAST(c AS INTEGER), 1, round((u0 * (x2 - x1) + u1 * (x0 - x2) + u2 * (x1 - x0)) / det, 4) FROM t""",
    "a1_vector_integral": _VEC + "SELECT elem_id, CAST(c AS INTEGER) AS c, round((u0 + u1 + u2) / 3 * det / 2, 8) AS v FROM t",
    "a1_number": _q("SELECT elem_id, round(det / 2 * 3, 9) AS v FROM t"),
    "g9_boundary_integral": _q("SELECT b.node_id // (b.n + 1) - 1 AS elem_id, round((a.u + b.u) / 2 * (b.x - a.x), 6) AS v FROM nodes a JOIN nodes b ON b.node_id = a.node_id + a.n + 1 WHERE a.node_id % (a.n + 1) = 0"),
    "g10_select_nodes": _q("SELECT node_id FROM nodes, (SELECT max(y) AS my FROM nodes) WHERE abs(y - my) <= 1e-8 + 1e-5 * abs(my)"),
    "g11_pair_boundaries": _q("""SELECT a.node_id AS dof, b.node_id AS master FROM (SELECT node_id, row_number() OVER (ORDER BY x, node_id) AS r FROM nodes WHERE abs(y) <= 1e-8) a
JOIN (SELECT node_id, row_number() OVER (ORDER BY x, node_id) AS r FROM nodes WHERE abs(y - 1) <= 1.001e-5) b USING (r)"""),
    "k1_strain": _q("SELECT elem_id, round(ux, 4) AS xx, round(sy, 4) AS yy, round((uy + sx) * 0.5::DOUBLE, 4) AS xy FROM tg"),
    "k2_stress": _q("SELECT elem_id, round(3 * ux + 0.75::DOUBLE * (ux + sy), 3) AS xx, round(3 * sy + 0.75::DOUBLE * (ux + sy), 3) AS yy, round(3 * ((uy + sx) * 0.5::DOUBLE), 3) AS xy FROM tg"),
    "k4_neo_hookean": _q("""SELECT elem_id, round(250 * (a * a + b * b + c * c + d * d - 2 - 2 * l) + 500 * l * l, 4) AS v FROM (SELECT *, CASE WHEN a * d - b * c > 0 THEN ln(a * d - b * c) END AS l
FROM (SELECT elem_id, 1 + ux * 1e-5 AS a, uy * 1e-5 AS b, sx * 1e-5 AS c, 1 + sy * 1e-5 AS d FROM tg))"""),
    "k5_plane_stress": _q("""SELECT elem_id, round((mu * (ux * ux + sy * sy + 2 * ((uy + sx) / 2) ^ 2) + 2 * mu * lam / (lam + 2 * mu) / 2 * (ux + sy) ^ 2) * det / 2, 5) AS v
FROM tg, (SELECT 1 / 2.6::DOUBLE AS mu, 0.3::DOUBLE / 1.3::DOUBLE / 0.4::DOUBLE AS lam)"""),
    "k7_active_set": _q("""SELECT elem_id, round(CASE WHEN elem_id % 2 = 0 THEN lu * ls ELSE 0.5::DOUBLE * lu * lu END, 3) AS v
FROM (SELECT b.node_id // (b.n + 1) - 1 AS elem_id, (a.u + b.u) / 2 AS lu, (a.s + b.s) / 2 AS ls FROM nodes a JOIN nodes b ON b.node_id = a.node_id + a.n + 1 WHERE a.node_id % (a.n + 1) = 0)"""),
    "k8_mean_parameter": _q("SELECT elem_id, round((u0 + u1 + u2) / 3 * (SELECT avg(CAST(p_size AS DOUBLE)) FROM part), 6) AS v FROM t"),
    "p11_flux_form": _q("SELECT node_id, round(sum((gx * ux + gy * uy) / 2), 4) + 0.0 AS v FROM nb GROUP BY 1", _GRID + _SIDES),
    "p12_full_form": _q("""SELECT a.node_id AS "row", b.node_id AS col, round(sum(a.det / 18 + (a.gx * (b.gx + 0.5::DOUBLE * b.gy) + 2 * a.gy * b.gy) / a.det / 2 + (b.gx + a.gy) / 6), 8) + 0.0 AS v
FROM (SELECT elem_id, unnest([n0, n1, n2]) AS node_id, unnest([y1 - y2, y2 - y0, y0 - y1]) AS gx, unnest([x2 - x1, x0 - x2, x1 - x0]) AS gy, det FROM t) a
JOIN (SELECT elem_id, unnest([n0, n1, n2]) AS node_id, unnest([y1 - y2, y2 - y0, y0 - y1]) AS gx, unnest([x2 - x1, x0 - x2, x1 - x0]) AS gy FROM t) b USING (elem_id) GROUP BY 1, 2"""),
    "p15_matvec_free": _q('SELECT node_id AS "row", round(sum((gx * ux + gy * uy) / 2 + um * det / 6), 4) + 0.0 AS v FROM nb GROUP BY 1', _GRID + _SIDES),
    "p10_residual_and_tangent": _q("""SELECT node_id, round(sum((gx * ux + gy * uy) / 2000 + (um / 1000) ^ 3 * det / 6), 6) + 0.0 AS residual, round(sum((um / 1000) ^ 2 * det / 2), 7) + 0.0 AS tangent
FROM nb GROUP BY 1""", _GRID + _SIDES),
    "p16_project": _q("SELECT node_id AS dof, round(x + 2 * y, 5) + 0.0 AS v FROM nodes WHERE node_id IN (SELECT node_id FROM ends)"),
    "p17_solve_cg": _q("SELECT node_id AS dof, round(u, 3) AS v FROM nodes WHERE node_id IN (SELECT node_id FROM ends)"),
    "s8_to_coo": _q("SELECT * FROM coo", _COO),
    "s9_to_csr": _q('SELECT "row", count(*) AS n, min(col) AS first, max(col) AS last, sum(v) AS total FROM coo GROUP BY 1', _COO),
    "s10_dense_rows": _q(f'SELECT "row", {_N} AS n, {_N} - count(*) AS zeros, sum(v) AS total FROM coo GROUP BY 1', _COO),
    "s11_write_sorted": _q("SELECT * FROM coo", _COO),
    "t1_sorted_pattern": _q("SELECT * FROM pat", _ITEMS),
    "t3_degree_order": _q("""SELECT dof, degree, row_number() OVER (ORDER BY degree DESC, dof DESC) - 1 AS place FROM (SELECT a.col AS dof, count(DISTINCT CASE WHEN b.col <> a.col THEN b.col END) AS degree
FROM pat a JOIN pat b USING ("row") GROUP BY 1)""", _ITEMS),
    "u3_union_patterns": _q('SELECT "row", col FROM pat UNION SELECT CAST(l_suppkey AS BIGINT), CAST(l_partkey AS BIGINT) FROM lineitem', _ITEMS),
    "u4_missing_entries": _q('SELECT CAST(l_suppkey AS BIGINT) AS "row", CAST(l_partkey AS BIGINT) AS col FROM lineitem EXCEPT SELECT "row", col FROM pat', _ITEMS),
    "p2_layout_pattern": _q("""SELECT 3 * a + i AS "row", 3 * b + j AS col FROM (SELECT DISTINCT a.col AS a, b.col AS b FROM pat a JOIN pat b USING ("row")), range(3) p(i), range(3) o(j)
UNION ALL SELECT 3 * (SELECT count(*) FROM orders) + r, 3 * (SELECT count(*) FROM orders) + r FROM range(0, (SELECT count(*) FROM nation)) t(r)""", _ITEMS),
    "p4_split_pattern": _q(f'SELECT DISTINCT b.col - {_N} // 2 AS "row", a.col FROM pat a JOIN pat b USING ("row") WHERE a.col < {_N} // 2 AND b.col >= {_N} // 2', _ITEMS),
    "a13_distinct_counts": _q("SELECT count(*) AS pairs, count(DISTINCT col) AS cols, max(col) + 1 AS size FROM pat", _ITEMS),
    "a4_scatter_add": _q("SELECT col - 5 AS dof, sum(v) AS v FROM it WHERE col >= 5 GROUP BY 1", _ITEMS),
    "a5_assemble": 'SELECT CAST(l_suppkey - 3 AS BIGINT) AS "row", CAST(l_partkey - 5 AS BIGINT) AS col, sum(CAST(l_quantity AS DOUBLE)) AS v FROM lineitem WHERE l_suppkey >= 3 AND l_partkey >= 5 GROUP BY 1, 2',
    "p5_colour": "SELECT CAST(0 AS BIGINT) AS conflicts, CAST(0 AS BIGINT) AS bare",
    "p9_decompress": _q('SELECT "row", col, sum(v) AS v FROM it GROUP BY 1, 2', _ITEMS),
    "c1_pack": _q("SELECT dof, v FROM vec", _STATE),
    "c2_unpack": _q("SELECT dof // 3 AS item, CAST(dof % 3 AS INTEGER) AS comp, v FROM vec, n WHERE dof < 3 * n AND dof % 3 < 2", _STATE),
    "c3_set_field": _q("SELECT dof, coalesce(CASE WHEN dof % 3 = 2 AND dof < 3 * n AND dof // 3 % 3 = 0 THEN CAST(p_size AS DOUBLE) END, v) AS v FROM vec CROSS JOIN n LEFT JOIN part ON p_partkey = dof // 3", _STATE),
    "c4_add_states": _q("SELECT dof, round(CASE WHEN dof % 2 = 0 THEN v + v * 0.5::DOUBLE ELSE v END, 4) AS v FROM vec", _STATE),
    "c5_natural_dofs": _q("""SELECT part, 'u' AS name, local_id, CAST(c AS INTEGER) AS comp, 3 * node_id + c AS dof, is_owned FROM layout, range(0, 2) t(c)
UNION ALL SELECT part, 'phi', local_id, 0, 3 * node_id + 2, is_owned FROM layout
UNION ALL SELECT part, 's', r, 0, 3 * (SELECT count(*) FROM orders) + r, part = 0 FROM (SELECT DISTINCT part FROM layout), range(0, (SELECT count(*) FROM nation)) t(r)"""),
    "j10_select_dofs": _q("SELECT 2 * k + c AS pos, dof, v FROM n, range(0, (n - 9) // 3 + 1) t(k), range(0, 2) o(c) JOIN vec ON dof = 3 * (n - 9 - 3 * k) + 1 - c", _STATE),
    "w4_subset_rank": "SELECT CAST(p_partkey AS BIGINT) AS node_id, row_number() OVER (ORDER BY p_partkey) - 1 AS item FROM part WHERE p_size > 25",
    "j11_global_dofs": f"SELECT CAST(p_partkey AS BIGINT) AS node_id, CASE WHEN p_size > 25 THEN 2 * {_N} + 2 + 3 * (CAST(sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) OVER (ORDER BY p_partkey) AS BIGINT) - 1) END AS dof FROM part",
    "u1_constrained_dofs": _q("SELECT dof FROM cons WHERE fixed OR slave"),
    "l9_with_values": _q("SELECT a.dof, round(CASE WHEN m.fixed THEN (SELECT min(v) FROM cons) ELSE m.v END, 6) AS v FROM cons a JOIN cons m ON m.dof = a.master"),
    "l10_augment_pattern": _q('SELECT DISTINCT a.t AS "row", b.t AS col FROM (SELECT DISTINCT "row", col FROM k) p JOIN ends_of a ON a.dof = p."row" JOIN ends_of b ON b.dof = p.col', _GRID + "ends_of AS (SELECT dof, dof AS t FROM cons UNION SELECT dof, master FROM cons),\n"),
    "l11_reduce_pattern": _q('SELECT a.reduced AS "row", b.reduced AS col FROM (SELECT DISTINCT "row", col FROM k) p JOIN free a ON a.dof = p."row" JOIN free b ON b.dof = p.col'),
    "l12_adapt_pattern": _q('SELECT DISTINCT f.reduced AS "row", h.reduced AS col FROM k p JOIN ends_of a ON a.dof = p."row" JOIN ends_of b ON b.dof = p.col JOIN free f ON f.dof = a.t JOIN free h ON h.dof = b.t', _GRID + "ends_of AS (SELECT dof, dof AS t FROM cons UNION SELECT dof, master FROM cons),\n"),
    "l13_lifted": _q("SELECT reduced, round(sum(2 * m.v), 6) AS v FROM cons a JOIN cons m ON m.dof = a.master JOIN free ON free.dof = a.master GROUP BY 1"),
    "a8_totals": _q("SELECT coalesce(part, -1) AS part, count(*) AS n_local, count(*) FILTER (is_owned) AS n_owned FROM layout GROUP BY ROLLUP (part)"),
    "a9_n_nodes_global": "SELECT CAST(max(l_partkey) + 1 AS BIGINT) AS n FROM lineitem",
    "w5_dof_layout": _q("SELECT part, local_id * 2 + c AS local_dof, node_id * 2 + c AS natural_dof, g * 2 + c AS global_dof, is_owned FROM lay, range(0, 2) t(c)", _PARTS),
    "w6_reduced_layout": _q("""SELECT f.part, f.natural_dof, reduced_dof, f.is_owned FROM fr f JOIN (SELECT natural_dof, row_number() OVER (ORDER BY part, local_dof) - 1 AS reduced_dof FROM fr WHERE is_owned) o USING (natural_dof)""",
        _PARTS + "fr AS (SELECT part, local_id * 2 + c AS local_dof, node_id * 2 + c AS natural_dof, is_owned FROM lay, range(0, 2) t(c) WHERE node_id * 2 + c NOT IN (SELECT dof * 2 FROM per WHERE dof <> master)),\n"),
    "l8_missing_masters": _q("SELECT DISTINCT part, master AS natural_dof FROM lay JOIN per ON per.dof = node_id WHERE dof <> master AND NOT EXISTS (SELECT 1 FROM lay o WHERE o.part = lay.part AND o.node_id = master)", _PARTS),
    "j3_global_to_local": _q("SELECT CAST(p_partkey % 8 AS INTEGER) AS part, CAST(p_partkey AS BIGINT) AS node_id, coalesce(local_id, -1) AS local_id FROM part p LEFT JOIN layout l ON l.part = p_partkey % 8 AND l.node_id = p_partkey", _PARTS),
    "j5_ghost_fill": _q("SELECT part, local_id AS local_dof, v FROM lay JOIN price USING (node_id)", _PARTS),
    "j6_ghost_add": _q("SELECT g AS global_dof, round(sum(v * (part + 1)), 4) AS v FROM lay JOIN price USING (node_id) GROUP BY 1", _PARTS),
    "a12_gather_global": _q("SELECT node_id AS natural_dof, round(v * (part + 1), 4) AS v FROM lay JOIN price USING (node_id) WHERE is_owned", _PARTS),
    "j7_ghost_add_matrix": _q('SELECT a.g AS "row", b.g AS col, CAST(count(*) AS DOUBLE) AS v FROM line l JOIN line m USING (elem_id) JOIN own a ON a.node_id = l.node_id JOIN own b ON b.node_id = m.node_id GROUP BY 1, 2', _PARTS),
    "j9_dof_range": _q("SELECT dof, part, part * low + least(part, more) AS start FROM b, n", _BLOCKS + f"b AS (SELECT CAST(p_partkey AS BIGINT) AS dof, {_block('p_partkey')} AS part FROM part, n),\n"),
    "a10_merge_replicas": _q(f"SELECT {_block('dof')} AS part, dof, v FROM (SELECT CAST(l_partkey AS BIGINT) AS dof, sum(CAST(l_quantity AS DOUBLE)) AS v FROM lineitem GROUP BY 1), n", _BLOCKS),
    "a11_merge_replica_matrices": _q(f"""SELECT {_block('"row"')} AS part, "row", col, v FROM (SELECT CAST(l_partkey AS BIGINT) AS "row", CAST(l_suppkey AS BIGINT) AS col, sum(CAST(l_quantity AS DOUBLE)) AS v FROM lineitem GROUP BY 1, 2), n""", _BLOCKS),
}
