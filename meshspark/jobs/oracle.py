"""The queries in DuckDB SQL, in closed form for triangles and bilinear quadrilaterals."""

from __future__ import annotations

_GRID = """WITH g AS (SELECT greatest(CAST(floor(sqrt(count(*))) AS BIGINT) - 1, 0) AS n FROM part),
nodes AS (SELECT CAST(p_partkey AS BIGINT) AS node_id, (p_partkey // (n + 1)) / CAST(n AS DOUBLE) AS x, (p_partkey % (n + 1)) / CAST(n AS DOUBLE) AS y,
  CAST(p_retailprice AS DOUBLE) AS u, CAST(p_size AS DOUBLE) AS s, n FROM part, g),
cells AS (SELECT r AS c, n, (r // n) * (n + 1) + r % n AS sw, (r // n + 1) * (n + 1) + r % n AS se FROM g, range(0, n * (n + 2)) t(r) WHERE (r // n + 1) * (n + 1) + r % n + 1 < (SELECT count(*) FROM part)),
tri AS (SELECT 2 * c AS elem_id, sw AS n0, se AS n1, se + 1 AS n2 FROM cells UNION ALL SELECT 2 * c + 1, sw, se + 1, sw + 1 FROM cells),
quad AS (SELECT c AS elem_id, sw AS n0, se AS n1, se + 1 AS n2, sw + 1 AS n3 FROM cells),
t AS (SELECT elem_id, n0, n1, n2, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, d.x AS x2, d.y AS y2, a.u AS u0, b.u AS u1, d.u AS u2, a.s AS s0, b.s AS s1, d.s AS s2,
  (b.x - a.x) * (d.y - a.y) - (b.y - a.y) * (d.x - a.x) AS det
  FROM tri JOIN nodes a ON a.node_id = n0 JOIN nodes b ON b.node_id = n1 JOIN nodes d ON d.node_id = n2),
tg AS (SELECT *, (u0 * (y1 - y2) + u1 * (y2 - y0) + u2 * (y0 - y1)) / det AS ux, (u0 * (x2 - x1) + u1 * (x0 - x2) + u2 * (x1 - x0)) / det AS uy,
  (s0 * (y1 - y2) + s1 * (y2 - y0) + s2 * (y0 - y1)) / det AS sx, (s0 * (x2 - x1) + s1 * (x0 - x2) + s2 * (x1 - x0)) / det AS sy FROM t),
ref AS (SELECT * FROM (VALUES (0, -1.0::DOUBLE, -1.0::DOUBLE), (1, 1, -1), (2, 1, 1), (3, -1, 1)) v(a, ra, sa)),
pts AS (SELECT q, r / sqrt(3.0::DOUBLE) AS r, s / sqrt(3.0::DOUBLE) AS s FROM (VALUES (0, -1, -1), (1, 1, -1), (2, -1, 1), (3, 1, 1)) v(q, r, s)),
ends AS (SELECT elem_id, a, CASE a WHEN 0 THEN n0 WHEN 1 THEN n1 WHEN 2 THEN n2 ELSE n3 END AS node_id FROM quad, ref),
shape AS (SELECT q, a, (1 + r * ra) * (1 + s * sa) / 4 AS f, ra * (1 + s * sa) / 4 AS fr, sa * (1 + r * ra) / 4 AS fs FROM pts, ref),
qp AS (SELECT elem_id, q, sum(f * x) AS x, sum(f * y) AS y, sum(f * u) AS u, sum(fr * x) * sum(fs * y) - sum(fr * y) * sum(fs * x) AS wt
  FROM ends JOIN shape USING (a) JOIN nodes USING (node_id) GROUP BY elem_id, q),
k AS (SELECT r.i, c.j, CASE r.i WHEN 0 THEN n0 WHEN 1 THEN n1 ELSE n2 END AS "row", CASE c.j WHEN 0 THEN n0 WHEN 1 THEN n1 ELSE n2 END AS col,
  (CASE r.i WHEN 0 THEN y1 - y2 WHEN 1 THEN y2 - y0 ELSE y0 - y1 END * CASE c.j WHEN 0 THEN y1 - y2 WHEN 1 THEN y2 - y0 ELSE y0 - y1 END
   + CASE r.i WHEN 0 THEN x2 - x1 WHEN 1 THEN x0 - x2 ELSE x1 - x0 END * CASE c.j WHEN 0 THEN x2 - x1 WHEN 1 THEN x0 - x2 ELSE x1 - x0 END) / det / 2 AS stiff, det / 18 AS mass
  FROM t, range(3) r(i), range(3) c(j)),
line AS (SELECT CAST(l_orderkey AS BIGINT) AS elem_id, CAST(l_partkey AS BIGINT) AS node_id,
  CAST(least(l_orderkey // greatest(((SELECT count(*) FROM orders) + 7) // 8, 1), 7) AS INTEGER) AS part FROM lineitem),
touched AS (SELECT DISTINCT part, node_id FROM line),
local AS (SELECT part, node_id, min(part) OVER (PARTITION BY node_id) AS owner FROM touched),
layout AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY part <> owner, node_id) - 1 AS local_id, node_id, owner, part = owner AS is_owned FROM local),
cons AS (SELECT node_id AS dof, u AS v, node_id % (n + 1) = 0 AS fixed, node_id <= n AS slave, CASE WHEN node_id <= n THEN node_id + n * (n + 1) ELSE node_id END AS master FROM nodes),
free AS (SELECT dof, row_number() OVER (ORDER BY dof) - 1 AS reduced FROM cons WHERE NOT fixed AND NOT slave),
"""
_POINTS = """pt AS (SELECT CAST(event_id AS BIGINT) AS point_id, ((event_id * 7919) % 1009) / 1009.0::DOUBLE * 1.2::DOUBLE - 0.1::DOUBLE AS px, ((event_id * 104729) % 1013) / 1013.0::DOUBLE * 1.2::DOUBLE - 0.1::DOUBLE AS py FROM events),
edge AS (SELECT elem_id, x0 AS ax, y0 AS ay, x1 AS bx, y1 AS b_y FROM t UNION ALL SELECT elem_id, x1, y1, x2, y2 FROM t UNION ALL SELECT elem_id, x2, y2, x0, y0 FROM t),
cand AS (SELECT point_id, px, py, elem_id FROM pt, t WHERE px BETWEEN least(x0, x1, x2) AND greatest(x0, x1, x2) AND py BETWEEN least(y0, y1, y2) AND greatest(y0, y1, y2)),
held AS (SELECT point_id, elem_id FROM cand JOIN edge USING (elem_id) GROUP BY point_id, elem_id HAVING
  bool_or(abs((px - ax) * (b_y - ay) - (py - ay) * (bx - ax)) <= 1e-8 AND px BETWEEN least(ax, bx) AND greatest(ax, bx) AND py BETWEEN least(ay, b_y) AND greatest(ay, b_y))
  OR sum(CASE WHEN ((ay <= py AND b_y > py) OR (b_y <= py AND ay > py)) THEN CASE WHEN px < ax + (py - ay) / (b_y - ay) * (bx - ax) THEN 1 ELSE 0 END ELSE 0 END) % 2 = 1),
loc AS (SELECT point_id, px, py, coalesce((SELECT min(elem_id) FROM held h WHERE h.point_id = pt.point_id), -1) AS elem_id FROM pt),
"""
_COO = """WITH coo AS (SELECT CAST(l_suppkey AS BIGINT) AS "row", CAST(l_partkey AS BIGINT) AS col, sum(CAST(l_quantity AS DOUBLE)) AS v FROM lineitem GROUP BY 1, 2),
cnt AS (SELECT r AS "row", (SELECT count(*) FROM coo WHERE coo."row" = r) AS n FROM range(0, (SELECT count(*) FROM supplier)) x(r)),
"""


def _q(body: str, head: str = _GRID) -> str:
    return head + "done AS (SELECT 1)\n" + body


SQL = {
    "s2_rectangle_tri": _q("SELECT * FROM tri"),
    "s3_rectangle_quad": _q("SELECT * FROM quad"),
    "s6_validate_mesh": _q("""SELECT 'bad node' AS problem, count(*) AS n FROM nodes WHERE node_id IS NULL OR node_id < 0 OR x IS NULL OR y IS NULL
UNION ALL SELECT 'repeated node', count(*) FROM (SELECT node_id FROM nodes GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'repeated element', count(*) FROM (SELECT elem_id FROM tri GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'wrong size', 0 UNION ALL SELECT 'missing node', count(*) FROM (SELECT unnest([n0, n1, n2]) AS e FROM tri) WHERE e NOT IN (SELECT node_id FROM nodes)"""),
    "e14_diameter": _q("SELECT elem_id, round(sqrt((x1-x0)^2+(y1-y0)^2) * sqrt((x2-x0)^2+(y2-y0)^2) * sqrt((x2-x1)^2+(y2-y1)^2) / greatest(abs(det), 1e-12), 9) AS diameter FROM t"),
    "a3_mesh_size": _q("""SELECT round(min(d), 9) AS hmin, round(max(d), 9) AS hmax FROM (SELECT sqrt(max((p.x-o.x)^2+(p.y-o.y)^2)) AS d
FROM ends e JOIN ends f USING (elem_id) JOIN nodes p ON p.node_id = e.node_id JOIN nodes o ON o.node_id = f.node_id GROUP BY elem_id)"""),
    "g3_evaluate": _q("SELECT elem_id, q, round(u, 6) AS v FROM qp"),
    "g4_gradient": _q("SELECT elem_id, 0 AS q, 0 AS d, round(ux, 4) AS v FROM tg UNION ALL SELECT elem_id, 0, 1, round(uy, 4) FROM tg"),
    "g5_quad_points": _q("SELECT elem_id, q, round(x, 9) AS x, round(y, 9) AS y FROM qp"),
    "g6_weights": _q("SELECT elem_id, q, round(wt, 9) AS wt FROM qp"),
    "g7_map_quads": _q("""SELECT elem_id, 0 AS q, round((u0 + u1 + u2) / 3 * quantity, 4) AS v FROM t
LEFT JOIN (SELECT l_partkey, sum(CAST(l_quantity AS DOUBLE)) AS quantity FROM lineitem GROUP BY 1) ON l_partkey = elem_id % (SELECT count(*) FROM part)"""),
    "g8_map_elements": _q("SELECT elem_id, round(greatest(u0, u1, u2) - least(u0, u1, u2), 6) AS v FROM t"),
    "a1_integrate_per_element": _q("SELECT elem_id, round(sum(u * wt), 6) AS v FROM qp GROUP BY elem_id"),
    "a2_integrate": _q("SELECT round(sum(det / 2), 6) AS measure, round(sum((u0 + u1 + u2) / 3 * det / 2), 4) AS integral FROM t"),
    "a2_dirichlet_energy": _q("SELECT count(*) AS n_points, round(sum((ux * ux + uy * uy) * det / 2), 2) AS energy FROM tg"),
    "k3_linear_energy": _q("SELECT elem_id, round((1 / 2.6::DOUBLE * (ux * ux + sy * sy + 2 * ((uy + sx) / 2) ^ 2) + 0.3::DOUBLE / 1.3::DOUBLE / 0.4::DOUBLE / 2 * (ux + sy) ^ 2) * det / 2, 4) AS v FROM tg"),
    "p11_linear_form": _q("SELECT node_id, round(sum(v), 6) AS v FROM (SELECT unnest([n0, n1, n2]) AS node_id, (u0 + u1 + u2) / 9 * det / 2 AS v FROM t) GROUP BY 1"),
    "p12_stiffness": _q('SELECT "row", col, round(sum(stiff), 9) + 0.0 AS v FROM k GROUP BY 1, 2'),
    "p13_mass": _q("""SELECT e.node_id AS "row", f.node_id AS col, round(sum(a.f * b.f * wt), 9) AS v FROM ends e JOIN ends f USING (elem_id)
JOIN shape a ON a.a = e.a JOIN shape b ON b.a = f.a AND b.q = a.q JOIN qp ON qp.elem_id = e.elem_id AND qp.q = a.q GROUP BY 1, 2"""),
    "p1_mesh_pattern": _q('SELECT DISTINCT l.node_id * 2 + a AS "row", m.node_id * 2 + b AS col FROM line l JOIN line m USING (elem_id), range(2) p(a), range(2) o(b)'),
    "p3_term_pattern": 'SELECT DISTINCT CAST(a.l_partkey AS BIGINT) AS "row", CAST(b.l_partkey AS BIGINT) AS col FROM lineitem a JOIN lineitem b USING (l_orderkey)',
    "u5_asymmetric": _q('SELECT "row", col FROM coo WHERE NOT EXISTS (SELECT 1 FROM coo o WHERE o."row" = coo.col AND o.col = coo."row")', _COO),
    "a7_row_counts": _q("SELECT * FROM cnt", _COO),
    "w3_row_pointer": _q('SELECT "row", CAST(coalesce(sum(n) OVER (ORDER BY "row" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ptr FROM cnt', _COO),
    "p14_matvec": _q('SELECT "row", round(sum(v * CAST(p_retailprice AS DOUBLE)), 2) AS v FROM coo JOIN part ON p_partkey = col GROUP BY 1', _COO),
    "j1_locate": _q("SELECT point_id, elem_id FROM loc", _GRID + _POINTS),
    "j2_interpolate": _q("""SELECT point_id, loc.elem_id, round(u0 + (((px-x0)*(y2-y0) - (py-y0)*(x2-x0)) * (u1-u0) + ((py-y0)*(x1-x0) - (px-x0)*(y1-y0)) * (u2-u0)) / det, 6) AS v
FROM loc LEFT JOIN t ON t.elem_id = loc.elem_id""", _GRID + _POINTS),
    "a6_node_owner": _q("SELECT node_id, min(part) AS owner FROM touched GROUP BY 1"),
    "w1_local_nodes": _q("SELECT * FROM layout"),
    "w2_part_offsets": _q("""SELECT *, CAST(coalesce(sum(n_owned) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM (SELECT part, count(*) AS n_local, count(*) FILTER (is_owned) AS n_owned FROM layout GROUP BY part)"""),
    "j8_halo": _q("SELECT owner, part AS ghost_part, count(*) AS n FROM layout WHERE NOT is_owned GROUP BY 1, 2"),
    "w7_free_dofs": _q("SELECT * FROM free"),
    "l2_lift": _q("SELECT a.dof, round(CASE WHEN m.fixed THEN 0.0 ELSE m.v END, 6) AS v FROM cons a JOIN cons m ON m.dof = a.master"),
    "l5_reduce_adjoint": _q("SELECT reduced, round(sum(v), 6) AS v FROM cons JOIN free ON free.dof = cons.master GROUP BY 1"),
    "l14_reduce_matrix": _q("""SELECT r.reduced AS "row", c.reduced AS col, round(sum(stiff + mass), 9) + 0.0 AS v FROM k JOIN cons a ON a.dof = k."row" JOIN cons b ON b.dof = k.col
JOIN free r ON r.dof = a.master JOIN free c ON c.dof = b.master GROUP BY 1, 2"""),
}
