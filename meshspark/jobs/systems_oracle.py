"""The queries of systems in DuckDB SQL."""

from __future__ import annotations

from .more_oracle import _CORNERS, _PARTS, _STATE
from .oracle import _GRID, _POINTS, _q

_SIDE = """side AS (SELECT elem_id, unnest([n0, n1, n2]) AS node_id, unnest([y1 - y2, y2 - y0, y0 - y1]) AS gx, unnest([x2 - x1, x0 - x2, x1 - x0]) AS gy, det, ux, uy, sx, sy FROM tg),
pair AS (SELECT a.node_id AS a, b.node_id AS b, a.gx AS ax, a.gy AS ay, b.gx AS bx, b.gy AS b_y, a.det FROM side a JOIN side b USING (elem_id)),
"""
_LAME = "(SELECT 1 / 2.6::DOUBLE AS mu, 0.3::DOUBLE / 1.3::DOUBLE / 0.4::DOUBLE AS lam)"
_ELASTIC = f"""elastic AS (SELECT 2 * a + i AS "row", 2 * b + j AS col, sum((lam * (CASE i WHEN 0 THEN ax ELSE ay END) * (CASE j WHEN 0 THEN bx ELSE b_y END)
  + mu * (CASE WHEN i = j THEN ax * bx + ay * b_y ELSE 0 END + (CASE j WHEN 0 THEN ax ELSE ay END) * (CASE i WHEN 0 THEN bx ELSE b_y END))) / det / 2) AS v
  FROM pair, range(2) p(i), range(2) o(j), {_LAME} GROUP BY 1, 2),
"""
_HYPER = """def AS (SELECT elem_id, node_id, gx, gy, 1 + ux * 1e-6 AS a, uy * 1e-6 AS b, sx * 1e-6 AS c, 1 + sy * 1e-6 AS d FROM side),
inv AS (SELECT *, ln(a * d - b * c) AS l, d / (a * d - b * c) AS b00, -c / (a * d - b * c) AS b01, -b / (a * d - b * c) AS b10, a / (a * d - b * c) AS b11 FROM def),
out2 AS (SELECT 2 * node_id AS dof, (500 * (a - b00) + 1000 * l * b00) * gx / 2 + (500 * (b - b01) + 1000 * l * b01) * gy / 2 AS v,
  (500 + 1000 * b00 * (b00 + b11) + (500 - 1000 * l) * (b00 * b00 + b01 * b10)) * gx / 2 + (1000 * b01 * (b00 + b11) + (500 - 1000 * l) * (b00 * b01 + b01 * b11)) * gy / 2 AS t FROM inv
  UNION ALL SELECT 2 * node_id + 1, (500 * (c - b10) + 1000 * l * b10) * gx / 2 + (500 * (d - b11) + 1000 * l * b11) * gy / 2,
  (1000 * b10 * (b00 + b11) + (500 - 1000 * l) * (b10 * b00 + b11 * b10)) * gx / 2 + (500 + 1000 * b11 * (b00 + b11) + (500 - 1000 * l) * (b10 * b01 + b11 * b11)) * gy / 2 FROM inv),
"""


def _greedy(order: str) -> str:
    """The sequential greedy, one column a step."""
    return _GRID.replace("WITH g AS", "WITH RECURSIVE g AS", 1) + f"""ends3 AS (SELECT elem_id, unnest([n0, n1, n2]) AS node_id FROM tri),
pat AS (SELECT DISTINCT a.node_id AS "row", b.node_id AS col FROM ends3 a JOIN ends3 b USING (elem_id)),
nbr AS (SELECT DISTINCT a.col AS u, b.col AS v FROM pat a JOIN pat b USING ("row") WHERE a.col <> b.col),
placed AS (SELECT u, row_number() OVER (ORDER BY {order}) - 1 AS place FROM (SELECT u, count(*) AS degree FROM nbr GROUP BY u)),
deps AS (SELECT p.place, any_value(p.u) AS u, coalesce(list(q.place) FILTER (q.place IS NOT NULL), CAST([] AS BIGINT[])) AS before FROM placed p
  LEFT JOIN (nbr JOIN placed q ON q.u = nbr.v) ON nbr.u = p.u AND q.place < p.place GROUP BY p.place),
walk(i, colors) AS (SELECT CAST(0 AS BIGINT), CAST([] AS INTEGER[]) UNION ALL
  SELECT i + 1, list_append(colors, CAST(list_min(list_filter(range(len(before) + 1), lambda c: NOT list_contains(list_transform(before, lambda p: colors[p + 1]), c))) AS INTEGER)) FROM walk JOIN deps ON place = i)
SELECT u AS dof, color FROM deps JOIN (SELECT unnest(range(len(colors))) AS place, unnest(colors) AS color FROM walk ORDER BY i DESC LIMIT (SELECT count(*) FROM deps)) USING (place)"""


_RULES = """al AS (SELECT 2 * node_id + c AS dof, CASE c WHEN 0 THEN u ELSE s END AS v, c, node_id, n, n + 1 AS m, node_id % (n + 1) = 0 AS f, node_id <= n AS p, node_id > n AND node_id < 2 * (n + 1) AND c = 1 AS w FROM nodes, range(2) t(c)),
fr AS (SELECT dof, v, row_number() OVER (ORDER BY dof) - 1 AS reduced FROM al WHERE NOT f AND NOT p AND NOT w),
"""


def _maps() -> str:
    """m_<order>(dof, source, w): unit vectors lifted by the rules one after the other; source -1 is the constant."""
    out, last = "", []
    for order in ("FPW", "PWF", "WFP", "WPF"):
        before = "(SELECT dof, dof AS source, 1.0::DOUBLE AS w FROM al)"
        for k, rule in enumerate(order):
            name = f"m_{order}_{k}"
            if rule == "F":
                body = f"SELECT b.* FROM {before} b JOIN al USING (dof) WHERE NOT f UNION ALL SELECT dof, -1, 1.5::DOUBLE + c FROM al WHERE f"
            elif rule == "P":
                body = f"SELECT b.dof, b.source, b.w FROM {before} b JOIN al USING (dof) WHERE NOT p UNION ALL SELECT al.dof, b.source, b.w FROM al JOIN {before} b ON b.dof = al.dof + 2 * n * m WHERE p"
            else:
                body = f"""SELECT b.dof, b.source, b.w FROM {before} b JOIN al a USING (dof) WHERE NOT a.w UNION ALL SELECT dof, source, sum(w) FROM (SELECT a.dof, b.source, b.w * 0.5::DOUBLE AS w FROM al a JOIN {before} b ON b.dof = a.dof - 2 * m WHERE a.w
UNION ALL SELECT a.dof, b.source, b.w * 0.25::DOUBLE FROM al a JOIN {before} b ON b.dof = a.dof + 2 * m WHERE a.w UNION ALL SELECT dof, -1, 2.0::DOUBLE FROM al a WHERE a.w) GROUP BY 1, 2"""
            out += f"{name} AS ({body}),\n"
            before = name
        last.append(f"SELECT '{order}' AS ord, dof, source, w FROM {before}")
    return out + "maps AS (" + " UNION ALL ".join(last) + "),\nto_free AS (SELECT ord, maps.dof, reduced, w FROM maps JOIN fr ON fr.dof = source WHERE w <> 0),\n"


_ORDERED = _GRID + _RULES + _maps()
_SKEWED = """sk AS (SELECT node_id, x + 0.3::DOUBLE * x * y AS x, y + 0.2::DOUBLE * x * y AS y FROM nodes),
q4 AS (SELECT elem_id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, c.x AS x2, c.y AS y2, d.x AS x3, d.y AS y3 FROM quad JOIN sk a ON a.node_id = n0 JOIN sk b ON b.node_id = n1 JOIN sk c ON c.node_id = n2 JOIN sk d ON d.node_id = n3),
e4 AS (SELECT elem_id, unnest([x0, x1, x2, x3]) AS ax, unnest([y0, y1, y2, y3]) AS ay, unnest([x1, x2, x3, x0]) AS bx, unnest([y1, y2, y3, y0]) AS b_y FROM q4),
c4 AS (SELECT point_id, px, py, elem_id FROM pt JOIN q4 ON px BETWEEN least(x0, x1, x2, x3) AND greatest(x0, x1, x2, x3) AND py BETWEEN least(y0, y1, y2, y3) AND greatest(y0, y1, y2, y3)),
h4 AS (SELECT point_id, elem_id FROM c4 JOIN e4 USING (elem_id) GROUP BY point_id, elem_id HAVING
  bool_or(abs((px - ax) * (b_y - ay) - (py - ay) * (bx - ax)) <= 1e-8 AND px BETWEEN least(ax, bx) AND greatest(ax, bx) AND py BETWEEN least(ay, b_y) AND greatest(ay, b_y))
  OR sum(CASE WHEN ((ay <= py AND b_y > py) OR (b_y <= py AND ay > py)) THEN CASE WHEN px < ax + (py - ay) / (b_y - ay) * (bx - ax) THEN 1 ELSE 0 END ELSE 0 END) % 2 = 1),
l4 AS (SELECT point_id, px, py, coalesce(elem_id, -1) AS elem_id FROM pt LEFT JOIN (SELECT point_id, min(elem_id) AS elem_id FROM h4 GROUP BY 1) USING (point_id)),
"""
_EIGHT = _CORNERS + """d8 AS (SELECT c AS elem_id, low, low + 2 * m + 2 AS high FROM dc),
b8 AS (SELECT elem_id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM d8 JOIN nodes a ON a.node_id = low JOIN nodes b ON b.node_id = high),
"""
_PT = _POINTS[: _POINTS.index("edge AS")]
_COUNTS = """ln AS (SELECT CAST(l_orderkey AS BIGINT) AS elem_id, CAST(l_partkey AS BIGINT) AS node_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INTEGER) AS a FROM lineitem),
rc AS (SELECT a.node_id, count(DISTINCT b.node_id) AS n FROM line a JOIN line b USING (elem_id) GROUP BY 1),
oc AS (SELECT part, local_id, n FROM layout JOIN rc USING (node_id) WHERE is_owned),
"""

_COUNT = "(SELECT count(*) FROM part)"
_AREA = """area AS (SELECT node_id, sum(det) / 6 AS a FROM side GROUP BY 1),
"""
_SUBSET = f"""sub AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS item FROM nodes WHERE s > 25),
ed AS (SELECT elem_id, 2 * node_id + c AS dof FROM (SELECT elem_id, unnest([n0, n1, n2]) AS node_id FROM tri), range(2) t(c)
  UNION ALL SELECT elem_id, 2 * {_COUNT} + item FROM (SELECT elem_id, unnest([n0, n1, n2]) AS node_id FROM tri) JOIN sub USING (node_id)),
"""

_KINDS = f"""sub AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS item FROM nodes WHERE s > 25),
op AS (SELECT part, n, CAST(coalesce(sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT part, count(DISTINCT elem_id) AS n FROM line GROUP BY part)),
ns AS (SELECT count(*) AS nsub, (SELECT sum(n) FROM op) AS nown, {_COUNT} AS nn FROM sub),
un AS (SELECT part, CASE WHEN c < 2 THEN 'u' ELSE 'phi' END AS name, local_id AS item, c % 2 AS comp, 0 AS blk, local_id * 3 + c AS within, node_id * 3 + c AS dof, is_owned FROM layout, range(3) t(c)
  UNION ALL SELECT part, 'l', p, c, 1, p * 2 + c, 3 * nn + item * 2 + c, is_owned FROM (SELECT part, item, is_owned, row_number() OVER (PARTITION BY part ORDER BY local_id) - 1 AS p FROM layout JOIN sub USING (node_id)), ns, range(2) t(c)
  UNION ALL SELECT part, 'own', i, 0, 2, i, 3 * nn + 2 * nsub + start + i, true FROM (SELECT part, start, unnest(range(n)) AS i FROM op), ns
  UNION ALL SELECT part, 's', r, 0, 3, r, CAST(3 * nn + 2 * nsub + nown + r AS BIGINT), part = 0 FROM (SELECT DISTINCT part FROM layout), range(0, (SELECT count(*) FROM nation)) t(r), ns),
ld AS (SELECT part, name, item, CAST(comp AS INTEGER) AS comp, row_number() OVER (PARTITION BY part ORDER BY blk, within) - 1 AS local_dof, CAST(dof AS BIGINT) AS dof, is_owned FROM un),
"""

_RANKED = """WITH rk AS (SELECT CAST(p_partkey AS BIGINT) AS k, row_number() OVER (ORDER BY p_partkey) - 1 AS r, CAST(p_retailprice AS DOUBLE) AS price, CAST(p_size AS DOUBLE) AS size FROM part WHERE p_size > 25)
"""

SQL = {
    "p12_elasticity": _q('SELECT "row", col, round(v, 8) + 0.0 AS v FROM elastic', _GRID + _SIDE + _ELASTIC),
    "p12_mixed": _q("""SELECT 3 * a + i AS "row", CASE WHEN j < 2 THEN 2 * b + j ELSE 2 * (SELECT count(*) FROM part) + b END AS col, round(sum(CASE WHEN i < 2 AND i = j THEN (ax * bx + ay * b_y) / det / 2
WHEN i < 2 AND j = 2 THEN (CASE i WHEN 0 THEN ax ELSE ay END) / 6 WHEN i = 2 AND j < 2 THEN (CASE j WHEN 0 THEN bx ELSE b_y END) / 6 ELSE 0 END), 8) + 0.0 AS v FROM pair, range(3) p(i), range(3) o(j) GROUP BY 1, 2""", _GRID + _SIDE),
    "p10_elasticity": _q("SELECT dof, round(sum(v), 6) + 0.0 AS v, round(sum(t), 5) + 0.0 AS action FROM out2 GROUP BY 1", _GRID + _SIDE + _HYPER),
    "p12_quad8_mass": _q("""SELECT low + st AS node_id, round(sum(w * 4 / n / n), 10) + 0.0 AS v FROM (SELECT d8.elem_id, low, n, unnest([0, 2 * n + 2, 2 * n + 4, 2, n + 1, 2 * n + 3, n + 3, 1]) AS st,
unnest([-1 / 12::DOUBLE, -1 / 12::DOUBLE, -1 / 12::DOUBLE, -1 / 12::DOUBLE, 1 / 3::DOUBLE, 1 / 3::DOUBLE, 1 / 3::DOUBLE, 1 / 3::DOUBLE]) AS w FROM d8, g) GROUP BY 1""", _GRID + _EIGHT),
    "p5_index_order": _greedy("u"),
    "p5_degree_order": _greedy("degree DESC, u DESC"),
    "l2_lift_orders": _q("SELECT ord, maps.dof, round(sum(CASE WHEN source = -1 THEN w ELSE w * coalesce(v, 0) END), 6) + 0.0 AS v FROM maps LEFT JOIN fr ON fr.dof = source GROUP BY 1, 2", _ORDERED),
    "l5_adjoint_orders": _q("SELECT ord, reduced, round(sum(to_free.w * al.v), 6) + 0.0 AS v FROM to_free JOIN al USING (dof) GROUP BY 1, 2", _ORDERED),
    "l10_pattern_orders": _q("""SELECT DISTINCT a.ord, a.reduced AS "row", b.reduced AS col FROM (SELECT DISTINCT 2 * k."row" + ci AS "row", 2 * k.col + cj AS col FROM k, range(2) p(ci), range(2) o(cj)) e
JOIN to_free a ON a.dof = e."row" JOIN to_free b ON b.dof = e.col AND b.ord = a.ord""", _ORDERED),
    "l14_matrix_orders": _q("""SELECT a.ord, a.reduced AS "row", b.reduced AS col, round(sum(a.w * b.w * e.v), 7) + 0.0 AS v FROM elastic e JOIN to_free a ON a.dof = e."row" JOIN to_free b ON b.dof = e.col AND b.ord = a.ord GROUP BY 1, 2, 3""",
        _ORDERED + _SIDE + _ELASTIC),
    "l9_values_each": _q("SELECT node_id AS dof, round(CASE WHEN node_id % (n + 1) = 0 THEN CASE WHEN s % 2 = 0 THEN u ELSE 3.0 END WHEN node_id >= n * (n + 1) AND node_id < (n + 1) * (n + 1) THEN 7.0 ELSE 1.0 END, 6) + 0.0 AS v FROM nodes"),
    "p3_heavy_terms": """WITH term AS (SELECT DISTINCT 'o' || l_orderkey AS t, CAST(l_partkey AS BIGINT) AS dof FROM lineitem UNION SELECT 'b' || p_brand, CAST(p_partkey AS BIGINT) FROM part),
pr AS (SELECT DISTINCT a.dof, b.dof AS other FROM term a JOIN term b USING (t)) SELECT dof, count(*) AS n, round(sum(CAST(p_retailprice AS DOUBLE)), 2) + 0.0 AS v FROM pr JOIN part ON p_partkey = other GROUP BY 1""",
    "p2_bordered_product": _q(f"""SELECT "row", round(sum(v), 4) + 0.0 AS v FROM (SELECT "row", e.v * al.v AS v FROM elastic e JOIN al ON al.dof = col UNION ALL SELECT 2 * node_id + c, a * (3 + c) FROM area, range(2) t(c)
UNION ALL SELECT 2 * {_COUNT} + c, a * al.v FROM area JOIN al USING (node_id)) GROUP BY 1""", _GRID + _RULES + _SIDE + _ELASTIC + _AREA),
    "p2_block_counts": _q("""SELECT CAST(0 AS INTEGER) AS block_row, CAST(0 AS INTEGER) AS block_col, count(*) AS n FROM elastic UNION ALL SELECT 0, 1, 2 * count(*) FROM area UNION ALL SELECT 1, 0, 2 * count(*) FROM area""", _GRID + _SIDE + _ELASTIC + _AREA),
    "p2_subset_pattern": _q(f"""SELECT "row", count(*) AS n, CAST(sum(col) AS BIGINT) AS cols FROM (SELECT DISTINCT a.dof AS "row", b.dof AS col FROM ed a JOIN ed b USING (elem_id) UNION ALL SELECT r, r FROM range(2 * {_COUNT} + (SELECT count(*) FROM sub), 2 * {_COUNT} + (SELECT count(*) FROM sub) + 3) t(r)) GROUP BY 1""",
        _GRID + _SUBSET),
    "p16_vector": _q("SELECT node_id AS dof, CAST(c AS INTEGER) AS c, round(CASE c WHEN 0 THEN x + 2 * y WHEN 1 THEN 3 - y ELSE 1 + 0.5::DOUBLE * x END, 5) + 0.0 AS v FROM nodes, range(3) t(c) WHERE node_id IN (SELECT unnest([n0, n1, n2]) FROM tri)"),
    "p16_constrained": _q("SELECT node_id AS dof, CAST(c AS INTEGER) AS c, round(CASE c WHEN 0 THEN 3 * y ELSE -y END, 5) + 0.0 AS v FROM nodes, range(2) t(c) WHERE node_id IN (SELECT unnest([n0, n1, n2]) FROM tri)"),
    "p17_partial_loads": _q("SELECT node_id AS dof, CASE WHEN s > 45 THEN s ELSE 0.0 END AS v FROM nodes WHERE node_id IN (SELECT node_id FROM ends)"),
    "j1_quad8": _q("SELECT point_id, coalesce(min(elem_id), -1) AS elem_id FROM pt LEFT JOIN b8 ON px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1 GROUP BY 1", _GRID + _PT + _EIGHT),
    "j2_newton": _q("SELECT point_id, elem_id, CASE WHEN elem_id >= 0 THEN round(1 + 2 * px + 3 * py, 7) + 0.0 END AS a, CASE WHEN elem_id >= 0 THEN round(px - py, 7) + 0.0 END AS b FROM l4", _GRID + _PT + _SKEWED),
    "w1_local_elements": _q("SELECT part, elem_id, a, local_id FROM ln JOIN (SELECT DISTINCT elem_id, part FROM line) USING (elem_id) JOIN layout USING (part, node_id)", _GRID + _COUNTS),
    "w3_part_pointer": _q("SELECT part, local_id, CAST(coalesce(sum(n) OVER (PARTITION BY part ORDER BY local_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ptr FROM oc", _GRID + _COUNTS),
    "a8_owned_nnz": _q("SELECT coalesce(part, -1) AS part, CAST(sum(n) AS BIGINT) AS nnz FROM oc GROUP BY ROLLUP (part)", _GRID + _COUNTS),
    "c5_all_kinds": _q("""SELECT part, name, item, comp, local_dof, dof, is_owned, global_dof FROM ld LEFT JOIN (SELECT dof, row_number() OVER (ORDER BY part, local_dof) - 1 AS global_dof FROM ld WHERE is_owned) USING (dof)""", _GRID + _KINDS),
    "w6_extra_ghosts": _q("""SELECT f.part, f.natural_dof, reduced_dof, f.is_owned FROM fr6 f JOIN (SELECT natural_dof, row_number() OVER (ORDER BY part, local_dof) - 1 AS reduced_dof FROM fr6 WHERE is_owned) o USING (natural_dof)""",
        _PARTS + """tied AS (SELECT per.dof, per.master FROM per JOIN own ON own.node_id = per.master WHERE per.dof <> per.master),
all6 AS (SELECT part, local_id AS local_dof, node_id AS natural_dof, is_owned FROM lay
  UNION ALL SELECT part, NULL, master, false FROM (SELECT DISTINCT part, master FROM lay JOIN tied ON tied.dof = node_id WHERE NOT EXISTS (SELECT 1 FROM lay o WHERE o.part = lay.part AND o.node_id = master))),
fr6 AS (SELECT * FROM all6 WHERE natural_dof NOT IN (SELECT dof FROM tied)),
"""),
    "j10_intersected": _q("""SELECT min(dof) AS base, CAST(CASE WHEN count(*) = 1 THEN 1 ELSE 63 END AS BIGINT) AS stride, count(*) AS "count", max(2 * k + c) AS "at", CAST(-14 AS BIGINT) AS hop
FROM (SELECT k, c, 3 * (n - 9 - 3 * k) + 1 - c AS dof FROM n, range(0, (n - 9) // 3 + 1) t(k), range(0, 2) o(c)) WHERE dof % 7 = 0 GROUP BY c""", _STATE),
    "j10_runs": _RANKED + """SELECT min(k) AS base, count(*) AS "count", min(r) AS "at", count(*) FILTER (k % 2 = 0) AS even, min(k) FILTER (k % 2 = 0) AS first_even FROM rk GROUP BY k - r""",
    "j10_picked": _q("SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS pos, dof, v FROM lineitem JOIN vec ON dof = 3 * l_partkey + 1", _STATE),
    "c4_without": _q("SELECT dof, v FROM vec, n WHERE NOT (dof < 3 * n AND dof % 3 < 2 AND dof // 3 % 2 = 0)", _STATE),
    "c1_stacked": _RANKED + f"""SELECT d AS dof, 7.0::DOUBLE AS v FROM range(2 * {_COUNT}) t(d) UNION ALL SELECT 2 * {_COUNT} + 3 * (SELECT count(*) FROM rk) + d, 7.0::DOUBLE FROM range(3) t(d)
UNION ALL SELECT 2 * {_COUNT} + 3 * r + c, CASE c WHEN 0 THEN price WHEN 1 THEN -price ELSE size END FROM rk, range(3) t(c)""",
    "j11_slices": _RANKED + f""", e AS (SELECT {_COUNT} AS n, {_COUNT} // 4 AS lo, {_COUNT} // 2 AS hi), q AS (SELECT min(r) AS r, count(*) AS c FROM rk, e WHERE k >= lo AND k < hi)
SELECT 'u' AS name, 2 * lo AS base, CAST(CASE WHEN hi - lo > 1 THEN 2 ELSE 1 END AS BIGINT) AS stride, hi - lo AS "count", CAST(0 AS BIGINT) AS "at", CAST(1 AS BIGINT) AS hop FROM e WHERE hi > lo
UNION ALL SELECT CASE WHEN p < 2 THEN 'l' ELSE 'm' END, 2 * n + 3 * r + CASE p WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END, CASE WHEN c > 1 THEN 3 ELSE 1 END, c, p % 2, CASE WHEN p < 2 THEN 2 ELSE 1 END FROM e, q, range(3) t(p) WHERE c > 0""",
    "j11_listed": _RANKED + f"""SELECT CAST((l_orderkey * 8 + l_linenumber) * 2 + c AS BIGINT) AS pos, 2 * {_COUNT} + 3 * r + 1 - c AS dof FROM lineitem JOIN rk ON k = l_partkey, range(2) t(c)""",
}
