"""Selections as progressions, against lists of their unknowns."""

import random

import pytest

from meshspark.operators import parts, selections, states


def _listed(sets):
    return sorted((r.pos, r.dof) for r in selections.listed(sets).collect())


def _random_sets(spark, rng, n, most_stride):
    """Disjoint progressions: unknowns already taken are left out."""
    rows, taken, at = [], set(), 0
    while len(rows) < n:
        stride, count, base = rng.randint(1, most_stride), rng.choice([1, 1, 2, 7, 60]), rng.randint(0, 3000)
        mine = {base + k * stride for k in range(count)}
        if not mine & taken:
            taken |= mine
            rows.append((base, stride, count, at, 1))
            at += count
    return spark.createDataFrame(rows, "base long, stride long, count long, at long, hop long")


@pytest.mark.parametrize("most_stride", [6, 400])  # pairs of strides by residue, and by range alone
@pytest.mark.parametrize("span_bits", [20, 4])
def test_meeting_and_picking_follow_the_lists(spark, monkeypatch, most_stride, span_bits):
    monkeypatch.setattr(selections, "SPAN_BITS", span_bits)
    rng = random.Random(most_stride + span_bits)
    a, b = _random_sets(spark, rng, 40, most_stride), _random_sets(spark, rng, 40, most_stride)
    held = {d for _, d in _listed(b)}
    expected = [(p, d) for p, d in _listed(a) if d in held]
    assert expected and _listed(selections.intersected(a, b)) == expected
    vec = spark.createDataFrame([(d, d * 0.5, "x") for d in range(0, 3500, 3)] + [(None, 1.0, "x")], "dof long, v double, pos string")
    got = sorted(map(tuple, selections.picked(vec, a).select("pos", "dof", "v").collect()))
    assert got == [(p, d, d * 0.5) for p, d in _listed(a) if d % 3 == 0 and d < 3500]
    rest = selections.without(vec, a)
    assert rest.count() == vec.count() - len(got) and rest.columns == vec.columns


def test_progressions_of_any_length_stay_few_rows(spark):
    a, b = selections.progression(spark, 10**12, -1, -6), selections.progression(spark, 1, 10**12, 10**7)
    far = selections.intersected(selections.progression(spark, 10**9, 0, -6), selections.progression(spark, 4, 10**9, 2 * 10**7 + 3))
    x = next(k for k in range(4, 10**9, 2 * 10**7 + 3) if (10**9 - k) % 6 == 0)
    n = len(range(x, 10**9 + 1, 6 * (2 * 10**7 + 3)))
    assert far.select("base", "stride", "count").collect() == [(x, 6 * (2 * 10**7 + 3), n)]
    assert far.first().at == (10**9 - x) // 6
    assert selections.size(a) == 10**12 // 6 + 1 and selections.size(b) == 10**5


def test_empty_selections(spark):
    none, some = selections.progression(spark, 5, 5), selections.progression(spark, 0, 9)
    vec = spark.createDataFrame([(1, 2.0)], "dof long, v double")
    assert not selections.intersected(none, some).count() and not selections.picked(vec, none).count() and not selections.picked(vec.limit(0), some).count()
    assert selections.without(vec, none).count() == 1 and not selections.listed(none).count() and selections.size(none) == 0
    assert not selections.runs(spark.createDataFrame([(None,)], "dof long")).count()


def _layout(spark):
    some = spark.createDataFrame([(i,) for i in (9, 2, 4, 5, 11)], "node_id long")
    kinds = [states.Field("u", (states.AUTO, 2)), states.Field("l", (states.AUTO, 2), nodes=some), states.Field("s", (3,), "shared"), states.Field("m", (states.AUTO,), nodes=some)]
    return states.layout(kinds, 12, together=(("l", "m"),))


def test_stacks_of_fields_on_some_nodes(spark):
    lay = _layout(spark)
    assert [(p.base, p.stride, p.block) for p in lay.places.values()] == [(0, 2, 0), (24, 3, 1), (39, 1, 2), (26, 3, 1)] and lay.size == 42
    m = spark.createDataFrame([(k, float(k)) for k in range(5)], "item long, v double")
    vec = states.pack(spark, lay, {"m": m})
    assert {(r.item, r.v) for r in states.unpack(lay, vec, "m").collect()} == {(k, float(k)) for k in range(5)}
    assert vec.count() == 42 == vec.select("dof").distinct().count()
    apart = states.layout([p.field for p in lay.places.values()], 12, together=(("m", "u"),))  # the first is a number a node: one after the other
    assert [(p.base, p.stride) for p in apart.places.values()] == [(5, 2), (29, 2), (39, 1), (0, 1)]
    for wrong in ((("l", "u"),), (("l", "s"),), (("l", "l"),), (("x",),)):
        with pytest.raises(ValueError):
            states.layout([p.field for p in lay.places.values()], 12, together=wrong)


def test_ownership_of_stacks(spark):
    lay = _layout(spark)
    rows, shared = [], {0: [0, 1, 2, 3, 4, 5, 6], 1: [5, 6, 7, 8, 9, 10, 11, 2]}  # local numbers: owned nodes first
    for part, nodes in shared.items():
        rows += [(part, n, k, part == 0 or n > 6) for k, n in enumerate(sorted(nodes, key=lambda n, part=part: (part == 1 and n <= 6, n)))]
    got = parts.ownership(lay, spark.createDataFrame(rows, "part int, node_id long, local_id long, is_owned boolean")).collect()
    assert {r.dof for r in got} == {*range(lay.size)}
    for part, nodes in shared.items():
        mine = [r for r in got if r.part == part]
        assert sorted(r.local_dof for r in mine) == [*range(len(mine))]
        assert len(mine) == 2 * len(nodes) + 3 * len({2, 4, 5, 9, 11} & {*nodes}) + 3
    owned = [r for r in got if r.is_owned]
    assert sorted(r.global_dof for r in owned) == [*range(lay.size)]
    m = {(r.part, r.item): r for r in got if r.name == "m"}
    for r in got:
        if r.name == "l":
            assert m[r.part, r.item].dof - r.dof == 2 - r.comp == m[r.part, r.item].local_dof - r.local_dof
    apart = states.layout([p.field for p in lay.places.values() if p.field.name in ("l", "m")], 12, together=(("m", "l"),))
    with pytest.raises(ValueError):
        parts.ownership(apart, spark.createDataFrame(rows, "part int, node_id long, local_id long, is_owned boolean"))


@pytest.mark.parametrize(("items", "comps"), [(None, None), (slice(-2, None, -3), [1, 0]), ([3, -1, 3], slice(None, None, -1)), (5, -1), (slice(4, 4), None)])
def test_selectors_agree_with_listed_ones(spark, items, comps):
    lay = _layout(spark)
    theirs = sorted((r.pos, r.dof) for r in states.select_dofs(spark, lay, "u", items, [comps] if isinstance(comps, int) else comps).collect())
    assert _listed(selections.of_field(spark, lay, "u", items, comps)) == theirs


def test_nodes_of_the_mesh_select_on_all_kinds(spark):
    lay, ids = _layout(spark), [2, 4, 5, 9, 11]
    for s in (slice(None), slice(4, 10), slice(3, None), slice(None, 5), slice(6, 8), slice(-5, 100)):
        start, stop = s.start if s.start is not None else 0, s.stop if s.stop is not None else 100
        inside = [k for k, i in enumerate(ids) if start <= i < stop]
        expected = [(2 * n + c, 24 + 3 * k + c) for n, k in enumerate(inside) for c in range(2)]
        assert _listed(selections.of_nodes(spark, lay, "l", s)) == expected
    assert _listed(selections.of_nodes(spark, lay, "m", [9, 2, 9])) == [(0, 35), (1, 26), (2, 35)]
    table = spark.createDataFrame([(0, 7), (1, 7)], "pos long, node_id long")
    assert _listed(selections.of_nodes(spark, lay, "u", table, 1)) == [(0, 15), (1, 15)]
    for missing in (3, [2, 3], spark.createDataFrame([(0, None)], "pos long, node_id long")):
        with pytest.raises(KeyError):
            selections.of_nodes(spark, lay, "l", missing)
    for wrong in (12, [0, 12], table.selectExpr("pos", "node_id + 5 AS node_id"), table.selectExpr("pos", "CAST(NULL AS BIGINT) AS node_id")):
        with pytest.raises(IndexError):
            selections.of_nodes(spark, lay, "u", wrong)
    with pytest.raises(ValueError):
        selections.of_nodes(spark, lay, "l", slice(0, 9, 2))
    with pytest.raises(ValueError):
        selections.of_nodes(spark, lay, "s", 0)
    with pytest.raises(IndexError):
        selections.of_field(spark, lay, "u", 0, 2)


def test_runs_of_neighbours(spark):
    got = selections.runs(spark.createDataFrame([(i,) for i in (7, 8, 9, 20, 8, 2, 3)], "dof long"))
    assert sorted(map(tuple, got.collect())) == [(2, 1, 2, 0, 1), (7, 1, 3, 2, 1), (20, 1, 1, 5, 1)]
