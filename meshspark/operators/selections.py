"""Selections of unknowns as sets of progressions, which meet by residue and range and are listed only on demand.

A selection is a table of progressions: base, stride (1 or more), count (1 or more), and the place
of each unknown in the selection's order: base + k * stride is number at + k * hop.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .states import Layout, _place, subset_items

#: Progressions are cut to this span (a power of two) before they meet, so that no key holds more unknowns.
SPAN_BITS = 20
#: Unknowns that one row lists at a time.
LISTED = 1 << 16
#: Pairs of strides meet by the residue of their own divisor up to this many strides a side; beyond, by range alone.
FEW_STRIDES = 32
COLUMNS = ("base", "stride", "count", "at", "hop")
_TYPES = ", ".join(f"{c} long" for c in COLUMNS)


def progression(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """The selection start, start + step and so on before stop; steps may be negative, unknowns may not."""
    return spark.createDataFrame(_rows(range(start, stop, step), 0, 1), _TYPES)


def _rows(r: range, at: int, hop: int) -> list[tuple[int, ...]]:
    """A range as a progression that rises."""
    if not r:
        return []
    if r.step < 0:
        r, at, hop = r[::-1], at + (len(r) - 1) * hop, -hop
    return [(r.start, r.step if len(r) > 1 else 1, len(r), at, hop)]


def _components(lay: Layout, name: str, comps: int | slice | list[int] | None) -> list[int]:
    n = _place(lay, name).field.components
    if comps is None or isinstance(comps, slice):
        return [*range(n)[comps or slice(None)]]
    listed = [comps] if isinstance(comps, int) else [*comps]
    if any(not -n <= c < n for c in listed):
        raise IndexError(f"{name}: component outside of {n}")
    return [c % n for c in listed]


def of_field(spark: SparkSession, lay: Layout, name: str, items: int | slice | list[int] | None = None, comps: int | slice | list[int] | None = None) -> DataFrame:
    """Unknowns of a field by selectors of items and components (a number, a slice, a short list, all), one progression a component and slice.

    Negative numbers count from the end; a number or an element of a list outside of the field is an
    error. The order is by item, then component. For long lists see of_items.
    """
    p, cs = _place(lay, name), _components(lay, name, comps)
    n = p.field.shape[0]
    if items is None or isinstance(items, slice):
        chosen = [range(n)[items or slice(None)]]
    else:
        listed = [items] if isinstance(items, int) else [*items]
        if any(not -n <= i < n for i in listed):
            raise IndexError(f"{name}: item outside of {n}")
        chosen = [range(i % n, i % n + 1) for i in listed]
    rows, before = [], 0
    for r in chosen:
        for k, c in enumerate(cs):
            if r:
                first = p.base + r[0] * p.stride + c
                rows += _rows(range(first, first + r.step * p.stride * len(r), r.step * p.stride), before + k, len(cs))
        before += len(r) * len(cs)
    return spark.createDataFrame(rows, _TYPES)


def of_items(lay: Layout, name: str, wanted: DataFrame, comps: int | slice | list[int] | None = None) -> DataFrame:
    """Unknowns at wanted(pos, item), positions from 0; an item outside of the field (null too) is an error. Items may repeat."""
    p, cs = _place(lay, name), _components(lay, name, comps)
    outside = ~F.coalesce(F.col("item").between(0, p.field.shape[0] - 1), F.lit(False))
    if (bad := wanted.filter(outside).first()) is not None:
        raise IndexError(f"{name}: no item {bad['item']}")
    each = wanted.select(F.col("pos").cast("long").alias("pos"), F.col("item").cast("long").alias("item"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("c")) for k, c in enumerate(cs)])).alias("_c"))
    one = F.lit(1).cast("long")
    return each.select((F.lit(p.base).cast("long") + F.col("item") * p.stride + F.col("_c.c")).alias("base"), one.alias("stride"), one.alias("count"), (F.col("pos") * len(cs) + F.col("_c.k")).alias("at"), one.alias("hop"))


def of_nodes(spark: SparkSession, lay: Layout, name: str, nodes: int | slice | list[int] | DataFrame, comps: int | slice | list[int] | None = None) -> DataFrame:
    """Unknowns of a nodal field by global node ids: a number, a slice, a short list, or a table nodes(pos, node_id).

    On a field of some nodes a slice means those of its nodes whose ids lie in it: two counts, nothing
    is listed; its step must be 1. A node that the field doesn't have is an error, null too.
    """
    p = _place(lay, name)
    if p.field.kind != "nodal":
        raise ValueError(f"{name}: not a field of nodes")
    if p.field.nodes is None:
        if isinstance(nodes, DataFrame):
            return of_items(lay, name, nodes.select("pos", F.col("node_id").alias("item")), comps)
        return of_field(spark, lay, name, nodes, comps)
    if isinstance(nodes, slice):
        if nodes.step not in (None, 1):
            raise ValueError(f"{name}: a slice of the nodes of a part of the mesh has step 1")
        node, ends = F.col("node_id"), (nodes.start, nodes.stop)
        below = [F.count_if(F.lit(k == 1) if e is None else node < e) for k, e in enumerate(ends)]
        return of_field(spark, lay, name, slice(*p.field.nodes.select(node).distinct().agg(*below).first()), comps)
    if not isinstance(nodes, DataFrame):
        nodes = spark.createDataFrame([*enumerate([nodes] if isinstance(nodes, int) else nodes)], "pos long, node_id long")
    found = nodes.select("pos", "node_id").join(subset_items(p.field.nodes), "node_id", "left")
    if (bad := found.filter("item IS NULL").first()) is not None:
        raise KeyError(f"{name}: no node {bad['node_id']}")
    return of_items(lay, name, found.select("pos", "item"), comps)


def runs(ids: DataFrame) -> DataFrame:
    """The distinct unknowns of ids(dof) as runs of neighbours, in rising order; nulls are left out."""
    ranked = subset_items(ids.filter("dof IS NOT NULL").select(F.col("dof").cast("long").alias("node_id")))
    out = ranked.groupBy((F.col("node_id") - F.col("item")).alias("_run")).agg(F.min("node_id").alias("base"), F.count("*").alias("count"), F.min("item").alias("at"))
    one = F.lit(1).cast("long")
    return out.select("base", one.alias("stride"), "count", "at", one.alias("hop"))


def size(sets: DataFrame) -> int:
    """How many unknowns a selection has, repeated ones each time."""
    return sets.agg(F.sum("count")).first()[0] or 0


def _pieces(sets: DataFrame, most: Column) -> DataFrame:
    """Progressions cut to `most` elements; _base and _at are where their whole began."""
    cut = sets.withColumn("_most", most).withColumn("_k", F.explode(F.expr("sequence(0L, (count - 1) div _most)")))
    first = F.col("_k") * F.col("_most")
    whole = [F.col("base").alias("_base"), F.col("at").alias("_at"), F.col("count").alias("_count")]
    return cut.select(*whole, (F.col("base") + first * F.col("stride")).alias("base"), "stride", F.least("_most", F.col("count") - first).alias("count"), (F.col("at") + first * F.col("hop")).alias("at"), "hop")


def listed(sets: DataFrame) -> DataFrame:
    """pos, dof of a selection; long progressions are shared out among tasks in pieces."""
    spark = sets.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = _pieces(sets.select(*COLUMNS), F.lit(LISTED)).repartition(n, "base", "at")
    each = each.withColumn("_i", F.explode(F.expr("sequence(0L, count - 1)")))
    return each.select((F.col("at") + F.col("_i") * F.col("hop")).alias("pos"), (F.col("base") + F.col("_i") * F.col("stride")).alias("dof"))


def _end() -> Column:
    return F.col("base") + (F.col("count") - 1) * F.col("stride")


def _levelled(sets: DataFrame) -> DataFrame:
    """Short pieces with _level, the smallest e such that 2 ** e unknowns span the piece, and _s, the stride or 0 of a single unknown."""
    short = _pieces(sets.select(*COLUMNS), F.expr(f"greatest(1L, {1 << SPAN_BITS}L div stride)"))
    reach = _end() - F.col("base")
    level = F.when(reach == 0, 0).otherwise(F.length(F.bin(reach)))
    return short.withColumns({"_level": level, "_s": F.when(F.col("count") == 1, F.lit(0)).otherwise(F.col("stride")).cast("long")})


def _euclid(a: Column, b: Column) -> Column:
    """The greatest common divisor g of two strides below 2 ** 31, and the inverse of a / g modulo b / g."""
    start = F.struct(a.alias("r"), b.alias("t"), F.lit(1).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))

    def step(s: Column, _: Column) -> Column:
        q = F.floor(s.r / F.greatest(s.t, F.lit(1))).cast("long")
        on = F.struct(s.t.alias("r"), (s.r - q * s.t).alias("t"), s.y.alias("x"), (s.x - q * s.y).alias("y"))
        return F.when(s.t == 0, s).otherwise(on)

    def last(s: Column) -> Column:
        return F.struct(s.r.alias("g"), F.pmod(s.x, (b / s.r).cast("long")).alias("inv"))

    return F.reduce(F.sequence(F.lit(1), F.lit(48)), start, step, last)  # 48 steps: no 31-bit pair takes more


def _strides(sets: DataFrame) -> list[int] | None:
    found = [r[0] for r in sets.select("stride").distinct().limit(FEW_STRIDES + 1).collect()]
    return found if len(found) <= FEW_STRIDES else None


def _meeting(a: DataFrame, b: DataFrame, strides: tuple[list[int] | None, list[int] | None]) -> DataFrame:
    """Pairs of pieces that touch one bin with one residue: _lo, the larger base, and the columns of both, prefixed a_ and b_; wholes end in 0.

    Pieces meet in the bins of the larger one's level, of which each touches two at most; a pair is
    taken in the bin of the larger base, at one level, so once.
    """
    levels = {s: [r[0] for r in d.select("_level").distinct().collect()] for s, d in (("a", a), ("b", b))}  # at most SPAN_BITS + 1
    common = None
    if None not in strides:
        pairs = [(s, t, max(math.gcd(s, t), 1)) for s in {0, *strides[0]} for t in {0, *strides[1]}]
        common = F.broadcast(a.sparkSession.createDataFrame(pairs, "_a long, _b long, _g long"))

    def keyed(d: DataFrame, me: str, other: str) -> DataFrame:
        if common is not None:
            d = d.join(common, d["_s"] == common[f"_{me}"])
        else:
            d = d.withColumns({c: F.lit(1).cast("long") for c in ("_a", "_b", "_g")})
        level, e = F.col("_level"), F.lit
        mine = F.struct(F.lit(me).alias("side"), level.alias("level"))
        above = [F.when(e(n) >= level if me == "b" else e(n) > level, F.struct(F.lit(other).alias("side"), e(n).alias("level"))) for n in levels[other]]
        d = d.withColumn("_at_level", F.explode(F.array_compact(F.array(mine, *above))))
        d = d.withColumn("_bin", F.explode(F.expr("sequence(shiftright(base, _at_level.level), shiftright(base + (count - 1) * stride, _at_level.level))")))
        keys = [F.col("_at_level.side").alias("_side"), F.col("_at_level.level").alias("_l"), "_bin", "_a", "_b", F.pmod("base", "_g").alias("_res")]
        whole = [F.col(f"_{c}").alias(f"{me}_{c}0") for c in ("base", "at", "count")]
        return d.select(*keys, *whole, *[F.col(c).alias(f"{me}_{c}") for c in (*COLUMNS, *(["row"] if "row" in d.columns else []))])

    both = keyed(a, "a", "b").join(keyed(b, "b", "a"), ["_side", "_l", "_bin", "_a", "_b", "_res"])
    return both.withColumn("_lo", F.greatest("a_base", "b_base")).filter(F.expr("shiftright(_lo, _l)") == F.col("_bin"))


def intersected(a: DataFrame, b: DataFrame) -> DataFrame:
    """The selection of a's unknowns that b holds too, at their positions in a; nothing is listed.

    Two progressions share one of the least common multiple of their strides, from the Chinese
    remainder on (strides below 2 ** 31). An unknown that b holds twice comes twice.
    """
    strides = _strides(a), _strides(b)
    pairs = _meeting(_levelled(a), _levelled(b), strides)
    if None not in strides:
        table = [(s, t, g := math.gcd(s, t), pow(s // g, -1, t // g)) for s in strides[0] for t in strides[1]]
        pairs = pairs.join(F.broadcast(a.sparkSession.createDataFrame(table, "a_stride long, b_stride long, _g long, _inv long")), ["a_stride", "b_stride"])
    else:
        pairs = pairs.withColumn("_e", _euclid(F.col("a_stride"), F.col("b_stride"))).withColumns({"_g": F.col("_e.g"), "_inv": F.col("_e.inv")})
    pairs = pairs.filter("pmod(b_base - a_base, _g) = 0")
    turn = F.pmod(F.expr("(b_base - a_base) div _g"), F.expr("b_stride div _g")) * F.col("_inv")
    meet = F.col("a_base") + F.col("a_stride") * F.pmod(turn, F.expr("b_stride div _g"))
    pairs = pairs.withColumn("_lcm", F.expr("a_stride div _g * b_stride")).withColumn("_first", F.col("_lo") + F.pmod(meet - F.col("_lo"), F.col("_lcm")))
    pairs = pairs.withColumn("_hi", F.least(F.expr("a_base + (a_count - 1) * a_stride"), F.expr("b_base + (b_count - 1) * b_stride"))).filter("_first <= _hi")
    # Pieces of the same two progressions are one again.
    whole = ["a_base0", "a_at0", "a_count0", "a_stride", "a_hop", "b_base0", "b_at0", "b_count0", "b_stride", "_lcm"]
    out = pairs.groupBy(*whole).agg(F.min("_first").alias("base"), F.sum(F.expr("(_hi - _first) div _lcm + 1")).alias("count"))
    one = F.col("count") == 1
    return out.select(
        "base", F.when(one, F.lit(1)).otherwise(F.col("_lcm")).cast("long").alias("stride"), "count",
        (F.col("a_at0") + F.expr("(base - a_base0) div a_stride") * F.col("a_hop")).alias("at"), F.expr("_lcm div a_stride * a_hop").alias("hop"),
    )


def picked(vec: DataFrame, sets: DataFrame) -> DataFrame:
    """pos and the columns of vec(dof, ...) for each unknown of a selection that vec holds; the selection is not listed. Rows of vec without a number are left out, as is a column pos of its own."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    kept = [c for c in vec.columns if c not in ("dof", "pos")]
    points = vec.filter("dof IS NOT NULL").select(F.col("dof").cast("long").alias("base"), one.alias("stride"), one.alias("count"), zero.alias("at"), one.alias("hop"), F.struct(*kept, one.alias("_")).alias("row"))
    points = points.select("*", F.col("base").alias("_base"), zero.alias("_at"), one.alias("_count"), F.lit(0).alias("_level"), zero.alias("_s"))
    pairs = _meeting(points, _levelled(sets), ([], _strides(sets))).filter("a_base BETWEEN b_base AND b_base + (b_count - 1) * b_stride AND (a_base - b_base) % b_stride = 0")
    at = F.col("b_at") + F.expr("(a_base - b_base) div b_stride") * F.col("b_hop")
    return pairs.select(at.alias("pos"), F.col("a_base").alias("dof"), *[F.col("a_row")[c].alias(c) for c in kept])


def without(vec: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of vec(dof, ...) whose unknowns a selection doesn't hold, those without a number too."""
    return vec.join(picked(vec.select("dof"), sets).select("dof"), "dof", "left_anti")
