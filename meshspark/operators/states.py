"""Packed state: several fields of different shapes in one vector of unknowns."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .matrices import positions

#: A size that the layout takes from the number of nodes.
AUTO = -1
RESERVED = {"fields", "size", "state"}


@dataclass(frozen=True)
class Field:
    """name, kind (nodal, local or shared) and shape: items first, then the components of an item.

    A nodal field on some nodes has their ids as nodes(node_id); its items are numbered by rising id.
    """

    name: str
    shape: tuple[int, ...]
    kind: str = "nodal"
    nodes: DataFrame | None = field(default=None, compare=False)

    @property
    def components(self) -> int:
        out = 1
        for s in self.shape[1:]:
            out *= s
        return out


@dataclass(frozen=True)
class Place:
    """Where a field lies: the unknown of item i and component c is base + i * stride + c."""

    field: Field
    base: int
    stride: int
    block: int


@dataclass(frozen=True)
class Layout:
    """Places of fields by name, in the order declared, and the number of unknowns."""

    places: dict[str, Place]
    size: int


def layout(fields: list[Field], n_nodes: int, stack: bool = True, together: tuple[tuple[str, ...], ...] = (), axis: int = -1) -> Layout:
    """Resolve AUTO sizes and give every field its place.

    With stack, two or more nodal fields on all nodes are interleaved by node in a block that comes
    first; all others follow in the order declared, each a block. Names must be unique and not reserved.

    Nodal fields that `together` names are interleaved in a block of their own, where the first of them
    stood: item by item with axis 1, one field after the other with axis 0. Negative axes count from
    the end of the first field's shape. Axis 1 asks for equal numbers of items.
    """
    names = [f.name for f in fields]
    if len({*names}) < len(names) or {*names} & RESERVED:
        raise ValueError("names of fields must be unique and not reserved")
    given = [replace(f, shape=((n_nodes if f.nodes is None else f.nodes.count()) if f.shape[0] == AUTO else f.shape[0], *f.shape[1:])) for f in fields]
    own = {n: group for group in together for n in group}
    if len(own) < sum(map(len, together)) or own.keys() - {*names}:
        raise ValueError("a field is stacked once, and must be there")
    whole = [f for f in given if f.kind == "nodal" and f.nodes is None and f.name not in own]
    stacked = whole if stack and len(whole) > 1 and len({f.shape[0] for f in whole}) == 1 else []
    places, base, block = {}, 0, 0
    if stacked:
        stride, at = sum(f.components for f in stacked), 0
        for f in stacked:
            places[f.name] = Place(f, at, stride, 0)
            at += f.components
        base, block = stride * stacked[0].shape[0], 1
    by_name = {f.name: f for f in given}
    for f in given:
        if f.name in own and f.name not in places:
            group = [by_name[n] for n in own[f.name]]
            places |= _stacked(group, axis % len(group[0].shape), base, block)
            base, block = base + sum(g.shape[0] * g.components for g in group), block + 1
        elif f.name not in places:
            places[f.name] = Place(f, base, f.components, block)
            base, block = base + f.shape[0] * f.components, block + 1
    return Layout({n: places[n] for n in names}, base)


def _stacked(group: list[Field], axis: int, base: int, block: int) -> dict[str, Place]:
    if any(f.kind != "nodal" for f in group) or axis > 1:
        raise ValueError("nodal fields are stacked, by items or one after the other")
    if axis == 1 and len({f.shape[0] for f in group}) > 1:
        raise ValueError("fields that are interleaved have equal numbers of items")
    out, at = {}, base
    for f in group:
        out[f.name] = Place(f, at, f.components if axis == 0 else sum(g.components for g in group), block)
        at += f.components * (f.shape[0] if axis == 0 else 1)
    return out


def dofs(spark: SparkSession, lay: Layout, name: str) -> DataFrame:
    """item, comp, dof of a field."""
    p = _place(lay, name)
    each = spark.range(p.field.shape[0]).withColumnRenamed("id", "item")
    each = each.withColumn("comp", F.explode(F.sequence(F.lit(0), F.lit(p.field.components - 1))))
    return each.select("item", "comp", (F.lit(p.base).cast("long") + F.col("item") * p.stride + F.col("comp")).alias("dof"))


def _place(lay: Layout, name: str) -> Place:
    if name not in lay.places:
        raise KeyError(f"no field {name}")
    return lay.places[name]


def _long(values: DataFrame) -> DataFrame:
    """item, comp, v of values(item, v), v a number or an array of components."""
    if values.schema["v"].dataType.typeName() == "array":
        return values.select("item", F.posexplode("v").alias("comp", "v"))
    return values.select("item", F.lit(0).alias("comp"), "v")


def pack(spark: SparkSession, lay: Layout, fields: dict[str, DataFrame], default: float = 0.0) -> DataFrame:
    """dof, v of all unknowns: the fields' values(item, v), the default where they have none. Items outside a field are an error of the caller's and left out."""
    parts = []
    for name, p in lay.places.items():
        d = dofs(spark, lay, name)
        if name in fields:
            d = d.join(_long(fields[name]), ["item", "comp"], "left").select("dof", F.coalesce("v", F.lit(default)).alias("v"))
        else:
            d = d.select("dof", F.lit(default).alias("v"))
        parts.append(d)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unpack(lay: Layout, vec: DataFrame, name: str) -> DataFrame:
    """item, comp, v of one field: the strides are inverted, nothing is joined."""
    p = _place(lay, name)
    at = F.col("dof") - F.lit(p.base)
    item, comp = F.floor(at / p.stride).cast("long"), F.pmod(at, F.lit(p.stride))
    mine = (at >= 0) & (comp < p.field.components) & (item < p.field.shape[0])
    return vec.filter(mine).select(item.alias("item"), comp.cast("int").alias("comp"), "v")


def set_field(spark: SparkSession, lay: Layout, vec: DataFrame, name: str, values: DataFrame) -> DataFrame:
    """The vector with one field's given values(item, v) in place of its own."""
    new = dofs(spark, lay, name).join(_long(values), ["item", "comp"]).select("dof", F.col("v").alias("_v"), F.lit(True).alias("_on"))
    return vec.join(new, "dof", "left").select("dof", F.when(F.col("_on"), F.col("_v")).otherwise(F.col("v")).alias("v"))


def add_states(a: DataFrame, b: DataFrame) -> DataFrame:
    """dof, v: the sum of two vectors; an unknown that one lacks counts as 0 there."""
    return a.select("dof", "v").unionByName(b.select("dof", "v")).groupBy("dof").agg(F.sum("v").alias("v"))


def select_dofs(spark: SparkSession, lay: Layout, name: str, items: int | slice | list[int] | None = None, comps: int | slice | list[int] | None = None) -> DataFrame:
    """pos, dof of a field's unknowns by selectors of items and components: a number, a slice, a list or all; negative numbers count from the end."""
    p = _place(lay, name)

    def axis(chosen, n: int):
        if chosen is None:
            chosen = slice(None)
        if isinstance(chosen, slice):
            r = range(*chosen.indices(n))
            return spark.range(len(r)).select(F.col("id").alias("k"), (F.lit(r.start).cast("long") + F.col("id") * r.step).alias("i"))
        listed = [chosen] if isinstance(chosen, int) else chosen
        if any(not -n <= i < n for i in listed):
            raise IndexError(f"{name}: index outside of {n}")
        return spark.createDataFrame([(k, i % n) for k, i in enumerate(listed)], "k long, i long")

    many, few = axis(items, p.field.shape[0]), axis(comps, p.field.components)
    n_few = len(range(*comps.indices(p.field.components))) if isinstance(comps, slice) else len(comps) if isinstance(comps, list) else 1 if comps is not None else p.field.components
    both = many.crossJoin(F.broadcast(few.select(F.col("k").alias("kc"), F.col("i").alias("ic"))))  # the components of one item
    return both.select((F.col("k") * n_few + F.col("kc")).alias("pos"), (F.lit(p.base).cast("long") + F.col("i") * p.stride + F.col("ic")).alias("dof"))


def subset_items(nodes: DataFrame) -> DataFrame:
    """node_id, item: the position of each id of a subset, by rising id."""
    return positions(nodes.select("node_id").distinct(), "node_id", "item")


def global_dofs(lay: Layout, name: str, wanted: DataFrame, comp: int = 0, on_missing: str = "error") -> DataFrame:
    """node_id, dof of a nodal field at wanted(node_id); a node that the field or the mesh doesn't have is an error, or null with on_missing="null"."""
    if on_missing not in ("error", "null"):
        raise ValueError("on_missing is error or null")
    p = _place(lay, name)
    if not 0 <= comp < p.field.components:
        raise IndexError(f"{name}: component {comp}")
    if p.field.nodes is None:
        inside = F.col("node_id").between(0, p.field.shape[0] - 1)
        at = wanted.select("node_id", F.when(inside, F.col("node_id")).alias("item"))
    else:
        at = wanted.select("node_id").join(subset_items(p.field.nodes), "node_id", "left")
    if on_missing == "error" and (bad := at.filter("item IS NULL").first()) is not None:
        raise KeyError(f"{name}: no node {bad['node_id']}")
    return at.select("node_id", (F.lit(p.base + comp).cast("long") + F.col("item") * p.stride).alias("dof"))


def natural_dofs(lay: Layout, local: DataFrame) -> DataFrame:
    """part, name, local_id, comp, dof, is_owned of nodal fields on all nodes and shared fields; local as of parts.local_nodes. Shared unknowns are the first part's."""
    out = None
    for name, p in lay.places.items():
        comps = F.explode(F.sequence(F.lit(0), F.lit(p.field.components - 1)))
        if p.field.kind == "shared":
            d = local.select("part").distinct().withColumn("local_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(p.field.shape[0] - 1).cast("long"))))
            d = d.withColumn("comp", comps).select("part", F.lit(name).alias("name"), "local_id", "comp", (F.lit(p.base).cast("long") + F.col("local_id") * p.stride + F.col("comp")).alias("dof"), (F.col("part") == 0).alias("is_owned"))
        elif p.field.nodes is None and p.field.kind == "nodal":
            d = local.withColumn("comp", comps).select("part", F.lit(name).alias("name"), "local_id", "comp", (F.lit(p.base).cast("long") + F.col("node_id") * p.stride + F.col("comp")).alias("dof"), "is_owned")
        elif p.field.kind == "local":
            raise ValueError(f"{name}: fields of a part alone have no global number; place them by offsets of the parts")
        else:
            items = subset_items(p.field.nodes)
            d = local.join(items, "node_id").withColumn("comp", comps).select("part", F.lit(name).alias("name"), "local_id", "comp", (F.lit(p.base).cast("long") + F.col("item") * p.stride + F.col("comp")).alias("dof"), "is_owned")
        out = d if out is None else out.unionByName(d)
    return out
