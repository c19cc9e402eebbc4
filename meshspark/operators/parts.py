"""Meshes split into parts: owners, local numbers, ghosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cut import kept, written
from .matrices import dealt, positions
from .states import Layout, subset_items


def chunks(elem_id: Column, n: int, parts: int) -> Column:
    """Contiguous blocks of elements, the last one smaller."""
    size = max(-(-n // parts), 1)
    return F.least(F.floor(elem_id / size), F.lit(parts - 1)).cast("int")


def touched(elements: DataFrame, partition: DataFrame | None = None) -> DataFrame:
    """part, node_id: the nodes of each part's elements; without a partition, elements have their own column part."""
    parted = elements if partition is None else elements.join(partition, "elem_id")
    return parted.select("part", F.explode("conn").alias("node_id")).distinct()


def node_owner(elements: DataFrame, partition: DataFrame | None = None) -> DataFrame:
    """node_id, owner: the smallest part that touches the node."""
    return touched(elements, partition).groupBy("node_id").agg(F.min("part").alias("owner"))


def local_nodes(elements: DataFrame, partition: DataFrame | None = None) -> DataFrame:
    """part, local_id, node_id, owner, is_owned: owned nodes first, then ghosts, each by rising id."""
    both = touched(elements, partition).withColumn("owner", F.min("part").over(W.partitionBy("node_id")))
    both = written(both.withColumn("_ghost", (F.col("part") != F.col("owner")).cast("int")), "touched")  # numbering reads it three times
    ranked = positions(both, "node_id", "local_id", by=("part",), first="_ghost")
    return ranked.select("part", "local_id", "node_id", "owner", (F.col("_ghost") == 0).alias("is_owned"))


def offsets(layout: DataFrame) -> DataFrame:
    """part, n_local, n_owned, start: sizes, and the owned nodes of all parts before (one row for a part)."""
    sizes = layout.groupBy("part").agg(F.count("*").alias("n_local"), F.sum(F.col("is_owned").cast("long")).alias("n_owned"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn("start", F.coalesce(F.sum("n_owned").over(before), F.lit(0)).cast("long"))


def halo(layout: DataFrame) -> DataFrame:
    """owner, ghost_part, n: how many values each part sends to another."""
    return layout.filter(~F.col("is_owned")).groupBy("owner", F.col("part").alias("ghost_part")).agg(F.count("*").alias("n"))


def block_start(n: int, parts: int, part: Column) -> Column:
    """The first of n unknowns of a part: even blocks, the first n mod parts of them one larger."""
    return part * F.lit(n // parts) + F.least(part, F.lit(n % parts))


def block_of(n: int, parts: int, dof: Column) -> Column:
    """The part whose block holds an unknown."""
    low, more = n // parts, n % parts
    large = more * (low + 1)
    return F.when(dof < large, F.floor(dof / F.lit(low + 1))).otherwise(F.lit(more) + F.floor((dof - large) / F.lit(max(low, 1)))).cast("int")


def totals(layout: DataFrame) -> DataFrame:
    """part, n_local, n_owned of every part, and of all with part null."""
    return layout.rollup("part").agg(F.count("*").alias("n_local"), F.sum(F.col("is_owned").cast("long")).alias("n_owned"))


def n_nodes_global(layout: DataFrame) -> DataFrame:
    """n: the largest node id and one."""
    return layout.agg((F.max("node_id") + 1).alias("n"))


def global_to_local(ids: DataFrame, l2g: DataFrame) -> DataFrame:
    """part, node_id, local_id; -1 where the part has no such node."""
    return ids.join(l2g.select("part", "node_id", "local_id"), ["part", "node_id"], "left").select("part", "node_id", F.coalesce("local_id", F.lit(-1)).cast("long").alias("local_id"))


def dof_layout(layout: DataFrame, components: int = 1) -> DataFrame:
    """part, local_dof, natural_dof, global_dof, is_owned: owned unknowns are numbered part after part without gaps, ghosts have their owner's number.

    The layout is read three times, and so it is written to the shared folder first, if it isn't yet.
    """
    layout = kept(layout, "layout")
    starts = offsets(layout).select(F.col("part").alias("owner"), "start")
    owned = layout.filter("is_owned").join(F.broadcast(starts), "owner").select("node_id", (F.col("start") + F.col("local_id")).alias("_g"))  # a row for a part
    all_of = layout.join(owned, "node_id").withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(components - 1))))
    number = lambda c: (F.col(c) * components + F.col("_c")).cast("long")
    return all_of.select("part", number("local_id").alias("local_dof"), number("node_id").alias("natural_dof"), number("_g").alias("global_dof"), "is_owned")


def reduced_layout(dofs: DataFrame, constrained: DataFrame) -> DataFrame:
    """part, natural_dof, reduced_dof, is_owned of unknowns that constrained(dof) doesn't name: numbered part after part, by owned local numbers."""
    free = written(dofs.join(constrained.select(F.col("dof").alias("natural_dof")), "natural_dof", "left_anti"), "free")
    owned = positions(free.filter("is_owned"), "local_dof", "_rank", by=("part",))
    sizes = owned.groupBy("part").agg(F.count("*").alias("_n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))  # a row for a part
    numbers = owned.join(F.broadcast(starts), "part").select("natural_dof", (F.col("_s") + F.col("_rank")).cast("long").alias("reduced_dof"))
    return free.join(numbers, "natural_dof").select("part", "natural_dof", "reduced_dof", "is_owned")


def missing_masters(dofs: DataFrame, periodic: DataFrame) -> DataFrame:
    """part, natural_dof: masters that a part needs for its slaves and does not hold; to be fetched as further ghosts. A master no part holds is an error of the mesh: it has no owner to fetch from."""
    dofs = written(dofs.select("part", "natural_dof"), "dofs")
    need = dofs.join(periodic.select(F.col("dof").alias("natural_dof"), "master"), "natural_dof").select("part", F.col("master").alias("natural_dof")).distinct()
    return need.join(dofs.select("part", "natural_dof"), ["part", "natural_dof"], "left_anti")


def ghost_fill(dofs: DataFrame, owned: DataFrame) -> DataFrame:
    """part, local_dof, v: every part's values, ghosts with their owner's; owned(global_dof, v)."""
    return dofs.join(owned.select("global_dof", "v"), "global_dof", "left").select("part", "local_dof", "v")


def ghost_add(dofs: DataFrame, local: DataFrame) -> DataFrame:
    """global_dof, v: what all parts' local(part, local_dof, v) add up to, at the owner's number."""
    return local.join(dofs.select("part", "local_dof", "global_dof"), ["part", "local_dof"]).groupBy("global_dof").agg(F.sum("v").alias("v"))


def ghost_add_matrix(dofs: DataFrame, local: DataFrame) -> DataFrame:
    """row, col, v in global numbers of all parts' local(part, row, col, v)."""
    for end in ("row", "col"):
        to = dofs.select("part", F.col("local_dof").alias(end), F.col("global_dof").alias(f"_{end}"))
        local = local.join(to, ["part", end])
    return local.groupBy(F.col("_row").alias("row"), F.col("_col").alias("col")).agg(F.sum("v").alias("v"))


def ghost_add_elements(dofs: DataFrame, ends: DataFrame) -> DataFrame:
    """row, col, v in global numbers: how often two unknowns meet in an element, over the elements of all parts, each given by ends(part, elem_id, local_dof) in its part's own numbers.

    What ghost_add_matrix() gives of the parts' matrices, which are not made here: ends get their owner's
    number before they are paired, and pairs, of which there are many more, move once and one way. Only an
    element's own ends are collected.
    """
    numbered = ends.join(dofs.select("part", "local_dof", "global_dof"), ["part", "local_dof"])
    rows = dealt(numbered, "part", "elem_id").groupBy("part", "elem_id").agg(F.array_sort(F.collect_list("global_dof")).alias("_e"))
    lower = rows.select("_e", F.posexplode("_e").alias("_i", "_a"))
    pairs = lower.select("_a", F.posexplode(F.slice("_e", F.col("_i") + 1, F.size("_e"))).alias("_j", "_b"))
    once = pairs.select("_a", "_b", F.when((F.col("_j") > 0) & (F.col("_a") == F.col("_b")), 2).otherwise(1).alias("_n"))
    half = dealt(once, "_a", "_b").groupBy("_a", "_b").agg(F.sum("_n").cast("double").alias("v"))
    way = lambda row, col: F.struct(F.col(row).alias("row"), F.col(col).alias("col"), "v")
    return half.select(F.inline(F.when(F.col("_a") == F.col("_b"), F.array(way("_a", "_b"))).otherwise(F.array(way("_a", "_b"), way("_b", "_a")))))


def merge_replicas(replicas: DataFrame, n: int, parts: int) -> DataFrame:
    """part, dof, v: the sum of all replicas(dof, v) of a vector of n, each unknown in the part whose block holds it."""
    summed = replicas.groupBy("dof").agg(F.sum("v").alias("v"))
    return summed.select(block_of(n, parts, F.col("dof")).alias("part"), "dof", "v")


def merge_replica_matrices(replicas: DataFrame, n: int, parts: int) -> DataFrame:
    """part, row, col, v: the sum of all replicas' entries, each row in the part whose block holds it."""
    summed = replicas.groupBy("row", "col").agg(F.sum("v").alias("v"))
    return summed.select(block_of(n, parts, F.col("row")).alias("part"), "row", "col", "v")


def gather_global(dofs: DataFrame, local: DataFrame) -> DataFrame:
    """natural_dof, v: the whole vector, of owned pieces alone."""
    return local.join(dofs.filter("is_owned").select("part", "local_dof", "natural_dof"), ["part", "local_dof"]).select("natural_dof", "v")


def local_elements(elements: DataFrame, partition: DataFrame, layout: DataFrame) -> DataFrame:
    """part, elem_id, conn in the part's local numbers, of layout as of local_nodes(). Only an element's own ends are collected, never a part."""
    ends = elements.join(partition, "elem_id").select("part", "elem_id", F.posexplode("conn").alias("_a", "node_id"))
    numbered = ends.join(layout.select("part", "node_id", "local_id"), ["part", "node_id"])
    rows = numbered.groupBy("part", "elem_id").agg(F.array_sort(F.collect_list(F.struct("_a", "local_id"))).alias("_e"))
    return rows.select("part", "elem_id", F.col("_e.local_id").alias("conn"))


def owned_row_counts(pattern: DataFrame, layout: DataFrame) -> DataFrame:
    """part, local_id, n: the entries of each row that a part owns, empty rows included; pattern(row, col) in node ids."""
    n = pattern.groupBy(F.col("row").alias("node_id")).agg(F.count("*").alias("_n"))
    return layout.filter("is_owned").join(n, "node_id", "left").select("part", "local_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def owned_nnz(counts: DataFrame) -> DataFrame:
    """part, nnz of owned_row_counts(), and of all parts with part null."""
    return counts.rollup("part").agg(F.sum("n").alias("nnz"))


def with_extra_ghosts(dofs: DataFrame, periodic: DataFrame) -> DataFrame:
    """dofs with the masters that a part needs for its slaves and lacks, as further ghosts after its own, by rising number; a master that no part owns is an error."""
    need = missing_masters(dofs, periodic)
    owner = dofs.filter("is_owned").select("natural_dof", "global_dof")
    if (bad := need.join(owner, "natural_dof", "left_anti").first()) is not None:
        raise ValueError(f"the master {bad['natural_dof']} is on no part")
    sizes = dofs.groupBy("part").agg((F.max("local_dof") + 1).alias("_n"))  # a row for a part
    extra = positions(need, "natural_dof", "_rank", by=("part",)).join(F.broadcast(sizes), "part").join(owner, "natural_dof")
    extra = extra.select("part", (F.col("_n") + F.col("_rank")).cast("long").alias("local_dof"), "natural_dof", "global_dof", F.lit(False).alias("is_owned"))
    return dofs.select(extra.columns).unionByName(extra)


def ownership(lay: Layout, local: DataFrame, own: dict[str, DataFrame] | None = None) -> DataFrame:
    """part, name, item, comp, local_dof, dof, is_owned, global_dof: every part's unknowns of a packed state, of all kinds of fields.

    local as of local_nodes(). A part's state has the state's root slices in their order: nodal fields on all nodes by local
    number, fields on some nodes by the local number of those that the part has, fields of a part alone as
    long as own[name](part, n) says, shared fields whole. Natural numbers: nodes, positions in the subset, the
    part's share after those before it, the shared item. A nodal unknown is its node's owner's, a part's own are its own, shared
    ones are the first part's. Owned unknowns are numbered part after part by local number, ghosts have their owner's number.
    Fields that a layout interleaves must be on the same nodes; those put one after the other in a block have no local place (an error).
    """
    spark, natural = local.sparkSession, 0
    touching = local.select("part").distinct()
    found, roots = None, {}
    for p in lay.places.values():
        roots.setdefault(p.block, []).append(p)
    for block, places in sorted(roots.items()):
        base, size = min(p.base for p in places), 0
        if len(places) > 1 and any(p.stride == p.field.components for p in places):
            raise ValueError("fields one after the other in a block have no local places")
        for p in places:
            f, comps = p.field, p.field.components
            at = p.base - base
            if f.kind == "nodal" and f.nodes is None:
                rows, size = local.select("part", F.col("local_id").alias("item"), F.col("node_id").alias("_g"), "is_owned"), f.shape[0] * p.stride
            elif f.kind == "nodal":
                items = subset_items(f.nodes)
                mine = positions(local.join(items.withColumnRenamed("item", "_g"), "node_id"), "local_id", "_rank", by=("part",))
                rows, size = mine.select("part", F.col("_rank").alias("item"), "_g", "is_owned"), items.count() * p.stride
            elif f.kind == "local":
                counts = (own or {})[f.name].select("part", "n")
                before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
                starts = counts.withColumn("_s", before)  # a row for a part
                total, most = starts.agg(F.sum("n"), F.max("n")).first()
                each = spark.range(most or 0).withColumnRenamed("id", "item").join(F.broadcast(starts), F.col("item") < F.col("n"))
                rows, size = each.select("part", "item", (F.col("_s") + F.col("item")).alias("_g"), F.lit(True).alias("is_owned")), (total or 0) * comps
            else:
                each = spark.range(f.shape[0]).withColumnRenamed("id", "item").crossJoin(F.broadcast(touching))  # a row for a part
                rows, size = each.select("part", "item", F.col("item").alias("_g"), (F.col("part") == F.lit(0)).alias("is_owned")), f.shape[0] * comps
            one = rows.withColumn("comp", F.explode(F.sequence(F.lit(0), F.lit(comps - 1))))
            place = lambda c: (F.col(c) * p.stride + F.lit(at) + F.col("comp")).cast("long")  # noqa: E731, B023
            one = one.select("part", F.lit(f.name).alias("name"), F.col("item").cast("long").alias("item"), "comp", F.lit(block).alias("_block"), place("item").alias("_within"), (F.lit(natural).cast("long") + place("_g")).alias("dof"), "is_owned")
            found = one if found is None else found.unionByName(one)
        natural += size
    found = written(found, "unknowns")
    slices = found.groupBy("part", "_block").agg(F.count("*").alias("_n"))  # a row for a part and slice
    starts = slices.select("part", "_block", F.coalesce(F.sum("_n").over(W.partitionBy("part").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    placed = found.join(F.broadcast(starts), ["part", "_block"]).withColumn("local_dof", (F.col("_off") + F.col("_within")).cast("long"))
    owned = positions(placed.filter("is_owned").select("part", "local_dof", "dof"), "local_dof", "_rank", by=("part",))
    sizes = owned.groupBy("part").agg(F.count("*").alias("_n"))
    before = sizes.select("part", F.coalesce(F.sum("_n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_s"))  # a row for a part
    numbers = owned.join(F.broadcast(before), "part").select("dof", (F.col("_s") + F.col("_rank")).cast("long").alias("global_dof"))
    return placed.join(numbers, "dof", "left").select("part", "name", "item", "comp", "local_dof", "dof", "is_owned", "global_dof")
