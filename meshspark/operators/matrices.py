"""Sparse patterns and matrices as tables (row, col[, v]), and numbering."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .cut import deleted, together, written

BUCKET = 1 << 16

#: The most classes that colour() deals columns into.
CLASSES = 16

#: Unknowns on a side of a tile of solve_cg().
TILE = 1 << 12

#: Columns and neighbours before them that one task colours in order.
BLOCK = 1 << 19


def _starts(counts: DataFrame, lead: list[str], at: str, span: int) -> DataFrame:
    """lead, at, _start: the sum of _n of all before, in levels of BUCKET while the span of `at` is large."""
    if span <= 16 * BUCKET:
        before = W.partitionBy(*lead).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
        return counts.select(*lead, at, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    up = f"{at}_up"
    upped = counts.withColumn(up, F.floor(F.col(at) / BUCKET).cast("long"))
    above = _starts(upped.groupBy(*lead, up).agg(F.sum("_n").alias("_n")), lead, up, span // BUCKET + 1).withColumnRenamed("_start", "_above")
    before = W.partitionBy(*lead, up).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    within = upped.withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return within.join(above, [*lead, up]).select(*lead, at, (F.col("_s") + F.col("_above")).alias("_start"))


def positions(df: DataFrame, key: str, name: str = "pos", by: tuple[str, ...] = (), first: str | None = None) -> DataFrame:
    """df with the rank (from 0) of its unique integer key, within each `by`, rows with a smaller `first` before.

    Rows are numbered within ranges of BUCKET keys, on top of the counts of the ranges before, which
    are summed in further levels where the keys are sparse; no window holds more than 16 BUCKET
    rows of counts. The span of the keys is asked for first.
    """
    lead = [*by, *([first] if first else [])]
    d = df.withColumn("_bucket", F.expr(f"`{key}` div {BUCKET}"))
    low, high = d.agg(F.min("_bucket"), F.max("_bucket")).first()
    counts = d.groupBy(*lead, "_bucket").agg(F.count("*").alias("_n"))
    starts = _starts(counts, lead, "_bucket", (high or 0) - (low or 0) + 1)
    if first:
        sums = counts.groupBy(*lead).agg(F.sum("_n").alias("_n"))  # a row for each value of first
        before = W.partitionBy(*by).orderBy(first).rowsBetween(W.unboundedPreceding, -1)
        sums = sums.select(*lead, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_lead"))
        starts = starts.join(sums, lead).select(*lead, "_bucket", (F.col("_start") + F.col("_lead")).alias("_start"))
    within = F.row_number().over(W.partitionBy(*lead, "_bucket").orderBy(key)) - 1
    out = d.withColumn("_in", within).join(starts, [*lead, "_bucket"])
    return out.withColumn(name, (F.col("_start") + F.col("_in")).cast("long")).drop("_bucket", "_in", "_start")


def row_counts(coo: DataFrame, n: int) -> DataFrame:
    """row, n for every row of a matrix with n rows, empty ones included."""
    counts = coo.groupBy("row").agg(F.count("*").alias("n"))
    rows = coo.sparkSession.range(n).withColumnRenamed("id", "row")
    return rows.join(counts, "row", "left").select("row", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def row_pointer(coo: DataFrame, n: int) -> DataFrame:
    """row, ptr: entries before each row; running sums in levels."""
    c = row_counts(coo, n).withColumn("_bucket", F.expr(f"row div {BUCKET}"))
    starts = _starts(c.groupBy("_bucket").agg(F.sum("n").alias("_n")), [], "_bucket", n // BUCKET + 1)
    within = F.coalesce(F.sum("n").over(W.partitionBy("_bucket").orderBy("row").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return c.withColumn("_in", within).join(starts, "_bucket").select("row", (F.col("_start") + F.col("_in")).cast("long").alias("ptr"))


def part_pointer(counts: DataFrame, key: str = "local_id") -> DataFrame:
    """part, key, ptr of counts(part, key, n): entries before each row of its part; running sums in levels that start anew in each part."""
    c = counts.withColumn("_bucket", F.expr(f"`{key}` div {BUCKET}"))
    high = c.agg(F.max("_bucket")).first()[0] or 0
    starts = _starts(c.groupBy("part", "_bucket").agg(F.sum("n").alias("_n")), ["part"], "_bucket", high + 1)
    within = F.coalesce(F.sum("n").over(W.partitionBy("part", "_bucket").orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return c.withColumn("_in", within).join(starts, ["part", "_bucket"]).select("part", key, (F.col("_start") + F.col("_in")).cast("long").alias("ptr"))


def once(df: DataFrame, *keys: str) -> DataFrame:
    """df's distinct rows, dealt by the keys (all columns if none are given) before repeats are dropped: where few rows repeat, dropping them before the shuffle too costs memory and spills for nothing."""
    return dealt(df, *(keys or df.columns)).distinct()


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df in as many partitions as spark.sql.shuffle.partitions says: not joined into fewer by their compressed size, which says little of the memory that their rows take."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def both_ways(half: DataFrame, a: str, b: str) -> DataFrame:
    """a, b of pairs that are given one way, both ways; a pair of equal ends once."""
    ways = F.when(F.col(a) == F.col(b), F.array(F.struct(a, b))).otherwise(F.array(F.struct(a, b), F.struct(F.col(b).alias(a), F.col(a).alias(b))))
    return half.select(F.inline(ways))


def node_pairs(elements: DataFrame) -> DataFrame:
    """a, b of nodes that share an element, both ways, each pair once; pairs are made unique one way, a <= b."""
    ends = elements.select(F.array_distinct("conn").alias("conn")).select(F.explode("conn").alias("a"), "conn")
    half = ends.select("a", F.explode(F.filter("conn", lambda b: b >= F.col("a"))).alias("b"))
    return both_ways(once(half), "a", "b")


def mesh_pattern(elements: DataFrame, dofs: int = 1) -> DataFrame:
    """row, col of unknowns that share an element; node pairs are made unique before they are expanded."""
    pairs = node_pairs(elements)
    each = F.sequence(F.lit(0), F.lit(dofs - 1))
    pairs = pairs.withColumn("i", F.explode(each)).withColumn("j", F.explode(each))
    return pairs.select((F.col("a") * dofs + F.col("i")).alias("row"), (F.col("b") * dofs + F.col("j")).alias("col"))


def term_pattern(dep: DataFrame) -> DataFrame:
    """row, col of unknowns that meet in a term of dep(term_id, dof); terms with equal sets count once."""
    unique = dep.distinct()
    marks = unique.groupBy("term_id").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("dof")).alias("x"), F.sum(F.xxhash64("dof", F.lit(1)).cast("decimal(38,0)")).alias("s"))
    first = marks.groupBy("n", "x", "s").agg(F.min("term_id").alias("term_id")).select("term_id")
    kept = unique.join(first, "term_id", "left_semi")
    half = kept.withColumnRenamed("dof", "row").join(kept.withColumnRenamed("dof", "col"), "term_id").filter("row <= col").select("row", "col")
    return both_ways(once(half), "row", "col")


def asymmetric(pattern: DataFrame) -> DataFrame:
    """The entries whose mirror image is missing: an entry and its image meet by their smaller and larger end, in one pass."""
    up, down = F.coalesce(F.col("row") <= F.col("col"), F.lit(True)), F.coalesce(F.col("row") >= F.col("col"), F.lit(False))
    ends = pattern.select(F.when(up, F.col("row")).otherwise(F.col("col")).alias("_low"), F.when(up, F.col("col")).otherwise(F.col("row")).alias("_high"), up.cast("long").alias("_up"), down.cast("long").alias("_down"))
    seen = dealt(ends, "_low", "_high").groupBy("_low", "_high").agg(F.sum("_up").alias("_up"), F.sum("_down").alias("_down")).filter("_up = 0 OR _down = 0")
    each = F.array_repeat(F.struct(F.when(F.col("_up") > 0, F.col("_low")).otherwise(F.col("_high")).alias("row"), F.when(F.col("_up") > 0, F.col("_high")).otherwise(F.col("_low")).alias("col")), (F.col("_up") + F.col("_down")).cast("int"))
    return seen.select(F.inline(each))


def matvec(coo: DataFrame, x: DataFrame) -> DataFrame:
    """row, v of the product with x(dof, v); rows without entries are absent."""
    x = x.select(F.col("dof").alias("col"), F.col("v").alias("_x"))
    return coo.join(x, "col").groupBy("row").agg(F.sum(F.col("v") * F.col("_x")).alias("v"))


def to_csr(coo: DataFrame) -> DataFrame:
    """row, cols, vals of every row with entries, by rising column; a row's entries must fit in one record."""
    rows = coo.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "v"))).alias("_e"))
    return rows.select("row", F.col("_e.col").alias("cols"), F.col("_e.v").alias("vals"))


def to_coo(csr: DataFrame) -> DataFrame:
    return csr.select("row", F.explode(F.arrays_zip("cols", "vals")).alias("_e")).select("row", F.col("_e.cols").alias("col"), F.col("_e.vals").alias("v"))


def to_dense_rows(csr: DataFrame, n: int, most: int = 100_000) -> DataFrame:
    """row, vals of all n columns, zeros filled in; refused over `most` columns."""
    if n > most:
        raise ValueError(f"{n} columns are too many for dense rows")
    return csr.select("row", _filled(F.lit(n)).alias("vals"))


def _filled(n: Column) -> Column:
    """n values from rising `cols` and their `vals`, zeros between them."""
    gap = lambda c, i: c - F.when(i > 0, F.get("cols", i - 1)).otherwise(F.lit(-1)) - 1
    zeros = lambda k: F.array_repeat(F.lit(0.0), k.cast("int"))
    filled = F.flatten(F.transform("cols", lambda c, i: F.concat(zeros(gap(c, i)), F.array(F.get("vals", i)))))
    return F.concat(filled, zeros(n - 1 - F.element_at("cols", -1)))


def dense_tiles(coo: DataFrame, n: int, width: int = 256) -> DataFrame:
    """row, tile, vals: the dense rows of n columns in tiles of `width`, zeros filled in; a tile without an entry is all zero and not made.

    A record holds one tile, however long the rows are.
    """
    tiles = coo.groupBy("row", F.expr(f"col div {width}").alias("tile")).agg(F.array_sort(F.collect_list(F.struct((F.col("col") % width).alias("col"), "v"))).alias("_e"))
    tiles = tiles.select("row", "tile", F.col("_e.col").alias("cols"), F.col("_e.v").alias("vals"))
    return tiles.select("row", "tile", _filled(F.least(F.lit(width), F.lit(n) - F.col("tile") * width)).alias("vals"))


def write_sorted(coo: DataFrame, path: str, key: str = "row") -> None:
    """A sink: Parquet in ranges of the key, sorted within, so that readers of some rows skip the other files."""
    coo.repartitionByRange(key).sortWithinPartitions(*[c for c in ("row", "col") if c in coo.columns] or [key]).write.parquet(path)


def sorted_pattern(pattern: DataFrame) -> DataFrame:
    """The entries once each, in ranges of rows, by rising row and column within."""
    return pattern.select("row", "col").distinct().repartitionByRange("row").sortWithinPartitions("row", "col")


def union_patterns(*patterns: DataFrame) -> DataFrame:
    out = patterns[0].select("row", "col")
    for p in patterns[1:]:
        out = out.unionByName(p.select("row", "col"))
    return out.distinct()


def missing_entries(a: DataFrame, b: DataFrame) -> DataFrame:
    """The entries of b that a lacks; a contains b if there are none. Entries of both meet in one pass."""
    marked = a.select("row", "col", F.lit(True).alias("_a")).unionByName(b.select("row", "col", F.lit(False).alias("_a")))
    seen = dealt(marked, "row", "col").groupBy("row", "col").agg(F.bool_or("_a").alias("_in_a"), F.bool_and("_a").alias("_only_a"))
    return seen.filter("NOT _only_a AND (NOT _in_a OR row IS NULL OR col IS NULL)").select("row", "col")


def split_pattern(dep: DataFrame, split: int) -> DataFrame:
    """row, col of trial unknowns (under split, columns) and test unknowns (from split on, rows less split) that meet in a term."""
    unique = dep.select("term_id", "dof").distinct()
    trial = unique.filter(F.col("dof") < split).withColumnRenamed("dof", "col")
    test = unique.filter(F.col("dof") >= split).select("term_id", (F.col("dof") - split).alias("row"))
    return test.join(trial, "term_id").select("row", "col").distinct()


def layout_pattern(elements: DataFrame, fields: list[tuple[int, int, int]], others: list[tuple[int, int]]) -> DataFrame:
    """row, col of a packed state: nodal fields (base, stride, components) couple within elements, other unknowns (first, count) with themselves alone."""
    pairs = node_pairs(elements)
    at = F.array(*(F.struct(F.lit(base + c).alias("base"), F.lit(stride).alias("stride")) for base, stride, n in fields for c in range(n)))
    pairs = pairs.withColumn("i", F.explode(at)).withColumn("j", F.explode(at))
    out = pairs.select((F.col("a") * F.col("i.stride") + F.col("i.base")).alias("row"), (F.col("b") * F.col("j.stride") + F.col("j.base")).alias("col"))
    for first, count in others:
        alone = elements.sparkSession.range(first, first + count)
        out = out.unionByName(alone.select(F.col("id").alias("row"), F.col("id").alias("col")))
    return out


def scatter_add(contributions: DataFrame) -> DataFrame:
    """dof, v: the sum of contributions(dof, v); null and negative unknowns are dropped."""
    return contributions.filter("dof >= 0").groupBy("dof").agg(F.sum("v").alias("v"))


def assemble_matrix(contributions: DataFrame) -> DataFrame:
    """row, col, v: the sum of contributions; entries of null or negative rows or columns are dropped."""
    return contributions.filter("row >= 0 AND col >= 0").groupBy("row", "col").agg(F.sum("v").alias("v"))


def row_neighbours(pattern: DataFrame) -> DataFrame:
    """u, v: columns that meet in a row, both ways, each pair once: the graph that a colouring must respect.

    Its size is the sum of the squared row lengths before repeats are merged; dense rows must be kept out.
    """
    return both_ways(_neighbours(pattern), "u", "v")


def _neighbours(pattern: DataFrame) -> DataFrame:
    """u, v: the pairs of row_neighbours() with u < v alone."""
    p = once(pattern.select("row", "col"), "row")
    return once(p.withColumnRenamed("col", "u").join(p.withColumnRenamed("col", "v"), "row").filter("u < v").select("u", "v"))


def degree_order(pattern: DataFrame) -> DataFrame:
    """dof, degree, place: columns by falling number of neighbours, ties by falling dof."""
    return _degree_order(pattern.select(F.col("col").alias("dof")).distinct(), row_neighbours(pattern))


def _degree_order(every: DataFrame, graph: DataFrame) -> DataFrame:
    degree = every.join(graph.groupBy(F.col("u").alias("dof")).agg(F.count("*").alias("degree")), "dof", "left")
    degree = degree.select("dof", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
    counts = degree.groupBy("degree").agg(F.count("*").alias("_n"))  # a row for each degree
    before = F.coalesce(F.sum("_n").over(W.orderBy(F.desc("degree")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = positions(degree.withColumn("_back", -F.col("dof")), "_back", "_rank", by=("degree",))
    return ranked.join(counts.select("degree", before.alias("_before")), "degree").select("dof", "degree", (F.col("_before") + F.col("_rank")).cast("long").alias("place"))


def colour(pattern: DataFrame, spread: int = 16, most_rounds: int = 200) -> DataFrame:
    """dof, color of the columns: two that meet in a row differ.

    The columns are dealt into classes by hash, so many that a column has about `spread` neighbours in its own, and in
    each round a class joins the columns without a colour. It takes the colours of its neighbours that have one, and its edges to those that
    have none; so an edge is moved once when its later end joins, and again only while both ends are open. In each round every
    open column proposes one of the `spread` smallest colours that no neighbour has, by hash; where neighbours propose the same, the one of the
    larger hash keeps it. The largest hash always does, so rounds end; after the last class their number is logarithmic on
    bounded degrees. Edges and rounds are written to the shared folder. Reruns give the same colours.
    """
    bucket = lambda c: F.pmod(F.xxhash64(c, F.lit(-2)), F.lit(CLASSES)).cast("int")
    first = F.when(bucket("u") <= bucket("v"), F.struct(F.col("u").alias("early"), F.col("v").alias("late"))).otherwise(F.struct(F.col("v").alias("early"), F.col("u").alias("late")))
    edges = written(_neighbours(pattern).select(F.inline(F.array(first))).withColumn("bucket", bucket("late")), "edges", by=("bucket",))
    every = written(pattern.select(F.col("col").alias("dof")).distinct().withColumn("bucket", bucket("dof")), "columns")
    classes = min(max(-(-2 * edges.count() // max(every.count() * spread, 1)), 1), CLASSES)
    nothing = F.array().cast("array<int>")
    left = open_ = kept = held = None
    rounds = []
    for number in range(most_rounds):
        if number < classes:
            mine = lambda df: df.filter(f"bucket * {classes} div {CLASSES} = {number}").drop("bucket")  # noqa: B023, E731
            fresh, met, reached = mine(every).withColumn("_taken", nothing), mine(edges), None
            if rounds:
                reached = written(met.join(_coloured(rounds).withColumnRenamed("dof", "early"), "early", "left"), "reached")
                taken = reached.filter("color IS NOT NULL").groupBy(F.col("late").alias("dof")).agg(F.collect_set("color").alias("_seen"))
                fresh = fresh.join(taken, "dof", "left").select("dof", F.coalesce("_seen", nothing).alias("_taken"))
                met = reached.filter("color IS NULL")
            met = both_ways(met, "early", "late").toDF("u", "v")
            left, open_ = (fresh, met) if left is None else (left.unionByName(fresh), open_.unionByName(met))
        left, open_ = written(left, "left", kept), written(open_, "open", held)
        if number < classes and reached is not None:
            deleted(reached)
        kept, held = left, open_
        room = F.array_except(F.sequence(F.lit(0), F.size("_taken") + spread - 1), F.col("_taken"))
        tries = left.select("dof", "_taken", F.get(room, F.pmod(F.xxhash64("dof", F.lit(number)), F.lit(spread)).cast("int")).alias("color"))
        mark = F.xxhash64("dof", F.lit(-1))
        both = open_.join(tries.select(F.col("dof").alias("u"), F.col("color").alias("cu"), mark.alias("hu")), "u")
        both = both.join(tries.select(F.col("dof").alias("v"), F.col("color").alias("cv"), mark.alias("hv")), "v")
        beaten = both.filter("cu = cv AND (hu < hv OR (hu = hv AND u < v))").select(F.col("u").alias("dof")).distinct().withColumn("_lost", F.lit(True))
        rounds.append(written(tries.join(beaten, "dof", "left").withColumn("_lost", F.coalesce("_lost", F.lit(False))), "round"))
        lost, new = rounds[-1].filter("_lost").select("dof", "_taken"), _coloured(rounds[-1:])
        if number >= classes - 1 and lost.isEmpty():
            break
        still = open_.join(lost.select(F.col("dof").alias("u")), "u", "left_semi")  # edges of columns that are open
        seen = still.join(new.withColumnRenamed("dof", "v"), "v").groupBy(F.col("u").alias("dof")).agg(F.collect_set("color").alias("_new"))
        left = lost.join(seen, "dof", "left").select("dof", F.array_union("_taken", F.coalesce("_new", nothing)).alias("_taken"))
        open_ = still.join(lost.select(F.col("dof").alias("v")), "v", "left_semi").select("u", "v")
    else:
        raise RuntimeError("no colouring within the rounds allowed")
    done = written(_coloured(rounds), "colors")
    deleted(edges, every, left, open_, *rounds)
    return done


def _coloured(rounds: list[DataFrame]) -> DataFrame:
    """dof, color of the columns that kept what they proposed."""
    return together(rounds).filter("NOT _lost").select("dof", "color")


def colour_in_order(pattern: DataFrame, order: str = "index", block: int | None = None) -> DataFrame:
    """dof, color of the columns, each the least that no neighbour before it in the order has: the colours of the sequential greedy.

    order: "index" is by rising dof, "degree" by falling number of neighbours and then by falling dof. The
    order is cut into blocks of `block` consecutive columns, or else of about BLOCK columns and neighbours before them, so that a
    block fits a task. The greedy is sequential: block after block, a task colours its columns one after the
    other, from the colours of its neighbours in the blocks before. A round reads its own block and those that
    these neighbours are in, and writes its own colours, no others.
    """
    if order not in ("index", "degree"):
        raise ValueError("order is index or degree")
    graph = written(row_neighbours(pattern), "graph")
    every = pattern.select(F.col("col").alias("dof")).distinct()
    places = written((positions(every, "dof", "place") if order == "index" else _degree_order(every, graph)).select("dof", "place"), "places")
    before = graph.join(places.select(F.col("dof").alias("u"), "place"), "u").join(places.select(F.col("dof").alias("v"), F.col("place").alias("_p")), "v").filter("_p < place")
    before = written(before.select("place", F.col("v").alias("before"), "_p"), "before")
    if block:
        blocks = places.withColumn("block", F.expr(f"place div {block}"))
    else:
        starts = row_pointer(before.select(F.col("place").alias("row")), places.count())
        blocks = places.join(starts.withColumnRenamed("row", "place"), "place").select("dof", "place", F.expr(f"(ptr + place) div {BLOCK}").alias("block"))
    waiting = blocks.join(before, "place", "left").select("block", "place", "dof", "before", "_p")
    waiting = written(waiting.repartitionByRange("block").sortWithinPartitions("block"), "waiting")
    deleted(graph, before)

    def run(table: pa.Table) -> pa.Table:
        place = table.column("place").to_numpy()
        rows = table.take(pa.array(np.argsort(place, kind="stable")))
        found: dict[int, int] = {}
        taken: set[int] = set()
        dof = None
        least = lambda: next(c for c in range(len(taken) + 1) if c not in taken)
        for own, v, color in zip(*(rows.column(c).to_pylist() for c in ("dof", "before", "color")), strict=True):
            if own != dof:
                if dof is not None:
                    found[dof] = least()
                dof, taken = own, set()
            if v is not None:
                taken.add(found[v] if color is None else color)
        if dof is not None:
            found[dof] = least()
        return pa.table({"dof": pa.array(found.keys(), pa.int64()), "color": pa.array(found.values(), pa.int32())})

    spans = waiting.groupBy("block").agg(F.min("place").alias("first"), F.min("_p").alias("least")).orderBy("block").collect()  # a row for each block
    firsts, done = [r["first"] for r in spans], []
    for k, span in enumerate(spans):
        mine = waiting.filter(F.col("block") == span["block"])
        needed = [] if span["least"] is None else done[bisect_right(firsts, span["least"]) - 1 : k]
        if needed:
            mine = mine.join(together(needed).withColumnRenamed("dof", "before"), "before", "left")
        else:
            mine = mine.withColumn("color", F.lit(None).cast("int"))
        done.append(written(mine.select("block", "place", "dof", "before", "color").groupBy("block").applyInArrow(run, "dof long, color int"), "colors"))
    none = places.limit(0).select("dof", F.lit(0).alias("color"))
    deleted(waiting, *((places,) if done else ()))
    return together(done) if done else none


def colour_conflicts(pattern: DataFrame, colors: DataFrame) -> DataFrame:
    """row, color, n: colours that a row sees more than once; none in a sound colouring."""
    seen = pattern.select("row", "col").distinct().join(colors.withColumnRenamed("dof", "col"), "col")
    return seen.groupBy("row", "color").agg(F.count("*").alias("n")).filter("n > 1")


def seeds(colors: DataFrame) -> DataFrame:
    """dof, color, v: one vector of ones for each colour, without its zeros."""
    return colors.select("dof", "color", F.lit(1.0).alias("v"))


def compress(coo: DataFrame, colors: DataFrame) -> DataFrame:
    """row, color, v: the matrix times the seeds."""
    return coo.join(colors.withColumnRenamed("dof", "col"), "col").groupBy("row", "color").agg(F.sum("v").alias("v"))


def decompress(pattern: DataFrame, colors: DataFrame, compressed: DataFrame) -> DataFrame:
    """row, col, v: each entry of the pattern from its row and its column's colour, 0 where there is none."""
    at = pattern.select("row", "col").join(colors.withColumnRenamed("dof", "col"), "col")
    return at.join(compressed, ["row", "color"], "left").select("row", "col", F.coalesce("v", F.lit(0.0)).alias("v"))


def _tiles(coo: DataFrame, places: DataFrame, tasks: int) -> DataFrame:
    """tile, up, rows(at, e(c, v)): the entries of each block of TILE columns and TILE rows in one record, rows numbered by places(dof, at), columns within the tile; in `tasks` partitions by tile."""
    for end in ("row", "col"):
        coo = coo.join(places.select(F.col("dof").alias(end), F.col("at").alias(f"_{end}")), end)
    cells = coo.select(F.expr(f"_col div {TILE}").alias("tile"), F.col("_row").alias("at"), F.struct((F.col("_col") % TILE).cast("int").alias("c"), "v").alias("e"))
    rows = cells.repartition(tasks, "tile").groupBy("tile", "at").agg(F.collect_list("e").alias("e"))
    return rows.groupBy("tile", F.expr(f"at div {TILE}").alias("up")).agg(F.collect_list(F.struct("at", "e")).alias("rows"))


def solve_cg(coo: DataFrame, rhs: DataFrame, tol: float = 1e-10, most: int = 500) -> DataFrame:
    """dof, x of coo x = rhs(dof, v), by conjugate gradients scaled by the diagonal; coo symmetric and positive.

    v is a number, or an array of as many components everywhere: then all are solved in one pass, each
    with steps and an end of its own, and x is an array. Unknowns are the matrix's rows; one that rhs doesn't name has 0 there.
    A component stops at a residual of tol times its first. Two sums for each component go to the driver in an iteration;
    the vectors are written to the shared folder and replace those before, so that lineage stays short and a lost executor costs one iteration.
    Unknowns are numbered and the matrix is cut into tiles of TILE by TILE, which are dealt by their columns once and kept there; an
    iteration moves the vectors to the tiles and a sum for each tile and row, never the matrix.
    Errors: a row without a positive diagonal, a load on an unknown without a row, a matrix that turns
    out not to be positive, and no convergence within `most` iterations.
    """
    coo = written(coo, "matrix")
    many = isinstance(rhs.schema["v"].dataType, ArrayType)
    load = written(rhs.select("dof", F.col("v") if many else F.array("v").alias("v")).filter("dof IS NOT NULL"), "load")
    low, high = load.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if low != high:
        raise ValueError(f"loads of {low} and of {high} components")
    each = range(high or (0 if many else 1))
    diagonal = coo.groupBy(F.col("row").alias("dof")).agg(F.sum(F.when(F.col("row") == F.col("col"), F.col("v"))).alias("d"))
    if not diagonal.filter("d IS NULL OR d <= 0").isEmpty():
        raise ValueError("a row without a positive diagonal")
    if not load.join(diagonal, "dof", "left_anti").isEmpty():
        raise ValueError("a load on an unknown that has no row")
    places = written(positions(diagonal, "dof", "at"), "places")
    tasks = max(min(-(-places.count() // TILE), int(coo.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 1)
    tiles = _tiles(coo, places, tasks).persist()
    zeros = F.array(*(F.lit(0.0) for _ in each)).cast("array<double>")
    vector = lambda cs: F.array(*cs).cast("array<double>")
    state = places.join(load, "dof", "left").select("dof", "at", zeros.alias("x"), F.coalesce("v", zeros).alias("r"), "d")
    state = state.withColumn("p", F.transform("r", lambda r: r / F.col("d")))
    state = held = written(state, "state")
    deleted(load)
    total = lambda df, f: [v or 0.0 for v in df.agg(*(F.sum(f(c)) for c in each)).first()] if len(each) else []
    squares = lambda c: F.col("r")[c] * F.col("r")[c] / F.col("d")
    rz = first = total(state, squares)
    open_ = [not rz[c] <= tol * tol * first[c] for c in each]
    for _ in range(most):
        if not any(open_):
            break
        parts = state.select(F.expr(f"at div {TILE}").alias("tile"), "at", "p").repartition(tasks, "tile").groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("at", "p"))).alias("_b"))
        of_row = lambda e, c: F.aggregate(e, F.lit(0.0), lambda a, x: a + x["v"] * F.get(F.col("_b.p"), x["c"])[c])
        sums = tiles.join(parts, "tile").select(F.inline(F.transform("rows", lambda r: F.struct(r["at"].alias("at"), vector(of_row(r["e"], c) for c in each).alias("q")))))
        product = sums.groupBy("at").agg(vector(F.sum(F.col("q")[c]) for c in each).alias("q"))
        state = held = written(state.join(product, "at"), "state", held)
        pq = total(state, lambda c: F.col("p")[c] * F.col("q")[c])
        if any(o and not v > 0 for o, v in zip(open_, pq, strict=True)):
            raise ValueError("the matrix is not positive")
        a = [rz[c] / pq[c] if open_[c] else 0.0 for c in each]
        x, r = (vector(F.col(y)[c] + F.col(z)[c] * F.lit(sign * a[c]) for c in each) for y, z, sign in (("x", "p", 1), ("r", "q", -1)))
        state = state.select("dof", "at", x.alias("x"), r.alias("r"), "p", "d")
        new = total(state, squares)
        b = [new[c] / rz[c] if open_[c] else 0.0 for c in each]
        state = state.select("dof", "at", "x", "r", vector(F.col("r")[c] / F.col("d") + F.col("p")[c] * F.lit(b[c]) for c in each).alias("p"), "d")
        rz = new
        open_ = [o and not rz[c] <= tol * tol * first[c] for c, o in zip(each, open_, strict=True)]
    if any(open_):
        raise RuntimeError(f"no convergence within {most} iterations: components {[c for c in each if open_[c]]}")
    tiles.unpersist()
    deleted(coo, places)
    return state.select("dof", F.col("x") if many else F.col("x")[0].alias("x"))
