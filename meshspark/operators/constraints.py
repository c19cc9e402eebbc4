"""Full and reduced vectors under ordered constraints."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cut import written
from .matrices import dealt, matvec, once, positions


class Constraint:
    """An ordered affine rule: dof becomes the sum of weight times what its masters are at that moment, and an offset.

    A type of one's own gives rows() and offsets(); an unknown that it names in neither isn't touched.
    """

    def rows(self) -> DataFrame:
        """dof, master, weight"""
        raise NotImplementedError

    def offsets(self) -> DataFrame:
        """dof, value; unknowns that rows() names may be missing here (0)."""
        raise NotImplementedError

    def dofs(self) -> DataFrame:
        """dof, each once"""
        return self.rows().select("dof").unionByName(self.offsets().select("dof")).distinct()

    def lift(self, vec: DataFrame) -> DataFrame:
        return composed([self]).apply(vec)

    def adjoint(self, vec: DataFrame) -> DataFrame:
        """The transpose: what an unknown of the constraint has goes to its masters, and it keeps 0."""
        zero = self.dofs().withColumn("v", F.lit(0.0)).join(vec.select("dof"), "dof", "left_semi")
        return composed([self]).transpose(vec).unionByName(zero).groupBy("dof").agg(F.sum("v").alias("v"))


@dataclass(frozen=True)
class Fixed(Constraint):
    """table(dof, value): prescribed values."""

    table: DataFrame

    def rows(self) -> DataFrame:
        return self.table.select("dof", F.col("dof").alias("master"), F.lit(0.0).alias("weight")).limit(0)

    def offsets(self) -> DataFrame:
        return self.table.select("dof", F.col("value").cast("double").alias("value"))


@dataclass(frozen=True)
class Periodic(Constraint):
    """table(dof, master): dof repeats what its master is at that moment."""

    table: DataFrame

    def rows(self) -> DataFrame:
        return self.table.select("dof", "master", F.lit(1.0).alias("weight"))

    def offsets(self) -> DataFrame:
        return self.table.select("dof", F.lit(0.0).alias("value"))


@dataclass(frozen=True)
class Weighted(Constraint):
    """table(dof, master, weight): dof is the weighted sum of its masters, plus plus(dof, value) if given."""

    table: DataFrame
    plus: DataFrame | None = None

    def rows(self) -> DataFrame:
        return self.table.select("dof", "master", F.col("weight").cast("double").alias("weight"))

    def offsets(self) -> DataFrame:
        if self.plus is None:
            return self.table.select("dof").distinct().withColumn("value", F.lit(0.0))
        return self.plus.select("dof", F.col("value").cast("double").alias("value"))


@dataclass(frozen=True)
class Valued:
    """table(dof, key): values that are bound later, by key; default stands where none is given."""

    table: DataFrame
    default: float | None = None


Constraints = list[Constraint]


@dataclass(frozen=True)
class AffineMap:
    """What ordered constraints do to a full vector, as one sparse table(dof, source, weight) of the unknowns that they touch.

    Each touched unknown has one row with a null source, its offset; the others map to themselves and
    have no rows, so the table is as small as the constraints. Lift, adjoint, matrix and pattern all
    follow from it: y = A x + c, A'r, A'KA, and the structure of A.
    """

    table: DataFrame

    def kept(self) -> AffineMap:
        """The map with its table written to the shared folder, for several uses."""
        return AffineMap(written(self.table, "map"))

    def dofs(self) -> DataFrame:
        """dof: the unknowns touched."""
        return self._offsets().select("dof")

    def _offsets(self) -> DataFrame:
        return self.table.filter("source IS NULL").select("dof", F.col("weight").alias("_c"))

    def _weights(self) -> DataFrame:
        return self.table.filter("source IS NOT NULL")

    def apply(self, vec: DataFrame) -> DataFrame:
        """dof, v of A x + c; null values of sources count as 0, and so do sources that aren't there."""
        sums = self._weights().join(vec.select(F.col("dof").alias("source"), "v"), "source").groupBy("dof").agg(F.sum(F.col("weight") * F.col("v")).alias("_s"))
        touched = self._offsets().join(sums, "dof", "left").select("dof", (F.col("_c") + F.coalesce("_s", F.lit(0.0))).alias("_v"), F.lit(True).alias("_on"))
        return vec.join(touched, "dof", "left").select("dof", F.when(F.col("_on"), F.col("_v")).otherwise(F.col("v")).alias("v"))

    def transpose(self, vec: DataFrame) -> DataFrame:
        """dof, v of A' r; unknowns that get nothing are absent."""
        stay = vec.select("dof", "v").join(self._offsets(), "dof", "left_anti")
        moved = self._weights().join(vec.select("dof", "v"), "dof").select(F.col("source").alias("dof"), (F.col("weight") * F.col("v")).alias("v"))
        return stay.unionByName(moved).groupBy("dof").agg(F.sum("v").alias("v"))

    def to_free(self, free: DataFrame) -> DataFrame:
        """dof, reduced, weight: T, the columns of the free unknowns; unknowns that end at none have no rows."""
        stay = free.select("dof", "reduced", F.lit(1.0).alias("weight")).join(self._offsets(), "dof", "left_anti")
        touched = self._weights().join(free.select(F.col("dof").alias("source"), "reduced"), "source").filter("weight <> 0").select("dof", "reduced", "weight")
        return stay.unionByName(touched)


def composed(constraints: Constraints | AffineMap) -> AffineMap:
    """All constraints as one map: each is folded into what those before it have made of its masters, by a join as large as the constraints. A map stays as it is."""
    if isinstance(constraints, AffineMap):
        return constraints
    table = None
    for c in constraints:
        rows = c.rows().select("dof", "master", "weight")
        constant = c.offsets().select("dof", F.lit(None).cast("long").alias("source"), F.col("value").alias("weight"))
        if table is None:
            linear = rows.select("dof", F.col("master").cast("long").alias("source"), "weight")
        else:
            before = table.select(F.col("dof").alias("master"), F.col("source").alias("_source"), F.col("weight").alias("_weight"), F.lit(True).alias("_on"))
            linear = rows.join(before, "master", "left")
            linear = linear.select("dof", F.when(F.col("_on"), F.col("_source")).otherwise(F.col("master")).cast("long").alias("source"), (F.col("weight") * F.coalesce("_weight", F.lit(1.0))).alias("weight"))
        always = c.dofs().select("dof", F.lit(None).cast("long").alias("source"), F.lit(0.0).alias("weight"))
        new = linear.unionByName(constant).unionByName(always).groupBy("dof", "source").agg(F.sum("weight").alias("weight"))
        table = new if table is None else table.join(c.dofs(), "dof", "left_anti").unionByName(new)
    if table is None:
        raise ValueError("no constraints")
    return AffineMap(table)


def with_values(constraints: list, params: DataFrame) -> Constraints:
    """The constraints with params(key, value[, dof]) bound to those that wait for values.

    A row without a dof (or params without that column) is for all unknowns of its key, one with a dof for
    that unknown alone, before the former. A value that is given twice, one that nothing asks for, or an
    unknown without a value and a default is an error; the unknowns are not collected.
    """
    waiting = [c for c in constraints if isinstance(c, Valued)]
    if not waiting:
        return constraints
    given = params.select("key", F.col("value").cast("double").alias("value"), (F.col("dof") if "dof" in params.columns else F.lit(None)).cast("long").alias("dof"))
    asked = waiting[0].table.select("key", "dof")
    for c in waiting[1:]:
        asked = asked.unionByName(c.table.select("key", "dof"))
    twice = given.groupBy("key", "dof").agg(F.count("*").alias("n"), F.count("value").alias("m")).filter("n > 1 OR m = 0").select("key")
    unknown = given.join(asked.select("key").distinct(), "key", "left_anti").select("key")
    stray = given.filter("dof IS NOT NULL").join(asked, ["key", "dof"], "left_anti").select("key")
    every = given.filter("dof IS NULL").select("key", F.col("value").alias("_every"))
    each = given.filter("dof IS NOT NULL").select("key", "dof", F.col("value").alias("_each"))
    bound, bare = [], twice.unionByName(unknown).unionByName(stray)
    for c in constraints:
        if not isinstance(c, Valued):
            bound.append(c)
            continue
        table = c.table.join(every, "key", "left").join(each, ["key", "dof"], "left").select("key", "dof", F.coalesce("_each", "_every", F.lit(c.default).cast("double")).alias("value"))
        bare = bare.unionByName(table.filter("value IS NULL").select("key"))
        bound.append(Fixed(table.select("dof", "value")))
    if (bad := bare.first()) is not None:
        raise KeyError(f"value {bad['key']}: unknown, missing or given twice")
    return bound


def checked(constraints: Constraints, all_dofs: DataFrame) -> Constraints:
    """The constraints, or an error: an unknown twice in one of them (or with a master twice), a master or unknown that is not there, a null."""
    for c in constraints:
        rows, offsets = c.rows(), c.offsets()
        names = rows.select("dof").unionByName(rows.select(F.col("master").alias("dof"))).unionByName(offsets.select("dof"))
        keys = ["dof"] if isinstance(c, Periodic) else ["dof", "master"]
        twice = rows.groupBy(*keys).count().select("dof", "count").unionByName(offsets.groupBy("dof").count()).filter("count > 1 OR dof IS NULL")
        if not twice.isEmpty() or not names.join(all_dofs, "dof", "left_anti").isEmpty():
            raise ValueError("a constraint names an unknown twice, or one that is not there")
    return constraints


def constrained_dofs(constraints: Constraints | AffineMap) -> DataFrame:
    """dof: the union of what the constraints name."""
    if isinstance(constraints, AffineMap):
        return constraints.dofs()
    out = constraints[0].dofs()
    for c in constraints[1:]:
        out = out.unionByName(c.dofs())
    return out.distinct()


def free_dofs(all_dofs: DataFrame, constraints: Constraints | AffineMap) -> DataFrame:
    """dof, reduced: what no constraint names, numbered by rising dof."""
    free = all_dofs.select("dof")
    if constraints:
        free = free.join(constrained_dofs(constraints), "dof", "left_anti")
    return positions(free, "dof", "reduced")


def to_free(free: DataFrame, constraints: Constraints | AffineMap) -> DataFrame:
    """dof, reduced, weight: the composed map's columns of free unknowns."""
    return composed(constraints).to_free(free) if constraints else free.select("dof", "reduced", F.lit(1.0).alias("weight"))


def augment_pattern(pattern: DataFrame, constraints: Constraints) -> DataFrame:
    """row, col: masters get their dependents' rows and columns, constraint by constraint; the dependents keep theirs."""
    for c in constraints:
        to = c.rows().groupBy("dof").agg(F.collect_set("master").alias("_m"))  # the masters of one unknown
        for end in ("row", "col"):
            pattern = pattern.join(to.withColumnRenamed("dof", end), end, "left").withColumn(end, F.explode(F.array_union(F.array(end), F.coalesce("_m", F.array(end))))).drop("_m")
    return pattern.select("row", "col").distinct()


def reduce_pattern(pattern: DataFrame, free: DataFrame) -> DataFrame:
    """row, col in reduced numbers, free ones only."""
    for end in ("row", "col"):
        pattern = pattern.join(free.select(F.col("dof").alias(end), F.col("reduced").alias(f"_{end}")), end)
    return pattern.select(F.col("_row").alias("row"), F.col("_col").alias("col"))


def adapt_pattern(pattern: DataFrame, free: DataFrame, constraints: Constraints | AffineMap) -> DataFrame:
    """The pattern of the reduced matrix: both ends follow the composed map."""
    if not constraints:
        return once(reduce_pattern(pattern, free))
    return adapt_patterns(pattern, free, {"": constraints}).select("row", "col")


def adapt_patterns(pattern: DataFrame, free: DataFrame, maps: dict[str, Constraints | AffineMap]) -> DataFrame:
    """name, row, col: adapt_pattern() for each of several constraints with the same free unknowns, in one pass over the pattern."""
    seen = _numbered(_followed(pattern.select("row", "col"), maps), free)
    return _of_each(seen.groupBy("row", "col").agg(_seen()), list(maps)).select("name", "row", "col")


def lifted(fn: Callable[[DataFrame], DataFrame], free: DataFrame, constraints: Constraints, full: DataFrame, output: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """A job on full vectors as one on reduced vectors(reduced, v).

    output: None leaves what fn gives, "primal" picks the free values, "dual" applies the transposed
    constraints first. A reduced vector of another size than free is an error.
    """
    if output not in (None, "primal", "dual"):
        raise ValueError("output is None, primal or dual")

    def run(reduced: DataFrame) -> DataFrame:
        if not reduced.select("reduced").join(free, "reduced", "left_anti").isEmpty() or not free.join(reduced.select("reduced"), "reduced", "left_anti").isEmpty():
            raise ValueError("the reduced vector has not the free unknowns' size")
        out = fn(lift(reduced, full, free, constraints))
        return out if output is None else reduce(out, free) if output == "primal" else reduce_adjoint(out, free, constraints)

    return run


def lift(reduced: DataFrame, full: DataFrame, free: DataFrame, constraints: Constraints | AffineMap) -> DataFrame:
    """dof, v: the free values over a base vector, then the constraints in their order."""
    given = reduced.join(free, "reduced").select("dof", F.col("v").alias("_v"), F.lit(True).alias("_on"))
    vec = full.join(given, "dof", "left").select("dof", F.when(F.col("_on"), F.col("_v")).otherwise(F.col("v")).alias("v"))
    return composed(constraints).apply(vec) if constraints else vec


def reduce(full: DataFrame, free: DataFrame) -> DataFrame:
    """reduced, v: the free values."""
    return full.join(free, "dof").select("reduced", "v")


def reduce_adjoint(residual: DataFrame, free: DataFrame, constraints: Constraints | AffineMap) -> DataFrame:
    """reduced, v: the transposed constraints in reverse, then the free values; a free unknown that gets nothing has 0."""
    moved = composed(constraints).transpose(residual) if constraints else residual.select("dof", "v")
    return free.join(moved, "dof", "left").select("reduced", F.coalesce("v", F.lit(0.0)).alias("v"))


def reduce_matrix(coo: DataFrame, free: DataFrame, constraints: Constraints | AffineMap) -> DataFrame:
    """row, col, v of T'KT in reduced numbers: slaves' rows and columns go to their masters by weight, fixed ones are dropped.

    Entries, summed or not, meet the table of the composed map once for each end and are summed once.
    """
    if not constraints:
        return _numbered(coo.select("row", "col", "v"), free).groupBy("row", "col").agg(F.sum("v").alias("v"))
    return reduce_matrices(coo, free, {"": constraints}).select("row", "col", "v")


def reduce_matrices(coo: DataFrame, free: DataFrame, maps: dict[str, Constraints | AffineMap]) -> DataFrame:
    """name, row, col, v: reduce_matrix() for each of several constraints with the same free unknowns, in one pass over the entries.

    An entry that none of them touches moves once, whatever their number; the sums of each are columns of fixed width.
    """
    seen = _numbered(_followed(coo.select("row", "col", "v"), maps), free)
    sums = [F.sum(F.when(F.col("_map") == k, F.col("v"))).alias(f"_v{k}") for k in range(len(maps))]
    summed = seen.groupBy("row", "col").agg(_seen(), F.sum(F.when(F.col("_map").isNull(), F.col("v"))).alias("_v"), *sums)
    return _of_each(summed, list(maps), lambda k: F.coalesce(F.col("_v") + F.col(f"_v{k}"), "_v", f"_v{k}")).select("name", "row", "col", "v")


def _seen() -> Column:
    """The maps that an entry is in, as bits: the lowest for all of them, the next ones for each."""
    return F.bit_or(F.expr("if(_map IS NULL, 1L, shiftleft(2L, _map))")).alias("_in")


def _followed(entries: DataFrame, maps: dict[str, Constraints | AffineMap]) -> DataFrame:
    """Entries whose ends, still in full numbers, are sources, with v times the weights, and _map, the place of the map that made them; null for entries that no map touches, which stay one row.

    Of the maps only the tables are joined, as small as the constraints. An unknown that one map touches and another does not is its own source in the latter.
    """
    if len(maps) > 60:
        raise ValueError("more than 60 maps at once")
    tables = [composed(m).table.select("dof", "source", "weight", F.lit(k).alias("_k")) for k, m in enumerate(maps.values())]
    touched = tables[0]
    for t in tables[1:]:
        touched = touched.unionByName(t)
    touched = touched.filter("source IS NULL OR weight <> 0")
    if len(maps) > 1:
        touched = written(touched, "touched")
        every = F.array(*(F.lit(k) for k in range(len(maps))))
        lacking = touched.filter("source IS NULL").groupBy("dof").agg(F.collect_set("_k").alias("_ks")).select("dof", F.explode(F.array_except(every, "_ks")).alias("_k"))
        own = F.inline(F.array(F.struct(F.lit(None).cast("long").alias("source"), F.lit(0.0).alias("weight")), F.struct(F.col("dof").alias("source"), F.lit(1.0).alias("weight"))))
        touched = touched.unionByName(lacking.select("dof", "_k", own))
    touched = written(touched, "maps")  # read for both ends; its size is known when they are planned
    out = entries.withColumn("_map", F.lit(None).cast("int"))
    for end in ("row", "col"):
        to = touched.select(F.col("dof").alias("_dof"), F.col("source").alias("_source"), F.col("weight").alias("_weight"), "_k")
        meets = (F.col(end) == F.col("_dof")) & (F.col("_map").isNull() | (F.col("_map") == F.col("_k")))
        out = out.join(to, meets, "left").filter("_dof IS NULL OR _source IS NOT NULL")
        v = [(F.col("v") * F.coalesce("_weight", F.lit(1.0))).alias("v")] if "v" in entries.columns else []
        other = "col" if end == "row" else "row"
        out = out.select(F.coalesce("_source", end).alias(end), other, *v, F.coalesce("_map", "_k").alias("_map"))
    return out


def _numbered(entries: DataFrame, free: DataFrame) -> DataFrame:
    """Entries in reduced numbers, free ones only, dealt by row and column."""
    for end in ("row", "col"):
        entries = entries.join(free.select(F.col("dof").alias(end), F.col("reduced").alias("_n")).hint("merge"), end).drop(end).withColumnRenamed("_n", end)
    return dealt(entries, "row", "col")


def _of_each(seen: DataFrame, names: list[str], value: Callable[[int], Column] | None = None) -> DataFrame:
    """name, row, col[, v] of every map that an entry is in."""
    each = (F.struct(F.lit(name).alias("name"), F.expr(f"_in & {1 + (2 << k)}L <> 0").alias("_on"), *([value(k).alias("v")] if value else [])) for k, name in enumerate(names))
    return seen.select("row", "col", F.inline(F.array(*each))).filter("_on")


def reduce_system(coo: DataFrame, rhs: DataFrame, all_dofs: DataFrame, free: DataFrame, constraints: Constraints | AffineMap) -> tuple[DataFrame, DataFrame]:
    """T'KT and T'(f - K c) of K y = f under y = T x + c: row, col, v and reduced, v."""
    zero = all_dofs.select("dof", F.lit(0.0).alias("v"))
    held = composed(constraints).apply(zero).filter("v <> 0") if constraints else zero.limit(0)
    moved = matvec(coo, held).select(F.col("row").alias("dof"), (-F.col("v")).alias("v"))
    load = rhs.select("dof", "v").unionByName(moved).groupBy("dof").agg(F.sum("v").alias("v"))
    return reduce_matrix(coo, free, constraints), reduce_adjoint(load, free, constraints)
