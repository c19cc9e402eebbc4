"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+`; bytes.split() splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, one of our own if all is on one machine (tests), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Folders of tables that materialize() wrote, by the identity of the table.
_FOLDERS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[back] = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete the folders of materialized tables that nothing reads any more."""
    for table in tables:
        if (path := _FOLDERS.pop(table, None)) is not None:
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def only(df: DataFrame, **cols: str) -> DataFrame:
    """df's named columns under new names, and nothing else: extra columns can't clash."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in cols.items()))


def row_hash(*cols: Column | str) -> Column:
    return F.xxhash64(*cols)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, nulls as empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_MUL = np.uint64(0x9E3779B97F4A7C15)
_OFF = np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64-bit integers."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """For every start of k consecutive elements, a 64-bit hash of their sequence (length n - k + 1)."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    n, out = len(h) - k + 1, np.full(len(h) - k + 1, _OFF)
    for j in range(k):
        out *= _MUL
        out += h[j : j + n]
    return mixed(out)


class Recent(dict):
    """A bounded cache: two generations, of which the older is dropped when the younger is full."""

    def __init__(self, make: Callable, most: int):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def load(self, keys: Iterable, make_all: Callable[[list], Iterable]) -> None:
        """Make many missing values in one call; afterwards each key of this batch is at hand."""
        missing = [k for k in keys if k not in self]
        if len(self) + len(missing) > self.most:
            self.old = dict(self)
            keep = {k: self[k] for k in keys if k in self}
            self.clear()
            self.update(keep)
        todo = []
        for k in missing:
            if (v := self.old.get(k)) is not None:
                self[k] = v
            else:
                todo.append(k)
        if todo:
            self.update(zip(todo, make_all(todo), strict=True))


_HELD: dict[str, Callable[[], None]] = {}


def holding(owner: str, clear: Callable[[], None] = lambda: None) -> None:
    """Called in tasks: drops the caches that other operators left in this Python worker, as workers are used again, and gives their memory back; clear will drop the owner's."""
    if [*_HELD] != [owner]:
        for name in [n for n in _HELD if n != owner]:
            _HELD.pop(name)()
        for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
            pool.release_unused()
        _HELD[owner] = clear


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 512) -> DataFrame:
    """fn on every Arrow batch, cut to slices of so many rows that long texts don't pile up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield fn(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """fn on the rows of each value of the integer keys, one group of a partition after the other: no task for a group, and only one is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
            new = np.zeros(batch.num_rows, bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            starts = [0, *np.flatnonzero(new).tolist()] if batch.num_rows else []
            done = []
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if (key := tuple(c[a] for c in columns)) != last:
                    if held:
                        done.append(fn(pa.Table.from_batches(held)))
                    held, last = [], key
                held.append(batch.slice(a, b - a))
            if done:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
        if held:
            yield from fn(pa.Table.from_batches(held)).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
