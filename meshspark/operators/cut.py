"""Written intermediate results of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the setting is missing, one of our own serves if all runs on one machine; else it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Folders of written tables, by the identity of the table.
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str, instead: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """df, written to the shared folder (in folders by the columns `by`, if given) and read back: cuts the lineage and survives lost executors. The table that it stands instead of is deleted."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[back] = path
    if instead is not None:
        deleted(instead)
    return back


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as it is if it is a written table, else written."""
    return df if df in _PATHS else written(df, name)


def together(tables: list[DataFrame]) -> DataFrame:
    """Written tables of one schema, read as one."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*(_PATHS[t] for t in tables))


def deleted(*tables: DataFrame) -> None:
    """Delete the folders of written tables that nothing reads any more."""
    for table in tables:
        if (path := _PATHS.pop(table, None)) is not None:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
