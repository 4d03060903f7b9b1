"""Tables between the steps of one operator, in the folder that all executors share.

A step that is read more than once, or that ends a loop's lineage, is written as Parquet under
``spark.checkpoint.dir`` and read again, so a lost executor costs a re-read and never a re-run.
Operators release the tables that their result doesn't read; those that it does read are deleted at the
end of the ``scope`` that they were made in, or else with the application.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder by application, for local sessions that name none (tests on one machine).
_own_folders: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Folders that go with their application, and the paths made in each open scope.
_passing: set[str] = set()
_scopes: list[list[str]] = []
#: Bytes, as a table's files have them, of one range of rows in order; most ranges.
RANGE_BYTES, MOST_RANGES = 64 << 20, 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one, but only if all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir names no folder: executors need one that all of them share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="forgeframe-")
    return _own_folders[app]


def _place(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own folder of the shared one, which is deleted when the application ends."""
    folder = f"{shared_dir(spark)}/forgeframe/{spark.sparkContext.applicationId}"
    if folder not in _passing:
        _passing.add(folder)
        system, place = _place(spark, folder)
        system.mkdirs(place)
        system.deleteOnExit(place)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    for paths in _scopes:
        paths.append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes all tables that are staged inside it at its end, also those that results read: write these inside."""
    _scopes.append(paths := [])
    try:
        yield
    finally:
        _scopes.remove(paths)
        for path in paths:
            system, place = _place(spark, path)
            system.delete(place, True)


def ranges(df: DataFrame) -> int:
    """How many ranges to deal the rows of ``df``, a table as it is read, to: the session's number of shuffle partitions, or more where its files' bytes need more."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_RANGES, size // RANGE_BYTES))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened where ``df`` has such columns of its own."""
    own, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in own:
            name += "_"
        out.append(name)
    return out


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: same rows, no lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])).parquet(path)
    _paths[out] = path
    return out


def with_row_ids(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a column ``name`` (long) that tells its rows apart, in the order of doc_id.

    That is doc_id itself, unless ids are null or repeat: then the rows are numbered, nulls last, in a
    staged copy, as a number is only stable once it is written.
    """
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if again.isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    nth = free_names(docs.withColumn(name, F.lit(0)), "nth")[0]
    order = [F.col("doc_id").asc_nulls_last(), F.col(nth)]
    ordered = docs.withColumn(nth, F.monotonically_increasing_id()).repartitionByRange(ranges(docs), *order).sortWithinPartitions(*order)
    return staged(ordered.withColumn(name, F.monotonically_increasing_id()).drop(nth), "numbered")


def release(*tables: DataFrame) -> None:
    """Deletes the files of staged ``tables``; nothing may read them, or frames made from them, any more."""
    for df in tables:
        path = _paths.pop(df, None)
        if path is not None:
            system, place = _place(df.sparkSession, path)
            system.delete(place, True)
