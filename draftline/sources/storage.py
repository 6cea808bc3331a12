"""Reliable storage of intermediate tables."""

from __future__ import annotations

import atexit
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """A folder of this application below the shared one named by `spark.checkpoint.dir`.

    Where that is unset, as in tests, it lies below the session's warehouse, which executors share,
    too. The folder is deleted when the Python process ends.
    """
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    folder = f"{shared.rstrip('/')}/draftline-{context.applicationId}"
    if folder not in _folders:
        _folders.append(folder)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


_folders: list[str] = []
_stored: dict[tuple, str] = {}


@atexit.register
def drop_stored() -> None:
    """Delete what this process has stored; tables read back from it can no longer be used."""
    from pyspark import SparkContext

    jvm = SparkContext._jvm
    if jvm is None:
        return
    while _folders:
        path = jvm.org.apache.hadoop.fs.Path(_folders.pop())
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
    _stored.clear()


def input_files(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files below a path: changes when the files do."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(folder, True)
    files = []
    while found.hasNext():
        file = found.next()
        files.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
    return tuple(sorted(files))


def stored_once(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from the file or folder `source`, as Parquet in the checkpoint folder.

    Written once per session and state of the source. Reading it back gives column pruning and filter
    pushdown, and nothing is derived twice.
    """
    folder = checkpoint_folder(spark)
    key = (folder, input_files(spark, source), name)
    if key not in _stored:
        path = f"{folder}/{len(_stored)}-{name}"
        build().write.mode("overwrite").parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def spread(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """The same rows dealt evenly over tasks of about `rows`, in no order.

    A file of one row group is read by one task, and what is derived from it and stored would lie in one
    file of one row group again. Pass a stored table, of which counting reads no column, narrowed to what is needed.
    """
    parts = -(-df.count() // rows)
    return df.repartition(parts) if parts > 1 else df


def materialize(df: DataFrame) -> DataFrame:
    """Compute once, store in the shared folder and forget the lineage; survives lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
