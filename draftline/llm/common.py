"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.storage import checkpoint_folder

#: Fixed value: what separates words in every contract of this subpackage.
SPACES = r"[\x20\x09-\x0D]+"


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Settings of the queries and the pipeline: rows hold whole texts, so batches for Python are kept
    small unless the session says otherwise; and workers that start in another folder find this package."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "1000")
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, paths]))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def store(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write once below `spark.checkpoint.dir` and read back: no stage is derived twice, and a
    lost executor costs no more than the tasks it ran."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*stored: DataFrame) -> None:
    """Delete tables of `store` that everything that reads them has been stored without."""
    for df in stored:
        files = df.inputFiles()
        if files:  # an empty table has none
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_row_key(docs: DataFrame) -> DataFrame:
    """Add _k1 and _k2, 128 bits of a row's content; only rows that are equal in all columns share them."""
    names = sorted(docs.columns)
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names]
    nulls = F.concat(*[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in names])
    return docs.withColumns({"_k1": F.xxhash64(*cells, nulls), "_k2": F.xxhash64(nulls, *reversed(cells), F.lit(1))})


def merged(df: DataFrame) -> DataFrame:
    """A side of a join that may have as many rows as the data: the join sorts and merges, nothing is broadcast.

    Spark sizes a table by the bytes of its files. Rows that `explode` adds, and what encoding and compression
    save, are missing there, so millions of rows may seem small enough to go through the driver.
    """
    return df.hint("merge")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """Words of a text; none for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def in_batches(function: Callable, rows: int = 512) -> Callable:
    """Adapt a function of one small record batch to `mapInArrow`, whatever batch size the session has."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield from function(batch.slice(at, rows))

    return run
