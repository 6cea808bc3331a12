"""Tables laid out for what is asked of them: by year, or in buckets of a key."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schema import DRAFT, DraftSchema
from .storage import checkpoint_folder

#: Partition column of tables stored by year.
YEAR = "_year"


def write_by_year(df: DataFrame, path: str, schema: DraftSchema = DRAFT, year: str = YEAR) -> None:
    """Parquet with one folder per year, rows in time order inside the files.

    Rows are dealt by ranges of time, so a year that holds most rows is written by many tasks, and a file
    covers a short period. Rows without a time go to a folder of their own.
    """
    dated = df.withColumn(year, F.year(schema.time))
    dated.repartitionByRange(year, schema.time).sortWithinPartitions(year, schema.time).write.partitionBy(year).parquet(path)


def read_by_year(spark: SparkSession, path: str, like: DataFrame, year: str = YEAR) -> DataFrame:
    """The table with its partition column; columns and types are those of `like`, so an empty one can be read, too."""
    return spark.read.schema(T.StructType([*like.schema.fields, T.StructField(year, T.IntegerType())])).parquet(path)


def write_bucketed(df: DataFrame, keys: Sequence[str], buckets: int, order: Sequence[str] = (), name: str = "bucketed") -> str:
    """Store in buckets of the keys, sorted by keys and `order`; the name of the table, which lies below
    `spark.checkpoint.dir` and is known to this session's catalog.

    The shuffle happens once, here: ranks per key and joins of tables with equally many buckets of the same
    keys read it without another one. A key with very many rows stays in one bucket, so reduce such keys
    first (`keep_latest` does it in the map tasks) or leave the table unbucketed.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys)  # one file per bucket
    writer = dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys, *order)
    writer.option("path", f"{checkpoint_folder(spark)}/{table}").saveAsTable(table)
    return table
