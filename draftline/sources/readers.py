"""Readers with explicit types, and the guard for missing sources."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schema import DRAFT, VERSION_STRUCT, DraftSchema, curated_struct, raw_struct


def require_sources(spark: SparkSession, paths: Iterable[str]) -> None:
    """Fail once, naming every path that cannot be found."""
    missing = []
    for path in paths:
        try:
            spark.read.text(path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in (error.getCondition() or str(error)):
                raise
            missing.append(path)
    if missing:
        raise FileNotFoundError("no data at: " + ", ".join(missing))


def _nanos_to_ntz(name: str) -> Column:
    """Epoch nanoseconds to a zone-free timestamp, independent of the session time zone."""
    return F.expr(
        "TIMESTAMP_NTZ '1970-01-01 00:00:00' + "
        f"make_dt_interval(0, 0, 0, CAST(`{name}` DIV 1000 AS DECIMAL(20, 0)) / 1000000)"
    )


def _nanosecond_columns(spark: SparkSession, paths: Iterable[str]) -> set[str]:
    """Columns of nanosecond timestamps, from the footer of one file; no data is read."""
    first = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(list(paths)).select("path").first()
    if first is None:
        return set()
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(first[0]), hadoop)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
    try:
        layout = reader.getFileMetaData().getSchema().toString()
    finally:
        reader.close()
    return set(re.findall(r"int64 (\S+) \(TIMESTAMP\(NANOS", layout))


def read_matches(spark: SparkSession, *paths: str, schema: DraftSchema = DRAFT) -> DataFrame:
    """Raw matches from Parquet, with every known time column and every nanosecond column as TIMESTAMP_NTZ.

    Microsecond files need no conversion and keep filter pushdown on time. Spark refuses nanosecond
    timestamps unless the session reads them as integers; only for files that have some is the session
    told so, and it stays told, as the setting also counts when the rows are read.
    """
    nanos = _nanosecond_columns(spark, paths)
    if nanos:
        spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    raw = spark.read.parquet(*paths)
    times = {f.name for f in raw_struct(schema) if isinstance(f.dataType, T.TimestampNTZType)}
    converted = {}
    for field in raw.schema:
        if field.name not in times | nanos or isinstance(field.dataType, T.TimestampNTZType):
            continue
        column = F.col(field.name)
        converted[field.name] = _nanos_to_ntz(field.name) if field.name in nanos else column.cast("timestamp_ntz")
    return raw.withColumns(converted) if converted else raw


def _csv_by_name(spark: SparkSession, path: str, known: T.StructType, needed: Iterable[str] = ()) -> DataFrame:
    """Headed CSV typed by column name, in any column order; unknown columns are text."""
    options = {"header": True, "quote": '"', "escape": '"', "mode": "FAILFAST"}
    header = spark.read.options(**options).csv(path).columns
    lacking = sorted(set(needed) - set(header))
    if lacking:
        raise ValueError(f"{path}: missing required columns {', '.join(lacking)}")
    types = {f.name: f.dataType for f in known}
    typed = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
    return spark.read.schema(typed).options(enforceSchema=False, **options).csv(path)


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """Version dimension: id, name and release time."""
    return _csv_by_name(spark, path, VERSION_STRUCT, ["id", "name"])


def read_curated(spark: SparkSession, path: str, schema: DraftSchema = DRAFT) -> DataFrame:
    """Curated matches from CSV; a value that does not parse fails the job."""
    return _csv_by_name(spark, path, curated_struct(schema), [schema.time])


FILE_POSITION = ("_file", "_block", "_row")


def with_file_position(df: DataFrame) -> DataFrame:
    """Add the place of every row in its source: file, start of the read block, row order in it.

    Files of a sorted export are named in order, so (file, block, row) is the export order.
    """
    file, block, row = FILE_POSITION
    return df.select(
        "*",
        F.col("_metadata.file_path").alias(file),
        F.col("_metadata.file_block_start").alias(block),
        F.monotonically_increasing_id().alias(row),
    )
