"""Profiling: schema, null rates, inventory, table summaries, metadata and fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import row_hash
from ..schema import DRAFT, SAMPLE_ROWS, DraftSchema
from .roles import with_role


def schema_table(df: DataFrame) -> DataFrame:
    """One row per column: position, name and type."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema, start=1)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")


def null_profile(df: DataFrame) -> DataFrame:
    """Null count and percent (two decimals, half to even) of every column, in a single scan."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(df.columns)])
    entry = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(field.name).alias("column"),
            F.lit(field.dataType.simpleString()).alias("type"),
            (F.col("_rows") - F.col(f"_{i}")).alias("null_count"),
            F.bround(F.lit(100.0) * (F.col("_rows") - F.col(f"_{i}")) / F.col("_rows"), 2).alias("null_percent"),
        )
        for i, field in enumerate(df.schema)
    ]
    return counts.select(F.inline(F.array(*entry)))


def column_inventory(df: DataFrame) -> DataFrame:
    """Null profile with the role of every column."""
    return with_role(null_profile(df))


def dtype_summary(df: DataFrame) -> DataFrame:
    """Type and missing count per column."""
    return null_profile(df).select("column", "type", F.col("null_count").alias("missing"))


def missing_cells(df: DataFrame) -> DataFrame:
    """NULL cells of the whole table, one row."""
    return null_profile(df).agg(F.sum("null_count").alias("missing_cells"))


#: Keys that one of Spark's bitmaps holds, and the rows per bitmap from which it is smaller than the keys.
_BITS, _ROWS_PER_BITMAP = 32_768, 256


def _are_dense(df: DataFrame, key: str) -> bool:
    """Whether integer keys lie close enough for bitmaps; otherwise one bitmap would hold few keys or one."""
    if not isinstance(df.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return False
    low, high, rows = df.agg(F.min(key), F.max(key), F.count(key)).first()
    return rows > 0 and (high - low) // _BITS <= rows // _ROWS_PER_BITMAP


def _bitmap_counts(df: DataFrame, key: str) -> DataFrame:
    """One row: all rows, different keys, and whether NULL is among them. Each task folds its rows into one
    bitmap per 32,768 neighbouring keys, so the shuffle carries bits instead of keys."""
    number = F.col(key).cast("bigint")
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(number))
    per_range = df.groupBy(F.bitmap_bucket_number(number).alias("_range")).agg(F.count("*").alias("_n"), bits.alias("_bits"))
    different = F.when(F.col("_range").isNull(), 0).otherwise(F.bitmap_count("_bits"))
    return per_range.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(different), F.lit(0)).cast("bigint").alias("different"),
        F.coalesce(F.max(F.col("_range").isNull().cast("int")), F.lit(0)).alias("null_key"),
    )


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first of their key, one row; NULL counts as one key.

    Integer keys that lie close together are counted in bitmaps, others by an exact distinct.
    """
    if _are_dense(df, key):
        counts = _bitmap_counts(df, key)
        return counts.select((F.col("rows") - F.col("different") - F.col("null_key")).cast("bigint").alias("repeated_keys"))
    per_key = df.groupBy(key).agg(F.count("*").alias("_n"))
    return per_key.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("repeated_keys"))


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    """Different keys without NULL, one row; in bitmaps where integer keys lie close together."""
    if _are_dense(df, key):
        return _bitmap_counts(df, key).select(F.col("different").alias("unique_key_count"))
    return df.select(key).distinct().agg(F.count(key).alias("unique_key_count"))


def _summary(df: DataFrame, schema: DraftSchema, *more: Column) -> DataFrame:
    """Keys are counted apart: beside them, every other counter would go through their shuffle."""
    time = F.col(schema.time)
    facts = df.agg(F.count("*").alias("row_count"), F.min(time).alias("min_time"), F.max(time).alias("max_time"), *more)
    facts = facts.withColumn("unique_key_count", distinct_keys(df, schema.key).scalar())
    rest = [c for c in facts.columns if c not in ("row_count", "unique_key_count")]
    return facts.select("row_count", "unique_key_count", *rest)


def table_summary(df: DataFrame, schema: DraftSchema = DRAFT) -> DataFrame:
    """Rows, distinct keys, first and last time."""
    return _summary(df, schema)


def sample_summary(df: DataFrame, schema: DraftSchema = DRAFT, decimals: int = 6) -> DataFrame:
    """Table summary and mean label."""
    return _summary(df, schema, F.bround(F.avg(F.col(schema.label).cast("int")), decimals).alias("label_rate"))


def overview(df: DataFrame, schema: DraftSchema = DRAFT) -> DataFrame:
    """Rows, columns, first and last time as (metric, value) text."""
    facts = df.agg(F.count("*").alias("n"), F.min(schema.time).alias("lo"), F.max(schema.time).alias("hi"))
    values: list[tuple[str, Column]] = [
        ("rows", F.col("n").cast("string")),
        ("columns", F.lit(str(len(df.columns)))),
        ("first_match", F.date_format("lo", "yyyy-MM-dd HH:mm:ss")),
        ("last_match", F.date_format("hi", "yyyy-MM-dd HH:mm:ss")),
    ]
    rows = [F.struct(F.lit(name).alias("metric"), value.alias("value")) for name, value in values]
    return facts.select(F.inline(F.array(*rows)))


def fingerprint(df: DataFrame) -> DataFrame:
    """Content fingerprint, one row: independent of row order, partitions and file layout."""
    number = F.conv(F.substring(row_hash(df.columns), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(number), F.lit(0)).cast("string").alias("hash_sum"))


def metadata_record(
    raw: DataFrame,
    sample: DataFrame,
    requested_rows: int = SAMPLE_ROWS,
    schema: DraftSchema = DRAFT,
) -> DataFrame:
    """One nested record about source, sample and selection rules."""
    stamp = "yyyy-MM-dd HH:mm:ss"
    source = table_summary(raw, schema).select(
        F.struct(
            F.col("row_count").alias("raw_rows"),
            F.col("unique_key_count").alias("raw_unique_matches"),
            F.date_format("min_time", stamp).alias("raw_date_min"),
            F.date_format("max_time", stamp).alias("raw_date_max"),
        ).alias("source")
    )
    content = fingerprint(sample).select("hash_sum")
    summary = sample_summary(sample, schema).withColumn("content_hash", content.scalar()).select(
        F.struct(
            F.lit(requested_rows).cast("bigint").alias("requested_rows"),
            F.col("row_count").alias("actual_rows"),
            F.col("unique_key_count").alias("unique_matches"),
            F.date_format("min_time", stamp).alias("date_min"),
            F.date_format("max_time", stamp).alias("date_max"),
            F.col("label_rate").alias(f"{schema.label}_rate"),
            F.col("content_hash"),
            F.array(*[F.lit(c) for c in sample.columns]).alias("columns"),
        ).alias("sample")
    )
    rules = F.struct(
        F.lit(f"newest row per {schema.key}").alias("deduplication"),
        F.lit("winner is a participant, version known, all picks named, positive and different").alias("eligibility"),
        F.lit(f"first {requested_rows} keys in MD5 order").alias("sampling"),
        F.lit(f"{schema.time}, then {schema.key}").alias("output_order"),
    )
    return source.withColumn("sample", summary.scalar()).withColumn("selection", rules)
