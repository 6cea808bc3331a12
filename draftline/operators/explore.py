"""Exploration: long picks, counts by time, version, pick and side, target balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..schema import DRAFT, DraftSchema
from .split import with_total_share


def picks_long(df: DataFrame, keep: Sequence[str] | None = None, schema: DraftSchema = DRAFT) -> DataFrame:
    """One row per pick from one scan: kept columns, ID, name, side and slot."""
    keep = list(keep) if keep is not None else [schema.key]
    cells = [
        F.struct(
            F.col(f"{side}_player_{slot}_{schema.item}_id").alias(f"{schema.item}_id"),
            F.col(f"{side}_player_{slot}_{schema.item}").alias(f"{schema.item}_name"),
            F.lit(side.title()).alias("side"),
            F.lit(slot).alias("slot"),
        )
        for side in schema.sides
        for slot in range(1, schema.slots + 1)
    ]
    return df.select(*keep, F.inline(F.array(*cells)))


def target_distribution(df: DataFrame, schema: DraftSchema = DRAFT) -> DataFrame:
    """Wins of the first and second side in fixed order, with shares; absent results count 0."""
    label = F.col(schema.label).cast("int")
    counts = df.agg(
        F.count("*").alias("_total"), F.count_if(label == 1).alias("_first"), F.count_if(label == 0).alias("_second")
    )
    first, second = (f"{side.title()} win" for side in schema.sides)
    rows = [
        F.struct(
            F.lit(position).alias("position"),
            F.lit(name).alias("result"),
            F.col(count).alias("matches"),
            (F.col(count).cast("double") / F.col("_total")).alias("share"),
        )
        for position, (name, count) in enumerate([(first, "_first"), (second, "_second")], start=1)
    ]
    return counts.select(F.inline(F.array(*rows)))


def majority_baseline(df: DataFrame, schema: DraftSchema = DRAFT) -> DataFrame:
    """Accuracy of always naming the more frequent result."""
    return target_distribution(df, schema).agg(F.max("share").alias("majority_baseline"))


def matches_by_year(df: DataFrame, schema: DraftSchema = DRAFT) -> DataFrame:
    year = F.year(schema.time).alias("year")
    return df.filter(F.col(schema.time).isNotNull()).groupBy(year).agg(F.count("*").alias("matches")).orderBy("year")


def _row_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("_total"))


def version_distribution(df: DataFrame, schema: DraftSchema = DRAFT) -> DataFrame:
    """Matches and table share per version; rows with a NULL ID or name form no group."""
    named = df.filter(F.col(schema.version).isNotNull() & F.col(schema.version_name).isNotNull())
    counts = named.groupBy(schema.version, schema.version_name).agg(F.count("*").alias("matches"))
    return with_total_share(counts, "matches", _row_total(df))


def version_count(df: DataFrame, schema: DraftSchema = DRAFT) -> DataFrame:
    return version_distribution(df, schema).agg(F.count("*").alias("versions"))


def top_by(counts: DataFrame, by: str, k: int, tie: Sequence[str]) -> DataFrame:
    """The k largest rows; ties by the given columns, ascending."""
    return counts.orderBy(F.col(by).desc(), *tie).limit(k)


def pick_frequency(df: DataFrame, schema: DraftSchema = DRAFT) -> DataFrame:
    """Picks per ID and name, and the share of matches they appear in.

    The share divides by matches, not picks.
    """
    item, name = f"{schema.item}_id", f"{schema.item}_name"
    named = picks_long(df, [], schema).filter(F.col(item).isNotNull() & F.col(name).isNotNull())
    counts = named.groupBy(item, name).agg(F.count("*").alias("picks"))
    return with_total_share(counts, "picks", _row_total(df), "match_share")


def top_picks(df: DataFrame, k: int = 20, schema: DraftSchema = DRAFT) -> DataFrame:
    return top_by(pick_frequency(df, schema), "picks", k, [f"{schema.item}_id"])


def side_frequency(df: DataFrame, k: int = 12, schema: DraftSchema = DRAFT) -> DataFrame:
    """Picks by name and side for the k most picked names."""
    name = f"{schema.item}_name"
    top = top_picks(df, k, schema).select(name)
    kept = picks_long(df, [], schema).join(F.broadcast(top), name, "left_semi")  # k rows
    return kept.groupBy(name, "side").agg(F.count("*").alias("picks"))


def first_rows(df: DataFrame, k: int, schema: DraftSchema = DRAFT) -> DataFrame:
    """Earliest k rows by time and key."""
    return df.orderBy(schema.time, schema.key).limit(k)


def encoded_example(train: DataFrame, schema: DraftSchema = DRAFT) -> DataFrame:
    """The earliest training row as one line per pick, with its signed code."""
    code = F.when(F.col("side") == schema.sides[0].title(), 1).otherwise(-1)
    picks = picks_long(first_rows(train, 1, schema), [schema.key], schema)
    return picks.withColumn("encoded_value", code)
