"""Chronological train / validation / test split."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..functions import share, split_label, split_rank
from ..sources.layout import YEAR
from ..schema import (
    DRAFT,
    SPLITS,
    TRAIN_AND_VALIDATION_SHARE,
    TRAIN_CUTOFF,
    TRAIN_SHARE,
    VALIDATION_CUTOFF,
    DraftSchema,
)
from .quality import require_columns
from .ranks import order_statistics


def _cutoffs(train: str | datetime, validation: str | datetime) -> tuple[str, str]:
    moments = [m if isinstance(m, datetime) else datetime.fromisoformat(m) for m in (train, validation)]
    if moments[0] >= moments[1]:
        raise ValueError("the train cutoff has to lie before the validation cutoff")
    return tuple(m.isoformat(sep=" ") for m in moments)


def chronological_split(
    df: DataFrame,
    train_cutoff: str | datetime = TRAIN_CUTOFF,
    validation_cutoff: str | datetime = VALIDATION_CUTOFF,
    schema: DraftSchema = DRAFT,
) -> DataFrame:
    """Add the split name by time; text times are parsed strictly, NULL times fail the job."""
    require_columns(df, [schema.time], "split input")
    first, second = _cutoffs(train_cutoff, validation_cutoff)
    if df.schema[schema.time].dataType.simpleString() != "timestamp_ntz":
        df = df.withColumn(schema.time, F.col(schema.time).cast("timestamp_ntz"))
    return df.withColumn(schema.split, split_label(F.col(schema.time), first, second))


def matches_between(
    df: DataFrame, first: str | datetime, last: str | datetime, schema: DraftSchema = DRAFT, year: str = YEAR
) -> DataFrame:
    """Rows from `first` to `last`, both included; rows without a time are outside.

    Of a table stored by year (`write_by_year`) only the years in question are listed and read; inside them,
    the limits on the time itself skip row groups.
    """
    moments = [m if isinstance(m, datetime) else datetime.fromisoformat(m) for m in (first, last)]
    if moments[0] > moments[1]:
        raise ValueError("the first moment lies after the last")
    limits = [F.lit(m.isoformat(sep=" ")).cast("timestamp_ntz") for m in moments]
    kept = df.filter(F.col(schema.time).between(*limits))
    if year in df.columns:
        kept = kept.filter(F.col(year).between(moments[0].year, moments[1].year)).drop(year)
    return kept


def of_split(df: DataFrame, name: str, schema: DraftSchema = DRAFT) -> DataFrame:
    """Rows of one split."""
    if name not in SPLITS:
        raise ValueError(f"unknown split {name!r}")
    return df.filter(F.col(schema.split) == name)


def split_boundaries(
    df: DataFrame,
    column: str = DRAFT.time,
    train: float = TRAIN_SHARE,
    train_and_validation: float = TRAIN_AND_VALIDATION_SHARE,
) -> DataFrame:
    """Exact candidate cutoffs for the given cumulative shares, one row."""
    return order_statistics(df, column, {"train_cutoff": train, "validation_cutoff": train_and_validation})


def with_total_share(counts: DataFrame, part: str, total: DataFrame | None = None, name: str = "share") -> DataFrame:
    """Add a count's share of the table: of its own total, or of a given one-cell table."""
    whole = total if total is not None else counts.agg(F.sum(part))
    return counts.withColumn(name, share(F.col(part), whole.scalar()))


def split_summary(df: DataFrame, schema: DraftSchema = DRAFT) -> DataFrame:
    """Rows, period, mean label and share of every split, in split order."""
    label = F.col(schema.label).cast("int") if schema.label in df.columns else F.lit(None).cast("int")
    counts = df.groupBy(schema.split).agg(
        F.count("*").alias("matches"),
        F.min(schema.time).alias("first_match"),
        F.max(schema.time).alias("last_match"),
        F.avg(label).alias("label_rate"),
    )
    return with_total_share(counts, "matches").orderBy(split_rank(schema.split))


def all_splits(df: DataFrame, per_split: DataFrame, fill: int | None = 0) -> DataFrame:
    """Exactly one row per split, in order; absent splits get `fill` (None leaves NULL)."""
    names = df.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    joined = names.join(per_split, "split", "left")  # three rows per side
    if fill is not None:
        joined = joined.fillna(fill)
    return joined.orderBy(split_rank())


def split_counts(df: DataFrame, schema: DraftSchema = DRAFT) -> DataFrame:
    """Rows per split; an absent split shows NULL."""
    counts = df.groupBy(F.col(schema.split).alias("split")).agg(F.count("*").alias("matches"))
    return all_splits(df, counts, fill=None)


def split_plan(df: DataFrame, schema: DraftSchema = DRAFT) -> DataFrame:
    """Summary of the split that the table's own 70 % and 85 % boundaries give."""
    cutoffs = split_boundaries(df, schema.time).first()
    proposed = chronological_split(df, cutoffs["train_cutoff"], cutoffs["validation_cutoff"], schema)
    return split_summary(proposed, schema).drop("label_rate")
