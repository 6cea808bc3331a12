"""Guards and check tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import distinct_values, status
from ..schema import DRAFT, FORBIDDEN, SPLITS, DraftSchema
from .profile import repeated_keys
from .ranks import breaks_between, sequence_ends


def require_columns(df: DataFrame, columns: Iterable[str], context: str) -> None:
    """Fail with the sorted names of all absent columns."""
    absent = sorted(set(columns) - set(df.columns))
    if absent:
        raise ValueError(f"{context}: missing required columns {', '.join(absent)}")


def forbidden_features(features: Iterable[str], forbidden: Iterable[str] = FORBIDDEN) -> list[str]:
    """Feature names that may not be model inputs."""
    return sorted(set(features) & set(forbidden))


def drop_forbidden(df: DataFrame, forbidden: Iterable[str] = FORBIDDEN) -> DataFrame:
    return df.drop(*forbidden)


def check_table(facts: DataFrame, checks: Sequence[tuple], otherwise: str = "REVIEW") -> DataFrame:
    """Turn a one-row table of facts into check rows.

    A check is (name, passed) or (name, observed, expected, passed).
    """
    rows = []
    for position, check in enumerate(checks, start=1):
        name, passed = check[0], F.coalesce(check[-1], F.lit(False))
        fields = [F.lit(position).alias("position"), F.lit(name).alias("check")]
        if len(check) == 4:
            fields += [check[1].cast("string").alias("observed"), check[2].cast("string").alias("expected")]
        rows.append(F.struct(*fields, passed.alias("passed"), status(passed, otherwise).alias("status")))
    return facts.select(F.inline(F.array(*rows)))


def require_passed(checks: DataFrame, context: str) -> None:
    """Fail with the names of the checks that did not pass; a check table is a handful of rows."""
    failed = [r["check"] for r in checks.filter(~F.col("passed")).orderBy("position").collect()]
    if failed:
        raise ValueError(f"{context}: failed checks: {'; '.join(failed)}")


def all_passed(checks: DataFrame) -> DataFrame:
    return checks.agg(F.bool_and("passed").alias("all_passed"))


def dataset_facts(df: DataFrame, sequence: str, within: Sequence[str] = (), schema: DraftSchema = DRAFT) -> DataFrame:
    """The numbers behind the dataset checks, one row.

    One scan of all columns, and one of key, time and sequence: put in the same aggregate, the latter would
    drag every other counter through the shuffle of the keys. Where the key is the sequence, the order
    check's stored table holds one row per key and tells the repeated ones.
    """
    internal = {sequence, *within}
    columns = [c for c in df.columns if c not in internal or c in schema.curated_columns()]
    ids = schema.pick_ids()

    def total(cell: Column) -> Column:
        return F.coalesce(F.sum(cell), F.lit(0)).cast("bigint")

    per_row = df.agg(
        F.count("*").alias("rows"),
        total(sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))).alias("missing_cells"),
        F.count_if(F.col(schema.time).isNull()).alias("invalid_dates"),
        total(sum((F.coalesce(F.col(c) <= 0, F.lit(False)).cast("int") for c in ids), F.lit(0))).alias("non_positive_ids"),
        F.count_if(distinct_values(ids) != schema.picks_per_row).alias("rows_without_distinct_picks"),
        F.count_if(F.col(schema.label).cast("int") == 1).alias("label_true"),
        F.count_if(F.col(schema.label).cast("int") == 0).alias("label_false"),
        F.count_if(~F.col(schema.label).cast("int").isin(0, 1)).alias("label_other"),
    ).withColumn("columns", F.lit(len(columns)))
    ends = sequence_ends(df.select(*{schema.time: 0, sequence: 0, **dict.fromkeys(within, 0)}), schema.time, sequence, within)
    if sequence == schema.key and not within:
        keys = ends.agg(F.coalesce(F.sum(F.col("_rows") - 1), F.lit(0)).cast("bigint").alias("repeated_keys"))
    else:
        keys = repeated_keys(df.select(schema.key), schema.key)
    order = breaks_between(ends, sequence, within)
    return per_row.withColumns({"repeated_keys": keys.scalar(), "breaks": order.scalar()})


def dataset_checks(
    df: DataFrame,
    sequence: str,
    within: Sequence[str] = (),
    expected_rows: int | None = None,
    expected_columns: int | None = None,
    schema: DraftSchema = DRAFT,
) -> DataFrame:
    """Nine checks of a curated table; `sequence` (inside `within`) is its row order."""
    facts = dataset_facts(df, sequence, within, schema)
    zero = F.lit(0)

    def none(name: str, fact: str) -> tuple:
        return (name, F.col(fact), zero, F.col(fact) == 0)

    rows = F.lit(expected_rows) if expected_rows is not None else F.col("rows")
    columns = F.lit(expected_columns) if expected_columns is not None else F.col("columns")
    binary = (F.col("label_true") > 0) & (F.col("label_false") > 0) & (F.col("label_other") == 0)
    is_sorted = (F.col("breaks") == 0) & (F.col("invalid_dates") == 0)
    # The published labels of the checks.
    return check_table(
        facts,
        [
            ("Expected rows loaded", F.col("rows"), rows, F.col("rows") == rows),
            ("Expected columns loaded", F.col("columns"), columns, F.col("columns") == columns),
            none("Duplicate match IDs", "repeated_keys"),
            none("Missing cells", "missing_cells"),
            none("Invalid dates", "invalid_dates"),
            none("Non-positive hero IDs", "non_positive_ids"),
            none("Rows without 10 unique heroes", "rows_without_distinct_picks"),
            ("Binary target", binary, F.lit(True), binary),
            ("Chronologically sorted", is_sorted, F.lit(True), is_sorted),
        ],
    )


def split_checks(df: DataFrame, schema: DraftSchema = DRAFT) -> DataFrame:
    """All rows assigned, exactly the three labels, and periods that do not overlap; one scan."""
    split, time = F.col(schema.split), F.col(schema.time)
    limits = [f(F.when(split == s, time)).alias(f"{s}_{end}") for s in SPLITS for end, f in (("min", F.min), ("max", F.max))]
    present = [F.bool_or(split == s).alias(f"has_{s}") for s in SPLITS]
    facts = df.agg(F.count_if(split.isNull()).alias("unassigned"), F.count_if(~split.isin(*SPLITS)).alias("other"), *present, *limits)
    train, validation, test = SPLITS
    labels = (F.col("other") == 0) & F.col(f"has_{train}") & F.col(f"has_{validation}") & F.col(f"has_{test}")
    # The published labels of the checks.
    return check_table(
        facts,
        [
            ("All rows assigned", F.col("unassigned") == 0),
            ("Expected split labels", labels & (F.col("unassigned") == 0)),
            ("Training ends before validation", F.col(f"{train}_max") < F.col(f"{validation}_min")),
            ("Validation ends before test", F.col(f"{validation}_max") < F.col(f"{test}_min")),
        ],
    )
