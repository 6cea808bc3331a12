"""Built-in column expressions only; everything here stays inside generated code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from ..schema import DRAFT, SPLITS, DraftSchema


def won_by_participant(schema: DraftSchema = DRAFT) -> Column:
    """Winner is one of the two teams; a NULL winner or no matching team drops the row.

    The separate not-null test changes nothing in a filter but reaches the Parquet scan.
    """
    winner = F.col(schema.winner)
    return winner.isNotNull() & winner.isin(*[F.col(c) for c in schema.team_ids])


def drafted_in_full(schema: DraftSchema = DRAFT) -> Column:
    """Every slot has a positive ID and a name."""
    slots = zip(schema.pick_ids(), schema.pick_names())
    tests = [(F.col(i) > 0) & F.col(n).isNotNull() for i, n in slots]
    return reduce(Column.__and__, tests)


def distinct_values(columns: Sequence[str], kind: str = "bigint") -> Column:
    """Number of different non-null values across columns of one row."""
    cells = F.array(*[F.col(c).cast(kind) for c in columns])
    return F.size(F.array_except(cells, F.array(F.lit(None).cast(kind))))


def drafted_once(schema: DraftSchema = DRAFT) -> Column:
    """No ID is picked twice in the row."""
    return distinct_values(schema.pick_ids()) == schema.picks_per_row


def eligible(schema: DraftSchema = DRAFT) -> Column:
    """Known winner and version, and a full draft of different picks."""
    return (
        won_by_participant(schema)
        & F.col(schema.version).isNotNull()
        & drafted_in_full(schema)
        & drafted_once(schema)
    )


def outcome(schema: DraftSchema = DRAFT) -> Column:
    """TRUE if the first side won, FALSE if the second did, else NULL."""
    winner = F.col(schema.winner)
    first, second = schema.team_ids
    return F.when(winner == F.col(first), True).when(winner == F.col(second), False)


def key_hash(key: str) -> Column:
    """Hex MD5 of the key written as text: a stable pseudo-random order."""
    return F.md5(F.col(key).cast("string"))


def row_hash(columns: Sequence[str]) -> Column:
    """Hex MD5 of all cells as text, each with its length or a mark for NULL.

    A value that moves to the next column, or a NULL that changes places with one, changes the hash.
    """
    cells = [F.col(f"`{c}`").cast("string") for c in columns]
    marked = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cells]
    return F.md5(F.concat_ws("|", *marked))


def split_label(time: Column, train_cutoff: str, validation_cutoff: str) -> Column:
    """Period of a row; a row exactly on a cutoff belongs to the earlier period.

    A NULL time fails the job: it must not fall through to the test period.
    """
    train, validation, test = SPLITS
    return (
        F.when(time.isNull(), F.raise_error("the time column contains missing values").cast("string"))
        .when(time <= F.lit(train_cutoff).cast("timestamp_ntz"), train)
        .when(time <= F.lit(validation_cutoff).cast("timestamp_ntz"), validation)
        .otherwise(test)
    )


def split_rank(column: str = "split") -> Column:
    """Sort position of a split name: train, validation, test."""
    return F.array_position(F.array(*[F.lit(s) for s in SPLITS]), F.col(column)).cast("int")


def keep_known(column: Column, known: Sequence[int]) -> Column:
    """The value if it is in the known set, else NULL."""
    return F.when(column.isin(list(known)), column)


def flip_where(label: Column, mask: Column) -> Column:
    """Invert a 0/1 label on the rows of the mask."""
    return F.when(mask, 1 - label).otherwise(label)


def predicted_class(probability: Column, threshold: float = 0.5) -> Column:
    """1 from the threshold on, inclusive."""
    return (probability >= threshold).cast("int")


def share(part: Column, whole: Column) -> Column:
    return part.cast("double") / whole.cast("double")


def item_of_feature(feature: Column, prefix: str) -> Column:
    """ID inside a feature name such as `hero_12`."""
    return F.substring(feature, len(prefix) + 2, 20).cast("bigint")


def status(passed: Column, otherwise: str = "REVIEW") -> Column:
    return F.when(passed, "PASS").otherwise(otherwise)
