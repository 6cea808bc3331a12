"""Column expressions shared by the operators."""

from .expressions import (
    distinct_values,
    drafted_in_full,
    drafted_once,
    eligible,
    flip_where,
    item_of_feature,
    keep_known,
    key_hash,
    outcome,
    predicted_class,
    row_hash,
    share,
    split_label,
    split_rank,
    status,
    won_by_participant,
)

__all__ = [
    "distinct_values",
    "drafted_in_full",
    "drafted_once",
    "eligible",
    "flip_where",
    "item_of_feature",
    "keep_known",
    "key_hash",
    "outcome",
    "predicted_class",
    "row_hash",
    "share",
    "split_label",
    "split_rank",
    "status",
    "won_by_participant",
]
