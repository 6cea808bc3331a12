"""Training job: curated CSV to fitted baselines and their metrics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import SparkSession

from ..operators.encode import prepare_features
from ..operators.models import BaselineRun, ordered_metrics, train_baselines
from ..schema import DRAFT, TRAIN_CUTOFF, VALIDATION_CUTOFF, DraftSchema
from ..sources import materialize, read_curated, require_sources, write_metrics


def run_training(
    spark: SparkSession,
    path: str,
    evaluate_test: bool = True,
    metrics_path: str | None = None,
    train_cutoff: str | datetime = TRAIN_CUTOFF,
    validation_cutoff: str | datetime = VALIDATION_CUTOFF,
    schema: DraftSchema = DRAFT,
) -> BaselineRun:
    """Read, prepare, train, evaluate; save the metrics if a path is given."""
    require_sources(spark, [path])
    # Training reads the table many times; text is parsed once and kept in the shared folder.
    frame = materialize(read_curated(spark, path, schema))
    run = train_baselines(prepare_features(frame, train_cutoff, validation_cutoff, schema), evaluate_test)
    if metrics_path is not None:
        write_metrics(ordered_metrics(run).coalesce(1), metrics_path)  # six rows at most
    return run
