"""Curation job: raw matches and version dimension to curated table, inventory and metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.curate import curate
from ..operators.profile import column_inventory, metadata_record
from ..schema import DRAFT, SAMPLE_ROWS, DraftSchema
from ..sources import (
    read_curated,
    read_matches,
    read_versions,
    require_sources,
    write_csv,
    write_inventory,
    write_metadata,
)


@dataclass(frozen=True)
class CurationResult:
    sample: DataFrame
    inventory: DataFrame
    metadata: DataFrame


def run_curation(
    spark: SparkSession,
    matches_path: str,
    versions_path: str,
    sample_path: str,
    inventory_path: str,
    metadata_path: str,
    rows: int | None = SAMPLE_ROWS,
    schema: DraftSchema = DRAFT,
) -> CurationResult:
    """Write the three outputs and return them; the metadata describes the table as read back."""
    require_sources(spark, [matches_path, versions_path])
    raw = read_matches(spark, matches_path, schema=schema)
    write_csv(curate(raw, read_versions(spark, versions_path), rows, schema), sample_path)
    sample = read_curated(spark, sample_path, schema)
    inventory = column_inventory(raw)
    write_inventory(inventory, inventory_path)
    requested = rows if rows is not None else sample.count()
    metadata = metadata_record(raw, sample, requested, schema)
    write_metadata(metadata, metadata_path)
    return CurationResult(sample, inventory, metadata)
