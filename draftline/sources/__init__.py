"""Sources and sinks."""

from .layout import read_by_year, write_bucketed, write_by_year
from .readers import FILE_POSITION, read_curated, read_matches, read_versions, require_sources, with_file_position
from .storage import checkpoint_folder, materialize, stored_once
from .writers import write_csv, write_inventory, write_metadata, write_metrics

__all__ = [
    "FILE_POSITION",
    "checkpoint_folder",
    "materialize",
    "read_by_year",
    "read_curated",
    "read_matches",
    "read_versions",
    "require_sources",
    "stored_once",
    "with_file_position",
    "write_bucketed",
    "write_by_year",
    "write_csv",
    "write_inventory",
    "write_metadata",
    "write_metrics",
]
