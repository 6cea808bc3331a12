"""Sinks of the curation and training jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Headed CSV with doubled quotes and second-precision timestamps; row order is kept."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(path)
    )


def write_inventory(inventory: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Column inventory in its published seven-column layout."""
    columns = ["column", "type", "null_count", "null_percent", "column_group", "v1_decision", "reason"]
    write_csv(inventory.orderBy("position").select(*columns), path, mode)


def write_metadata(metadata: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One nested JSON record."""
    metadata.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    write_csv(metrics, path, mode)
