"""Encoding with vocabularies that are tables: nothing of them is on the driver, whatever their size."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..schema import DRAFT, DraftSchema
from ..sources.storage import materialize
from .encode import vocabulary
from .quality import require_columns
from .ranks import prefix_sums


@dataclass(frozen=True)
class StoredVocabulary:
    """Known IDs with their dense position by value: a stored table (kind, value, position) and its two sizes.

    Feature order is that of `DraftEncoderModel`: known picks, two unknown counts, known versions, unknown version.
    """

    table: DataFrame
    items: int
    versions: int
    schema: DraftSchema = DRAFT

    @property
    def width(self) -> int:
        return self.items + self.versions + 3


def fit_stored(train: DataFrame, schema: DraftSchema = DRAFT) -> StoredVocabulary:
    """Learn the vocabularies of training rows. Positions come from ranks inside value ranges that are added
    up, so no task orders a whole vocabulary; the driver sees three numbers per kind."""
    require_columns(train, [*schema.pick_ids(), schema.version], "encoder input")
    values = materialize(vocabulary(train, schema).select("kind", "value", F.lit(1).alias("_one")))
    facts = {r["kind"]: r for r in values.groupBy("kind").agg(F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("none")).collect()}
    if not facts:
        raise ValueError("the encoder cannot learn from an empty table")
    for kind, text in (("item", f"{schema.item} ID columns contain"), ("version", f"{schema.version} contains")):
        if facts[kind]["none"]:
            raise ValueError(f"encoder input: {text} missing values")
    placed = prefix_sums(values, "value", ["_one"], ["kind"])
    table = materialize(placed.select("kind", "value", (F.col("cum__one") - 1).alias("position")))
    return StoredVocabulary(table, facts["item"]["n"], facts["version"]["n"], schema)


def encode_stored(df: DataFrame, known: StoredVocabulary, keep: Sequence[str] | None = None) -> DataFrame:
    """Non-zero cells as (key, index, feature, value), one row each, as `encoded_long` gives them.

    Cells are unfolded and joined with the vocabulary by value; a value in a third of all cells is the left,
    splittable side of that join. Rows are numbered and stored first, so keys may repeat.
    """
    s = known.schema
    keep = list(keep) if keep is not None else [s.key]
    ids = s.pick_ids()
    require_columns(df, [*ids, s.version, *keep], "encoder input")
    rows = materialize(df.select(*keep, *ids, s.version).withColumn("_row", F.monotonically_increasing_id()))
    missing = F.raise_error(f"encoder input: {s.item} ID columns contain missing values").cast("bigint")
    cells = rows.select("_row", F.posexplode(F.array(*[F.col(c).cast("bigint") for c in ids])).alias("_slot", "value"))
    cells = cells.select("_row", (F.col("_slot") >= s.slots).cast("int").alias("_side"), F.coalesce("value", missing).alias("value"))
    items = known.table.where("kind = 'item'").drop("kind")
    placed = cells.join(items, "value", "left")
    # a pick on both sides keeps the second side's sign, and a repeated pick counts once
    picks = placed.where("position IS NOT NULL").groupBy("_row", "position", "value").agg((1 - 2 * F.max("_side")).alias("cell"))
    picks = picks.select("_row", F.col("position").alias("index"), F.concat(F.lit(f"{s.item}_"), F.col("value")).alias("feature"), "cell")
    unknown = placed.where("position IS NULL").groupBy("_row", "_side").agg(F.count("*").cast("int").alias("cell"))
    names = F.when(F.col("_side") == 0, s.unknown_counts[0]).otherwise(s.unknown_counts[1])
    unknown = unknown.select("_row", (F.col("_side") + F.lit(known.items).cast("bigint")).alias("index"), names.alias("feature"), "cell")
    versions = known.table.where("kind = 'version'").select(F.col("value").alias("_value"), "position")
    dated = rows.select("_row", F.col(s.version).cast("bigint").alias("_value")).join(versions, "_value", "left")
    offset = F.lit(known.items + 2).cast("bigint")
    dated = dated.select(
        "_row",
        F.coalesce(F.col("position") + offset, F.lit(known.width - 1).cast("bigint")).alias("index"),
        F.when(F.col("position").isNull(), s.unknown_version).otherwise(F.concat(F.lit(f"{s.version_prefix}_"), F.col("_value"))).alias("feature"),
        F.lit(1).alias("cell"),
    )
    found = picks.unionByName(unknown).unionByName(dated)
    return found.join(rows.select("_row", *keep), "_row").select(*keep, "index", "feature", F.col("cell").alias("value"))
