"""Table layouts and defaults: which columns a draft table has and how they are named."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Names, cutoffs and sizes that define the published results.
SPLITS = ("train", "validation", "test")
TRAIN_CUTOFF = "2022-11-11 00:00:00"
VALIDATION_CUTOFF = "2023-11-19 08:14:29"
SAMPLE_ROWS = 30_000
TRAIN_SHARE = 0.70
TRAIN_AND_VALIDATION_SHARE = 0.85

# Columns that may never be model inputs, and the wider list of the feature report.
FORBIDDEN = ("match_id", "match_start_date_time", "split", "radiant_win", "winner_id")
STRICT_FORBIDDEN = FORBIDDEN + (
    "match_duration_seconds",
    "first_blood_time_seconds",
    "radiant_kills",
    "dire_kills",
)


@dataclass(frozen=True)
class DraftSchema:
    """Column naming of a draft table; the first side is encoded +1, the second -1."""

    key: str = "match_id"
    time: str = "match_start_date_time"
    version: str = "game_version_id"
    version_name: str = "game_version"
    winner: str = "winner_id"
    label: str = "radiant_win"
    split: str = "split"
    item: str = "hero"
    version_prefix: str = "patch"
    sides: tuple[str, str] = ("radiant", "dire")
    slots: int = 5

    def slot_columns(self, suffix: str, sides: tuple[str, ...] | None = None) -> list[str]:
        """Column family over all slots, side by side: `{side}_player_{slot}_{suffix}`."""
        return [
            f"{side}_player_{slot}_{suffix}"
            for side in (sides or self.sides)
            for slot in range(1, self.slots + 1)
        ]

    def pick_ids(self, *sides: str) -> list[str]:
        return self.slot_columns(f"{self.item}_id", sides or None)

    def pick_names(self, *sides: str) -> list[str]:
        return self.slot_columns(self.item, sides or None)

    @property
    def picks_per_row(self) -> int:
        return self.slots * len(self.sides)

    @property
    def team_ids(self) -> list[str]:
        return [f"{side}_team_id" for side in self.sides]

    @property
    def unknown_counts(self) -> list[str]:
        return [f"unknown_{side}_{self.item}_count" for side in self.sides]

    @property
    def unknown_version(self) -> str:
        return f"{self.version_prefix}_unknown"

    def curated_columns(self) -> list[str]:
        picks = [c for pair in zip(self.pick_ids(), self.pick_names()) for c in pair]
        return [self.key, self.time, self.version, self.version_name, *picks, self.label]


DRAFT = DraftSchema()

VERSION_STRUCT = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("start_date_time", T.TimestampNTZType()),
    ]
)


def raw_struct(schema: DraftSchema = DRAFT) -> T.StructType:
    """The raw match table: match fields, then eleven attributes per player slot."""
    text, big, small = T.StringType(), T.LongType(), T.ShortType()
    whole, time = T.IntegerType(), T.TimestampNTZType()
    first, second = schema.sides
    head = [
        ("league", text), ("league_id", whole), ("league_tier", text),
        ("league_start_date_time", time), ("league_end_date_time", time),
        ("league_region", text), ("series_id", whole), ("series_type", text),
        (schema.key, big), (schema.time, time),
        ("match_duration_seconds", whole), ("first_blood_time_seconds", whole),
        (f"{first}_team_id", big), (f"{first}_team_name", text),
        (f"{second}_team_id", big), (f"{second}_team_name", text),
        (schema.winner, big), (f"{first}_kills", small), (f"{second}_kills", small),
    ]
    per_slot = [
        ("id", big), ("name", text), (f"{schema.item}_id", big), (schema.item, text),
        ("position", text), ("lane", text), ("role", text),
        ("kills", small), ("deaths", small), ("assists", small), ("networth", big),
    ]
    slots = [
        (f"{side}_player_{slot}_{suffix}", kind)
        for side in schema.sides
        for slot in range(1, schema.slots + 1)
        for suffix, kind in per_slot
    ]
    fields = head + slots + [(schema.version, whole)]
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


def curated_struct(schema: DraftSchema = DRAFT) -> T.StructType:
    """The curated table in export order."""
    raw = {f.name: f.dataType for f in raw_struct(schema)}
    raw[schema.version_name] = T.StringType()
    raw[schema.label] = T.BooleanType()
    return T.StructType([T.StructField(c, raw[c]) for c in schema.curated_columns()])
