"""Match-shaped rows derived from the `orders` test table, in SQL that Spark and DuckDB share.

The view has real signal in the winner and planted defects: NULL winners, versions and names, a
zero ID, one pick on both sides, and newer duplicates of which some are not eligible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import raw_struct
from .storage import spread, stored_once

_STEPS = range(10)
_SIGNAL = " ".join(f"{'+' if i < 5 else '-'} (h{i} * 37 % 101 - 50)" for i in _STEPS)
_PICKS = [f"radiant_player_{i}_hero" for i in range(1, 6)] + [f"dire_player_{i}_hero" for i in range(1, 6)]
_SPECIAL_IDS = {
    4: "CASE WHEN o_orderdate >= TIMESTAMP '2000-01-01 00:00:00' AND o_orderkey % 7 = 0 THEN 121 + o_orderkey % 2 ELSE h4 END",
    5: "CASE WHEN o_orderkey % 307 = 0 THEN h0 ELSE h5 END",
    9: "CASE WHEN o_orderkey % 401 = 0 THEN 0 ELSE h9 END",
}
_IDS = ",\n    ".join(f"CAST({_SPECIAL_IDS.get(i, f'h{i}')} AS BIGINT) AS {_PICKS[i]}_id" for i in _STEPS)
_PICK_IDS = ", ".join(f"{p}_id" for p in _PICKS)
_NAMES = ",\n    ".join(
    f"CASE WHEN match_id % 503 = 0 THEN NULL ELSE concat('Hero ', {p}_id) END AS {p}" if i == 0 else f"concat('Hero ', {p}_id) AS {p}"
    for i, p in enumerate(_PICKS)
)

# Common table expressions ending in `match_view`, to be put after WITH.
MATCH_VIEW_CTES = f"""
stepped AS (
  SELECT o_orderkey, o_custkey, o_orderdate,
    CASE o_custkey % 4 WHEN 0 THEN 7 WHEN 1 THEN 11 WHEN 2 THEN 13 ELSE 17 END AS step
  FROM orders),
drafted AS (
  SELECT *, {", ".join(f"(o_orderkey + {i} * step) % 120 + 1 AS h{i}" for i in _STEPS)}
  FROM stepped),
played AS (
  SELECT o_orderkey AS match_id, o_orderdate AS match_start_date_time,
    CAST(CASE WHEN o_orderkey % 2003 = 0 THEN NULL
         ELSE (year(o_orderdate) - 1995) * 12 + month(o_orderdate) END AS INT) AS game_version_id,
    o_custkey AS radiant_team_id, o_custkey + 1 AS dire_team_id,
    CASE WHEN o_orderkey % 211 = 0 THEN NULL
         WHEN 0 {_SIGNAL} + (o_orderkey * 7919 % 1009 - 504) / 5.0 > 0 THEN o_custkey
         ELSE o_custkey + 1 END AS winner_id,
    {_IDS}
  FROM drafted),
repeated AS (
  SELECT * FROM played
  UNION ALL
  SELECT match_id, match_start_date_time + INTERVAL 1 DAY AS match_start_date_time,
    CASE WHEN match_id % 2 = 0 THEN NULL ELSE game_version_id END AS game_version_id,
    radiant_team_id, dire_team_id, winner_id, {_PICK_IDS}
  FROM played WHERE match_id % 97 = 0),
match_view AS (
  SELECT *,
    {_NAMES}
  FROM repeated)"""

VERSIONS_CTE = """
versions AS (
  SELECT DISTINCT game_version_id AS id, concat('p', game_version_id) AS name
  FROM match_view WHERE game_version_id IS NOT NULL AND game_version_id % 13 <> 0)"""

# Period ends of the view: its own 70 % and 85 % boundaries at scale factor 0.01.
VIEW_TRAIN_CUTOFF = "1999-08-29 00:00:00"
VIEW_VALIDATION_CUTOFF = "2000-08-09 00:00:00"
# A period inside it.
PERIOD = ("1996-03-01 00:00:00", "1998-06-30 00:00:00")


def match_view(spark: SparkSession, folder: str) -> DataFrame:
    """The view, stored as a Parquet table as raw matches are in practice."""

    def derive() -> DataFrame:
        orders = spread(spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate"))
        return spark.sql(f"WITH {MATCH_VIEW_CTES.replace('FROM orders', 'FROM {orders}')} SELECT * FROM match_view", orders=orders)

    return stored_once(spark, f"{folder}/orders.parquet", "match_view", derive)


def version_view(spark: SparkSession, folder: str) -> DataFrame:
    """Version dimension of the view; every thirteenth ID is missing."""
    ids = match_view(spark, folder).select(F.col("game_version_id").alias("id"))
    return ids.filter("id % 13 <> 0").distinct().withColumn("name", F.concat(F.lit("p"), F.col("id").cast("string")))


def _made_up(position: int, field) -> str:
    """A value for a raw column that the view lacks, NULL in some rows, in SQL of both engines."""
    kind, gap = field.dataType.simpleString(), 5 + position % 13
    value = {
        "string": f"concat('t', (match_id + {position}) % 97)",
        "timestamp_ntz": "match_start_date_time",
    }.get(kind, f"CAST((match_id + {position}) % 89 AS {kind.upper()})")
    return f"CASE WHEN (match_id + {position}) % {gap} = 0 THEN NULL ELSE {value} END AS {field.name}"


_HAS = {"match_id", "match_start_date_time", "game_version_id", "radiant_team_id", "dire_team_id", "winner_id", *_PICKS, *(f"{p}_id" for p in _PICKS)}
_WIDE = ",\n    ".join(f.name if f.name in _HAS else _made_up(i, f) for i, f in enumerate(raw_struct()))
# The view with all 130 columns of a raw match table, and one that no rule knows.
WIDE_VIEW_CTE = f"""
wide_view AS (
  SELECT {_WIDE},
    CASE WHEN match_id % 10 = 0 THEN NULL ELSE 'fair' END AS weather
  FROM match_view)"""


def wide_view(spark: SparkSession, folder: str) -> DataFrame:
    text = WIDE_VIEW_CTE.replace("FROM match_view", "FROM {view}")
    return spark.sql(f"WITH {text} SELECT * FROM wide_view", view=match_view(spark, folder))
