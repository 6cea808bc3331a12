"""Small match tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from draftline.schema import DRAFT

ROW = (
    f"{DRAFT.key} bigint, {DRAFT.time} timestamp_ntz, {DRAFT.version} int, {DRAFT.label} int, "
    + ", ".join(f"{c} bigint" for c in DRAFT.pick_ids())
    + ", "
    + ", ".join(f"{c} string" for c in DRAFT.pick_names())
)


def match(key, time, win=1, radiant=(1, 2, 3, 4, 5), dire=(6, 7, 8, 9, 10), version=1):
    ids = [*radiant, *dire]
    when = datetime.fromisoformat(time) if isinstance(time, str) else time
    return (key, when, version, win, *ids, *[None if i is None else f"Hero {i}" for i in ids])


def matches(spark, rows):
    return spark.createDataFrame(rows, ROW)


def signal_rows(flip_validation=False):
    """Daily matches of three periods in which one draft always wins."""
    rows, key = [], 0
    for start, count in (("2022-01-01", 40), ("2023-01-01", 20), ("2024-01-01", 20)):
        for i in range(count):
            win = i % 2
            first, second = (1, 2, 3, 4, 5), (6, 7, 8, 9, 10)
            radiant, dire = (first, second) if win else (second, first)
            label = 1 - win if flip_validation and start.startswith("2023") else win
            key += 1
            rows.append(match(key, datetime.fromisoformat(start) + timedelta(days=i), label, radiant, dire))
    return rows


RAW = (
    f"{DRAFT.key} bigint, {DRAFT.time} timestamp_ntz, {DRAFT.version} int, radiant_team_id bigint, "
    "dire_team_id bigint, winner_id bigint, "
    + ", ".join(f"{c} bigint" for c in DRAFT.pick_ids())
    + ", "
    + ", ".join(f"{c} string" for c in DRAFT.pick_names())
)


def raw_match(key, time="2022-01-01", version=1, winner=100, teams=(100, 200), ids=tuple(range(1, 11)), names=None):
    names = names if names is not None else [f"Hero {i}" for i in ids]
    return (key, datetime.fromisoformat(time), version, *teams, winner, *ids, *names)


def raw_matches(spark, rows):
    return spark.createDataFrame(rows, RAW)
