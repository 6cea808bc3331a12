"""Curation: eligibility, keep-latest, deterministic sampling, dimension names, label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import eligible, key_hash, outcome
from ..schema import DRAFT, SAMPLE_ROWS, DraftSchema
from ..sources.storage import materialize

# Largest key set or dimension that is sent to every executor.
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only after counting; a bigger side is left to the optimizer's own join choice."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def keep_latest(df: DataFrame, keys: Sequence[str], newest_first: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by the order columns, NULLs last.

    Ties are broken by the other columns in turn, so only equal rows can stand for each other. The
    rank filter lets Spark keep one row per key and map task before the shuffle, so a hot key stays small.
    """
    ranking = [*newest_first, *(c for c in df.columns if c not in {*keys, *newest_first})]
    order = [F.col(f"`{c}`").desc_nulls_last() for c in ranking]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def _nearest_keys(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Stored distinct keys that surely hold the first `rows` in hash order, and not many more.

    A sketch estimates the number of keys, which gives the share of the hash range to look at.
    Only keys in that part are shuffled. If they turn out to be too few, the part is doubled, up
    to all keys, so the estimate affects the cost but never the result.
    """
    keys = df.select(key).filter(F.col(key).isNotNull())
    estimate = keys.agg(F.approx_count_distinct(key)).first()[0]
    part = 1.3 * rows / estimate if estimate else 1.0
    place = F.conv(F.substring(key_hash(key), 1, 8), 16, 10).cast("double") / float(1 << 32)
    while True:
        near = keys.filter(place < part) if part < 1.0 else keys
        found = materialize(near.distinct())
        if part >= 1.0 or found.count() >= rows:
            return found.withColumn("_hash", key_hash(key))
        part *= 2.0


def _last_sampled(df: DataFrame, key: str, rows: int):
    """(_hash, key) of the last of the first `rows` keys in hash order; None if there are no more keys.

    The first 20 bits of the hash cut the keys into even buckets. Counts tell which bucket holds the
    last key, and only that bucket is ordered.
    """
    bucketed = _nearest_keys(df, key, rows).withColumn("_bucket", F.conv(F.substring("_hash", 1, 5), 16, 10).cast("int"))
    counts = bucketed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    running = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)  # at most 2**20 rows
    ends = counts.withColumn("_end", F.sum("_n").over(running)).withColumn("_before", F.col("_end") - F.col("_n"))
    edge = ends.filter(F.col("_end") >= rows).orderBy("_bucket").select("_bucket", "_before").first()
    if edge is None:
        return None
    at_edge = bucketed.filter(F.col("_bucket") == edge["_bucket"]).orderBy("_hash", key)
    return at_edge.offset(rows - 1 - edge["_before"]).select("_hash", key).first()


def hash_sample(df: DataFrame, key: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """All rows of the first `rows` distinct keys in MD5 order; the same keys on every run.

    The sample is everything up to one place in that order, so the table is filtered against two
    constants where it lies: neither a join nor a shuffle, at any sample size. Little more than the
    sampled keys is shuffled to find the place. Rows with a NULL key are not sampled.
    """
    if rows <= 0:
        return df.limit(0)
    last = _last_sampled(df, key, rows)
    if last is None:
        return df.filter(F.col(key).isNotNull())
    place, limit, value = key_hash(key), F.lit(last["_hash"]), F.lit(last[key]).cast(df.schema[key].dataType)
    return df.filter((place < limit) | ((place == limit) & (F.col(key) <= value)))


def with_version_name(df: DataFrame, versions: DataFrame, schema: DraftSchema = DRAFT) -> DataFrame:
    """Left join to the version dimension; unknown versions get a NULL name."""
    dim = versions.select(F.col("id").alias(schema.version), F.col("name").alias(schema.version_name))
    size = dim.groupBy(schema.version).agg(F.count("*").alias("n")).agg(F.max("n").alias("uses"), F.sum("n").alias("rows")).first()
    if (size["uses"] or 0) > 1:
        raise ValueError(f"version dimension: an id occurs {size['uses']} times")
    small = (size["rows"] or 0) <= BROADCAST_ROWS
    return df.join(F.broadcast(dim) if small else dim, schema.version, "left")


def latest_eligible(raw: DataFrame, schema: DraftSchema = DRAFT) -> DataFrame:
    """Eligible rows, newest per key. Rows are filtered first, so a newer row that is not
    eligible does not hide an older one that is."""
    needed = [schema.key, schema.time, schema.version, schema.winner, *schema.team_ids]
    slim = raw.filter(eligible(schema)).select(*needed, *schema.pick_ids(), *schema.pick_names())
    return keep_latest(slim, [schema.key], [schema.time, schema.version])


def curate(
    raw: DataFrame,
    versions: DataFrame,
    rows: int | None = SAMPLE_ROWS,
    schema: DraftSchema = DRAFT,
    ordered: bool = True,
) -> DataFrame:
    """Curated table: eligible rows, sampled by key hash (all if `rows` is None), newest per key,
    version name and label added, in time order.

    The sample depends on keys alone, so it is drawn before the duplicates are ranked: the rank
    then shuffles the sample instead of the whole table.
    """
    kept = raw.filter(eligible(schema))
    if rows is not None:
        kept = hash_sample(kept, schema.key, rows)
    latest = latest_eligible(kept, schema).withColumn(schema.label, outcome(schema))
    table = with_version_name(latest, versions, schema).select(*schema.curated_columns())
    return in_time_order(table, schema) if ordered else table


def in_time_order(table: DataFrame, schema: DraftSchema = DRAFT) -> DataFrame:
    """Rows by time, then key. Spark reads the rows twice, first for the limits of its ranges, so pass a
    table that is stored if it is large and costly to derive."""
    return table.orderBy(F.col(schema.time).asc_nulls_last(), F.col(schema.key).asc_nulls_last())
