"""Ordered computations without a global window: prefix sums, order statistics, order checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..sources.storage import materialize

_SAMPLE_PER_BUCKET = 100


def _as_number(df: DataFrame, key: str) -> Column:
    """A double that never decreases when the key increases."""
    kind = df.schema[key].dataType
    column = F.col(key)
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        days = F.unix_date(column.cast("date")).cast("double")
        if isinstance(kind, T.DateType):
            return days
        return days + (F.hour(column) * 3600 + F.minute(column) * 60 + F.second(column)) / F.lit(86400.0)
    if isinstance(kind, T.NumericType):
        return column.cast("double")
    raise TypeError(f"{key}: cannot order a {kind.simpleString()} column by ranges")


def with_range_bucket(df: DataFrame, key: str, bucket: str = "_bucket", buckets: int | None = None) -> DataFrame:
    """Add a range number that rises with the key and holds about equally many rows each.

    Limits are quantiles of a small random sample; they decide how even the ranges are, never
    which rows are in the result. They become constants of the plan, so a lost task that is run
    again puts every row in the same range. Equal keys always share a range. NULL keys come last.
    """
    if buckets is None:
        buckets = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / buckets for i in range(1, buckets)]
    number = df.withColumn("_number", _as_number(df, key))
    limits = None
    if cuts:
        wanted, rows = _SAMPLE_PER_BUCKET * buckets, df.count()
        drawn = number.select("_number").sample(wanted / rows, seed=0) if rows > wanted else number
        quantiles = F.percentile_approx("_number", F.array(*[F.lit(c) for c in cuts]), F.lit(max(10_000, 20 * buckets)))
        limits = drawn.agg(quantiles).first()[0]
    splits = [float("-inf"), *sorted(set(limits or [0.0])), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="_number", outputCol=bucket, handleInvalid="keep").transform(number)
    return ranged.withColumn(bucket, F.coalesce(F.col(bucket).cast("int"), F.lit(len(splits)))).drop("_number")


def prefix_sums(
    df: DataFrame,
    key: str,
    measures: Sequence[str],
    groups: Sequence[str] = (),
    descending: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Running totals `cum_<measure>` by key inside each group. Keys must be unique per group.

    Rows are summed inside key ranges in parallel; a table of one row per group and range then
    gives each range its starting value. The groups must be few, as splits or models are. The
    table is read several times, so pass one that is stored.
    """
    ranged = with_range_bucket(df, key, buckets=buckets)

    def way(name: str) -> Column:
        return F.col(name).desc_nulls_last() if descending else F.col(name).asc_nulls_last()

    earlier = Window.partitionBy(*groups).orderBy(way("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*groups, "_bucket").agg(*[F.sum(m).alias(f"_sum_{m}") for m in measures])
    by = [*groups, "_bucket"]
    starts = totals.select(
        *[F.col(c).alias(f"_on_{c}") for c in by],
        *[F.coalesce(F.sum(f"_sum_{m}").over(earlier), F.lit(0)).alias(f"_start_{m}") for m in measures],
    )
    inside = Window.partitionBy(*by).orderBy(way(key)).rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.withColumns({f"_run_{m}": F.sum(m).over(inside) for m in measures})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    joined = running.join(starts, same)  # small for few groups; the optimizer knows its size
    return joined.select(
        *df.columns, *[(F.col(f"_start_{m}") + F.col(f"_run_{m}")).alias(f"cum_{m}") for m in measures]
    )


def order_statistics(df: DataFrame, column: str, fractions: Mapping[str, float]) -> DataFrame:
    """Exact order statistics, one row: for each name, the k-th smallest value, k = int(n * fraction).

    n counts every row; k = 0 gives the largest value. The table is scanned once: its different
    values with their counts are stored and ranked, so a value that fills a third of the table is
    one row.
    """
    counts = materialize(df.groupBy(column).agg(F.count("*").alias("n")))
    ranked = prefix_sums(counts.filter(F.col(column).isNotNull()), column, ["n"])
    ranked = ranked.withColumn("_rows", counts.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar())

    def pick(fraction: float) -> Column:
        k = F.floor(F.col("_rows").cast("double") * F.lit(fraction))
        return F.when(F.max(k) == 0, F.max(column)).otherwise(F.min(F.when(F.col("cum_n") >= k, F.col(column))))

    return ranked.agg(*[pick(f).alias(name) for name, f in fractions.items()])


def order_breaks(df: DataFrame, value: str, sequence: str, within: Sequence[str] = ()) -> DataFrame:
    """One row with `breaks`: how many rows have a smaller value than the row before them.

    The order is (`within` columns, sequence, value), so rows of one sequence value hold no break among
    themselves and their smallest and largest value stand for them: a sequence value that a third of
    the rows share becomes one row before anything is ordered. NULL values are left out. `within` names
    natural pieces such as file and block; without it, pieces are ranges of the sequence. Each piece is
    checked on its own, and then the last value of a piece against the first of the next.
    """
    return breaks_between(sequence_ends(df, value, sequence, within), sequence, within)


def sequence_ends(df: DataFrame, value: str, sequence: str, within: Sequence[str] = ()) -> DataFrame:
    """Rows, smallest and largest value of every sequence value; stored, unless natural pieces are given.

    Ranges of the sequence take several readings; given pieces take one, which needs no stored copy of a
    table that may have a row, and the names of its pieces, for every row of `df`.
    """
    low, high = F.min(value).alias("_low"), F.max(value).alias("_high")
    ends = df.groupBy(*within, sequence).agg(F.count("*").alias("_rows"), low, high)
    return ends if within else materialize(ends)


def breaks_between(ends: DataFrame, sequence: str, within: Sequence[str] = ()) -> DataFrame:
    """`order_breaks` of `sequence_ends`."""
    ends = ends.where(F.col("_low").isNotNull()).drop("_rows")
    pieces, by = (ends, list(within)) if within else (with_range_bucket(ends, sequence), ["_bucket"])
    before = F.lag("_high").over(Window.partitionBy(*by).orderBy(sequence))
    broken = F.coalesce(F.col("_low") < before, F.lit(False)).cast("int")
    ends = (
        pieces.withColumn("_broken", broken)
        .groupBy(*by)
        .agg(
            F.sum("_broken").alias("_inside"),
            F.min_by("_low", F.struct(F.col(sequence).isNotNull(), sequence)).alias("_first"),
            F.max_by("_high", F.struct(F.col(sequence).isNotNull(), sequence)).alias("_last"),
        )
    )
    piece_before = F.lag("_last").over(Window.orderBy(*by))
    joints = ends.withColumn("_joint", F.coalesce(F.col("_first") < piece_before, F.lit(False)).cast("int"))
    return joints.agg(F.coalesce(F.sum(F.col("_inside") + F.col("_joint")), F.lit(0)).cast("bigint").alias("breaks"))
