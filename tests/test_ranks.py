import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from draftline.operators import ranks


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_prefix_sums_equal_a_running_total(spark, buckets, descending):
    rng = random.Random(4)
    rows = [(g, k, rng.randint(0, 9)) for g in ("x", "y") for k in rng.sample(range(-1000, 1000), 200)]
    df = spark.createDataFrame(rows, "g string, k int, n int").repartition(5)
    got = {(r.g, r.k): r.cum_n for r in ranks.prefix_sums(df, "k", ["n"], ["g"], descending, buckets).collect()}
    assert len(got) == 400
    for group in ("x", "y"):
        total = 0
        for _, k, n in sorted((r for r in rows if r[0] == group), key=lambda r: r[1], reverse=descending):
            total += n
            assert got[group, k] == total


def test_concentrated_keys_are_still_spread(spark):
    """Nearly equal scores get different ranges: limits follow the data, not the value range."""
    df = spark.range(2000).select((F.lit(0.5) + F.col("id") * F.lit(1e-9)).alias("k"))
    sizes = [r["count"] for r in ranks.with_range_bucket(df, "k", buckets=20).groupBy("_bucket").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 200


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101])
def test_order_statistics_equal_sorted_positions(spark, n):
    rng = random.Random(n)
    start = datetime(2020, 1, 1)
    times = [start + timedelta(seconds=rng.randint(0, 40) * 3600) for _ in range(n)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    got = ranks.order_statistics(df, "t", {"a": 0.70, "b": 0.85}).first()
    ordered = sorted(times)
    assert (got.a, got.b) == (ordered[int(n * 0.70) - 1], ordered[int(n * 0.85) - 1])


def test_order_statistics_with_one_dominant_value(spark):
    df = spark.range(900).select(F.when(F.col("id") < 600, 5).otherwise(F.col("id")).alias("v"))
    got = ranks.order_statistics(df, "v", {"a": 0.5, "b": 0.9}).first()
    assert (got.a, got.b) == (5, 809)


def test_order_breaks(spark):
    values = [1, 2, 2, 5, 4, 6, 3, 7]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v int").repartition(4)
    assert ranks.order_breaks(df, "v", "i").first().breaks == 2
    assert ranks.order_breaks(df.filter("v not in (4, 3)"), "v", "i").first().breaks == 0
    pieces = df.select(F.floor(F.col("i") / 3).alias("file"), "i", "v")
    assert ranks.order_breaks(pieces, "v", "i", ["file"]).first().breaks == 2


def test_text_keys_are_refused(spark):
    with pytest.raises(TypeError):
        ranks.with_range_bucket(spark.createDataFrame([("a",)], "k string"), "k")


def test_breaks_do_not_depend_on_partitions_when_sequence_values_repeat(spark):
    df = spark.range(400).selectExpr("id % 100 AS i", "CASE WHEN id % 7 = 0 THEN NULL ELSE id * 7919 % 101 END AS v")
    rows = sorted((r.i, r.v) for r in df.collect() if r.v is not None)
    expected = sum(b[1] < a[1] for a, b in zip(rows, rows[1:]))
    for n in (1, 3, 16):
        assert ranks.order_breaks(df.repartition(n), "v", "i").first().breaks == expected


def test_a_hot_sequence_value_becomes_one_row(spark):
    df = spark.range(90_000).selectExpr("IF(id % 3 = 0, 7, id) AS i", "id AS v")
    assert ranks.order_breaks(df, "v", "i").first().breaks == 2  # before its smallest and after its largest
    plan = df.where("v IS NOT NULL").groupBy("i").agg(F.min("v"), F.max("v"))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate") < plan.index("Exchange") < plan.rindex("HashAggregate")  # reduced below the shuffle


def test_given_pieces_are_read_once_and_not_stored(spark, monkeypatch):
    monkeypatch.setattr(ranks, "materialize", lambda df: pytest.fail("stored"))
    df = spark.createDataFrame([("a", 0, 3), ("a", 1, 2), ("b", 2, 1), ("b", 3, None), ("b", 4, 5)], "piece string, place int, v int")
    assert ranks.order_breaks(df, "v", "place", ["piece"]).first().breaks == 2
