import hashlib

import pytest
from pyspark.sql import functions as F

from draftline.functions import distinct_values, eligible, outcome
from draftline.operators import curate as cur
from draftline.schema import DRAFT
from draftline.sources import write_bucketed

from fixtures import raw_match, raw_matches


def keys(df):
    return sorted(r[DRAFT.key] for r in df.select(DRAFT.key).collect())


def test_eligibility_rules(spark):
    rows = [
        raw_match(1),
        raw_match(2, winner=None),
        raw_match(3, winner=300),
        raw_match(4, version=None),
        raw_match(5, ids=(0, *range(2, 11))),
        raw_match(6, ids=(None, *range(2, 11))),
        raw_match(7, names=[None, *[f"Hero {i}" for i in range(2, 11)]]),
        raw_match(8, ids=(1, 2, 3, 4, 5, 1, 7, 8, 9, 10)),
        raw_match(9, winner=200),
        raw_match(10, teams=(None, 200), winner=200),
    ]
    df = raw_matches(spark, rows).filter(eligible())
    assert keys(df) == [1, 9, 10]
    labels = {r[0]: r[1] for r in df.select(DRAFT.key, outcome()).collect()}
    assert labels == {1: True, 9: False, 10: False}


def test_distinct_values_ignore_nulls(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 3), (None, None, None)], "a int, b int, c int")
    assert [r[0] for r in df.select(distinct_values(["a", "b", "c"])).collect()] == [1, 3, 0]


def test_an_ineligible_newer_duplicate_does_not_hide_the_older_row(spark):
    rows = [
        raw_match(1, "2022-01-01", version=1),
        raw_match(1, "2022-01-05", version=None),
        raw_match(2, "2022-01-01", version=1),
        raw_match(2, "2022-01-05", version=1),
        raw_match(3, "2022-01-01", version=1),
        raw_match(3, "2022-01-01", version=2),
    ]
    latest = {r[DRAFT.key]: r for r in cur.latest_eligible(raw_matches(spark, rows)).collect()}
    assert len(latest) == 3
    assert latest[1][DRAFT.time].day == 1 and latest[2][DRAFT.time].day == 5 and latest[3][DRAFT.version] == 2


def test_full_ties_are_broken_the_same_way_in_any_partitioning(spark):
    rows = [raw_match(1, winner=w, teams=(100, 200), ids=ids) for w in (100, 200) for ids in (range(1, 11), range(11, 21))]
    picked = {tuple(cur.latest_eligible(raw_matches(spark, rows).repartition(n)).first()) for n in (1, 2, 4)}
    assert len(picked) == 1


def test_nulls_come_last_in_the_latest_row(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, 5, "b"), (2, None, "c")], "k int, t int, v string")
    assert sorted(r.v for r in cur.keep_latest(df, ["k"], ["t"]).collect()) == ["b", "c"]


@pytest.mark.parametrize("rows", [1, 7, 150, 300, 400])
def test_hash_sample_takes_the_first_keys_by_md5(spark, rows):
    df = spark.range(1000).select((F.col("id") % 300).alias("k"), F.col("id").alias("v"))  # repeated keys
    order = sorted(range(300), key=lambda k: hashlib.md5(str(k).encode()).hexdigest())
    got = cur.hash_sample(df, "k", rows)
    assert "Join" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "Exchange" not in plan
    assert sorted({r.k for r in got.collect()}) == sorted(order[:rows])
    assert got.count() == df.filter(F.col("k").isin(order[:rows])).count()


def test_hot_key_is_reduced_before_the_shuffle(spark):
    df = spark.range(3000).select((F.when(F.col("id") < 1000, 0).otherwise(F.col("id"))).alias("k"), F.col("id").alias("t"))
    plan = cur.keep_latest(df, ["k"], ["t"])._jdf.queryExecution().executedPlan().toString()
    partial, exchange = plan.index("row_number(), 1, Partial"), plan.index("Exchange hashpartitioning")
    assert exchange < partial  # printed top-down: the limit is below the exchange
    assert cur.keep_latest(df, ["k"], ["t"]).filter("k = 0").first().t == 999


def test_version_names_and_the_unique_key_guard(spark):
    versions = spark.createDataFrame([(1, "p1"), (2, "p2")], "id int, name string")
    table = cur.curate(raw_matches(spark, [raw_match(2, "2022-01-02", version=1), raw_match(1, "2022-01-02", version=3), raw_match(3, version=2)]), versions)
    rows = table.collect()
    assert table.columns == DRAFT.curated_columns() and len(table.columns) == 25
    assert [(r[DRAFT.key], r[DRAFT.version_name]) for r in rows] == [(3, "p2"), (1, None), (2, "p1")]
    with pytest.raises(ValueError, match="occurs 2 times"):
        cur.with_version_name(table.drop(DRAFT.version_name), versions.union(versions))


def test_sampling_before_ranking_equals_ranking_before_sampling(spark):
    rows = [raw_match(k, f"2022-01-{1 + d:02d}", version=None if (k + d) % 5 == 0 else d + 1) for k in range(60) for d in range(3)]
    raw = raw_matches(spark, rows)
    versions = spark.createDataFrame([(i, f"p{i}") for i in range(1, 4)], "id int, name string")
    full = {r[DRAFT.key]: r for r in cur.curate(raw, versions, rows=None).collect()}
    want = sorted(full, key=lambda k: hashlib.md5(str(k).encode()).hexdigest())[:20]
    got = {r[DRAFT.key]: r for r in cur.curate(raw, versions, rows=20).collect()}
    assert got == {k: full[k] for k in want}


def test_full_ties_do_not_depend_on_the_input_order(spark):
    rows = [(1, 5, 1, None), (1, 5, None, 1), (1, 5, None, None)]
    found = set()
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        df = spark.createDataFrame(order, "k int, t int, a int, b int").coalesce(1)
        found |= {tuple(r) for r in cur.keep_latest(df, ["k"], ["t"]).collect()}
    assert found == {(1, 5, 1, None)}


def test_hash_sample_of_nothing_and_of_null_keys(spark):
    df = spark.createDataFrame([(None,), (1,), (1,), (2,)], "k int")
    assert cur.hash_sample(df, "k", 0).count() == 0
    assert sorted(r.k for r in cur.hash_sample(df, "k", 5).collect()) == [1, 1, 2]


def test_buckets_spare_the_shuffle(spark):
    rows = [(i % 40 if i % 9 else None, i * 7 % 100, f"v{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "k bigint, t bigint, v string")
    stored = spark.table(write_bucketed(df, ["k"], 4, ["t"]))
    latest = cur.keep_latest(stored, ["k"], ["t", "v"])
    assert sorted(latest.collect(), key=str) == sorted(cur.keep_latest(df, ["k"], ["t", "v"]).collect(), key=str)
    assert "Exchange" not in latest._jdf.queryExecution().executedPlan().toString()
    other = spark.table(write_bucketed(df.select("k").distinct(), ["k"], 4))
    joined = stored.join(other.hint("merge"), "k")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == sum(k is not None for k, *_ in rows)


def test_export_orders_the_stored_table(spark, tmp_path, monkeypatch):
    """Ordering reads its rows twice, so the duplicates are not ranked below it."""
    from draftline import catalog

    written = []
    monkeypatch.setattr(catalog, "write_csv", lambda df, path: written.append(df))
    orders = "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz"
    rows = spark.range(500).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "CAST(timestampadd(DAY, 500 - id, TIMESTAMP '1997-01-01') AS timestamp_ntz) AS o_orderdate")
    assert rows.schema.simpleString() == spark.createDataFrame([], orders).schema.simpleString()
    rows.write.parquet(str(tmp_path / "orders.parquet"))
    catalog._curated_file(spark, str(tmp_path))
    plan = written[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" in plan and "Window" not in plan
    times = [r[0] for r in written[0].select("match_start_date_time").collect()]
    assert times == sorted(times) and len(times) > 100
