import re
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from draftline.functions import flip_where, split_rank
from draftline.operators import quality, split as sp
from draftline.schema import DRAFT
from draftline.sources import read_by_year, write_by_year

from fixtures import match, matches

# Instants on and beside the published cutoffs.
BOUNDARY = ["2022-11-10 23:59:59", "2022-11-11 00:00:00", "2022-11-11 00:00:01", "2023-11-19 08:14:29", "2023-11-19 08:14:30"]
EXPECTED = ["train", "train", "validation", "validation", "test"]


@pytest.mark.parametrize("kind", ["string", "timestamp_ntz"])
def test_rows_on_a_cutoff_go_to_the_earlier_split(spark, kind):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(BOUNDARY)], f"i int, t string")
    df = df.select("i", F.col("t").cast(kind).alias(DRAFT.time))
    rows = sp.chronological_split(df).orderBy("i").collect()
    assert [r.split for r in rows] == EXPECTED


def test_cutoffs_have_to_be_in_order(spark):
    df = matches(spark, [match(1, "2022-01-01")])
    with pytest.raises(ValueError, match="before the validation cutoff"):
        sp.chronological_split(df, "2022-01-01", "2022-01-01")


def test_missing_column_null_time_and_bad_text(spark):
    with pytest.raises(ValueError, match="missing required columns"):
        sp.chronological_split(spark.range(1))
    null = spark.createDataFrame([(None,)], f"{DRAFT.time} timestamp_ntz")
    with pytest.raises(PySparkException, match="missing values"):
        sp.chronological_split(null).collect()
    text = spark.createDataFrame([("not a date",)], f"{DRAFT.time} string")
    with pytest.raises(PySparkException):
        sp.chronological_split(text).collect()


def test_summary_counts_and_order(spark):
    df = matches(spark, [match(1, "2022-01-01", 1), match(2, "2022-01-02", 0), match(3, "2024-01-01", 1)])
    split = sp.chronological_split(df)
    rows = sp.split_summary(split).collect()
    assert [(r.split, r.matches, r.label_rate) for r in rows] == [("train", 2, 0.5), ("test", 1, 1.0)]
    assert rows[0].share == pytest.approx(2 / 3)
    assert [(r.split, r.matches) for r in sp.split_counts(split).collect()] == [("train", 2), ("validation", None), ("test", 1)]
    assert sp.of_split(split, "test").count() == 1
    assert [r.split for r in split.orderBy(split_rank()).collect()] == ["train", "train", "test"]


def test_split_checks_report_a_missing_period(spark):
    df = sp.chronological_split(matches(spark, [match(1, "2022-01-01"), match(2, "2024-01-01")]))
    checks = {r.check: r.passed for r in quality.split_checks(df).collect()}
    assert checks["All rows assigned"] and not checks["Expected split labels"]
    assert not checks["Training ends before validation"]
    with pytest.raises(ValueError, match="Expected split labels"):
        quality.require_passed(quality.split_checks(df), "split")


def test_flip_where_inverts_only_the_masked_rows(spark):
    df = matches(spark, [match(1, "2022-06-01", 1), match(2, "2023-06-01", 1), match(3, "2023-12-31", 0)])
    mask = F.col(DRAFT.time).between("2023-01-01", "2023-12-31")
    rows = df.withColumn(DRAFT.label, flip_where(F.col(DRAFT.label), mask)).orderBy(DRAFT.key).collect()
    assert [r[DRAFT.label] for r in rows] == [1, 0, 1]


def test_a_period_reads_its_years_only(spark, tmp_path):
    rows = [(i, datetime(1990 + i % 10, 1 + i % 12, 1 + i % 28, i % 24)) for i in range(500)] + [(1000, None)]
    df = spark.createDataFrame(rows, f"match_id bigint, {DRAFT.time} timestamp_ntz")
    write_by_year(df, str(tmp_path / "years"))
    stored = read_by_year(spark, str(tmp_path / "years"), df)
    first, last = datetime(1993, 4, 5, 4), datetime(1995, 8, 20)
    kept = sp.matches_between(stored, first, last)
    assert kept.columns == df.columns
    expected = sorted(i for i, t in rows if t is not None and first <= t <= last)
    assert sorted(r.match_id for r in kept.collect()) == expected
    assert sorted(r.match_id for r in sp.matches_between(df, str(first), str(last)).collect()) == expected
    plan = spark._jvm.PythonSQLUtils.explainString(kept._jdf.queryExecution(), "formatted")
    assert re.search(r"PartitionFilters: \[.*_year.* >= 1993.*_year.* <= 1995", plan)
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual", plan)
    with pytest.raises(ValueError):
        sp.matches_between(df, last, first)


def test_an_empty_table_by_year(spark, tmp_path):
    df = spark.createDataFrame([], f"match_id bigint, {DRAFT.time} timestamp_ntz")
    write_by_year(df, str(tmp_path / "years"))
    assert read_by_year(spark, str(tmp_path / "years"), df).count() == 0
