import json
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from draftline import run_curation
from draftline.operators import profile as prof, ranks
from draftline.schema import DRAFT, raw_struct
from draftline.sources import (
    FILE_POSITION,
    materialize,
    read_curated,
    read_matches,
    read_versions,
    require_sources,
    with_file_position,
    write_csv,
)
from draftline.sources.match_view import match_view

from fixtures import RAW, raw_match


def nanos_file(path, rows):
    """Raw matches with nanosecond times, as the published file has them."""
    names = [c.split()[0] for c in RAW.split(", ")]
    columns = dict(zip(names, zip(*rows)))
    arrays = {
        n: pa.array(v, pa.timestamp("ns") if n == DRAFT.time else pa.string() if n in DRAFT.pick_names() else pa.int32() if n == DRAFT.version else pa.int64())
        for n, v in columns.items()
    }
    pq.write_table(pa.table(arrays), path, version="2.6")


def test_nanosecond_times_do_not_depend_on_the_session_zone(spark, tmp_path):
    path = str(tmp_path / "raw.parquet")
    nanos_file(path, [raw_match(1, "2022-03-27 02:30:00"), raw_match(2, "2011-06-19 00:00:00.123456")])
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", name)
            df = read_matches(spark, path)
            assert df.schema[DRAFT.time].dataType.simpleString() == "timestamp_ntz"
            times = {r[0]: r[1] for r in df.select(DRAFT.key, DRAFT.time).collect()}
            assert times == {1: datetime(2022, 3, 27, 2, 30), 2: datetime(2011, 6, 19, 0, 0, 0, 123456)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_curation_job_writes_three_outputs(spark, tmp_path):
    raw, versions = str(tmp_path / "raw.parquet"), str(tmp_path / "versions.csv")
    rows = [raw_match(k, f"2022-01-{k:02d} 10:00:00", winner=100 if k % 2 else 200, version=1 + k % 2, names=['say "hi", 1', *[f"H{i}" for i in range(9)]]) for k in range(1, 21)]
    nanos_file(raw, rows + [raw_match(30, winner=None)])
    with open(versions, "w") as f:
        f.write("id,name,start_date_time\n1,7.37,2024-08-01 00:00:00\n")
    out = {n: str(tmp_path / n) for n in ("sample", "inventory", "metadata")}
    result = run_curation(spark, raw, versions, out["sample"], out["inventory"], out["metadata"], rows=15)

    sample = read_curated(spark, out["sample"])
    assert sample.columns == DRAFT.curated_columns() and sample.count() == 15
    assert {f.name: f.dataType for f in sample.schema}[DRAFT.label].simpleString() == "boolean"
    got = sample.orderBy(DRAFT.key).collect()
    assert all(r["radiant_player_1_hero"] == 'say "hi", 1' for r in got)
    assert {r[DRAFT.version_name] for r in got} == {"7.37", None}
    assert [r[DRAFT.time] for r in got] == [datetime(2022, 1, r[DRAFT.key], 10) for r in got]
    placed = with_file_position(sample)
    file, block, row = FILE_POSITION
    assert ranks.order_breaks(placed, DRAFT.time, row, [file, block]).first().breaks == 0
    text = "".join(r.value + "\n" for r in spark.read.text(out["sample"]).collect())
    assert "2022-01-" in text and "T10:00" not in text

    inventory = spark.read.option("header", True).csv(out["inventory"])
    assert inventory.columns == ["column", "type", "null_count", "null_percent", "column_group", "v1_decision", "reason"]
    assert inventory.count() == 26
    record = json.loads("".join(r.value for r in spark.read.text(out["metadata"]).collect()))
    assert record["source"]["raw_rows"] == 21 and record["sample"]["actual_rows"] == 15
    assert record["sample"]["columns"] == DRAFT.curated_columns() and record["sample"]["requested_rows"] == 15
    assert record["sample"]["content_hash"] == prof.fingerprint(sample).first().hash_sum
    assert result.metadata.first()["sample"]["unique_matches"] == 15


def test_missing_sources_are_all_named(spark, tmp_path):
    present = str(tmp_path / "here")
    spark.range(1).write.parquet(present)
    with pytest.raises(FileNotFoundError, match="nowhere_1.*nowhere_2"):
        require_sources(spark, [str(tmp_path / "nowhere_1"), present, str(tmp_path / "nowhere_2")])
    require_sources(spark, [present])


def test_csv_is_typed_by_name_and_strict(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("radiant_win,note,match_start_date_time,game_version_id\nTrue,a,2022-01-01 00:00:00,7\n")
    row = read_curated(spark, str(path)).first()
    assert row.radiant_win is True and row.note == "a" and row.match_start_date_time == datetime(2022, 1, 1) and row.game_version_id == 7
    path.write_text("match_start_date_time,game_version_id\nnever,7\n")
    with pytest.raises(Exception, match="never"):
        read_curated(spark, str(path)).collect()
    path.write_text("id,start_date_time\n1,2022-01-01 00:00:00\n")
    with pytest.raises(ValueError, match="missing required columns name"):
        read_versions(spark, str(path))


def test_sorted_check_sees_an_unsorted_export(spark, tmp_path):
    df = spark.createDataFrame([(i, datetime(2022, 1, 1 + (i * 7) % 20)) for i in range(20)], "i int, t timestamp_ntz")
    write_csv(df.coalesce(1), str(tmp_path / "out"))
    back = with_file_position(spark.read.option("header", True).schema("i int, t timestamp_ntz").csv(str(tmp_path / "out")))
    file, block, row = FILE_POSITION
    assert ranks.order_breaks(back, "t", row, [file, block]).first().breaks > 0


def test_materialized_rows_have_no_lineage(spark):
    df = materialize(spark.range(10).withColumn("x", F.rand(1)))
    assert df.collect() == df.collect()
    assert "Range" not in df._jdf.queryExecution().executedPlan().toString()


def test_raw_layout_has_130_columns():
    kinds = [f.dataType.simpleString() for f in raw_struct()]
    assert {k: kinds.count(k) for k in set(kinds)} == {"string": 56, "bigint": 34, "smallint": 32, "int": 5, "timestamp_ntz": 3}


def test_matches_of_one_row_group_are_derived_by_many_tasks(spark, tmp_path):
    """Also where a third of the rows share one key."""
    key = "CASE WHEN id % 3 = 0 THEN 97 ELSE id END"
    orders = spark.range(250_000).selectExpr(f"{key} AS o_orderkey", "id % 7 AS o_custkey", "TIMESTAMP_NTZ '1997-01-01' AS o_orderdate")
    orders.coalesce(1).write.parquet(path := str(tmp_path / "orders.parquet"))
    (file,) = (tmp_path / "orders.parquet").glob("*.parquet")
    assert pq.ParquetFile(file).num_row_groups == 1
    view = match_view(spark, str(tmp_path))
    held = [r["count"] for r in view.groupBy(F.input_file_name()).count().collect()]
    assert max(held) < 100_000
    assert sum(held) == 250_000 + spark.read.parquet(path).filter("o_orderkey % 97 = 0").count()
