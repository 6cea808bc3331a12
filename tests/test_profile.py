from collections import Counter

import pytest
from pyspark.sql import functions as F

from draftline.operators import explore as ex, profile as prof, quality as q, roles
from draftline.schema import DRAFT, raw_struct

from fixtures import match, matches, raw_match, raw_matches


def test_roles_of_the_130_raw_columns(spark):
    empty = spark.createDataFrame([], raw_struct())
    assert len(empty.columns) == 130
    table = roles.with_role(prof.schema_table(empty)).collect()
    assert Counter(r.v1_decision for r in table) == {
        "exclude_leakage": 44, "exclude_leakage_risk": 30, "exclude_scope": 30, "use_feature": 11,
        "display_only": 10, "target_derivation_only": 3, "tracking_only": 1, "split_only": 1,
    }
    by_name = {r.column: r.column_group for r in table}
    assert by_name["radiant_player_1_name"] == "player identity" and by_name["radiant_team_name"] == "team identity"
    assert by_name["league"] == by_name["league_tier"] == "competition metadata"
    other = roles.with_role(spark.createDataFrame([("weather",)], "column string")).first()
    assert (other.column_group, other.v1_decision) == ("other", "review_before_use")


def test_null_profile_counts_and_rounds_half_to_even(spark):
    df = spark.range(800).select(F.when(F.col("id") > 0, 1).alias("a"), F.lit(1).alias("b.c"))
    rows = {r.column: r for r in prof.null_profile(df).collect()}
    assert rows["a"].null_count == 1 and rows["a"].null_percent == 0.12  # 0.125 %
    assert rows["b.c"].null_count == 0
    assert prof.missing_cells(df).first()[0] == 1


def test_repeated_keys_count_null_as_one_key(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,), (None,), (2,)], "k int")
    assert prof.repeated_keys(df, "k").first()[0] == 3


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(500).withColumn("x", F.col("id") * 2)
    one = prof.fingerprint(df).first()
    assert one == prof.fingerprint(df.repartition(7).orderBy(F.desc("id"))).first()
    assert one != prof.fingerprint(df.withColumn("x", F.when(F.col("id") == 3, 7).otherwise(F.col("x")))).first()
    assert one != prof.fingerprint(df.union(df.limit(1))).first()


def test_dataset_checks(spark):
    good = matches(spark, [match(1, "2022-01-01", 1), match(2, "2022-01-02", 0)])
    table = q.dataset_checks(good, DRAFT.key, expected_rows=2, expected_columns=24)
    assert table.count() == 9 and q.all_passed(table).first()[0]
    bad = matches(spark, [match(1, "2022-01-03", 1), match(1, "2022-01-02", 1, radiant=(0, None, 3, 3, 5))])
    table = {r.check: r for r in q.dataset_checks(bad, DRAFT.key, expected_rows=3).collect()}
    assert table["Expected rows loaded"].status == "REVIEW"
    assert table["Duplicate match IDs"].observed == "1"
    assert table["Missing cells"].observed == "2"
    assert table["Non-positive hero IDs"].observed == "1"
    assert table["Rows without 10 unique heroes"].observed == "1"
    assert not table["Binary target"].passed


def test_picks_and_frequencies(spark):
    df = matches(spark, [match(1, "2022-01-01", 1), match(2, "2022-01-02", 0, radiant=(1, 2, 3, 4, 11))])
    picks = ex.picks_long(df)
    assert picks.count() == 20 and set(picks.columns) == {"match_id", "hero_id", "hero_name", "side", "slot"}
    top = ex.top_picks(df, 3).collect()
    assert [(r.hero_id, r.picks, r.match_share) for r in top] == [(1, 2, 1.0), (2, 2, 1.0), (3, 2, 1.0)]
    sides = {(r.hero_name, r.side): r.picks for r in ex.side_frequency(df, 2).collect()}
    assert sides == {("Hero 1", "Radiant"): 2, ("Hero 2", "Radiant"): 2}
    example = ex.encoded_example(df).collect()
    assert [r.encoded_value for r in example] == [1] * 5 + [-1] * 5 and {r.match_id for r in example} == {1}


def test_target_distribution_keeps_absent_results(spark):
    rows = ex.target_distribution(matches(spark, [match(1, "2022-01-01", 1)])).collect()
    assert [(r.result, r.matches, r.share) for r in rows] == [("Radiant win", 1, 1.0), ("Dire win", 0, 0.0)]
    assert ex.majority_baseline(matches(spark, [match(1, "2022-01-01", 1)])).first()[0] == 1.0


def test_version_distribution_drops_null_groups(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, None)], "game_version_id int, game_version string")
    rows = ex.version_distribution(df).collect()
    assert [(r.game_version_id, r.matches, r.share) for r in rows] == [(1, 2, 0.5)]


def test_guards_and_summaries(spark):
    df = raw_matches(spark, [raw_match(1), raw_match(1, "2022-01-02"), raw_match(2)])
    summary = prof.table_summary(df).first()
    assert (summary.row_count, summary.unique_key_count) == (3, 2)
    assert {r.metric: r.value for r in prof.overview(df).collect()}["last_match"] == "2022-01-02 00:00:00"
    assert q.forbidden_features(["hero_1", "split"]) == ["split"]
    assert "winner_id" not in q.drop_forbidden(df).columns
    with pytest.raises(ValueError, match="x: missing required columns b, c"):
        q.require_columns(spark.createDataFrame([(1,)], "a int"), ["c", "a", "b"], "x")


def test_fingerprint_sees_a_value_move_next_to_a_null(spark):
    kind = "a int, b int, c string, d string"
    tables = [[(1, None, "x", "")], [(None, 1, "x", "")], [(1, None, "", "x")], [(1, None, None, "x")], [(1, None, "x|1:", "")]]
    prints = {prof.fingerprint(spark.createDataFrame(rows, kind)).first().hash_sum for rows in tables}
    assert len(prints) == len(tables)
    assert prof.fingerprint(spark.createDataFrame([], kind)).first() == (0, "0")


@pytest.mark.parametrize("keys", [
    [], [None], [None, None, 5], [-1, 0, 1, -1, 32767, 32768, 32769, -32768, -32769, None, None],
    [-(2**63), 2**63 - 1, 7, 7], [3] * 50, list(range(-40_000, 40_000, 3)) * 2,
])
def test_distinct_and_repeated_keys_in_bitmaps_and_without(spark, keys, monkeypatch):
    for kind in ("bigint", "int") if all(k is None or abs(k) < 2**31 for k in keys) else ("bigint",):
        df = spark.createDataFrame([(k,) for k in keys], f"k {kind}").repartition(3)
        different = len({k for k in keys if k is not None})
        for rows in (256, 10**9, 1):  # by density, never bitmaps, bitmaps wherever there is a row per range
            monkeypatch.setattr(prof, "_ROWS_PER_BITMAP", rows)
            assert prof.distinct_keys(df, "k").first()[0] == different
            assert prof.repeated_keys(df, "k").first()[0] == len(keys) - different - (None in keys)


def test_dense_keys_shuffle_bitmaps(spark):
    dense = spark.range(100_000).withColumnRenamed("id", "k")
    plan = prof.distinct_keys(dense, "k")._jdf.queryExecution().toString()
    assert "bitmap_construct_agg" in plan
    far = spark.range(100_000).selectExpr("xxhash64(id) AS k")
    assert "bitmap_construct_agg" not in prof.distinct_keys(far, "k")._jdf.queryExecution().toString()
