import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from draftline import DraftEncoder, DraftEncoderModel, prepare_features, validate_features
from draftline.operators import encode as enc
from draftline.schema import DRAFT, FORBIDDEN, STRICT_FORBIDDEN

from fixtures import match, matches


def cells(model, df):
    """Encoded rows as {key: {feature: value}}."""
    names = model.feature_names
    rows = model.transform(df).select(DRAFT.key, "features", "entries").collect()
    for r in rows:
        assert [(int(i), v) for i, v in zip(r.features.indices, r.features.values)] == [(e["index"], e["value"]) for e in r.entries]
        assert r.features.size == len(names)
    return {r[DRAFT.key]: {names[i]: v for i, v in zip(r.features.indices, r.features.values)} for r in rows}


def test_train_only_vocabulary_and_unknown_features(spark):
    df = matches(spark, [match(1, "2022-01-01"), match(2, "2023-01-01", radiant=(1, 2, 3, 4, 99), version=2)])
    model = DraftEncoder().fit(df.filter("match_id = 1"))
    validate_features(model.transform(df), model)
    a, b = (cells(model, df)[k] for k in (1, 2))
    assert a["hero_1"] == 1 and a["hero_6"] == -1 and a["patch_1"] == 1
    assert b["unknown_radiant_hero_count"] == 1 and "unknown_dire_hero_count" not in b
    assert "patch_1" not in b and b["patch_unknown"] == 1
    assert "hero_99" not in model.feature_names and "patch_2" not in model.feature_names
    names = [a["name"] for a in model.transform(df).schema["features"].metadata["ml_attr"]["attrs"]["numeric"]]
    assert names == model.feature_names == [
        *(f"hero_{i}" for i in range(1, 11)),
        "unknown_radiant_hero_count", "unknown_dire_hero_count", "patch_1", "patch_unknown",
    ]


def test_ids_are_ordered_as_numbers(spark):
    df = matches(spark, [match(1, "2022-01-01", radiant=(100, 20, 3, 4, 5), version=10), match(2, "2022-01-01", version=9)])
    model = DraftEncoder().fit(df)
    assert model.item_vocabulary == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 20, 100]
    assert model.version_vocabulary == [9, 10]


@pytest.mark.parametrize("span", [enc.LOOKUP_SPAN, 0])
def test_random_drafts_equal_brute_force(spark, monkeypatch, span):
    """Both lookups, with repeated, shared and unknown picks and NULL versions."""
    monkeypatch.setattr(enc, "LOOKUP_SPAN", span)
    rng = random.Random(3)
    train = [match(k, "2022-01-01", radiant=rng.sample(range(1, 21), 5), dire=rng.sample(range(21, 41), 5), version=rng.randint(1, 4)) for k in range(20)]
    later = [
        match(100 + k, "2023-01-01", radiant=rng.choices(range(1, 60), k=5), dire=rng.choices(range(1, 60), k=5), version=rng.choice([1, 3, 9, None]))
        for k in range(60)
    ]
    later.append(match(200, "2023-01-01", radiant=(2**62, -(2**62), 1, 2, 3), dire=(0, -1, 21, 22, 23), version=2**30))
    model = DraftEncoder().fit(matches(spark, train))
    known, versions = set(model.item_vocabulary), set(model.version_vocabulary)
    got = cells(model, matches(spark, later))
    for row in later:
        radiant, dire, expected = row[4:9], row[9:14], {}
        for side, picks, sign in (("radiant", radiant, 1.0), ("dire", dire, -1.0)):
            for p in picks:
                if p in known:
                    expected[f"hero_{p}"] = sign
            unknown = sum(p not in known for p in picks)
            if unknown:
                expected[f"unknown_{side}_hero_count"] = float(unknown)
        expected[f"patch_{row[2]}" if row[2] in versions else "patch_unknown"] = 1.0
        assert got[row[0]] == expected


def test_wide_view_has_one_byte_column_per_feature(spark):
    df = matches(spark, [match(1, "2022-01-01")])
    model = DraftEncoder().fit(df)
    wide = model.wide(df, keep=["match_id"])
    assert wide.columns == ["match_id", *model.feature_names]
    assert {f.dataType.simpleString() for f in wide.schema[1:]} == {"tinyint"}
    row = wide.first()
    assert row["hero_1"] == 1 and row["hero_10"] == -1 and row["patch_unknown"] == 0


def test_fit_rejects_bad_input(spark):
    good = match(1, "2022-01-01")
    with pytest.raises(ValueError, match="missing required columns"):
        DraftEncoder().fit(spark.createDataFrame([(1,)], "game_version_id int"))
    with pytest.raises(ValueError, match="empty"):
        DraftEncoder().fit(matches(spark, [good]).limit(0))
    with pytest.raises(ValueError, match="hero ID columns"):
        DraftEncoder().fit(matches(spark, [match(1, "2022-01-01", radiant=(None, 2, 3, 4, 5))]))
    with pytest.raises(ValueError, match="game_version_id"):
        DraftEncoder().fit(matches(spark, [match(1, "2022-01-01", version=None)]))
    with pytest.raises(RuntimeError, match="fitted"):
        DraftEncoderModel().transform(matches(spark, [good]))
    model = DraftEncoder().fit(matches(spark, [good]))
    with pytest.raises(PySparkException, match="missing values"):
        model.transform(matches(spark, [match(2, "2022-01-01", dire=(None, 7, 8, 9, 10))])).collect()


def test_prepared_rows_leave_out_leakage_columns(spark):
    rows = [match(101, "2022-01-01", 1), match(102, "2022-01-02", 0), match(103, "2023-01-01", 1), match(104, "2024-01-01", 0)]
    df = matches(spark, rows).withColumn("winner_id", F.col("match_id") % 2)
    prepared = prepare_features(df)
    assert not set(FORBIDDEN) & set(prepared.feature_names)
    got = prepared.frame.orderBy("match_id").select("match_id", "split", "radiant_win").collect()
    assert [r.split for r in got] == ["train", "train", "validation", "test"]
    assert [r.radiant_win for r in got] == [1, 0, 1, 0]
    assert prepared.frame.schema["radiant_win"].dataType.simpleString() == "tinyint"


def test_later_rows_do_not_change_the_encoder(spark):
    train = [match(1, "2022-01-01"), match(2, "2022-01-02", version=2)]
    one = prepare_features(matches(spark, train + [match(3, "2023-01-01"), match(4, "2024-01-01")]))
    two = prepare_features(matches(spark, train + [match(3, "2023-01-01", radiant=(90, 91, 92, 93, 94), version=7)]))
    assert one.feature_names == two.feature_names


def test_prepare_reports_each_problem(spark):
    with pytest.raises(ValueError, match="no training rows"):
        prepare_features(matches(spark, [match(1, "2024-01-01")]))
    with pytest.raises(ValueError, match="missing values"):
        prepare_features(matches(spark, [match(1, "2022-01-01"), match(2, "2022-01-01", win=None)]))
    with pytest.raises(ValueError, match="binary"):
        prepare_features(matches(spark, [match(1, "2022-01-01"), match(2, "2022-01-01", win=2)]))
    both_sides = match(2, "2022-01-02", radiant=(1, 2, 3, 4, 6))
    with pytest.raises(ValueError, match="exactly 10 picks"):
        prepare_features(matches(spark, [match(1, "2022-01-01"), both_sides]))
    null_time = matches(spark, [match(1, "2022-01-01"), match(2, "2022-01-01")]).withColumn(
        DRAFT.time, F.expr(f"IF(match_id = 2, NULL, {DRAFT.time})")
    )
    with pytest.raises(ValueError, match="missing values"):
        prepare_features(null_time)


def test_binary_target_accepts_booleans(spark):
    df = matches(spark, [match(1, "2022-01-01", 1), match(2, "2022-01-01", 0)]).withColumn(DRAFT.label, F.col(DRAFT.label).cast("boolean"))
    target = enc.binary_target(df)
    assert sorted(r[0] for r in target.select(DRAFT.label).collect()) == [0, 1]
    with pytest.raises(ValueError, match="missing required columns"):
        enc.binary_target(df.drop(DRAFT.label))


def test_a_pick_on_both_sides_keeps_the_second_sign_and_fails_the_check(spark):
    df = matches(spark, [match(1, "2022-01-01"), match(2, "2022-01-01", radiant=(6, 2, 3, 4, 5))])
    model = DraftEncoder().fit(df)
    assert cells(model, df)[2]["hero_6"] == -1
    with pytest.raises(ValueError, match="1 rows do not account"):
        validate_features(model.transform(df), model)


def test_feature_checks_name_the_failed_rule(spark):
    rows = [match(1, "2022-01-01", 1), match(2, "2023-01-01", 0), match(3, "2024-01-01", 1)]
    prepared = prepare_features(matches(spark, rows))
    table = enc.feature_checks(prepared.frame, prepared.encoder)
    assert table.count() == 9 and all(r.passed for r in table.collect())
    assert enc.pre_model_checks(prepared.frame, prepared.encoder).count() == 7
    bad = enc.feature_checks(prepared.frame, prepared.encoder, forbidden=[*STRICT_FORBIDDEN, "hero_1"])
    assert [r.status for r in bad.filter("not passed").collect()] == ["REVIEW"]


def test_saved_encoder_gives_the_same_rows(spark, tmp_path):
    df = matches(spark, [match(1, "2022-01-01"), match(2, "2022-01-02", radiant=(11, 2, 3, 4, 5))])
    model = DraftEncoder().fit(df.limit(1))
    model.write().overwrite().save(str(tmp_path / "encoder"))
    loaded = DraftEncoderModel.load(str(tmp_path / "encoder"))
    assert loaded.feature_names == model.feature_names
    assert cells(loaded, df) == cells(model, df)


def test_fitted_encoder_also_encodes_a_stream(spark, tmp_path):
    """`transform` is stateless, so matches can be encoded as they arrive."""
    df = matches(spark, [match(1, "2022-01-01"), match(2, "2022-01-02", radiant=(11, 2, 3, 4, 5))])
    model = DraftEncoder().fit(df.filter("match_id = 1"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = (
        model.transform(stream).select("match_id", "entries").writeStream.format("parquet")
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    key = lambda r: r.match_id
    got = sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=key)
    assert got == sorted(model.transform(df).select("match_id", "entries").collect(), key=key)


def test_joined_lookup_sends_the_vocabulary_not_the_cells(spark, tmp_path):
    """Rows that next to no bytes in files stand for: their unfolded cells are the larger side all the same."""
    one = matches(spark, [match(1, "2022-01-01")])
    one.crossJoin(spark.range(200_000).select(F.col("id").alias("_n"))).drop("_n").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    model = DraftEncoderModel()._set(items=list(range(1, 60_001)), versions=[1], lookupSpan=0)
    placed = model._joined_positions(rows, DRAFT.pick_ids(), model.item_vocabulary, [f"_p{i}" for i in range(10)])
    plan = placed._jdf.queryExecution().sparkPlan().toString()
    assert "BuildLeft" not in plan and "BroadcastHashJoin [_value" in plan
    assert placed.select("_p0", "_p9").distinct().collect() == [(0, 9)]


def method_sizes(df, capsys):
    """Bytes of the largest generated method of every subtree; the JVM compiles none of more than 8000."""
    capsys.readouterr()
    df.explain(mode="codegen")
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]


def test_encoding_is_short_enough_to_be_compiled(spark, tmp_path, capsys):
    matches(spark, [match(1, "2022-01-01"), match(2, "2023-01-01", radiant=(1, 2, 3, 4, 99))]).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    sizes = method_sizes(enc.encode_with_train_vocabulary(rows).frame.drop("features"), capsys)
    assert sizes and max(sizes) <= 8000
