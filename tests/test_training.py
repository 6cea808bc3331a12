import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from draftline import prepare_features, run_training, train_baselines
from draftline.operators import evaluate as ev, models as mod
from draftline.sources import write_csv

from fixtures import match, matches, signal_rows


def newton(x, y, penalty=1.0):
    """Reference solution: all weights, bias included, are penalised."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (p - y) + penalty * w)
        w -= step
        if abs(step).max() < 1e-12:
            break
    return w


@pytest.fixture(scope="module")
def run(spark):
    return train_baselines(prepare_features(matches(spark, signal_rows())))


def test_gate_passes_and_test_is_evaluated(run):
    assert run.validation_gate_passed
    assert set(run.models) == {"Dummy prior", "Logistic regression"}
    rows = mod.ordered_metrics(run).collect()
    assert [(r.model, r.split) for r in rows] == [
        ("Dummy prior", "train"), ("Dummy prior", "validation"),
        ("Logistic regression", "train"), ("Logistic regression", "validation"),
        ("Dummy prior", "test"), ("Logistic regression", "test"),
    ]
    auc = {(r.model, r.split): r.roc_auc for r in rows}
    assert auc["Logistic regression", "validation"] > 0.99 and auc["Logistic regression", "test"] > 0.99
    assert auc["Dummy prior", "test"] == 0.5


def test_gate_stops_before_the_test_split(spark):
    stopped = train_baselines(prepare_features(matches(spark, signal_rows(flip_validation=True))))
    assert not stopped.validation_gate_passed
    assert {r.split for r in stopped.metrics.collect()} == {"train", "validation"}
    gate = mod.gate_checks(stopped.metrics).collect()
    assert {r.status for r in gate} == {"STOP"}
    summary = mod.run_summary(stopped)
    row = summary.gate.first()
    assert row.gate == "STOP" and not row.test_evaluated and "gate" in row.test_skipped_because


def test_skipping_the_test_split(spark):
    run = train_baselines(prepare_features(matches(spark, signal_rows())), evaluate_test=False)
    assert run.validation_gate_passed and run.metrics.filter("split = 'test'").count() == 0
    assert mod.run_summary(run).gate.first().test_skipped_because == "test evaluation was switched off"


def test_summary_and_coefficients(run):
    summary = mod.run_summary(run)
    assert [(r.split, r.matches) for r in summary.split_counts.collect()] == [("train", 40), ("validation", 20), ("test", 20)]
    shape = summary.shape.first()
    assert (shape.rows, shape.feature_columns, shape.known_items, shape.known_versions) == (80, 14, 10, 1)
    table = mod.item_coefficients(run)
    assert table.count() == 10
    top = mod.strongest(table, 2).collect()
    assert [r.coefficient > 0 for r in top] == [False, False, True, True]
    assert {r.hero_name for r in top} <= {f"Hero {i}" for i in range(1, 11)}
    gaps = ev.metric_gaps(run.metrics, mod.LOGISTIC, mod.PRIOR).first()
    assert gaps.validation_roc_auc_gain == pytest.approx(0.5) and gaps.validation_test_roc_auc_gap == pytest.approx(0)
    assert [r.roc_auc for r in ev.by_auc(run.metrics).collect()] == [1.0, 1.0, 1.0, 0.5, 0.5, 0.5]


def test_weights_equal_a_newton_solution(spark):
    rng = np.random.default_rng(5)
    x = rng.choice([-1.0, 0.0, 1.0], size=(400, 6), p=[0.2, 0.6, 0.2])
    y = (x @ np.array([1.0, -2.0, 0.5, 0.0, 0.3, 0.0]) + 0.7 + rng.logistic(size=400) > 0).astype(int)
    rows = [(int(label), Vectors.sparse(6, [(i, v) for i, v in enumerate(row) if v])) for row, label in zip(x.tolist(), y)]
    df = spark.createDataFrame(rows, ["label", "features"])
    features = F.col("features").alias("features", metadata={"ml_attr": {"num_attrs": 6}})
    for C in (1.0, 0.1):
        model = mod.fit_logistic(df.select("label", features), C=C)
        got, bias = mod.weights(model)
        want = newton(np.c_[x, np.ones(400)], y, penalty=1 / C)
        assert np.allclose([*got, bias], want, atol=1e-4)
    scored = model.transform(df.select("label", features)).select("features", "probability").collect()
    for r in scored[:20]:
        z = r.features.toArray() @ np.array(got) + bias
        assert r.probability[1] == pytest.approx(1 / (1 + np.exp(-z)))


def test_guards(spark):
    train = [match(1, "2022-01-01", 1), match(2, "2022-01-02", 0)]
    validation = [match(3, "2023-01-01", 1), match(4, "2023-01-02", 0)]
    with pytest.raises(ValueError, match="empty splits: test"):
        train_baselines(prepare_features(matches(spark, train + validation)))
    with pytest.raises(ValueError, match="both classes in: test"):
        train_baselines(prepare_features(matches(spark, train + validation + [match(5, "2024-01-01", 1)])))
    with pytest.raises(ValueError, match="training rows"):
        mod.require_trainable({"train": (2, 2), "validation": (2, 1), "test": (2, 1)})
    with pytest.raises(ValueError, match="empty table"):
        mod.ClassPrior(labelCol="radiant_win").fit(matches(spark, train).limit(0))


def test_saved_models_score_alike(spark, run, tmp_path):
    from pyspark.ml import PipelineModel

    for name, kind in ((mod.LOGISTIC, PipelineModel), (mod.PRIOR, mod.ClassPriorModel)):
        run.models[name].write().overwrite().save(str(tmp_path / "model"))
        loaded = kind.load(str(tmp_path / "model"))
        frame = run.prepared.frame.select("match_id", "features").orderBy("match_id")
        assert loaded.transform(frame).select("probability").collect() == run.models[name].transform(frame).select("probability").collect()


def test_run_training_from_csv(spark, tmp_path):
    path, out = str(tmp_path / "sample"), str(tmp_path / "metrics")
    write_csv(matches(spark, signal_rows()).withColumn("radiant_win", F.col("radiant_win").cast("boolean")), path)
    run = run_training(spark, path, metrics_path=out)
    assert run.validation_gate_passed
    saved = spark.read.option("header", True).csv(out)
    assert saved.columns == ["model", "split", "accuracy", "roc_auc", "log_loss"] and saved.count() == 6
    with pytest.raises(FileNotFoundError):
        run_training(spark, str(tmp_path / "nowhere"))


def test_evaluate_model_agrees_with_the_scores_from_entries(run):
    frame = run.prepared.frame
    expected = {(r.model, r.split): (r.accuracy, r.roc_auc, r.log_loss) for r in run.metrics.collect()}
    for name, model in run.models.items():
        for r in mod.evaluate_model(model, frame, name).collect():
            assert (r.accuracy, r.roc_auc, r.log_loss) == pytest.approx(expected[name, r.split], abs=1e-9)


def test_the_gradient_vanishes_for_every_feature(run):
    values, bias = mod.weights(run.models[mod.LOGISTIC])
    train = run.prepared.frame.filter("split = 'train'").select("features", "radiant_win").collect()
    x = np.array([[*r.features.toArray(), 1.0] for r in train])
    w = np.array([*values, bias])
    p = 1 / (1 + np.exp(-x @ w))
    gradient = w + x.T @ (p - np.array([r.radiant_win for r in train], dtype=float))
    assert abs(gradient).max() < 1e-3


def test_rows_are_encoded_once(run):
    plan = run.prepared.frame._jdf.queryExecution().optimizedPlan().toString()
    assert "array_except" not in plan  # what training and scoring read is stored


def test_stored_tables_follow_their_source_and_go_at_the_end(spark, tmp_path):
    import os

    from draftline.sources import storage

    source = str(tmp_path / "source")
    build = lambda: spark.read.parquet(source)
    spark.range(3).write.parquet(source)
    first = storage.stored_once(spark, source, "t", build)
    assert first.inputFiles() == storage.stored_once(spark, source, "t", build).inputFiles()
    spark.range(5).write.mode("overwrite").parquet(source)
    assert storage.stored_once(spark, source, "t", build).count() == 5
    folder = storage.checkpoint_folder(spark)
    place, kept, stored = str(tmp_path / "shared"), list(storage._folders), dict(storage._stored)
    os.makedirs(f"{place}/x")
    try:  # the session of the tests goes on, so only a folder of this test is dropped
        storage._folders[:] = [place]
        storage.drop_stored()
        assert not os.path.exists(place) and not storage._stored
    finally:
        storage._folders[:] = kept
        storage._stored.update(stored)
    assert folder in kept


def test_both_solvers_reach_the_optimum(spark, run):
    train = run.prepared.frame.filter("split = 'train'")
    weights = [mod.weights(mod.fit_logistic(train, label="radiant_win", solver=s)) for s in ("newton", "lbfgs")]
    assert np.allclose(weights[0][0] + [weights[0][1]], weights[1][0] + [weights[1][1]], atol=1e-4)
    slopes = mod.stationarity(run).orderBy("index").collect()
    assert [r.feature for r in slopes] == [*run.prepared.feature_names, "bias"]
    assert max(abs(r.slope) for r in slopes) < 1e-9
    with pytest.raises(ValueError, match="unknown solver"):
        mod.fit_logistic(train, label="radiant_win", solver="sgd")


def test_slopes_show_a_model_off_the_optimum(spark, run):
    from dataclasses import replace

    train = run.prepared.frame.filter("split = 'train'")
    off = replace(run, models=run.models | {mod.LOGISTIC: mod.fit_logistic(train, label="radiant_win", C=0.01)})
    assert max(abs(r.slope) for r in mod.stationarity(off).collect()) > 0.1
    assert max(abs(r.slope) for r in mod.stationarity(off, C=0.01).collect()) < 1e-9


def test_newton_takes_few_passes(spark, run, monkeypatch):
    fits = []
    fit = mod.LinearRegression.fit
    monkeypatch.setattr(mod.LinearRegression, "fit", lambda self, *a: fits.append(1) or fit(self, *a))
    mod.fit_logistic(run.prepared.frame.filter("split = 'train'"), label="radiant_win")
    assert 0 < len(fits) <= 15


def test_wide_tables_and_steps_that_do_not_settle_take_lbfgs(spark, run, monkeypatch):
    train = run.prepared.frame.filter("split = 'train'")
    want = mod.weights(mod.fit_logistic(train, label="radiant_win", solver="lbfgs"))
    monkeypatch.setattr(mod, "NEWTON_WIDTH", 3)
    assert mod.weights(mod.fit_logistic(train, label="radiant_win")) == want
    monkeypatch.undo()
    monkeypatch.setattr(mod, "_SETTLED", -1.0)
    assert mod.weights(mod.fit_logistic(train, label="radiant_win")) == want


def test_slopes_score_a_row_once(run):
    """The error of a row is found before its cells are unfolded."""
    plan = mod.stationarity(run)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.index("generate") < plan.index("exp(") and "exp(" not in plan[: plan.index("generate")]
