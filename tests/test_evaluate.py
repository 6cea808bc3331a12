import math
import random

import pytest

from draftline.operators import evaluate as ev


def scored(spark, rows):
    return spark.createDataFrame(rows, "model string, split string, label int, probability double")


def brute(rows):
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    clip = lambda p: min(max(p, ev.EPSILON), 1 - ev.EPSILON)
    loss = -sum(math.log(clip(p)) if y else math.log(1 - clip(p)) for y, p in rows) / len(rows)
    hit = sum((p >= 0.5) == bool(y) for y, p in rows) / len(rows)
    return hit, wins / (len(pos) * len(neg)), loss


def test_metrics_equal_brute_force_with_ties_and_extremes(spark):
    rng = random.Random(1)
    groups = {}
    for model in ("a", "b"):
        for split in ("train", "test"):
            grid = [0.0, 0.25, 0.5, 0.75, 1.0] if model == "a" else [rng.random() for _ in range(150)]
            groups[model, split] = [(rng.randint(0, 1), rng.choice(grid)) for _ in range(200)]
    df = scored(spark, [(m, s, y, p) for (m, s), rows in groups.items() for y, p in rows])
    got = {(r.model, r.split): r for r in ev.metrics(df).collect()}
    for key, rows in groups.items():
        hit, auc, loss = brute(rows)
        assert got[key].accuracy == pytest.approx(hit)
        assert got[key].roc_auc == pytest.approx(auc, abs=1e-12)
        assert got[key].log_loss == pytest.approx(loss)
        assert got[key].rows == 200


def test_one_score_for_all_rows_gives_half(spark):
    df = scored(spark, [("m", "s", int(i % 3 == 0), 0.3) for i in range(30)])
    assert ev.roc_auc(df).first()[0] == 0.5


def test_single_class_has_no_auc(spark):
    assert ev.metrics(scored(spark, [("m", "s", 1, 0.3)]), ["model"]).first().roc_auc is None


def test_threshold_is_inclusive_and_empty_cells_stay(spark):
    df = scored(spark, [("m", "s", 1, 0.5), ("m", "s", 1, 0.7)])
    cells = {(r.actual, r.predicted): r.rows for r in ev.confusion_matrix(df).collect()}
    assert cells == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 2}
    assert ev.accuracy(df).first()[0] == 1.0


def test_roc_points_end_at_one_and_enclose_the_auc(spark):
    rng = random.Random(2)
    rows = [("m", "s", rng.randint(0, 1), rng.choice([0.1, 0.2, 0.6, 0.9])) for _ in range(100)]
    df = scored(spark, rows)
    points = ev.roc_points(df).orderBy("fpr", "tpr").collect()
    assert (points[0].fpr, points[0].tpr) == (0.0, 0.0) and (points[-1].fpr, points[-1].tpr) == (1.0, 1.0)
    area = sum((b.fpr - a.fpr) * (a.tpr + b.tpr) / 2 for a, b in zip(points, points[1:]))
    assert area == pytest.approx(ev.roc_auc(df).first()[0])
