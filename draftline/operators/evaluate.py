"""Model quality from scored rows: accuracy, exact ROC-AUC, log loss, ROC points, confusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import predicted_class, split_rank
from ..schema import DRAFT
from ..sources.storage import materialize
from .ranks import prefix_sums, with_range_bucket

GROUPS = ("model", "split")
# Fixed value: double-precision machine epsilon, the clip of probabilities in the log loss.
EPSILON = 2.220446049250313e-16


def class_prior(df: DataFrame, label: str = DRAFT.label) -> DataFrame:
    """Mean label, one row."""
    return df.agg(F.avg(F.col(label).cast("double")).alias("prior"))


def score_counts(scored: DataFrame, groups: Sequence[str] = GROUPS, score: str = "probability", label: str = "label") -> DataFrame:
    """Positives and negatives per group and different score.

    Every metric below depends on these counts alone. They are summed inside each task before the
    shuffle, so a score shared by all rows, as the class prior's, stays one row per task.
    """
    positive = F.col(label).cast("bigint")
    return scored.groupBy(*groups, score).agg(F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg"))


def _log_loss(score: Column) -> Column:
    p = F.greatest(F.lit(EPSILON), F.least(F.lit(1.0 - EPSILON), score))
    return -(F.col("pos") * F.ln(p) + F.col("neg") * F.ln(1.0 - p))


def metrics(scored: DataFrame, groups: Sequence[str] = GROUPS, score: str = "probability", label: str = "label") -> DataFrame:
    """Rows, accuracy at 0.5, exact ROC-AUC with half credit for ties, and log loss per group.

    AUC is NULL where a group has one class only. The rows are scored once: their counts are
    stored, as ranking reads them several times.
    """
    ranked = prefix_sums(materialize(score_counts(scored, groups, score, label)), score, ["neg"], groups)
    p, pos, neg = F.col(score), F.col("pos"), F.col("neg")
    right = F.when(predicted_class(p) == 1, pos).otherwise(neg)
    won = pos * (F.col("cum_neg") - neg / F.lit(2.0))  # negatives below, plus half of the tied ones
    rows = F.sum(pos + neg)
    return ranked.groupBy(*groups).agg(
        rows.alias("rows"),
        (F.sum(right) / rows).alias("accuracy"),
        F.try_divide(F.sum(won), F.sum(pos).cast("double") * F.sum(neg)).alias("roc_auc"),
        (F.sum(_log_loss(p)) / rows).alias("log_loss"),
    )


def accuracy(scored: DataFrame, groups: Sequence[str] = (), score: str = "probability", label: str = "label") -> DataFrame:
    hit = (predicted_class(F.col(score)) == F.col(label).cast("int")).cast("double")
    return scored.groupBy(*groups).agg(F.avg(hit).alias("accuracy"))


def log_loss(scored: DataFrame, groups: Sequence[str] = (), score: str = "probability", label: str = "label") -> DataFrame:
    p = F.greatest(F.lit(EPSILON), F.least(F.lit(1.0 - EPSILON), F.col(score)))
    y = F.col(label).cast("double")
    return scored.groupBy(*groups).agg(F.avg(-(y * F.ln(p) + (1.0 - y) * F.ln(1.0 - p))).alias("log_loss"))


def roc_auc(scored: DataFrame, groups: Sequence[str] = (), score: str = "probability", label: str = "label") -> DataFrame:
    return metrics(scored, groups, score, label).select(*groups, "roc_auc")


def _corners(ranked: DataFrame, groups: Sequence[str], score: str) -> DataFrame:
    """Ranked counts without those whose next lower score moves the curve just as they do.

    The first and last score of a group stay. Neighbours are found inside ranges of the score; one row
    per range carries the first counts of the range below.
    """
    by = [*groups, "_bucket"]
    cell, ranged = F.struct("pos", "neg"), with_range_bucket(ranked, score)
    heads = ranged.groupBy(*by).agg(F.max_by(cell, score).alias("_head"))
    below = F.lead("_head").over(Window.partitionBy(*groups).orderBy(F.col("_bucket").desc()))
    heads = heads.select(*[F.col(c).alias(f"_on_{c}") for c in by], below.alias("_below"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    inside = F.lead(cell).over(Window.partitionBy(*by).orderBy(F.col(score).desc()))
    joined = ranged.withColumn("_next", inside).join(heads, same)
    following = F.coalesce("_next", "_below")
    first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
    return joined.filter(first | ~cell.eqNullSafe(following)).select(*ranked.columns)


def roc_points(
    scored: DataFrame,
    groups: Sequence[str] = (),
    score: str = "probability",
    label: str = "label",
    drop_collinear: bool = False,
) -> DataFrame:
    """False and true positive rate at every different score, from the highest down, after (0, 0).

    Points on a straight line are kept unless `drop_collinear`; the (0, 0) row has an infinite threshold.
    """
    counts = materialize(score_counts(scored, groups, score, label))
    ranked = prefix_sums(counts, score, ["pos", "neg"], groups, descending=True)
    if drop_collinear:
        ranked = _corners(materialize(ranked), groups, score)
    sizes = counts.groupBy(*groups).agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    if groups:
        joined = ranked.join(sizes, list(groups))
    else:
        joined = ranked.withColumns({c: sizes.select(c).scalar() for c in ("_pos", "_neg")})
    points = joined.select(
        *groups,
        F.col(score).alias("threshold"),
        F.try_divide(F.col("cum_neg").cast("double"), F.col("_neg")).alias("fpr"),
        F.try_divide(F.col("cum_pos").cast("double"), F.col("_pos")).alias("tpr"),
    )
    origin = sizes.select(
        *groups, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def confusion_matrix(scored: DataFrame, groups: Sequence[str] = (), score: str = "probability", label: str = "label") -> DataFrame:
    """Rows per actual and predicted class; all four cells, zeros included."""
    actual, predicted = F.col(label).cast("int"), predicted_class(F.col(score))
    counts = scored.groupBy(*groups).agg(
        *[F.count_if((actual == a) & (predicted == p)).alias(f"_{a}{p}") for a in (0, 1) for p in (0, 1)]
    )
    cells = [
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"_{a}{p}").alias("rows"))
        for a in (0, 1)
        for p in (0, 1)
    ]
    return counts.select(*groups, F.inline(F.array(*cells)))


def metric_gaps(table: DataFrame, candidate: str, baseline: str) -> DataFrame:
    """Differences of each metric, one row: candidate minus baseline per split, and the candidate's
    validation minus test. A split without metrics gives NULL."""
    columns = ("accuracy", "roc_auc", "log_loss")

    def value(model: str, split: str, metric: str) -> Column:
        return F.max(F.when((F.col("model") == model) & (F.col("split") == split), F.col(metric)))

    gaps = []
    for metric in columns:
        for split in ("validation", "test"):
            gain = value(candidate, split, metric) - value(baseline, split, metric)
            gaps.append(gain.alias(f"{split}_{metric}_gain"))
        drop = value(candidate, "validation", metric) - value(candidate, "test", metric)
        gaps.append(drop.alias(f"validation_test_{metric}_gap"))
    return table.agg(*gaps)


def by_auc(table: DataFrame) -> DataFrame:
    """Metric rows from the best ROC-AUC down."""
    return table.orderBy(F.col("roc_auc").desc_nulls_last(), split_rank(), "model")


def rounded(table: DataFrame, decimals: int = 4) -> DataFrame:
    return table.withColumns({c: F.bround(c, decimals) for c in ("accuracy", "roc_auc", "log_loss")})
