"""Class prior and L2 logistic regression, training guards, validation gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import LinearRegression
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import item_of_feature
from ..schema import DRAFT, SPLITS, DraftSchema
from ..sources.storage import materialize
from .curate import broadcast_if_small
from .encode import PreparedFeatures
from .evaluate import metrics, rounded
from .explore import picks_long
from .quality import check_table
from .split import split_counts

# Model names in the metric table.
PRIOR = "Dummy prior"
LOGISTIC = "Logistic regression"

_BIAS, _WITH_BIAS, _WEIGHT = "_bias", "_features_and_bias", "_weight"


class _PriorParams(DefaultParamsReadable, DefaultParamsWritable):
    labelCol = Param(Params._dummy(), "labelCol", "0/1 label column", TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "output: vector of both probabilities", TypeConverters.toString)


class ClassPrior(Estimator, _PriorParams):
    """Learns the mean label and predicts it for every row."""

    def __init__(self, labelCol: str = "label", probabilityCol: str = "probability"):
        super().__init__()
        self._set(labelCol=labelCol, probabilityCol=probabilityCol)

    def _fit(self, df: DataFrame) -> "ClassPriorModel":
        prior = df.agg(F.avg(F.col(self.getOrDefault(self.labelCol)).cast("double"))).first()[0]
        if prior is None:
            raise ValueError("the class prior cannot be learned from an empty table")
        return self._copyValues(ClassPriorModel(prior))


class ClassPriorModel(Model, _PriorParams):
    prior = Param(Params._dummy(), "prior", "probability of label 1", TypeConverters.toFloat)

    def __init__(self, prior: float = 0.5, probabilityCol: str = "probability"):
        super().__init__()
        self._set(prior=prior, probabilityCol=probabilityCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        p = F.lit(self.getOrDefault(self.prior))
        return df.withColumn(self.getOrDefault(self.probabilityCol), array_to_vector(F.array(1.0 - p, p)))


def fit_logistic(
    train: DataFrame,
    features: str = "features",
    label: str = "label",
    C: float = 1.0,
    max_iter: int = 1000,
    tol: float = 1e-10,
    rows: int | None = None,
    solver: str = "newton",
) -> PipelineModel:
    """L2 logistic regression that minimises `|w|^2 / 2 + C * sum(loss)`, bias inside `|w|`.

    "newton" sums normal equations in one pass per step and needs a handful of steps; it is the choice up to
    `NEWTON_WIDTH` features, whose square the driver holds. Wider tables, and fits whose steps do not settle,
    go to "lbfgs", which takes some hundred passes to the same solution.

    Spark never penalises its own intercept, so the bias is a constant feature instead. "lbfgs" also ignores a
    feature that never varies, so one all-zero row is added there, as heavy as all training rows together: it
    gives the bias feature a spread, and its share of the total weight is undone in the penalty.
    """
    if solver not in ("newton", "lbfgs"):
        raise ValueError(f"unknown solver {solver!r}")
    with_bias = SQLTransformer(statement=f"SELECT *, CAST(1.0 AS DOUBLE) AS {_BIAS} FROM __THIS__")
    assemble = VectorAssembler(inputCols=[features, _BIAS], outputCol=_WITH_BIAS)
    cells = [F.col(label).cast("double").alias(label), features]
    assembled = assemble.transform(with_bias.transform(train.select(*cells))).select(label, _WITH_BIAS)
    width = assembled.schema[_WITH_BIAS].metadata["ml_attr"]["num_attrs"]
    if solver == "newton" and width <= NEWTON_WIDTH:
        steps = _newton(materialize(assembled), label, C, width)
        if steps is not None:
            probability = SQLTransformer(statement=f"SELECT *, 1.0 / (1.0 + exp({_MARGIN})) AS _no, 1.0 / (1.0 + exp(-{_MARGIN})) AS _yes FROM __THIS__")
            both = VectorAssembler(inputCols=["_no", "_yes"], outputCol="probability")
            return PipelineModel(stages=[with_bias, assemble, steps, probability, both])
    if rows is None:
        rows = train.count()
    weighted = assembled.withColumn(_WEIGHT, F.lit(1.0))
    anchor = train.sparkSession.createDataFrame([(0.0, Vectors.sparse(width, [], []), float(rows))], weighted.schema)
    anchor = anchor.coalesce(1)  # one row; each empty task would cost time in every iteration
    model = LogisticRegression(
        featuresCol=_WITH_BIAS,
        labelCol=label,
        weightCol=_WEIGHT,
        fitIntercept=False,
        standardization=False,
        elasticNetParam=0.0,
        regParam=1.0 / (C * 2.0 * rows),
        maxIter=max_iter,
        tol=tol,
    ).fit(weighted.unionByName(anchor))
    return PipelineModel(stages=[with_bias, assemble, model])


#: Widest table, bias included, that Spark's normal equations take.
NEWTON_WIDTH = 4096
_MARGIN = "_margin"
_SETTLED = 1e-6


def _newton(table: DataFrame, label: str, C: float, width: int, most: int = 15):
    """Newton steps as weighted regressions, one pass each; the last one's model, or None if they do not settle.

    A step regresses margin + (label - p) / v on the features with weights v = p (1 - p): the solution of its
    normal equations is the next weight vector. The penalty is one more row per feature, which asks for zero
    with weight 1 / C; so no feature is without spread, and Spark's own penalty, which depends on the
    spread of the target, is not needed. Errors square from step to step: one shorter than 1e-6 is the last.
    """
    y, margin = F.col(label), F.col(_MARGIN)
    p = 1.0 / (1.0 + F.exp(-margin))
    v = F.greatest(p * (1.0 - p), F.lit(1e-12))
    schema = T.StructType([table.schema[label], table.schema[_WITH_BIAS], T.StructField(_WEIGHT, T.DoubleType())])
    zeros = [(0.0, Vectors.sparse(width, [j], [1.0]), 1.0 / C) for j in range(width)]
    penalty = materialize(table.sparkSession.createDataFrame(zeros, schema).coalesce(1))
    regression = LinearRegression(
        featuresCol=_WITH_BIAS, labelCol=label, weightCol=_WEIGHT, predictionCol=_MARGIN, fitIntercept=False, solver="normal"
    )
    model, last = None, np.zeros(width)
    for _ in range(most):
        placed = model.transform(table) if model is not None else table.withColumn(_MARGIN, F.lit(0.0))
        working = placed.select((margin + (y - p) / v).alias(label), _WITH_BIAS, v.alias(_WEIGHT))
        model = regression.fit(working.unionByName(penalty))
        now = model.coefficients.toArray()
        if not np.isfinite(now).all():
            return None
        if abs(now - last).max() <= _SETTLED * max(1.0, abs(now).max()):
            return model
        last = now
    return None


def weights(model: PipelineModel) -> tuple[list[float], float]:
    """Feature weights and bias of a fitted logistic pipeline."""
    values = model.stages[2].coefficients.toArray().tolist()
    return values[:-1], values[-1]


def scored_by(models: Mapping[str, Model], df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Long scores: kept columns, model name and probability of label 1; one pass for all models.

    Any fitted Spark model with a `probability` vector can take part.
    """
    wide, scores = df, []
    for position, (name, model) in enumerate(models.items()):
        before = wide.columns
        column = f"_score_{position}"
        wide = model.transform(wide).select(*before, vector_to_array("probability")[1].alias(column))
        scores.append(F.struct(F.lit(name).alias("model"), F.col(column).alias("probability")))
    return wide.select(*keep, F.inline(F.array(*scores)))


def evaluate_model(
    model: Model,
    df: DataFrame,
    name: str,
    schema: DraftSchema = DRAFT,
) -> DataFrame:
    """Accuracy, ROC-AUC and log loss of any fitted model for each split in the rows."""
    slim = df.select(F.col(schema.split).alias("split"), F.col(schema.label).cast("int").alias("label"), "features")
    table = metrics(scored_by({name: model}, slim, ["split", "label"]))
    return table.select("model", "split", "accuracy", "roc_auc", "log_loss")


def training_facts(df: DataFrame, schema: DraftSchema = DRAFT) -> dict[str, tuple[int, int]]:
    """Rows and positive rows per split; at most three rows reach the driver."""
    label = F.col(schema.label).cast("int")
    table = df.groupBy(F.col(schema.split).alias("split")).agg(F.count("*").alias("n"), F.sum(label).alias("pos"))
    return {r["split"]: (r["n"], r["pos"] or 0) for r in table.collect()}


def require_trainable(facts: Mapping[str, tuple[int, int]]) -> None:
    """No empty split, and both classes in every split, also in one that is not evaluated."""
    empty = [s for s in SPLITS if not facts.get(s, (0, 0))[0]]
    if empty:
        raise ValueError(f"empty splits: {', '.join(empty)}")
    single = [s for s in SPLITS if facts[s][1] in (0, facts[s][0])]
    if SPLITS[0] in single:
        raise ValueError("training rows have to contain both classes")
    if single:
        raise ValueError(f"ROC-AUC needs both classes in: {', '.join(single)}")


def gate_checks(table: DataFrame, candidate: str = LOGISTIC, baseline: str = PRIOR) -> DataFrame:
    """Validation gate: ROC-AUC above 0.5, and log loss no worse than the baseline's."""

    def value(model: str, metric: str):
        here = (F.col("model") == model) & (F.col("split") == "validation")
        return F.max(F.when(here, F.col(metric)))

    facts = table.agg(
        value(candidate, "roc_auc").alias("auc"),
        value(candidate, "log_loss").alias("loss"),
        value(baseline, "log_loss").alias("baseline_loss"),
    )
    return check_table(
        facts,
        [
            ("Validation ROC-AUC above 0.5", F.col("auc") > 0.5),
            ("Validation Log Loss no worse than dummy", F.col("loss") <= F.col("baseline_loss")),
        ],
        otherwise="STOP",
    )


@dataclass(frozen=True)
class BaselineRun:
    """Prepared rows, fitted models by name, metric table and the gate's decision."""

    prepared: PreparedFeatures
    models: dict[str, Model]
    metrics: DataFrame
    validation_gate_passed: bool


def entry_scores(run_weights: tuple[list[float], float], entries: Column) -> Column:
    """Probability of label 1 from the non-zero entries alone: no vector is built to score a row."""
    values, bias = run_weights
    table = F.lit(values) if values else F.array().cast("array<double>")
    margin = F.aggregate(entries, F.lit(bias), lambda acc, e: acc + e["value"] * F.get(table, e["index"]))
    return 1.0 / (1.0 + F.exp(-margin))


_METRICS = "position int, model string, split string, accuracy double, roc_auc double, log_loss double"


def train_baselines(prepared: PreparedFeatures, evaluate_test: bool = True, C: float = 1.0, tol: float = 1e-10) -> BaselineRun:
    """Fit both models on training rows and score them; test rows are scored only if the gate passes.

    The metric rows (six at most) are brought to the driver for the gate and returned in order:
    by model, training before validation, then the test rows.
    """
    schema, frame = prepared.schema, prepared.frame
    facts = training_facts(frame, schema)
    require_trainable(facts)
    train = frame.filter(F.col(schema.split) == SPLITS[0])
    rows, positive = facts[SPLITS[0]]
    models: dict[str, Model] = {
        PRIOR: ClassPriorModel(positive / rows),
        LOGISTIC: fit_logistic(train, "features", schema.label, C=C, tol=tol, rows=rows),
    }

    entries = F.col(prepared.encoder.getOrDefault(prepared.encoder.entriesCol))
    scores = {PRIOR: F.lit(positive / rows), LOGISTIC: entry_scores(weights(models[LOGISTIC]), entries)}
    both = F.inline(F.array(*[F.struct(F.lit(n).alias("model"), p.alias("probability")) for n, p in scores.items()]))
    scored = frame.select(F.col(schema.split).alias("split"), F.col(schema.label).cast("int").alias("label"), both)

    def measured(*splits: str) -> list[tuple]:
        table = metrics(scored.filter(F.col("split").isin(*splits)))
        found = table.select("model", "split", "accuracy", "roc_auc", "log_loss").collect()
        place = {(m, s): i for i, (m, s) in enumerate((m, s) for m in models for s in splits)}
        return sorted((tuple(r) for r in found), key=lambda r: place[r[0], r[1]])

    spark = frame.sparkSession
    records = measured(*SPLITS[:2])

    def as_table() -> DataFrame:
        return spark.createDataFrame([(i, *r) for i, r in enumerate(records, start=1)], _METRICS)

    passed = all(r["passed"] for r in gate_checks(as_table()).collect())
    if passed and evaluate_test:
        records += measured(SPLITS[2])
    return BaselineRun(prepared, models, as_table(), passed)


def stationarity(run: BaselineRun, C: float = 1.0) -> DataFrame:
    """Slope of the penalised loss `|w|^2 / 2 + C * sum(loss)` along every weight, bias last.

    Summed from the stored non-zero entries of the training rows, apart from any solver: all slopes are zero
    at the optimum and nowhere else, as the loss is strictly convex.
    """
    schema, model = run.prepared.schema, run.prepared.encoder
    names, (values, bias) = run.prepared.feature_names, weights(run.models[LOGISTIC])
    entries = F.col(model.getOrDefault(model.entriesCol))
    train = run.prepared.frame.filter(F.col(schema.split) == SPLITS[0])
    error = entry_scores((values, bias), entries) - F.col(schema.label).cast("double")
    one = F.array(F.struct(F.lit(len(names)).alias("index"), F.lit(1.0).alias("value")))
    # Each row's cells carry its error, so that it is computed once and not again for every cell.
    shares = F.transform(F.concat(entries, one), lambda e: F.struct(e["index"].alias("index"), (F.col("_error") * e["value"]).alias("_share")))
    cells = train.select(entries, error.alias("_error")).select(F.inline_outer(shares))
    sums = cells.groupBy("index").agg(F.sum("_share").alias("_sum"))
    rows = [(i, n, w) for i, (n, w) in enumerate(zip([*names, _BIAS.strip("_")], [*values, bias]))]
    table = train.sparkSession.createDataFrame(rows, "index int, feature string, weight double")
    slope = F.col("weight") + F.lit(C) * F.coalesce("_sum", F.lit(0.0))
    return table.join(sums, "index", "left").select("index", "feature", slope.alias("slope"))


def coefficient_table(run: BaselineRun) -> DataFrame:
    """Weight of every feature."""
    values, _ = weights(run.models[LOGISTIC])
    rows = [(i, n, w) for i, (n, w) in enumerate(zip(run.prepared.feature_names, values))]
    return run.prepared.frame.sparkSession.createDataFrame(rows, "index int, feature string, coefficient double")


def item_names(df: DataFrame, schema: DraftSchema = DRAFT) -> DataFrame:
    """One name per ID: the first in side, slot and row order.

    Order matters only for IDs with several names. They are found by a plain distinct, and only
    their picks are compared; the others need no sorting.
    """
    item, name = f"{schema.item}_id", f"{schema.item}_name"
    long = picks_long(df, [schema.key, schema.time], schema)
    per_item = long.select(item, name).distinct().groupBy(item).agg(F.count("*").alias("names"), F.max(name).alias(name))
    per_item = materialize(per_item)  # one row per ID
    clear = per_item.filter("names = 1").select(item, name)
    several = per_item.filter("names > 1").select(item)
    if several.isEmpty():
        return clear
    side = F.when(F.col("side") == schema.sides[0].title(), 0).otherwise(1)
    order = F.struct(side.alias("side"), F.col("slot"), F.col(schema.time), F.col(schema.key))
    compared = long.join(broadcast_if_small(several), long[item].eqNullSafe(several[item]), "left_semi")
    return clear.unionByName(compared.groupBy(item).agg(F.min_by(name, order).alias(name)))


def item_coefficients(run: BaselineRun) -> DataFrame:
    """Pick features with ID, name (NULL if unknown) and weight."""
    return named_coefficients(coefficient_table(run), run.prepared.frame, run.prepared.schema)


def named_coefficients(coefficients: DataFrame, df: DataFrame, schema: DraftSchema = DRAFT) -> DataFrame:
    """The pick features of an (index, feature, coefficient) table with ID and name."""
    s = schema
    table = coefficients.filter(F.col("feature").startswith(f"{s.item}_"))
    table = table.withColumn(f"{s.item}_id", item_of_feature(F.col("feature"), s.item))
    named = table.join(broadcast_if_small(item_names(df, s)), f"{s.item}_id", "left")
    return named.select("index", "feature", f"{s.item}_id", f"{s.item}_name", "coefficient")


def strongest(coefficients: DataFrame, k: int = 10) -> DataFrame:
    """The k smallest and the k largest weights, by weight; ties keep feature order."""
    low = coefficients.orderBy("coefficient", "index").limit(k)
    high = coefficients.orderBy(F.col("coefficient").desc(), "index").limit(k)
    return low.unionByName(high).orderBy("coefficient", "index")


@dataclass(frozen=True)
class RunSummary:
    """The figures of a training run; texts are left to the caller."""

    split_counts: DataFrame
    shape: DataFrame
    metrics: DataFrame
    gate: DataFrame


def run_summary(run: BaselineRun) -> RunSummary:
    spark, prepared = run.prepared.frame.sparkSession, run.prepared
    counts = split_counts(prepared.frame, prepared.schema)
    shape = counts.agg(F.coalesce(F.sum("matches"), F.lit(0)).alias("rows")).select(
        "rows",
        F.lit(len(prepared.feature_names)).alias("feature_columns"),
        F.lit(len(prepared.encoder.item_vocabulary)).alias("known_items"),
        F.lit(len(prepared.encoder.version_vocabulary)).alias("known_versions"),
    )
    tested = run.metrics.filter(F.col("split") == SPLITS[2]).limit(1).count() > 0
    if not run.validation_gate_passed:
        reason = "the validation gate did not pass"
    else:
        reason = None if tested else "test evaluation was switched off"
    gate = spark.createDataFrame(
        [("PASS" if run.validation_gate_passed else "STOP", tested, reason)],
        "gate string, test_evaluated boolean, test_skipped_because string",
    )
    return RunSummary(counts, shape, rounded(run.metrics).orderBy("position"), gate)


def ordered_metrics(run: BaselineRun) -> DataFrame:
    """Metric rows in their published order and layout."""
    return run.metrics.orderBy("position").drop("position")


__all__ = [
    "BaselineRun",
    "ClassPrior",
    "ClassPriorModel",
    "LOGISTIC",
    "PRIOR",
    "RunSummary",
    "coefficient_table",
    "entry_scores",
    "evaluate_model",
    "fit_logistic",
    "gate_checks",
    "item_coefficients",
    "item_names",
    "named_coefficients",
    "ordered_metrics",
    "require_trainable",
    "run_summary",
    "scored_by",
    "stationarity",
    "strongest",
    "train_baselines",
    "training_facts",
    "weights",
]
