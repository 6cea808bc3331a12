"""Registered queries: every operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import flip_where, keep_known, outcome
from .operators import curate as cur, encode as enc, evaluate as ev, explore as ex, models as mod
from .operators import profile as prof, quality as q, ranks, roles, split as sp, wide
from .plans import run_curation, run_training
from .sources import (
    FILE_POSITION,
    materialize,
    read_by_year,
    read_curated,
    read_matches,
    read_versions,
    stored_once,
    with_file_position,
    write_bucketed,
    write_by_year,
    write_csv,
    write_inventory,
    write_metadata,
    write_metrics,
)
from .sources.storage import checkpoint_folder, input_files
from .schema import DRAFT
from .sources.match_view import PERIOD, VIEW_TRAIN_CUTOFF, VIEW_VALIDATION_CUTOFF, match_view, version_view, wide_view

Query = Callable[[SparkSession, str], DataFrame]

_ROUND = 6
_runs: dict[tuple, mod.BaselineRun] = {}
_encoded: dict[tuple, enc.PreparedFeatures] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), _ROUND) for c in columns})


def _curated(spark: SparkSession, folder: str) -> DataFrame:
    """All curated matches, no sampling, no order."""
    return cur.curate(match_view(spark, folder), version_view(spark, folder), rows=None, ordered=False)


def _matches(spark: SparkSession, folder: str) -> DataFrame:
    """The curated table as analysis reads it: stored once, by the curation above."""
    return stored_once(spark, f"{folder}/orders.parquet", "matches", lambda: _curated(spark, folder))


def _prepared(spark: SparkSession, folder: str) -> enc.PreparedFeatures:
    """Encoded rows, encoded and stored once per session and state of the table."""
    key = (spark.sparkContext.applicationId, input_files(spark, f"{folder}/orders.parquet"))
    if key not in _encoded:
        _encoded.clear()
        prepared = enc.encode_with_train_vocabulary(_matches(spark, folder), VIEW_TRAIN_CUTOFF, VIEW_VALIDATION_CUTOFF)
        vector = prepared.encoder.getOrDefault(prepared.encoder.outputCol)
        frame = materialize(prepared.frame.drop(vector))
        _encoded[key] = replace(prepared, frame=prepared.encoder.with_vector(frame))
    return _encoded[key]


def _split(spark: SparkSession, folder: str) -> DataFrame:
    return sp.chronological_split(_matches(spark, folder), VIEW_TRAIN_CUTOFF, VIEW_VALIDATION_CUTOFF)


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    """Split, label and a made-up score in exact arithmetic: strength of the first pick, with many ties."""
    df = _split(spark, folder)
    strength = (F.col("radiant_player_1_hero_id") * 37) % 101 * 9 + 50
    score = strength.cast("double") / F.lit(1000.0)
    return df.select("split", F.col(DRAFT.label).cast("int").alias("label"), score.alias("probability"))


def _length_scored(spark: SparkSession, folder: str) -> DataFrame:
    """Document quality labels against a score from the text length."""
    documents = _table(spark, folder, "documents").select("doc_id", "n_chars")
    labels = _table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    size = F.col("n_chars").cast("double")
    return labels.join(documents, "doc_id").select("label", (size / (size + F.lit(1000.0))).alias("probability"))


def _lines_scored(spark: SparkSession, folder: str) -> DataFrame:
    """Returned lines against a score from the price, per line status."""
    price = F.col("l_extendedprice") / (F.col("l_extendedprice") + F.lit(50000.0))
    returned = (F.col("l_returnflag") == "R").cast("int")
    return _table(spark, folder, "lineitem").select(
        F.col("l_linestatus").alias("status"), returned.alias("label"), price.alias("probability")
    )


def _run(spark: SparkSession, folder: str) -> mod.BaselineRun:
    """One training run per session and folder, shared by the queries that report on it."""
    key = (spark.sparkContext.applicationId, input_files(spark, f"{folder}/orders.parquet"))
    if key not in _runs:
        _runs.clear()  # one run at a time; those of earlier sessions and tables are of no use
        prepared = enc.prepare_features(_matches(spark, folder), VIEW_TRAIN_CUTOFF, VIEW_VALIDATION_CUTOFF)
        _runs[key] = mod.train_baselines(prepared)
    return _runs[key]


# --- curation -------------------------------------------------------------------------------------


def curated_sample(spark, folder, rows=30_000):
    return cur.curate(match_view(spark, folder), version_view(spark, folder), rows=rows)


def keep_latest_matches(spark, folder):
    latest = cur.latest_eligible(match_view(spark, folder))
    return latest.withColumn(DRAFT.label, outcome()).select("match_id", DRAFT.time, DRAFT.version, DRAFT.winner, DRAFT.label)


def keep_latest_events(spark, folder):
    events = _table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return cur.keep_latest(events, ["user_id"], ["ts", "event_id"])


def keep_latest_events_bucketed(spark, folder):
    """The same on a table stored in buckets of the key, which takes no shuffle."""
    events = _table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return cur.keep_latest(spark.table(write_bucketed(events, ["user_id"], buckets)), ["user_id"], ["ts", "event_id"])


def hash_sample_orders(spark, folder, rows=1000):
    orders = _table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return cur.hash_sample(orders, "o_orderkey", rows)


def hash_sample_parts_of_lines(spark, folder):
    lines = _table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return cur.hash_sample(lines, "l_partkey", 150)


# --- profiling ------------------------------------------------------------------------------------


def _view(spark, folder):
    return match_view(spark, folder)


def metadata_record(spark, folder):
    raw = match_view(spark, folder)
    record = prof.metadata_record(raw, _matches(spark, folder))
    sample = F.col("sample")
    return record.select(
        "source.*",
        *[sample[c].alias(c) for c in ("requested_rows", "actual_rows", "unique_matches", "date_min", "date_max")],
        F.round(sample["radiant_win_rate"], 5).alias("radiant_win_rate"),
        F.array_join(sample["columns"], ",").alias("columns"),
    )


def fingerprint(spark, folder):
    return prof.fingerprint(_matches(spark, folder))


def quality_checks(spark, folder):
    checks = q.dataset_checks(_matches(spark, folder), sequence=DRAFT.key, expected_columns=25)
    return checks.drop("position")


def quality_checks_raw(spark, folder):
    df = match_view(spark, folder).withColumn(DRAFT.label, outcome())
    return q.dataset_checks(df, sequence=DRAFT.key, expected_rows=15_000).drop("position")


def order_breaks(spark, folder):
    return ranks.order_breaks(_table(spark, folder, "orders"), "o_orderdate", "o_orderkey")


def prefix_sums(spark, folder):
    lines = _table(spark, folder, "lineitem").groupBy("l_returnflag", "l_shipdate").agg(F.count("*").alias("n"))
    return ranks.prefix_sums(materialize(lines), "l_shipdate", ["n"], ["l_returnflag"])


# --- splits ---------------------------------------------------------------------------------------


def chronological_split(spark, folder):
    return _split(spark, folder).select("match_id", "split")


def matches_between(spark, folder):
    """A period of the curated table, stored by year."""
    table = _matches(spark, folder)
    path = _written(spark, folder, "matches-by-year", lambda path: write_by_year(table, path))
    kept = sp.matches_between(read_by_year(spark, path, table), *PERIOD)
    return kept.select("match_id", DRAFT.time, F.col(DRAFT.label).cast("int").alias("label"))


def split_boundaries_shipdate(spark, folder):
    return sp.split_boundaries(_table(spark, folder, "lineitem"), "l_shipdate")


def known_versions(spark, folder):
    prepared = _prepared(spark, folder)
    known = keep_known(F.col(DRAFT.version), prepared.encoder.version_vocabulary)
    kept = prepared.frame.select("split", known.alias("known_version"))
    return kept.groupBy("split").agg(
        F.count("known_version").alias("kept"), F.count_if(F.col("known_version").isNull()).alias("nulled")
    )


# --- sources and sinks ----------------------------------------------------------------------------


def _written(spark: SparkSession, folder: str, name: str, write: Callable[[str], object]) -> str:
    """A path below the checkpoint folder, written once per session and state of the table."""
    path = f"{checkpoint_folder(spark)}/{name}"
    key = (path, input_files(spark, f"{folder}/orders.parquet"))
    if key not in _outputs:
        _outputs[key] = f"{path}-{len(_outputs)}"
        write(_outputs[key])
    return _outputs[key]


_outputs: dict[tuple, str] = {}


def _curated_file(spark, folder):
    """The whole curated table as a CSV export in time order."""
    return _written(spark, folder, "curated-csv", lambda path: write_csv(cur.in_time_order(_matches(spark, folder)), path))


def curated_csv(spark, folder):
    return read_curated(spark, _curated_file(spark, folder))


def file_order_checks(spark, folder):
    placed = with_file_position(read_curated(spark, _curated_file(spark, folder)))
    file, block, row = FILE_POSITION
    return q.dataset_checks(placed, sequence=row, within=[file, block], expected_columns=25).drop("position")


def inventory_csv(spark, folder):
    inventory = prof.column_inventory(wide_view(spark, folder))
    path = _written(spark, folder, "inventory-csv", lambda path: write_inventory(inventory, path))
    table = spark.read.options(header=True, quote='"', escape='"').csv(path)
    return table.select("column", F.col("null_count").cast("bigint").alias("null_count"), "column_group", "v1_decision", "reason")


def metadata_json(spark, folder):
    record = prof.metadata_record(match_view(spark, folder), _matches(spark, folder))
    path = _written(spark, folder, "metadata-json", lambda path: write_metadata(record, path))
    read = spark.read.json(path)
    return read.select("source.*", "sample.actual_rows", "sample.date_min", "sample.date_max", F.size("sample.columns").alias("n_columns"))


def metrics_csv(spark, folder):
    path = _written(spark, folder, "metrics-csv", lambda path: write_metrics(_measured(spark, folder), path))
    typed = "model string, split string, accuracy double, roc_auc double, log_loss double"
    return _rounded(spark.read.schema(typed).option("header", True).csv(path), "accuracy", "roc_auc", "log_loss")


def _versions_file(spark, folder):
    versions = version_view(spark, folder)
    return _written(spark, folder, "versions-csv", lambda path: write_csv(versions, path))


def versions_csv(spark, folder):
    return read_versions(spark, _versions_file(spark, folder)).select("id", "name")


def _raw_file(spark, folder):
    return _written(spark, folder, "raw-parquet", lambda path: match_view(spark, folder).write.parquet(path))


def raw_matches(spark, folder):
    raw = read_matches(spark, _raw_file(spark, folder)).select("match_id", DRAFT.time, DRAFT.version, DRAFT.winner)
    return raw.fillna(-1, [DRAFT.version, DRAFT.winner])


def _curation(spark, folder) -> str:
    """The curation job from files to files; the path of its sample."""
    paths = [f"{checkpoint_folder(spark)}/job-{len(_outputs)}-{n}" for n in ("inventory", "metadata")]
    sources = _raw_file(spark, folder), _versions_file(spark, folder)
    return _written(spark, folder, "job-sample", lambda path: run_curation(spark, *sources, path, *paths, rows=2000))


def curation_job(spark, folder):
    return read_curated(spark, _curation(spark, folder))


def training_job_prior(spark, folder):
    """The training job on the curated file; the prior's rows of the metrics that it writes."""

    def job(path: str) -> None:
        run_training(spark, _curated_file(spark, folder), True, path, VIEW_TRAIN_CUTOFF, VIEW_VALIDATION_CUTOFF)

    path = _written(spark, folder, "job-metrics", job)
    typed = "model string, split string, accuracy double, roc_auc double, log_loss double"
    table = spark.read.schema(typed).option("header", True).csv(path)
    return _rounded(table.filter(F.col("model") == mod.PRIOR), "accuracy", "roc_auc", "log_loss")


def binary_labels(spark, folder):
    return enc.binary_target(_matches(spark, folder)).select("match_id", F.col(DRAFT.label).cast("int").alias("label"))


def flipped_labels(spark, folder):
    label = F.col(DRAFT.label).cast("int")
    return _matches(spark, folder).select("match_id", flip_where(label, F.col("match_id") % 3 == 0).alias("label"))


def training_guards(spark, folder):
    facts = mod.training_facts(_split(spark, folder))
    mod.require_trainable(facts)
    rows = [(split, n, pos, 0 < pos < n) for split, (n, pos) in facts.items()]
    return spark.createDataFrame(rows, "split string, rows bigint, positives bigint, trainable boolean")


# --- models ---------------------------------------------------------------------------------------


def _measured(spark, folder) -> DataFrame:
    """Metric table of the training prior and the made-up score, under the names of the two models."""
    split = _split(spark, folder)
    label = F.col(DRAFT.label).cast("int")
    prior = split.filter(F.col("split") == "train").agg(F.avg(label.cast("double"))).scalar()
    scored = _scored(spark, folder).withColumn("_prior", prior)
    both = F.array(
        F.struct(F.lit(mod.PRIOR).alias("model"), F.col("_prior").alias("probability")),
        F.struct(F.lit(mod.LOGISTIC).alias("model"), F.col("probability")),
    )
    return ev.metrics(scored.select("split", "label", F.inline(both))).select("model", "split", "accuracy", "roc_auc", "log_loss")


def _pick_means(spark, folder) -> DataFrame:
    """A weight per known pick that SQL can compute: the mean label of the first side's picks."""
    long = _matches(spark, folder).select(
        F.explode(F.array(*[F.col(c) for c in DRAFT.pick_ids("radiant")])).alias("id"), F.col(DRAFT.label).cast("int").alias("y")
    )
    means = long.groupBy("id").agg(F.avg("y").alias("coefficient"))
    return means.select(F.col("id").cast("int").alias("index"), F.concat(F.lit("hero_"), F.col("id")).alias("feature"), "coefficient")


def named_means(spark, folder):
    return _rounded(mod.named_coefficients(_pick_means(spark, folder), _matches(spark, folder)), "coefficient")


def encoded_vectors(spark, folder):
    """Size and non-zero cells of the feature vectors as text."""
    values = vector_to_array("features")
    cells = _prepared(spark, folder).frame.select("match_id", values.alias("v"))
    text = "array_join(transform(filter(sequence(0, size(v) - 1), i -> v[i] <> 0), i -> concat(i, ':', CAST(v[i] AS int))), ' ')"
    return cells.select("match_id", F.size("v").alias("size"), F.expr(text).alias("cells"))


def logistic_weights(spark, folder):
    """A fit with two features and bias, small enough for Newton's method in SQL."""
    lines = _table(spark, folder, "lineitem").select(
        (F.col("l_quantity") / 50).cast("double").alias("quantity"),
        (F.col("l_discount") * 10).cast("double").alias("discount"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )
    rows = VectorAssembler(inputCols=["quantity", "discount"], outputCol="features").transform(lines)
    values, bias = mod.weights(mod.fit_logistic(rows, C=0.01))
    table = list(zip(("quantity", "discount", "bias"), [*values, bias]))
    return spark.createDataFrame(table, "feature string, weight double").withColumn("weight", F.round("weight", 4))


def evaluate_prior(spark, folder):
    """A fitted model on the encoded rows."""
    frame = _prepared(spark, folder).frame.withColumn(DRAFT.label, F.col(DRAFT.label).cast("int"))
    model = mod.ClassPrior(labelCol=DRAFT.label).fit(sp.of_split(frame, "train"))
    return _rounded(mod.evaluate_model(model, frame, mod.PRIOR), "accuracy", "roc_auc", "log_loss")


def weight_slopes(spark, folder):
    """Slopes of the fitted logistic model's loss; zero at the optimum."""
    slopes = mod.stationarity(_run(spark, folder))
    return slopes.withColumn("slope", F.round("slope", 6) + F.lit(0.0))  # no negative zero


def encoded_by_join(spark, folder):
    """Encoded rows with the vocabulary joined, as for IDs that are spread widely."""
    matches = _matches(spark, folder)
    return enc.encoded_long(enc.encode_with_train_vocabulary(matches, VIEW_TRAIN_CUTOFF, VIEW_VALIDATION_CUTOFF, lookup_span=0))


def encoded_by_table(spark, folder):
    """Encoded rows with a vocabulary that is a stored table."""
    split = _split(spark, folder)
    known = wide.fit_stored(sp.of_split(split, "train"))
    return wide.encode_stored(split, known).select("match_id", "feature", "value")


def prior_metrics(spark, folder):
    df = _split(spark, folder).withColumn(DRAFT.label, F.col(DRAFT.label).cast("int"))
    model = mod.ClassPrior(labelCol=DRAFT.label).fit(sp.of_split(df, "train"))
    scored = mod.scored_by({mod.PRIOR: model}, df, ["split", F.col(DRAFT.label).alias("label")])
    return _rounded(ev.metrics(scored).drop("rows"), "accuracy", "roc_auc", "log_loss")


def _with(source: Callable, operator: Callable, *rounded: str, drop: tuple[str, ...] = (), **options) -> Query:
    """A query that applies one operator to one source table."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        result = operator(source(spark, folder), **options).drop(*drop)
        return _rounded(result, *rounded) if rounded else result

    return query


def _from(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return partial(lambda spark, folder, table: _table(spark, folder, table), table=name)


QUERIES: dict[str, Query] = {
    # curation
    "curated_sample": curated_sample,
    "curated_small_sample": partial(curated_sample, rows=2000),
    "curated_all": _curated,
    "keep_latest_matches": keep_latest_matches,
    "keep_latest_events": keep_latest_events,
    "keep_latest_events_bucketed": keep_latest_events_bucketed,
    "hash_sample": hash_sample_orders,
    "hash_sample_large": partial(hash_sample_orders, rows=5000),
    "hash_sample_repeated_key": hash_sample_parts_of_lines,
    # sources and sinks
    "raw_matches": raw_matches,
    "versions_csv": versions_csv,
    "curated_csv": curated_csv,
    "file_order_checks": file_order_checks,
    "inventory_csv": inventory_csv,
    "metadata_json": metadata_json,
    "metrics_csv": metrics_csv,
    "curation_job": curation_job,
    "training_job_prior": training_job_prior,
    # profiling
    "table_summary": _with(_view, prof.table_summary),
    "sample_summary": _with(_matches, prof.sample_summary, "label_rate", decimals=5),
    "null_profile": _with(_view, prof.null_profile, "null_percent", drop=("type",)),
    "null_profile_documents": _with(_from("documents"), prof.null_profile, "null_percent", drop=("type",)),
    "column_inventory": _with(_view, prof.column_inventory, "null_percent", drop=("type",)),
    "column_inventory_wide": _with(wide_view, prof.column_inventory, "null_percent", drop=("type",)),
    "role_summary_wide": _with(lambda s, f: prof.column_inventory(wide_view(s, f)), roles.role_summary, drop=("names",)),
    "role_summary": _with(lambda s, f: prof.column_inventory(match_view(s, f)), roles.role_summary),
    "dtype_summary": _with(_matches, prof.dtype_summary),
    "missing_cells": _with(_view, prof.missing_cells),
    "missing_cells_curated": _with(_matches, prof.missing_cells),
    "repeated_keys": _with(_view, prof.repeated_keys, key=DRAFT.key),
    "repeated_keys_events": _with(_from("events"), prof.repeated_keys, key="user_id"),
    "overview": _with(_matches, prof.overview),
    "metadata_record": metadata_record,
    "fingerprint": fingerprint,
    # checks
    "quality_checks": quality_checks,
    "quality_checks_raw": quality_checks_raw,
    "order_breaks": order_breaks,
    "order_breaks_repeated": _with(_from("lineitem"), ranks.order_breaks, value="l_shipdate", sequence="l_orderkey"),
    "order_breaks_raw": _with(_view, ranks.order_breaks, value=DRAFT.time, sequence=DRAFT.key),
    "prefix_sums": prefix_sums,
    "split_checks": _with(_split, q.split_checks, drop=("position",)),
    # exploration
    "target_distribution": _with(_matches, ex.target_distribution, "share", drop=("position",)),
    "majority_baseline": _with(_matches, ex.majority_baseline, "majority_baseline"),
    "matches_by_year": _with(_matches, ex.matches_by_year),
    "patch_distribution": _with(_matches, ex.version_distribution, "share"),
    "top_patches": _with(
        lambda s, f: ex.version_distribution(_matches(s, f)), ex.top_by, "share", by="matches", k=15, tie=[DRAFT.version]
    ),
    "patch_count": _with(_matches, ex.version_count),
    "picks_long": _with(_matches, ex.picks_long),
    "pick_frequency": _with(_matches, ex.pick_frequency, "match_share"),
    "top_picks": _with(_matches, ex.top_picks, "match_share"),
    "side_frequency": _with(_matches, ex.side_frequency),
    "first_rows": _with(_matches, ex.first_rows, k=3),
    "hero_names": _with(_matches, mod.item_names),
    "encoded_example": _with(lambda s, f: sp.of_split(_split(s, f), "train"), ex.encoded_example),
    # splits
    "split_boundaries": _with(_matches, sp.split_boundaries),
    "split_boundaries_shipdate": split_boundaries_shipdate,
    "chronological_split": chronological_split,
    "matches_between": matches_between,
    "split_plan": _with(_matches, sp.split_plan, "share"),
    "split_summary": _with(_split, sp.split_summary, "label_rate", "share"),
    "split_counts": _with(_split, sp.split_counts),
    # encoder
    "vocabulary": _with(lambda s, f: sp.of_split(_split(s, f), "train"), enc.vocabulary),
    "known_versions": known_versions,
}


def _of_prepared(operator: Callable, *rounded: str, **options) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        result = operator(_prepared(spark, folder), **options)
        return _rounded(result, *rounded) if rounded else result

    return query


def _checks(operator: Callable) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        prepared = _prepared(spark, folder)
        return operator(prepared.frame, prepared.encoder).drop("position")

    return query


def _of_run(report: Callable[[mod.BaselineRun], DataFrame]) -> Query:
    return lambda spark, folder: report(_run(spark, folder))


QUERIES |= {
    "vocabulary_summary": _of_prepared(enc.vocabulary_summary),
    "encoded_long": _of_prepared(enc.encoded_long),
    "encoded_long_by_join": encoded_by_join,
    "encoded_long_by_table": encoded_by_table,
    "encoded_vectors": encoded_vectors,
    "unseen_hero_summary": _of_prepared(enc.unseen_pick_summary),
    "unseen_hero_catalog": _of_prepared(enc.unseen_pick_catalog),
    "unseen_hero_catalog_by_time": _of_prepared(enc.unseen_pick_catalog, chronological=True),
    "unseen_patch_summary": _of_prepared(enc.unseen_version_summary),
    "unseen_patch_catalog": _of_prepared(enc.unseen_version_catalog),
    "unknown_totals": _of_prepared(enc.unknown_totals),
    "matrix_split_summary": _of_prepared(enc.matrix_split_summary, "label_rate"),
    "sparsity": _of_prepared(enc.sparsity, "density"),
    "split_sparsity": _of_prepared(enc.split_sparsity, "density"),
    "active_features": _of_prepared(enc.active_features, "share"),
    "feature_manifest": _of_prepared(lambda p: enc.feature_manifest(p).drop("position")),
    "feature_checks": _checks(enc.feature_checks),
    "pre_model_checks": _checks(enc.pre_model_checks),
    # evaluation
    "class_prior": _with(lambda s, f: sp.of_split(_split(s, f), "train"), ev.class_prior, "prior"),
    "accuracy": _with(_scored, ev.accuracy, "accuracy", groups=["split"]),
    "log_loss": _with(_scored, ev.log_loss, "log_loss", groups=["split"]),
    "roc_auc": _with(_scored, ev.roc_auc, "roc_auc", groups=["split"]),
    "roc_points": _with(_scored, ev.roc_points, "threshold", "fpr", "tpr", groups=["split"]),
    "roc_corners": _with(_scored, ev.roc_points, "threshold", "fpr", "tpr", groups=["split"], drop_collinear=True),
    "roc_corners_lines": _with(_lines_scored, ev.roc_points, "threshold", "fpr", "tpr", groups=["status"], drop_collinear=True),
    "confusion_matrix": _with(_scored, ev.confusion_matrix, groups=["split"]),
    "quality_metrics": _with(_length_scored, ev.metrics, "accuracy", "roc_auc", "log_loss", groups=[]),
    "quality_confusion": _with(_length_scored, ev.confusion_matrix),
    "line_metrics": _with(_lines_scored, ev.metrics, "accuracy", "roc_auc", "log_loss", groups=["status"]),
    # labels and guards
    "binary_labels": binary_labels,
    "flipped_labels": flipped_labels,
    "training_guards": training_guards,
    # models
    "prior_metrics": prior_metrics,
    "evaluate_prior": evaluate_prior,
    "gate_checks_of_scores": lambda s, f: mod.gate_checks(_measured(s, f)).drop("position"),
    "metric_gaps_of_scores": lambda s, f: _rounded(
        gaps := ev.metric_gaps(_measured(s, f), mod.LOGISTIC, mod.PRIOR), *gaps.columns
    ),
    "metrics_by_auc_of_scores": lambda s, f: _rounded(ev.by_auc(_measured(s, f)), "accuracy", "roc_auc", "log_loss"),
    "named_means": named_means,
    "strongest_means": lambda s, f: mod.strongest(named_means(s, f)),
    "logistic_weights": logistic_weights,
    "weight_slopes": weight_slopes,
    "baseline_metrics": _of_run(mod.ordered_metrics),
    "gate_checks": _of_run(lambda run: mod.gate_checks(run.metrics).drop("position")),
    "metric_gaps": _of_run(lambda run: ev.metric_gaps(run.metrics, mod.LOGISTIC, mod.PRIOR)),
    "metrics_by_auc": _of_run(lambda run: ev.by_auc(run.metrics)),
    "hero_coefficients": _of_run(mod.item_coefficients),
    "strongest_heroes": _of_run(lambda run: mod.strongest(mod.item_coefficients(run))),
    "run_split_counts": _of_run(lambda run: mod.run_summary(run).split_counts),
    "run_shape": _of_run(lambda run: mod.run_summary(run).shape),
    "run_gate": _of_run(lambda run: mod.run_summary(run).gate),
}
