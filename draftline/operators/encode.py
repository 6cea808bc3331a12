"""Draft encoder: train-only vocabularies, signed picks, unknown counts, version one-hot."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from ..functions import share, split_rank
from ..schema import DRAFT, FORBIDDEN, SPLITS, STRICT_FORBIDDEN, TRAIN_CUTOFF, VALIDATION_CUTOFF, DraftSchema
from ..sources.storage import materialize
from .curate import BROADCAST_ROWS
from .explore import picks_long
from .quality import check_table, forbidden_features, require_columns
from .split import _cutoffs, all_splits, chronological_split, of_split, with_total_share

# Widest range of IDs that is looked up in a constant array; beyond it the vocabulary is joined.
LOOKUP_SPAN = 50_000
ENTRIES = "entries"


class _EncoderParams(DefaultParamsReadable, DefaultParamsWritable):
    outputCol = Param(Params._dummy(), "outputCol", "feature vector column", TypeConverters.toString)
    entriesCol = Param(
        Params._dummy(), "entriesCol", "column of non-zero (index, value) pairs by index", TypeConverters.toString
    )
    item = Param(Params._dummy(), "item", "name of a pick in column and feature names", TypeConverters.toString)
    versionCol = Param(Params._dummy(), "versionCol", "version ID column", TypeConverters.toString)
    versionPrefix = Param(Params._dummy(), "versionPrefix", "prefix of version features", TypeConverters.toString)
    lookupSpan = Param(
        Params._dummy(), "lookupSpan", "widest range of IDs looked up in a constant array; wider ones are joined", TypeConverters.toInt
    )
    sides = Param(Params._dummy(), "sides", "side names; +1 then -1", TypeConverters.toListString)
    slots = Param(Params._dummy(), "slots", "picks per side", TypeConverters.toInt)

    def _set_schema_defaults(self, schema: DraftSchema) -> None:
        self._setDefault(
            outputCol="features",
            entriesCol=ENTRIES,
            item=schema.item,
            versionCol=schema.version,
            versionPrefix=schema.version_prefix,
            sides=list(schema.sides),
            slots=schema.slots,
        )

    @property
    def schema(self) -> DraftSchema:
        get = self.getOrDefault
        return replace(
            DRAFT,
            item=get(self.item),
            version=get(self.versionCol),
            version_prefix=get(self.versionPrefix),
            sides=tuple(get(self.sides)),
            slots=get(self.slots),
        )

    def _require_input(self, df: DataFrame) -> None:
        require_columns(df, [*self.schema.pick_ids(), self.schema.version], "encoder input")


class DraftEncoder(Estimator, _EncoderParams):
    """Learns the pick and version vocabularies of the rows it is given: pass training rows only."""

    @keyword_only
    def __init__(
        self, *, outputCol: str = "features", entriesCol: str = ENTRIES, schema: DraftSchema = DRAFT, lookupSpan: int | None = None
    ):
        super().__init__()
        self._set_schema_defaults(schema)
        self._set(outputCol=outputCol, entriesCol=entriesCol, **({} if lookupSpan is None else {"lookupSpan": lookupSpan}))

    def _fit(self, df: DataFrame) -> "DraftEncoderModel":
        self._require_input(df)
        schema = self.schema
        values = vocabulary(df, schema).collect()  # one row per different ID
        if not values:
            raise ValueError("the encoder cannot learn from an empty table")
        learned = {kind: sorted(r.value for r in values if r.kind == kind and r.value is not None) for kind in ("item", "version")}
        for kind, text in (("item", f"{schema.item} ID columns contain"), ("version", f"{schema.version} contains")):
            if any(r.kind == kind and r.value is None for r in values):
                raise ValueError(f"encoder input: {text} missing values")
        model = DraftEncoderModel()
        self._copyValues(model)
        model._set(items=learned["item"], versions=learned["version"])
        return model


def vocabulary(df: DataFrame, schema: DraftSchema = DRAFT) -> DataFrame:
    """Different pick and version IDs (NULL included) with their frequency, as (kind, value, uses).

    Picks are counted inside each task first, so the shuffle carries one row per ID and task.
    """
    cells = [F.struct(F.lit("item").alias("kind"), F.col(c).cast("bigint").alias("value")) for c in schema.pick_ids()]
    cells.append(F.struct(F.lit("version").alias("kind"), F.col(schema.version).cast("bigint").alias("value")))
    return df.select(F.inline(F.array(*cells))).groupBy("kind", "value").agg(F.count("*").alias("uses"))


class DraftEncoderModel(Model, _EncoderParams):
    """Fitted encoder. Feature order: known picks by ID, two unknown counts, known versions by ID,
    unknown version. `transform` is narrow: no shuffle and no Python per row."""

    items = Param(Params._dummy(), "items", "known pick IDs, ascending", TypeConverters.toListInt)
    versions = Param(Params._dummy(), "versions", "known version IDs, ascending", TypeConverters.toListInt)

    def __init__(self):
        super().__init__()
        self._set_schema_defaults(DRAFT)

    @property
    def item_vocabulary(self) -> list[int]:
        return self._learned(self.items)

    @property
    def version_vocabulary(self) -> list[int]:
        return self._learned(self.versions)

    def _learned(self, param: Param) -> list[int]:
        if not self.isSet(param):
            raise RuntimeError("the encoder has to be fitted before it is used")
        return list(self.getOrDefault(param))

    @property
    def feature_names(self) -> list[str]:
        s = self.schema
        return [
            *(f"{s.item}_{i}" for i in self.item_vocabulary),
            *s.unknown_counts,
            *(f"{s.version_prefix}_{v}" for v in self.version_vocabulary),
            s.unknown_version,
        ]

    def feature_table(self, df: DataFrame) -> DataFrame:
        """(index, feature) of every feature, as a DataFrame in the session of `df`."""
        return df.sparkSession.createDataFrame(list(enumerate(self.feature_names)), "index int, feature string")

    def _positions(self, df: DataFrame, columns: Sequence[str], ids: Sequence[int], name: str) -> DataFrame:
        """Add the vocabulary positions of the columns as one array, -1 for the unknown.

        One lookup is written for all columns: a copy for each would make the generated method too long for
        the JVM to compile, and it would be interpreted for every row.
        """
        span = self.getOrDefault(self.lookupSpan) if self.isSet(self.lookupSpan) else LOOKUP_SPAN
        if ids[-1] - ids[0] <= span:
            known = {value: position for position, value in enumerate(ids)}
            cells = ",".join(str(known.get(v, -1)) for v in range(ids[0], ids[-1] + 1))
            table = F.split(F.lit(cells), ",").cast("array<int>")  # folded into one constant
            values = F.array(*[F.col(c).cast("bigint") for c in columns])
            return df.withColumn(
                name,
                F.transform(values, lambda v: F.when(v.between(ids[0], ids[-1]), F.get(table, (v - ids[0]).cast("int"))).otherwise(-1)),
            )
        names = [f"{name}{i}" for i in range(len(columns))]
        return self._joined_positions(df, columns, ids, names).withColumn(name, F.array(*names)).drop(*names)

    def _joined_positions(self, df: DataFrame, columns: Sequence[str], ids: Sequence[int], names: Sequence[str]) -> DataFrame:
        """The same by one join over the unfolded cells, for IDs that are spread widely.

        Rows are stored first, so that the numbers given to them stay. A cell's value may be in a third
        of all rows; a vocabulary of usual size goes to every task, a larger one is merged, which lets
        Spark split that value. Both joins are told so: a table's size in files, where equal values take
        next to no room, says little of its unfolded cells, which Spark would else take for the side to send.
        """
        rows = materialize(df.withColumn("_row_number", F.monotonically_increasing_id()))
        lookup = df.sparkSession.createDataFrame([(v, p) for p, v in enumerate(ids)], "_value bigint, _position int")
        cells = F.posexplode(F.array(*[F.col(c).cast("bigint") for c in columns])).alias("_cell", "_value")
        lookup = F.broadcast(lookup) if len(ids) <= BROADCAST_ROWS else lookup.hint("merge")
        found = rows.select("_row_number", cells).join(lookup, "_value")
        per_row = found.groupBy("_row_number").agg(
            *[F.max(F.when(F.col("_cell") == i, F.col("_position"))).alias(name) for i, name in enumerate(names)]
        )
        joined = rows.join(per_row.hint("merge"), "_row_number", "left")
        return joined.withColumns({name: F.coalesce(name, F.lit(-1)) for name in names}).select(*df.columns, *names)

    def _transform(self, df: DataFrame) -> DataFrame:
        items, versions = self.item_vocabulary, self.version_vocabulary
        self._require_input(df)
        s, width = self.schema, len(items)
        ids, version = s.pick_ids(), F.col(s.version)
        placed = self._positions(df, ids, items, "_p")
        placed = self._positions(placed, [s.version], versions, "_v")

        incomplete = F.array_contains(F.array(*[F.col(c).isNull() for c in ids]), True)
        first, second = F.slice("_p", 1, s.slots), F.slice("_p", s.slots + 1, s.slots)
        unknown = F.array(F.lit(-1))
        # A pick on both sides keeps the second side's sign, and a repeated pick counts once.
        minus = F.array_except(second, unknown)
        plus = F.array_except(first, F.concat(second, unknown))
        placed = placed.withColumns(
            {
                "_plus": F.when(incomplete, F.raise_error(f"encoder input: {s.item} ID columns contain missing values").cast("array<int>")).otherwise(plus),
                "_minus": minus,
                **{f"_u{n}": F.lit(s.slots) - F.size(F.array_remove(side, -1)) for n, side in enumerate((first, second))},
            }
        )
        none_int, none_double = F.array().cast("array<int>"), F.array().cast("array<double>")
        index, value = [F.col("_plus"), F.col("_minus")], [
            F.array_repeat(F.lit(1.0), F.size("_plus")),
            F.array_repeat(F.lit(-1.0), F.size("_minus")),
        ]
        for n in range(2):
            seen = F.col(f"_u{n}") > 0
            index.append(F.when(seen, F.array(F.lit(width + n))).otherwise(none_int))
            value.append(F.when(seen, F.array(F.col(f"_u{n}").cast("double"))).otherwise(none_double))
        in_vocabulary = version.isNotNull() & (F.get("_v", 0) >= 0)
        unknown_version = width + 2 + len(versions)
        index.append(F.array(F.when(in_vocabulary, F.get("_v", 0) + width + 2).otherwise(unknown_version)))
        value.append(F.array(F.lit(1.0)))
        pairs = F.sort_array(F.arrays_zip(F.concat(*index).alias("index"), F.concat(*value).alias("value")))

        entries = self.getOrDefault(self.entriesCol)
        return self.with_vector(placed.withColumn(entries, pairs).drop("_p", "_v", "_plus", "_minus", "_u0", "_u1"))

    def with_vector(self, encoded: DataFrame) -> DataFrame:
        """Add the feature vector to rows that have their entries."""
        entries = F.col(self.getOrDefault(self.entriesCol))
        return encoded.withColumn(self.getOrDefault(self.outputCol), sparse_vector(entries, self.feature_names))

    def wide(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """One byte column per feature, in feature order, for export and inspection."""
        encoded = self.transform(df)
        pairs = F.map_from_entries(F.col(self.getOrDefault(self.entriesCol)))
        cells = [
            F.coalesce(F.col("_pairs")[F.lit(i)], F.lit(0.0)).cast("tinyint").alias(name)
            for i, name in enumerate(self.feature_names)
        ]
        return encoded.withColumn("_pairs", pairs).select(*keep, *cells)


def sparse_vector(entries: Column, names: Sequence[str]) -> Column:
    """ML sparse vector from sorted (index, value) pairs, with the feature names as attributes.

    Spark has a built-in function for dense vectors only; the JSON reader fills the vector type
    from its fields inside the JVM, and its cost depends on the non-zero entries alone.
    """
    fields = F.struct(
        F.lit(0).alias("type"),
        F.lit(len(names)).alias("size"),
        entries.getField("index").alias("indices"),
        entries.getField("value").alias("values"),
    )
    holder = T.StructType([T.StructField("v", VectorUDT())])
    vector = F.from_json(F.to_json(F.struct(fields.alias("v"))), holder).getField("v")
    attributes = [{"idx": i, "name": n} for i, n in enumerate(names)]
    metadata = {"ml_attr": {"attrs": {"numeric": attributes}, "num_attrs": len(names)}}
    return vector.alias("features", metadata=metadata)


def binary_target(df: DataFrame, schema: DraftSchema = DRAFT) -> DataFrame:
    """Cast the label to a 0/1 byte after one aggregate has shown that it is binary."""
    _raise_on_target(df.agg(*_target_facts(df, schema)).first(), schema)
    return df.withColumn(schema.label, F.col(schema.label).cast("tinyint"))


def _target_facts(df: DataFrame, schema: DraftSchema) -> list[Column]:
    require_columns(df, [schema.label], "target input")
    label = F.col(schema.label).cast("double")
    return [F.count_if(label.isNull()).alias("null_labels"), F.count_if(~label.isin(0.0, 1.0)).alias("other_labels")]


def _raise_on_target(facts, schema: DraftSchema) -> None:
    if facts["null_labels"]:
        raise ValueError(f"{schema.label} contains missing values")
    if facts["other_labels"]:
        raise ValueError(f"{schema.label} has to be binary")


def _feature_facts(model: DraftEncoderModel) -> list[Column]:
    """Row tests of encoded rows, all inside one aggregate."""
    width, size = len(model.item_vocabulary), len(model.feature_names)
    entries = F.col(model.getOrDefault(model.entriesCol))  # the vector is these entries and nothing else
    picks = F.filter(entries, lambda e: e["index"] < width)
    counts = F.filter(entries, lambda e: (e["index"] >= width) & (e["index"] < width + 2))
    flags = F.filter(entries, lambda e: e["index"] >= width + 2)

    def total(pairs: Column) -> Column:
        return F.aggregate(pairs, F.lit(0.0), lambda acc, e: acc + e["value"])

    accounted = F.size(picks) + total(counts)
    # A row without entries has no features at all, which the null test reports.
    outside = F.exists(entries, lambda e: (e["index"] < 0) | (e["index"] >= size))
    unsigned = F.exists(picks, lambda e: ~e["value"].isin(-1.0, 1.0))
    return [
        F.count("*").alias("rows"),
        F.count_if(entries.isNull()).alias("null_features"),
        F.count_if(outside).alias("outside_features"),
        F.count_if(unsigned).alias("unsigned_picks"),
        F.count_if(accounted != model.schema.picks_per_row).alias("unaccounted_picks"),
        F.count_if(total(flags) != 1).alias("version_flag_errors"),
    ]


def _raise_on_features(facts, model: DraftEncoderModel, forbidden: Sequence[str]) -> None:
    names = model.feature_names
    if facts["outside_features"]:
        raise ValueError("encoded rows do not match the fitted feature list")
    if facts["null_features"]:
        raise ValueError("encoded rows contain missing values")
    if len(set(names)) != len(names):
        raise ValueError("the feature list repeats a name")
    if forbidden_features(names, forbidden):
        raise ValueError(f"the feature list contains forbidden columns: {forbidden_features(names, forbidden)}")
    if facts["unsigned_picks"]:
        raise ValueError("pick features have to be -1, 0 or 1")
    if facts["unaccounted_picks"]:
        raise ValueError(f"{facts['unaccounted_picks']} rows do not account for exactly {model.schema.picks_per_row} picks")
    if facts["version_flag_errors"]:
        raise ValueError(f"{facts['version_flag_errors']} rows do not have exactly one {model.schema.version_prefix} flag")


def validate_features(encoded: DataFrame, model: DraftEncoderModel, forbidden: Sequence[str] = FORBIDDEN) -> None:
    """Fail on the first structural error of the encoded rows; one pass over them."""
    require_columns(encoded, [model.getOrDefault(model.entriesCol)], "encoded rows")
    _raise_on_features(encoded.agg(*_feature_facts(model)).first(), model, forbidden)


def feature_checks(
    encoded: DataFrame,
    model: DraftEncoderModel,
    forbidden: Sequence[str] = STRICT_FORBIDDEN,
    schema: DraftSchema = DRAFT,
    per_split: bool = True,
) -> DataFrame:
    """The validator as a check table; features and label share a row, so they align by construction."""
    label, split = F.col(schema.label), F.col(schema.split)
    entries = F.col(model.getOrDefault(model.entriesCol))
    names = model.feature_names
    rows = {s: F.count_if(split == s).alias(f"rows_{s}") for s in SPLITS}
    targets = {s: F.count_if((split == s) & label.isNotNull()).alias(f"targets_{s}") for s in SPLITS}
    facts = encoded.agg(
        *_feature_facts(model), F.count_if(entries.isNotNull() != label.isNotNull()).alias("unaligned"), *rows.values(), *targets.values()
    )
    no_repeats = F.lit(len(set(names)) == len(names))
    # The published labels of the checks.
    checks = [
        ("No missing feature values", F.col("null_features") == 0),
        ("No duplicate feature columns", no_repeats),
        ("Hero values are -1, 0, or 1", F.col("unsigned_picks") == 0),
        ("Every row accounts for 10 hero picks", F.col("unaccounted_picks") == 0),
        ("Exactly one patch feature per row", F.col("version_flag_errors") == 0),
        ("No forbidden fields in feature matrix", F.lit(not forbidden_features(names, forbidden))),
        ("Feature and target indexes align", F.col("unaligned") == 0),
    ]
    if per_split:
        matching = F.lit(True)
        for s in SPLITS:
            matching = matching & (F.col(f"rows_{s}") == F.col(f"targets_{s}"))
        checks += [
            ("All splits share identical feature columns", F.col("outside_features") == 0),
            ("Split row counts match targets", matching),
        ]
    return check_table(facts, checks)


def pre_model_checks(encoded: DataFrame, model: DraftEncoderModel, schema: DraftSchema = DRAFT) -> DataFrame:
    """The seven checks repeated before training, with the short forbidden list."""
    return feature_checks(encoded, model, FORBIDDEN, schema, per_split=False)


@dataclass(frozen=True)
class PreparedFeatures:
    """Rows with split, 0/1 label, entries and feature vector, and the fitted encoder."""

    frame: DataFrame
    encoder: DraftEncoderModel
    schema: DraftSchema = DRAFT

    @property
    def feature_names(self) -> list[str]:
        return self.encoder.feature_names


def encode_with_train_vocabulary(
    df: DataFrame,
    train_cutoff: str = TRAIN_CUTOFF,
    validation_cutoff: str = VALIDATION_CUTOFF,
    schema: DraftSchema = DRAFT,
    lookup_span: int | None = None,
) -> PreparedFeatures:
    """Split by time, learn the encoder on the training period and encode every row; no checks."""
    split = chronological_split(df, train_cutoff, validation_cutoff, schema)
    encoder = DraftEncoder(schema=schema, lookupSpan=lookup_span)
    encoder._require_input(split)
    # The plain time limit reaches the Parquet scan; the split name alone would not.
    cutoff = F.lit(_cutoffs(train_cutoff, validation_cutoff)[0]).cast("timestamp_ntz")
    train = split.filter(F.col(schema.time) <= cutoff)
    try:
        model = encoder.fit(train)
    except ValueError as error:
        if "empty" in str(error):
            raise ValueError("the chronological split leaves no training rows") from error
        raise
    return PreparedFeatures(model.transform(split), model, schema)


def prepare_features(
    df: DataFrame,
    train_cutoff: str = TRAIN_CUTOFF,
    validation_cutoff: str = VALIDATION_CUTOFF,
    schema: DraftSchema = DRAFT,
) -> PreparedFeatures:
    """Split, encode, build the label and validate.

    Rows are encoded once and stored with their entries; training and scoring read them back. Target and
    feature tests are observed while the rows are written, so they cost no scan. The write has no shuffle
    after the observed step, so a task that runs again is not counted twice.
    """
    require_columns(df, [schema.time], "split input")
    if df.schema[schema.time].dataType.simpleString() != "timestamp_ntz":
        df = df.withColumn(schema.time, F.col(schema.time).cast("timestamp_ntz"))
    if not df.filter(F.col(schema.time).isNull()).isEmpty():
        raise ValueError(f"{schema.time} contains missing values")
    prepared = encode_with_train_vocabulary(df, train_cutoff, validation_cutoff, schema)
    encoder = prepared.encoder
    frame = prepared.frame.drop(encoder.getOrDefault(encoder.outputCol))
    observed = Observation()
    frame = materialize(frame.observe(observed, *_target_facts(frame, schema), *_feature_facts(encoder)))
    facts = observed.get
    _raise_on_target(facts, schema)
    _raise_on_features(facts, encoder, FORBIDDEN)
    labelled = frame.withColumn(schema.label, F.col(schema.label).cast("tinyint"))
    return replace(prepared, frame=encoder.with_vector(labelled))


def encoded_long(prepared: PreparedFeatures, keep: Sequence[str] | None = None) -> DataFrame:
    """Non-zero cells as (key, feature, value).

    Every row has entries, so the outer form drops nothing; the plain form would make the optimizer
    add a test for empty arrays, which repeats the whole encoding below the shuffle.
    """
    keep = list(keep) if keep is not None else [prepared.schema.key]
    cells = prepared.frame.select(*keep, F.inline_outer(prepared.encoder.getOrDefault(prepared.encoder.entriesCol)))
    names = prepared.encoder.feature_table(prepared.frame)
    named = cells.join(F.broadcast(names) if len(prepared.feature_names) <= BROADCAST_ROWS else names, "index")
    return named.select(*keep, "feature", F.col("value").cast("int").alias("value"))


# --- categories first seen after training -----------------------------------------------------


def _known(df: DataFrame, ids: Sequence[int], name: str) -> DataFrame:
    known = df.sparkSession.createDataFrame([(i,) for i in ids], f"{name} bigint")
    return F.broadcast(known) if len(ids) <= BROADCAST_ROWS else known


def unseen_picks(prepared: PreparedFeatures) -> DataFrame:
    """Long picks whose ID is not in the training vocabulary, stored.

    The encoder has counted unknown picks in the row, so only rows that have some are unfolded.
    """
    s, encoder = prepared.schema, prepared.encoder
    width = len(encoder.item_vocabulary)
    entries = F.col(encoder.getOrDefault(encoder.entriesCol))
    touched = prepared.frame.filter(F.exists(entries, lambda e: (e["index"] == width) | (e["index"] == width + 1)))
    picks = picks_long(touched, [s.key, s.time, s.split], s)
    known = _known(picks, encoder.item_vocabulary, f"{s.item}_id")
    return materialize(picks.join(known, f"{s.item}_id", "left_anti"))


def unseen_pick_summary(prepared: PreparedFeatures) -> DataFrame:
    """Unseen picks, IDs and affected matches per split; zero where there are none."""
    s, item = prepared.schema, f"{prepared.schema.item}_id"
    unseen = unseen_picks(prepared).select(F.col(s.split).alias("split"), item, s.key)
    # Two plain counts: one aggregate with two distincts would copy every row.
    by_id = unseen.groupBy("split", item).agg(F.count("*").alias("n"))
    by_match = unseen.groupBy("split", s.key).agg(F.count("*").alias("n"))
    picks = by_id.groupBy("split").agg(F.sum("n").alias("unseen_picks"), F.count(item).alias("unseen_hero_ids"))
    touched = by_match.groupBy("split").agg(F.count(s.key).alias("affected_matches"))
    return all_splits(prepared.frame, picks.join(touched, "split"))  # three rows per side


def unseen_pick_catalog(prepared: PreparedFeatures, chronological: bool = False) -> DataFrame:
    """Unseen IDs with the split of their first pick, number of picks and smallest match key.

    "First" follows the unfolded table: side, slot, then row (time, key); `chronological` puts
    time first instead.
    """
    s = prepared.schema
    side = F.when(F.col("side") == s.sides[0].title(), 0).otherwise(1)
    row_order, slot_order = [F.col(s.time), F.col(s.key)], [side, F.col("slot")]
    order = row_order + slot_order if chronological else slot_order + row_order
    item, name = f"{s.item}_id", f"{s.item}_name"
    return (
        unseen_picks(prepared)
        .filter(F.col(name).isNotNull())
        .groupBy(item, name)
        .agg(
            F.min_by(s.split, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("first_seen_split"),
            F.count("*").alias("picks"),
            F.min(s.key).alias("first_match_id"),
        )
        .orderBy("first_seen_split", item, name)
    )


def unseen_version_rows(prepared: PreparedFeatures) -> DataFrame:
    """Rows whose version is not in the training vocabulary; NULL counts as unseen."""
    s = prepared.schema
    return prepared.frame.join(_known(prepared.frame, prepared.encoder.version_vocabulary, s.version), s.version, "left_anti")


def unseen_version_summary(prepared: PreparedFeatures) -> DataFrame:
    s = prepared.schema
    per_split = unseen_version_rows(prepared).groupBy(F.col(s.split).alias("split")).agg(
        F.count("*").alias("matches_with_unseen_patch"), F.countDistinct(s.version).alias("unseen_patch_ids")
    )
    return all_splits(prepared.frame, per_split)


def unseen_version_catalog(prepared: PreparedFeatures) -> DataFrame:
    s = prepared.schema
    rows = unseen_version_rows(prepared).select(s.split, s.version, s.version_name).distinct()
    return rows.orderBy(s.split, s.version)


# --- reports on the encoded table ---------------------------------------------------------------


def unknown_totals(prepared: PreparedFeatures) -> DataFrame:
    """Unknown picks of either side and rows of unknown version, per split; absent splits are NULL."""
    s, names = prepared.schema, prepared.feature_names
    entries = F.col(prepared.encoder.getOrDefault(prepared.encoder.entriesCol))

    def value_at(index: int) -> Column:
        return F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + F.when(e["index"] == index, e["value"]).otherwise(0.0))

    columns = {c: c for c in s.unknown_counts} | {s.unknown_version: "matches_with_unknown_patch"}
    sums = [F.sum(value_at(names.index(c))).cast("bigint").alias(alias) for c, alias in columns.items()]
    return all_splits(prepared.frame, prepared.frame.groupBy(F.col(s.split).alias("split")).agg(*sums), fill=None)


def _nonzero(prepared: PreparedFeatures) -> Column:
    return F.size(prepared.encoder.getOrDefault(prepared.encoder.entriesCol))


def matrix_split_summary(prepared: PreparedFeatures) -> DataFrame:
    """Rows, feature columns, labelled rows and mean label per split."""
    s = prepared.schema
    per_split = prepared.frame.groupBy(F.col(s.split).alias("split")).agg(
        F.count("*").alias("rows"),
        F.lit(len(prepared.feature_names)).alias("feature_columns"),
        F.count(s.label).alias("target_rows"),
        F.avg(F.col(s.label).cast("int")).alias("label_rate"),
    )
    return per_split.orderBy(split_rank())


def _density(counts: DataFrame, width: int) -> DataFrame:
    total = F.col("rows") * F.lit(width).cast("bigint")
    return counts.withColumn("feature_columns", F.lit(width)).withColumn("total_values", total).withColumn(
        "density", share(F.col("nonzero_values"), F.col("total_values"))
    )


def sparsity(prepared: PreparedFeatures) -> DataFrame:
    """Rows, columns, non-zero cells, all cells and density, one row."""
    counts = prepared.frame.agg(F.count("*").alias("rows"), F.sum(_nonzero(prepared)).alias("nonzero_values"))
    return _density(counts, len(prepared.feature_names))


def split_sparsity(prepared: PreparedFeatures) -> DataFrame:
    counts = prepared.frame.groupBy(F.col(prepared.schema.split).alias("split")).agg(
        F.count("*").alias("rows"), F.sum(_nonzero(prepared)).alias("nonzero_values")
    )
    return _density(counts, len(prepared.feature_names)).orderBy(split_rank())


def active_features(prepared: PreparedFeatures) -> DataFrame:
    """Matches and share by number of non-zero features."""
    counts = prepared.frame.groupBy(_nonzero(prepared).alias("nonzero_feature_columns")).agg(F.count("*").alias("matches"))
    return with_total_share(counts, "matches").orderBy("nonzero_feature_columns")


def feature_manifest(prepared: PreparedFeatures) -> DataFrame:
    """Families of features: size, origin, allowed values and treatment of new categories."""
    m, s = prepared.encoder, prepared.schema
    first, second = s.unknown_counts
    # The published texts of the manifest.
    rows = [
        (1, "Known heroes", len(m.item_vocabulary), "Training hero IDs", "-1, 0, 1", "One column per training hero"),
        (2, "Unknown Radiant heroes", 1, "Future Radiant picks", "0 to 5", f"Count in {first}"),
        (3, "Unknown Dire heroes", 1, "Future Dire picks", "0 to 5", f"Count in {second}"),
        (4, "Known patches", len(m.version_vocabulary), "Training patch IDs", "0 or 1", "One-hot columns"),
        (5, "Unknown patch", 1, "Future patch IDs", "0 or 1", f"Single {s.unknown_version} flag"),
    ]
    layout = "position int, feature_family string, columns int, source string, `values` string, handling string"
    return prepared.frame.sparkSession.createDataFrame(rows, layout)


def vocabulary_summary(prepared: PreparedFeatures) -> DataFrame:
    """Size, smallest and largest ID of both vocabularies."""
    rows = [
        (kind, len(ids), ids[0], ids[-1])
        for kind, ids in (("item", prepared.encoder.item_vocabulary), ("version", prepared.encoder.version_vocabulary))
    ]
    return prepared.frame.sparkSession.createDataFrame(rows, "kind string, size int, min_id bigint, max_id bigint")
