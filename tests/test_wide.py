"""Vocabularies as stored tables."""

import os
import subprocess
import sys
import tempfile

import pytest

from draftline.operators import encode as enc, split as sp, wide
from draftline.schema import DRAFT

from fixtures import match, matches, signal_rows

WIDE = """
import sys, tempfile
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from draftline.operators import wide
from draftline.schema import DRAFT
spark = (SparkSession.builder.master("local[4]").config("spark.driver.memory", "1g").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "16").config("spark.checkpoint.dir", {folder!r}).getOrCreate())
n = 500_000  # ten different IDs a row: five million, spread over 64 bits
ids = [F.abs(F.xxhash64("id", F.lit(i))).alias(c) for i, c in enumerate(DRAFT.pick_ids())]
train = spark.range(n).select(F.col("id").alias(DRAFT.key), *ids, (F.col("id") % 50).alias(DRAFT.version))
known = wide.fit_stored(train)
cells = wide.encode_stored(train, known)
low, high, rows, different = cells.where("feature LIKE 'hero%'").agg(F.min("index"), F.max("index"), F.count("*"), F.approx_count_distinct("index")).first()
print("RESULT", known.items, known.versions, low, high, rows)
"""


def test_a_stored_vocabulary_encodes_like_one_on_the_driver(spark):
    rows = signal_rows() + [match(900, "2024-02-01", 1)]
    split = sp.chronological_split(matches(spark, rows))
    split = split.replace(3, 999, subset=[DRAFT.pick_ids()[0], DRAFT.pick_ids()[7]])
    train = sp.of_split(split, "train")
    known = wide.fit_stored(train)
    model = enc.DraftEncoder().fit(train)
    assert (known.items, known.versions) == (len(model.item_vocabulary), len(model.version_vocabulary))
    prepared = enc.PreparedFeatures(model.transform(split), model)
    found = sorted(tuple(r) for r in wide.encode_stored(split, known).select(DRAFT.key, "feature", "value").collect())
    assert found == sorted(tuple(r) for r in enc.encoded_long(prepared).collect())
    names = {r["index"]: r["feature"] for r in wide.encode_stored(split, known).select("index", "feature").distinct().collect()}
    assert all(model.feature_names[i] == name for i, name in names.items())


def test_missing_values_and_empty_tables_are_errors(spark):
    train = sp.chronological_split(matches(spark, signal_rows()))
    with pytest.raises(ValueError, match="empty table"):
        wide.fit_stored(train.limit(0))
    with pytest.raises(ValueError, match="missing values"):
        wide.fit_stored(train.withColumn(DRAFT.version, train[DRAFT.version] * None))


def test_five_million_ids_on_a_driver_of_one_gigabyte():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = WIDE.format(root=root, folder=tempfile.mkdtemp(prefix="draftline-wide-"))
    environment = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))}
    run = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=600, env=environment)
    found = [line.split()[1:] for line in run.stdout.splitlines() if line.startswith("RESULT")]
    assert found == [["5000000", "50", "0", "4999999", "5000000"]], run.stderr[-2000:]
