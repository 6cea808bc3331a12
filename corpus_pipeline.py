"""The corpus pipeline: language identification, near and exact deduplication, mixing, packing.

Every stage takes the table its predecessor kept. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from draftline.llm.common import prepare, store, table, with_row_key
from draftline.llm.language import UNKNOWN, fit, predict, train
from draftline.llm.mixing import mix
from draftline.llm.packing import cut_pieces, pack
from draftline.llm.simhash import near_duplicates
from draftline.llm.suffix_dedup import remove_repeats

#: Bytes of a string that the pipeline removes where it repeats. A passage of over 50 words has some 285 bytes or
#: more in these texts; 256 leaves none of them, while phrases and sentences that documents share by chance stay.
REPEATED_BYTES = 256
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: NULL texts, no letters, or two languages about equally near.

    If no row to learn from has a label, there are no languages to tell apart, and all texts with a letter stay.
    """
    prepare(spark)
    model = train(docs)
    if not model.classes:  # one class for all
        model = fit(np.zeros((1, model.size), np.float32), ["any"], model.size)
    judged = predict(docs, model, extra=tuple(c for c in COLUMNS if c != "doc_id"))
    return judged.where((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous")).select(*COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays: that of the smallest doc_id, NULL last.

    Rows are told apart by their content, so of repeated rows one stays, and a group without any doc_id
    keeps one document, too.
    """
    prepare(spark)
    keyed = with_row_key(docs.select(*COLUMNS))
    identity = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_k1", "_k2").alias("row")
    found = near_duplicates(keyed.select(identity, "text"), "row")
    keepers = found.where(F.col("row") == F.col("component_id")).select("row._k1", "row._k2").distinct()
    first = Window.partitionBy("_k1", "_k2").orderBy("lang", "n_chars")
    kept = keyed.join(keepers, ["_k1", "_k2"], "left_semi").withColumn("_turn", F.row_number().over(first))
    return kept.where("_turn = 1").select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of `REPEATED_BYTES` bytes are cut out; n_chars follows the text. A character of which only some
    bytes stay is left out. Documents of which nothing stays remain, with an empty text."""
    prepare(spark)
    cut = remove_repeats(docs.select(*COLUMNS), length=REPEATED_BYTES, rewrite=True)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shard by shard in shuffled order."""
    prepare(spark)
    return mix(docs.select(*COLUMNS)).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 2048 tokens."""
    prepare(spark)
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return pack(store(cut_pieces(docs, tokenizer, end_id=0, with_ids=False), "pieces"))


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("suffix_dedup", suffix_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Hashing by XXH64, a fitted classifier and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each one's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
