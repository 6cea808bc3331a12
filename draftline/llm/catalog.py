"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.storage import checkpoint_folder
from .common import store, table
from .conversation_repair import repair_damaged
from .histogram_packing import encode_pieces, pack_histogram
from .html_text import extract
from .language import predict, train
from .mixing import taken
from .neighbours import search
from .oracle import ORACLE_SQL as ORACLE_SQL
from .packing import cut_pieces, pack
from .periodic_runs import collapse_runs, digests, with_planted_runs
from .quality_rules import apply_rules
from .simhash import near_duplicates
from .suffix_dedup import remove_repeats
from .token_counts import token_counts, unigram_scores
from .token_files import encode_documents, read_tokens, with_crc, write_tokens


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return token_counts(docs, unigram_scores(docs, public_tokenizers.path("piece_bpe_32k.model")))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return apply_rules(table(spark, folder, "documents"))


def op3_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return taken(table(spark, folder, "documents"))


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{checkpoint_folder(spark)}/llm-tokens-{uuid.uuid4().hex}"
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    write_tokens(encode_documents(table(spark, folder, "documents"), tokenizer, end_id=2), path)
    return with_crc(read_tokens(spark, path))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return predict(docs, train(docs))


def op9_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return search(table(spark, folder, "embeddings"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    pieces = cut_pieces(table(spark, folder, "documents"), tokenizer, end_id=0, with_ids=False)
    return pack(store(pieces, "pieces"))


def op11_histogram_packing(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    pieces = encode_pieces(table(spark, folder, "documents"), tokenizer, end_id=1)
    return pack_histogram(store(pieces, "window-pieces"))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair_damaged(table(spark, folder, "conversations"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return digests(collapse_runs(docs.withColumn("text", with_planted_runs(F.col("text"), F.col("doc_id")))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_quality_rules": op2_quality_rules,
    "op3_html_text": op3_html_text,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_mixing": op5_mixing,
    "op6_token_files": op6_token_files,
    "op7_simhash": op7_simhash,
    "op8_language_id": op8_language_id,
    "op9_neighbours": op9_neighbours,
    "op10_packing": op10_packing,
    "op11_histogram_packing": op11_histogram_packing,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_periodic_runs": op13_periodic_runs,
}
