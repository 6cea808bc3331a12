"""Token ids in Parquet files that can be read selectively, in ascending document order."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import in_batches, partitions

#: Encodings of the columns. Ids keep a dictionary (one per row group, 16 bits a token or less) or
#: take delta encoding; the ascending numbers beside them always take delta encoding.
_DICTIONARY = "parquet.enable.dictionary"
_SAMPLED = 40


def _text_limits(docs: DataFrame, parts: dict, rows: int, blocks: int) -> dict[float | None, list[str]]:
    """Texts that cut the rows of each doc_id in `parts` (None for NULL) into about so many ranges: quantiles of a
    sample of some `_SAMPLED` beginnings of texts a block."""
    if not parts:
        return {}
    wanted = F.col("doc_id").isin([int(x) for x in parts if x is not None])
    wanted = wanted | F.col("doc_id").isNull() if None in parts else wanted
    texts = docs.where(wanted).sample(min(1.0, _SAMPLED * blocks / rows), seed=0)
    found = defaultdict(list)
    for doc_id, text in texts.select("doc_id", F.substring("text", 1, 128)).collect():
        found[None if doc_id is None else float(doc_id)].append(text)
    limits = {}
    for key, seen in found.items():
        seen.sort(key=lambda x: x.encode())
        limits[key] = list(dict.fromkeys(seen[len(seen) * i // parts[key]] for i in range(1, parts[key])))
    return limits


def with_blocks(docs: DataFrame, blocks: int) -> tuple[DataFrame, int]:
    """Add `block`, which rises with (doc_id, text), NULL last; and the number of blocks.

    Blocks begin at quantiles of doc_id. A doc_id that is several quantiles at once, or a NULL doc_id that would
    fill several blocks, is dealt over as many ranges of text. All limits are constants of the plan, so a task that
    runs again deals alike. Rows that agree in doc_id and in the first 128 characters stay together.
    """
    cuts = F.array(*[F.lit(i / blocks) for i in range(1, blocks)])
    quantiles = F.percentile_approx("doc_id", cuts, F.lit(max(10_000, 20 * blocks))) if blocks > 1 else F.array()
    rows, known, found = docs.agg(F.count("*"), F.count("doc_id"), quantiles).first()
    times = Counter(map(float, found or [0]))
    starts = sorted(times)
    # larger numbers than 2**53 are not told apart here, so none of them is taken for one doc_id
    parts = {x: n for x, n in times.items() if n > 1 and abs(x) <= 2**53}
    if rows and (nulls := -(-blocks * (rows - known) // rows)) > 1:
        parts[None] = nulls
    limits = _text_limits(docs, parts, rows, blocks)

    splits = [float("-inf"), *starts, float("inf")]
    ranges = Bucketizer(splits=splits, inputCol="_number", outputCol="_range", handleInvalid="keep")
    df = ranges.transform(docs.withColumn("_number", F.col("doc_id").cast("double")))
    df = df.withColumn("_range", F.col("_range").cast("int"))
    # each range has the blocks of the doc_id it starts with, if that has some of its own, and one for the others
    own = [0] + [len(limits[x]) + 1 if x in limits else 0 for x in starts]
    base = [0]
    for n in own:
        base.append(base[-1] + n + 1)

    def of_range(values: list) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("_range"))

    def place(texts: list[str]) -> Column:
        below = F.array(*[F.lit(x) for x in texts]).cast("array<string>")
        return F.size(F.filter(below, lambda x: x <= F.col("text")))

    part = of_range(own)
    for x in starts:
        if x in limits:
            part = F.when(F.col("_number") == x, place(limits[x])).otherwise(part)
    last = F.lit(base[-1]) + place(limits.get(None, []))
    block = F.when(F.col("doc_id").isNull(), last).otherwise(of_range(base[:-1]) + part)
    df = df.withColumn("block", block.cast("int")).drop("_number", "_range")
    return df, base[-1] + len(limits.get(None, [])) + 1


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """block, first, doc_id, n_tokens, ids of all documents, blocks and rows in ascending doc_id order.

    `block` is the range of documents that one task encodes, `first` the ids before the document in its
    block. NULL and empty texts give the end id alone. A NULL doc_id comes last; equal doc_ids are
    ordered by text. Texts are encoded after they are dealt, so only one pass runs Python.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranged, blocks = with_blocks(docs, partitions(docs.sparkSession))
    dealt = ranged.repartitionById(blocks, F.col("block")).sortWithinPartitions(
        F.col("block"), F.col("doc_id").asc_nulls_last(), "text"
    )

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        from .tokens import encoder

        ids_of, first, block = encoder(tokenizer), 0, None

        def one(batch):
            nonlocal first, block
            ids, at = ids_of.encode(batch.column("text"), end_id)
            sizes, blocks, firsts = np.diff(at), batch.column("block").to_pylist(), []
            for b, size in zip(blocks, sizes.tolist()):
                if b != block:
                    block, first = b, 0
                firsts.append(first)
                first += size
            columns = {
                "block": batch.column("block"),
                "first": pa.array(firsts, pa.int64()),
                "doc_id": batch.column("doc_id").cast(pa.int64()),
                "n_tokens": pa.array(sizes),
                "ids": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))),
            }
            yield pa.RecordBatch.from_pydict(columns)

        yield from in_batches(one)(batches)

    return dealt.mapInArrow(encode, "block int, first bigint, doc_id bigint, n_tokens bigint, ids array<int>")


def write_tokens(
    encoded: DataFrame, path: str, dictionary: bool = True, row_group_mb: int = 32, page_kb: int = 256
) -> None:
    """Write with row groups and pages of the given size; Parquet's page indexes come with them.

    Ids use dictionary encoding or, without it, delta encoding (version 2 pages).
    """
    options = {
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": str(row_group_mb << 20),
        "parquet.page.size": str(page_kb << 10),
        "parquet.page.row.count.limit": "1000",
        _DICTIONARY: "false",
        f"{_DICTIONARY}#ids.list.element": str(dictionary).lower(),
        f"{_DICTIONARY}#block": "true",
    }
    encoded.write.options(**options).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens of each document; the ids are not read."""
    return _with_start(spark.read.parquet(path).drop("ids"), spark, path)


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Documents with their ids. A range of doc_id reaches the files as a filter, so that row groups
    and pages outside it are skipped; `start` still counts all documents before."""
    rows = spark.read.parquet(path)
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") <= high)
    return _with_start(rows, spark, path)


def _with_start(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    sizes = spark.read.parquet(path).groupBy("block").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # one row per block, of which there are some twice as many as shuffle partitions
    bases = sizes.select("block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    joined = rows.join(F.broadcast(bases), "block")
    return joined.withColumn("start", F.col("_base") + F.col("first")).drop("block", "first", "_base")


def with_crc(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document's ids as little-endian 32-bit numbers."""

    def digest(batches):
        import numpy as np
        import pyarrow as pa

        def one(batch):
            ids = batch.column("ids")
            values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4")
            offsets = ids.offsets.to_pylist()
            crc = [zlib.crc32(values[a:b].data) for a, b in zip(offsets, offsets[1:])]
            columns = [batch.column(c) for c in ("doc_id", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

        yield from in_batches(one, 4096)(batches)

    columns = tokens.select("doc_id", "start", "n_tokens", "ids")
    return columns.mapInArrow(digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
