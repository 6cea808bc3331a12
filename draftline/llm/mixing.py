"""Mixing sources to target weights, dealt over output shards by a splitting tree."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import in_batches, merged, n_words, store, with_row_key

WEIGHTS = (3, 1, 2)
#: Fixed value: fewer blocks than this are drawn by the library.
LIBRARY_LIMIT = 1_000_000_000
_ROW = ["_k1", "_k2"]
_GROUP = ["position", "_perm", "size", "_byte"]


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150) -> DataFrame:
    """Add position, weight and target to one row per source (source, n, source_size).

    Sources by code point, NULL last, take the weights in turn and share `percent` of all sizes; no
    target exceeds twice its source's size, what is above is shared again by weight. Sources that
    are full at a smaller size per weight fill up first, so one pass in that order finds them all.
    Whole numbers until the last division. The table has one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    df = sizes.withColumn("position", F.row_number().over(by_name) - 1)
    cycle = F.array(*[F.lit(w) for w in weights])
    big = lambda x: x.cast("decimal(38,0)")
    df = df.withColumn("weight", cycle[F.col("position") % len(weights)]).withColumn("_cap", big(2 * F.col("source_size")))
    filling = Window.orderBy((F.col("_cap") / F.col("weight")), "position")
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn(
        "_left",
        F.lit(percent) * big(F.sum("source_size").over(everything))
        - 100 * big(F.coalesce(F.sum("_cap").over(before), F.lit(0))),
    ).withColumn("_open", F.sum("weight").over(after))
    fits = 100 * F.col("_cap") * F.col("_open") >= F.col("_left") * F.col("weight")
    df = df.withColumn("_fits", fits).withColumn("_turn", F.row_number().over(filling))
    level = F.min(F.when(F.col("_fits"), F.struct("_turn", "_left", "_open"))).over(everything)
    df = df.withColumn("_level", level)
    shared = (F.col("_level._left") * F.col("weight")).cast("double") / (100 * F.col("_level._open")).cast("double")
    full = F.col("_level").isNull() | (F.col("_turn") < F.col("_level._turn"))
    df = df.withColumn("target", F.when(full, F.col("_cap").cast("double")).otherwise(shared))
    return df.drop("_cap", "_left", "_open", "_fits", "_turn", "_level")


def plan_copies(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """One row per row of `docs`: its keys, doc_id, size, source_size, target, and how often it is taken.

    Whole documents are taken: each source as many times as its target has whole rounds, and then a
    prefix of its documents in the order of md5(seed, doc_id), up to the document whose middle reaches
    the target. Rows that also agree in size and in the first byte of their key form a group; a group's
    places follow from its number of rows, and groups are added up per (source, first three hex digits).
    So neither a source nor a NULL or repeated doc_id, however large, is ordered by one task: of such a
    doc_id one task sees one row per size and byte. Only rows equal in all columns stay together.
    """
    perm = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = with_row_key(docs).select(
        *_ROW, "doc_id", "source", n_words(F.col("text")).alias("size"), perm.alias("_perm")
    )
    sized = store(sized, "sizes")
    sources = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    sources = store(targets(sources).withColumnRenamed("source", "_source"), "targets")
    joined = sized.join(sources, sized.source.eqNullSafe(F.col("_source")))
    joined = joined.withColumn("_byte", F.shiftright("_k1", 56))
    groups = joined.groupBy(*_GROUP).agg(F.count("*").alias("_n"))
    groups = store(groups.withColumn("_bucket", F.substring("_perm", 1, 3)).withColumn("_s", F.col("_n") * F.col("size")), "size-groups")
    buckets = groups.groupBy("position", "_bucket").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))

    def before(column: str, window: Window) -> Column:
        return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    earlier = Window.partitionBy("position").orderBy("_bucket")
    bases = buckets.select("position", "_bucket", before("_n", earlier).alias("_n0"), before("_s", earlier).alias("_s0"))
    inside = Window.partitionBy("position", "_bucket").orderBy("_perm", "size", "_byte")
    starts = groups.withColumns({"_n1": before("_n", inside), "_s1": before("_s", inside)}).join(bases, ["position", "_bucket"])
    starts = starts.select(*_GROUP, (F.col("_n0") + F.col("_n1")).alias("_n"), (F.col("_s0") + F.col("_s1")).alias("_s"))
    turn = F.row_number().over(Window.partitionBy(*_GROUP).orderBy(*_ROW)) - 1
    ranked = joined.withColumn("_turn", turn).join(merged(starts), _GROUP)
    ranked = ranked.withColumn("rank", F.col("_n") + F.col("_turn")).withColumn("_before", F.col("_s") + F.col("_turn") * F.col("size"))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    ranked = ranked.withColumn("_rounds", rounds).withColumn(
        "_extra", F.col("target") - F.col("_rounds") * F.col("source_size")
    )
    more = (F.col("_extra") > 0) & (2 * F.col("_before") + F.col("size") <= 2 * F.col("_extra"))
    copies = (F.col("_rounds") + more.cast("int")).cast("int")
    columns = [*_ROW, "doc_id", "size", "source_size", "target", "position", "n", "rank", copies.alias("copies")]
    return store(ranked.select(*columns), "copies")


def split_quota(quota: np.ndarray, part: int, random: np.random.Generator) -> np.ndarray:
    """How many blocks of each source fall into a random part of all: multivariate hypergeometric.

    Beyond the library's limit, every block is first taken by a coin of the part's share, one binomial per
    source. Given its size, such a set is uniformly random; so it becomes the part by a uniformly random
    removal of what is too much, or choice of what is missing. That is the same draw of about the square
    root of the size, so a few rounds lead below the limit, and the distribution is the exact one.
    """
    total = int(quota.sum())
    if total < LIBRARY_LIMIT:
        return random.multivariate_hypergeometric(quota, part, method="marginals")
    if 2 * part > total:
        return quota - split_quota(quota, total - part, random)
    if part <= 64:  # one after the other
        out = np.zeros_like(quota)
        for _ in range(part):
            out[np.searchsorted(np.cumsum(quota - out), random.integers(int((quota - out).sum())), side="right")] += 1
        return out
    coins = random.binomial(quota, part / total)
    missing = part - int(coins.sum())
    if missing < 0:
        return coins - split_quota(coins, -missing, random)
    return coins + split_quota(quota - coins, missing, random)


def shard_quotas(quota: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each source in one shard.

    Walks down the splitting tree: a node's draw depends on the seed and the node alone, so every
    shard finds the same draws on its way and the shards' ranges are disjoint and complete.
    """
    total, low, high = int(quota.sum()), 0, shards
    first = np.zeros_like(quota)
    while high - low > 1:
        middle = (low + high) // 2
        part = total * middle // shards - total * low // shards
        left = split_quota(quota, part, np.random.default_rng([seed, low, high]))
        if shard < middle:
            quota, high = left, middle
        else:
            first, quota, low = first + left, quota - left, middle
    return first, quota


def place(planned: DataFrame, shard_blocks: int = 4096, seed: int = 11) -> DataFrame:
    """shard and place of every taken copy (a block): position, rank, round, shard, place.

    A source's blocks are numbered round by round in its permuted order. The tree gives each shard a
    range of numbers per source; inside a shard, blocks are shuffled by a hash. The driver holds one
    number per source.
    """
    quotas = planned.groupBy("position").agg(F.sum("copies").alias("q")).where("q > 0").orderBy("position").collect()
    names = np.array([r["position"] for r in quotas], dtype=np.int32)
    quota = np.array([r["q"] for r in quotas], dtype=np.int64)
    shards = max(1, -(-int(quota.sum()) // shard_blocks))

    def ranges(batches):
        import pyarrow as pa

        def one(batch):
            for shard in batch.column(0).to_pylist():
                first, count = shard_quotas(quota, shards, shard, seed)
                some = count > 0
                low, high = first[some], (first + count)[some]
                arrays = [pa.array(names[some]), pa.array(low), pa.array(high), pa.array([shard] * len(low), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["_p", "_low", "_high", "shard"])

        yield from in_batches(one)(batches)

    spark = planned.sparkSession
    table = spark.range(shards).mapInArrow(ranges, "_p int, _low bigint, _high bigint, shard bigint")
    width = 1024
    table = table.withColumn("_chunk", F.explode(F.expr(f"sequence(_low div {width}, (_high - 1) div {width})")))
    blocks = planned.where("copies > 0").select("position", "n", "rank", F.explode(F.expr("sequence(0, copies - 1)")).alias("round"))
    blocks = blocks.withColumn("_block", F.col("round") * F.col("n") + F.col("rank"))
    blocks = blocks.withColumn("_c", F.expr(f"_block div {width}"))
    placed = blocks.join(merged(table), (F.col("position") == F.col("_p")) & (F.col("_c") == F.col("_chunk")))
    placed = placed.where((F.col("_block") >= F.col("_low")) & (F.col("_block") < F.col("_high")))
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "position", "_block"), "position", "_block")
    placed = placed.withColumn("place", F.row_number().over(shuffled) - 1)
    return placed.select("position", "rank", "round", "shard", "place")


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row: what the placed blocks hold of it.

    NULL texts have size zero, NULL is the last source, an empty table gives no rows. Repeated rows are
    rows of their own. A document is taken whole, at most twice.
    """
    planned = plan_copies(docs)
    blocks = place(planned).groupBy("position", "rank").agg(F.count("place").alias("_blocks"))
    joined = planned.join(blocks, ["position", "rank"], "left")
    amount = (F.coalesce("_blocks", F.lit(0)) * F.col("size")).cast("long")
    return joined.select("doc_id", "size", "source_size", "target", amount.alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The columns of `docs`, one row per taken copy, with shard and place; rows of a shard lie together
    in their shuffled order."""
    planned = plan_copies(docs)
    where = place(planned).join(merged(planned.select(*_ROW, "position", "rank")), ["position", "rank"])
    # equal rows stand for each other: one of them meets the places of all
    one = Window.partitionBy(*_ROW).orderBy(F.lit(0))
    rows = with_row_key(docs).withColumn("_turn", F.row_number().over(one)).where("_turn = 1")
    out = rows.join(merged(where.select(*_ROW, "shard", "place")), _ROW).select(*docs.columns, "shard", "place")
    return out.repartition(F.col("shard")).sortWithinPartitions("shard", "place")

