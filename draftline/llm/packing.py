"""Best-fit packing by minimum bin slack over lengths."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import in_batches, partitions

_PIECE = "piece int, start bigint, length bigint, ids array<int>, ids_crc32 bigint"


def cut_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, with_ids: bool = True, id_column: str = "doc_id"
) -> DataFrame:
    """Pieces of at most `capacity` ids, one document's after the other: doc_id, piece, start, length, ids, ids_crc32.

    A text's ids end with `end_id`; NULL and empty texts have that id alone. Only longer documents are
    cut; all pieces but the first are full. Repeated rows give repeated pieces; other columns are ignored.
    """
    names = [id_column, *[x.split()[0] for x in _PIECE.split(", ")]]
    if not with_ids:
        names.remove("ids")

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        from .tokens import encoder

        ids_of = encoder(tokenizer)

        def one(batch):
            ids, at = ids_of.encode(batch.column(1), end_id)
            sizes = np.diff(at)
            n = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            first = (sizes - 1) % capacity + 1
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[row], capacity)
            begin = at[row] + start
            crc = [zlib.crc32(ids[a:b].data) for a, b in zip(begin.tolist(), (begin + length).tolist())]
            arrays = {
                id_column: batch.column(0).take(pa.array(row)),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start),
                "length": pa.array(length),
                "ids_crc32": pa.array(crc, pa.int64()),
            }
            if with_ids:  # pieces follow each other just as the ids do
                ends = np.append(begin, at[-1]).astype(np.int32)
                arrays["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([arrays[n] for n in names], names)

        yield from in_batches(one)(batches)

    fields = [docs.schema[id_column], *[f for f in T._parse_datatype_string(_PIECE).fields if f.name in names]]
    columns = docs.select(id_column, F.coalesce("text", F.lit("")).alias("text"))
    return columns.mapInArrow(encode, T.StructType(fields))


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Which of the available lengths fill `room` as far as possible: length -> how many.

    Subset sums are the bits of one integer; lengths come in falling order until the room can be
    filled exactly, and small lengths are spared on the way back.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        steps.append((length, reach))
        for _ in range(min(counts[length], room // length)):
            if (more := (reach | reach << length) & mask) == reach:
                break
            reach = more
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        k = 0
        while not before >> at & 1:
            at, k = at - length, k + 1
        if k:
            chosen[length] = k
    return chosen


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(content of a bin, how many such bins), by minimum bin slack.

    The longest length left opens a bin; the fullest feasible combination joins it and is removed,
    as many times as the counts allow. Every entry uses up at least one length, or leaves fewer of
    it than a bin takes, so the plan's size depends on the capacity and not on the number of pieces.
    """
    left, plan = {k: v for k, v in counts.items() if v}, []
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        content = fullest({k: v for k, v in rest.items() if v}, capacity - longest)
        content[longest] = content.get(longest, 0) + 1
        times = min(left[k] // m for k, m in content.items())
        plan.append((content, times))
        for k, m in content.items():
            left[k] -= m * times
            if not left[k]:
                del left[k]
    return plan


def pack(pieces: DataFrame, capacity: int = 2048, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add sequence_id and offset to each piece; `length` is 1 to `capacity`. Pass a stored table.

    The driver sees one count per length and plans bins for lengths, not for pieces. A piece's
    number among those of its length (`order` and ids_crc32 decide; full ties are the same) tells
    its bin. A length may hold a third of all pieces, and so may a NULL doc_id: they are numbered in hash
    buckets of `order` and ids_crc32, each starting at the sum of the buckets before. Empty tables stay empty; other columns are carried along.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError(f"lengths must be 1 to {capacity}")
    slots, sequence, used = [], 0, dict.fromkeys(counts, 0)
    for content, times in plan_bins(counts, capacity):
        offset = 0
        for length in sorted(content, reverse=True):
            m = content[length]
            slots.append((length, used[length], m, sequence, offset))
            used[length] += m * times
            offset += m * length
        sequence += times
    slots.sort()

    salts = partitions(pieces.sparkSession)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order, "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    starts = sums.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    within = Window.partitionBy("length", "_salt").orderBy(*[F.col(c).asc_nulls_last() for c in order], "ids_crc32")
    numbered = salted.withColumn("_k", F.row_number().over(within)).join(starts, ["length", "_salt"])
    numbered = numbered.withColumn("_k", F.col("_from") + F.col("_k") - 1).select(*pieces.columns, "_k")

    columns = pieces.columns

    def place(batches):
        import numpy as np
        import pyarrow as pa

        table = np.array(slots, dtype=np.int64).reshape(-1, 5)
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            k = batch.column("_k").to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(keys, (length << 44) + k, side="right") - 1]
            local, m = k - row[:, 1], row[:, 2]
            arrays = [batch.column(c) for c in columns]
            arrays += [pa.array(row[:, 3] + local // m), pa.array(row[:, 4] + local % m * length)]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "sequence_id", "offset"])

    added = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return numbered.mapInArrow(place, T.StructType([*pieces.schema.fields, *added]))
