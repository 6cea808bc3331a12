"""Packing by non-negative least squares over a histogram of lengths."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import in_batches, store

_PIECE = "doc_tokens bigint, start bigint, length bigint, part int, turn bigint, ids_crc32 bigint, ids binary"


def _binary(offsets, ids):
    """Arrow binaries between byte offsets of an array of ids."""
    import pyarrow as pa

    buffers = [None, pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(ids.astype("<u4", copy=False))]
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, buffers)


def encode_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, id_column: str = "doc_id") -> DataFrame:
    """Every document's ids with `end_id`, cut into full windows and a rest: the ID, doc_tokens, start,
    length, part, turn, ids_crc32, ids (little-endian unsigned 32-bit numbers).

    `part` is the input split, `turn` the number of the piece among those of its length in that split:
    together they order the pieces of a length without a sort. NULL and empty texts have the end id alone.
    Repeated rows give repeated pieces; other columns are ignored.
    """

    def encode(batches):
        import numpy as np
        import pyarrow as pa

        from .tokens import encoder

        ids_of, seen = encoder(tokenizer), np.zeros(capacity + 1, dtype=np.int64)

        def one(batch):
            nonlocal seen
            ids, at = ids_of.encode(batch.column(1), end_id)
            sizes = np.diff(at)
            n = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), n)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * capacity
            length = np.minimum(sizes[row] - start, capacity)
            order = np.argsort(length, kind="stable")
            ranked = length[order]
            turn = np.empty(len(row), dtype=np.int64)
            turn[order] = np.arange(len(row)) - np.searchsorted(ranked, ranked) + seen[ranked]
            seen = seen + np.bincount(length, minlength=capacity + 1)
            begin = at[row] + start
            crc = [zlib.crc32(ids[a:b].data) for a, b in zip(begin.tolist(), (begin + length).tolist())]
            yield pa.RecordBatch.from_pydict(
                {
                    id_column: batch.column(0).take(pa.array(row)),
                    "doc_tokens": pa.array(sizes[row]),
                    "start": pa.array(start),
                    "length": pa.array(length),
                    "part": batch.column(2).take(pa.array(row)),
                    "turn": pa.array(turn),
                    "ids_crc32": pa.array(crc, pa.int64()),
                    "ids": _binary(np.append(begin, at[-1]) * 4, ids),  # pieces follow each other as the ids do
                }
            )

        yield from in_batches(one)(batches)

    fields = [docs.schema[id_column], *T._parse_datatype_string(_PIECE).fields]
    columns = docs.select(id_column, F.coalesce(F.col("text").cast("string"), F.lit("")), F.spark_partition_id().alias("part"))
    return columns.mapInArrow(encode, T.StructType(fields))


def fillings(counts, depth: int = 3):
    """All combinations of at most `depth` lengths that fill the window exactly, one per row, longest first.

    `counts[x]` says how many pieces have length x; the window is the last index. Unused places are 0.
    """
    import numpy as np

    window, have = len(counts) - 1, np.asarray(counts) > 0
    have[0] = False
    lengths = np.flatnonzero(have)
    rows = [np.array([[window]])] if have[window] else []
    open_ = lengths[:, None]  # combinations that still leave room for one more length, none longer than the last
    for size in range(2, depth + 1):
        last = window - open_.sum(axis=1)
        fits = (last > 0) & (last <= open_[:, -1])
        full = np.column_stack([open_[fits], last[fits]])
        rows.append(full[have[full[:, -1]]])
        if size < depth:
            grown = []
            for x in lengths.tolist():  # x joins all combinations that end in x or more and still leave room
                some = open_[(open_[:, -1] >= x) & (open_.sum(axis=1) + x < window)]
                grown.append(np.column_stack([some, np.full(len(some), x)]))
            open_ = np.concatenate(grown) if grown else open_[:0]
    found = np.concatenate([np.pad(r, ((0, 0), (0, depth - r.shape[1]))) for r in rows] or [np.zeros((0, depth), int)])
    # no more of one length than there are pieces
    ok = np.ones(len(found), dtype=bool)
    for place in range(depth):
        x = found[:, place]
        ok &= (x == 0) | ((found == x[:, None]).sum(axis=1) <= np.asarray(counts)[x])
    return found[ok].astype(np.int64)


def repeats(rows, counts, rounds: int = 30, retries: int = 6, steps: int = 80):
    """How often to use each combination: min |W(Ax - counts)|, x >= 0, by an active set.

    W weighs a length by itself, for what is left over costs tokens. Combinations whose use would lower the
    sum most join the set, at most one per length and round; the least squares on the set come from
    conjugate gradients; what turns negative leaves. The sum never rises; more rounds, retries and steps
    bring it nearer to the least, which changes the plan, never its validity. Few combinations are ever used, so rounding costs little.
    """
    import numpy as np

    window = len(counts) - 1
    weight = (np.arange(window + 1) / window) ** 2  # squares of W
    target = np.asarray(counts, dtype=float)
    places = range(rows.shape[1])
    used = lambda c, x: sum(np.bincount(c[:, k], x, minlength=window + 1) for k in places) if len(c) else np.zeros(window + 1)

    def gain(c, left):
        pull = weight * left
        pull[0] = 0
        return pull[c].sum(axis=1)

    def solve(c, x):
        """Conjugate gradients on the normal equations of the set, from x."""
        x = x.copy()
        slope = gain(c, target - used(c, x))
        way, size = slope.copy(), slope @ slope
        first = size
        for _ in range(steps):
            if size <= 1e-12 * max(first, 1e-300):
                break
            through = used(c, way)
            curve = (weight * through * through)[1:].sum()
            if curve <= 0:
                break
            x += size / curve * way
            slope -= size / curve * gain(c, through)
            size, before = slope @ slope, size
            way = slope + size / before * way
        return x

    active, x = np.zeros(0, dtype=np.int64), np.zeros(0)
    norm = np.sqrt(np.maximum(weight[rows].sum(axis=1), 1e-12)) if len(rows) else np.zeros(0)
    least, batch = np.inf, window
    for _ in range(rounds):
        left = target - used(rows[active], x)
        rest = (weight * left * left)[1:].sum()
        if rest > least * (1 - 1e-3):  # many at once got in each other's way: fewer
            batch //= 4
        least = min(rest, least)
        pull = gain(rows, left) / norm
        pull[active] = 0
        order = np.argsort(-pull, kind="stable")[:20_000]
        taken, chosen = np.zeros(window + 1, dtype=bool), []
        for j in order[pull[order] > 1e-6].tolist():
            c = rows[j]
            if len(chosen) < batch and not taken[c].any():
                taken[c[c > 0]] = True
                chosen.append(j)
        if not chosen:
            break
        active, x = np.append(active, chosen), np.append(x, np.zeros(len(chosen)))
        for _ in range(retries):
            aim = solve(rows[active], x)
            low = aim <= 0
            if not low.any():
                x = aim
                break
            new = low & (x <= 1e-9)
            if not new.any():  # go as far as nothing turns negative
                x = x + (x[low] / (x[low] - aim[low])).min() * (aim - x)
                new = low & (x <= 1e-9)
            active, x = active[~new], x[~new]
    return active, x


def plan_windows(counts, depth: int = 3):
    """(lengths of a window, how many such windows) and how many pieces of each length stay outside.

    Solved repeats are rounded, the largest first, never beyond the pieces there are. Residuals that still
    fill a window exactly are packed greedily, the longest first. The plan's size depends on the window alone.
    """
    import numpy as np

    left = np.array(counts, dtype=np.int64)
    rows = fillings(left, depth)
    active, x = repeats(rows, left)
    order = np.argsort(-x, kind="stable")
    wanted = [(j, round(v)) for j, v in zip(active[order].tolist(), x[order].tolist()) if round(v)]
    wanted += [(j, None) for j in np.lexsort([-rows[:, k] for k in reversed(range(rows.shape[1]))]).tolist()]
    plan: dict[tuple[int, ...], int] = {}
    have, listed = left.tolist(), rows.tolist()
    for j, limit in wanted:
        row = [c for c in listed[j] if c]
        times = min(have[c] // row.count(c) for c in row)
        if limit is not None:
            times = min(times, limit)
        if times:
            plan[tuple(row)] = plan.get(tuple(row), 0) + times
            for c in row:
                have[c] -= times
    return list(plan.items()), have


def pack_histogram(pieces: DataFrame, capacity: int = 2048, depth: int = 3, with_ids: bool = False, id_column: str = "doc_id") -> DataFrame:
    """Place pieces (`encode_pieces`, stored) in sequences: the ID, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, on request, ids (as `encode_pieces` gives them).

    The driver sees one count per length. Pieces in planned windows are whole; the rest is laid end to end,
    the longest first, and cut where a window ends. The last window ends in sequences of falling powers of
    two, which need no padding, so no sequence is padded at all. A piece's number among those of its length
    is its turn plus the pieces of the splits before, so no length, however common, is numbered by one
    task. Only pieces of the rest are read and moved with their ids. Empty tables stay empty.
    """
    spark = pieces.sparkSession
    counted = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    if counted and not 1 <= min(counted) <= max(counted) <= capacity:
        raise ValueError(f"lengths must be 1 to {capacity}")
    counts = [counted.get(x, 0) for x in range(capacity + 1)]
    plan, outside = plan_windows(counts, depth)
    planned = [n - rest for n, rest in zip(counts, outside)]

    slots, used, sequence = [], [0] * (capacity + 1), 0
    for row, times in plan:
        offset = 0
        for length in sorted(set(row), reverse=True):
            m = row.count(length)
            slots.append((length, used[length], m, sequence, offset))
            used[length] += m * times
            offset += m * length
        sequence += times
    slots.sort()
    line, total = [0] * (capacity + 1), 0  # where the rest of each length begins, laid end to end
    for length in range(capacity, 0, -1):
        line[length] = total
        total += outside[length] * length

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = pieces.groupBy("length", "part").agg(F.count("*").alias("_n"))
    bases = store(sums.select("length", "part", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")), "bases")

    # of each length, the first piece that is outside the plan: at most `capacity` rows
    ends = spark.createDataFrame([(x, planned[x]) for x in range(1, capacity + 1) if outside[x]], "length bigint, _planned bigint")
    limits = bases.join(F.broadcast(ends), "length").where("_base <= _planned and _planned < _base + _n")
    limits = limits.select("length", F.col("part").alias("_part"), (F.col("_planned") - F.col("_base")).alias("_turn"))
    late = "_part is not null and (part > _part or (part = _part and turn >= _turn))"
    marked = pieces.join(F.broadcast(limits), "length", "left")
    numbered = lambda rows: rows.join(bases.drop("_n"), ["length", "part"]).withColumn("_k", F.col("_base") + F.col("turn"))
    inside = numbered(marked.where(f"not ({late})").drop("ids", "_part", "_turn"))
    rest = numbered(marked.where(late).drop("_part", "_turn"))

    fixed = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    columns = [id_column, *fixed, *(["ids"] if with_ids else [])]
    kinds = [T.StructField(c, T.LongType()) for c in fixed] + [T.StructField("ids", T.BinaryType())]
    schema = T.StructType([pieces.schema[id_column], *kinds][: len(columns)])

    def place(batches):
        import numpy as np
        import pyarrow as pa

        table = np.array(slots, dtype=np.int64).reshape(-1, 5)
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy(zero_copy_only=False)
            k = batch.column("_k").to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(keys, (length << 44) + k, side="right") - 1]
            local, m = k - row[:, 1], row[:, 2]
            made = {"sequence_id": pa.array(row[:, 3] + local // m), "offset": pa.array(row[:, 4] + local % m * length)}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in columns], columns)

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        # beyond the last full window, sequences end at falling powers of two
        full, tail = total // capacity, total % capacity
        powers = [1 << b for b in range(capacity.bit_length(), -1, -1) if tail >> b & 1]
        edges = full * capacity + np.cumsum([0, *powers])
        starts_of, planned_of = np.array(line), np.array(planned)

        def one(batch):
            take = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_k", "start", "doc_tokens")}
            length = take["length"]
            at = starts_of[length] + (take["_k"] - planned_of[length]) * length
            until, done, row, found = at + length, np.zeros(len(length), np.int64), np.arange(len(length)), []
            while len(row):
                here = at[row] + done[row]
                beyond = np.searchsorted(edges, here, side="right") - 1  # -1 before the tail
                begin = np.where(beyond < 0, here // capacity * capacity, edges[beyond])
                end = np.where(beyond < 0, begin + capacity, edges[np.minimum(beyond + 1, len(edges) - 1)])
                stop = np.minimum(end, until[row])
                number = np.where(beyond < 0, here // capacity, full + beyond)
                found.append(np.stack([row, done[row], stop - here, sequence + number, here - begin]))
                done[row] += stop - here
                row = row[stop < until[row]]
            r, skip, size, number, offset = np.concatenate(found, axis=1)
            r, skip, size = r.tolist(), skip.tolist(), size.tolist()
            whole = [memoryview(x) for x in batch.column("ids").to_pylist()]
            slices = [whole[x][4 * a : 4 * (a + n)] for x, a, n in zip(r, skip, size)]
            made = {
                id_column: batch.column(id_column).take(pa.array(r)),
                "start": pa.array(take["start"][r] + np.array(skip)),
                "length": pa.array(size, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x) for x in slices], pa.int64()),
                "doc_tokens": pa.array(take["doc_tokens"][r]),
                "sequence_id": pa.array(number),
                "offset": pa.array(offset),
            }
            if with_ids:
                made["ids"] = pa.array([bytes(x) for x in slices], pa.binary())
            yield pa.RecordBatch.from_arrays([made[c] for c in columns], columns)

        yield from in_batches(one)(batches)

    if with_ids:  # planned pieces need their ids, too
        inside = numbered(marked.where(f"not ({late})").drop("_part", "_turn"))
    return inside.mapInArrow(place, schema).unionAll(rest.mapInArrow(cut, schema))
