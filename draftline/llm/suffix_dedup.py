"""Removal of long byte strings that occur more than once, by ranks of growing strings around anchors.

Ranking every byte position would move several times the text per round. Instead each window of
`length` bytes belongs to an anchor inside it that depends on its bytes alone (see `byte_windows`), so
equal windows stand equally far from equal anchors. A rank is the name (hashes) of a string at its
offset from the anchor. Rounds compare strings that grow until they reach `length`:

1. the anchor's gram, which all windows of the anchor contain,
2. what BLOCK neighbouring windows have in common,
3. the windows themselves.

In each round, positions with the same rank are brought together. A rank that only one position has
is unique and its windows are done. Runs or blocks that agree as a whole are repeats and are done,
too, but for one of each kind, which stands for all of them in the next round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .byte_windows import Hasher, anchors, mix
from .common import discard, in_batches, store

GRAM = 100
BLOCK = 16
_KEY = ["_k1", "_k2"]
_KEYS = "_k1 bigint, _k2 bigint"


def _values(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary Arrow column and where its values start and end."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), ends


def _longs(x: np.ndarray):
    import pyarrow as pa

    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """Every anchor with its run of windows, and the names of gram (`g`) and whole run (`c1`, `c2`)."""

    def run(batches):
        import pyarrow as pa

        def one(batch):
            data, ends = _values(batch.column("_bytes"))
            rows, found = [], []
            for i in range(batch.num_rows):
                if ends[i + 1] - ends[i] >= length:
                    found.append(anchors(data[ends[i] : ends[i + 1]], length, GRAM))
                    rows.append(np.full(len(found[-1][0]), i))
            if not rows:
                return
            a, s, e, g, f1, f2 = (np.concatenate(x) for x in zip(*found))
            c1 = mix(f1 ^ mix(((a - s) * 1024 + (e - s)).astype(np.uint64)))
            take = pa.array(np.concatenate(rows))
            arrays = [batch.column(k).take(take) for k in _KEY]
            arrays += [pa.array(x, pa.int32()) for x in (a, s, e)] + [_longs(x) for x in (g, c1, f2)]
            yield pa.RecordBatch.from_arrays(arrays, [*_KEY, "a", "s", "e", "g", "c1", "c2"])

        yield from in_batches(one)(batches)

    return docs.select(*_KEY, "_bytes").mapInArrow(
        run, f"{_KEYS}, a int, s int, e int, g bigint, c1 bigint, c2 bigint"
    )


def _contexts(docs: DataFrame, live: DataFrame, length: int) -> DataFrame:
    """The bytes of the runs that the next rounds look into."""
    per_text = live.groupBy(*_KEY).agg(F.collect_list(F.struct("a", "s", "e", "known")).alias("_runs"))

    def run(batches):
        import pyarrow as pa

        def one(batch):
            rows, out = [], {"a": [], "s": [], "e": [], "known": [], "bytes": []}
            texts = batch.column("_bytes")
            for i, runs in enumerate(batch.column("_runs").to_pylist()):
                text = texts[i].as_buffer()
                for r in runs:
                    rows.append(i)
                    for k in ("a", "s", "e", "known"):
                        out[k].append(r[k])
                    out["bytes"].append(text[r["s"] : r["e"] + length].to_pybytes())
            arrays = [batch.column(k).take(pa.array(rows, pa.int64())) for k in _KEY]
            arrays += [pa.array(out[k], pa.int32()) for k in ("a", "s", "e")]
            arrays += [pa.array(out["known"], pa.bool_()), pa.array(out["bytes"], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [*_KEY, "a", "s", "e", "known", "bytes"])

        yield from in_batches(one, 128)(batches)

    joined = docs.select(*_KEY, "_bytes").join(per_text.hint("shuffle_hash"), _KEY)
    return joined.mapInArrow(run, f"{_KEYS}, a int, s int, e int, known boolean, bytes binary")


def _block_rows(contexts: DataFrame, length: int) -> DataFrame:
    """Blocks of up to BLOCK windows at the same offsets (`lo` to `hi` before the anchor), with the name
    of their common bytes (`g`) and of all their bytes (`c1`, `c2`)."""

    def run(batches):
        import pyarrow as pa

        def one(batch):
            data, ends = _values(batch.column("bytes"))
            data, base = data[ends[0] : ends[-1]], ends[:-1] - ends[0]
            a, s, e = (batch.column(k).to_numpy().astype(np.int64) for k in "ase")
            low, high = (a - e) // BLOCK, (a - s) // BLOCK
            n = high - low + 1
            row = np.repeat(np.arange(len(a)), n)
            j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]
            lo, hi = np.maximum(j * BLOCK, (a - e)[row]), np.minimum(j * BLOCK + BLOCK - 1, (a - s)[row])
            at = (base - s + a)[row]  # the anchor's place in `data`
            one, two = Hasher(data, 1), Hasher(data, 2)
            core = one(at - j * BLOCK, at - (j * BLOCK + BLOCK - 1) + length)
            core = mix(core ^ mix((j + 1).astype(np.uint64)))
            start, end = at - hi, at - lo + length
            c1 = mix(one(start, end) ^ mix((lo * 1024 + hi).astype(np.uint64)))
            take = pa.array(row)
            arrays = [batch.column(k).take(take) for k in (*_KEY, "a", "s", "known")]
            arrays += [pa.array(lo, pa.int32()), pa.array(hi, pa.int32())]
            arrays += [_longs(x) for x in (core, c1, two(start, end))]
            yield pa.RecordBatch.from_arrays(arrays, [*_KEY, "a", "s", "known", "lo", "hi", "g", "c1", "c2"])

        yield from in_batches(one)(batches)

    return contexts.mapInArrow(
        run, f"{_KEYS}, a int, s int, known boolean, lo int, hi int, g bigint, c1 bigint, c2 bigint"
    )


def _window_rows(contexts: DataFrame, live: DataFrame, length: int) -> DataFrame:
    """The windows of the blocks that are still open, with their names."""
    per_run = live.groupBy(*_KEY, "a", "s").agg(F.collect_list(F.struct("lo", "hi", "known")).alias("_blocks"))

    def run(batches):
        import pyarrow as pa

        def one(batch):
            data, ends = _values(batch.column("bytes"))
            data, base = data[ends[0] : ends[-1]], ends[:-1] - ends[0]
            rows, ds, known = [], [], []
            for i, blocks in enumerate(batch.column("_blocks").to_pylist()):
                for b in blocks:
                    n = b["hi"] - b["lo"] + 1
                    rows.append(np.full(n, i))
                    ds.append(np.arange(b["lo"], b["hi"] + 1))
                    known.append(np.full(n, b["known"]))
            row, d = np.concatenate(rows), np.concatenate(ds)
            a, s = (batch.column(k).to_numpy().astype(np.int64) for k in "as")
            start = (base - s + a)[row] - d
            take = pa.array(row)
            arrays = [batch.column(k).take(take) for k in _KEY]
            arrays += [pa.array(a[row] - d, pa.int32()), pa.array(np.concatenate(known))]
            arrays += [_longs(Hasher(data, seed)(start, start + length)) for seed in (1, 2)]
            yield pa.RecordBatch.from_arrays(arrays, [*_KEY, "s", "known", "c1", "c2"])

        yield from in_batches(one)(batches)

    joined = contexts.drop("known").join(per_run.hint("shuffle_hash"), [*_KEY, "a", "s"])
    return joined.mapInArrow(run, f"{_KEYS}, s int, known boolean, c1 bigint, c2 bigint")


def _rerank(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(names of repeats, rows for the next round), both stored.

    Rows of one kind share c1 and c2; `known` rows only stand for repeats found before. A kind with
    one row that is not known is open. The next round gets one row of each kind whose rank `g` also
    has another kind, if any kind of that rank is open.
    """
    kinds = rows.groupBy("g", "c1", "c2").agg(
        F.count("*").alias("n"), F.max("known").alias("known"), F.min(F.struct(*columns)).alias("_one")
    )
    kinds = store(kinds.withColumn("open", (F.col("n") == 1) & ~F.col("known")), "kinds")
    ranks = kinds.groupBy("g").agg(F.count("*").alias("_kinds"), F.max("open").alias("_open"))
    # stored, so that the join below has plain shuffles on both sides and a hot rank can be split
    ranks = store(ranks.where((F.col("_kinds") > 1) & F.col("_open")).select("g"), "open-ranks")
    following = store(kinds.join(ranks, "g").select("_one.*", (~F.col("open")).alias("known")), "live")
    names = store(kinds.where("n > 1").select("c1", "c2"), "repeated")
    discard(kinds, ranks)
    return names, following


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """_k1, _k2, start, end of every run of windows that also starts elsewhere (see `remove_repeats`).

    Spans are stored as they are found: a string that very many places share is then split over tasks where
    its places are joined, as nothing else happens in that step, and the tables it took can go.
    """
    anchored = store(_anchor_rows(docs, length), "anchors", compression="zstd")
    # most grams are unique; their anchors need no further look
    shared = store(anchored.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "shared-grams")
    found = store(anchored.join(shared, "g"), "shared-anchors", compression="zstd")
    discard(anchored, shared)
    names, live = _rerank(found.withColumn("known", F.lit(False)), [*_KEY, "a", "s", "e"])
    spans = found.select(*_KEY, "s", "e", "c1", "c2").join(names, ["c1", "c2"])
    spans = store(spans.select(*_KEY, F.col("s").alias("start"), (F.col("e") + length).alias("end")), "spans")
    discard(found, names)

    contexts = store(_contexts(docs, live, length), "contexts")
    blocks = store(_block_rows(contexts, length), "blocks")
    discard(live)
    names, live = _rerank(blocks, [*_KEY, "a", "s", "lo", "hi"])
    more = blocks.where(~F.col("known")).join(names, ["c1", "c2"])
    more = store(more.select(*_KEY, (F.col("a") - F.col("hi")).alias("start"), (F.col("a") - F.col("lo") + length).alias("end")), "spans")
    discard(blocks, names)

    windows = store(_window_rows(contexts, live, length), "windows")
    discard(contexts, live)
    again = windows.groupBy("c1", "c2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    last = windows.where(~F.col("known")).join(again, ["c1", "c2"])
    last = store(last.select(*_KEY, F.col("s").alias("start"), (F.col("s") + length).alias("end")), "spans")
    discard(windows)
    return spans.unionByName(more).unionByName(last)


def spans_of_texts(docs: DataFrame, length: int = 400) -> DataFrame:
    """_k1, _k2, _spans: the different repeated spans of each text. Rows with equal keys find the same spans;
    these are kept once, so that an array is bounded by its own text."""
    spans = repeated_spans(docs, length)
    return spans.groupBy(*_KEY).agg(F.collect_set(F.struct("start", "end")).alias("_spans"))


def remove_repeats(docs: DataFrame, length: int = 400, text: str = "text", rewrite: bool = False) -> DataFrame:
    """All columns of `docs` (but those of the same names) and kept (binary), n_bytes, n_removed, n_spans of every whole text.

    With `rewrite` the text column holds what is kept instead, without characters that lost some of their bytes.

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, the same text
    included; strings are judged on the input and never cross rows. NULL counts as empty; texts shorter
    than `length` stay. Repeated rows are occurrences of their own, so both lose what they repeat. Names
    are two 64-bit hashes; a gram's is one, as a clash there only costs work.
    """
    added = T._parse_datatype_string("kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")
    if rewrite:
        added = T.StructType(added.fields[1:])
    docs = docs.drop(*added.names)
    columns = docs.columns
    inner = docs.withColumn("_bytes", F.coalesce(F.col(text).cast("binary"), F.lit(b"")))
    # rows with equal columns get equal keys, which is right: they lose the same bytes
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns if c != text]
    inner = inner.withColumn("_k1", F.xxhash64(*cells, "_bytes")).withColumn("_k2", F.xxhash64("_bytes", *cells))
    joined = inner.join(spans_of_texts(inner, length).hint("shuffle_hash"), _KEY, "left").select(*columns, "_bytes", "_spans")

    def run(batches):
        import pyarrow as pa

        def one(batch):
            out = {"kept": [], "n_bytes": [], "n_removed": [], "n_spans": []}
            texts = batch.column("_bytes")
            spans = batch.column("_spans")
            for i in range(batch.num_rows):
                data = texts[i].as_py()
                kept, at, n = [], 0, 0
                if spans[i].is_valid:
                    pairs = np.array([(x["start"], x["end"]) for x in spans[i].as_py()], dtype=np.int64)
                    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                    reach = np.maximum.accumulate(pairs[:, 1])
                    new = np.concatenate([[True], pairs[1:, 0] > reach[:-1]])
                    lows = pairs[new, 0]
                    highs = reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(pairs) - 1]])]
                    for low, high in zip(lows.tolist(), highs.tolist()):
                        kept.append(data[at:low])
                        at, n = high, n + 1
                kept = b"".join([*kept, data[at:]])
                for name, value in zip(out, (kept, len(data), len(data) - len(kept), n)):
                    out[name].append(value)
            if rewrite:
                short = pa.array([x.decode("utf-8", "ignore") for x in out.pop("kept")], pa.string())
            arrays = [short if rewrite and c == text else batch.column(c) for c in columns]
            arrays += [pa.array(out[f.name], pa.binary() if f.name == "kept" else pa.int64()) for f in added]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, *added.names])

        yield from in_batches(one)(batches)

    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, *added.fields]))
