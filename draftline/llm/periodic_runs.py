"""Periodic stretches of words: harmonic grids over difference-cover extension queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import n_words, words

#: Fixed values, a perfect difference set: every distance modulo 13 lies between two of its members.
_MODULUS, _COVER = 13, (0, 1, 3, 9)

#: Grid points looked at at once, survivors kept at once, bytes of text per call; bounds of memory only.
_CHUNK, _HELD, _BYTES = 2_000_000, 4_000_000, 4 << 20

_RUN = "struct<start:bigint,length:bigint,period:bigint>"


def _shifts():
    """For two residues, the least shift that brings both into the cover."""
    import numpy as np

    inside = np.isin(np.arange(_MODULUS), _COVER)
    residue, shift = np.arange(_MODULUS), np.arange(_MODULUS)
    hit = inside[(residue[:, None] + shift) % _MODULUS]
    return (hit[:, None, :] & hit[None, :, :]).argmax(axis=2)


class Extensions:
    """Longest common extensions within one sequence of ids, in which every text ends in an id of its own.

    Only suffixes at positions of a difference cover (4 of 13) are sorted: by their first 13 ids, then by
    doubling along the cover, which repeats every 13 positions. A query compares at most 12 ids until both
    positions are in the cover; the least neighbour extension between two ranks does the rest.
    """

    def __init__(self, ids):
        import numpy as np

        n, per = len(ids), len(_COVER)
        low = ids.min(initial=0)
        self.ids = ids = np.concatenate([ids, low - 1 - np.arange(2 * _MODULUS, dtype=ids.dtype)])
        blocks = -(-n // _MODULUS)
        at = (np.arange(blocks)[:, None] * _MODULUS + np.array(_COVER)).ravel()
        m = len(at)
        keys = [ids[at + k] for k in range(_MODULUS)]
        order = np.lexsort(keys[::-1])
        new = np.zeros(m, dtype=bool)
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
        rank = np.empty(m, dtype=np.int64)
        rank[order] = np.cumsum(new)
        levels, step = [rank], per
        while rank.max() < m - 1:
            after = np.zeros(m, dtype=np.int64)
            after[: max(m - step, 0)] = rank[step:] + 1
            key = rank * (m + 1) + after
            order = np.argsort(key, kind="stable")
            rank = np.empty(m, dtype=np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
            levels.append(rank.astype(np.int32))
            step *= 2
        self.rank = rank

        # what neighbours in this order share: doubled steps from the largest down, then single ids
        a, b, shared = order[:-1].copy(), order[1:].copy(), np.zeros(m - 1, dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same = levels[k][np.minimum(a, m - 1)] == levels[k][np.minimum(b, m - 1)]
            same &= (a < m) & (b < m)
            shared += same * (_MODULUS << k)
            a, b = a + same * (per << k), b + same * (per << k)
        left, right = at[order[:-1]] + shared, at[order[1:]] + shared
        live = np.flatnonzero((left < n) & (right < n))
        for _ in range(_MODULUS):
            live = live[ids[left[live]] == ids[right[live]]]
            left[live] += 1
            right[live] += 1
            shared[live] += 1

        table = [shared.astype(np.int32)]
        while 2 << (len(table) - 1) <= len(shared):
            last, half = table[-1], 1 << (len(table) - 1)
            wider = last.copy()
            wider[: len(last) - half] = np.minimum(last[: len(last) - half], last[half:])
            table.append(wider)
        self.table = np.stack(table)
        self.shift = _shifts()
        self.place = np.full(_MODULUS, -1)
        self.place[list(_COVER)] = np.arange(per)

    def of(self, i, j):
        """How many ids agree from i and j on; i and j are arrays of different positions."""
        import numpy as np

        delta = self.shift[i % _MODULUS, j % _MODULUS]
        found, live = np.zeros(len(i), dtype=np.int64), np.ones(len(i), dtype=bool)
        for k in range(int(delta.max(initial=0))):
            on = np.flatnonzero(live & (k < delta))
            same = self.ids[i[on] + k] == self.ids[j[on] + k]
            found[on[same]] += 1
            live[on[~same]] = False
        on = np.flatnonzero(live)
        ranks = [self.rank[len(_COVER) * (p // _MODULUS) + self.place[p % _MODULUS]] for p in (i[on] + delta[on], j[on] + delta[on])]
        low, high = np.minimum(*ranks), np.maximum(*ranks)
        k = np.frexp(high - low)[1] - 1
        found[on] += np.minimum(self.table[k, low], self.table[k, high - (1 << k)])
        return found


def find_runs(ids, ends, least: int = 24, exponent: int = 3):
    """(text, start, length, period) of all runs of several texts, in this order: four arrays.

    `ids` holds the texts one after the other, `ends` where each ends. A run of period p covers two
    neighbouring points of the grid 0, p, 2p, ... that agree on over p ids (on more, if p is small), so
    every p looks at one pair in p positions; a few ids rule nearly all of them out, extension queries
    to both sides give the run around the others. A multiple of a run's period finds the same stretch,
    so the least period of equal stretches is its own.
    """
    import numpy as np

    ends = np.asarray(ends, dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    size = ends - starts
    most = np.where(size >= least, size // exponent, 0)
    text = np.repeat(np.arange(len(size)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    points = -(-(size[text] - period) // period)
    upto = np.cumsum(points)
    # the first grid point of a run extends over so many ids; the least of it over all periods
    need = lambda p: np.maximum((exponent - 2) * p + 1, least + 1 - 2 * p)
    words_checked = min(int(need(p)) for p in range(1, least + 1))

    found, held, lasting = [], [], (None, None)

    def flush():
        nonlocal held, lasting
        if not held:
            return
        t, i, p = (np.concatenate(x) for x in zip(*held))
        held = []
        some = np.unique(t)
        if lasting[0] is None or not np.array_equal(lasting[0], some):
            # every text between two ids of its own, in both directions
            parts, base, at = [np.array([-1], dtype=np.int64)], np.zeros(len(size), dtype=np.int64), 1
            for k, x in enumerate(some.tolist()):
                base[x] = at
                parts += [ids[starts[x] : ends[x]], np.array([-2 - k])]
                at += int(size[x]) + 1
            whole = np.concatenate(parts).astype(np.int64)
            lasting = (some, (base, len(whole), Extensions(whole), Extensions(whole[::-1].copy())))
        base, n, forward, backward = lasting[1]
        i = i + base[t]
        ahead = forward.of(i, i + p)
        good = ahead >= need(p)
        t, i, p, ahead = t[good], i[good], p[good], ahead[good]
        behind = backward.of(n - i, n - i - p)
        length = ahead + behind + p
        good = length >= np.maximum(least, exponent * p)
        rows = np.stack([t, i - behind - base[t], length, p])[:, good]
        found.append(np.unique(rows, axis=1))

    total = int(upto[-1]) if len(upto) else 0
    for low in range(0, total, _CHUNK):
        high = min(low + _CHUNK, total)
        a, b = np.searchsorted(upto, low, side="right"), np.searchsorted(upto, high - 1, side="right") + 1
        first = np.maximum(upto[a:b] - points[a:b], low)
        count = np.minimum(upto[a:b], high) - first
        row = np.repeat(np.arange(a, b), count)
        p = period[row]
        i = (np.arange(low, high) - (upto - points)[row]) * p
        here = i + starts[text[row]]
        live = np.flatnonzero(ids[here] == ids[here + p])
        room = size[text[row[live]]] - p[live] - i[live]
        live = live[room >= words_checked]
        for k in range(1, words_checked):
            live = live[ids[here[live] + k] == ids[here[live] + p[live] + k]]
        if len(live):
            held.append((text[row[live]], i[live], p[live]))
            if sum(len(x[0]) for x in held) > _HELD:
                flush()
    flush()
    if not found:
        return tuple(np.zeros((4, 0), dtype=np.int64))
    t, start, length, p = np.unique(np.concatenate(found, axis=1), axis=1)
    own = np.ones(len(t), dtype=bool)  # sorted by text, start, length, period
    own[1:] = (t[1:] != t[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    t, start, length, p = t[own], start[own], length[own], p[own]
    order = np.lexsort((p, start, t))
    return t[order], start[order], length[order], p[order]


def collapse_runs(docs: DataFrame, id_column: str = "doc_id", least: int = 24, exponent: int = 3) -> DataFrame:
    """Runs of words in every whole text, and the text without their repetitions.

    Returns the ID, n_words, `runs` (start, length, period of every run, by start, then period), `top`
    (the run of greatest length / period; ties: smallest start, then period; NULL without runs) and
    `collapsed` (kept words joined by one space). A run has a smallest period q, at least `least` words
    and `exponent` periods (3 or more), and no neighbouring word extends it; a word goes if any run holds
    it after that run's first q words. NULL, empty and blank texts have no words, no run and an empty
    `collapsed`. Rows are judged one by one: repeated rows give repeated results, empty tables stay
    empty, other columns are ignored. A text of any length is searched whole, in n log n steps.
    """
    if exponent < 3:
        raise ValueError("runs of fewer than three periods are not enumerated")

    def search(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def one(batch):
            texts = pc.fill_null(batch.column(1), "")
            n = len(texts)
            lists = pc.ascii_split_whitespace(texts)
            at = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
            coded = lists.flatten().dictionary_encode()
            ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            blank = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[ids]
            ends = (at - np.concatenate([[0], np.cumsum(blank)])[at])[1:]
            ids = ids[~blank]
            size = np.diff(ends, prepend=0)
            t, start, length, period = find_runs(ids, ends, least, exponent)
            # words after a run's first period, as depth of nested stretches
            depth = np.zeros(len(ids) + 1, dtype=np.int64)
            begin = (ends - size)[t] + start
            np.add.at(depth, begin + period, 1)
            np.add.at(depth, begin + length, -1)
            kept = np.cumsum(depth[:-1]) == 0
            left = np.concatenate([[0], np.cumsum(kept)])
            bounds = pa.array(left[np.concatenate([[0], ends])].astype(np.int32))
            joined = pc.binary_join(pa.ListArray.from_arrays(bounds, coded.dictionary.take(pa.array(ids[kept]))), " ")
            columns = [pa.array(x, pa.int64()) for x in (start, length, period)]
            names = ["start", "length", "period"]
            per_text = np.searchsorted(t, np.arange(n + 1))
            runs = pa.ListArray.from_arrays(pa.array(per_text.astype(np.int32)), pa.StructArray.from_arrays(columns, names))
            best: list = [None] * n
            for x, s, l, p in zip(t.tolist(), start.tolist(), length.tolist(), period.tolist()):
                if best[x] is None or l * best[x]["period"] > best[x]["length"] * p:
                    best[x] = {"start": s, "length": l, "period": p}
            top = pa.array(best, runs.type.value_type)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), runs, top, joined.cast(pa.string())],
                [id_column, "n_words", "runs", "top", "collapsed"],
            )

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            group = np.cumsum(sizes.astype(np.int64)) // _BYTES
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                if high > low:
                    yield from one(batch.slice(low, high - low))

    kinds = f"n_words bigint, runs array<{_RUN}>, top {_RUN}, collapsed string"
    fields = [docs.schema[id_column], *T._parse_datatype_string(kinds).fields]
    return docs.select(id_column, F.col("text").cast("string")).mapInArrow(search, T.StructType(fields))


def with_planted_runs(text: Column, doc_id: Column) -> Column:
    """The text of which, for a tenth of the IDs, the words from some place on repeat with some period.

    By h, the unsigned CRC-32 of the ID in decimal, and g = floor(h / 10): if h % 10 = 0 and there are n > 0
    words, word i >= a becomes word a + (i - a) % p, where a = g % n, p = 1 + floor((n - a) / (3 + g % 8)).
    Other texts stay as they are, and so do those without an ID.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(row: Column) -> Column:
        w, a, p = row["w"], row["a"], row["p"]
        return F.transform(w, lambda x, i: F.when(i < a, x).otherwise(w[a + (i - a) % p]))

    def placed(w: Column) -> Column:
        n = F.size(w)
        return F.struct(w.alias("w"), (g % n).cast("int").alias("a"), (1 + F.floor((n - g % n) / (3 + g % 8))).cast("int").alias("p"))

    # arrays of one element bind the words and places, which would else be made anew for every word
    bound = F.transform(F.transform(F.array(words(text)), placed), repeated)[0]
    return F.when((h % 10 == 0) & (n_words(text) > 0), F.array_join(bound, " ")).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the top run and SHA-256 sums of all runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.expr("(1000 * top.length) div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
