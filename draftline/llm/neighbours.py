"""Approximate nearest neighbours over balanced posting lists."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import in_batches, store


@dataclass
class ListIndex:
    """Centroids of the lists and the graph over them; at most `max_lists` rows, whatever the table's size."""

    centroids: np.ndarray
    graph: np.ndarray

    def search(self, rows: np.ndarray, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """The `width` nearest centroids found for each row, nearest first: best-first search on the graph,
        for all rows at once. Missing ones have distance infinity."""
        n, lists = len(rows), len(self.centroids)
        width = min(width, lists)
        norms = (self.centroids**2).sum(axis=1)

        def distances(ids):
            dots = np.einsum("nd,nkd->nk", rows, self.centroids[ids])
            return np.sqrt(np.maximum((rows**2).sum(axis=1)[:, None] + norms[ids] - 2 * dots, 0))

        start = np.tile(np.unique(np.linspace(0, lists - 1, min(lists, width)).astype(int)), (n, 1))
        seen = np.zeros((n, lists), dtype=bool)
        np.put_along_axis(seen, start, True, axis=1)
        found, dist = start, distances(start)
        done = np.zeros(start.shape, dtype=bool)
        every = np.arange(n)
        while True:
            open_dist = np.where(done, np.inf, dist)
            at = open_dist.argmin(axis=1)
            active = np.isfinite(open_dist[every, at])
            if not active.any():
                break
            done[every, at] = True
            near = self.graph[found[every, at]]
            fresh = ~np.take_along_axis(seen, near, axis=1) & active[:, None]
            np.put_along_axis(seen, near, np.take_along_axis(seen, near, axis=1) | active[:, None], axis=1)
            more = np.where(fresh, distances(near), np.inf)
            found, dist = np.concatenate([found, near], axis=1), np.concatenate([dist, more], axis=1)
            done = np.concatenate([done, ~fresh], axis=1)
            best = np.argsort(dist, axis=1, kind="stable")[:, :width]
            found, dist, done = (np.take_along_axis(x, best, axis=1) for x in (found, dist, done))
        return found, dist

    def within(self, rows: np.ndarray, ratio: float, sizes: np.ndarray, least: int, width: int) -> list[np.ndarray]:
        """For each row all lists whose centroid is within `ratio` of the nearest one's distance, and further
        ones until they hold `least` rows. The graph serves rows that need fewer than `width` lists; for
        the others all lists are ranked, so that no number of lists ends a search."""

        def enough(found, dist):
            take = dist <= ratio * dist[:, :1]
            held = np.cumsum(sizes[found], axis=1)
            return (take | (held - sizes[found] < least)) & np.isfinite(dist)

        found, dist = self.search(rows, width)
        take = enough(found, dist)
        out = [f[t] for f, t in zip(found, take)]
        wide = np.flatnonzero(take[:, -1] | ~np.isfinite(dist[:, -1]))
        if len(wide) and found.shape[1] < len(self.centroids):
            x = rows[wide]
            dist = (x**2).sum(axis=1)[:, None] + (self.centroids**2).sum(axis=1) - 2 * x @ self.centroids.T
            found = np.argsort(dist, axis=1, kind="stable")
            dist = np.sqrt(np.maximum(np.take_along_axis(dist, found, axis=1), 0))
            for i, f, t in zip(wide.tolist(), found, enough(found, dist)):
                out[i] = f[t]
        return out


def _cluster(rows: np.ndarray, k: int, random: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Label of each row: k-means with farthest-point seeds."""
    centres = rows[[int(random.integers(len(rows)))]]
    nearest = ((rows - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and nearest.max() > 0:
        pick = random.choice(len(rows), p=nearest / nearest.sum())
        centres = np.concatenate([centres, rows[[pick]]])
        nearest = np.minimum(nearest, ((rows - rows[pick]) ** 2).sum(axis=1))
    for _ in range(rounds):
        label = ((centres**2).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)
        centres = np.stack([rows[label == i].mean(axis=0) if (label == i).any() else c for i, c in enumerate(centres)])
    return label


def fit_index(rows: np.ndarray, lists: int, degree: int = 16, seed: int = 3) -> ListIndex:
    """Split the sample again and again until no part exceeds an even share (equal rows stay together),
    then link each centroid to its nearest ones and to a few far ones."""
    random, cap, parts, todo = np.random.default_rng(seed), max(1, -(-len(rows) // lists)), [], [np.arange(len(rows))]
    while todo:
        part = todo.pop()
        if len(part) > cap and (rows[part] != rows[part[0]]).any():
            label = _cluster(rows[part], min(8, -(-len(part) // cap)), random)
            pieces = [part[label == i] for i in range(label.max() + 1) if (label == i).any()]
            if len(pieces) > 1:
                todo += pieces
                continue
        parts.append(part)
    centroids = np.unique(np.stack([rows[p].mean(axis=0) for p in parts]), axis=0)
    n = len(centroids)
    squares = (centroids**2).sum(axis=1)
    near = np.stack(
        [np.argsort(squares - 2 * centroids @ c, kind="stable")[: min(n, degree + 1)] for c in centroids]
    )
    far = random.integers(0, n, (n, min(n, 4)))
    return ListIndex(centroids, np.concatenate([near, far], axis=1))


def _usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    fine = F.col(id_column).isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0)
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_column).alias("vec_id"), x.alias("v"))
    size = rows.select(F.mode(F.size("v"), deterministic=True)).first()[0]
    return rows.where(F.size("v") == F.lit(size))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _in_lists(rows: DataFrame, index: ListIndex, ratio: float, most: int, width: int) -> DataFrame:
    """Each row once per list whose centroid is within `ratio` of the nearest one's distance; `most` bounds
    the copies of a boundary vector."""

    def run(batches):
        import pyarrow as pa

        def one(batch):
            found, dist = index.search(_matrix(batch.column("v")), width)
            take = (dist <= ratio * dist[:, :1]) & np.isfinite(dist)
            take[:, most:] = False
            take[:, 0] = True
            row, at = np.nonzero(take)
            arrays = [pa.array(found[row, at], pa.int32()), *[batch.column(c).take(pa.array(row)) for c in ("vec_id", "v")]]
            yield pa.RecordBatch.from_arrays(arrays, ["list", "vec_id", "v"])

        yield from in_batches(one)(batches)

    fields = [T.StructField("list", T.IntegerType()), rows.schema["vec_id"], rows.schema["v"]]
    return rows.mapInArrow(run, T.StructType(fields))


def _asked_groups(rows: DataFrame, index: ListIndex, ratio: float, width: int, sizes: np.ndarray, group: np.ndarray) -> DataFrame:
    """Each query once, with the groups (`group` of each list) of all lists it has to look into."""

    def run(batches):
        import pyarrow as pa

        def one(batch):
            found = [np.unique(group[x]) for x in index.within(_matrix(batch.column("v")), ratio, sizes, 200, width)]
            ends = np.cumsum([0, *map(len, found)])
            flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.int32), pa.int32())
            groups = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([groups, batch.column("vec_id"), batch.column("v")], ["groups", "vec_id", "v"])

        yield from in_batches(one)(batches)

    fields = [T.StructField("groups", T.ArrayType(T.IntegerType())), rows.schema["vec_id"], rows.schema["v"]]
    return rows.mapInArrow(run, T.StructType(fields))


def _grouped(sizes: np.ndarray, block: int) -> np.ndarray:
    """A number for each list; lists in a row share it as long as they hold `block` rows at most."""
    group, held = np.zeros(len(sizes), dtype=np.int32), 0
    for i, n in enumerate(sizes.tolist()):
        held += n
        group[i] = group[i - 1] if i else 0
        if i and held > block:
            group[i], held = group[i] + 1, n
    return group


def _nearest(k: int):
    """The k nearest of one block of a group of lists to one block of its queries, by the exact distance."""

    def run(queries, members):
        import pyarrow as pa

        ids, x = members["vec_id"].to_numpy(), _matrix(members["v"].combine_chunks())
        qids, q = queries["vec_id"].to_numpy(), _matrix(queries["v"].combine_chunks())
        out = ([], [], [])
        if len(ids) and len(qids):
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            # of equal vectors only the k + 1 smallest ids can be among the nearest
            _, kind = np.unique(x, axis=0, return_inverse=True)
            kind = kind.ravel()
            by_kind = np.argsort(kind, kind="stable")
            first = np.searchsorted(kind[by_kind], kind[by_kind], side="left")
            # a boundary vector may be in several lists of the group
            again = np.concatenate([[False], (np.diff(kind[by_kind]) == 0) & (np.diff(ids[by_kind]) == 0)])
            copies = np.cumsum(again)
            place = np.arange(len(ids)) - first - (copies - copies[first])
            chosen = by_kind[~again & (place <= k)]
            ids, x, kind = ids[chosen], x[chosen], kind[chosen]
            for at in range(0, len(q), 256):
                part = q[at : at + 256]
                rough = (x**2).sum(axis=1) - 2 * part @ x.T
                for i, row in enumerate(rough):
                    need = min(len(ids), 2 * k + 2)
                    edge = np.partition(row, need - 1)[need - 1]
                    near = np.flatnonzero(row <= edge + 1e-9 * (1 + abs(edge)))
                    near = near[ids[near] != qids[at + i]]
                    score = np.sqrt(((x[near] - part[i]) ** 2).sum(axis=1))
                    best = np.lexsort((ids[near], score))[:k]
                    out[0].append(np.full(len(best), qids[at + i]))
                    out[1].append(ids[near][best])
                    out[2].append(score[best])
        arrays = [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, np.float64))]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), arrays)))

    return run


def search(
    vectors: DataFrame,
    k: int = 10,
    query_every: int = 100,
    id_column: str = "vec_id",
    column: str = "embedding",
    sample: int = 16_384,
    max_lists: int = 1024,
    block: int = 4096,
    copies: int = 4,
    build_ratio: float = 1.1,
    search_ratio: float = 1.35,
    width: int = 96,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by `query_every`.

    Lists are fitted on about `sample` rows, drawn by a hash of the id; every row is in one list at least.
    Vectors that are NULL, zero, hold NULL or non-finite numbers or differ in length from most take no
    part, nor do NULL ids. An id counts once, with its nearest vector; a query never finds its own id.
    A query looks into all lists within `search_ratio` of the nearest one's distance, however many these
    are (`width`: up to how many the graph is used to find them). Ties go to smaller ids. Short lists
    are grouped; a long one, or a group that many queries want, is cut into blocks of about `block` rows
    on both sides, so no task holds all of it. Empty tables give no rows.
    """
    rows = _usable(vectors, id_column, column)
    n = rows.count()
    uniform = F.pmod(F.xxhash64("vec_id", F.lit("lists")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.where(uniform < sample / max(n, 1)).orderBy("vec_id").select("v").toArrow()
    points = _matrix(drawn["v"].combine_chunks()) if drawn.num_rows else np.zeros((0, 1))
    if not len(points):  # a small table whose hashes missed the sample
        found = rows.orderBy("vec_id").limit(1).select("v").toArrow()
        points = _matrix(found["v"].combine_chunks()) if found.num_rows else np.zeros((1, 1))
    index = fit_index(points, lists=max(1, min(max_lists, n // 64)))
    lists = len(index.centroids)

    members = store(_in_lists(rows, index, build_ratio, copies, 16), "posting-lists")
    sizes = np.zeros(lists, dtype=np.int64)
    for r in members.groupBy("list").count().collect():  # one row per list
        sizes[r["list"]] = r["count"]
    group = _grouped(sizes, block)
    held = np.bincount(group, weights=sizes).astype(np.int64)
    asked = rows.where(F.col("vec_id") % query_every == 0)
    queries = store(_asked_groups(asked, index, search_ratio, width, sizes, group), "list-queries")
    queries = queries.select(F.explode("groups").alias("group"), "vec_id", "v")
    wanted = np.zeros(len(held), dtype=np.int64)
    for r in queries.groupBy("group").count().collect():
        wanted[r["group"]] = r["count"]
    of_list = F.array(*[F.lit(int(g)) for g in group])
    members = members.select(of_list[F.col("list")].alias("group"), "vec_id", "v")

    def blocks(counts: np.ndarray):
        return F.array(*[F.lit(int(max(1, -(-c // block)))) for c in counts])[F.col("group")]

    def dealt(side: DataFrame, own: str, own_counts: np.ndarray, other: str, other_counts: np.ndarray) -> DataFrame:
        own_block = F.pmod(F.xxhash64("vec_id", F.lit(own)), blocks(own_counts)).cast("int")
        copies_of = F.explode(F.sequence(F.lit(0), blocks(other_counts) - 1))
        return side.withColumn(own, own_block).withColumn(other, copies_of)

    key = ["group", "_m", "_q"]
    by_query = dealt(queries, "_q", wanted, "_m", held).groupBy(*key)
    by_member = dealt(members, "_m", held, "_q", wanted).groupBy(*key)
    found = by_query.cogroup(by_member).applyInArrow(_nearest(k), "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
