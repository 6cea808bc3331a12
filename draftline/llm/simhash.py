"""Near duplicates by SimHash, found through signatures with one bit left out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from .common import in_batches, merged, store
from .components import components

#: Buckets of at most so many fingerprints are compared pair by pair, larger ones through neighbours.
PAIRWISE = 32
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64 bits, each set if it is set in over half the hashes of the text's word shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - shingle + 1)
    stops = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]) - 1
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        spans = zip(starts[at : min(n, at + _CHUNK)].tolist(), stops[at : at + _CHUNK].tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id and `print`, the fingerprint as a signed bigint, of every whole text (NULL: no words, zero)."""

    def run(batches):
        import pyarrow as pa

        def one(batch):
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], [id_column, "print"])

        yield from in_batches(one)(batches)

    schema = T.StructType([docs.schema[id_column], T.StructField("print", T.LongType())])
    return docs.select(id_column, "text").mapInArrow(run, schema)


def signatures(prints: DataFrame) -> DataFrame:
    """`key` of each fingerprint's 64 variants: one of its two halves with one bit left out.

    Of two fingerprints that differ in two bits at most, one half differs in one bit at most, and
    so they share the variant without that bit.
    """
    k = F.col("_k")
    half = F.expr("IF(_k < 32, print & 4294967295L, shiftrightunsigned(print, 32))")
    variants = prints.select("print", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("_k"))
    bit = F.expr("shiftleft(1L, _k & 31)")
    return variants.select("print", half.bitwiseAND(F.bitwise_not(bit)).bitwiseOR(F.expr("shiftleft(CAST(_k AS bigint), 32)")).alias("key"))


def links(prints: DataFrame) -> DataFrame:
    """Edges a, b over different fingerprints with the connectivity of all pairs at two bits or fewer.

    Signatures that several fingerprints share are joined. Up to PAIRWISE fingerprints are verified
    pair by pair. Members of a larger bucket meet at their one-bit neighbours instead: a neighbour's
    callers are within two bits of each other, they number 65 at most, each is tied to the smallest,
    and any two members within two bits have a common neighbour. So no bucket yields all its pairs,
    none is cut off, and no link is lost.
    """
    index = signatures(prints)
    shared = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = store(index.join(merged(shared), "key"), "simhash-buckets")
    near = "flatten(transform(p, x -> transform(filter(p, y -> y > x AND bit_count(x ^ y) <= 2), y -> struct(x AS a, y AS b))))"
    small = members.where(F.col("n") <= PAIRWISE).groupBy("key").agg(F.collect_list("print").alias("p"))
    pairs = small.select(F.inline(F.expr(near)))
    crowded = members.where(F.col("n") > PAIRWISE).select("print").distinct()
    around = F.expr("transform(sequence(-1, 63), i -> IF(i < 0, print, print ^ shiftleft(1L, i)))")
    meetings = crowded.select("print", F.explode(around).alias("z")).groupBy("z").agg(F.collect_list("print").alias("p"))
    stars = meetings.where(F.size("p") > 1).select(F.array_min("p").alias("a"), F.explode("p").alias("b")).where("a <> b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row per row of `docs`: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Copies share a fingerprint and collapse before anything is compared. NULL, empty and blank texts
    have fingerprint zero and are linked like any other. A NULL id is never a component's number
    unless all ids are NULL. Repeated rows give repeated rows; other columns are ignored.
    """
    prints = store(fingerprints(docs, id_column), "fingerprints")
    classes = store(prints.groupBy("print").agg(F.min(id_column).alias("_first")), "classes")
    groups = components(links(classes.select("print")), "a", "b")
    linked = classes.join(groups, classes.print == groups.node, "left")
    linked = linked.select("print", "_first", F.coalesce("component", "print").alias("_root"))
    lowest = linked.groupBy("_root").agg(F.min("_first").alias("component_id"))
    of_print = linked.join(lowest, "_root").select(F.col("print").alias("_print"), "component_id")
    hexed = F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint")
    return prints.join(merged(of_print), F.col("print") == F.col("_print")).select(id_column, hexed, "component_id")
