"""Packing, mixing, anchors, neighbours and token files."""

import bisect
import hashlib
import itertools
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from fixtures_llm import DOCUMENTS, odd_rows, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from draftline.llm import byte_windows, mixing, neighbours
from draftline.llm.common import with_row_key
from draftline.llm.packing import fullest, pack, plan_bins
from draftline.llm.suffix_dedup import remove_repeats, spans_of_texts
from draftline.llm.token_files import encode_documents, read_metadata, read_tokens, with_blocks, write_tokens

import public_tokenizers  # isort: skip


def test_fullest_against_all_combinations():
    random = np.random.default_rng(2)
    for _ in range(200):
        counts = {int(x): int(random.integers(1, 3)) for x in random.integers(1, 15, 4)}
        room = int(random.integers(1, 25))
        items = [x for x, n in counts.items() for _ in range(n)]
        best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room)
        chosen = fullest(counts, room)
        assert sum(k * m for k, m in chosen.items()) == best
        assert all(m <= counts[k] for k, m in chosen.items())


def test_plan_uses_every_piece_once_and_is_small():
    random = np.random.default_rng(3)
    counts = {int(k): int(n) for k, n in zip(random.integers(1, 2049, 900), random.integers(1, 10**7, 900))}
    plan, used = plan_bins(counts, 2048), dict.fromkeys(counts, 0)
    for content, times in plan:
        assert sum(k * m for k, m in content.items()) <= 2048
        for k, m in content.items():
            used[k] += m * times
    assert used == counts
    assert len(plan) < 6 * len(counts)


def best_fit(lengths, capacity=2048):
    free = []
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(free, length)
        rest = free.pop(at) - length if at < len(free) else capacity - length
        bisect.insort(free, rest)
    return len(free)


def test_no_more_bins_than_best_fit():
    random = np.random.default_rng(9)
    for top in (300, 1100, 2048):
        lengths = random.integers(1, top + 1, 2000).tolist()
        plan = plan_bins(Counter(lengths), 2048)
        assert sum(t for _, t in plan) <= best_fit(lengths)


def test_pack_with_a_hot_length(spark):
    rows = spark.range(6000).selectExpr("id doc_id", "0 piece", "IF(id % 3 = 0, 700, 1 + id % 2048) length", "id ids_crc32", "id size")
    found = pack(rows).toPandas()
    assert sorted(found.doc_id) == list(range(6000)) and "size" in found
    for _, part in found.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() <= 2048
    assert found.sequence_id.nunique() <= 1.001 * best_fit(found.length) + 1
    again = pack(rows.repartition(7)).toPandas()
    assert sorted(found.itertuples(index=False)) == sorted(again.itertuples(index=False))
    with pytest.raises(ValueError):
        pack(rows.selectExpr("doc_id", "piece", "4000 length", "ids_crc32"))


def test_targets_against_sharing_again_and_again(spark):
    random = np.random.default_rng(4)
    for n in (1, 2, 3, 7, 30):
        sizes = (10 ** random.uniform(0, 6, n)).astype(int) * random.integers(0, 2, n)
        names = [None if i == n - 1 else f"s{i:02d}" for i in range(n)]
        table = spark.createDataFrame(list(zip(names, sizes.tolist())), "source string, source_size bigint")
        found = {r.position: r for r in mixing.targets(table).collect()}
        assert [found[i].source for i in range(n)] == names
        weights, goal = np.array([(3, 1, 2)[i % 3] for i in range(n)]), np.zeros(n)
        left, free = 1.5 * sizes.sum(), np.ones(n, dtype=bool)
        while free.any() and left > 0:
            goal[free] = left * weights[free] / weights[free].sum()
            over = free & (goal > 2 * sizes)
            if not over.any():
                break
            goal[over] = 2 * sizes[over]
            left, free = left - goal[over].sum(), free & ~over
        assert np.allclose([found[i].target for i in range(n)], goal)


def test_shards_split_each_source_without_gap_or_overlap():
    quota = np.array([5000, 0, 17, 900])
    shards = 7
    ranges = [mixing.shard_quotas(quota, shards, s, seed=1) for s in range(shards)]
    at = np.zeros(4, dtype=int)
    for first, count in ranges:
        assert (first == at).all()
        at = at + count
    assert (at == quota).all()
    totals = [int(count.sum()) for _, count in ranges]
    assert max(totals) - min(totals) <= 1
    big = np.array([3_000_000_000, 2_000_000_000, 5])
    part = mixing.split_quota(big, 2_500_000_000, np.random.default_rng(1))
    assert part.sum() == 2_500_000_000 and (part >= 0).all() and (part <= big).all()
    assert abs(part[0] / 1.5e9 - 1) < 0.01


def test_mix_repeats_whole_rows_and_agrees_with_its_plan(spark):
    docs = spark.createDataFrame(odd_rows(), DOCUMENTS)
    found = mixing.mix(docs).toPandas()
    taken = mixing.taken(docs).toPandas()
    words = found.text.fillna("").str.split().str.len()
    assert words.sum() == taken.taken.sum()
    assert (taken.taken <= 2 * taken["size"]).all()
    by_source = taken.groupby(["source_size", "target"]).taken.sum().reset_index()
    largest = taken["size"].max()
    assert (abs(by_source.taken - by_source.target) <= largest).all()
    again = mixing.mix(docs.repartition(5)).toPandas()
    assert sorted(map(str, found.itertuples(index=False))) == sorted(map(str, again.itertuples(index=False)))
    assert sorted(found.place) == list(range(len(found)))  # one shard


def test_no_table_of_documents_is_broadcast(spark, monkeypatch):
    plans, keep = {}, mixing.store

    def watch(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(df, name)

    monkeypatch.setattr(mixing, "store", watch)
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('a b ', 9) AS text", "concat('s', id % 40) AS source")
    mixed = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert mixed.count("SortMergeJoin") == 3 and "Broadcast" not in mixed
    sent = [x for x in plans["copies"].splitlines() if "BroadcastHashJoin" in x]
    assert sent and not any("_perm" in x for x in sent)


def test_anchor_depends_on_the_window_alone(monkeypatch):
    random = np.random.default_rng(6)
    data = random.integers(97, 100, 4000).astype(np.uint8)
    data[500:1100] = 97  # a long run of one letter
    data[3000:3900] = data[100:1000]

    def owners():
        a, s, e, *_ = byte_windows.anchors(data, 400, 100)
        out = np.zeros(len(data) - 399, dtype=int)
        for x, y, z in zip(a, s, e):
            out[y : z + 1] = np.arange(y, z + 1) - x
        return out

    whole = owners()
    assert (whole[100:601] == whole[3000:3501]).all()
    monkeypatch.setattr(byte_windows, "CHUNK", 333)
    assert (owners() == whole).all()


def test_long_texts_in_chunks_lose_the_same_bytes(spark):
    text = prose(9, 400)
    texts = [text + " x " + text, text[:399], text[7:407]]
    docs = spark.createDataFrame(list(enumerate(texts, start=1)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in remove_repeats(docs, rewrite=True).collect()}
    windows = Counter(t[p : p + 400] for t in texts for p in range(len(t) - 399))
    for i, t in enumerate(texts, start=1):
        gone = {q for p in range(len(t) - 399) if windows[t[p : p + 400]] > 1 for q in range(p, p + 400)}
        assert found[i].n_removed == len(gone) and found[i].text == "".join(c for q, c in enumerate(t) if q not in gone)
    assert found[2].n_removed == 0 and found[3].n_removed == 400


def test_spans_of_repeated_rows_are_held_once(spark):
    text = prose(11, 1500)
    docs = spark.createDataFrame([(1, 2, text.encode())] * 60 + [(3, 4, text.encode())], "_k1 bigint, _k2 bigint, _bytes binary")
    found = [sorted((x["start"], x["end"]) for x in r["_spans"]) for r in spans_of_texts(docs).collect()]
    assert len(found) == 2 and found[0] == found[1]
    assert len(set(found[0])) == len(found[0]) and found[0][0][0] == 0 and max(e for _, e in found[0]) == len(text)


def test_graph_search_finds_the_nearest_lists():
    random = np.random.default_rng(7)
    rows = random.normal(size=(4000, 16)) + 4 * random.integers(0, 3, (4000, 1))
    index = neighbours.fit_index(rows, 64)
    found, dist = index.search(rows[:200], 16)
    exact = np.sqrt(((rows[:200, None] - index.centroids[None]) ** 2).sum(axis=2))
    assert (found[:, 0] == exact.argmin(axis=1)).mean() > 0.98
    assert np.allclose(dist, np.take_along_axis(exact, found, axis=1), atol=1e-6)
    equal = neighbours.fit_index(np.ones((500, 3)), 10)
    assert len(equal.centroids) == 1


def test_recall_with_a_third_of_equal_vectors_and_small_blocks(spark):
    random = np.random.default_rng(8)
    rows = random.normal(size=(3000, 12)).astype(np.float32)
    rows[::3] = rows[0]
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id bigint, embedding array<float>")
    found = neighbours.search(table, block=100).toPandas()
    rows, hits = rows.astype(float), 0
    for q in range(0, 3000, 100):
        far = np.sqrt(((rows - rows[q]) ** 2).sum(axis=1))
        exact = [i for i in np.lexsort((np.arange(3000), far)) if i != q][:10]
        hits += len(set(exact) & set(found[found.query_id == q].vec_id))
    assert hits / 300 >= 0.9


def test_the_ratio_and_not_a_number_of_lists_ends_a_search(spark):
    random = np.random.default_rng(10)
    rows = random.normal(size=(4000, 48)).astype(np.float32)
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id bigint, embedding array<float>")
    found = neighbours.search(table, query_every=50, width=4).toPandas()
    rows, hits = rows.astype(float), 0
    for q in range(0, 4000, 50):
        far = np.sqrt(((rows - rows[q]) ** 2).sum(axis=1))
        hits += len(set(np.argsort(far)[1:11]) & set(found[found.query_id == q].vec_id))
    assert hits / 800 >= 0.99
    index = neighbours.fit_index(rows, 62)
    sizes = np.full(len(index.centroids), 64)
    exact = np.sqrt(((rows[:50, None] - index.centroids[None]) ** 2).sum(axis=2))
    for near, lists in zip(exact, index.within(rows[:50], 1.35, sizes, 200, 4)):
        assert set(np.flatnonzero(near <= 1.35 * near.min())) <= set(lists.tolist())


@pytest.mark.parametrize("dictionary", [True, False])
def test_token_files_are_read_selectively(spark, tmp_path, dictionary):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = str(tmp_path / "tokens")
    write_tokens(encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2), path, dictionary)
    whole = read_tokens(spark, path).toPandas().set_index("doc_id")
    part = read_tokens(spark, path, 50, 60)
    assert "GreaterThanOrEqual(doc_id,50)" in part._jdf.queryExecution().toString()
    for row in part.collect():
        assert row.start == whole.start[row.doc_id] and list(row.ids) == list(whole.ids[row.doc_id])
    assert part.count() == 11
    meta = read_metadata(spark, path)
    assert "ids" not in meta._jdf.queryExecution().executedPlan().toString().split("ReadSchema:")[1].split(">")[0]
    file = pq.ParquetFile(next((tmp_path / "tokens").glob("*.parquet")))
    columns = {file.metadata.row_group(0).column(i).path_in_schema: file.metadata.row_group(0).column(i) for i in range(file.metadata.num_columns)}
    ids = columns["ids.list.element"]
    assert ("RLE_DICTIONARY" in ids.encodings) == dictionary and ("DELTA_BINARY_PACKED" in ids.encodings) != dictionary
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert ids.has_offset_index and columns["doc_id"].has_column_index


@pytest.mark.parametrize("part", [0, 1, 7, 60, 100, 130, 150])
def test_draws_beyond_the_library_have_the_same_distribution(part, monkeypatch):
    quota = np.array([90, 0, 15, 45])
    plain = np.array([np.random.default_rng([1, i]).multivariate_hypergeometric(quota, part) for i in range(8000)])
    monkeypatch.setattr(mixing, "LIBRARY_LIMIT", 30)
    found = np.array([mixing.split_quota(quota, part, np.random.default_rng([2, i])) for i in range(8000)])
    assert (found.sum(axis=1) == part).all() and (found >= 0).all() and (found <= quota).all()
    for column in range(4):
        edges = np.arange(-1, 92)
        a, b = (np.searchsorted(np.sort(x[:, column]), edges, side="right") / len(x) for x in (plain, found))
        assert abs(a - b).max() < 0.035  # two samples of the same distribution differ by less
    assert np.allclose(np.cov(plain.T), np.cov(found.T), atol=0.06 * max(1.0, abs(np.cov(plain.T)).max()))


def test_shards_of_very_many_blocks_are_complete():
    quota = np.array([3 * 10**12, 10**9, 5, 0])
    first = np.zeros(4, dtype=np.int64)
    for shard in range(7):
        begin, count = mixing.shard_quotas(quota, 7, shard, 3)
        assert (begin == first).all() and abs(count.sum() - quota.sum() / 7) < 1
        first = begin + count
    assert (first == quota).all()


@pytest.mark.parametrize("blocks", [1, 4, 16])
def test_hot_ids_are_dealt_over_blocks_in_order(spark, blocks):
    random = np.random.default_rng(blocks)
    ids = [*[None] * 1000, *[7] * 1000, *[2**60 + i for i in range(200)], *random.integers(-500, 500, 800).tolist()]
    rows = [(i, f"é text {n // 2}" if n % 5 else f"text {n} 😀") for n, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    dealt, n = with_blocks(docs, blocks)
    found = dealt.select(F.coalesce("doc_id", F.lit(2**62)).alias("doc_id"), "text", "block").toPandas()
    assert len(found) == len(rows) and found.block.between(0, n - 1).all() and n <= 2 * blocks + 2
    ordered = found.sort_values(["doc_id", "text"])
    assert ordered.block.is_monotonic_increasing
    assert found.groupby(["doc_id", "text"]).block.nunique().max() == 1
    if blocks == 16:
        assert found.block.value_counts().max() < 2.5 * len(rows) / blocks


def test_starts_follow_the_order_of_hot_ids(spark, tmp_path):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(None if n % 3 == 0 else 5 if n % 3 == 1 else n, f"some text {n} " + "word " * (n % 7)) for n in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    path = str(tmp_path / "tokens")
    write_tokens(encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2), path)
    found = read_tokens(spark, path).toPandas().sort_values("start")
    assert found.start.tolist() == [0, *np.cumsum(found.n_tokens)[:-1]]
    assert found.doc_id.fillna(2**62).is_monotonic_increasing
    expected = [(-1 if i is None else i, *tokenizer.encode(t, add_special_tokens=False).ids, 2) for i, t in rows]
    assert sorted(expected) == sorted((int(i), *ids) for i, ids in zip(found.doc_id.fillna(-1), found.ids))


def test_mix_of_a_hot_null_id_follows_the_plain_order(spark):
    random = np.random.default_rng(8)
    rows = [(None if n % 3 == 0 else 7 if n % 3 == 1 else n, f"w{n} " * int(random.integers(0, 9)), "ab"[n % 5 == 0]) for n in range(900)]
    rows += rows[:20]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    plan = mixing.plan_copies(docs)
    found = plan.toPandas().sort_values(["position", "rank"])
    perm = found.doc_id.map(lambda x: hashlib.md5(f"mix|{'' if x != x else int(x)}".encode()).hexdigest())
    for position, part in found.assign(perm=perm).groupby("position"):
        expected = part.sort_values(["perm", "size", "_k1", "_k2"], kind="stable")
        assert part["rank"].tolist() == list(range(len(part))) and (part.n == len(part)).all()
        assert part[["perm", "size", "_k1", "_k2"]].values.tolist() == expected[["perm", "size", "_k1", "_k2"]].values.tolist()
        rounds = int(part.target.iloc[0] // part.source_size.iloc[0])
        before = part["size"].cumsum() - part["size"]
        more = part.target.iloc[0] - rounds * part.source_size.iloc[0]
        assert (part.copies == rounds + ((more > 0) & (2 * before + part["size"] <= 2 * more))).all()


def test_hot_null_ids_of_one_length_are_dealt_over_buckets(spark):
    rows = spark.range(4000).selectExpr("IF(id % 3 = 0, NULL, id) doc_id", "0 piece", "700L length", "id * 7919 ids_crc32")
    salts = 8
    salted = rows.where("doc_id IS NULL").withColumn("s", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    assert salted.groupBy("s").count().agg(F.max("count")).first()[0] < 2 * 1334 / salts
    found = pack(rows).toPandas()
    assert len(found) == 4000 and found.groupby("sequence_id").length.sum().max() <= 2048
    assert not found.duplicated(["sequence_id", "offset"]).any()
    again = pack(rows.repartition(7)).toPandas()
    columns = ["ids_crc32", "sequence_id", "offset"]
    assert sorted(found[columns].values.tolist()) == sorted(again[columns].values.tolist())


def test_row_keys_tell_null_from_every_text(spark):
    rows = [(None, "a"), ("\0", "a"), ("", "a"), ("a", None), ("a", "\0"), ("a", ""), ("0", "a"), (None, None)]
    keyed = with_row_key(spark.createDataFrame(rows, "b string, `a.c` string"))
    assert keyed.select("_k1").distinct().count() == keyed.select("_k2").distinct().count() == len(rows)
