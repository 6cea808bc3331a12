"""The pipeline's stages, each on what its predecessor kept, against plain Python on the smallest table."""

import hashlib
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from fixtures_llm import DOCUMENTS, odd_rows
from test_tables_of_numbers import best_fit
from test_text import naive_fingerprint
from tokenizers import Tokenizer

FOLDER = "/root/testdata/sf0.001"
COLUMNS = list(corpus_pipeline.COLUMNS)


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage, and the result of run()."""
    docs, found = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.store(stage(spark, docs, FOLDER), "test")
        found.append((before.toPandas(), docs.toPandas()))
    return found, corpus_pipeline.run(spark, FOLDER).toPandas()


def rows(frame):
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


def test_language_keeps_clean_documents(stages):
    before, after = stages[0][0]
    assert list(after.columns) == COLUMNS and rows(before) == rows(after)


def test_one_of_each_group_stays(stages):
    before, after = stages[0][1]
    prints = {r.doc_id: naive_fingerprint(r.text) for r in before.itertuples()}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2 and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert sorted(after.doc_id) == sorted({find(i) for i in prints})
    assert rows(after) == rows(before[before.doc_id.isin(after.doc_id)])


def test_repeats_are_cut_out(stages):
    before, after = stages[0][2]
    texts = [t.encode() for t in before.text]
    n = corpus_pipeline.REPEATED_BYTES
    windows = Counter(hashlib.md5(t[p : p + n]).digest() for t in texts for p in range(len(t) - n + 1))
    for row, text in zip(before.itertuples(), texts):
        gone = np.zeros(len(text), dtype=bool)
        for p in range(len(text) - n + 1):
            if windows[hashlib.md5(text[p : p + n]).digest()] > 1:
                gone[p : p + n] = True
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        found = after[after.doc_id == row.doc_id].iloc[0]
        assert found.text == kept and found.n_chars == len(kept) and found.source == row.source
    assert len(before) == len(after)


def test_mix_takes_a_prefix_of_each_permuted_source(stages):
    before, after = stages[0][3]
    before = before.assign(size=before.text.str.split().str.len())
    copies = after.groupby("doc_id").size()
    sizes = before.groupby("source")["size"].sum()
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes.index))}
    goal, left, free = {}, 1.5 * sizes.sum(), set(sizes.index)
    while free:
        share = left / sum(weights[s] for s in free)
        over = {s for s in free if share * weights[s] > 2 * sizes[s]}
        goal |= {s: 2.0 * sizes[s] if over else share * weights[s] for s in over or free}
        left, free = left - sum(goal[s] for s in over), free - over if over else set()
    for source, part in before.groupby("source"):
        part = part.assign(key=[hashlib.md5(f"mix|{i}".encode()).hexdigest() for i in part.doc_id]).sort_values("key")
        rounds = int(goal[source] // sizes[source])
        extra, at = goal[source] - rounds * sizes[source], 0
        for row in part.itertuples():
            wanted = rounds + (extra > 0 and 2 * at + row.size <= 2 * extra)
            assert copies.get(row.doc_id, 0) == wanted
            at += row.size
    assert set(rows(after)) <= set(rows(before[COLUMNS]))


def test_packing_holds_all_tokens(stages):
    before, after = stages[0][4]
    tokenizer, expected = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for row in before.itertuples():
        ids = [*tokenizer.encode(row.text, add_special_tokens=False).ids, 0]
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected.append((row.doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(expected) == sorted(after[columns].itertuples(index=False, name=None))
    for _, part in after.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() <= 2048
    assert after.sequence_id.nunique() <= best_fit(after.length)


def test_run_is_the_stages_one_after_the_other(stages):
    assert rows(stages[0][-1][1]) == rows(stages[1])


def test_odd_documents_pass_every_stage(spark):
    docs = spark.createDataFrame(odd_rows(), DOCUMENTS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.store(stage(spark, docs, FOLDER), "odd")
        assert docs.columns == COLUMNS
    kept = pd.Series([r.doc_id for r in docs.collect()])
    assert not kept.isin([1, 2, 3, 7]).any()  # no letters
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() >= len(kept)


def test_without_labels_texts_with_letters_stay(spark):
    docs = spark.createDataFrame([(1, "some text", None, "a", 9), (2, None, None, "a", 0), (3, "12 %", None, "a", 4)], DOCUMENTS)
    assert [r.doc_id for r in corpus_pipeline.language_id(spark, docs, FOLDER).collect()] == [1]
