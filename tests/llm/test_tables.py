"""Every operator on empty tables and on tables with NULLs, odd texts, repeated rows and clashing names."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from fixtures_llm import odd_rows, odd_vectors, write_tables
from tokenizers import Tokenizer

from __spark_entry__ import queries

NAMES = sorted(n for n in queries() if n.startswith("op") and n[2].isdigit()) + ["pipeline"]
#: Queries with other rows than one per document.
OTHER_ROWS = {"op9_neighbours", "op3_html_text", "op10_packing", "op11_histogram_packing", "op12_conversation_repair", "pipeline"}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write_tables(spark, str(tmp_path_factory.mktemp("empty")), None)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return write_tables(spark, str(tmp_path_factory.mktemp("odd")), odd_rows())


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_no_rows(spark, empty, name):
    assert queries()[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", [n for n in NAMES if n not in OTHER_ROWS])
def test_one_row_per_document(spark, odd, name):
    found = queries()[name](spark, odd).toPandas()
    ids = sorted(found.doc_id.fillna(-1).astype(int))
    assert ids == sorted(-1 if r[0] is None else r[0] for r in odd_rows())


def test_pages(spark, odd):
    found = sorted(map(tuple, queries()["op3_html_text"](spark, odd).select("text", "n_chars").collect()))
    assert found == [("", 0), ("", 0), ("One, two.", 9), ("One, two.", 9)]


def test_sequences_hold_every_token_once(spark, odd):
    found = queries()["op10_packing"](spark, odd).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = []
    for doc_id, text, *_ in odd_rows():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            crc = zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())
            expected.append((-1 if doc_id is None else doc_id, piece, a, b - a, crc))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(expected) == sorted(found.fillna({"doc_id": -1})[columns].astype(int).itertuples(index=False, name=None))
    for _, part in found.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *np.cumsum(part.length)[:-1]]
        assert part.length.sum() <= 2048


def test_token_files(spark, odd):
    found = queries()["op6_token_files"](spark, odd).toPandas().sort_values("start")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = sorted(odd_rows(), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    at = 0
    for (doc_id, text, *_), got in zip(rows, found.itertuples()):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert (got.start, got.n_tokens, got.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        assert doc_id is None or got.doc_id == doc_id
        at += len(ids)


def test_repeats(spark, odd):
    found = queries()["op4_suffix_dedup"](spark, odd).toPandas()
    texts = [(r[1] or "").encode() for r in odd_rows()]
    starts = {}
    for text in texts:
        for p in range(len(text) - 399):
            key = hashlib.blake2b(text[p : p + 400], digest_size=12).digest()
            starts[key] = starts.get(key, 0) + 1
    expected = []
    for (doc_id, *_), text in zip(odd_rows(), texts):
        gone = np.zeros(len(text) + 1, dtype=bool)
        for p in range(len(text) - 399):
            if starts[hashlib.blake2b(text[p : p + 400], digest_size=12).digest()] > 1:
                gone[p : p + 400] = True
        kept = np.frombuffer(text, np.uint8)[~gone[:-1]].tobytes()
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if text else 0
        expected.append((-1 if doc_id is None else doc_id, len(text), len(text) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    got = found.fillna({"doc_id": -1}).astype({"doc_id": int})
    assert sorted(expected) == sorted(got[["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False, name=None))


def test_neighbours(spark, odd):
    found = queries()["op9_neighbours"](spark, odd).toPandas()
    best = {}
    for i, v, _ in odd_vectors():
        if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v):
            best.setdefault(i, np.array(v, dtype=np.float32).astype(float))
    asked = [i for i in best if i % 100 == 0]
    assert sorted(set(found.query_id)) == sorted(asked)
    hits = total = 0
    for q in asked:
        exact = sorted((float(np.sqrt(((best[q] - v) ** 2).sum())), i) for i, v in best.items() if i != q)[:10]
        got = found[found.query_id == q].sort_values("rank")
        assert got["rank"].tolist() == list(range(1, 11))
        assert np.allclose(got.score, [np.sqrt(((best[q] - best[i]) ** 2).sum()) for i in got.vec_id])
        assert list(zip(got.score, got.vec_id)) == sorted(zip(got.score, got.vec_id))
        hits += len({i for _, i in exact} & set(got.vec_id))
        total += 10
    assert hits / total >= 0.9
