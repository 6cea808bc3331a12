"""Histogram packing, conversation repair and periodic runs against plain versions."""

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from fixtures_llm import odd_conversations, odd_rows, prose, write_tables
from tokenizers import Tokenizer

from draftline.llm import catalog
from draftline.llm.conversation_repair import damaged, repair, repair_damaged, repaired_rows
from draftline.llm.histogram_packing import fillings, pack_histogram, plan_windows, repeats
from draftline.llm.periodic_runs import Extensions, collapse_runs, find_runs

SPACE = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return write_tables(spark, str(tmp_path_factory.mktemp("odd")), odd_rows() + planted_rows())


def planted_rows():
    """IDs whose texts are made periodic, and texts that are so."""
    ids = [i for i in range(20_000, 20_400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, prose(i, 10 + 7 * k), "en", "a", 1) for k, i in enumerate(ids)]
    rows += [(30_000 + i, "a b " * (5 + i) + prose(i, 30) + " x y z" * 20, "en", "a", 1) for i in range(40)]
    return rows + [(31_000, "w " * 6_000, "en", "a", 1), (31_001, "word\u00a0word " * 30, "en", "a", 1)]


# packing


def test_fillings_are_all_short_combinations():
    counts = [0, 3, 1, 2, 5, 0, 1, 0, 2, 1]  # window 9
    found = sorted(tuple(r) for r in fillings(counts).tolist())
    expected = set()
    for a in range(1, 10):
        for b in range(a + 1):
            for c in range(b + 1):
                used = [x for x in (a, b, c) if x]
                if a + b + c == 9 and all(counts[x] >= used.count(x) for x in used):
                    expected.add((a, b, c))
    assert found == sorted(expected)


def test_repeats_solve_least_squares():
    rnd = np.random.default_rng(4)
    counts = np.concatenate([[0], rnd.integers(0, 50, 40)])
    rows = fillings(counts)
    active, x = repeats(rows, counts, rounds=400, retries=40, steps=2000)
    assert (x >= 0).all()
    weight = np.arange(41) / 40
    use = np.zeros((41, len(rows)))
    for j, row in enumerate(rows):
        for c in row[row > 0]:
            use[c, j] += 1
    use, target = use * weight[:, None], counts * weight
    whole = np.zeros(len(rows))
    whole[active] = x
    y, step = np.zeros(len(rows)), 1 / np.linalg.norm(use, 2) ** 2
    for _ in range(50_000):  # projected gradient
        y = np.maximum(0, y + step * use.T @ (target - use @ y))
    squares = lambda v: ((use @ v - target) ** 2).sum()
    assert squares(whole) <= squares(y) * 1.02 + 1e-6


@pytest.mark.parametrize("n", [0, 1, 7, 300, 5000])
def test_plans_use_every_piece_at_most_once(n):
    rnd = np.random.default_rng(n)
    counts = np.bincount(np.clip(rnd.lognormal(3, 1, n).astype(int), 1, 128), minlength=129)
    plan, outside = plan_windows(counts)
    used = np.array(outside)
    for row, times in plan:
        assert sum(row) == 128 and times > 0
        for c in row:
            used[c] += times
    assert used.tolist() == counts.tolist() and min(outside) >= 0
    left = fillings(outside)
    assert len(left) == 0  # nothing that still fills a window stays outside


def tokens(end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_packing_holds_every_token_once(spark, odd):
    found = catalog.op11_histogram_packing(spark, odd).toPandas().fillna({"doc_id": -1})
    ids_of, texts = tokens(1), {}
    for doc_id, text, *_ in odd_rows() + planted_rows():
        texts.setdefault(-1 if doc_id is None else doc_id, []).append(ids_of(text))
    for doc_id, part in found.groupby("doc_id"):
        left = []  # pieces of documents with one doc_id, told apart by what they hold
        for ids in texts[doc_id]:
            left.append([ids, 0])
        for row in part.sort_values(["doc_tokens", "start"]).itertuples():
            match = next(x for x in left if len(x[0]) == row.doc_tokens and x[1] == row.start and crc(x[0][x[1] : x[1] + row.length]) == row.ids_crc32)
            match[1] += row.length
        assert all(len(ids) == done for ids, done in left)
    assert set(found.doc_id) == set(texts)
    sizes = []
    for _, part in found.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *np.cumsum(part.length)[:-1]]
        sizes.append(part.length.sum())
    short = sorted(s for s in sizes if s != 2048)
    assert len(set(short)) == len(short) and all(s & (s - 1) == 0 for s in short)  # no padding


def test_packing_keeps_ids_and_deals_a_hot_length(spark):
    rows = [(None if i % 3 else i, "same") for i in range(3000)] + [(i, prose(i, i % 90)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    from draftline.llm.common import store
    from draftline.llm.histogram_packing import encode_pieces

    pieces = store(encode_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 1, capacity=64), "pieces")
    found = pack_histogram(pieces, capacity=64, with_ids=True).toPandas()
    assert found.length.sum() == sum(r.length for r in pieces.select("length").collect())
    for row in found.itertuples():
        assert len(row.ids) == 4 * row.length and zlib.crc32(row.ids) == row.ids_crc32
    sizes = found.groupby("sequence_id").length.sum()
    assert (sizes <= 64).all() and (sizes & (sizes - 1) == 0).all()
    for _, part in found.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *np.cumsum(part.length)[:-1]]


# conversations


def plain_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of (turn, role, text) in order."""
    counts, seen, kinds = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        kind = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "fine"
        seen.add((role, text))
        kinds.append(kind)
        if kind != "fine":
            counts[kind] += 1
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, state, inserts):
        """(cost, audit, repaired) of what follows."""
        found = []
        if i == len(rows):
            if state in ("", "a"):
                found.append((0, "", ()))
        else:
            _, role, text = rows[i]
            more, extra = best(i + 1, state, 0), kinds[i] == "truncated"
            found.append((3 + more[0], "D" + more[1], more[2]))
            if kinds[i] in ("fine", "truncated"):
                if (state, role[:1]) in step:
                    more = best(i + 1, step[state, role[:1]], 0)
                    found.append((extra + more[0], "K" + more[1], (f"{role}:{text}", *more[2])))
                for new in ("user", "assistant"):
                    if (state, new[0]) in step:
                        more = best(i + 1, step[state, new[0]], 0)
                        found.append((2 + extra + more[0], "R" + more[1], (f"{new}:{text}", *more[2])))
        if inserts < 3:
            for new in ("user", "assistant"):
                if (state, new[0]) in step:
                    more = best(i, step[state, new[0]], inserts + 1)
                    found.append((2 + more[0], "I" + more[1], (f"{new}:", *more[2])))
        return min(found, default=(10**9, "", ()))

    cost, audit, repaired = best(0, "", 0)
    sha = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
    return (gaps, *counts.values(), illegal, cost, audit, sha), repaired


def plain_damage(rows):
    found = {}
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else x
        role, text = space(role), space(text)
        fault = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        group = found.setdefault(conv, [])
        if fault == 1:
            text = ""
        elif fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif fault == 4:
            role = "user"
        group += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {conv: sorted(group, key=order) for conv, group in found.items()}


@pytest.mark.parametrize("limits", [{}, {"long_rows": 4}, {"long_rows": 1, "long_bytes": 1}, {"long_rows": 60}])
def test_repair_is_cheapest_and_least(spark, odd, limits):
    rows = spark.read.parquet(f"{odd}/conversations.parquet")
    found = {r[0]: tuple(r)[1:] for r in repair_damaged(rows, **limits).collect()}
    expected = {conv: plain_repair(group)[0] for conv, group in plain_damage(odd_conversations()).items()}
    assert found == expected


def test_query_repairs_every_conversation(spark, odd):
    found = catalog.op12_conversation_repair(spark, odd)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert found.count() == len({r[0] for r in odd_conversations()})


@pytest.mark.parametrize("limits", [{}, {"long_rows": 4}])
def test_repaired_rows_alternate(spark, odd, limits):
    rows = damaged(spark.read.parquet(f"{odd}/conversations.parquet"))
    found = {}
    for r in repaired_rows(rows, **limits).orderBy("conv_id", "part", "no", "place").collect():
        found.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, group in plain_damage(odd_conversations()).items():
        assert tuple(found.get(conv, ())) == plain_repair(group)[1]


def test_repair_without_damage_leaves_a_good_conversation(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello!"), (1, 2, "assistant", "Hello!")]
    docs = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1L AS copies")
    (row,) = repair(docs).collect()
    assert (row.cost, row.audit) == (0, "KKK")
    assert row.repaired_sha256 == hashlib.sha256(b"system:Be kind.\nuser:Hello!\nassistant:Hello!").hexdigest()


# periodic runs


def plain_runs(s, least=24, exponent=3):
    found, n = {}, len(s)
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            if j - i + p >= max(least, exponent * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((a, length, p) for (a, length), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = None
    for s, length, q in runs:
        if top is None or length * top[2] > top[1] * q:
            top = (s, length, q)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    facts = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(runs), *facts, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())


def test_query_finds_every_run(spark, odd):
    # plain search is quadratic: the longest text is left to the next test
    rows = [r[:2] for r in odd_rows() + planted_rows()]
    found = [tuple(r) for r in catalog.op13_periodic_runs(spark, odd).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    long = {r[0] for r in rows if len((r[1] or "").split()) > 5000}
    expected = sorted((plain_row(*r) for r in rows if r[0] not in long), key=key)
    assert sorted((r for r in found if r[0] not in long), key=key) == expected
    assert sum(r[1] > 0 for r in expected) > 50
    assert next(r[1:6] for r in found if r[0] == 31_000) == (1, 0, 6000, 1, 6_000_000)


def test_runs_of_small_alphabets(monkeypatch):
    from draftline.llm import periodic_runs

    monkeypatch.setattr(periodic_runs, "_CHUNK", 50)  # many small chunks
    monkeypatch.setattr(periodic_runs, "_HELD", 20)
    rnd = random.Random(9)
    for _ in range(60):
        texts = []
        for _ in range(rnd.randint(1, 5)):
            n, k = rnd.choice([0, 1, 23, 24, 80, 200]), rnd.choice([1, 2, 3, 40])
            words = [rnd.randrange(k) for _ in range(n)]
            if n and rnd.random() < 0.6:
                a = rnd.randrange(n)
                p = 1 + rnd.randrange(max(1, (n - a) // 3))
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
                if rnd.random() < 0.5:
                    words[rnd.randrange(n)] = 77
            texts.append(words)
        found = find_runs(np.array([w for t in texts for w in t], dtype=np.int64), np.cumsum([len(t) for t in texts]))
        expected = [(x, *r) for x, t in enumerate(texts) for r in plain_runs(t)]
        assert list(zip(*(c.tolist() for c in found))) == expected


def test_extensions_count_equal_ids():
    rnd = random.Random(2)
    s = [rnd.randrange(2) for _ in range(150)] + [0, 1, 1] * 60
    ids = np.array([-1, *s, -2], dtype=np.int64)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(1, len(s)), np.arange(1, len(s))))
    i, j = i[i != j], j[i != j]
    plain = []
    for a, b in zip(i.tolist(), j.tolist()):
        n = 0
        while ids[a + n] == ids[b + n]:
            n += 1
        plain.append(n)
    assert Extensions(ids).of(i, j).tolist() == plain


def test_run_bounds_are_parameters(spark):
    docs = spark.createDataFrame([(1, "a b a b a b a b c"), (2, None)], "doc_id bigint, text string")
    found = {r.doc_id: r for r in collapse_runs(docs, least=6).collect()}
    assert [tuple(x) for x in found[1].runs] == [(0, 8, 2)] and found[1].collapsed == "a b c"
    assert found[2].runs == [] and found[2].top is None and found[2].collapsed == ""
    with pytest.raises(ValueError):
        collapse_runs(docs, exponent=2)
