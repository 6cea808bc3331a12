"""Fingerprints, quality counts, token counts, language and main text against plain versions."""

import functools
import gc
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from compare import difference
from fixtures_llm import clashing, odd_rows, write_tables
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from __spark_entry__ import oracle_sql, queries
from draftline.llm import simhash
from draftline.llm.html_text import main_text
from draftline.llm.language import code_words, predict, train
from draftline.llm.quality_rules import apply_rules, base_counts
from draftline.llm.token_counts import TrieCounter, piece_counts, unigram_scores
from draftline.llm.tokens import PieceEncoder

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op2_quality_rules", "op5_mixing"])
def test_sql_on_odd_rows(spark, tmp_path, name):
    folder = write_tables(spark, str(tmp_path / "t"), odd_rows())
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    ours, theirs = queries()[name](spark, folder).toPandas(), connection.execute(oracle_sql()[name]).df()
    for frame in (ours, theirs):
        frame["doc_id"] = frame.doc_id.fillna(-1).astype("int64")
    assert difference(ours, theirs) is None


def test_quality_runs_no_python(spark):
    docs = spark.createDataFrame(odd_rows(), "doc_id bigint, text string, lang string, source string, n_chars bigint")
    plan = apply_rules(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_a_noisy_document_goes_and_its_neighbours_stay(spark):
    fine = [(i, " ".join(f"word{i * j % 97}" for j in range(1, 80)), "en", "a") for i in range(1, 40)]
    noisy = (99, " ".join(f"w{j}###%%%" for j in range(80)), "en", "a")
    docs = clashing(spark.createDataFrame([*fine, noisy], "doc_id bigint, text string, lang string, source string"))
    verdict = {r.doc_id: r.kept for r in apply_rules(docs).collect()}
    assert verdict.pop(99) is False
    assert all(verdict.values())


def naive_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.one_of(st.none(), st.text(st.sampled_from(" \n\tabAÄ\x0b\x85"), max_size=60)))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == naive_fingerprint(text)


def test_long_texts_are_hashed_in_parts(monkeypatch):
    text = " ".join(f"w{i * i % 1009}" for i in range(1000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_CHUNK", 7)
    assert simhash.fingerprint(text) == whole == naive_fingerprint(text)


@pytest.mark.parametrize("pairwise", [1, 32])
def test_links_connect_just_what_two_bits_connect(spark, pairwise, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    random = np.random.default_rng(5)
    prints = set()
    for centre in random.integers(0, 2**64, 12, dtype=np.uint64).tolist():
        for _ in range(25):
            prints.add(centre)
            for bit in random.choice(64, random.integers(1, 3), replace=False).tolist():
                centre ^= 1 << bit
            if random.random() < 0.3:
                centre ^= int(random.integers(0, 2**60))
    prints = sorted(prints)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "print bigint"))
    found = {r.node: r.component for r in simhash.components(edges, "a", "b").collect()}
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    for i in range(len(prints)):
        for j in range(i):
            ours = found.get(signed[i], signed[i]) == found.get(signed[j], signed[j])
            assert ours == (root(i) == root(j))


def test_signatures_are_not_broadcast(spark, monkeypatch):
    """64 rows of each fingerprint, of which Spark knows the bytes of one."""
    plans, keep = {}, simhash.store

    def watch(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(df, name)

    monkeypatch.setattr(simhash, "store", watch)
    simhash.links(spark.range(2000).selectExpr("xxhash64(id) AS print"))
    assert "SortMergeJoin" in plans["simhash-buckets"] and "Broadcast" not in plans["simhash-buckets"]


def test_fingerprints_of_all_rows_are_not_broadcast(spark):
    """NULL ids and one text take next to no bytes in a file, however many rows have them."""
    docs = spark.range(3000).selectExpr("IF(id > 9, NULL, id) AS doc_id", "IF(id % 3 = 0, 'a b c d', 'e f g h') AS text")
    found = simhash.near_duplicates(docs)
    joins = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x]
    assert "SortMergeJoin [print" in joins[0]
    assert found.count() == 3000 and found.where("component_id IS NULL").count() == 0


@pytest.mark.parametrize("bits", [1, 3, 9])
def test_windows_of_equal_hashes_are_told_apart(spark, bits):
    random = np.random.default_rng(bits)
    texts = [" ".join(random.choice(list("abcdefg"), n)) for n in random.integers(0, 200, 60)]
    texts += [" ".join(map(str, range(n))) for n in (0, 2, 3, 4, 5, 90)] + ["a b c a b c", "a b c x a b c", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = {r.id: r.n_repeat_words for r in base_counts(docs, hash_bits=bits).collect()}
    assert found == {r.id: r.n_repeat_words for r in base_counts(docs).collect()}
    for i, text in enumerate(texts):
        words = (text or "").split()
        windows = Counter(zip(words, words[1:], words[2:]))
        again = {j + k for j, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
        assert found[i] == len(again)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_cached_pieces_give_the_ids_of_whole_texts(name):
    random = np.random.default_rng(1)
    parts = ["a", "Bc", " ", "  ", "\n", "\t", "é", "é", " d", "\x1c", "\x85", "'s", "<|endoftext|>", "12", "²", "_", ".", "%%", "日本", "😀", "İ", "ß", "\r\n", "\x00", "x" * 70]
    texts = ["".join(random.choice(parts, random.integers(0, 25))) for _ in range(3000)] + [None, ""]
    encoder = PieceEncoder(public_tokenizers.path(name), cached=500)
    for at in range(0, len(texts), 100):
        ids, starts = encoder.encode(pa.array(texts[at : at + 100], pa.string()), end=5)
        for i, text in enumerate(texts[at : at + 100]):
            expected = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids
            assert ids[starts[i] : starts[i + 1]].tolist() == [*expected, 5]


def test_trie_counts_equal_the_library_and_do_not_depend_on_the_bound(spark):
    scores = unigram_scores(spark.read.parquet(f"{SMALL}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
    library = Tokenizer(models.Unigram([("<unk>", min(scores.values())), *scores.items()], unk_id=0))
    library.pre_tokenizer = pre_tokenizers.Metaspace()
    texts = pd.read_parquet(f"{SMALL}/documents.parquet").text
    words = sorted({w for t in texts for w in t.split()})[::7] + ["x" * 500, "ab" * 40]
    ours, tight = TrieCounter(scores), TrieCounter(scores, nodes=50, words=7)
    counts = [ours.count(w) for w in words]
    assert counts == [tight.count(w) for w in words] == [len(x.ids) for x in library.encode_batch(words)]
    assert ours.count("a𐎀") == ours.count("a") + 4  # no piece: four bytes
    assert ours.size < sum(len(w) + 1 for w in words) / 2  # prefixes are shared


def test_trie_nodes_are_no_objects_of_the_garbage_collector():
    counter = TrieCounter({"▁": -1.0, "▁a": -2.0, "ab": -2.5, "ba": -3.0, "a": -3.0, "b": -3.0})
    gc.collect()
    before = len(gc.get_objects())
    counts = [counter.count(f"{i:013b}".replace("0", "a").replace("1", "b")) for i in range(5000)]
    gc.collect()
    assert len(counts) < counter.size and len(gc.get_objects()) - before < counter.size / 10


def plain_scores(texts):
    """Scores by counting every word of every text on its own."""
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    seen = Counter(i for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t or "") for i in library.encode(w))
    kept = [
        i
        for i in range(library.get_piece_size())
        if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))
    ]
    total = sum(seen[i] + 1 for i in kept)
    return {library.id_to_piece(i): math.log((seen[i] + 1) / total) for i in kept}


def plain_tokens(word, scores, unknown):
    """Tokens of the best path, by a table over all pairs of places."""
    text, best = "▁" + word, [(0.0, 0)]
    for end in range(1, len(text) + 1):
        ways = [
            (best[start][0] + scores[text[start:end]], start, best[start][1] + 1)
            for start in range(max(0, end - 64), end)
            if text[start:end] in scores
        ]
        if text[end - 1] not in scores:
            ways.append((best[end - 1][0] + unknown, end, best[end - 1][1] + len(text[end - 1].encode())))
        score, _, tokens = max(ways, key=lambda way: (way[0], -way[1]))
        best.append((score, tokens))
    return best[-1][1]


def test_token_counts_of_whole_texts(spark, tmp_path):
    rows = odd_rows()
    found = queries()["op1_token_counts"](spark, write_tables(spark, str(tmp_path), rows))
    scores = plain_scores([r[1] for r in rows])
    assert max(map(len, scores)) <= 64
    unknown = min(scores.values()) - 10.0
    tokens = functools.cache(lambda word: plain_tokens(word, scores, unknown))
    expected = []
    for doc_id, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        expected.append((-1 if doc_id is None else doc_id, len(words), sum(map(tokens, words))))
    assert sorted(map(tuple, found.na.fill(-1, ["doc_id"]).collect())) == sorted(expected)


def test_scores_do_not_depend_on_how_many_words_are_cut_at_once(spark):
    docs, model = spark.read.parquet(f"{SMALL}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model")
    some = dict(map(tuple, piece_counts(docs.repartition(5), model, words=50).collect()))
    assert some == dict(map(tuple, piece_counts(docs, model).collect()))


def test_language_on_held_out_documents(spark):
    found = queries()["op8_language_id"](spark, SMALL).toPandas().merge(pd.read_parquet(f"{SMALL}/documents.parquet"), on="doc_id")
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]).all()
    tested = found[found.held_out]
    assert (tested.lang_pred == tested.lang).mean() > 0.98
    assert found.score.between(0, 1).all()


def test_language_looks_at_the_text_alone(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = train(docs)
    rows = docs.limit(50).selectExpr("doc_id", "text", "'xx' lang", "NULL source")
    first = {r.doc_id: r.lang_pred for r in predict(docs.limit(50), model).collect()}
    assert first == {r.doc_id: r.lang_pred for r in predict(rows, model).collect()}
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 %%"), (4, "the the")], "doc_id bigint, text string")
    assert [r.lang_pred == "und" for r in predict(odd, model).orderBy("doc_id").collect()] == [True, True, True, False]


def test_one_or_no_language(spark):
    one = spark.createDataFrame([(i, "some text", "en") for i in range(8)], "doc_id bigint, text string, lang string")
    assert {r.lang_pred for r in predict(one, train(one)).collect()} == {"en"}
    none = one.selectExpr("doc_id", "text", "CAST(NULL AS string) lang")
    assert {(r.lang_pred, r.score) for r in predict(none, train(none)).collect()} == {("und", 0.0)}


def test_code_words_differ_widely():
    for classes in (2, 3, 5, 9, 40):
        code = code_words(classes).astype(int)
        apart = [(code[i] != code[j]).sum() for i in range(classes) for j in range(i)]
        assert min(apart) >= max(1, code.shape[1] // 5)


LONG = "A first sentence, with a comma, and enough words to count as a paragraph of the article itself. " * 2


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("plain &lt;text&gt;", "plain <text>"),
        (f"<nav><a href=x>Home</a></nav><article><h1>T&amp;T</h1><p>{LONG}<p>Short.</article><footer>Foot</footer>", f"T&T\n\n{LONG.strip()}\n\nShort."),
        (f"<div id=content><p>{LONG}</p><ul><li>one</li><li>two</li></ul></div><div class='comments'><p>{LONG * 3}</p></div>", f"{LONG.strip()}\n\none\n\ntwo"),
        (f"<article><p>{LONG}</p><script>var t='</p><p>no';</script><style>p{{}}</style><div class=ad>Buy, buy, buy</div></article>", LONG.strip()),
        (f"<article><section><p>{LONG}</p></section><section><p>Second, {LONG}</p></section></article>", f"{LONG.strip()}\n\nSecond, {LONG.strip()}"),
        (f"<article><p>{LONG}</p><aside>Notice</aside><form>Name <input></form><p>a <b>b</b>\n c<br>d</p></article>", f"{LONG.strip()}\n\na b c d"),
        (f"<body><div><ul><li><a href=1>Menu one</a></li><li><a href=2>Menu two</a></li><li><a href=3>Menu three</a></li></ul><p>{LONG}</p></div></body>", LONG.strip()),
        (f"<div class='content with-sidebar'><p>{LONG}</p></div><div class=sidebar-content><p>{LONG * 2}</p></div>", LONG.strip()),
        (f"<div class='has-comments post'><p>{LONG}</p><div class='comment-content'><p>{LONG * 2}</p></div></div>", LONG.strip()),
        (f"<div id=main><p>{LONG}</p><div id='cookieNotice'>We use cookies, many of them, here and there.</div></div>", LONG.strip()),
        (f"<article><p>{LONG}</p><!-- <p>not this</p> --><p title='a>b'>x</p>", f"{LONG.strip()}\n\nx"),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


REFERENCES = "".join(f"<li><a href={i}>Source number {i}</a></li>" for i in range(4))


@pytest.mark.parametrize(
    "page, words",
    [
        (f"<div id=wrap><h1>Title</h1><div class=content><p>{LONG}</p><p>{LONG}</p></div></div>", "Title"),
        (f"<div><h1>Title</h1><p>Short lead.</p><div><div><p>{LONG}</p><p>{LONG}</p></div></div></div>", "Title Short lead."),
        (f"<body><div><p>{LONG}</p><p>{LONG}</p></div><h2>Next</h2><ul><li>one</li></ul><pre>x = 1</pre><div><p>{LONG}</p><p>{LONG}</p></div><section><p>The end.</p></section></body>", "Next one x = 1 The end."),
        (f"<div><div><p>{LONG}</p><p>{LONG}</p></div>free text<table><tr><td>cell</table></div>", "free text cell"),
        (f"<article><p>{LONG}</p><h2>Sources</h2><ol>{REFERENCES}</ol></article>", "Sources " + " ".join(f"Source number {i}" for i in range(4))),
        (f"<div class=post><p>{LONG}</p><p>{LONG}</p><ul>{REFERENCES}</ul></div>", " ".join(f"Source number {i}" for i in range(4))),
    ],
)
def test_nothing_of_the_article_goes(page, words):
    found = main_text(page)
    assert " ".join(x for x in found.split("\n\n") if x != LONG.strip()) == words
    assert found.count(LONG.strip()[:40]) == page.count(LONG[:40])


@pytest.mark.parametrize(
    "inner",
    [
        "<h2 id=related-work>Related</h2>",
        "<h2 id=copyright>On copyright</h2>",
        "<section id=legal-history><p>History.</p></section>",
        "<section id=search-methods><h3>Methods</h3></section>",
        "<div id=search-methods class='section level2'><p>Methods.</p></div>",
        "<p title='the hidden cost'>Cost.</p>",
        "<p data-note='class=ad'>Note.</p>",
        "<p>where <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>",
    ],
)
@pytest.mark.parametrize("around", ["article", "div"])
def test_names_and_titles_do_not_end_sections(inner, around):
    expected = " ".join(re.sub("<[^>]*>", "", inner).split())
    assert main_text(f"<{around}><p>{LONG}</p>{inner}<p>{LONG}</p></{around}>").split("\n\n")[1:-1] == [expected]


@pytest.mark.parametrize("names", ["class=related-posts", "class=ad", "id=comments", "role=search", "hidden", "style='color:red; display: none'", "aria-hidden=true", "class='social-media'"])
def test_clear_marks_end_what_they_mark(names):
    page = f"<article><p>{LONG}</p><div {names}>{'<a href=x>Some link</a> ' * 4}</div></article>"
    assert main_text(page) == LONG.strip()


def test_menus_beside_the_article_go():
    menu = "".join(f"<li><a href={i}>Menu {i}</a></li>" for i in range(4))
    page = f"<body><ul>{menu}</ul><div><p>{LONG}</p><p>{LONG}</p></div><p>End.</p><div><ul>{menu}</ul></div><div>Company</div></body>"
    assert main_text(page) == f"{LONG.strip()}\n\n{LONG.strip()}\n\nEnd."


def test_deep_and_broken_pages_end():
    assert main_text("<div>" * 20_000 + "deep text here" + "</p>" * 5) == "deep text here"
    assert main_text("<p>a<" * 2000)
    assert isinstance(main_text('<a href="' * 3000), str)


def test_pages_lose_nothing_of_the_article(spark):
    pages = pd.read_parquet(f"{SMALL}/pages.parquet")
    found = queries()["op3_html_text"](spark, SMALL).toPandas().merge(pages, on=["page_id", "url"])
    assert len(found) == len(pages)
    for row in found.itertuples():
        inner = re.search(r"<article>(.*?)</article>", row.html, re.S)[1]
        words = re.sub(r"<[^>]*>", " ", inner).replace("&amp;", "&").replace("&quot;", '"').replace("&amp", "&").split()
        assert row.text.split() == words and row.n_chars == len(row.text)


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<body><form id=aspnetForm><nav><a href=x>Home</a></nav><article><p>{LONG}</p></article></form></body>", LONG.strip()),
        (f"<body><form><div><p>{LONG}</p><p>{LONG}</p></div></form><footer>Foot</footer></body>", f"{LONG.strip()}\n\n{LONG.strip()}"),
        (f"<div><p>{LONG}</p><p>{LONG}</p></div><form><p>Leave a reply, dear reader.</p><label>Name</label></form>", f"{LONG.strip()}\n\n{LONG.strip()}"),
        (f"<html><head><title>x</title><body><article><p>{LONG}</p></article>", LONG.strip()),
        (f"<html><head><title>x</title><meta name=a><article><p>{LONG}</p></article>", LONG.strip()),
        (f"<html><head><title>x</title>{LONG}<p>{LONG}</p>", f"{LONG.strip()}\n\n{LONG.strip()}"),
        (f"<article><p>{LONG}</p><table><tr class=header><td>Year</td></tr><tr><td>1999</td></tr></table></article>", f"{LONG.strip()}\n\nYear\n\n1999"),
        (f"<article><div class=section-header><h2>Method</h2></div><p>{LONG}</p></article>", f"Method\n\n{LONG.strip()}"),
        (f"<article><p>The <span class=tooltip>entropy</span> rises. {LONG}</p></article>", f"The entropy rises. {LONG.strip()}"),
        (f"<main><header><h1>Title</h1></header><p>{LONG}</p></main>", f"Title\n\n{LONG.strip()}"),
        (f"<article><p class=extra>More.</p><p>{LONG}</p><figure class=banner><figcaption>Fig. 1</figcaption></figure></article>", f"More.\n\n{LONG.strip()}\n\nFig. 1"),
    ],
)
def test_no_page_is_lost_to_a_form_a_head_or_a_name(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("change", [
    lambda page: page.replace("</head>", ""),
    lambda page: re.sub(r"(<body[^>]*>)", r"\1<form id=aspnetForm method=post>", page).replace("</body>", "</form></body>"),
    lambda page: page.replace("<article>", "<div>").replace("</article>", "</div>"),
    lambda page: re.sub("</?body[^>]*>", "", page.replace("</head>", "")),
])
def test_pages_read_alike_however_they_are_wrapped(change):
    pages = pd.read_parquet(f"{SMALL}/pages.parquet").html
    assert sum(change(page) != page for page in pages) > 0.5 * len(pages)
    for page in pages:
        assert main_text(change(page)) == main_text(page)
