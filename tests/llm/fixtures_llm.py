"""Small tables with everything that may go wrong in them."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside.
CLASHING = {"size": "7", "kept": "'x'", "g": "1", "key": "'k'", "rank": "0", "shard": "3", "print": "9", "length": "1"}


def prose(seed: int, words: int, letters: str = "abcdefgh") -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 8))) for _ in range(words))


def odd_rows() -> list[tuple]:
    base = prose(1, 400)
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \t\n\r ", None, "a", 5),
        (4, base, "en", None, None),
        (5, base, "en", "a", 1),
        (6, base + " tail", "fr", "b", 1),
        (None, base[:1500], None, None, None),
        (7, "1234 5678 %%% ###", "en", "b", 3),
        (8, "Ünïcödé <|endoftext|> 日本語 😀 " + prose(2, 60, "äöüß"), "de", "b", 3),
        (9, "x" * 5000, "en", "b", 1),
        (10, prose(3, 100) + "\n" + prose(3, 100) + "\n\n" + prose(4, 3) + "  end ", "en", "c", 1),
        (11, prose(5, 30_000), "en", "c", 1),
        (12, "a", "fr", "c", 1),
        (12, "a", "fr", "c", 1),
        (13, "same id", "en", "c", 1),
        (13, "other text " + prose(6, 80), "en", "d", 1),
    ]
    return rows + [(100 + i, prose(100 + i, 70), ("en", "fr", "de")[i % 3], "hot" if i % 3 else f"s{i}", 1) for i in range(60)]


def write_tables(spark: SparkSession, folder: str, rows: list[tuple] | None) -> str:
    """The synthetic tables in `folder`; with None, empty ones. Columns with clashing names are added."""
    documents = spark.createDataFrame(rows or [], DOCUMENTS)
    clashing(documents).repartition(3).write.parquet(f"{folder}/documents.parquet")
    vectors = [] if rows is None else odd_vectors()
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").write.parquet(
        f"{folder}/embeddings.parquet"
    )
    pages = [] if rows is None else [(1, "u", None), (2, None, ""), (None, "v", "<p>One, two.</p>"), (None, "v", "<p>One, two.</p>")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
    rows = [] if rows is None else odd_conversations()
    conversations = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    conversations.selectExpr("*", "1 AS copies", "'x' AS part", "2 AS units").write.parquet(f"{folder}/conversations.parquet")
    return folder


def odd_conversations() -> list[tuple]:
    rnd = random.Random(12)
    texts = [None, "", " \t\n", "Yes.", "No", "What?\n", "Go! \u2028", "a.b!c?", "Ü😀.", "Yes."]
    roles = [None, "", "user", "assistant", "system", "tool", "User", "unknown", "user", "assistant"]
    rows = []
    for conv in [None, *range(400)]:
        turn = rnd.choice([0, 3, None])
        for _ in range(rnd.choice([1, 1, 2, 3, 5, 8, 12])):
            rows.append((conv, turn, rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.5 else f"text {rnd.random()}."))
            if turn is not None:
                turn = rnd.choice([None, turn, turn + 1, turn + 1, turn + 1, turn + 4])
    rows += [(7000, t, ("user", "assistant")[t % 2], f"word {t}" + "." * (t % 3)) for t in range(300)]
    rows += [(8000, 5, "user", "again.")] * 200 + [(8000, None, "user", "again.")] * 40
    return rows


def clashing(df: DataFrame) -> DataFrame:
    return df.selectExpr("*", *[f"{value} AS {name}" for name, value in CLASHING.items()])


def odd_vectors() -> list[tuple]:
    rnd = random.Random(3)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [rnd.gauss(0, 1) for _ in range(8)], 0) for i in range(1, 400)]
    hot = [float(x) for x in range(1, 9)]
    rows += [(i, hot, None) for i in range(400, 600)]
    bad = [None, [], [0.0] * 8, [nan] + [1.0] * 7, [inf] + [1.0] * 7, [None] + [1.0] * 7, [1.0, 2.0]]
    rows += [(1000 + i, v, 1) for i, v in enumerate(bad)]
    return rows + [(None, hot, 1), (300, rows[299][1], 2), (0, hot, 0)]
