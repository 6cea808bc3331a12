"""Quality rules with limits learned per language and source from mergeable quantile sketches.

Only DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import store, words

#: Per measure: the smallest spread (in thousandths) that a group is given. A group whose values are
#: all alike would otherwise reject everything that differs at all.
SPREADS = {"symbols": 250, "dup_lines": 150, "repeat_words": 100, "word_length": 500}
#: Measures of which small values are suspicious too.
TWO_SIDED = ("word_length",)
REACH = 3
LEAST_ROWS = 30
_BITS = 7


def base_counts(docs: DataFrame, text: str = "text", hash_bits: int = 64) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words to each row.

    NULL and empty texts count zero everywhere. Windows of three words are found again by sorting
    one number per window, hash above position, inside the row: nothing is unfolded or shuffled.
    Neighbours with equal hashes are compared word by word. In a text where two of them differ, as the
    hash keeps fewer bits the longer the text is, the windows themselves are sorted instead.
    """
    df = docs.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumn("_w", words(F.col("_text")))
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    df = df.withColumn("_shift", F.length(F.bin("n_words")))
    window = f"shiftright(xxhash64(_w[i], _w[i + 1], _w[i + 2]), {64 - hash_bits})"
    keys = f"transform(sequence(0, n_words - 3), i -> shiftleft({window}, _shift) | i)"
    df = df.withColumn("_keys", F.expr(f"IF(n_words > 3, sort_array({keys}), CAST(array() AS array<bigint>))"))
    at = "CAST({} & (shiftleft(1L, _shift) - 1) AS int)".format
    hashes = "shiftright({0}, _shift) = shiftright({1}, _shift)".format
    same = "(_w[{0}] = _w[{1}] AND _w[{0} + 1] = _w[{1} + 1] AND _w[{0} + 2] = _w[{1} + 2])".format
    before = f"{hashes('_keys[j - 1]', 'k')} AND {same(at('_keys[j - 1]'), at('k'))}"
    after = f"{hashes('_keys[j + 1]', 'k')} AND {same(at('_keys[j + 1]'), at('k'))}"
    found = f"filter(_keys, (k, j) -> (j > 0 AND {before}) OR (j < size(_keys) - 1 AND {after}))"
    clash = f"j > 0 AND {hashes('_keys[j - 1]', 'k')} AND NOT {same(at('_keys[j - 1]'), at('k'))}"
    df = df.withColumn("_clash", F.expr(f"size(filter(_keys, (k, j) -> {clash})) > 0"))
    whole = "sort_array(transform(sequence(0, n_words - 3), i -> struct(_w[i] AS a, _w[i + 1] AS b, _w[i + 2] AS c, CAST(i AS int) AS i)))"
    df = df.withColumn("_whole", F.expr(f"IF(_clash, {whole}, NULL)"))
    beside = "(k.a = _whole[{0}].a AND k.b = _whole[{0}].b AND k.c = _whole[{0}].c)".format
    exact = f"filter(_whole, (k, j) -> (j > 0 AND {beside('j - 1')}) OR (j < size(_whole) - 1 AND {beside('j + 1')}))"
    pos = f"IF(_clash, transform({exact}, k -> k.i), transform({found}, k -> {at('k')}))"
    df = df.withColumn("_pos", F.expr(f"sort_array({pos})"))
    covered = "aggregate(transform(_pos, (p, j) -> IF(j = 0, 3, least(3, p - _pos[j - 1]))), 0, (a, x) -> a + x)"
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_lines", lines)
    return df.withColumns(
        {
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_repeat_words": F.expr(covered).cast("long"),
        }
    ).drop("_text", "_w", "_shift", "_keys", "_clash", "_whole", "_pos", "_lines")


def base_failed() -> Column:
    """Fixed values of the contract."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measures() -> dict[str, Column]:
    """Whole thousandths, so that sketches of any order and engine agree."""

    def per(a: str, b: str) -> Column:
        return F.expr(f"1000 * {a} div greatest({b}, 1)")

    return {
        "symbols": per("n_symbols", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeat_words": per("n_repeat_words", "n_words"),
        "word_length": per("word_chars", "n_words"),
    }


def sketch(rows: DataFrame, groups: list[str], values: dict[str, Column]) -> DataFrame:
    """A quantile sketch per group and measure: counts of value buckets below 1 % wide.

    Buckets keep the leading bits of a value. Two sketches merge by adding counts, in any order,
    and at most some 400 buckets exist per group and measure whatever the input size.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("value")) for k, v in values.items()])
    low = F.expr(f"greatest(length(bin(value)) - {_BITS + 1}, 0)")
    long = rows.select(*groups, F.inline(pairs)).withColumn("_low", low)
    bucket = F.expr("shiftleft(shiftright(value, _low), _low)").alias("bucket")
    return long.groupBy(*groups, "measure", bucket).agg(F.count("*").alias("n"))


def limits(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """One row per group: `rows` and an upper (and lower) limit per measure, REACH spreads beyond the quartiles."""
    by = Window.partitionBy(*groups, "measure")
    ranked = sketches.withColumns({"_cum": F.sum("n").over(by.orderBy("bucket")), "_all": F.sum("n").over(by)})
    quarters = ranked.groupBy(*groups, "measure").agg(
        F.max("_all").alias("rows"),
        F.min(F.when(4 * F.col("_cum") >= F.col("_all"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("_cum") >= 3 * F.col("_all"), F.col("bucket"))).alias("q3"),
    )
    floor = F.create_map(*[F.lit(x) for pair in SPREADS.items() for x in pair])[F.col("measure")]
    spread = F.greatest(F.col("q3") - F.col("q1"), floor)
    quarters = quarters.withColumns({"top": F.col("q3") + REACH * spread, "bottom": F.col("q1") - REACH * spread})
    of = lambda name, side: F.max(F.when(F.col("measure") == name, F.col(side)))
    return quarters.groupBy(*groups).agg(
        F.max("rows").alias("rows"),
        *[of(m, "top").alias(f"{m}_top") for m in SPREADS],
        *[of(m, "bottom").alias(f"{m}_bottom") for m in TWO_SIDED],
    )


def apply_rules(docs: DataFrame, id_column: str = "doc_id", salts: int = 32) -> DataFrame:
    """One row per input row: id, base counts, base_failed, kept.

    The sketches see the rows that pass the base rules. A row is kept if it passes them and none
    of its measures lies outside its group's limits; groups are (lang, source), NULL being a value
    of its own. A group of fewer than LEAST_ROWS rows uses the merged sketch of its language.
    Empty tables give no rows; repeated rows are judged alike; other columns are ignored.
    The limits are joined on (lang, source, salt), so a source with a third of the rows is dealt
    over `salts` tasks; the limit rows are copied that often.
    """
    counted = base_counts(docs.select(id_column, "text", "lang", "source")).drop("text")
    counted = store(counted.withColumn("base_failed", base_failed()), "quality")
    values = measures()
    sketches = store(sketch(counted.where(~F.col("base_failed")), ["lang", "source"], values), "sketches")
    own = limits(sketches, ["lang", "source"])
    merged = sketches.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    wide = limits(merged, ["lang"]).withColumnRenamed("lang", "_lang").drop("rows")
    names = [c for c in wide.columns if c != "_lang"]
    both = own.join(wide.select("_lang", *[F.col(c).alias(f"_{c}") for c in names]), own.lang.eqNullSafe(F.col("_lang")))
    small = F.col("rows") < LEAST_ROWS
    table = both.select(
        F.col("lang").alias("_l"),
        F.col("source").alias("_s"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt_of"),
        *[F.when(small, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in names],
    )
    salted = counted.withColumn("_salt", F.pmod(F.xxhash64(id_column), F.lit(salts)).cast("int"))
    joined = salted.join(
        table,
        salted.lang.eqNullSafe(table._l) & salted.source.eqNullSafe(table._s) & (F.col("_salt") == F.col("_salt_of")),
        "left",
    )
    fine = F.lit(True)
    for name, value in values.items():
        fine = fine & (value <= F.col(f"{name}_top"))
        if name in TWO_SIDED:
            fine = fine & (value >= F.col(f"{name}_bottom"))
    kept = ~F.col("base_failed") & F.coalesce(fine, F.lit(False))
    return joined.select(
        id_column, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept")
    )
