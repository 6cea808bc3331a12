"""Repair of conversation structure at least cost, decided by integer minima alone.

A path through a conversation is one integer. Its high digits are the cost; below them every row has a slot
of two digits, the letters of its edits with zeros at the end (`D`, `K`, `R`, or an insertion before one of the
latter two), and a last slot holds insertions at the end. Digits rise with the letters' ASCII order, and a
slot's letters end in the one letter that is not an insertion, so the least integer is the least cost and,
among equal costs, the ASCII-least audit.

Rows that have to go cost the same on every path and an insertion before a deletion may as well follow it,
which is ASCII-less; so such rows have no slot, and their `D`s are put back between the slots.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import store

_SPACE = " \t\n\x0b\x0c\r"
_USER, _ASSISTANT = "user", "assistant"

#: States of `(s?(ua)+)?`: nothing yet, after s, after u, after a. Fixed values of the contract.
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_WANTED = {0: "u", 1: "u", 2: "a", 3: "u"}
_STATES = (0, 1, 2, 3)
_LEGAL = {"su", "ua", "au"}
_RENAME, _DELETE, _INSERT, _UNFINISHED = 2, 3, 2, 1

#: Digits of letters, in ASCII order; 0 ends a slot. Three bits a digit, two digits a slot.
_DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
_SLOT = 6
_TEXT = {(_DIGIT[x[0]] << 3) + (_DIGIT[x[1]] if len(x) > 1 else 0): x for x in ("D", "K", "R", "I", "IK", "IR", "II")} | {0: ""}
_CODE = {x: n for n, x in _TEXT.items()}


def _options() -> dict[tuple[int, str, bool], list[tuple[int, int, int]]]:
    """(state, role initial, unfinished) -> (next state, cost, slot) of every edit of a row that may stay."""
    found = {}
    for state in _STATES:
        opened = _STEP[state, _WANTED[state]]
        for initial in "sua-":
            for unfinished in (False, True):
                edits = [(state, _DELETE, _CODE["D"])]
                for before, cost, mark in ((state, 0, ""), (opened, _INSERT, "I")):
                    if (before, initial) in _STEP:
                        edits.append((_STEP[before, initial], cost + unfinished, _CODE[mark + "K"]))
                    renamed = _STEP[before, _WANTED[before]]
                    edits.append((renamed, cost + _RENAME + unfinished, _CODE[mark + "R"]))
                found[state, initial, unfinished] = edits
    return found


_OPTIONS = _options()
#: What completes a sequence from each state.
_CLOSING = {0: (0, ""), 1: (2 * _INSERT, "II"), 2: (_INSERT, "I"), 3: (0, "")}


def cheapest(rows: tuple[tuple[str, bool], ...], first: int = 0) -> dict[int, int]:
    """Last state -> least path over rows (role initial, unfinished) from state `first`, as an integer.

    Insertions at the end are left to the caller. Equal costs never make one audit a prefix of another, as
    insertions cost something; so least paths of parts make least paths of the whole.
    """
    n = len(rows)
    top = _SLOT * n
    least = {first: 0}
    for i, (initial, unfinished) in enumerate(rows):
        at = _SLOT * (n - 1 - i)
        reached: dict[int, int] = {}
        for state, weight in least.items():
            for after, cost, code in _OPTIONS[state, initial, unfinished]:
                path = weight + (cost << top) + (code << at)
                if after not in reached or path < reached[after]:
                    reached[after] = path
        least = reached
    return least


def closed(ends: dict[int, int], n: int) -> tuple[int, int]:
    """(last state before closing, least closed path) of paths over n rows; closing is one slot more."""
    weights = {q: (w << _SLOT) + (_CLOSING[q][0] << _SLOT * (n + 1)) + _CODE[_CLOSING[q][1]] for q, w in ends.items()}
    last = min(weights, key=weights.__getitem__)
    return last, weights[last]


def slots_of(path: int, n: int) -> list[str]:
    return [_TEXT[path >> _SLOT * (n - 1 - i) & 63] for i in range(n)]


class Paths:
    """`cheapest` with a bounded memory: conversations of one shape are solved once per worker."""

    def __init__(self, kept: int = 20_000, longest: int = 64):
        self.kept, self.longest, self.known = kept, longest, {}

    def __call__(self, rows: tuple, first: int = 0) -> dict[int, int]:
        if len(rows) > self.longest:
            return cheapest(rows, first)
        if (rows, first) not in self.known:
            if len(self.known) >= self.kept:
                self.known = {}
            self.known[rows, first] = cheapest(rows, first)
        return self.known[rows, first]


def _initial(role: str) -> str:
    return role[0] if role[:1] in ("s", "u", "a") else "-"


def _unfinished(stripped: str) -> bool:
    return stripped[-1] not in ".!?"


def _render(units: list[tuple], slots: list[str], state: int, closing: str) -> tuple[str, list[dict[str, str]]]:
    """Audit and repaired rows of units (role, text, copies, stays) whose staying rows have these slots."""
    audit, repaired, found = [], [], iter(slots)

    def put(letter: str, role: str = "", text: str = "") -> None:
        nonlocal state
        if letter == "D":
            return
        role = role if letter == "K" else _USER if _WANTED[state] == "u" else _ASSISTANT
        repaired.append({"role": role, "text": "" if letter == "I" else text})
        state = _STEP[state, role[0]]

    for role, text, copies, stays in units:
        letters = next(found) if stays else ""
        for letter in letters:
            put(letter, role, text)
        audit.append(letters + "D" * (copies - stays))
    for letter in closing:
        put(letter)
    return "".join(audit) + closing, repaired


class _Facts:
    """Counts over consecutive units in order; two neighbours can be joined."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn: int | None, role: str, stripped: str, copies: int, first_seen: bool) -> bool:
        """Count a unit of equal rows; whether its first row may stay."""
        if turn is not None and turn != self.high:
            self.distinct += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        initial = role[:1]
        if self.last is not None:
            self.illegal += self.last + initial not in _LEGAL
        else:
            self.first = initial
        self.illegal += copies - 1  # a role beside itself
        self.last = initial
        stays = bool(stripped) and first_seen
        if not stripped:
            self.blank += copies
        else:
            self.duplicate += copies - stays
            self.truncated += stays and _unfinished(stripped)
        return stays

    def join(self, other: "_Facts") -> None:
        """Append what follows."""
        if self.last is not None and other.first is not None:
            self.illegal += self.last + other.first not in _LEGAL
        self.illegal += other.illegal
        self.distinct += other.distinct - (self.high is not None and self.high == other.low)
        self.blank += other.blank
        self.duplicate += other.duplicate
        self.truncated += other.truncated
        self.first = other.first if self.first is None else self.first
        self.last = other.last if other.last is not None else self.last
        self.low = other.low if self.low is None else self.low
        self.high = other.high if other.high is not None else self.high

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct


    def as_row(self) -> dict:
        return {c: getattr(self, c) for c in _FACTS}

    @classmethod
    def of_row(cls, row: dict) -> "_Facts":
        facts = cls()
        for c in _FACTS:
            setattr(facts, c, row[c])
        return facts


_FACTS = ("blank", "duplicate", "truncated", "illegal", "distinct", "low", "high", "first", "last")
_FACTS_TYPE = f"struct<{','.join(f'{c}:bigint' for c in _FACTS[:7])},first:string,last:string>"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_COUNTS_TYPE = ", ".join(f"{c} bigint" for c in _COUNTS)
_REPAIRED = "repaired array<struct<role:string,text:string>>"
_UNITS = "units array<struct<role:string,text:string,copies:bigint,stays:boolean>>"


def _counts(facts: _Facts, cost: int) -> tuple[int, ...]:
    return facts.gaps(), facts.blank, facts.duplicate, facts.truncated, facts.illegal, cost


def _free(units: list[tuple]) -> tuple[tuple[str, bool], ...]:
    return tuple((_initial(role), _unfinished(text.rstrip(_SPACE))) for role, text, _, stays in units if stays)


def _forced(units: list[tuple]) -> int:
    return _DELETE * sum(copies - stays for _, _, copies, stays in units)


def _mapped(df: DataFrame, function, kinds: str) -> DataFrame:
    """`mapInArrow` of a function from an iterator of rows (tuples) to an iterator of rows; conv_id comes first."""
    schema = T.StructType([df.schema["conv_id"], *T._parse_datatype_string(kinds).fields])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema)
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        found = function(rows)
        while held := list(itertools.islice(found, 256)):
            columns = [pa.array([row[i] for row in held], field.type) for i, field in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, schema=types)

    return df.mapInArrow(run, schema)


def _by_conversation(rows: Iterator[tuple]) -> Iterator[tuple]:
    return itertools.groupby(rows, key=lambda row: row[0])


def _short(rows: DataFrame) -> DataFrame:
    """Verdict and repaired rows of conversations that each fit a task, one row per conversation."""

    def solve(found):
        paths = Paths()
        for conv, group in _by_conversation(found):
            facts, seen, units = _Facts(), set(), []
            for _, turn, role, text, copies in group:
                stays = facts.add(turn, role, text.rstrip(_SPACE), copies, (role, text) not in seen)
                seen.add((role, text))
                units.append((role, text, copies, stays))
            free = _free(units)
            _, path = closed(paths(free), len(free))
            *slots, closing = slots_of(path, len(free) + 1)
            audit, repaired = _render(units, slots, 0, closing)
            cost = (path >> _SLOT * (len(free) + 1)) + _forced(units)
            yield conv, *_counts(facts, cost), audit, repaired

    columns = rows.select("conv_id", "turn", "role", "text", "copies")
    ordered = columns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return _mapped(ordered, solve, f"{_COUNTS_TYPE}, audit string, {_REPAIRED}")


def _blocks(rows: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """Stored pieces of long conversations in order (conv_id, part, no), each of bounded size: units, facts.

    Equal rows become one unit first, wherever they are; a role and text counts as seen if an earlier turn
    has it. Then rows are dealt by ranges of (conv_id, turn, role, text), so a conversation of any size
    spreads over tasks. Only beginnings of role and text take part in the ranges, which the driver samples.
    """
    key = ["conv_id", "turn", "role", "text"]
    units = store(rows.groupBy(*key).agg(F.sum("copies").alias("copies")), "units")
    firsts = units.groupBy("conv_id", "role", "text").agg(F.min(F.struct("turn")).alias("_first"))
    firsts = firsts.select(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "text")], F.col("_first.turn").alias("_turn"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    marked = units.join(firsts.withColumn("_seen", F.lit(True)), same, "left")
    begin = [F.substring("role", 1, 32), F.substring("text", 1, 64)]
    dealt = marked.repartitionByRange("conv_id", "turn", *begin).sortWithinPartitions(*key)

    def gather(found):
        for conv, group in _by_conversation(found):
            no, facts, units, size = 0, _Facts(), [], 0
            for _, turn, role, text, copies, first, part in group:
                if len(units) >= most_rows or size >= most_bytes:
                    yield conv, part, no, _as_units(units), facts.as_row()
                    no, facts, units, size = no + 1, _Facts(), [], 0
                units.append((role, text, copies, facts.add(turn, role, text.rstrip(_SPACE), copies, first)))
                size += len(role) + len(text)
            yield conv, part, no, _as_units(units), facts.as_row()

    columns = dealt.select(*key, "copies", F.col("_seen").isNotNull().alias("first"), F.spark_partition_id().alias("part"))
    return store(_mapped(columns, gather, f"part int, no bigint, {_UNITS}, facts {_FACTS_TYPE}"), "blocks")


def _as_units(units: list[tuple]) -> list[dict]:
    return [dict(zip(("role", "text", "copies", "stays"), u)) for u in units]


def _long(rows: DataFrame, most_rows: int, most_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(counts and chosen states, repaired pieces) of long conversations.

    Least paths through every piece from each state are found piece by piece; one integer per pair of states
    is chained along a conversation, which needs no text; then every piece is written out from its state.
    """
    blocks = _blocks(rows, most_rows, most_bytes)

    def through(found):
        for conv, part, no, units, facts in found:
            units = [tuple(u.values()) for u in units]
            free = _free(units)
            ways = []
            for first in _STATES:
                for last, path in cheapest(free, first).items():
                    ways.append({"first": first, "last": last, "path": path.to_bytes(path.bit_length() // 8 + 1, "big")})
            yield conv, part, no, facts, len(free), _forced(units), ways

    ways = "array<struct<first:int,last:int,path:binary>>"
    kinds = f"part int, no bigint, facts {_FACTS_TYPE}, free bigint, forced bigint, ways {ways}"
    narrow = _mapped(blocks, through, kinds)

    def chain(found):
        for conv, group in _by_conversation(found):
            facts, least, n, forced, places, back = _Facts(), {0: 0}, 0, 0, [], []
            for _, part, no, more, free, must, ways in group:
                facts.join(_Facts.of_row(more))
                reached, came = {}, {}
                low = (1 << _SLOT * free) - 1
                for way in ways:
                    first, last, path = way.values()
                    if first not in least:
                        continue
                    path = int.from_bytes(path, "big")
                    # costs add up, slots follow each other
                    whole = (least[first] << _SLOT * free) + (path >> _SLOT * free << _SLOT * (n + free)) + (path & low)
                    if last not in reached or whole < reached[last]:
                        reached[last], came[last] = whole, first
                least, n, forced = reached, n + free, forced + must
                places.append((part, no))
                back.append(came)
            state, path = closed(least, n)
            closing, chosen = _CLOSING[state][1], []
            for (part, no), came in zip(reversed(places), reversed(back)):
                chosen.append({"part": part, "no": no, "first": came[state], "last": state, "closing": closing})
                state, closing = came[state], ""
            yield conv, *_counts(facts, (path >> _SLOT * (n + 1)) + forced), chosen

    chosen = "chosen array<struct<part:int,no:bigint,first:int,last:int,closing:string>>"
    ordered = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    counts = store(_mapped(ordered, chain, f"{_COUNTS_TYPE}, {chosen}"), "chained")

    picks = counts.select(F.col("conv_id").alias("_conv_id"), F.explode("chosen").alias("_c"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("part") == F.col("_c.part")) & (F.col("no") == F.col("_c.no"))
    joined = blocks.join(picks, same).select("conv_id", "part", "no", "units", "_c.first", "_c.last", "_c.closing")

    def write(found):
        for conv, part, no, units, first, last, closing in found:
            units = [tuple(u.values()) for u in units]
            free = _free(units)
            audit, repaired = _render(units, slots_of(cheapest(free, first)[last], len(free)), first, closing)
            yield conv, part, no, audit, repaired

    pieces = store(_mapped(joined, write, f"part int, no bigint, audit string, {_REPAIRED}"), "written")
    return counts.drop("chosen"), pieces


def _line(row: Column) -> Column:
    return F.concat(row["role"], F.lit(":"), row["text"])


def _split(rows: DataFrame, long_rows: int, long_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of conversations that fit a task, rows of the others or None)."""
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("_n"), F.sum(F.octet_length("text")).alias("_b"))
    longer = store(sizes.where((F.col("_n") > long_rows) | (F.col("_b") > long_bytes)).select(F.col("conv_id").alias("_long")), "long")
    if longer.isEmpty():
        return rows, None
    same = F.col("conv_id").eqNullSafe(F.col("_long"))
    return rows.join(longer, same, "left_anti"), rows.join(longer, same, "left_semi")


def repair(rows: DataFrame, long_rows: int = 4096, long_bytes: int = 16 << 20) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    `rows` has conv_id, turn (bigint), role, text, neither of the latter NULL, and copies, how often the row
    stands there; other columns are ignored. Rows go by turn (NULL first), ties by role, then text; equal
    rows are duplicates of the first. A NULL conv_id is a conversation of its own. An empty role has no
    initial and cannot be kept. The empty table gives no rows. `repaired_rows` gives the rows themselves.

    A conversation of over `long_rows` rows or `long_bytes` bytes is cut into pieces of at most a quarter of
    that, solved apart and chained; the result is the same. Its audit, and the sum over its whole text, which
    is taken in order as the pieces stream by, are then all that one task sees of it at once.
    """
    short, long = _split(rows, long_rows, long_bytes)
    columns = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    sha = F.sha2(F.array_join(F.transform("repaired", _line), "\n"), 256)
    found = _short(short).withColumn("repaired_sha256", sha).select(*columns)
    if long is None:
        return found
    counts, pieces = _long(long, max(1, long_rows // 4), max(1, long_bytes // 4))

    def digest(rows):
        for conv, group in _by_conversation(rows):
            audit, digest, first = [], hashlib.sha256(), True
            for _, _, _, letters, text, some in group:
                audit.append(letters)
                if some:
                    digest.update(("" if first else "\n").encode() + text.encode())
                    first = False
            yield conv, "".join(audit), digest.hexdigest()

    lines = pieces.select(
        "conv_id", "part", "no", "audit", F.array_join(F.transform("repaired", _line), "\n").alias("text"), (F.size("repaired") > 0).alias("some")
    )
    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")
    sums = _mapped(ordered, digest, "audit string, repaired_sha256 string").withColumnRenamed("conv_id", "_conv_id")
    whole = counts.join(sums, F.col("conv_id").eqNullSafe(F.col("_conv_id"))).select(*columns)
    return found.unionAll(whole)


def repaired_rows(rows: DataFrame, long_rows: int = 4096, long_bytes: int = 16 << 20) -> DataFrame:
    """conv_id, part, no, place, role, text of every row after the repair; part, no and place give the order."""
    short, long = _split(rows, long_rows, long_bytes)
    found = _short(short).select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("no"), "repaired")
    if long is not None:
        found = found.unionAll(_long(long, max(1, long_rows // 4), max(1, long_bytes // 4))[1].drop("audit"))
    return found.select("conv_id", "part", "no", F.posexplode("repaired").alias("place", "row")).select(
        "conv_id", "part", "no", "place", "row.role", "row.text"
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies after damage by crc32(`conv_id:turn`) % 20; NULLs count as one space.

    0 drops the row, 1 empties the text, 2 takes `.`, `!` and `?` out of it, 3 repeats the row, 4 makes it a user's.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    role = F.when(fault == 4, _USER).otherwise(filled("role"))
    text = F.when(fault == 1, "").when(fault == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text"))
    copies = F.when(fault == 3, 2).otherwise(1).cast("long")
    return conversations.where(fault != 0).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies")
    )


def repair_damaged(conversations: DataFrame, **limits: int) -> DataFrame:
    """The verdicts of `repair` on damaged rows for every conv_id of the table, also where no row is left."""
    found = repair(damaged(conversations), **limits).withColumnRenamed("conv_id", "_conv_id")
    ids = conversations.select("conv_id").distinct()
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left")
    empty = hashlib.sha256().hexdigest()
    return joined.select(
        "conv_id",
        *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in _COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )
