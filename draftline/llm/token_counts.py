"""Token counts of a unigram vocabulary, found once per shared prefix in a trie of pre-tokens."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, functions as F, types as T

from .common import in_batches

_SPACE = "▁"
_LONG = 48


class TrieCounter:
    """Best-path token counts of pre-tokens.

    The trie has one node per different prefix of a pre-token, with the forward score of the best
    segmentation that ends there; a prefix shared by many pre-tokens is scored once. The node that
    ends a pre-token stores its count. A character that no piece covers costs `unknown` and counts
    as its UTF-8 bytes. Pre-tokens of over 48 characters are scored outside the trie, which is
    emptied when it holds `nodes` nodes; counts of pre-tokens outlive it in two generations of at
    most `words` each. So memory is bounded, and none of this changes a count.
    """

    def __init__(self, scores: dict[str, float], nodes: int = 1_000_000, words: int = 400_000):
        self.scores, self.most, self.words = scores, nodes, words
        self.counts, self.old = {}, {}
        self.reach = max(map(len, scores))
        #: Pieces from their last character to their first, as (score if a piece starts here, next characters).
        self.ends: dict[str, tuple] = {}
        for piece, score in scores.items():
            children = self.ends
            for letter in piece[:0:-1]:
                children = children.setdefault(letter, (None, {}))[1]
            children[piece[0]] = score, children.get(piece[0], (None, {}))[1]
        self.unknown = min(scores.values()) - 10.0
        self._clear()

    def _clear(self) -> None:
        #: Nodes are numbers, the root is 0: the node that follows (node, code point), and (score, tokens) of each.
        #: Plain numbers, as a million objects that refer to others keep the garbage collector busy.
        self.after, self.ways, self.size = {}, [(0.0, 0)], 0

    def _step(self, text: str, end: int, path: list[tuple] | dict[int, tuple]) -> tuple[float, int]:
        """Score and tokens of text[:end]; path[i] has those of text[:i]."""
        children, start, best, n = self.ends, end, None, 0
        while start and (found := children.get(text[start - 1])):
            start -= 1
            score, children = found
            if score is not None:
                before, tokens = path[start]
                score += before
                if best is None or score >= best:  # the longest of equal ways
                    best, n = score, tokens + 1
        if text[end - 1] not in self.scores:
            score = path[end - 1][0] + self.unknown
            if best is None or score > best:
                best, n = score, path[end - 1][1] + len(text[end - 1].encode("utf-8", "surrogatepass"))
        return best, n

    def count(self, word: str) -> int:
        found = self.counts.get(word)
        if found is not None:
            return found
        found = self.old.get(word)
        if found is None:
            found = self._find(word)
        if len(word) <= _LONG:
            self.counts[word] = found
            if len(self.counts) > self.words:
                self.counts, self.old = {}, self.counts
        return found

    def _find(self, word: str) -> int:
        text = _SPACE + word
        if len(word) > _LONG:
            # only the last `reach` prefixes matter to the next one
            path = {0: (0.0, 0)}
            for end in range(1, len(text) + 1):
                path[end] = self._step(text, end, path)
                path.pop(end - self.reach, None)
            return path[len(text)][1]
        if self.size > self.most:
            self._clear()
        after, ways, node, path = self.after, self.ways, 0, [(0.0, 0)]
        for end, letter in enumerate(text, 1):
            place = node << 21 | ord(letter)
            node = after.get(place)
            if node is None:
                node = after[place] = len(ways)
                ways.append(self._step(text, end, path))
                self.size += 1
            path.append(ways[node])
        return path[-1][1]


def _pieces(library) -> dict[str, int]:
    """Pieces of a vocabulary that stand for text, with their ids: no control, unknown or byte pieces."""
    skipped = (library.is_control, library.is_unknown, library.is_byte)
    ids = [i for i in range(library.get_piece_size()) if not any(is_kind(i) for is_kind in skipped)]
    return {library.id_to_piece(i): i for i in ids}


def piece_counts(docs: DataFrame, model: str, words: int = 200_000) -> DataFrame:
    """piece (its id) and n: how often the public tokenizer at `model` cuts each piece out of the words of all texts.

    Words are counted before they are cut, `words` different ones at a time, so a word costs one cut however
    often it stands there. A task hands on at most one row per piece.
    """

    def run(batches):
        from itertools import chain

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model)
        totals, counts = np.zeros(library.get_piece_size(), np.int64), {}

        def cut():
            found = library.encode(list(counts), num_threads=1)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
            np.add.at(totals, ids, np.repeat(np.fromiter(counts.values(), np.int64, len(counts)), sizes))
            counts.clear()

        def one(batch):
            coded = pc.ascii_split_whitespace(pc.fill_null(batch.column(0), "")).flatten().dictionary_encode()
            times = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
            for word, n in zip(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), times.tolist()):
                if word:
                    counts[word] = counts.get(word, 0) + n
            if len(counts) > words:
                cut()
            return ()

        for _ in in_batches(one)(batches):
            pass
        if counts:
            cut()
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(totals[used])], ["piece", "n"])

    return docs.select("text").mapInArrow(run, "piece int, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))


def unigram_scores(docs: DataFrame, model: str) -> dict[str, float]:
    """Log probability of each piece of the public vocabulary at `model`, from its count in all of `docs`.

    One is added to every count, so pieces that never occur have a score, too, and an empty table makes all
    alike. The vocabulary stays as published; the driver receives one count per piece of it.
    """
    import sentencepiece

    pieces = _pieces(sentencepiece.SentencePieceProcessor(model_file=model))
    found = {r["piece"]: r["n"] for r in piece_counts(docs, model).collect()}
    counts = {piece: found.get(i, 0) + 1 for piece, i in pieces.items()}
    total = sum(counts.values())
    return {piece: math.log(n / total) for piece, n in counts.items()}


_counters: dict[str, TrieCounter] = {}


def _counter(scores: dict[str, float], key: str) -> TrieCounter:
    """The counter of this Python worker; one for other scores is given up."""
    if key not in _counters:
        _counters.clear()
        _counters[key] = TrieCounter(scores)
    return _counters[key]


def token_counts(docs: DataFrame, scores: dict[str, float]) -> DataFrame:
    """doc_id, n_words and n_tokens of every whole text, by the best path under `scores`.

    Words are cut at ASCII white space and take a leading space mark, so a text's count is the sum over
    its words. NULL, empty and blank texts count zero; repeated rows count alike; other columns are
    ignored. Each worker keeps a trie over its partitions: nothing is shuffled or sent to the driver.
    """
    key = hashlib.sha256(repr(sorted(scores.items())).encode()).hexdigest()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        counter = _counter(scores, key)

        def one(batch):
            lists = pc.ascii_split_whitespace(pc.fill_null(batch.column(1), ""))
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            coded = lists.flatten().dictionary_encode()
            different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            word = coded.indices.to_numpy(zero_copy_only=False)
            # leading and trailing white space yields empty strings, which are no words
            tokens = np.array([counter.count(w) if w else 0 for w in different], dtype=np.int64)[word]
            real = np.array([bool(w) for w in different], dtype=np.int64)[word]
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[at]) for x in (real, tokens)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums)], ["doc_id", "n_words", "n_tokens"])

        yield from in_batches(one)(batches)

    added = [T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]
    return docs.select("doc_id", F.col("text")).mapInArrow(run, T.StructType([docs.schema["doc_id"], *added]))
