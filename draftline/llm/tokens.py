"""Token ids of whole texts by a public tokenizer file, with a bounded cache of pieces."""

from __future__ import annotations

import os
import re

import numpy as np

#: A space between two characters that are not white space: no pre-token reaches across it.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Latin letters, which stay letters in lower case, and marks that never join them in one pre-token.
_LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
_MARKS = ".,;:!?%$#&*|"
_LONG = 64

_encoders: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, cached: int = 250_000) -> PieceEncoder:
    """The encoder of this Python worker; the file must lie at `path` on every machine."""
    if (path, cached) not in _encoders:
        _encoders[path, cached] = PieceEncoder(path, cached)
    return _encoders[path, cached]


class PieceEncoder:
    """Encodes texts as little-endian unsigned 32-bit ids, exactly as the library does on whole texts.

    Texts are cut at single spaces between words, where pre-tokens always end, and ids of pieces are
    kept. The cache has two generations of at most `cached` pieces of at most 64 characters, so its
    memory is bounded; a forgotten piece is encoded again.
    """

    def __init__(self, path: str, cached: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cached, self.young, self.old, self.tails = cached, {}, {}, {}
        self.lower = '"Lowercase"' in self.tokenizer.to_str()
        ends = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Which ids end a pre-token or, without a suffix for that, begin one after a space.
        self.marks, self.at_end = np.zeros(max(vocabulary.values()) + 1, dtype=bool), bool(ends)
        for token, i in vocabulary.items():
            self.marks[i] = token.endswith(ends) if ends else token.startswith("\u0120")

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _fill(self, pieces: list[str], plain: list[bool]) -> list[bytes]:
        """Ids of pieces, each with the space before it. Plain words are encoded a hundred to a text and
        told apart by the ids that end or begin a pre-token, which saves most of the calls' cost."""
        words = [p for p, simple in zip(pieces, plain) if simple]
        rest = iter(self._ids([" " + p for p, simple in zip(pieces, plain) if not simple]))
        ids = b"".join(self._ids([" " + " ".join(words[i : i + 100]) for i in range(0, len(words), 100)]))
        marks = np.flatnonzero(self.marks[np.frombuffer(ids, "<u4")])
        if len(marks) != len(words):
            raise ValueError("the tokenizer does not cut texts into words as expected")
        ends = (marks + 1 if self.at_end else np.append(marks[1:], len(ids) // 4)[: len(words)]) * 4
        starts = np.concatenate([[0], ends[:-1]])
        found = iter([ids[a:b] for a, b in zip(starts.tolist(), ends.tolist())])
        return [next(found) if simple else next(rest) for simple in plain]

    def _known(self, pieces: list[str], plain: np.ndarray) -> list[bytes]:
        """Ids of different pieces, from the cache where they are in it."""
        young, old = self.young, self.old
        found = list(map(young.get, pieces))
        missing = []
        for i, ids in enumerate(found):
            if ids is None:
                piece = pieces[i]
                ids = found[i] = old.get(piece)
                if ids is None:
                    missing.append(i)
                else:
                    young[piece] = ids
        if missing:
            for i, ids in zip(missing, self._fill([pieces[i] for i in missing], plain[missing].tolist())):
                found[i] = ids
                if len(pieces[i]) <= _LONG:
                    young[pieces[i]] = ids
            if len(young) > self.cached:
                self.old, self.young = young, {}
        return found

    def _of_tails(self, tails: list[str]) -> list[bytes]:
        if new := list(set(tails) - self.tails.keys()):
            if len(self.tails) > 100_000:
                self.tails, new = {}, list(set(tails))
            self.tails.update(zip(new, self._ids(new)))
        return [self.tails[t] for t in tails]

    def encode(self, texts, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an Arrow string column, one after the other, and where each text starts
        (and the last ends). Each text is followed by `end` if that is given; NULL is an empty text."""
        import pyarrow.compute as pc

        n = len(texts)
        texts = pc.fill_null(texts, "")
        lists = pc.split_pattern(texts, " ")
        at = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py() if n else np.zeros(1, np.int64)
        coded = lists.flatten().dictionary_encode()
        word, different = coded.indices.to_numpy(zero_copy_only=False).copy(), coded.dictionary
        pieces = different.to_numpy(zero_copy_only=False).tolist()
        # this cut is right unless other white space stands next to a space; such texts are cut with care
        trimmed = pc.utf8_trim_whitespace(different)
        odd = pc.or_(pc.not_equal(trimmed, different), pc.equal(trimmed, "")).to_numpy(zero_copy_only=False)
        seen = np.concatenate([[0], np.cumsum(odd[word])])
        careful = np.flatnonzero(seen[at[1:]] > seen[at[:-1]])
        # a word with marks at its end is two pre-tokens: words are looked up without them
        heads = pc.utf8_rtrim(different, _MARKS)
        heads = pc.if_else(pc.match_substring_regex(heads, _LETTERS), heads, different)
        marked = np.flatnonzero(pc.not_equal(heads, different).to_numpy(zero_copy_only=False))
        length = pc.utf8_length(heads).to_numpy(zero_copy_only=False)[marked].tolist()
        if self.lower:
            heads = pc.if_else(pc.match_substring_regex(heads, _LETTERS), pc.utf8_lower(heads), heads)
        heads = pc.if_else(odd, None, heads).dictionary_encode()
        plain = pc.match_substring_regex(heads.dictionary, _LETTERS).to_numpy(zero_copy_only=False)
        known = self._known(heads.dictionary.to_numpy(zero_copy_only=False).tolist(), plain)
        values = [known[i] if i >= 0 else b"" for i in pc.fill_null(heads.indices, -1).to_numpy(zero_copy_only=False).tolist()]
        tails = self._of_tails([pieces[i][n:] for i, n in zip(marked.tolist(), length)])
        for i, ids in zip(marked.tolist(), tails):
            values[i] += ids
        # a text's first piece has no space before it; a careful text stands in place of its first piece
        firsts = self._ids([pieces[i] for i in word[at[:-1]].tolist()])
        for i in careful.tolist():
            head, *rest = _CUT.split(texts[i].as_py())
            firsts[i] = b"".join(self._ids([head, *[" " + p for p in rest]]))
            word[at[i] : at[i + 1]] = len(values)
        word[at[:-1]] = len(values) + 1 + np.arange(n)
        values += [b"", *firsts]
        size = np.fromiter(map(len, values), np.int32, len(values)) // 4
        start = np.cumsum(size, dtype=np.int32) - size  # a batch has far fewer than 2**31 ids
        flat = np.frombuffer(b"".join(values), "<u4")
        per_word = size[word]
        ends = np.cumsum(per_word, dtype=np.int32)
        total = int(ends[-1]) if n else 0
        ids = flat[np.repeat(start[word] - ends + per_word, per_word) + np.arange(total, dtype=np.int32)]
        text_at = np.concatenate([[0], ends])[at].astype(np.int64)
        if end is None:
            return ids, text_at
        out = np.full(total + n, end, dtype="<u4")
        out[np.arange(total) + np.repeat(np.arange(n), np.diff(text_at))] = ids
        return out, text_at + np.arange(n + 1)
