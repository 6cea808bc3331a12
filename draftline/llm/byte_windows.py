"""Hashes of byte strings and content-defined anchors of fixed-length windows, with numpy."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Windows handled at once, so memory does not grow with a text.
CHUNK = 1 << 19
_POSITION = _U((1 << 20) - 1)


def _constants(seed: int) -> tuple[np.ndarray, int]:
    random = np.random.default_rng(seed)
    return random.integers(0, 2**64, 256, dtype=_U), int(random.integers(0, 2**61)) * 8 + 5


class Hasher:
    """64-bit polynomial hashes of any substring of one byte string, modulo 2**64.

    Bytes are first replaced by random numbers and results are mixed, so that low bits are as good as high ones.
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int):
        table, base = _constants(seed)
        n = len(data)
        known = Hasher._powers.get(seed)
        if known is None or len(known[0]) < n + 1:
            size = max(4096, 1 << n.bit_length())
            up, down = np.full(size, base, _U), np.full(size, pow(base, -1, 2**64), _U)
            up[0] = down[0] = 1
            known = Hasher._powers[seed] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        self._down = known[1]
        self._sums = np.zeros(n + 1, _U)
        np.cumsum(table[data] * known[0][:n], out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start])

    def all_of(self, length: int) -> np.ndarray:
        n = len(self._sums) - length
        return mix((self._sums[length:] - self._sums[:n]) * self._down[:n])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, from running minima of blocks in both directions."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, _U)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, length: int, gram: int, seed: int = 1):
    """Runs of windows of `length` bytes that share an anchor: arrays (anchor, first, last, hash, hash, hash).

    A window's anchor is its `gram`-byte string of smallest hash, the leftmost of equals. It depends on
    the window's bytes alone, so equal windows have their anchors at the same place. Hashes are those
    of the anchor's gram and (two, of different seeds) of all bytes of the run. Long texts are cut into
    chunks of windows, which may cut a run in two.
    """
    parts = []
    for at in range(0, len(data) - length + 1, CHUNK):
        piece = data[at : at + CHUNK + length - 1]
        one = Hasher(piece, seed)
        grams = one.all_of(gram)
        keys = (grams & ~_POSITION) | np.arange(len(grams), dtype=_U)
        owner = (sliding_minimum(keys, length - gram + 1) & _POSITION).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
        last = np.concatenate([first[1:] - 1, [len(owner) - 1]])
        anchor, end = owner[first], last + length
        two = Hasher(piece, seed + 1)
        parts.append((anchor + at, first + at, last + at, grams[anchor], one(first, end), two(first, end)))
    return [np.concatenate(x) for x in zip(*parts)] if parts else None
