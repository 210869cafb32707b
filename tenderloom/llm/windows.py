"""Windows of a fixed length over a sequence of symbols, grouped by the gram that stands for them.

A window is represented by its smallest gram (the leftmost of equals), which depends on the window's
content alone: equal windows anywhere have the same gram at the same place. Consecutive windows often
share it, so a text falls into segments of windows, about two in ``length - gram`` symbols. Repeats can
then be looked for among segments, not windows.
"""

from __future__ import annotations

import numpy as np
import xxhash

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _raised(base: int, n: int) -> np.ndarray:
    """``base ** i`` for i up to ``n``, modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) <= n:
        steps = np.full(max(n + 1, 1 << 14), base, np.uint64)
        steps[0] = 1
        known = _powers[base] = np.cumprod(steps, dtype=np.uint64)
        if len(known) > 1 << 22:
            _powers.pop(base)
    return known[: n + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer with full avalanche."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Windows:
    """Segments of the windows of ``length`` symbols, given the hashes of all grams of ``gram``.

    With ``sizes`` the symbols are those of several texts in a row; only windows inside one count, and
    ``owners`` says whose a segment is.
    """

    def __init__(self, grams: np.ndarray, length: int, gram: int, sizes: list[int] | None = None):
        self.grams, self.length = grams, length
        self.width = length - gram + 1
        self.count = max(0, len(grams) - self.width + 1)
        if not self.count:
            self.starts = self.ends = self.anchors = self.owners = np.zeros(0, np.int64)
            return
        least, place, span = grams, np.arange(len(grams), dtype=np.int32), 1
        while span < self.width:
            step = min(span, self.width - span)
            right = least[step:] < least[:-step]
            least = np.where(right, least[step:], least[:-step])
            place = np.where(right, place[step:], place[:-step])
            span += step
        inside = np.arange(self.count)
        if sizes is not None:
            owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            inside = np.flatnonzero(owner[: self.count] == owner[length - 1 : length - 1 + self.count])
            place = place[inside]
        change = np.flatnonzero(place[1:] != place[:-1])
        self.starts = inside[np.concatenate([[0], change + 1])] if len(inside) else inside
        self.ends = inside[np.concatenate([change, [len(inside) - 1]])] if len(inside) else inside
        self.anchors = place[np.concatenate([[0], change + 1])].astype(np.int64) if len(inside) else inside
        self.owners = owner[self.starts] if sizes is not None else np.zeros(len(self.starts), np.int32)

    def _sums(self) -> np.ndarray:
        if not hasattr(self, "_prefix"):
            self._prefix = np.zeros(len(self.grams) + 1, np.uint64)
            np.cumsum(self.grams * _raised(_BASE, len(self.grams))[:-1], out=self._prefix[1:])
        return self._prefix

    def content(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A hash of all symbols under the windows ``first`` to ``last``, as signed 64 bits."""
        sums = self._sums()
        raw = (sums[last + self.width] - sums[first]) * _raised(_BACK, len(self.grams))[first]
        return mixed(raw ^ (last - first + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, hash of the gram, hash of the whole content, of each segment. A place holds the
        first window and, in its last 16 bits, how many follow it."""
        at = (self.starts << 16) | (self.ends - self.starts)
        return at, self.grams[self.anchors].view(np.int64), self.content(self.starts, self.ends)


def byte_grams(data: bytes, gram: int) -> np.ndarray:
    """A hash of every ``gram`` bytes of ``data``; ``gram`` is a multiple of 8."""
    if len(data) < gram:
        return np.zeros(0, np.uint64)
    n = len(data) - gram + 1
    raw = np.frombuffer(data, np.uint8)
    eights = np.lib.stride_tricks.as_strided(raw[: len(data) - 7].view(), (len(data) - 7, 8), (1, 1))
    eights = np.ascontiguousarray(eights).view(np.uint64).ravel()
    out = np.zeros(n, np.uint64)
    for i in range(0, gram, 8):
        out = out * np.uint64(_BASE) + eights[i : i + n]
        out ^= out >> np.uint64(29)
    return mixed(out)


def word_grams(words: list[bytes], gram: int) -> np.ndarray:
    """A hash of every ``gram`` words."""
    if len(words) < gram:
        return np.zeros(0, np.uint64)
    n = len(words) - gram + 1
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    for i in range(gram):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(_BASE) + each[i : i + n]
    return mixed(out)
