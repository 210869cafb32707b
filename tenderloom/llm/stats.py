"""Statistics of whole texts, used by the quality rules and the quality classifier.

Words are runs of bytes other than the six ASCII blanks. All numbers are of one text; an empty text
has zeros throughout.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np

BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
# Bytes that start no character, and blanks.
_NOT_IN_WORDS = bytes(range(0x80, 0xC0)) + BLANKS
_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
_DIGITS = bytes(range(0x30, 0x3A))
_MARKS = b"!?;:.,"
_OTHER = bytes(b for b in range(256) if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")

# Counts first, shares after; the rules test the shares.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = [
    "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share",
    "digit_share", "mark_share", "punct_share", "top_word_share", "lone_mark_share", "line_words",
]


def _dropped(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def repeated_words(ids: np.ndarray) -> int:
    """Words inside a 3-word window that the text has twice or more, the first one included."""
    if len(ids) < 4:
        return 0
    width = int(ids.max()) + 1
    pairs = ids[:-1] * width + ids[1:]
    if width > 1_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * width + ids[2:]
    _, back, counts = np.unique(windows, return_inverse=True, return_counts=True)
    found = counts[back] > 1
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : len(found) + shift] |= found
    return int(covered.sum())


def measure(data: bytes) -> tuple[list[int], list[float]]:
    """``COUNTS`` and ``SHARES`` of one text."""
    words = data.split()
    n = len(words)
    if not n:
        return [0] * len(COUNTS), [0.0] * len(SHARES)
    index = defaultdict(itertools.count().__next__)
    ids = np.fromiter(map(index.__getitem__, words), np.int64, n)
    chars = len(data.translate(None, _NOT_IN_WORDS))
    symbols = _dropped(data, SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.strip(BLANKS)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(ids)
    upper, lower = _dropped(data, _UPPER), _dropped(data, _LOWER)
    lone = sum(map(words.count, (b"|", b"-", b"*", b"#", b"&", b"%", b"$")))
    shares = [
        chars / n,
        symbols / n,
        dup / len(lines),
        repeat / n,
        len(index) / n,
        upper / max(1, upper + lower),
        _dropped(data, _DIGITS) / chars,
        _dropped(data, _MARKS) / n,
        _dropped(data, _OTHER) / chars,
        int(np.bincount(ids).max()) / n,
        lone / n,
        n / len(lines),
    ]
    return [n, chars, symbols, dup, repeat], shares
