"""Token counts by a two-tier lookup of pre-token lengths.

A text is cut into pre-tokens by the tokenizer's own pattern; the number of tokens of a pre-token
does not depend on its neighbours. Lengths of frequent pre-tokens come from a compact table that
every task gets; all others are encoded once per worker by the library and kept in its cache. No
pre-token is ever shuffled, and no text leaves the task that read it.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from collections import Counter
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.common import batches

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
# Texts up to here are cut by a short form of the pattern, others by one that lists all planes.
LAST = 0x4FF
# Entries of a worker's cache, after which it starts anew.
CACHE = 400_000
# Rows that the table of frequent pre-tokens is counted on (the first 20,000 characters of each, to
# bound what the driver holds), and its entries. It only saves time: the counts are the same with any.
SAMPLE_ROWS, FREQUENT = 1_000, 30_000


def _ranges(codes: list[int]) -> str:
    """Characters as a class of a pattern, runs of them as ranges."""
    out, start = [], 0
    for i in range(1, len(codes) + 1):
        if i == len(codes) or codes[i] != codes[i - 1] + 1:
            first, last = (re.escape(chr(codes[at])) for at in (start, i - 1))
            out.append(first if start == i - 1 else f"{first}-{last}")
            start = i
    return "".join(out)


def _kind(category: str) -> str:
    """Letters and numbers are told apart, and blanks (Z); all else is one kind."""
    return category[0] if category[0] in "LNZ" else "other"


@functools.cache
def classes(last: int = sys.maxunicode) -> tuple[str, str, str, str]:
    """Letters, numbers, blanks, and later characters than ``LAST`` that not every version of Unicode has
    as the same kind: a library may take these either way. An old version is compared with this one, and
    what is not assigned yet may be anything."""
    kinds: dict[str, list[int]] = {"L": [], "N": [], "Z": [], "unsure": []}
    old = unicodedata.ucd_3_2_0.category
    for code in range(last + 1):
        c = chr(code)
        if 0xD800 <= code <= 0xDFFF:
            continue
        kind = "Z" if code in (9, 10, 11, 12, 13, 0x85) else _kind(unicodedata.category(c))
        if code > LAST and (kind != _kind(old(c)) or unicodedata.category(c) == "Cn"):
            kind = "unsure"
        if kind != "other":
            kinds[kind].append(code)
    return tuple(_ranges(kinds[k]) for k in ("L", "N", "Z", "unsure"))


@functools.cache
def pattern(letter: str, number: str, blank: str) -> re.Pattern:
    """The byte-level pre-token pattern."""
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{blank}{letter}{number}]+"
        f"|[{blank}]+(?![^{blank}])|[{blank}]+"
    )


BEYOND = re.compile(f"[^\\x00-\\u{LAST:04x}]")


class Lengths(dict):
    """Tokens of each pre-token met; one not yet met is encoded by the library."""

    def __init__(self, tokenizer, known: dict[str, int]):
        super().__init__(known)
        self.tokenizer, self.known = tokenizer, known

    def __missing__(self, piece: str) -> int:
        if len(self) > CACHE + len(self.known):
            self.clear()
            self.update(self.known)
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= 64:
            self[piece] = n
        return n


class TokenCounter:
    """Counts the tokens of whole texts as the library does with its default settings."""

    def __init__(self, definition: str, known: dict[str, int], kinds: tuple | None = None):
        """``kinds``: what ``classes`` returns, if at hand."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.lengths = Lengths(self.tokenizer, known)
        letter, number, blank, unsure = kinds or classes()
        self.short = pattern(*classes(LAST)[:3]).findall
        self.wide = pattern(letter, number, blank).findall
        self.unsure = re.compile(f"[{unsure}]")
        facts = json.loads(definition)
        self.special = [t["content"] for t in facts["added_tokens"]]
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in facts["added_tokens"])
        pre, model = facts["pre_tokenizer"] or {}, facts["model"]
        self.fast = (
            plain
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and facts["normalizer"] is None
            and model["type"] == "BPE"
        )
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        if not self.fast:
            return self.whole(text)
        if self.cut is not None and self.cut.search(text):
            parts = self.cut.split(text)
            return len(parts) - 1 + sum(self.count(p) for p in parts)
        pieces = self.pieces(text)
        return self.whole(text) if pieces is None else sum(map(self.lengths.__getitem__, pieces))

    def pieces(self, text: str) -> list[str] | None:
        """The pre-tokens of a text; None where the library alone can tell."""
        if not BEYOND.search(text):
            return self.short(text)
        return None if self.unsure.search(text) else self.wide(text)


@functools.lru_cache(maxsize=2)
def _worker(key: str, definition: str, known: tuple, kinds: tuple) -> TokenCounter:
    return TokenCounter(definition, dict(known), kinds)


def frequent(docs: DataFrame, definition: str, rows: int = SAMPLE_ROWS, size: int = FREQUENT) -> dict[str, int]:
    """Lengths of the commonest pre-tokens of ``rows`` texts, ``size`` entries at most."""
    counter, seen = TokenCounter(definition, {}), Counter()
    if not counter.fast:
        return {}
    for row in docs.select(F.substring("text", 1, 20_000).alias("text")).limit(rows).toLocalIterator():
        seen.update(p for p in counter.pieces(row.text or "") or () if len(p) <= 64)
    return {sys.intern(p): counter.lengths[p] for p, _ in seen.most_common(size)}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """One row per document: UTF-8 bytes, tokens, and whether these are more than ``limit``.

    ``tokenizer`` is the path of a tokenizers file. Special strings inside texts become their special
    token, as is the library's default; nothing is added, cut or padded. A null or empty text has no
    tokens, a null id stays null, repeated rows are counted each, extra columns are ignored and an
    empty table gives an empty one.
    """
    definition = Path(tokenizer).read_text(encoding="utf-8")
    shared = docs.sparkSession.sparkContext.broadcast(
        (tokenizer, definition, tuple(frequent(docs, definition).items()), classes())
    )

    def count(frames):
        counter = _worker(*shared.value)
        for batch, ids, data in batches(frames, "doc_id", "text"):
            sizes = [len(t.encode()) if t else 0 for t in data]
            counts = [counter.count(t) if t else 0 for t in data]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([n > limit for n in counts], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, SCHEMA)
