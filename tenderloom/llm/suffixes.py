"""Suffix-array dedup of bytes: what also stands anywhere else, in strings of 200 bytes or more.

Suffixes are taken where a window's gram stands (see ``repeats``) and only where a repeat begins or
ends. Sampled splitters range-partition them by their leading bytes; every bucket is sorted by multikey
quicksort and neighbours are compared. A splitter falls between different leading bytes, and a repeat
shares these, so none crosses into the next bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tenderloom.llm.common import batches
from tenderloom.llm.repeats import ANSWERS, Bytes, Repeats, runs, without_repeats

LENGTH = 200
TOKEN = 8
# Suffixes sorted at a time; a group of equal leading bytes is never cut.
CHUNK = 20_000


def multikey_quicksort(strings: list[bytes], token: int = TOKEN) -> list[int]:
    """The order of the strings, by three-way partitions on one token at a time."""
    out, todo = [], [(list(range(len(strings))), 0)]
    while todo:
        part, depth = todo.pop()
        if len(part) <= 1 or depth < 0:
            out += part
            continue
        at = depth * token
        keys = [strings[i][at : at + token] for i in part]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        less = [i for i, k in zip(part, keys) if k < pivot]
        same = [i for i, k in zip(part, keys) if k == pivot]
        more = [i for i, k in zip(part, keys) if k > pivot]
        # Strings that end within this token are equal.
        todo += [(more, depth), (same, depth + 1 if len(pivot) == token else -1), (less, depth)]
    return out


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def _runs(sorted_rows: list[dict], shared: list[int], least: int):
    """Stretches of the sorted suffixes whose neighbours share at least ``least`` bytes."""
    start = 0
    for i in range(1, len(sorted_rows) + 1):
        if i == len(sorted_rows) or shared[i] < least:
            if i - start > 1:
                yield sorted_rows[start:i], shared[start + 1 : i]
            start = i


def _pair(a: dict, b: dict, shared: int, length: int):
    """Repeated windows of two suffixes that share ``shared`` bytes: as many bytes before the suffix as
    they also share there, and no fewer than the window needs."""
    before = common(a["left"][::-1], b["left"][::-1])
    least = max(0, length - shared)
    for row in (a, b):
        if row["own"] and before >= least:
            origin = (row["at"] >> 16) + len(row["left"])
            last = (row["at"] >> 16) + (row["at"] & 0xFFFF)
            yield row["did"], row["th"], origin - before, min(origin - least, last)


def _many(rows: list[dict], shared: list[int], length: int):
    """The same for more suffixes: windows that a neighbour's common prefix lets be repeated are
    compared as strings."""
    reach = [max(x, y) for x, y in zip([0, *shared], [*shared, 0])]
    seen: dict[tuple, int] = {}
    tried = []
    for row, far in zip(rows, reach):
        piece, middle = row["left"] + row["right"], len(row["left"])
        windows = [
            (j, (middle - j, piece[j : j + length]))
            for j in range((row["at"] & 0xFFFF) + 1)
            if length - (middle - j) <= far
        ]
        for _, key in windows:
            seen[key] = seen.get(key, 0) + 1
        tried.append(windows)
    for row, windows in zip(rows, tried):
        if row["own"]:
            first = row["at"] >> 16
            for begin, end in runs([j for j, key in windows if seen[key] > 1]):
                yield row["did"], row["th"], first + begin, first + end


def _sorted_bucket(rows: list[dict], length: int, gram: int):
    order = multikey_quicksort([row["right"] for row in rows])
    rows = [rows[i] for i in order]
    shared = [0] + [common(a["right"], b["right"]) for a, b in zip(rows, rows[1:])]
    for run, within in _runs(rows, shared, gram):
        if len(run) == 2:
            yield from _pair(*run, within[0], length)
        else:
            yield from _many(run, within, length)


def suffix_answers(edges: DataFrame, what: Repeats) -> DataFrame:
    """Repeated windows among the edges, by sorting their suffixes in range partitions."""

    def flush(rows):
        found = list(_sorted_bucket(rows, what.length, what.symbols.gram))
        columns = list(zip(*found)) if found else [[], [], [], []]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        arrays = [pa.array(c, t) for c, t in zip(columns, types)]
        return pa.RecordBatch.from_arrays(arrays, ["did", "th", "first", "last"])

    def run(frames):
        rows = []
        names = ["did", "th", "at", "own", "head", "left", "right"]
        for _, *columns in batches(frames, *names):
            for values in zip(*columns):
                row = dict(zip(names, values))
                if len(rows) >= CHUNK and row["head"] != rows[-1]["head"]:
                    yield flush(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield flush(rows)

    # Spark samples the splitters; equal leading bytes are never parted.
    parts = edges.drop("gram").repartitionByRange("head").sortWithinPartitions("head")
    return parts.select("did", "th", "at", "own", "head", "left", "right").mapInArrow(run, ANSWERS)


def without_repeated_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` per document: every byte goes that is
    covered by a string of ``length`` bytes standing anywhere else too, the same document included.

    A null text is empty and, like any text shorter than ``length``, keeps all it has; a null id stays
    null; repeated rows are different documents, so all of a long one goes; overlapping copies count;
    extra columns are ignored and an empty table gives an empty one. Equality of whole segments is
    taken from 64-bit hashes.
    """
    what = Repeats(Bytes, length, earlier=False)
    found = without_repeats(docs, what, lambda edges: suffix_answers(edges, what))
    return found.withColumnRenamed("n", "n_bytes")
