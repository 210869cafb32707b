"""Texts without what other texts also hold: the frame that substring and suffix-array dedup share.

1. Every text is cut into segments of windows (see ``windows``); only hashes leave the task.
2. Segments whose gram stands elsewhere too are kept as candidates. A segment whose whole content is
   found elsewhere is settled: all its windows are repeated. Counts are combined before each shuffle and
   joins on a hot gram are split by Spark, so copies in thousands are counted, not gathered.
3. What is left, segments at the edges of repeats, is sent with its symbols to the operator's own
   method, in shards of whole groups. A group with more than ``BIG`` contents is not gathered: each of
   its windows goes by the hash of its content, which is again only counted.
4. Texts that wait for step 3 are finished with its answers, all others as soon as step 2 is done.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.common import batches, merge, sha256, shown_id, structs, texts, written
from tenderloom.llm.windows import Windows, byte_grams, word_grams

# Contents of one gram that are compared in one place at most: about a megabyte of symbols.
BIG = 4_096
SEGMENTS = "did long, th int, at long, gram long, content long"
ANSWERS = "did long, th int, first int, last int"
# Symbols cut into segments at a time.
TOGETHER = 200_000
# What a segment is, as bits: repeated as a whole, to be compared, compared with, of a big group.
IS_DONE, IS_OWN, IS_OTHER, IS_BIG = 1, 2, 4, 8

DONE, WAITING, EDGE, WINDOW = 0, 1, 2, 3
WORKED = (
    "kind int, did long, th int, n long, n_removed long, n_spans long, kept_sha256 string, data binary,"
    " starts array<int>, ends array<int>, gram long, at long, own boolean, head binary, left binary,"
    " right binary, place int, key long"
)


class Bytes:
    """A text as its bytes."""

    gram = 32

    def __init__(self, data: bytes):
        self.symbols, self.data = data, data

    @classmethod
    def grams(cls, symbols: bytes) -> np.ndarray:
        return byte_grams(symbols, cls.gram)

    @staticmethod
    def chain(several: list[bytes]) -> bytes:
        return b"".join(several)

    @staticmethod
    def join(parts: list[bytes]) -> bytes:
        return b"".join(parts)

    @staticmethod
    def packed(symbols: bytes) -> bytes:
        return symbols


class Words:
    """A text as its words: runs of bytes other than the six ASCII blanks."""

    gram = 8

    def __init__(self, data: bytes):
        self.symbols, self.data = data.split(), data

    @classmethod
    def grams(cls, symbols: list[bytes]) -> np.ndarray:
        return word_grams(symbols, cls.gram)

    @staticmethod
    def chain(several: list[list[bytes]]) -> list[bytes]:
        return [word for words in several for word in words]

    @staticmethod
    def join(parts: list[list[bytes]]) -> bytes:
        return b" ".join(b" ".join(part) for part in parts if part)

    @staticmethod
    def packed(symbols: list[bytes]) -> bytes:
        return b" ".join(symbols)


@dataclass(frozen=True)
class Repeats:
    """What counts as repeated. ``earlier``: only what a text with a smaller id holds as well;
    otherwise what is found anywhere else, the same text included."""

    symbols: type
    length: int
    earlier: bool


def packed(docs: DataFrame) -> DataFrame:
    """``texts(docs)`` with the bytes compressed, for the way to other tasks."""

    def run(frames):
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch, data in batches(frames, "data"):
            small = pa.array([squeeze.compress(x) for x in data], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("th"), small], ["did", "th", "data"])

    return texts(docs).mapInArrow(run, "did long, th int, data binary")


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def segments(docs: DataFrame, what: Repeats) -> DataFrame:
    """``SEGMENTS`` of every text that has a window."""

    def cut(dids, ths, several):
        sizes = [len(symbols) for symbols in several]
        grams = what.symbols.grams(what.symbols.chain(several))
        found = Windows(grams, what.length, what.symbols.gram, sizes)
        if not len(found.starts):
            return None
        at, gram, content = found.segments()
        first = np.cumsum([0, *sizes[:-1]])[found.owners]
        columns = [np.array(dids)[found.owners], np.array(ths, np.int32)[found.owners], at - (first << 16), gram, content]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["did", "th", "at", "gram", "content"])

    def run(frames):
        held, size = ([], [], []), 0
        for _, dids, ths, data in batches(frames, "did", "th", "data"):
            for did, th, text in zip(dids, ths, data):
                symbols = what.symbols(text).symbols if len(text) >= what.length else ()
                if len(symbols) < what.length:
                    continue
                for column, value in zip(held, (did, th, symbols)):
                    column.append(value)
                size += len(symbols)
                if size > TOGETHER:
                    made = cut(*held)
                    held, size = ([], [], []), 0
                    if made is not None:
                        yield made
        made = cut(*held) if size else None
        if made is not None:
            yield made

    return texts(docs).mapInArrow(run, SEGMENTS)


def marked(found: DataFrame, what: Repeats) -> DataFrame:
    """Segments that matter, with what they are: some are repeated as a whole, some are to be compared
    window by window, some are what these are compared with. Big groups are not gathered."""
    facts = [F.count(F.lit(1)).alias("n")]
    if what.earlier:
        facts += [F.min("did").alias("lowest"), F.max("did").alias("highest")]
    grams = found.groupBy("gram").agg(*facts)
    grams = grams.where("lowest < highest" if what.earlier else "n > 1").select("gram")
    # A table of its own, so that Spark can split the join where one gram is everywhere.
    grams = written(grams, "repeats-grams")
    candidates = written(found.join(grams, "gram", "left_semi"), "repeats-candidates")
    contents = candidates.groupBy("gram", "content").agg(
        F.count(F.lit(1)).alias("n"), F.min("did").alias("first")
    )
    groups = contents.groupBy("gram").agg(
        F.count(F.lit(1)).alias("kinds"), F.min("first").alias("first_any")
    )
    # A table of its own, or Spark would keep it dealt by gram and the join with the candidates too,
    # where a hot gram can't be split.
    facts = written(contents.join(groups, "gram"), "repeats-contents")
    known = candidates.join(facts, ["gram", "content"])
    if what.earlier:
        done = F.col("first") < F.col("did")
        own = ~done & (F.col("first_any") < F.col("did"))
    else:
        done = F.col("n") > 1
        own = ~done
    other = (F.col("kinds") > 1) & (F.col("did") == F.col("first"))
    bits = [(done, IS_DONE), (own, IS_OWN), (other, IS_OTHER), (F.col("kinds") > BIG, IS_BIG)]
    is_ = sum((F.when(c, bit).otherwise(0) for c, bit in bits), F.lit(0))
    return known.select("did", "th", "at", "gram", is_.cast("int").alias("is")).where(f"is & {IS_BIG - 1} <> 0")


def runs(places: list[int]):
    """First and last of each stretch of consecutive rising numbers."""
    start = 0
    for i in range(1, len(places) + 1):
        if i == len(places) or places[i] != places[i - 1] + 1:
            yield places[start], places[i - 1]
            start = i


def _cover(starts, ends, n: int) -> tuple[np.ndarray, np.ndarray]:
    return merge(np.asarray(starts, np.int64), np.minimum(np.asarray(ends, np.int64), n))


def _result(text, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, str]:
    """Symbols, symbols removed, maximal removed runs, and the hash of what is kept."""
    n = len(text.symbols)
    edges = [0, *np.stack([starts, ends], 1).ravel().tolist(), n]
    kept = [text.symbols[a:b] for a, b in zip(edges[::2], edges[1::2])]
    return n, int((ends - starts).sum()), len(starts), sha256(text.join(kept))


WORKED_ARROW = pa.schema(
    [
        ("kind", pa.int32()), ("did", pa.int64()), ("th", pa.int32()), ("n", pa.int64()),
        ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
        ("data", pa.binary()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())),
        ("gram", pa.int64()), ("at", pa.int64()), ("own", pa.bool_()), ("head", pa.binary()),
        ("left", pa.binary()), ("right", pa.binary()), ("place", pa.int32()), ("key", pa.int64()),
    ]
)


class _Rows:
    """Rows of one kind, column by column; columns it doesn't have are null."""

    def __init__(self, kind: int, *names: str):
        self.kind, self.names = kind, names
        self.columns: list[list] = [[] for _ in names]

    def add(self, *values) -> None:
        for column, value in zip(self.columns, values):
            column.append(value)

    def batch(self) -> pa.RecordBatch:
        n, own = len(self.columns[0]), dict(zip(self.names, self.columns))
        own["kind"] = [self.kind] * n
        arrays = [pa.array(own[f.name], f.type) if f.name in own else pa.nulls(n, f.type) for f in WORKED_ARROW]
        return pa.RecordBatch.from_arrays(arrays, schema=WORKED_ARROW)


def _windows(did: int, th: int, own: bool, first: int, keys: np.ndarray) -> pa.RecordBatch:
    """Rows for the windows of one piece of a big group."""
    n = len(keys)
    known = {
        "kind": np.full(n, WINDOW, np.int32), "did": np.full(n, did), "th": np.full(n, th, np.int32),
        "own": np.full(n, own), "place": np.arange(first, first + n, dtype=np.int32), "key": keys,
    }
    arrays = [pa.array(known[f.name], f.type) if f.name in known else pa.nulls(n, f.type) for f in WORKED_ARROW]
    return pa.RecordBatch.from_arrays(arrays, schema=WORKED_ARROW)


def _work(what: Repeats) -> Callable:
    """Texts beside their segments that matter, to finished texts, waiting ones, edges and windows."""
    width = what.length - what.symbols.gram + 1

    def tables() -> tuple[_Rows, _Rows, _Rows]:
        return (
            _Rows(DONE, "did", "n", "n_removed", "n_spans", "kept_sha256"),
            _Rows(WAITING, "did", "th", "data", "starts", "ends"),
            _Rows(EDGE, "did", "th", "own", "gram", "at", "head", "left", "right"),
        )

    def run(frames):
        (done, waiting, edges), size = tables(), 0
        for batch, dids, ths, datas in batches(frames, "did", "th", "data"):
            edge, notes = structs(batch.column("notes"))
            for i, (did, th, data) in enumerate(zip(dids, ths, datas)):
                text = what.symbols(unpacked(data))
                # Repeated rows bring every note as often.
                places, one = np.unique(notes["at"][edge[i] : edge[i + 1]], return_index=True)
                kinds, grams_ = (notes[f][edge[i] : edge[i + 1]][one] for f in ("is", "gram"))
                settled = places[kinds & IS_DONE > 0]
                starts, ends = _cover(
                    settled >> 16, (settled >> 16) + (settled & 0xFFFF) + what.length, len(text.symbols)
                )
                size += 400
                if (kinds & IS_OWN).any():
                    waiting.add(did, th, data, starts.tolist(), ends.tolist())
                    size += len(data)
                else:
                    done.add(did, *_result(text, starts, ends))
                open_ = np.flatnonzero(kinds & (IS_OWN | IS_OTHER))
                for at, is_, gram in zip(*(x[open_].tolist() for x in (places, kinds, grams_))):
                    first = at >> 16
                    piece = text.symbols[first : first + (at & 0xFFFF) + what.length]
                    grams = what.symbols.grams(piece)
                    if is_ & IS_BIG:
                        cut = Windows(grams, what.length, what.symbols.gram)
                        every = np.arange(cut.count)
                        yield _windows(did, th, bool(is_ & IS_OWN), first, cut.content(every, every))
                        continue
                    middle = int(np.argmin(grams[:width]))
                    head, left = piece[middle : middle + what.symbols.gram], piece[:middle]
                    parts = [what.symbols.packed(x) for x in (head, left, piece[middle:])]
                    edges.add(did, th, bool(is_ & IS_OWN), gram, at, *parts)
                    size += 1_000
                if size > 16_000_000:
                    yield from (rows.batch() for rows in (done, waiting, edges))
                    (done, waiting, edges), size = tables(), 0
        yield from (rows.batch() for rows in (done, waiting, edges))

    return run


def _finish(what: Repeats) -> Callable:
    """Waiting texts beside the answers about their windows."""
    names = ["did", "n", "n_removed", "n_spans", "kept_sha256"]

    def run(frames):
        for batch, dids, data, starts, ends in batches(frames, "did", "data", "starts", "ends"):
            edge, answers = structs(batch.column("answers"))
            out = []
            for i, (did, raw, s, e) in enumerate(zip(dids, data, starts, ends)):
                text = what.symbols(unpacked(raw))
                more = slice(edge[i], edge[i + 1])
                s = np.concatenate([s, answers["first"][more]])
                e = np.concatenate([e, answers["last"][more] + what.length])
                out.append((did, *_result(text, *_cover(s, e, len(text.symbols)))))
            types = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names
            )

    return run


def without_repeats(docs: DataFrame, what: Repeats, compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(doc_id, n, n_removed, n_spans, kept_sha256)`` per document.

    ``compare`` gets the edges and returns ``ANSWERS``: repeated windows of ``own`` ones, from first
    to last.
    """
    matter = marked(segments(docs, what), what)
    note = F.struct("at", "is", "gram")
    notes = matter.groupBy("did", "th").agg(F.collect_list(note).alias("notes"))
    both = packed(docs).join(notes, ["did", "th"], "left").select("did", "th", "data", "notes")
    worked = written(both.mapInArrow(_work(what), WORKED), "repeats-worked")

    edges = worked.where(F.col("kind") == EDGE).select("did", "th", "at", "own", "gram", "head", "left", "right")
    windows = worked.where(F.col("kind") == WINDOW).select("did", "th", "own", "place", "key")
    fact = F.min("did") if what.earlier else F.count(F.lit(1))
    keys = windows.groupBy("key").agg(fact.alias("fact"))
    if what.earlier:
        counted = windows.where("own").join(keys, "key").where("fact < did")
    else:
        counted = windows.where("own").join(keys.where("fact > 1"), "key", "left_semi")
    answers = compare(edges).unionByName(
        counted.select("did", "th", F.col("place").alias("first"), F.col("place").alias("last"))
    )
    answers = answers.groupBy("did", "th").agg(F.collect_list(F.struct("first", "last")).alias("answers"))
    waiting = worked.where(F.col("kind") == WAITING).select("did", "th", "data", "starts", "ends")
    finished = waiting.join(answers, ["did", "th"], "left").mapInArrow(
        _finish(what), "did long, n long, n_removed long, n_spans long, kept_sha256 string"
    )
    done = worked.where(F.col("kind") == DONE).select("did", "n", "n_removed", "n_spans", "kept_sha256")
    return done.unionByName(finished).select(
        shown_id().alias("doc_id"), "n", "n_removed", "n_spans", "kept_sha256"
    )
