"""Substring dedup by suffix automata: spans of 50 words or more that an earlier document also has.

The reference is all repeated material of the corpus, each content once (see ``repeats``), and it grows
with the corpus, so it is not sent whole to every task: it is cut into shards of whole groups of equal
grams, and the pieces of documents that can match a shard travel to it. There its automaton is built
and the pieces are streamed through it; their matching statistics tell which windows of words it has,
and the first document that has them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from tenderloom.llm.common import batches
from tenderloom.llm.repeats import ANSWERS, Repeats, Words, runs, without_repeats

LENGTH = 50
# Words of the pieces in one automaton; a group of equal grams is never cut.
SHARD_WORDS = 60_000


class Automaton:
    """A suffix automaton over words of several texts, added by rising id; ``first`` of a state is the
    smallest id of a text that holds the state's strings."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def _state(self, length: int, first, next_: dict, link: int = 0) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.length) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """A state for the strings of ``q`` that ``p`` extends by the word."""
        clone = self._state(self.length[p] + 1, self.first[q], dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list[bytes], text: int) -> None:
        last = 0
        for word in words:
            known = self.next[last].get(word)
            if known is not None:
                fits = self.length[known] == self.length[last] + 1
                last = known if fits else self._split(last, word, known)
                continue
            new = self._state(self.length[last] + 1, text, {})
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
            last = new

    def first_holders(self, words: list[bytes], length: int) -> list[tuple[int, int]]:
        """``(start, id)`` for each window of ``length`` words that some text holds."""
        state, matched, out = 0, 0, []
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            if matched >= length:
                while self.length[self.link[state]] >= length:
                    state = self.link[state]
                    matched = self.length[state]
                out.append((i - length + 1, self.first[state]))
        return out


def _shard(rows: list[tuple], length: int):
    """``rows``: ``(did, th, at, own, words)``; answers for those that are ``own``."""
    automaton = Automaton()
    rows.sort(key=lambda row: row[0])
    for did, words in dict.fromkeys((did, tuple(words)) for did, _, _, _, words in rows):
        automaton.add(list(words), did)
    for did, th, at, own, words in rows:
        if own:
            found = [start for start, holder in automaton.first_holders(words, length) if holder < did]
            for begin, end in runs(found):
                yield did, th, (at >> 16) + begin, (at >> 16) + end


def automaton_answers(edges: DataFrame, what: Repeats) -> DataFrame:
    """Windows of the edges that a document with a smaller id also has."""

    def flush(rows):
        found = list(_shard(rows, what.length))
        columns = list(zip(*found)) if found else [[], [], [], []]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        arrays = [pa.array(c, t) for c, t in zip(columns, types)]
        return pa.RecordBatch.from_arrays(arrays, ["did", "th", "first", "last"])

    def run(frames):
        rows, size, group = [], 0, None
        for _, *columns in batches(frames, "did", "th", "at", "own", "gram", "left", "right"):
            for did, th, at, own, gram, left, right in zip(*columns):
                if size > SHARD_WORDS and gram != group:
                    yield flush(rows)
                    rows, size = [], 0
                words = left.split() + right.split()
                rows.append((did, th, at, own, words))
                size, group = size + len(words), gram
        if rows:
            yield flush(rows)

    parts = edges.drop("head").repartition("gram").sortWithinPartitions("gram")
    return parts.select("did", "th", "at", "own", "gram", "left", "right").mapInArrow(run, ANSWERS)


def without_earlier_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, n_words, n_removed, n_spans, kept_sha256)`` per document: every word goes that is
    covered by ``length`` consecutive words which also stand in a document with a smaller id.

    A null text has no words and, like any text of fewer than ``length``, keeps all it has; a null id
    stays null and is the smallest; rows with one id are no earlier than each other; what a document
    repeats within itself stays; extra columns are ignored and an empty table gives an empty one.
    Equality of whole segments is taken from 64-bit hashes.
    """
    what = Repeats(Words, length, earlier=True)
    found = without_repeats(docs, what, lambda edges: automaton_answers(edges, what))
    return found.withColumnRenamed("n", "n_words")
