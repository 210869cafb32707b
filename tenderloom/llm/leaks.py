"""Benchmark decontamination by latent semantic retrieval.

1. Every text becomes a row of word numbers in the vocabulary of the benchmark (others are -1), and is
   cut into overlapping passages. Document frequencies come from all passages.
2. A distributed randomised SVD: the Gram matrix of the TF-IDF passages is multiplied with a random
   block, task by task, and the sums give the range of its leading directions. The benchmark's own
   span joins it, so that no item is lost in the truncation.
3. Passages and items are compared by cosine in that space, in blocks of items. An item longer than a
   passage is compared in pieces of a passage's length, so that its cosine doesn't fall with its length.
4. Candidates are verified on the words: longest common subsequence of item and text, and whether
   the end of the item, its answer, is there too. A very long item is verified in parts, whose words
   are added up.
5. What the cosine misses is found by counting: a stretch that holds enough of an item has a certain
   number of its rarest words, and where a text has so many within a stretch, every stretch is verified.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.common import batches, common_subsequence, row_id, shown_id, written

# Words of a passage; passages start every half of it.
PASSAGE = 64
STRIDE = PASSAGE // 2
# Words of an item verified at a time.
PART = 2_048
# Random directions of the sketch, and pieces of items searched for at a time.
SKETCH, ITEMS = 24, 256
# A word in a smaller share of passages is telling. Items with few of them are looked for by all their
# words. A passage is compared with the items that its telling words alone bring so near.
RARE, TELLING, REACH = 0.01, 8, 0.18
# Of the words that a stretch needs, the share that is counted, and how many of them a task holds at once.
COUNTED, COUNTS = 1 / 3, 2_000_000
SEED = 11
PARTS = "item_id long, key long, n int, part int, last boolean, pieces int, text string"
HELD = "did long, th int, place int, cosine double, covered int, answer double, first_word int, last_word int"
FOUND = (
    "did long, th int, item_id long, cosine double, coverage double, answer double, first_word int, last_word int"
)
_APART = bytes(
    b if chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(256)
)


def words(text: str) -> list[bytes]:
    """Case-folded words, with ASCII punctuation as blanks."""
    return text.casefold().encode().translate(_APART).split()


def even_cuts(n: int, most: int) -> list[tuple[int, int]]:
    """As few stretches as hold at most so many of ``n`` words each, of nearly equal length."""
    count = math.ceil(n / most)
    return [(i * n // count, (i + 1) * n // count) for i in range(count)]


def item_parts(benchmark: DataFrame) -> DataFrame:
    """One row per part of a distinct item: its words, the item's number of words, whether it is the
    last part, and in how many pieces it is looked for. Items without a word have none."""

    def run(frames):
        for batch, ids, keys, data in batches(frames, "item_id", "key", "text"):
            rows = []
            for item, key, text in zip(ids, keys, data):
                own = words(text)
                cuts = even_cuts(len(own), PART)
                for i, (a, b) in enumerate(cuts):
                    pieces = len(even_cuts(b - a, PASSAGE))
                    rows.append((item, key, len(own), i, i == len(cuts) - 1, pieces, b" ".join(own[a:b]).decode()))
            columns = list(zip(*rows)) if rows else [[] for _ in range(7)]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.string()]
            names = ["item_id", "key", "n", "part", "last", "pieces", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    known = benchmark.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    ).where("text is not null").distinct()
    return known.select("item_id", F.xxhash64("item_id", "text").alias("key"), "text").mapInArrow(run, PARTS)


def fewest_of(n: int, share: float) -> int:
    """The smallest whole number of ``n`` that makes up such a share."""
    few = max(0, int(share * n) - 1)
    while few / n < share:
        few += 1
    return few


def stretch_of(n: int) -> int:
    """Words of the stretch that a part is looked for in: it may have some more in the text, not many."""
    return n + n // 4 + 4


class Benchmark:
    """Parts of items of one block, as numbers of a vocabulary of their own, and their pieces."""

    def __init__(self, rows: list[tuple]):
        """``rows``: text, the item's number of words, whether this is its last part."""
        cut = [words(row[0]) for row in rows]
        names = sorted({w for ws in cut for w in ws})
        self.vocabulary = {w: i for i, w in enumerate(names)}
        self.parts = [np.array([self.vocabulary[w] for w in ws], np.int32) for ws in cut]
        # The answer is the last fifth of an item, as far as it is in the last part.
        self.tails = [
            part[-max(1, min(len(part), max(3, n // 5))) :] if last else None
            for part, (_, n, last) in zip(self.parts, rows)
        ]
        self.alone = [len(part) == n for part, (_, n, _) in zip(self.parts, rows)]
        places = [(i, a, b) for i, part in enumerate(self.parts) for a, b in even_cuts(len(part), PASSAGE)]
        self.items = [self.parts[i][a:b] for i, a, b in places]
        self.part_of = [i for i, _, _ in places]
        self.offset = [a for _, a, _ in places]

    def weigh(self, frequency: np.ndarray, passages: int) -> None:
        self.idf = np.log((1 + passages) / (1 + frequency)) + 0.1
        rare = frequency < max(1, RARE * passages)
        vectors, pairs = self.vectors(), []
        for i, item in enumerate(self.items):
            own = np.unique(item)
            pairs += [(w, i) for w in (own[rare[own]] if rare[own].sum() >= TELLING else own).tolist()]
        # The items of each word that tells of them, one after another, with its weight there.
        pairs.sort()
        self.holders = np.array([i for _, i in pairs], np.int64)
        self.shares = np.array([vectors[i, w] for w, i in pairs])
        self.many = np.bincount([w for w, _ in pairs], minlength=len(self.vocabulary)).astype(np.int64)
        self.from_ = np.cumsum(self.many) - self.many

    def anchor(self, frequency: np.ndarray, least: float) -> None:
        """The rarest words of each part, so many that a stretch with a share of ``least`` of the part
        cannot do without ``must`` of them."""
        pairs, self.must = [], np.ones(len(self.parts), np.int64)
        for i, part in enumerate(self.parts):
            own, times = np.unique(part, return_counts=True)
            need = max(1, fewest_of(len(part), least))
            order = np.argsort(frequency[own], kind="stable")
            without = np.cumsum(times[order]) - (len(part) - need)
            last = int(np.searchsorted(without, max(1, math.ceil(need * COUNTED))))
            self.must[i] = without[last]
            pairs += [(w, i) for w in own[order[: last + 1]].tolist()]
        pairs.sort()
        self.anchored = np.array([i for _, i in pairs], np.int64)
        self.anchors = np.bincount([w for w, _ in pairs], minlength=len(self.vocabulary)).astype(np.int64)
        self.anchors_from = np.cumsum(self.anchors) - self.anchors
        self.width = np.array([stretch_of(len(part)) for part in self.parts], np.int64)

    def cosine(self, part: int, stretch: np.ndarray) -> float:
        """The cosine of a stretch and the nearest piece of a part in the latent space."""
        at, n = np.unique(stretch[stretch >= 0], return_counts=True)
        latent = ((1 + np.log(n)) * self.idf[at]) @ self.basis[at]
        mine = self.latent[np.flatnonzero(np.array(self.part_of) == part)]
        return float((mine @ latent).max() / max(np.linalg.norm(latent), 1e-12))

    def vectors(self) -> np.ndarray:
        out = np.zeros((len(self.items), len(self.vocabulary)))
        for i, item in enumerate(self.items):
            at, n = np.unique(item, return_counts=True)
            out[i, at] = (1 + np.log(n)) * self.idf[at]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def span(self, sketch: np.ndarray) -> None:
        """The latent space: the items and the leading directions of the corpus."""
        vectors = self.vectors()
        basis, _ = np.linalg.qr(np.concatenate([vectors.T, sketch], axis=1))
        scale = np.maximum(np.linalg.norm(sketch, axis=0), 1e-12)
        _, _, turn = np.linalg.svd(np.concatenate([vectors, (sketch / scale).T]) @ basis, full_matrices=False)
        self.basis = (basis @ turn.T).astype(np.float32)
        latent = vectors @ self.basis
        self.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)).astype(np.float32)


class Passages:
    """TF-IDF rows of the passages of several texts, kept as sorted (passage, word) entries."""

    def __init__(self, texts: list[np.ndarray], size: int):
        owner, start, entries, base = [], [], [], 0
        for i, ids in enumerate(texts):
            count = max(1, math.ceil((len(ids) - STRIDE) / STRIDE))
            at = np.flatnonzero(ids >= 0)
            half = at // STRIDE
            known = ids[at].astype(np.int64)
            late = np.minimum(half, count - 1)
            entries.append((base + late) * size + known)
            both = (half > 0) & (half - 1 < late)
            entries.append((base + half[both] - 1) * size + known[both])
            owner.append(np.full(count, i, np.int32))
            start.append(np.arange(count, dtype=np.int32) * STRIDE)
            base += count
        self.count = base
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int32)
        self.start = np.concatenate(start) if start else np.zeros(0, np.int32)
        cells, self.tf = np.unique(np.concatenate(entries) if entries else np.zeros(0, np.int64), return_counts=True)
        self.row, self.word = cells // size, cells % size

    def weigh(self, bench: Benchmark) -> None:
        """Weights of the entries, for the passages near enough to an item to be compared with it
        (``hits``); the others leave."""
        x = (1 + np.log(self.tf)) * bench.idf[self.word]
        norm = np.sqrt(np.bincount(self.row, x * x, self.count))
        x = (x / np.maximum(norm[self.row], 1e-12)).astype(np.float32)
        items, many = len(bench.items), bench.many[self.word]
        ends = np.cumsum(many)
        step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many)
        at = np.repeat(bench.from_[self.word], many) + step
        cells = np.repeat(self.row, many) * items + bench.holders[at]
        near = np.bincount(cells, np.repeat(x, many) * bench.shares[at], self.count * items)
        hits = near.reshape(self.count, items) >= REACH
        enough = hits.any(1)
        self.rows, self.hits = np.flatnonzero(enough), hits[enough]
        mine, place = enough[self.row], np.cumsum(enough) - 1
        self.row, self.word, self.x = place[self.row[mine]], self.word[mine], x[mine]

    def times(self, block: np.ndarray) -> np.ndarray:
        """The passages' rows times a block of columns."""
        if not len(self.x):
            return np.zeros((len(self.rows), block.shape[1]), np.float32)
        starts = np.flatnonzero(np.concatenate([[True], self.row[1:] != self.row[:-1]]))
        out = np.zeros((len(self.rows), block.shape[1]), np.float32)
        out[self.row[starts]] = np.add.reduceat(self.x[:, None] * block[self.word], starts)
        return out


def numbered(docs: DataFrame, shared) -> DataFrame:
    """``(did, th, ids)``: the words of each text as numbers of the benchmark's vocabulary."""

    def run(frames):
        get = shared.value.vocabulary.get
        for batch, data in batches(frames, "text"):
            rows = [pa.array(list(map(get, words(t), itertools.repeat(-1))), pa.int32()) for t in data]
            sizes = np.cumsum([0] + [len(r) for r in rows])
            flat = pa.concat_arrays(rows) if rows else pa.array([], pa.int32())
            ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("th"), ids], ["did", "th", "ids"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(row_id().alias("did"), F.hash(text).alias("th"), text.alias("text"))
    return rows.mapInArrow(run, "did long, th int, ids array<int>")


def _texts(frames, most: int = 300_000):
    """Texts as arrays, in groups of about so many words, beside their ids."""
    group, size = [], 0
    for batch in frames:
        ids = batch.column("ids")
        flat, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
        dids, ths = batch.column("did").to_pylist(), batch.column("th").to_pylist()
        for i, (did, th) in enumerate(zip(dids, ths)):
            group.append((did, th, flat[offsets[i] : offsets[i + 1]]))
            size += len(group[-1][2])
            if size > most:
                yield group
                group, size = [], 0
    if group:
        yield group


def _frequencies(rows: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many passages each word of the vocabulary is, and how many passages there are."""

    def run(frames):
        total = np.zeros(size + 1, np.int64)
        for group in _texts(frames):
            passages = Passages([t for _, _, t in group], size)
            total[:size] += np.bincount(passages.word, minlength=size)
            total[size] += passages.count
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(total)], ["word", "n"])

    counts = rows.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size + 1, np.int64)
    for row in counts:
        out[row.word] = row.n
    return out[:size], int(out[size])


def _sketched(rows: DataFrame, shared, size: int, columns: int) -> np.ndarray:
    """The Gram matrix of the passages times a random block: sums over tasks, one row a word."""
    names = [f"y{i}" for i in range(columns)]

    def run(frames):
        bench = shared.value
        block = np.random.default_rng(SEED).normal(size=(size, columns)).astype(np.float32)
        total = np.zeros((size, columns))
        for group in _texts(frames):
            passages = Passages([t for _, _, t in group], size)
            passages.weigh(bench)
            here = passages.times(block)[passages.row] * passages.x[:, None]
            for i in range(columns):
                total[:, i] += np.bincount(passages.word, here[:, i], size)
        used = np.flatnonzero(total.any(1))
        arrays = [pa.array(used)] + [pa.array(total[used, i]) for i in range(columns)]
        yield pa.RecordBatch.from_arrays(arrays, ["word", *names])

    schema = "word long, " + ", ".join(f"{n} double" for n in names)
    sums = rows.mapInArrow(run, schema).groupBy("word").agg(*[F.sum(n).alias(n) for n in names])
    out = np.zeros((size, columns))
    for row in sums.collect():
        out[row[0]] = row[1:]
    return out


def _verified(bench: Benchmark, part: int, text: np.ndarray, first: int, last: int, least: float):
    """Words of a part that stand in order in one stretch of ``text[first:last]``, where that is, and how
    much of the answer is in it; None where no stretch can hold a share of ``least``."""
    words_, tail = bench.parts[part], bench.tails[part]
    n, region = len(words_), text[first:last]
    width, best, place = min(len(region), stretch_of(n)), 0, 0
    inside = np.concatenate([[0], np.cumsum(np.isin(region, words_))])
    step = max(1, n // 8)
    for at in range(0, max(1, len(region) - width + step), step):
        known = inside[min(at + width, len(region))] - inside[min(at, len(region))]
        if known > best and known / n >= least:
            got = common_subsequence(words_.tolist(), region[at : at + width].tolist())
            if got > best:
                best, place = got, at
    if not best or best / n < least:
        return None
    end = 0.0
    if tail is not None:
        end = common_subsequence(tail.tolist(), region[place : place + width].tolist()) / len(tail)
    return best, end, first + place, first + place + width - 1


def _stretches(hits: list[tuple[int, float]], n: int) -> list[tuple[int, int, float]]:
    """Where in a text a part of ``n`` words may stand: hits are the places where it would begin, by
    each piece met, and their cosines; those that agree make one stretch."""
    if n <= PASSAGE:
        return [(at - n, at + PASSAGE + n, cosine) for at, cosine in hits]
    out = []
    for at, cosine in sorted(hits):
        low, high = at - PASSAGE - n // 8, at + PASSAGE + n + n // 4
        if out and at - out[-1][3] <= max(PASSAGE, n // 8):
            out[-1] = (out[-1][0], high, max(cosine, out[-1][2]), at)
        else:
            out.append((low, high, cosine, at))
    return [stretch[:3] for stretch in out]


def _counted(bench: Benchmark, texts: list[np.ndarray]):
    """``(owner, part, low, high)``: where in a text stretches have as many of a part's rarest words as
    any must that holds enough of it. No other stretch does."""
    sizes = [int(bench.anchors[t[t >= 0]].sum()) for t in texts]
    first = 0
    while first < len(texts):
        after, held = first + 1, sizes[first]
        while after < len(texts) and held + sizes[after] <= COUNTS:
            held += sizes[after]
            after += 1
        yield from _counted_at_once(bench, texts[first:after], first)
        first = after


def _counted_at_once(bench: Benchmark, texts: list[np.ndarray], first: int):
    flat, lengths = np.concatenate(texts), np.array([len(t) for t in texts])
    begin = np.cumsum(lengths) - lengths
    at = np.flatnonzero(flat >= 0)
    at = at[bench.anchors[flat[at]] > 0]
    many = bench.anchors[flat[at]]
    ends = np.cumsum(many)
    step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many)
    part = bench.anchored[np.repeat(bench.anchors_from[flat[at]], many) + step]
    owner = np.repeat(np.repeat(np.arange(len(texts)), lengths)[at], many)
    key, place = owner * len(bench.parts) + part, np.repeat(at, many)
    order = np.argsort(key, kind="stable")
    key, place, part = key[order], place[order], part[order]
    end = np.arange(len(key)) + bench.must[part] - 1
    inside = end < len(key)
    end = np.where(inside, end, 0)
    dense = np.flatnonzero(inside & (key[end] == key) & (place[end] - place < bench.width[part]))
    open_ = None
    for i in dense.tolist():
        mine, which, width = int(key[i]) // len(bench.parts), int(part[i]), int(bench.width[part[i]])
        low = max(0, int(place[end[i]] - begin[mine]) - width + 1)
        high = min(int(lengths[mine]), int(place[i] - begin[mine]) + width)
        if open_ and open_[:2] == (first + mine, which) and low <= open_[3]:
            open_ = (*open_[:3], max(high, open_[3]))
            continue
        if open_:
            yield open_
        open_ = first + mine, which, low, high
    if open_:
        yield open_


def _held(
    bench: Benchmark, part: int, text: np.ndarray, first: int, last: int, least: float, sure: float, answer: float
):
    """What ``_verified`` tells, from every stretch of ``text[first:last]``. Of an item in one part, the first
    stretch that holds it; of another the most words and the most of the answer. None where there is none.

    Neither can grow by more than one from a stretch to the next, so those that cannot get there are
    left out.
    """
    words_, tail = bench.parts[part].tolist(), bench.tails[part]
    n, region, alone = len(words_), text[first:last], bench.alone[part]
    need, width = max(1, fewest_of(n, least)), min(len(region), stretch_of(n))
    inside = np.concatenate([[0], np.cumsum(np.isin(region, bench.parts[part]))])
    tail = [] if tail is None else tail.tolist()
    never = len(region) + n
    # What a stretch must have to count: so many words, or ``need`` and so many of the answer.
    enough = max(need, fewest_of(n, sure)) if alone else need
    ending = (fewest_of(len(tail), answer) if alone else 1) if tail else never
    best, most, place, free = 0, 0, 0, 0
    for at in np.flatnonzero(inside[width:] - inside[: len(inside) - width] >= need).tolist():
        if at < free:
            continue
        stretch = region[at : at + width].tolist()
        got = common_subsequence(words_, stretch)
        end = common_subsequence(tail, stretch) if tail and got >= need else 0
        if got >= enough or got >= need and end >= ending:
            if alone:
                return got, end / len(tail), first + at, first + at + width - 1
            if got > best:
                best, place = got, at
            most = max(most, end)
            enough, ending = max(enough, best + 1), most + 1 if most < len(tail) else never
        free = at + max(1, min(enough - got, max(need - got, ending - end if got >= need else 1)))
    if not best:
        return None
    return best, most / len(tail) if tail else 0.0, first + place, first + place + width - 1


def _search(
    rows: DataFrame, shared, size: int, cosine: float, coverage: float, sure: float, answer: float
) -> DataFrame:
    """The parts of items, by place in the block, that texts hold enough of."""
    least = min(coverage, sure)

    def run(frames):
        bench = shared.value
        for group in _texts(frames):
            passages = Passages([t for _, _, t in group], size)
            passages.weigh(bench)
            z = passages.times(bench.basis)
            z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
            hits: dict[tuple[int, int], list] = {}
            for at in range(0, len(z), 4096):
                near = z[at : at + 4096] @ bench.latent.T
                for row, piece in zip(*np.nonzero((near >= cosine) & passages.hits[at : at + 4096])):
                    passage = passages.rows[at + row]
                    key = int(passages.owner[passage]), bench.part_of[piece]
                    start = int(passages.start[passage]) - bench.offset[piece]
                    hits.setdefault(key, []).append((start, float(near[row, piece])))
            found = {}
            for (owner, part), places in hits.items():
                text, best = group[owner][2], None
                for low, high, near in _stretches(places, len(bench.parts[part])):
                    got = _verified(bench, part, text, max(0, low), min(len(text), high), least)
                    if got is not None and (best is None or (near, *got) > best):
                        best = (near, *got)
                if best is not None:
                    found[owner, part] = best
            for owner, part, low, high in _counted(bench, [t for _, _, t in group]):
                known, text = found.get((owner, part)), group[owner][2]
                n = len(bench.parts[part])
                held = known is not None and (known[1] / n >= sure or known[1] / n >= coverage and known[2] >= answer)
                if held and bench.alone[part]:
                    continue
                got = _held(bench, part, text, low, high, least, sure, answer)
                if got is None:
                    continue
                if known is None or bench.alone[part]:
                    near = max(known[0] if known else -1.0, bench.cosine(part, text[got[2] : got[3] + 1]))
                    found[owner, part] = (near, *got)
                else:
                    # Words and answer count each for itself, as parts are added up.
                    place = got if got[0] > known[1] else known[1:]
                    found[owner, part] = known[0], place[0], max(got[1], known[2]), *place[2:]
            out = [(*group[owner][:2], part, *best) for (owner, part), best in found.items()]
            columns = list(zip(*out)) if out else [[] for _ in range(8)]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
            names = ["did", "th", "place", "cosine", "covered", "answer", "first_word", "last_word"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return rows.mapInArrow(run, HELD)


def found_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    cosine: float = 0.4,
    coverage: float = 0.6,
    sure: float = 0.8,
    answer: float = 0.75,
    items: int = ITEMS,
) -> DataFrame:
    """``(did, th, item_id, ...)`` per document and benchmark item that it holds.

    An item is held where at least ``sure`` of its words stand in order in a stretch little longer than
    it (``stretch_of``), wherever that begins and whatever its ``cosine``, or at least ``coverage`` of them with ``answer`` of its last fifth. Items of more than ``PART``
    words are verified in parts, each in a stretch of its own: a part counts with the words found from
    ``coverage`` on, and the last part tells of the answer. The benchmark is searched in blocks of about
    ``items`` pieces of items, chosen by hash, each over all documents; only a block is on the driver.
    Items and texts may have any length. Null or empty texts and items match nothing; repeated items
    count as one, those with one id and different texts each; repeated documents are found each; extra
    columns are left behind; empty tables give an empty one.
    """
    spark, out = docs.sparkSession, None
    known = written(item_parts(benchmark), "leaks-items")
    pieces = known.agg(F.sum("pieces").alias("n")).first().n
    blocks = math.ceil((pieces or 0) / items)
    block_of = F.pmod(F.xxhash64("key", "part"), F.lit(blocks))
    for block in range(blocks):
        chosen = known.where(block_of == block).orderBy("key", "part").collect()
        if not chosen:
            continue
        bench = Benchmark([(r.text, r.n, r.last) for r in chosen])
        size = len(bench.vocabulary)
        rows = written(numbered(docs, spark.sparkContext.broadcast(bench)), "leaks-words")
        frequency, passages = _frequencies(rows, size)
        bench.weigh(frequency, passages)
        bench.anchor(frequency, min(coverage, sure))
        bench.span(_sketched(rows, spark.sparkContext.broadcast(bench), size, min(SKETCH, size)))
        here = _search(rows, spark.sparkContext.broadcast(bench), size, cosine, coverage, sure, answer)
        place = F.col("place")
        listed = lambda name, kind: F.get(F.array(*[F.lit(r[name]).cast(kind) for r in chosen]), place)
        here = here.select(
            "*",
            listed("item_id", "long").alias("item_id"),
            listed("key", "long").alias("key"),
            listed("n", "int").alias("n"),
            listed("part", "int").alias("part"),
        )
        out = here if out is None else out.unionByName(here)
    if out is None:
        return spark.createDataFrame([], FOUND)
    share = F.col("covered") / F.col("n")
    # Rows repeated with id and text find a part once each.
    return (
        out.groupBy("did", "th", "item_id", "key", "n", "part")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            *[F.max(c).alias(c) for c in ("cosine", "covered", "answer", "last_word")],
            F.min("first_word").alias("first_word"),
        )
        .groupBy("did", "th", "item_id", "key", "n")
        .agg(
            F.sum("covered").alias("covered"),
            F.min("first_word").alias("first_word"),
            *[F.max(c).alias(c) for c in ("copies", "cosine", "answer", "last_word")],
        )
        .where((share >= sure) | (share >= coverage) & (F.col("answer") >= answer))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select("did", "th", "item_id", "cosine", share.alias("coverage"), "answer", "first_word", "last_word")
    )


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``found_leaks`` in the form of a report, one row per document and item."""
    return found_leaks(docs, benchmark, **settings).select(
        shown_id().alias("doc_id"), "item_id", "cosine", "coverage", "answer", "first_word", "last_word"
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    bad = found_leaks(docs, benchmark, **settings).select(
        F.col("did").alias("__did"), F.col("th").alias("__th")
    ).distinct()
    on = (row_id() == F.col("__did")) & (F.hash(F.coalesce(F.col("text"), F.lit(""))) == F.col("__th"))
    return docs.join(bad, on, "left_anti")
