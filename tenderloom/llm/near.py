"""Near duplicates by order MinHash over five-word shingles.

Each sketch of a text takes the few smallest of its occurrence-labelled shingles under one hash
function and keeps them in the order of the text, so that equal sketches mean near texts, not near bags
of words. Exact copies are one text from the start. Texts with an equal sketch are a bucket. They are first
compared with the bucket's head, the text with the most company; those that are in different classes then
are compared with the neighbours that look most alike, in an order that brings texts with several common
sketches together. What may still be near in a bucket without being in one class is found by its rarest
shingles, with no limit to their number, so that no link within a bucket is lost. An exhaustive form compares
all that is left, in rounds. Comparing means the Jaccard similarity of the shingles, then a
banded alignment. Links become classes by alternating star contractions, in tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.common import batches, common_subsequence, row_id, shown_id, texts, written
from tenderloom.llm.repeats import unpacked
from tenderloom.llm.windows import mixed

WORDS, SIMILARITY = 5, 0.8
SKETCHES, TAKEN = 24, 5
# Shorter texts also get sketches of fewer shingles, as few shingles seldom agree in five.
SHORT, TAKEN_SHORT = 50, 2
SEED = 97
# Marks of a text, one byte each, by which similarity is estimated; how many standard errors it may be off.
MARKS, DOUBT = 64, 2.5
# Texts of a bucket that a text is held against, and those of them that it is compared with.
REACH, NEAREST = 32, 3
# Slots of the table by which shingles are told to be rare, of a fixed size however many there are.
SLOTS = 1 << 18
# Longs of a text's parity bits: in how many ranges of hashes two texts' numbers of shingles differ by an odd
# number is at least so many shingles that only one of them has.
PARITIES = 8
# Of the exhaustive form: a round has so many times the heads of the one before; a part is about so many texts of a bucket or a shingle.
GROWTH, PART = 16, 1_024
# Diagonals of the alignment's band; beyond, the whole matrix is worked out bit by bit.
BAND = 1_500


def shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of the runs of ``WORDS`` words; a shorter text is one run."""
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(WORDS, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        out = mixed(out + np.uint64(i + 1)) + each[i : i + len(out)]
    return mixed(out)


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Hashes that also tell the first occurrence of a shingle from its second, and so on."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return hashes
    at = np.arange(len(hashes))
    starts = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), at, 0))
    times = np.empty(len(hashes), np.uint64)
    times[order] = (at - starts).astype(np.uint64)
    return mixed(hashes + times * np.uint64(0x9E3779B97F4A7C15))


def order_sketches(hashes: np.ndarray, taken: int, seed: int) -> np.ndarray:
    """``SKETCHES`` values: for each hash function, the ``taken`` smallest in their text order."""
    labels = labelled(hashes)
    salts = mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64) + np.uint64(seed << 20))
    if len(labels) <= taken:
        at = np.broadcast_to(np.arange(len(labels)), (SKETCHES, len(labels)))
    else:
        values = (labels[None, :] ^ salts[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
        values ^= values >> np.uint64(32)
        values *= np.uint64(0x94D049BB133111EB)
        at = np.sort(np.argpartition(values, taken - 1, axis=1)[:, :taken], axis=1)
    out = salts.copy()
    for i in range(at.shape[1]):
        out = mixed(out) + labels[at[:, i]]
    return mixed(out)


def similarity_marks(distinct: np.ndarray) -> bytes:
    """For each of ``MARKS`` ranges of hashes, a byte of the smallest hash in it; 0 if there is none.
    ``distinct`` is in order."""
    out = np.zeros(MARKS, np.uint8)
    spread = np.sort(mixed(distinct ^ np.uint64(SEED)))
    at, first = np.unique(spread >> np.uint64(64 - MARKS.bit_length() + 1), return_index=True)
    out[at.astype(np.int64)] = 1 + (spread[first] % np.uint64(255)).astype(np.uint8)
    return out.tobytes()


def _signature(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def sketched(docs: DataFrame) -> DataFrame:
    """``(did, th, sig, n, sketches, marks)``; ``sig`` is null where there is no word, ``n`` counts
    distinct shingles."""

    def run(frames):
        for batch, data in batches(frames, "data"):
            sigs, sizes, rows, marks = [], [], [], []
            for text in data:
                words = text.split()
                hashes = shingles(words)
                each = np.unique(hashes)
                distinct = len(each)
                marks.append(similarity_marks(each))
                sigs.append(_signature(words) if words else None)
                sizes.append(distinct)
                found = [order_sketches(hashes, TAKEN, SEED)] if words else []
                if words and distinct < SHORT:
                    found.append(order_sketches(hashes, TAKEN_SHORT, SEED + 1))
                rows.append(np.concatenate(found).view(np.int64) if found else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("did"), batch.column("th"), pa.array(sigs, pa.binary()),
                    pa.array(sizes, pa.int32()), pa.array(rows, pa.list_(pa.int64())), pa.array(marks, pa.binary()),
                ],
                ["did", "th", "sig", "n", "sketches", "marks"],
            )

    return texts(docs).mapInArrow(run, "did long, th int, sig binary, n int, sketches array<long>, marks binary")


def bucket_members(sketches: DataFrame) -> DataFrame:
    """``(key, sig, n, size, head)``: the texts of each bucket of two or more, and its first text."""
    one = sketches.where("sig is not null").groupBy("sig").agg(
        F.first("n").alias("n"), F.first("sketches").alias("sketches")
    )
    keys = one.select("sig", "n", F.explode("sketches").alias("key"))
    groups = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("sig").alias("head")).where("size > 1")
    # Both grow with the texts; a planner that broadcasts the groups while they are few only hides it.
    return written(keys.join(groups.hint("merge"), "key"), "near-members")


def candidate_pairs(member: DataFrame) -> DataFrame:
    """Distinct ``(a, b)`` with a < b: each text and the head of each bucket it is in. The head is the text
    whose buckets are largest in all: in a family of copies that is the text they were all made from."""
    large = member.where("size > 2")
    known = large.groupBy("sig").agg(F.sum("size").alias("known"))
    heads = large.join(known.hint("merge"), "sig").groupBy("key").agg(F.max(F.struct("known", "sig")).alias("top"))
    named = member.join(heads.hint("merge"), "key", "left").withColumn("head", F.coalesce("top.sig", "head"))
    pairs = named.where("sig <> head").select(F.least("sig", "head").alias("a"), F.greatest("sig", "head").alias("b"))
    return pairs.distinct()


def _alike(marks: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of each row and the one ``step`` rows earlier, and how much that may be off."""
    here, there = marks[step:], marks[:-step]
    used = np.maximum(((here != 0) | (there != 0)).sum(axis=1), 1)
    return ((here == there) & (here != 0)).sum(axis=1) / used, DOUBT * np.sqrt(SIMILARITY * (1 - SIMILARITY) / used)


def _neighbours(frames):
    """Pairs of a bucket's texts, in different classes, that stand near in its order and look most alike."""
    names = ["key", "sig", "n", "label", "marks"]
    held = None
    for batch in frames:
        table = pa.Table.from_batches([batch.select(names)])
        fresh = 0 if held is None else held.num_rows
        table = table if held is None else pa.concat_tables([held, table])
        held = table.slice(max(0, table.num_rows - REACH))
        key, n, label = (table.column(c).to_numpy() for c in ("key", "n", "label"))
        sig = table.column("sig").to_pylist()
        marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint8).reshape(-1, MARKS)
        found = [np.zeros((0, 3))]
        for step in range(1, min(REACH, len(key) - 1) + 1):
            near = (key[step:] == key[:-step]) & (label[step:] != label[:-step])
            small, big = np.minimum(n[step:], n[:-step]), np.maximum(n[step:], n[:-step])
            near &= (small >= SIMILARITY * big) & (np.arange(step, len(key)) >= fresh)
            at = np.flatnonzero(near)
            if len(at):
                rows = np.concatenate([marks[at + step], marks[at]])
                alike, doubt = _alike(rows, len(at)) if len(at) else (np.zeros(0), np.zeros(0))
                good = alike >= SIMILARITY - doubt
                found.append(np.stack([at[good] + step, at[good], alike[good]], 1))
        every = np.concatenate(found)
        ends = np.concatenate([every[:, :2], every[:, 1::-1]]).astype(np.int64)
        alike = np.concatenate([every[:, 2], every[:, 2]])
        order = np.lexsort((-alike, ends[:, 0]))
        ends = ends[order]
        starts = np.searchsorted(ends[:, 0], ends[:, 0])
        ends = ends[np.arange(len(ends)) - starts < NEAREST]
        pairs = sorted({(min(sig[i], sig[j]), max(sig[i], sig[j])) for i, j in ends.tolist()})
        columns = list(zip(*pairs)) if pairs else [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["a", "b"])


def neighbour_pairs(mixed: DataFrame, sketches: DataFrame) -> DataFrame:
    """Distinct ``(a, b)`` with a < b: texts that share a bucket but no class. The texts of a bucket are put
    in the order of their next sketches, so that those with several sketches in common stand together, and
    each is held against the ``REACH`` before it by its marks. A text has at most ``NEAREST`` pairs for
    each bucket it is in and each that names it."""
    texts_ = sketches.where("sig is not null").groupBy("sig").agg(
        F.first("sketches").alias("sketches"), F.first("marks").alias("marks")
    )
    rows = mixed.select("key", "sig", "n", F.xxhash64("label").alias("label")).join(texts_.hint("merge"), "sig")
    at = F.array_position("sketches", F.col("key")).cast("int") - 1
    block = F.floor(at / SKETCHES).cast("int") * SKETCHES
    follow = [F.col("sketches")[block + F.pmod(at + i, F.lit(SKETCHES))].alias(f"next{i}") for i in (1, 2, 3)]
    # Written, as bounds are sampled from it.
    rows = written(rows.select("key", *follow, "sig", "n", "label", "marks"), "near-rows")
    order = ["key", "next1", "next2", "next3", "sig"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(_neighbours, "a binary, b binary").distinct()


def mixed_buckets(rest: DataFrame, labels: DataFrame) -> DataFrame:
    """``(key, sig, n, label, size)`` of the buckets whose texts are not yet in one class."""
    named = rest.join(labels.select("sig", "label").hint("merge"), "sig", "left")
    named = named.select("key", "sig", "n", F.coalesce("label", "sig").alias("label"))
    open_ = named.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.min("label").alias("one"), F.max("label").alias("other")
    )
    open_ = open_.where("one <> other").select("key", "size")
    return written(named.join(open_.hint("merge"), "key"), "near-mixed")


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _packed_shingles(data: bytes) -> np.ndarray:
    return np.unique(shingles(unpacked(data).split()))


def _shingle_counts(open_: DataFrame) -> np.ndarray:
    """How many texts have a shingle in each of ``SLOTS`` slots."""

    def run(frames):
        total = np.zeros(SLOTS, np.int64)
        for _, data in batches(frames, "data"):
            for one in data:
                np.add.at(total, _slots(_packed_shingles(one)), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["slot", "n"])

    found = open_.select("data").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = found.toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return out


def _parities(hashes: np.ndarray) -> np.ndarray:
    bits = 64 * PARITIES
    many = np.bincount((hashes >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64), minlength=bits)
    return np.packbits((many & 1).astype(np.uint8)).view(np.int64)


def _prefixes(open_: DataFrame) -> DataFrame:
    """``(token, sig, n, label, at, p0, p1, ...)``: the rarest shingles of each text, with their place in that
    order, and the text's parity bits. Two texts
    that share none of them have less than ``SIMILARITY``: of all but one more than a text may have of its
    own, at least one is in the other, and in either the rarest of these stands that early."""
    counts = open_.sparkSession.sparkContext.broadcast(_shingle_counts(open_))
    names = [f"p{i}" for i in range(PARITIES)]

    def run(frames):
        for _, sig, label, data in batches(frames, "sig", "label", "data"):
            rows, many = [], 0
            for i, text in enumerate(data):
                hashes = _packed_shingles(text)
                n = len(hashes)
                most = n - int(np.ceil(SIMILARITY * n - 1e-9)) + 1
                order = np.lexsort((hashes, counts.value[_slots(hashes)]))[:most]
                rows.append((hashes[order].view(np.int64), i, n, _parities(hashes)))
                many += most
                if many > 50_000 or i == len(data) - 1:
                    sizes = [len(tokens) for tokens, *_ in rows]
                    text_of = pa.array(np.repeat([i for _, i, *_ in rows], sizes))
                    columns = [
                        pa.array(np.concatenate([tokens for tokens, *_ in rows])),
                        pa.array(sig, pa.binary()).take(text_of),
                        pa.array(np.repeat([n for _, _, n, _ in rows], sizes), pa.int32()),
                        pa.array(label, pa.binary()).take(text_of),
                        pa.array(np.concatenate([np.arange(k) for k in sizes]), pa.int32()),
                    ]
                    parities = np.repeat(np.stack([p for *_, p in rows]), sizes, axis=0)
                    columns += [pa.array(np.ascontiguousarray(parities[:, k])) for k in range(PARITIES)]
                    yield pa.RecordBatch.from_arrays(columns, ["token", "sig", "n", "label", "at", *names])
                    rows, many = [], 0

    rows = open_.select("sig", "label", "data")
    schema = "token long, sig binary, n int, label binary, at int, " + ", ".join(f"{p} long" for p in names)
    return rows.mapInArrow(run, schema)


def rarest_pairs(mixed: DataFrame, held: DataFrame) -> DataFrame:
    """Distinct ``(a, b)`` with a < b: all pairs of these texts, in different classes, that may reach
    ``SIMILARITY``; exact, whatever the size of a bucket. Texts meet at their rarest shingles; the places
    of these bound what the two can have in common, and their parity bits what they have not."""
    open_ = mixed.select("sig", "label").distinct().join(held.hint("merge"), "sig")
    rows = written(_prefixes(written(open_, "near-open")), "near-prefixes")
    shared = rows.groupBy("token").agg(
        F.count(F.lit(1)).alias("size"), F.min("label").alias("one"), F.max("label").alias("other")
    )
    shared = shared.where("one <> other").select("token", F.ceil(F.col("size") / PART).cast("int").alias("parts"))
    rows = rows.join(shared.hint("merge"), "token")
    here = rows.withColumn("part", F.pmod(F.xxhash64("sig", F.lit(SEED + 3)), F.col("parts")).cast("int"))
    there = rows.select(
        "token", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        *[F.col(c).alias(f"{c}_b") for c in rows.columns if c not in ("token", "parts")],
    )
    both = F.least("at", "at_b") + F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b"))
    apart = sum((F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"p{i}_b"))) for i in range(PARITIES)), F.lit(0))
    near = (F.least("n", "n_b") >= SIMILARITY * F.greatest("n", "n_b") - 1e-9) & (
        (1 + SIMILARITY) * both >= SIMILARITY * (F.col("n") + F.col("n_b")) - 1e-9
    ) & ((1 + SIMILARITY) * apart <= (1 - SIMILARITY) * (F.col("n") + F.col("n_b")) + 1e-9)
    pairs = here.drop("parts").join(there.hint("merge"), ["token", "part"])
    pairs = pairs.where((F.col("sig") < F.col("sig_b")) & (F.col("label") != F.col("label_b")) & near)
    return pairs.select(F.col("sig").alias("a"), F.col("sig_b").alias("b")).distinct()


def head_pairs(mixed: DataFrame) -> DataFrame:
    """Distinct ``(a, b)`` with a < b: each head and the texts of its bucket that are in another class and
    not too short or long to be near."""
    parts = F.ceil(F.col("size") / PART).cast("int")
    heads = mixed.where("is_head").select(
        "key", F.col("sig").alias("head"), F.col("n").alias("head_n"), F.col("label").alias("head_label"),
        F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"),
    )
    others = mixed.withColumn("part", F.pmod(F.xxhash64("sig", F.lit(SEED + 3)), parts).cast("int"))
    near = F.least("n", "head_n") >= SIMILARITY * F.greatest("n", "head_n")
    pairs = others.join(heads.hint("merge"), ["key", "part"]).where(F.col("label") != F.col("head_label")).where(near)
    return pairs.select(F.least("sig", "head").alias("a"), F.greatest("sig", "head").alias("b")).distinct()


def _distance(a: list[int], b: list[int], most: int) -> int | None:
    """Insertions and deletions between two texts, by furthest-reaching points on the diagonals of a
    band that widens with each; None beyond ``most``."""
    n, m = len(a), len(b)
    reach = {1: 0}
    for d in range(min(most, BAND) + 1):
        for k in range(-d, d + 1, 2):
            down = k == -d or k != d and reach[k - 1] < reach[k + 1]
            x = reach[k + 1] if down else reach[k - 1] + 1
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                if a[x : x + 32] == b[y : y + 32]:
                    step = min(32, n - x, m - y)
                else:
                    step = 1
                x, y = x + step, y + step
            reach[k] = x
            if x >= n and y >= m:
                return d
    if most <= BAND:
        return None
    d = n + m - 2 * common_subsequence(a, b)
    return d if d <= most else None


class _Text:
    def __init__(self, data: bytes):
        words = unpacked(data).split()
        self.hashes = np.unique(shingles(words))
        self.words = list(map(xxhash.xxh3_64_intdigest, words))


def similar(a: _Text, b: _Text, least: float = SIMILARITY) -> tuple[float, float] | None:
    """Jaccard similarity of the shingles and similarity of the alignment, if both are enough."""
    n, m = len(a.hashes), len(b.hashes)
    if min(n, m) < least * max(n, m):
        return None
    both = len(np.intersect1d(a.hashes, b.hashes, assume_unique=True))
    jaccard = both / (n + m - both)
    if jaccard < least:
        return None
    total = len(a.words) + len(b.words)
    d = _distance(a.words, b.words, int((1 - least) * total + 1e-9))
    return None if d is None else (jaccard, 1 - d / total)


def held_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """``(sig, data)``: the compressed text of everything in a pair, once."""

    def pack(frames):
        squeeze = zstandard.ZstdCompressor(level=3)
        for _, data in batches(frames, "data"):
            words = [x.split() for x in data]
            some = [(_signature(w), squeeze.compress(x)) for w, x in zip(words, data) if w]
            columns = list(zip(*some)) if some else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["sig", "data"])

    needed = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    packed = texts(docs).select("data").mapInArrow(pack, "sig binary, data binary")
    held = packed.join(needed.hint("merge"), "sig", "left_semi").groupBy("sig").agg(F.min("data").alias("data"))
    return written(held, "near-texts")


def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """``(a, b, jaccard, aligned)`` of the pairs that are near."""

    def compare(frames):
        head, text = None, None
        for _, a, b, x, y in batches(frames, "a", "b", "x", "y"):
            out = []
            for one, two, p, q in zip(a, b, x, y):
                if one != head:
                    head, text = one, _Text(p)
                found = similar(text, _Text(q))
                if found:
                    out.append((one, two, *found))
            columns = list(zip(*out)) if out else [[], [], [], []]
            types = [pa.binary(), pa.binary(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["a", "b", "jaccard", "aligned"]
            )

    rows = pairs.join(held.withColumnsRenamed({"sig": "b", "data": "y"}), "b")
    rows = rows.join(held.withColumnsRenamed({"sig": "a", "data": "x"}), "a")
    return rows.select("a", "b", "x", "y").mapInArrow(compare, "a binary, b binary, jaccard double, aligned double")


def classes(links: DataFrame) -> DataFrame:
    """``(sig, label)``: the smallest member of each text's class, for texts that have a link.

    Large and small stars take turns until the links are stars already; every round is a table.
    """
    edges = written(links.select("a", "b").where("a <> b").distinct(), "near-links")

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    while True:
        # Every text links its larger neighbours to the smallest it knows.
        near = both(edges)
        least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = near.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # Every text links itself and its smaller neighbours to the smallest of these.
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        small = small.unionByName(lowest.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b")
        new = written(small.distinct(), "near-stars")
        # Stars on their own centre: nobody has two centres and no centre has another.
        centres = new.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
        loose = centres.where("n > 1").limit(1).count() or new.select("a").join(centres, F.col("a") == centres.b, "left_semi").limit(1).count()
        edges = new
        if not loose:
            break
    return edges.select(F.col("b").alias("sig"), F.col("a").alias("label")).unionByName(
        edges.select(F.col("a").alias("sig"), F.col("a").alias("label")).distinct()
    )


def class_labels(sketches: DataFrame, docs: DataFrame, exhaustive: bool = False) -> DataFrame:
    """``(sig, label)`` as of ``classes``.

    Texts are compared with the heads of their buckets, then those of mixed buckets with their most similar
    neighbours; both grow with the number of texts. Then what is left in mixed buckets is compared with all
    that share one of its rarest shingles, so that any two texts of a bucket are in one class, compared, or
    known to be less similar. If ``exhaustive``, rounds follow until any two are in one class or compared,
    to the same classes, which grows with the square of a bucket of dissimilar texts: a
    round compares its heads with all the rest, in other classes, of their buckets, and then they leave.
    """
    member = bucket_members(sketches)
    pairs = written(candidate_pairs(member), "near-pairs")
    # Each text of a bucket has a pair with its head, so these are the texts of all later rounds too.
    held = held_texts(pairs, docs)
    links = written(verified(pairs, held).select("a", "b"), "near-found")
    labels = written(classes(links), "near-classes")

    def more(fresh: DataFrame) -> None:
        nonlocal pairs, links, labels
        # What was compared before, in this bucket or another, is not compared again.
        fresh = written(fresh.join(pairs.hint("merge"), ["a", "b"], "left_anti"), "near-pairs")
        found = written(verified(fresh, held).select("a", "b"), "near-found")
        if found.limit(1).count():
            links = links.unionByName(found)
            labels = written(classes(links), "near-classes")
        pairs = pairs.unionByName(fresh)

    rest = member.select("key", "sig", "n")
    more(neighbour_pairs(mixed_buckets(rest, labels), sketches))
    mixed = mixed_buckets(rest, labels)
    if mixed.limit(1).count():
        more(rarest_pairs(mixed, held))
    heads = GROWTH
    while exhaustive:
        mixed = mixed_buckets(rest, labels)
        cuts = F.ceil(F.col("size") / heads)
        mixed = mixed.withColumn("is_head", F.pmod(F.xxhash64("sig", F.lit(SEED + 2)), cuts) == 0)
        if mixed.limit(1).count() == 0:
            break
        more(head_pairs(mixed))
        rest, heads = mixed.where("not is_head").select("key", "sig", "n"), heads * GROWTH
    return labels


def classed(docs: DataFrame, exhaustive: bool = False) -> DataFrame:
    """``(did, th, label)`` of each row; rows of one class have one label."""
    sketches = written(sketched(docs), "near-sketches")
    labels = class_labels(sketches, docs, exhaustive).withColumnRenamed("sig", "own")
    rows = sketches.select("did", "th", "sig").join(labels, F.col("sig") == F.col("own"), "left")
    # A text without words is alone.
    alone = F.concat(F.lit("row ").cast("binary"), F.monotonically_increasing_id().cast("string").cast("binary"))
    return rows.select("did", "th", F.coalesce("label", "sig", alone).alias("label"), F.col("sig").isNull().alias("empty"))


def near_duplicates(docs: DataFrame, exhaustive: bool = False) -> DataFrame:
    """One row per document: ``class_id``, the smallest id of its class, and whether it is the one that
    ``kept_documents`` keeps.

    Texts are near when at least 0.8 of their five-word shingles agree (those in either text being
    all) and their alignment agrees as far. A text of fewer words is one shingle; a null text or one
    without words is alone; a null id stays null and gives its class no id; repeated rows and exact
    copies are one class; extra columns are ignored and an empty table gives an empty one. Texts of any
    length are compared whole. ``exhaustive`` compares all texts of a bucket, see ``class_labels``.
    """
    rows = written(classed(docs, exhaustive), "near-rows")
    groups = rows.groupBy("label").agg(
        F.min(shown_id()).alias("class_id"), F.min("did").alias("first"), F.count(F.lit(1)).alias("class_size")
    )
    return rows.join(groups, "label").select(
        shown_id().alias("doc_id"), "class_id", "class_size", (F.col("did") == F.col("first")).alias("first_of_class")
    )


def kept_documents(docs: DataFrame, exhaustive: bool = False) -> DataFrame:
    """The rows of ``docs`` without near duplicates, with all their columns: of each class the row with
    the smallest id (then text hash); texts without words stay."""
    rows = written(classed(docs, exhaustive), "near-rows")
    first = rows.where("not empty").groupBy("label").agg(F.min(F.struct("did", "th")).alias("first"))
    kept = first.select("first.did", "first.th", F.lit(True).alias("once"))
    kept = kept.unionByName(rows.where("empty").select("did", "th", F.lit(False).alias("once")).distinct())
    kept = kept.withColumnsRenamed({"did": "__did", "th": "__th", "once": "__once"})
    on = (row_id() == F.col("__did")) & (F.hash(F.coalesce(F.col("text"), F.lit(""))) == F.col("__th"))
    found = docs.join(kept, on)
    # Repeated rows are one document.
    one = found.where("__once").dropDuplicates(["__did", "__th"])
    return one.unionByName(found.where("not __once")).select(*docs.columns)
