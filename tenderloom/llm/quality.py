"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

The score of a text is a logistic of ``b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``. The pairwise
part is worked out in time linear in the number of features, as
``1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``. Features are signed nowhere: hashed words by
damped frequency, scaled to one length, then structure statistics and the stored length.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.common import batches, fewest, row_id
from tenderloom.llm.stats import SHARES, measure

BITS, RANK = 15, 8
WORDS = 1 << BITS
EXTRA = len(SHARES) + 2
SIZE = WORDS + EXTRA
# Labelled rows that the model is fitted on at most: those with the smallest hash of their id.
FIT_ROWS = 12_000
SEED = 7
CACHE = 500_000


def held_out() -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


class Buckets(dict):
    """Bucket of each word met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        bucket = self[word] = zlib.crc32(word) & (WORDS - 1)
        return bucket


_buckets = Buckets()


def features(data: bytes, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values; the extra features are always there, also for an empty text."""
    counts = Counter(data.split())
    at = np.fromiter(map(_buckets.__getitem__, counts), np.int64, len(counts))
    x = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    if len(x):
        x /= np.sqrt((x * x).sum())
    sizes, shares = measure(data)
    length = len(data) if n_chars is None or n_chars < 0 else n_chars
    extra = np.array([*shares, np.log1p(sizes[0]), np.log1p(length)])
    return np.concatenate([at, np.arange(WORDS, SIZE)]), np.concatenate([x, np.minimum(extra, 1e6)])


class Machine:
    """Weights of the machine; values of extra features are standardised by ``mean`` and ``spread``."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.b, self.w = 0.0, np.zeros(SIZE)
        self.v = rng.normal(0, 0.02, (SIZE, RANK))

    def scaled(self, x: np.ndarray) -> np.ndarray:
        x = x.copy()
        x[-EXTRA:] = np.clip((x[-EXTRA:] - self.mean) / self.spread, -4, 4) / np.sqrt(EXTRA)
        return x

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        x = self.scaled(x)
        xv = x[:, None] * self.v[at]
        pairs = 0.5 * ((xv.sum(0) ** 2).sum() - (xv * xv).sum())
        z = self.b + float((self.w[at] * x).sum()) + float(pairs)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, passes: int = 6,
            rate: float = 0.1, shrink: float = 1e-5, block: int = 64) -> None:
        """AdaGrad on the logistic loss, in blocks of rows in a seeded order."""
        rng = np.random.default_rng(SEED)
        gb, gw, gv = 1e-6, np.full(SIZE, 1e-6), np.full((SIZE, RANK), 1e-6)
        rows = [(at, self.scaled(x)) for at, x in rows]
        for _ in range(passes):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), block):
                part = order[i : i + block]
                at = np.concatenate([rows[j][0] for j in part])
                x = np.concatenate([rows[j][1] for j in part])
                starts = np.cumsum([0] + [len(rows[j][0]) for j in part[:-1]])
                size = np.diff(np.append(starts, len(at)))
                v = self.v[at]
                xv = x[:, None] * v
                total = np.add.reduceat(xv, starts)
                pairs = 0.5 * ((total**2).sum(1) - np.add.reduceat(xv * xv, starts).sum(1))
                z = self.b + np.add.reduceat(self.w[at] * x, starts) + pairs
                slope = np.repeat((1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[part]) / len(part), size)
                own, back = np.unique(at, return_inverse=True)
                dw = np.bincount(back, slope * x, len(own)) + shrink * self.w[own]
                grad = (slope * x)[:, None] * (np.repeat(total, size, 0) - xv)
                dv = np.stack([np.bincount(back, grad[:, f], len(own)) for f in range(RANK)], 1)
                dv += shrink * self.v[own]
                db = slope[starts].sum() if len(starts) else 0.0
                gb += db * db
                gw[own] += dw * dw
                gv[own] += dv * dv
                self.b -= rate * db / np.sqrt(gb)
                self.w[own] -= rate * dw / np.sqrt(gw[own])
                self.v[own] -= rate * dv / np.sqrt(gv[own])


def _with_length(docs: DataFrame) -> DataFrame:
    length = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"),
        length.alias("n_chars"),
    )


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Machine:
    """A machine fitted on at most ``rows`` labelled documents, none of them held out."""
    good = (
        labels.where(F.col("quality").isNotNull())
        .groupBy(row_id().alias("did"))
        .agg(F.min("quality").alias("label"))
    )
    # The ids are chosen before any text is read, so that the join carries only their texts.
    own = docs.select("doc_id", row_id().alias("did")).where(~held_out()).select("did").distinct()
    ids = fewest(own.join(good, "did"), rows, SEED)
    chosen = _with_length(docs).join(F.broadcast(ids), row_id() == F.col("did"))
    # An id may be on any number of rows; one stands for it, so that the bound holds for rows as well.
    one = F.min(F.struct(F.xxhash64("data").alias("place"), "data", "n_chars")).alias("one")
    chosen = chosen.groupBy("did", "label").agg(one).select("did", "label", "one.data", "one.n_chars")

    def run(frames):
        for _, ids, labels_, data, lengths in batches(frames, "did", "label", "data", "n_chars"):
            found = [features(d, n) for d, n in zip(data, lengths)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(labels_, pa.int32()),
                    pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())),
                    pa.array([f[1].astype(np.float32) for f in found], pa.list_(pa.float32())),
                ],
                ["did", "label", "at", "x"],
            )

    wide = chosen.mapInArrow(
        run, "did long, label int, at array<int>, x array<float>"
    )
    taken = sorted(
        ((r.did, r.label, np.array(r.at, np.int64), np.array(r.x, np.float64)) for r in wide.toLocalIterator()),
        key=lambda r: (r[0], r[1], len(r[2]), r[3].tobytes()),
    )
    extra = np.array([r[3][-EXTRA:] for r in taken]).reshape(-1, EXTRA)
    mean = extra.mean(0) if len(extra) else np.zeros(EXTRA)
    spread = extra.std(0) + 1e-3 if len(extra) else np.ones(EXTRA)
    machine = Machine(mean, spread)
    if taken:
        machine.fit([(r[2], r[3]) for r in taken], np.array([r[1] for r in taken], float))
    return machine


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: ``held_out``, ``score`` and ``predicted`` (1 from ``threshold`` on).

    A null or empty text is scored by its structure alone; a null id is never held out; repeated rows
    are scored each; without labels every score is 0.5; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows))

    def run(frames):
        machine = shared.value
        for batch, data, lengths in batches(frames, "data", "n_chars"):
            scores = [float(machine.score(*features(d, n))) for d, n in zip(data, lengths)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= threshold) for s in scores], pa.int32()),
                ],
                ["doc_id", "held_out", "score", "predicted"],
            )

    rows_ = _with_length(docs).withColumn("held_out", held_out())
    return rows_.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
