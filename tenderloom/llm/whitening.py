"""Whitening of embeddings with MLlib's block matrices.

Each distinct vector, on an integer grid, is a row of a distributed matrix of blocks of centred rows. Its
transpose times itself is the scatter matrix, which is as large as a vector is long, squared, and whose
eigenvectors are found on the driver. The matrix times the whitening matrix projects the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom.llm.common import written

# Grid points of one, and components returned.
GRID, COMPONENTS = 256, 4
# Beyond this an entry of the grid is not one number of a double any more; larger ones become it.
LARGEST = 2**52
# Numbers in a block, about.
BLOCK_CELLS = 2**18
SCHEMA = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def grid_rows(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, x, key)`` of the rows with a whole vector of finite numbers; shorter vectors are filled
    up with zeros. ``key`` is a hash that stands for ``x``."""
    vector = F.col("embedding")
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = embeddings.where(vector.isNotNull() & ~bad)
    longest = kept.agg(F.max(F.size(vector))).first()[0] or 0
    scaled = F.transform(vector, lambda c: c.cast("double") * GRID)
    x = F.transform(scaled, lambda c: F.floor(F.greatest(F.least(c, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))))
    filled = F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(longest) - F.size(x)))
    narrow = kept.select(F.col("vec_id").cast("long").alias("vec_id"), filled.alias("x"))
    return narrow.withColumn("key", F.unhex(F.sha2(F.array_join("x", ",").cast("binary"), 256)))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """``(key, x, index)``: each vector once, numbered from 0 without a gap."""
    one = rows.groupBy("key").agg(F.first("x").alias("x"))
    one = written(one.withColumn("mark", F.monotonically_increasing_id()), "white-vectors")
    part = F.shiftright("mark", 33)
    # A row for each task that wrote vectors.
    sizes = sorted(one.groupBy(part.alias("part")).count().collect())
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    starts = one.sparkSession.createDataFrame(
        [(p, b) for (p, _), b in zip(sizes, before)], "part long, before long"
    )
    index = F.col("before") + F.col("mark").bitwiseAND(2**33 - 1)
    return one.join(F.broadcast(starts), part == F.col("part")).select("key", "x", index.alias("index"))


def _as_matrix(column: pa.Array) -> np.ndarray:
    flat = pa.concat_arrays([column]).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def sums(vectors: DataFrame) -> list[int]:
    """The exact sum of each dimension; a task sends one number for each."""

    def run(frames):
        total = None
        for batch in frames:
            if batch.num_rows:
                x = _as_matrix(batch.column("x"))
                wide = np.abs(x).max(initial=0) * len(x) >= 2**62
                now = (x.astype(object) if wide else x).sum(axis=0)
                total = [int(v) + w for v, w in zip(now, total or [0] * len(now))]
        if total:
            places = pa.array(range(len(total)), pa.int32())
            values = pa.array([str(v) for v in total], pa.string())
            yield pa.RecordBatch.from_arrays([places, values], ["i", "s"])

    parts = vectors.select("x").mapInArrow(run, "i int, s string")
    found = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    return [int(r["s"]) for r in sorted(found)]


def _deviations(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """``n * x - s``, exactly; as Python numbers where 64 bits might not hold the sum of squares."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, s))
    if most * most * len(s) < 2**63:
        return n * x - np.array(s, np.int64)
    return n * x.astype(object) - np.array(s, object)


def deviations(vectors: DataFrame, n: int, s: list[int]) -> DataFrame:
    """``(key, index, deviation)``: the sum of squares of ``n * x - s``, null beyond 64 bits."""

    def run(frames):
        for batch in frames:
            if batch.num_rows:
                total = (_deviations(_as_matrix(batch.column("x")), n, s) ** 2).sum(axis=1).tolist()
                held = pa.array([v if v < 2**63 else None for v in total], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), batch.column("index"), held], ["key", "index", "deviation"]
                )

    return vectors.mapInArrow(run, "key binary, index long, deviation long")


def centred_blocks(vectors: DataFrame, n: int, s: list[int], rows: int) -> DataFrame:
    """``(block, cells)``: ``rows`` centred vectors each, column after column; the last is filled with zeros."""

    def run(frames):
        for batch in frames:
            out = []
            for members in batch.column("members").to_pylist():
                cells = np.zeros((rows, len(s)))
                at = [m["place"] for m in members]
                cells[at] = (_deviations(np.array([m["x"] for m in members]), n, s) / n).astype(float)
                out.append(cells.T.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, pa.binary())], ["block", "cells"])

    member = F.struct((F.col("index") % rows).cast("int").alias("place"), "x")
    gathered = vectors.groupBy(F.floor(F.col("index") / rows).cast("int").alias("block")).agg(
        F.collect_list(member).alias("members")
    )
    return written(gathered.mapInArrow(run, "block int, cells binary"), "white-blocks")


def block_matrix(blocks: DataFrame, rows: int, columns: int, groups: int = 1) -> BlockMatrix:
    """The blocks below one another. With ``groups`` those of each group stand in columns of their own."""

    def place(r):
        cells = np.frombuffer(r["cells"])
        return (r["block"], r["block"] % groups), DenseMatrix(rows, columns, cells)

    return BlockMatrix(blocks.rdd.map(place), rows, columns)


def scatter(blocks: DataFrame, rows: int, columns: int, n_blocks: int) -> np.ndarray:
    """The transpose times the matrix. The right factor's blocks stand in several columns, so that as many
    tasks each multiply a share of the blocks; as one column they would all meet in one task."""
    groups = max(1, min(n_blocks, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    left = block_matrix(blocks, rows, columns).transpose()
    parts = left.multiply(block_matrix(blocks, rows, columns, groups)).blocks
    return parts.map(lambda b: b[1].toArray()).treeReduce(np.add)


def projected(blocks: DataFrame, rows: int, columns: int, by: np.ndarray) -> DataFrame:
    """``(index, white)``: each row of the matrix times ``by``."""
    spark, width = blocks.sparkSession, by.shape[1]
    one = spark.sparkContext.parallelize([((0, 0), DenseMatrix(*by.shape, by.ravel("F")))], 1)
    product = block_matrix(blocks, rows, columns).multiply(BlockMatrix(one, columns, width))

    def unblock(b):
        (i, _), matrix = b
        for place, values in enumerate(matrix.toArray().tolist()):
            yield i * rows + place, values

    return spark.createDataFrame(product.blocks.flatMap(unblock), "index long, white array<double>")


def identity_error(white: DataFrame, n: int, width: int) -> float:
    """Largest absolute entry of the projections' covariance less the identity."""
    names = [F.col("white")[i] for i in range(width)]
    mean = white.agg(*[F.avg(c) for c in names]).first()
    pairs = [(i, j) for i in range(width) for j in range(i + 1)]
    found = white.agg(*[F.sum((names[i] - mean[i]) * (names[j] - mean[j])) for i, j in pairs]).first()
    return max(abs(v / n - (i == j)) for v, (i, j) in zip(found, pairs))


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def whitened_vectors(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each row with a usable vector and each component.

    A vector that is null or holds a null, NaN or infinite entry is left out. Entries become whole numbers
    ``floor(256 * c)``, at most 2**52 in size. Means and covariances are those of the distinct vectors, so
    copies weigh nothing; each row is returned, repeated ones and null ids too. Vectors shorter than the
    longest are filled up with zeros; there are at most as many components as dimensions, and none for an
    empty table or if all vectors are empty. A component without variance (all vectors equal, for
    instance) has null as ``whitened``, and as ``identity_error`` if there is no other; ``explained`` is
    null where there is no variance at all. ``deviation`` is null if 64 bits cannot hold it. Extra columns are
    ignored, whatever their names. Of equal eigenvalues either order may be found.
    """
    spark = embeddings.sparkSession
    rows = written(grid_rows(embeddings), "white-rows")
    vectors = written(distinct_vectors(rows), "white-fit")
    n, s = vectors.count(), sums(vectors)
    d = len(s)
    if not n or not d:
        return _none(spark)
    height = max(1, min(4096, BLOCK_CELLS // d, n))
    blocks, n_blocks = centred_blocks(vectors, n, s, height), -(-n // height)
    covariance = scatter(blocks, height, d, n_blocks) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    total = float(np.trace(covariance))
    width = min(components, d)
    real = int((values[:width] > total * d * np.finfo(float).eps).sum()) if total > 0 else 0
    told = deviations(vectors, n, s)
    error = None
    if real:
        white = written(projected(blocks, height, d, axes[:, :real] / np.sqrt(values[:real])), "white-projected")
        # The last block's filling has no vector.
        white = white.where(F.col("index") < n)
        error = float(identity_error(white, n, real))
        told = told.join(white.hint("merge"), "index")
    else:
        told = told.withColumn("white", F.array().cast("array<double>"))
    told = written(told.select("key", "deviation", "white"), "white-told")
    shares = [float(v) / total if total > 0 else None for v in values[:width]]
    each = [
        F.struct(
            F.lit(i + 1).alias("component"),
            (F.col("white")[i] if i < real else F.lit(None).cast("double")).alias("whitened"),
            F.lit(shares[i]).cast("double").alias("explained"),
        )
        for i in range(width)
    ]
    # Both sides are tables, so that Spark can split the rows of a vector that is everywhere.
    found = rows.select("vec_id", "key").join(told.hint("merge"), "key")
    return found.select("vec_id", "deviation", F.inline(F.array(*each))).select(
        "vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained",
        F.lit(error).cast("double").alias("identity_error"),
    )
