"""What the corpus operators share: reading tables, row keys, scratch tables, kept text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom.session import shared_folder

# Stands in for a null doc_id inside the operators, so that joins and orders see it: the smallest.
NO_ID = -(2**63)
SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``(did, th, data)`` of each row: a non-null id, a hash that tells rows with one id apart, and
    the text as UTF-8 bytes (null: empty). Other columns are left behind, so none can clash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(row_id().alias("did"), F.hash(text).alias("th"), text.cast("binary").alias("data"))


def row_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def shown_id(column: str = "did") -> Column:
    """The id as it was given."""
    return F.when(F.col(column) != NO_ID, F.col(column))


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder: later steps don't repeat the work
    that made them, and a lost executor loses none of them."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batches(frames: Iterator, *names: str) -> Iterator[tuple]:
    """Each Arrow batch with the named columns as Python lists."""
    for batch in frames:
        yield (batch, *[batch.column(n).to_pylist() for n in names])


def fewest(df: DataFrame, rows: int, seed: int, *ties: str) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hash of ``did``. With many more, tasks first leave
    out what can hardly be among them, or each would send as many as are wanted in all."""
    span = 2**40
    place = F.pmod(F.xxhash64("did", F.lit(seed)), F.lit(span))
    n = df.count()
    if n > rows:
        df = df.where(place <= int(1.25 * rows / n * span))
    return df.orderBy(place, "did", *ties).limit(rows)


def structs(column: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A column of lists of structs of numbers as the place where each row's list starts (and the last
    one ends) in arrays of the fields; a null is an empty list."""
    column = pa.concat_arrays([column])
    values = column.values
    fields = {f.name: values.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(values.type)}
    return column.offsets.to_numpy(), fields


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open intervals as their maximal runs, in order; touching ones become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], starts[1:] > ends[:-1]])
    last = np.concatenate([first[1:], [True]])
    return starts[first], ends[last]


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each element of ``a``."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & where.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()
