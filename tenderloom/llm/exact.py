"""Exact duplicates by two passes with a Bloom filter, in DataFrame operations alone.

The first pass sets two positions for each text's hash in a filter and keeps those that were set more than
once. The second pass asks the filter: a hash that misses a repeated position stands alone, and its row
passes straight through. Only rows whose hash is possibly repeated are shuffled, to be told apart exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Positions for each row, and the most there are: a filter is no larger than 128 MB. With more rows than
# about a sixteenth of that, more rows that stand alone are shuffled too; the result is the same.
BITS_A_ROW, MOST_BITS = 16, 2**30
SEEDS = (11, 12)


def folded(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed; a null is empty."""
    text = F.coalesce(text, F.lit(""))
    # Lower-casing text of one-byte characters changes A-Z only, and is much the faster way.
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_sha256(text: Column) -> Column:
    return F.sha2(folded(text).cast("binary"), 256)


def filter_bits(rows: int, most: int = MOST_BITS) -> int:
    """A power of two, for ``BITS_A_ROW`` positions a row where that is allowed."""
    return min(most, max(2**15, 1 << (BITS_A_ROW * max(rows, 1) - 1).bit_length()))


def _positions(key: str, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits)) + 1 for seed in SEEDS]


def repeated_positions(hashes: DataFrame, key: str, bits: int) -> DataFrame:
    """``(bucket, bitmap)`` of the filter's positions that more than one row set. A task sends each
    position once, however many of its rows set it."""
    found = hashes.select(F.explode(F.array_distinct(F.array(*_positions(key, bits)))).alias("at"))
    often = found.groupBy("at").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return often.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap")
    )


def with_possible(rows: DataFrame, key: str, positions: DataFrame, bits: int, name: str) -> DataFrame:
    """The rows with a column ``name``: whether the key is possibly repeated. Never false for one that is."""
    out, possible = rows, F.lit(True)
    inner = [f"{name}_{i}" for i in range(len(SEEDS))]
    for column, at in zip(inner, _positions(key, bits)):
        # At most ``bits`` bits in all: one row of 4 kB for 32,768 of them.
        side = F.broadcast(positions.select(F.col("bucket").alias(f"{column}_b"), F.col("bitmap").alias(column)))
        out = out.join(side, F.bitmap_bucket_number(at) == F.col(f"{column}_b"), "left")
        place = F.bitmap_bit_position(at)
        byte = F.substring(F.col(column), (place / 8).cast("int") + 1, F.lit(1))
        hit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), F.pmod(place, F.lit(8)).cast("int")) == 1
        possible = possible & F.coalesce(hit, F.lit(False))
    return out.withColumn(name, possible).select(*rows.columns, name)


def exact_dedup(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per document: the id of the row that stays for its text, how many rows have that text,
    whether this row stays, and the hash of the text.

    Texts are equal when they are the same after lower-casing A-Z, so null and empty texts are one; a
    text of any length is hashed whole. Of equal texts the row with the largest id stays, a null id
    being the smallest; of rows repeated with id and text one stays. Extra columns are ignored, whatever
    their names; an empty table gives an empty one. Equality is taken from SHA-256.
    """
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_sha256(F.col("text")).alias("text_sha256"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = written(narrow, "exact-rows")
    bits = filter_bits(rows.count(), most_bits)
    positions = written(repeated_positions(rows, "text_sha256", bits), "exact-positions")
    asked = with_possible(rows, "text_sha256", positions, bits, "possible")
    possible = written(asked.where("possible").drop("possible"), "exact-possible")
    # A task sends one row for each text. Written, so that a text with a third of all rows can be split below.
    groups = possible.groupBy("text_sha256").agg(
        F.max(F.struct("doc_id", "row")).alias("stays"), F.count(F.lit(1)).alias("group_size")
    )
    groups = written(groups, "exact-groups")
    told = possible.join(groups.hint("merge"), "text_sha256").select(
        "doc_id",
        F.col("stays.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("stays.row")).alias("kept"),
        "text_sha256",
    )
    alone = asked.where("not possible").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "text_sha256",
    )
    return alone.unionByName(told)


def distinct_documents(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows that stand alone never move; of
    the others each task sends one for each text. Of equal texts with equal ids any one stays."""
    own = "_exact" + "_" * max((len(c) for c in docs.columns), default=0)
    keyed = docs.withColumn(own, text_sha256(F.col("text")))
    bits = filter_bits(docs.count(), most_bits)
    positions = written(repeated_positions(keyed, own, bits), "exact-positions")
    asked = with_possible(keyed, own, positions, bits, own + "p")
    row = F.struct(*[F.col(c) for c in docs.columns])
    order = F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"))
    last = asked.where(F.col(own + "p")).groupBy(own).agg(F.max_by(row, order).alias("row")).select("row.*")
    return asked.where(~F.col(own + "p")).select(*docs.columns).unionByName(last)


def sql() -> str:
    """The same in DuckDB's SQL."""
    return f"""
      WITH hashed AS (
        SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents
      )
      SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
        row_number() OVER w = 1 AS kept, text_sha256
      FROM hashed WINDOW w AS (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST)"""
