"""Tables on plain files: batches that can be replayed, current views over them, point reads.

Plain files have no merge, so a table of versions is only ever appended to. Each batch owns one
folder and replaces it when it is run again, which makes a replay harmless; the current row of a
key is found on reading.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tenderloom.functions.values import uuid_bytes, uuid_text
from tenderloom.schemas import FEEDBACK


# Ids are random, so only a code for their 16 digits makes them smaller.
_CODEC = "zstd"


def write_batch(rows: DataFrame, path: str, batch: int) -> None:
    """Write one batch of an append-only table, replacing an earlier run of the same batch."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch}", compression=_CODEC)


def read_batches(
    spark: SparkSession, path: str, schema: StructType, before: int | None = None
) -> DataFrame:
    """All batches, or those before a given one (what a replayed batch may look at)."""
    layout = StructType([*schema.fields]).add("batch_id", LongType())
    try:
        rows = spark.read.schema(layout).option("basePath", path).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        # A table nobody has written to yet.
        rows = spark.createDataFrame([], layout)
    return rows if before is None else rows.filter(F.col("batch_id") < before)


def current_rows(versions: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last version of every key. Aggregates before the shuffle."""
    rest = [c for c in versions.columns if c != key]
    return (
        versions.groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(key, "_row.*")
    )


def find(rows: DataFrame, **equals: str) -> DataFrame:
    """Point read: a notice by control number, matches by id or by profile."""
    for column, value in equals.items():
        rows = rows.filter(F.col(column) == F.lit(value))
    return rows


def upsert(rows: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Next state of a table whose key is derived from its content, such as matches: an incoming
    row takes the place of the stored one. Of several incoming rows of a key one is stored, the
    greatest by its columns from left to right."""
    rest = [c for c in incoming.columns if c != key]
    one = incoming.groupBy(key).agg(F.max(F.struct(*rest)).alias("_row"))
    one = one.select(key, "_row.*").select(*rows.columns)
    return rows.join(one.select(key), key, "left_anti").unionByName(one)


BUCKETS = 256


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _packed(rows: DataFrame, *ids: str) -> DataFrame:
    """Rows whose ids, where they are UUIDs, are bytes while they travel; ``_unpacked`` makes texts of them again."""
    bytes_of = {f"_{i}_bytes": uuid_bytes(F.col(i)) for i in ids}
    rows = rows.withColumns(bytes_of)
    return rows.withColumns({i: F.when(F.col(f"_{i}_bytes").isNull(), F.col(i)) for i in ids})


def _unpacked(rows: DataFrame, *ids: str) -> DataFrame:
    texts = {i: F.coalesce(uuid_text(F.col(f"_{i}_bytes")), F.col(i)) for i in ids}
    return rows.withColumns(texts).drop(*[f"_{i}_bytes" for i in ids])


def _write_buckets(rows: DataFrame, path: str, replaced: str) -> None:
    """Rows in folders by their ``bucket``, which replace those they fall into (``dynamic``) or all (``static``)."""
    write = rows.write.partitionBy("bucket").option("partitionOverwriteMode", replaced).mode("overwrite")
    write.parquet(path, compression=_CODEC)


def store_keyed(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS, placed: bool = False) -> None:
    """Store a table in folders by the key's hash. Only the folders that ``rows`` fall into are replaced.
    A large bucket is written by several tasks, to a file each, so that tasks grow in number, not in size.
    Rows that are ``placed`` were read from a table of as many buckets and have their ``bucket``; they are
    written as they lie, and nothing is dealt anew."""
    if not placed:
        rows = rows.withColumn("bucket", bucket_of(F.col(key), buckets))
        rows = _unpacked(_packed(rows, key).hint("rebalance", "bucket"), key)
    _write_buckets(rows, path, "dynamic")


def read_keyed(spark: SparkSession, path: str, layout: StructType) -> DataFrame:
    """A stored table with its ``bucket``."""
    return spark.read.schema(StructType([*layout.fields, StructField("bucket", IntegerType())])).parquet(path)


def find_keyed(rows: DataFrame, key: str, value: str, buckets: int = BUCKETS) -> DataFrame:
    """Point read by key: no bucket but the key's is opened."""
    wanted = F.lit(value)
    return rows.filter((F.col("bucket") == bucket_of(wanted, buckets)) & (F.col(key) == wanted)).drop("bucket")


# Parts of a stored table for each task that an upsert has, so that these get about as much each.
_SLICES = 8


def _upsert_placed(held: DataFrame, incoming: DataFrame, key: str, buckets: int) -> DataFrame:
    """``upsert`` of a stored table's rows, with their ``bucket``. Both sides travel once, to where slices of
    buckets meet, so that the next state can be written as it lies."""
    tasks = int(incoming.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = buckets * -(-tasks * _SLICES // buckets)
    both = held.select(*incoming.columns, F.lit(False).alias("_new")).unionByName(
        incoming.withColumn("_new", F.lit(True))
    )
    both = _packed(both.withColumn("_slice", bucket_of(F.col(key), slices)), key).repartition("_slice")
    rest = [F.col(c).desc_nulls_last() for c in incoming.columns if c != key]
    of_key = W.partitionBy(f"_{key}_bytes", key, "_slice").orderBy(F.col("_new").desc(), *rest)
    ranked = both.withColumns({"_rank": F.row_number().over(of_key), "_first": F.first("_new").over(of_key)})
    # One incoming row of a key, or what is stored of it; rows without a key replace none.
    keyless = F.col(f"_{key}_bytes").isNull() & F.col(key).isNull()
    kept = ranked.filter((F.col("_rank") == 1) | ~F.col("_first") | (keyless & ~F.col("_new")))
    kept = kept.withColumn("bucket", F.col("_slice") % buckets)
    return _unpacked(kept, key).select(*incoming.columns, "bucket")


def upsert_keyed(incoming: DataFrame, path: str, key: str, scratch: str, buckets: int = BUCKETS) -> list[int]:
    """``upsert`` into a stored table. Only buckets that incoming rows fall into are read and written, so
    a batch costs what it touches, however many came before. Returns these buckets, of which there are at
    most ``buckets``. The next state is whole in ``scratch`` before any bucket is replaced; a batch that
    broke off is mended by running it again, which gives the same rows."""
    spark = incoming.sparkSession
    touched = incoming.select(bucket_of(F.col(key), buckets).alias("b")).distinct()
    touched = sorted(r["b"] for r in touched.collect())
    if not touched:
        return []
    held = read_keyed(spark, path, incoming.schema).filter(F.col("bucket").isin(touched))
    _write_buckets(_upsert_placed(held, incoming, key, buckets), scratch, "static")
    store_keyed(read_keyed(spark, scratch, incoming.schema), path, key, buckets, placed=True)
    return touched


def feedback_events(match_ids: DataFrame, verdict: Column, given_at: Column) -> DataFrame:
    """Feedback to append: every judgement is a new event with its own id."""
    return match_ids.select(
        F.expr("uuid()").alias("feedback_id"),
        "match_id",
        verdict.alias("verdict"),
        given_at.alias("given_at"),
    ).select(*FEEDBACK.fieldNames())


def latest_verdicts(feedback: DataFrame, *also: Column) -> DataFrame:
    """The last word per match, and what else is to be worked out of its events. That may be a count of
    distinct ids, which needs every event, so then each travels once, its ids as bytes."""
    if not also:
        return feedback.groupBy("match_id").agg(
            F.max(F.struct("given_at", "feedback_id", "verdict")).alias("_last")
        ).select("match_id", "_last.verdict", "_last.given_at")
    match = ["_match_id_bytes", "match_id"]
    events = _packed(feedback.select(*FEEDBACK.fieldNames()), "match_id", "feedback_id").repartition(*match)
    told = _unpacked(events, "feedback_id").groupBy(*match).agg(
        F.max(F.struct("given_at", "feedback_id", "verdict")).alias("_last"), *also
    )
    more = [c for c in told.columns if c not in (*match, "_last")]
    return _unpacked(told, "match_id").select("match_id", "_last.verdict", "_last.given_at", *more)
