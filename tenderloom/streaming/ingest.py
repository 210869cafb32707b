"""Continuous ingestion of the message stream.

Per control number the state is the stored hash and time, nothing else, and it never expires: how
late a message is gets counted, never used to drop it. There is no watermark for that reason.
Numbers are kept in buckets by their hash and their rows travel as texts, since a call of the function that
judges them, and every column it gets, cost more than judging does.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tenderloom.operators.consume import deliveries, quarantine, read_messages
from tenderloom.operators.ingest import HASH, KEY, TIME, last_stored, verdicts_against
from tenderloom.operators.reports import lateness
from tenderloom.schemas import ARRIVAL, NOTICES
from tenderloom.sources.tables import bucket_of, current_rows, read_batches, write_batch
from tenderloom.vocabulary import STALE, STORED, UNCHANGED

_STATE = T.StructType(
    [T.StructField("hash", T.StringType()), T.StructField("time", T.TimestampType())]
)
# Numbers of one bucket are judged by one call and share an entry of the state store, so a checkpoint holds
# for one number of buckets.
STATE_BUCKETS = 4096
# The numbers of a bucket as JSON: [number, hash, microseconds].
_BUCKET_STATE = T.StructType([T.StructField("stored", T.StringType())])


def _place(arrival: Any) -> tuple:
    """An arrival as something to sort by: a number, or fields compared one by one, nulls first."""
    if hasattr(arrival, "asDict"):
        arrival = arrival.asDict()
    parts = arrival.values() if isinstance(arrival, dict) else [arrival]
    return tuple((part is not None, part) for part in parts)


def _outcomes(order: list[int], hashes: list, times: list, stored: tuple, outcomes: list[str]) -> tuple:
    """Fill in the outcomes of one number's deliveries, whose places ``order`` has from the first arrival on.
    Returns the hash and time they leave stored."""
    stored_hash, stored_time = stored
    for i in order:
        new_hash, new_time = hashes[i], times[i]
        if stored_hash is None:
            outcome = STORED
        elif new_hash == stored_hash:
            outcome = UNCHANGED
        elif new_time is not None and stored_time is not None and new_time < stored_time:
            outcome = STALE
        else:
            outcome = STORED
        if outcome == STORED:
            stored_hash, stored_time = new_hash, new_time
        outcomes[i] = outcome
    return stored_hash, stored_time


def _decide(
    _key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """Verdicts of one control number's deliveries of a micro-batch, taken in arrival order; the rows stay as
    they came, as most numbers have few and moving them costs more than deciding on them."""
    # A micro-batch is bounded by the source's trigger limits.
    frames = list(batches)
    rows = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
    places = list(map(_place, rows["seq"]))
    times = [None if pd.isna(t) else t for t in rows[TIME]]
    outcomes = [STORED] * len(places)
    order = sorted(range(len(places)), key=places.__getitem__)
    stored = _outcomes(order, list(rows[HASH]), times, state.getOption or (None, None), outcomes)
    state.update((stored[0], None if stored[1] is None else pd.Timestamp(stored[1]).to_pydatetime()))
    rows = rows.copy(deep=False)
    rows["outcome"] = outcomes
    yield rows


def _to_texts(column: Column, kind: T.DataType) -> list[Column]:
    """A column as texts, of which ``_from_texts`` makes the same column again."""
    if isinstance(kind, T.StructType):
        parts = [text for f in kind.fields for text in _to_texts(column[f.name], f.dataType)]
        return [F.when(column.isNotNull(), F.lit("")), *parts]
    if isinstance(kind, T.TimestampType):
        column = F.unix_micros(column)
    elif isinstance(kind, T.DateType):
        column = F.unix_date(column)
    return [column.cast("string")]


def _from_texts(texts: Iterator[Column], kind: T.DataType) -> Column:
    text = next(texts)
    if isinstance(kind, T.StructType):
        parts = [_from_texts(texts, f.dataType).alias(f.name) for f in kind.fields]
        return F.when(text.isNotNull(), F.struct(*parts))
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(text.cast("bigint"))
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(text.cast("int"))
    return text.cast(kind)


def _readers(kind: T.DataType) -> list[Callable]:
    """What makes texts of ``_to_texts`` comparable."""
    if isinstance(kind, T.StructType):
        return [str, *[reader for f in kind.fields for reader in _readers(f.dataType)]]
    if isinstance(kind, (T.TimestampType, T.DateType, T.IntegralType)):
        return [int]
    return [{T.DecimalType: Decimal, T.DoubleType: float, T.FloatType: float}.get(type(kind), str)]


def _bucket_decider(schema: T.StructType) -> Callable:
    """``_decide`` for all control numbers of a bucket at once, whose rows are texts."""
    start, at = {}, 0
    for f in schema.fields:
        start[f.name], at = at, at + len(_readers(f.dataType))
    key_at, hash_at, time_at, seq_at = (start[c] for c in (KEY, HASH, TIME, "seq"))
    readers = _readers(schema["seq"].dataType)

    def place(row) -> tuple:
        parts = row[seq_at : seq_at + len(readers)]
        return tuple((p is not None, p if p is None else read(p)) for p, read in zip(parts, readers))

    def decide(_key: tuple[int], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {number: (h, t) for number, h, t in json.loads(state.getOption[0])} if state.exists else {}
        # A micro-batch is bounded by the source's trigger limits.
        rows = [row for frame in batches for row in frame["_row"]]
        hashes = [row[hash_at] for row in rows]
        times = [None if row[time_at] is None else int(row[time_at]) for row in rows]
        outcomes = [STORED] * len(rows)
        found: dict[str, list[int]] = {}
        for i, row in enumerate(rows):
            found.setdefault(row[key_at], []).append(i)
        for number, order in found.items():
            if len(order) > 1:
                order.sort(key=lambda i: place(rows[i]))
            held[number] = _outcomes(order, hashes, times, held.get(number, (None, None)), outcomes)
        state.update((json.dumps([(number, *stored) for number, stored in held.items()]),))
        yield pd.DataFrame({"_row": rows, "outcome": outcomes})

    return decide


def keyed_verdicts(arrivals: DataFrame, buckets: int = STATE_BUCKETS) -> DataFrame:
    """Verdicts over a stream of deliveries, with keyed state in the state store: an entry for each of
    ``buckets``, or with 0 of them for each control number, as checkpoints of before have it."""
    outcome = T.StructField("outcome", T.StringType())
    if not buckets:
        schema = T.StructType([*arrivals.schema.fields, outcome])
        return arrivals.groupBy(KEY).applyInPandasWithState(
            _decide, schema, _STATE, "append", GroupStateTimeout.NoTimeout
        )
    fields = arrivals.schema.fields
    texts = [text for f in fields for text in _to_texts(F.col(f.name), f.dataType)]
    carried = T.StructType([T.StructField("_row", T.ArrayType(T.StringType())), outcome])
    decided = (
        arrivals.select(bucket_of(F.col(KEY), buckets).alias("_bucket"), F.array(*texts).alias("_row"))
        .groupBy("_bucket")
        .applyInPandasWithState(
            _bucket_decider(arrivals.schema), carried, _BUCKET_STATE, "append", GroupStateTimeout.NoTimeout
        )
    )
    places = (F.get("_row", F.lit(i)) for i in range(len(texts)))
    return decided.select(*[_from_texts(places, f.dataType).alias(f.name) for f in fields], "outcome")


def stream_deliveries(messages: DataFrame) -> DataFrame:
    """The readable messages of a stream as deliveries."""
    return deliveries(read_messages(messages))


def start_keyed_ingest(
    messages: DataFrame, folder: str, now: Column | None = None, buckets: int = STATE_BUCKETS, **trigger
) -> StreamingQuery:
    """Ingest with the state store holding the stored hash and time of every notice.

    Nothing is read back from the tables, so a micro-batch costs what it carries. Each micro-batch
    writes its verdicts, and how late what it stored came, under its own id and replaces them when
    replayed after a failure.
    """
    decided = keyed_verdicts(stream_deliveries(messages), buckets)
    seen_at = F.current_timestamp() if now is None else now

    def sink(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        write_batch(lateness(kept.filter(F.col("outcome") == STORED), seen_at), f"{folder}/lateness", batch_id)
        write_batch(kept, f"{folder}/verdicts", batch_id)
        kept.unpersist()

    return (
        decided.writeStream.foreachBatch(sink)
        .option("checkpointLocation", f"{folder}/checkpoints/verdicts")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_quarantine(messages: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Keep the messages that cannot be consumed."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        write_batch(quarantine(read_messages(batch)), f"{folder}/quarantine", batch_id)

    return (
        messages.writeStream.foreachBatch(sink)
        .option("checkpointLocation", f"{folder}/checkpoints/quarantine")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_batch_ingest(
    messages: DataFrame, folder: str, now: Column | None = None, **trigger
) -> StreamingQuery:
    """Ingest whole micro-batches against the stored table.

    Suits few, large micro-batches, where one control number may carry a large share of the
    messages: its deliveries are cut into blocks as in the batch job. Writes versions, verdict
    counts, lateness and quarantine, all under the micro-batch's id; the versions go last, so a
    crash in between is replayed and finds the table as it was.
    """
    seen_at = F.current_timestamp() if now is None else now
    layout = T.StructType([T.StructField("seq", ARRIVAL), *NOTICES.fields])

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        read = read_messages(batch).persist()
        versions = read_batches(spark, f"{folder}/versions", layout, before=batch_id)
        current = current_rows(versions, KEY, ["batch_id", "seq"]).drop("seq", "batch_id")
        decided = verdicts_against(deliveries(read), current, hash_covers_time=True).persist()
        write_batch(quarantine(read), f"{folder}/quarantine", batch_id)
        write_batch(
            decided.groupBy("outcome").agg(F.count(F.lit(1)).alias("messages")),
            f"{folder}/outcomes",
            batch_id,
        )
        write_batch(
            lateness(decided.filter(F.col("outcome") == STORED), seen_at),
            f"{folder}/lateness",
            batch_id,
        )
        write_batch(last_stored(decided).select(*layout.fieldNames()), f"{folder}/versions", batch_id)
        decided.unpersist()
        read.unpersist()

    return (
        messages.writeStream.foreachBatch(sink)
        .option("checkpointLocation", f"{folder}/checkpoints/ingest")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def keyed_notices(spark, folder: str) -> DataFrame:
    """The notices table as the keyed ingest left it: the last stored delivery of every number."""
    layout = T.StructType(
        [
            T.StructField("seq", ARRIVAL),
            *NOTICES.fields,
            T.StructField("outcome", T.StringType()),
        ]
    )
    stored = read_batches(spark, f"{folder}/verdicts", layout).filter(F.col("outcome") == STORED)
    return current_rows(stored, KEY, ["batch_id", "seq"]).select(*NOTICES.fieldNames())


def current_notices(spark, folder: str) -> DataFrame:
    """The notices table the batch ingest maintains."""
    layout = T.StructType([T.StructField("seq", ARRIVAL), *NOTICES.fields])
    versions = read_batches(spark, f"{folder}/versions", layout)
    return current_rows(versions, KEY, ["batch_id", "seq"]).select(*NOTICES.fieldNames())


__all__ = [
    "current_notices",
    "keyed_notices",
    "keyed_verdicts",
    "start_batch_ingest",
    "start_keyed_ingest",
    "start_quarantine",
    "stream_deliveries",
]
