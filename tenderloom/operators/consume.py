"""From messages to deliveries: check the contract, map again, keep what cannot be read.

The hash and the time a message carries are not trusted; both come from its payload.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom import vocabulary as V
from tenderloom.operators.mapping import map_notices, with_change_token
from tenderloom.schemas import MESSAGES, NOTICES
from tenderloom.sources.messages import contract_fault, version_fault


def read_messages(messages: DataFrame) -> DataFrame:
    """Messages with their mapping and a ``fault`` naming why one cannot be consumed."""
    checked = messages.select(
        *[
            F.col(n).alias({"control_number": "message_control", "source_updated_at": "stamp"}.get(n, n))
            for n in MESSAGES.fieldNames()
        ],
        F.coalesce(contract_fault(), version_fault()).alias("contract_fault"),
    )
    readable = checked.withColumn(
        "payload", F.when(F.col("contract_fault").isNull(), F.col("raw_payload"))
    )
    # The hash is taken here, so that a payload without one is kept aside instead of ingested.
    mapped = with_change_token(map_notices(readable))
    fault = F.when(F.col("contract_fault").isNotNull(), F.col("contract_fault")).when(
        F.col("outcome") == V.REJECTED,
        F.concat(
            F.lit("the payload cannot be mapped: "), F.col("field"), F.lit(": "), F.col("reason")
        ),
    )
    fault = fault.when(
        (F.col("outcome") == V.MAPPED) & F.col("source_payload_hash").isNull(),
        F.lit("the payload has no content hash"),
    )
    return mapped.withColumn("fault", fault)


def deliveries(read: DataFrame) -> DataFrame:
    """Readable messages as notices to ingest, with their arrival number."""
    good = read.filter(F.col("fault").isNull() & (F.col("outcome") == V.MAPPED))
    return good.select("seq", *NOTICES.fieldNames())


def quarantine(read: DataFrame) -> DataFrame:
    """Messages that cannot be consumed, whole and with a reason."""
    return read.filter(F.col("fault").isNotNull()).select(
        "seq",
        "schema_version",
        F.col("message_control").alias("control_number"),
        "content_hash",
        F.col("stamp").alias("source_updated_at"),
        "raw_payload",
        F.col("fault").alias("reason"),
    )
