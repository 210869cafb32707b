"""The message contract between discovery and ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom import vocabulary as V
from tenderloom.functions.text import is_blank
from tenderloom.functions.times import instant_text, is_canonical_instant
from tenderloom.schemas import ARRIVAL, MESSAGES


def arrival(
    run: Column, day: Column, modality: Column, state: Column, page: Column, place: Column
) -> Column:
    """Place of a message among all: its run comes first, so what a later run says is newer."""
    parts = zip(ARRIVAL.fields, (run, day, modality, state, page, place))
    return F.struct(*[part.cast(field.dataType).alias(field.name) for field, part in parts])


def messages_for(notices: DataFrame, seq: Column, payload: str = "payload") -> DataFrame:
    """One message per mapped notice, at the current version."""
    return notices.select(
        seq.alias("seq"),
        F.lit(V.MESSAGE_VERSION).alias("schema_version"),
        "control_number",
        F.col("source_payload_hash").alias("content_hash"),
        instant_text(F.col("source_updated_at")).alias("source_updated_at"),
        F.col(payload).alias("raw_payload"),
    )


def publish(messages: DataFrame, path: str, batch: int) -> None:
    """Write the messages of one run; running it again replaces them. Files are of even size, as many as the
    messages fill, so that the micro-batches that read them don't grow in number with the tasks."""
    messages.hint("rebalance").write.mode("overwrite").parquet(f"{path}/run={batch}")


def read_message_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Published messages as a stream; unknown fields are ignored, missing ones are null."""
    return (
        spark.readStream.schema(MESSAGES)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true")
        .parquet(path)
    )


def contract_fault() -> Column:
    """Why a message breaks the contract, or null."""
    stamp = F.col("source_updated_at")

    def lacks(name: str) -> Column:
        return F.when(F.col(name).isNull(), F.lit(f"{name} is required")).when(
            is_blank(F.col(name)), F.lit(f"{name} must not be blank")
        )

    version = F.col("schema_version")
    return F.coalesce(
        F.when(version.isNull(), F.lit("schema_version is required")),
        F.when(
            version < 1,
            F.concat(F.lit("schema versions start at 1 but was "), version.cast("string")),
        ),
        lacks("control_number"),
        lacks("content_hash"),
        lacks("raw_payload"),
        F.when(
            is_blank(stamp), F.lit("source_updated_at must be absent or a timestamp, never blank")
        ),
        F.when(
            stamp.isNotNull() & ~is_canonical_instant(stamp),
            F.concat(
                F.lit("source_updated_at must be a UTC instant in its one canonical form: "), stamp
            ),
        ),
    )


def version_fault() -> Column:
    """Newer versions cannot be read; older ones always can."""
    return F.when(
        F.col("schema_version") > V.MESSAGE_VERSION,
        F.format_string(
            "message version %d is newer than the %d this consumer reads",
            F.col("schema_version"),
            F.lit(V.MESSAGE_VERSION),
        ),
    )
