"""Column layouts of the tables the jobs read and write."""

from __future__ import annotations

from pyspark.sql import types as T

# Amounts are kept as exact text; ranges are tested on this type, where a value is cut, never rejected.
MONEY = T.DecimalType(38, 10)

NOTICES = T.StructType(
    [
        T.StructField("control_number", T.StringType(), False),
        T.StructField("object_description", T.StringType(), False),
        T.StructField("state", T.StringType(), False),
        T.StructField("estimated_value", MONEY),
        T.StructField("estimated_amount", T.StringType()),
        T.StructField("modality_code", T.IntegerType(), False),
        T.StructField("modality_name", T.StringType(), False),
        T.StructField("published_at", T.TimestampType(), False),
        T.StructField("proposal_opens_at", T.TimestampType(), False),
        T.StructField("proposal_closes_at", T.TimestampType(), False),
        T.StructField("source_payload_hash", T.StringType(), False),
        T.StructField("source_updated_at", T.TimestampType()),
    ]
)

PROFILES = T.StructType(
    [
        T.StructField("profile_id", T.StringType(), False),
        T.StructField("company_id", T.StringType(), False),
        T.StructField("keywords", T.ArrayType(T.StringType()), False),
        T.StructField("cnaes", T.ArrayType(T.StringType()), False),
        T.StructField("states", T.ArrayType(T.StringType()), False),
        T.StructField("value_min", MONEY),
        T.StructField("value_max", MONEY),
        T.StructField("minimum_score", T.IntegerType(), False),
    ]
)

ENRICHMENTS = T.StructType(
    [
        T.StructField("control_number", T.StringType(), False),
        T.StructField("segment", T.StringType(), False),
        T.StructField("confidence", T.DoubleType(), False),
        T.StructField("generated_at", T.TimestampType(), False),
    ]
)

COMPANIES = T.StructType(
    [
        T.StructField("company_id", T.StringType(), False),
        T.StructField("cnpj", T.StringType(), False),
    ]
)

FEEDBACK = T.StructType(
    [
        T.StructField("feedback_id", T.StringType(), False),
        T.StructField("match_id", T.StringType(), False),
        T.StructField("verdict", T.StringType(), False),
        T.StructField("given_at", T.TimestampType(), False),
    ]
)

# Where a message stands among all ever published: compared field by field, in this order.
ARRIVAL = T.StructType(
    [
        T.StructField("run", T.TimestampType()),
        T.StructField("publication_date", T.DateType()),
        T.StructField("modality_code", T.IntegerType()),
        T.StructField("state", T.StringType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("place", T.LongType()),
    ]
)

MESSAGES = T.StructType(
    [
        T.StructField("seq", ARRIVAL, False),
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("control_number", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("source_updated_at", T.StringType()),
        T.StructField("raw_payload", T.StringType()),
    ]
)

LEDGER = T.StructType(
    [
        T.StructField("cycle_date", T.DateType(), False),
        T.StructField("publication_date", T.DateType(), False),
        T.StructField("modality_code", T.IntegerType(), False),
        T.StructField("state", T.StringType(), False),
        T.StructField("origin", T.StringType(), False),
        T.StructField("planned_at", T.TimestampType(), False),
        T.StructField("attempts", T.IntegerType(), False),
        T.StructField("completed_at", T.TimestampType()),
        T.StructField("pages_fetched", T.IntegerType()),
        T.StructField("notices_published", T.IntegerType()),
        T.StructField("last_failure_at", T.TimestampType()),
        T.StructField("last_failure", T.StringType()),
    ]
)
LEDGER_KEY = ["cycle_date", "publication_date", "modality_code", "state"]

GAPS = T.StructType(
    [
        T.StructField("publication_date", T.DateType(), False),
        T.StructField("modality_code", T.IntegerType(), False),
        T.StructField("state", T.StringType(), False),
        T.StructField("detected_at", T.TimestampType(), False),
        T.StructField("resolved_at", T.TimestampType()),
    ]
)
GAP_KEY = ["publication_date", "modality_code", "state"]

LANDING = T.StructType(
    [
        T.StructField("publication_date", T.DateType()),
        T.StructField("modality_code", T.IntegerType()),
        T.StructField("state", T.StringType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("body", T.StringType()),
    ]
)
