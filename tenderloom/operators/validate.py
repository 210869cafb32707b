"""Broken rows as reports: plain files enforce nothing, so invariants are checked by query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom import vocabulary as V
from tenderloom.functions.text import is_blank
from tenderloom.functions.values import digits


def violations(rows: DataFrame, key: list[str], checks: dict[str, Column]) -> DataFrame:
    """One row per broken invariant: the key, and the invariant's name."""
    broken = F.array_compact(
        F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in checks.items()])
    )
    return rows.select(*key, F.explode_outer(broken).alias("violation")).filter(
        F.col("violation").isNotNull()
    )


def notice_violations(notices: DataFrame) -> DataFrame:
    c = F.col
    return violations(
        notices,
        ["control_number"],
        {
            "blank object description": is_blank(c("object_description")),
            "blank payload hash": is_blank(c("source_payload_hash")),
            "negative value": c("estimated_value") < 0,
            "modality not positive": c("modality_code") <= 0,
            "blank modality name": is_blank(c("modality_name")),
            "unknown state": ~c("state").isin(V.STATES),
            "closes before it opens": c("proposal_closes_at") < c("proposal_opens_at"),
        },
    )


def ledger_violations(ledger: DataFrame) -> DataFrame:
    c = F.col
    completion = [c("completed_at"), c("pages_fetched"), c("notices_published")]
    present = sum((x.isNotNull().cast("int") for x in completion), F.lit(0))
    return violations(
        ledger,
        ["cycle_date", "publication_date", "modality_code", "state"],
        {
            "cycle before publication": c("cycle_date") < c("publication_date"),
            "modality not positive": c("modality_code") <= 0,
            "unknown origin": ~c("origin").isin(V.SCHEDULED, V.MANUAL),
            "negative attempts": c("attempts") < 0,
            "half a completion": ~present.isin(0, 3),
        },
    )


def profile_violations(profiles: DataFrame) -> DataFrame:
    c = F.col
    return violations(
        profiles,
        ["profile_id"],
        {
            "blank keyword": F.exists("keywords", lambda k: k.isNull() | is_blank(k)),
            "range upside down": c("value_min") > c("value_max"),
            "half a range": c("value_min").isNull() != c("value_max").isNull(),
            "negative range": c("value_min") < 0,
            "cnae without a division": F.exists("cnaes", lambda k: F.length(digits(k)) < 2),
            "unknown state": F.exists("states", lambda s: ~s.isin(V.STATES)),
            "score out of range": ~c("minimum_score").between(0, 100),
        },
    )


def company_violations(companies: DataFrame) -> DataFrame:
    return violations(
        companies, ["company_id"], {"cnpj is not 14 digits": F.length(digits(F.col("cnpj"))) != 14}
    )


def enrichment_violations(enrichments: DataFrame) -> DataFrame:
    c = F.col
    return violations(
        enrichments,
        ["control_number"],
        {
            "unknown segment": ~c("segment").isin(V.SEGMENTS),
            "confidence out of range": ~c("confidence").between(0.0, 1.0),
        },
    )
