"""Enrichments: the latest per notice, reuse by text, and a hook that supplies missing ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.functions.text import fold, words
from tenderloom.functions.values import text_hash
from tenderloom.schemas import ENRICHMENTS
from tenderloom.vocabulary import SEGMENTS

Provider = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def latest_enrichments(enrichments: DataFrame) -> DataFrame:
    """One row per notice: the one generated last (ties settled by segment and confidence)."""
    return (
        enrichments.groupBy("control_number")
        .agg(F.max(F.struct("generated_at", "segment", "confidence")).alias("_latest"))
        .select("control_number", "_latest.segment", "_latest.confidence", "_latest.generated_at")
    )


def missing_enrichment(notices: DataFrame, enrichments: DataFrame) -> DataFrame:
    return notices.join(enrichments.select("control_number"), "control_number", "left_anti")


def reuse_by_text(missing: DataFrame, notices: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Enrichments for notices whose object text was enriched before under another number.

    Known texts are reduced to one row each before the join, so a text shared by many notices
    does not multiply.
    """
    known = (
        notices.select("control_number", text_hash(F.col("object_description")).alias("text_hash"))
        .join(latest_enrichments(enrichments), "control_number")
        .groupBy("text_hash")
        .agg(F.max(F.struct("generated_at", "segment", "confidence")).alias("_known"))
    )
    return (
        missing.select("control_number", text_hash(F.col("object_description")).alias("text_hash"))
        .join(known, "text_hash")
        .select("control_number", "_known.segment", "_known.confidence", "_known.generated_at")
    )


def enrich_by_words(missing: DataFrame, lookup: DataFrame, at) -> DataFrame:
    """The default provider: words that hint at a segment, as a join and a vote.

    ``lookup`` has ``word`` and ``segment``. The segment with most words present wins (ties by
    name); the confidence is its share of all hints. A notice without hints stays unenriched.
    """
    hints = lookup.select(
        fold(F.col("word")).alias("word"), "segment"
    ).filter(F.col("segment").isin(SEGMENTS)).distinct()
    present = missing.select(
        "control_number", F.explode(words(fold(F.col("object_description")))).alias("word")
    )
    votes = (
        present.join(hints, "word").groupBy("control_number", "segment").agg(
            F.count(F.lit(1)).alias("votes")
        )
    )
    return (
        votes.groupBy("control_number")
        .agg(
            F.min(F.struct((-F.col("votes")).alias("v"), "segment")).alias("_best"),
            F.sum("votes").alias("_all"),
        )
        .select(
            "control_number",
            F.col("_best.segment").alias("segment"),
            (-F.col("_best.v") / F.col("_all")).cast("double").alias("confidence"),
            at.alias("generated_at"),
        )
    )


def enrich_with(missing: DataFrame, provider: Provider) -> DataFrame:
    """Enrichments from a caller's batch function over the notices that lack one. It may leave a
    notice out, never fail the job for it; answers outside the vocabulary are dropped as absent."""
    answered = missing.select("control_number", "object_description").mapInPandas(
        provider, ENRICHMENTS
    )
    return answered.filter(
        F.col("segment").isin(SEGMENTS) & F.col("confidence").between(0.0, 1.0)
    )
