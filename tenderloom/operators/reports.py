"""Counts and distributions over the outcome tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom import vocabulary as V
from tenderloom.functions.times import days_late


def rejections_by_field(mapped: DataFrame) -> DataFrame:
    return (
        mapped.filter(F.col("outcome") == V.REJECTED)
        .groupBy("field")
        .agg(F.count(F.lit(1)).alias("rejected"))
    )


def mapping_outcomes(mapped: DataFrame) -> DataFrame:
    return mapped.groupBy("outcome").agg(F.count(F.lit(1)).alias("notices"))


def rejected_pages(mapped: DataFrame, page: list[str]) -> DataFrame:
    """Pages of which every notice was rejected, which means the source changed its contract.
    Notices without a window do not count as rejected."""
    return (
        mapped.groupBy(*page)
        .agg(
            F.count(F.lit(1)).alias("notices"),
            F.count_if(F.col("outcome") == V.REJECTED).alias("rejected"),
        )
        .filter(F.col("rejected") == F.col("notices"))
    )


def ingestion_outcomes(decided: DataFrame) -> DataFrame:
    return decided.groupBy("outcome").agg(F.count(F.lit(1)).alias("deliveries"))


def lateness(stored: DataFrame, seen_at: Column) -> DataFrame:
    """How many stored notices were seen within 1, 2, 3, 4, 5, 7 and 14 days of publication
    (cumulative), with their number and the worst case. Ages below two days are the ordinary case
    and are left out."""
    aged = stored.select(days_late(F.col("published_at"), seen_at).alias("age")).filter(
        F.col("age") >= 2
    )
    return aged.agg(
        *[F.count_if(F.col("age") <= b).alias(f"within_{b}") for b in V.LATENESS_BUCKETS],
        F.count(F.lit(1)).alias("late"),
        F.max("age").alias("oldest"),
    )


def counts_by_scope(rows: DataFrame, name: str) -> DataFrame:
    """Gaps or failed chunks by modality and state; dates are left out so that the number of
    groups stays bounded."""
    return rows.groupBy("modality_code", "state").agg(F.count(F.lit(1)).alias(name))


def failed_chunks(log: DataFrame) -> DataFrame:
    return counts_by_scope(log.filter(F.col("failure").isNotNull()), "failed")


def with_published(results: DataFrame, messages: DataFrame) -> DataFrame:
    """Results of a run with ``published`` counted on the messages that were written for each chunk,
    so that the report shows what was found and never left."""
    chunk = ["publication_date", "modality_code", "state"]
    sent = messages.groupBy(*[F.col(f"seq.{c}").alias(c) for c in chunk]).agg(
        F.count(F.lit(1)).cast("int").alias("_sent")
    )
    counted = results.join(sent, chunk, "left").withColumn("published", F.coalesce("_sent", F.lit(0)))
    return counted.select(*results.columns)


def run_report(results: DataFrame) -> DataFrame:
    """Notices discovered and published per cycle. More published than discovered is impossible
    and is flagged."""
    return (
        results.groupBy("cycle_date")
        .agg(F.sum("discovered").alias("discovered"), F.sum("published").alias("published"))
        .withColumn("consistent", F.col("published") <= F.col("discovered"))
    )


def attempts_per_chunk(log: DataFrame, key: list[str]) -> DataFrame:
    return log.groupBy(*key).agg(F.count(F.lit(1)).alias("attempts"))


# Page volume ------------------------------------------------------------------------------------


def observed_pages(notices: DataFrame, page_size: int, days: int) -> DataFrame:
    """Pages per day by state and modality over a measured period, and how much the busiest day
    exceeds the average."""
    daily = notices.groupBy("state", "modality_code", "publication_date").agg(
        F.count(F.lit(1)).alias("records")
    )
    return daily.groupBy("state", "modality_code").agg(
        (F.ceil(F.sum("records") / page_size) / days).cast("double").alias("pages_per_day"),
        (F.max("records") / (F.sum("records") / days)).cast("double").alias("peak"),
    )


def unmeasured(observed: DataFrame, scope: DataFrame) -> DataFrame:
    """Configured (state, modality) pairs nobody has measured; any row here means the volume of
    that scope is unknown and must not be guessed."""
    return scope.join(observed, ["state", "modality_code"], "left_anti")


def volume_profile(
    observed: DataFrame, scope: DataFrame, lookback: int, peak: float = V.PEAK_MULTIPLIER,
    by: list[str] = (),
) -> DataFrame:
    """Pages of a day, of a run and of the largest chunk, on average and at peak, over the scope or
    for each value of ``by``.

    A run fetches the lookback and the day itself. An unmeasured scope fails the job.
    """
    measured = scope.join(observed, ["state", "modality_code"], "left")
    pages = F.coalesce(
        F.col("pages_per_day"),
        F.raise_error(
            F.concat(
                F.lit("pages of modality "),
                F.col("modality_code").cast("string"),
                F.lit(" in "),
                F.col("state"),
                F.lit(" have not been measured, so their volume is unknown"),
            )
        ).cast("double"),
    )
    per_day = F.sum(pages)
    return measured.groupBy(*by).agg(
        per_day.alias("pages_per_day"),
        (per_day * (lookback + 1)).alias("pages_per_run"),
        (per_day * (lookback + 1) * peak).alias("peak_pages_per_run"),
        (F.max(pages) * peak).alias("peak_pages_of_largest_chunk"),
    )


def national_pages(observed_state: DataFrame, lookback: int) -> DataFrame:
    """Pages of a run over every state, estimated from one measured state."""
    return observed_state.agg(
        (F.sum("pages_per_day") * V.NATIONAL_MULTIPLIER * (lookback + 1)).alias("pages_per_run")
    )


# Feedback ---------------------------------------------------------------------------------------


def feedback_precision(feedback: DataFrame, matched: DataFrame) -> DataFrame:
    """Share of relevant judgements per profile, counting the last word on each match."""
    last = feedback.groupBy("match_id").agg(
        F.max(F.struct("given_at", "feedback_id", "verdict")).alias("_last")
    ).select("match_id", F.col("_last.verdict").alias("verdict"))
    relevant = F.count_if(F.col("verdict") == V.RELEVANT)
    return (
        last.join(matched.select("match_id", "profile_id"), "match_id")
        .groupBy("profile_id")
        .agg(
            relevant.alias("relevant"),
            F.count(F.lit(1)).alias("judged"),
            (relevant / F.count(F.lit(1))).cast("double").alias("precision"),
        )
    )
