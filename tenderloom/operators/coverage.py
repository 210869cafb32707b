"""The discovery ledger and its audit: what is owed, what was lost, what a backfill settles.

A ledger row is one chunk (cycle date, publication date, modality, state). A date is covered only
by a completion in a later cycle than the date itself. Jobs take the ledger and the gap table as
DataFrames and return their next state; writing them is the caller's last step.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom import vocabulary as V
from tenderloom.functions.times import window_dates
from tenderloom.schemas import GAP_KEY, GAPS, LEDGER, LEDGER_KEY


def covers(cycle_date: Column, publication_date: Column) -> Column:
    """A fetch on the day itself never settles the day."""
    return cycle_date > publication_date


def in_scope(modalities: list[int], states: list[str]) -> Column:
    return F.col("modality_code").isin(list(modalities)) & F.col("state").isin(list(states))


def one_cycle(spark: SparkSession, cycle: date) -> DataFrame:
    return spark.range(1).select(F.lit(cycle).alias("cycle_date"))


def chunk_plan(
    cycles: DataFrame, lookback: int, modalities: list[int], states: list[str], now: Column
) -> DataFrame:
    """For each cycle (``cycle_date``) every date of its window for every modality and state, as
    fresh scheduled chunks."""
    dated = cycles.select(
        "cycle_date", F.explode(window_dates(F.col("cycle_date"), lookback)).alias("publication_date")
    )
    by_modality = dated.select(
        "*", F.explode(F.array(*[F.lit(m) for m in modalities])).alias("modality_code")
    )
    chunks = by_modality.select("*", F.explode(F.array(*[F.lit(s) for s in states])).alias("state"))
    return _fresh(chunks, V.SCHEDULED, now)


def _fresh(chunks: DataFrame, origin: str, now: Column) -> DataFrame:
    values = {"origin": F.lit(origin), "planned_at": now, "attempts": F.lit(0)}
    return chunks.select(
        *[
            values.get(f.name, F.col(f.name) if f.name in LEDGER_KEY else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in LEDGER.fields
        ]
    )


def plan_if_absent(ledger: DataFrame, plan: DataFrame) -> DataFrame:
    """The chunks to append: planned and not in the ledger yet. Never overwrites a row, so a
    backfill somebody asked for keeps its origin."""
    return plan.join(ledger.select(*LEDGER_KEY), LEDGER_KEY, "left_anti")


def pending(ledger: DataFrame, cycle: Column) -> DataFrame:
    """Incomplete chunks of this cycle, and incomplete backfills of any, oldest date first."""
    return ledger.filter(
        F.col("completed_at").isNull()
        & ((F.col("cycle_date") == cycle) | (F.col("origin") == V.MANUAL))
    ).orderBy("publication_date", "modality_code")


def stuck_backfills(ledger: DataFrame, attempts: int = V.STUCK_ATTEMPTS) -> DataFrame:
    return ledger.filter(
        (F.col("origin") == V.MANUAL)
        & F.col("completed_at").isNull()
        & (F.col("attempts") >= attempts)
    ).orderBy("publication_date")


def responsibility(ledger: DataFrame, modalities: list[int], states: list[str]) -> DataFrame:
    """First publication date ever scheduled per modality and state; backfills do not count."""
    return (
        ledger.filter((F.col("origin") == V.SCHEDULED) & in_scope(modalities, states))
        .groupBy("modality_code", "state")
        .agg(F.min("publication_date").alias("since"))
    )


def expected_dates(responsible: DataFrame, window_start: Column) -> DataFrame:
    """Every date from the start of responsibility to the day before the window, from the calendar
    and not from rows, so that an outage leaves traces."""
    return responsible.filter(F.col("since") < window_start).select(
        F.explode(F.sequence("since", F.date_sub(window_start, 1))).alias("publication_date"),
        "modality_code",
        "state",
    )


def covered_dates(ledger: DataFrame) -> DataFrame:
    return ledger.filter(
        F.col("completed_at").isNotNull() & covers(F.col("cycle_date"), F.col("publication_date"))
    ).select(*GAP_KEY)


def new_gaps(
    ledger: DataFrame, gaps: DataFrame, window_start: Column, modalities: list[int],
    states: list[str], now: Column,
) -> DataFrame:
    """Gaps not recorded before: the rows to append and the ones to alert on. A resolved gap is
    on record and is not opened again."""
    expected = expected_dates(responsibility(ledger, modalities, states), window_start)
    return (
        expected.join(covered_dates(ledger), GAP_KEY, "left_anti")
        .join(gaps.select(*GAP_KEY), GAP_KEY, "left_anti")
        .select(*GAP_KEY, now.alias("detected_at"), F.lit(None).cast("timestamp").alias("resolved_at"))
    )


def open_gaps(gaps: DataFrame) -> DataFrame:
    return (
        gaps.filter(F.col("resolved_at").isNull())
        .select(*GAP_KEY)
        .orderBy("publication_date", "modality_code")
    )


def resolvable_gaps(gaps: DataFrame, completions: DataFrame) -> DataFrame:
    """Open gaps that a covering completion settles."""
    return gaps.filter(F.col("resolved_at").isNull()).join(
        covered_dates(completions), GAP_KEY, "left_semi"
    )


def resolve_gaps(gaps: DataFrame, completions: DataFrame) -> DataFrame:
    """Gaps with ``resolved_at`` set, where still open, to the first covering completion."""
    settled = (
        completions.filter(
            F.col("completed_at").isNotNull()
            & covers(F.col("cycle_date"), F.col("publication_date"))
        )
        .groupBy(*GAP_KEY)
        .agg(F.min("completed_at").alias("_at"))
    )
    return (
        gaps.join(settled, GAP_KEY, "left")
        .withColumn("resolved_at", F.coalesce("resolved_at", "_at"))
        .select(*GAPS.fieldNames())
    )


def request_backfills(ledger: DataFrame, requests: DataFrame, cycle: Column, now: Column) -> DataFrame:
    """Ledger with the requested chunks (publication date, modality, state) as manual ones, reset
    when they were there already. ``planned_at`` of an existing chunk stays."""
    asked = _fresh(
        requests.select(cycle.alias("cycle_date"), *GAP_KEY).distinct(), V.MANUAL, now
    )
    before = ledger.select(*LEDGER_KEY, F.col("planned_at").alias("_planned_at"))
    upserted = (
        asked.join(before, LEDGER_KEY, "left")
        .withColumn("planned_at", F.coalesce("_planned_at", "planned_at"))
        .select(*LEDGER.fieldNames())
    )
    return ledger.join(asked.select(*LEDGER_KEY), LEDGER_KEY, "left_anti").unionByName(upserted)


def complete_chunks(ledger: DataFrame, results: DataFrame) -> DataFrame:
    """Ledger with completions (``at``, ``pages``, ``published`` per chunk) written where the chunk
    was still incomplete, so a second run never counts twice. All three columns change together,
    and of several results for a chunk the first counts."""
    done = (
        results.groupBy(*LEDGER_KEY)
        .agg(F.min(F.struct("at", "pages", "published")).alias("_done"))
        .select(
            *LEDGER_KEY,
            F.col("_done.at").alias("_at"),
            F.col("_done.pages").alias("_pages"),
            F.col("_done.published").alias("_published"),
        )
    )
    joined = ledger.join(done, LEDGER_KEY, "left")
    wins = F.col("completed_at").isNull() & F.col("_at").isNotNull()
    return joined.select(
        *[
            {
                "completed_at": F.when(wins, F.col("_at")).otherwise(F.col("completed_at")),
                "pages_fetched": F.when(wins, F.col("_pages")).otherwise(F.col("pages_fetched")),
                "notices_published": F.when(wins, F.col("_published")).otherwise(
                    F.col("notices_published")
                ),
            }
            .get(name, F.col(name))
            .alias(name)
            for name in LEDGER.fieldNames()
        ]
    )


def record_attempts(ledger: DataFrame, log: DataFrame) -> DataFrame:
    """Ledger with an attempt log applied: every entry counts, the latest failure is kept.

    The log has the chunk key, ``at`` and ``failure`` (null for an attempt that went well).
    """
    failed = F.col("failure").isNotNull()
    tally = log.groupBy(*LEDGER_KEY).agg(
        F.count(F.lit(1)).cast("int").alias("_attempts"),
        F.max(F.when(failed, F.col("at"))).alias("_failed_at"),
        F.max(F.when(failed, F.struct("at", "failure"))).alias("_failure"),
    )
    joined = ledger.join(tally, LEDGER_KEY, "left")
    return joined.select(
        *[
            {
                "attempts": F.col("attempts") + F.coalesce("_attempts", F.lit(0)),
                "last_failure_at": F.coalesce("_failed_at", "last_failure_at"),
                "last_failure": F.when(
                    F.col("_failed_at").isNotNull(), F.col("_failure.failure")
                ).otherwise(F.col("last_failure")),
            }
            .get(name, F.col(name))
            .alias(name)
            for name in LEDGER.fieldNames()
        ]
    )
