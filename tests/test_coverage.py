import datetime as dt

import pytest
from pyspark.sql import functions as F

from tenderloom.operators import coverage
from tenderloom.schemas import GAPS, LEDGER

DONE = dt.datetime(2026, 9, 24)


def now():
    return F.lit("2026-09-24 12:00:00").cast("timestamp")


def day(n):
    return dt.date(2026, 9, n)


def chunk(cycle, published, modality=6, origin="SCHEDULED", attempts=0, done=True, state="SP"):
    published = published if isinstance(published, dt.date) else day(published)
    finished = (DONE, 1, 1) if done else (None, None, None)
    return (day(cycle), published, modality, state, origin, DONE, attempts, *finished, None, None)


@pytest.fixture
def audit(spark):
    def run(rows, start, modalities=(6,), known=()):
        ledger = spark.createDataFrame(rows, LEDGER)
        gaps = spark.createDataFrame(list(known), GAPS)
        found = coverage.new_gaps(
            ledger, gaps, F.lit(day(start)), list(modalities), ["SP"], now()
        )
        return sorted((r.publication_date.day, r.modality_code) for r in found.collect())

    return run


def test_gaps(audit):
    assert audit([chunk(20, 20)], 21) == [(20, 6)]
    assert audit([chunk(20, 20), chunk(21, 20)], 21) == []
    assert audit([chunk(20, 20), chunk(21, 20, done=False)], 21) == [(20, 6)]
    assert audit([chunk(20, 20)], 21, known=[(day(20), 6, "SP", DONE, None)]) == []
    assert audit([chunk(20, 20)], 21, known=[(day(20), 6, "SP", DONE, DONE)]) == []
    assert audit([chunk(15, 14)], 18) == [(15, 6), (16, 6), (17, 6)]
    assert audit([chunk(20, 20)], 20) == [] and audit([chunk(20, 20)], 3) == []


def test_responsibility(audit):
    two = [chunk(15, 14), chunk(20, 19, modality=8)]
    assert audit(two, 21, (6, 8)) == [(15, 6), (16, 6), (17, 6), (18, 6), (19, 6), (20, 6), (20, 8)]
    ancient = chunk(20, dt.date(2020, 1, 1), origin="MANUAL")
    assert audit([chunk(20, 19), ancient], 20) == []
    assert audit([chunk(20, 20), chunk(21, 20, origin="MANUAL")], 21) == []
    dropped = [chunk(15, 14), chunk(15, 14, modality=8)]
    assert {m for _, m in audit(dropped, 18)} == {6}


def test_planning_never_overwrites(spark):
    ledger = spark.createDataFrame([chunk(24, 22, origin="MANUAL", done=False)], LEDGER)
    plan = coverage.chunk_plan(coverage.one_cycle(spark, day(24)), 3, [6, 8], ["SP", "RJ"], now())
    assert plan.count() == 16 and plan.schema.fieldNames() == LEDGER.fieldNames()
    fresh = coverage.plan_if_absent(ledger, plan)
    assert fresh.count() == 15
    after = ledger.unionByName(fresh)
    assert coverage.plan_if_absent(after, plan).count() == 0


def test_pending_and_stuck(spark):
    rows = [
        chunk(24, 23, done=False), chunk(24, 21, 8, done=False), chunk(24, 21, 4, done=False),
        chunk(23, 20, done=False), chunk(10, 5, origin="MANUAL", attempts=8, done=False),
        chunk(24, 24), chunk(11, 5, origin="MANUAL", attempts=7, done=False),
    ]
    ledger = spark.createDataFrame(rows, LEDGER)
    owed = coverage.pending(ledger, F.lit(day(24))).collect()
    assert [(r.publication_date.day, r.modality_code) for r in owed] == [
        (5, 6), (5, 6), (21, 4), (21, 8), (23, 6)
    ]
    assert [r.cycle_date for r in coverage.stuck_backfills(ledger).collect()] == [day(10)]


def test_backfill_and_resolution(spark):
    ledger = spark.createDataFrame([chunk(24, 20, attempts=5), chunk(24, 21)], LEDGER)
    asked = spark.createDataFrame(
        [(day(20), 6, "SP"), (day(3), 8, "RJ")], "publication_date date, modality_code int, state string"
    )
    after = coverage.request_backfills(ledger, asked, F.lit(day(24)), now())
    rows = {(r.publication_date.day, r.modality_code): r for r in after.collect()}
    assert len(rows) == 3
    reset = rows[20, 6]
    assert (reset.origin, reset.attempts, reset.completed_at, reset.pages_fetched) == ("MANUAL", 0, None, None)
    assert reset.planned_at == DONE and rows[3, 8].origin == "MANUAL"
    twice = coverage.request_backfills(after, asked, F.lit(day(24)), now())
    assert sorted(map(str, twice.collect())) == sorted(map(str, after.collect()))

    results = after.filter("origin = 'MANUAL'").select(
        "cycle_date", "publication_date", "modality_code", "state",
        now().alias("at"), F.lit(4).alias("pages"), F.lit(9).alias("published"),
    )
    done = coverage.complete_chunks(after, results)
    again = coverage.complete_chunks(done, results.withColumn("pages", F.lit(99)))
    assert {r.pages_fetched for r in again.collect()} == {1, 4}
    gaps = spark.createDataFrame(
        [(day(20), 6, "SP", DONE, None), (day(24), 6, "SP", DONE, None), (day(3), 8, "RJ", DONE, DONE)],
        GAPS,
    )
    assert coverage.resolvable_gaps(gaps, done).count() == 1
    settled = coverage.resolve_gaps(gaps, done)
    assert [r.publication_date for r in coverage.open_gaps(settled).collect()] == [day(24)]
    kept = settled.filter("modality_code = 8").first()
    assert kept.resolved_at == DONE


def test_attempts(spark):
    ledger = spark.createDataFrame([chunk(24, 20, attempts=1, done=False)], LEDGER)
    log = spark.createDataFrame(
        [(day(24), day(20), 6, "SP", dt.datetime(2026, 9, 24, h), f) for h, f in
         [(1, "first"), (3, "second"), (5, None)]],
        "cycle_date date, publication_date date, modality_code int, state string, at timestamp, failure string",
    )
    row = coverage.record_attempts(ledger, log).first()
    assert (row.attempts, row.last_failure, row.last_failure_at.hour) == (4, "second", 3)
