"""Streaming, discovery and reports over small tables."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tenderloom.operators import consume, enrich, ingest, reports, validate
from tenderloom.plans.discovery import discover
from tenderloom.schemas import LANDING, LEDGER, MESSAGES
from tenderloom.session import shared_folder
from tenderloom.sources import messages, tables
from tenderloom.streaming import ingest as streaming
from tests.test_coverage import chunk, day
from tests.test_mapping import GONE, notice


def message(seq, payload, version=1, control="c", stamp=None):
    body = payload if isinstance(payload, str) else json.dumps(payload)
    return (place(seq), version, control, "h", stamp, body)


def place(n):
    return (dt.datetime(2026, 9, 1), dt.date(2026, 9, 1), 6, "SP", 1, n)


def test_keyed_verdicts_follow_arrival_without_moving_rows():
    """Deliveries of a number out of order and in two frames: judged by arrival, handed on as they came."""

    class State:
        getOption = ("h0", dt.datetime(2026, 9, 1))

        def update(self, value):
            self.kept = value

    def frame(*rows):
        names = ["seq", "source_payload_hash", "source_updated_at"]
        made = pd.DataFrame(rows, columns=names)
        return made.assign(source_updated_at=pd.to_datetime(made["source_updated_at"]))

    seq = lambda n: {"run": None if n < 3 else dt.datetime(2026, 9, 2), "place": n}
    frames = [
        frame((seq(5), "h2", "2026-09-03"), (seq(1), "h0", None)),
        frame((seq(4), "h1", "2026-08-01"), (seq(2), "h2", "2026-09-03"), (seq(6), "h3", None)),
    ]
    state = State()
    got = pd.concat(streaming._decide(("a",), iter(frames), state))
    assert [(s["place"], o) for s, o in zip(got["seq"], got["outcome"])] == [
        (5, "unchanged"), (1, "unchanged"), (4, "stale"), (2, "stored"), (6, "stored")
    ]
    assert state.kept == ("h3", None)


def test_stream_and_replay(spark, tmp_path):
    home = str(tmp_path)
    late = dict(numeroControlePNCP="a", dataAtualizacaoGlobal="2026-09-03T10:00:00")
    early = {**late, "dataAtualizacaoGlobal": "2026-09-02T10:00:00"}
    first = [message(1, notice(**late)), message(2, notice(**late)), message(3, notice(**early)),
             message(4, notice(numeroControlePNCP="b")), message(5, "not json"),
             message(6, notice(numeroControlePNCP="c"), version=2),
             message(7, notice(dataAberturaProposta=GONE, dataEncerramentoProposta=GONE))]

    def publish(rows, run):
        messages.publish(spark.createDataFrame(rows, MESSAGES), f"{home}/messages", run)

    def run():
        source = messages.read_message_stream(spark, f"{home}/messages")
        streaming.start_keyed_ingest(source, home).awaitTermination()
        streaming.start_quarantine(source, home).awaitTermination()
        streaming.start_batch_ingest(
            source, f"{home}/b", F.lit("2026-09-05 12:00:00").cast("timestamp")
        ).awaitTermination()

    publish(first, 0)
    run()
    verdicts = lambda: sorted(
        (r.seq.place, r.outcome) for r in spark.read.parquet(f"{home}/verdicts").collect()
    )
    assert verdicts() == [(1, "stored"), (2, "unchanged"), (3, "stale"), (4, "stored")]
    kept = spark.read.parquet(f"{home}/quarantine").collect()
    assert sorted(r.seq.place for r in kept) == [5, 6] and all(r.reason and r.raw_payload for r in kept)
    publish([(place(r[0][-1] + 10), *r[1:]) for r in first], 1)
    run()
    assert [o for s, o in verdicts() if s > 10] == ["unchanged", "unchanged", "stale", "unchanged"]
    current = streaming.current_notices(spark, f"{home}/b").collect()
    assert {r.control_number: r.source_updated_at for r in current} == {
        "a": dt.datetime(2026, 9, 3, 13, 0), "b": None
    }
    keyed = streaming.keyed_notices(spark, home)
    assert sorted(keyed.collect()) == sorted(streaming.current_notices(spark, f"{home}/b").collect())
    counted = spark.read.parquet(f"{home}/b/outcomes").filter("batch_id = 1").collect()
    assert {r.outcome: r.messages for r in counted} == {"unchanged": 3, "stale": 1}
    seen = spark.read.parquet(f"{home}/b/lateness").filter("batch_id = 0").first()
    assert (seen.late, seen.within_3, seen.within_4, seen.oldest) == (2, 0, 2, 4)


def test_message_contract(spark):
    good = notice()
    rows = [message(1, good, version=0), message(2, good, control=" "), message(3, ""),
            message(4, good, stamp=""), message(5, good, stamp="2026-09-01T17:22:01.5Z"),
            message(6, good, stamp="2026-09-01T17:22:01Z"), message(7, notice(objetoCompra=GONE))]
    read = consume.read_messages(spark.createDataFrame(rows, MESSAGES))
    assert sorted(r.seq.place for r in consume.quarantine(read).collect()) == [1, 2, 3, 4, 5, 7]
    assert [r.seq.place for r in consume.deliveries(read).collect()] == [6]


def test_a_payload_without_a_hash_is_kept_aside(spark):
    endless = json.dumps(notice())[:-1] + ', "x": 1e99999}'
    read = consume.read_messages(spark.createDataFrame([message(1, endless), message(2, notice())], MESSAGES))
    assert [r.seq.place for r in consume.deliveries(read).collect()] == [2]
    kept = consume.quarantine(read).collect()
    assert [(r.seq.place, r.reason) for r in kept] == [(1, "the payload has no content hash")]


def test_scratch_is_shared_on_a_cluster():
    class Conf(dict):
        def getConf(self):
            return self

    def session(master, folder=None):
        context = Conf({"spark.checkpoint.dir": folder} if folder else {})
        context.master = master
        return type("Session", (), {"conf": Conf(), "sparkContext": context})()

    with pytest.raises(ValueError, match="all executors share"):
        shared_folder(session("spark://host:7077"), "x")
    assert shared_folder(session("spark://host:7077", "hdfs:///tmp/"), "x").startswith("hdfs:///tmp/x-")
    assert "tenderloom-" in shared_folder(session("local[4]"), "x")


def test_later_runs_are_newer(spark):
    runs = [dt.datetime(2026, 9, 1), dt.datetime(2026, 9, 2)]
    rows = []
    for run, page, text in zip(runs, (2, 1), ("old", "new")):
        body = json.dumps(notice(objetoCompra=text, dataAtualizacaoGlobal=GONE))
        rows.append(((run, dt.date(2026, 9, 1), 106, "SP", page, 0), 1, "c", "h", None, body))
    arrived = consume.deliveries(consume.read_messages(spark.createDataFrame(rows[::-1], MESSAGES)))
    kept = ingest.last_stored(ingest.verdicts(arrived, hash_covers_time=True, blocks=2)).collect()
    assert [r.object_description for r in kept] == ["new"]


def test_a_failed_chunk_publishes_nothing(spark):
    def landed(d, number, *notices, total=1, body=None):
        text = body or json.dumps({"data": list(notices), "totalPaginas": total})
        return (day(d), 6, "SP", number, text)

    ids = iter(range(100))
    ok = lambda: notice(numeroControlePNCP=f"n{next(ids)}")
    bad = notice(objetoCompra=GONE)
    pages = [
        landed(1, 1, ok(), bad, total=2), landed(1, 2, ok(), total=2),
        landed(2, 1, ok(), total=2), landed(2, 2, body="<html>"),
        landed(3, 1, ok(), total=2), landed(3, 2, bad, total=2),
        landed(4, 1, body=" "),
        landed(5, 1, ok(), total=3),
        landed(7, 1, ok()),
    ]
    owed = spark.createDataFrame([chunk(9, d, done=False) for d in range(1, 7)], LEDGER)
    now = F.lit("2026-09-24 12:00:00").cast("timestamp")
    run = discover(owed, spark.createDataFrame(pages, LANDING), now)
    assert sorted(r.control_number for r in run.messages.collect()) == ["n0", "n1"]
    assert {r.publication_date.day: bool(r.failure) for r in run.attempts.collect()} == {
        1: False, 2: True, 3: True, 4: False, 5: True, 6: True
    }
    after = {r.publication_date.day: r for r in run.next_ledger(owed).collect()}
    assert (after[1].pages_fetched, after[1].notices_published, after[1].attempts) == (2, 2, 1)
    assert (after[4].pages_fetched, after[4].notices_published) == (1, 0)
    assert after[2].completed_at is None and after[2].last_failure
    report = reports.run_report(run.results).first()
    assert (report.discovered, report.published, report.consistent) == (2, 2, True)
    # What left is counted on the messages: one of two was written, then one was written twice.
    for sent, told in [(run.messages.limit(1), (2, 1, True)),
                       (run.messages.unionByName(run.messages.limit(1)), (2, 3, False)),
                       (run.messages.limit(0), (2, 0, True))]:
        report = reports.run_report(reports.with_published(run.results, sent)).first()
        assert (report.discovered, report.published, report.consistent) == told


def test_volume(spark):
    observed = spark.createDataFrame(
        [("SP", 4, 4.0), ("SP", 6, 171 / 7), ("SP", 8, 344 / 7)],
        "state string, modality_code int, pages_per_day double",
    )
    scope = observed.select("state", "modality_code")
    row = reports.volume_profile(observed, scope, lookback=3).first()
    assert row.peak_pages_of_largest_chunk == pytest.approx(70.77, abs=0.01)
    assert row.peak_pages_per_run == pytest.approx(446.81, abs=0.01)
    assert reports.national_pages(observed, 2).first()[0] == pytest.approx(1396.29, abs=0.01)
    other = spark.createDataFrame([("RJ", 6)], "state string, modality_code int")
    assert reports.unmeasured(observed, other).count() == 1
    with pytest.raises(Exception, match="pages of modality 6 in RJ have not been measured"):
        reports.volume_profile(observed, other, 3).collect()


def test_enrichment_hook(spark, make):
    notices = make.notices(dict(control_number="a"), dict(control_number="b"), dict(control_number="c"))
    have = make.enrichments(dict(control_number="a"))
    missing = enrich.missing_enrichment(notices, have)

    def provider(batches):
        for batch in batches:
            segments = batch["control_number"].map({"b": "FURNITURE", "c": "NOT_A_SEGMENT"})
            yield pd.DataFrame({"control_number": batch["control_number"], "segment": segments,
                                "confidence": 0.5, "generated_at": pd.Timestamp("2026-09-01")})

    answered = enrich.enrich_with(missing, provider).collect()
    assert [(r.control_number, r.segment) for r in answered] == [("b", "FURNITURE")]
    reused = enrich.reuse_by_text(missing, notices, have).collect()
    assert {(r.control_number, r.segment) for r in reused} == {("b", "IT_SERVICES"), ("c", "IT_SERVICES")}


def test_feedback_keeps_every_event(spark):
    ids = spark.createDataFrame([("m1",), ("m2",)], "match_id string")
    at = lambda d: F.lit(f"2026-09-0{d}").cast("timestamp")
    events = tables.feedback_events(ids, F.lit("RELEVANT"), at(1)).unionByName(
        tables.feedback_events(ids.filter("match_id = 'm1'"), F.lit("NOT_RELEVANT"), at(2))
    ).cache()
    assert events.select("feedback_id").distinct().count() == 3
    last = {r.match_id: r.verdict for r in tables.latest_verdicts(events).collect()}
    assert last == {"m1": "NOT_RELEVANT", "m2": "RELEVANT"}
    matched = spark.createDataFrame([("m1", "p"), ("m2", "p")], "match_id string, profile_id string")
    row = reports.feedback_precision(events, matched).first()
    assert (row.relevant, row.judged, row.precision) == (1, 2, 0.5)


def test_violations(spark, make):
    broken = make.notices(dict(object_description=" ", modality_code=0))
    assert {r.violation for r in validate.notice_violations(broken).collect()} == {
        "blank object description", "modality not positive"
    }
    assert validate.notice_violations(make.notices()).count() == 0
    assert validate.profile_violations(make.profiles()).count() == 0
