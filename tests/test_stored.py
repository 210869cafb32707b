"""Stored tables: folders that are not opened, buckets that are not touched, ties."""

import datetime as dt
import io
from contextlib import redirect_stdout
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tenderloom.operators.ingest import insert_if_absent
from tenderloom.plans.discovery import discover
from tenderloom.sources import landing, tables

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="sample tables are not here")
def test_discovery_opens_owed_folders_only(spark, tmp_path):
    from tenderloom.plans import examples as X

    landing.write_landing(X.landing(spark, FOLDER), str(tmp_path / "landing"))
    pages = landing.read_landing(spark, str(tmp_path / "landing"))
    owed = X.owed_chunks(spark, FOLDER).filter(F.col("state") == "BA")
    run = discover(owed, pages, F.lit(dt.datetime(2026, 9, 22)))
    assert "dynamicpruning" in plan(run.results)
    before = discover(owed, X.landing(spark, FOLDER), F.lit(dt.datetime(2026, 9, 22)))
    assert sorted(map(str, run.results.collect())) == sorted(map(str, before.results.collect()))


def rows(spark, ids, score):
    return spark.createDataFrame([(f"m{i}", score) for i in ids], "match_id string, score int")


@pytest.mark.parametrize("batches", [2, 6])
def test_upsert_touches_its_buckets_only(spark, tmp_path, batches):
    home = tmp_path / "t"
    tables.store_keyed(rows(spark, range(200), 0), str(home), "match_id", 16)
    want = dict.fromkeys((f"m{i}" for i in range(200)), 0)
    touched = []
    for n in range(batches):
        files = {f: f.stat().st_mtime_ns for f in home.rglob("*.parquet")}
        touched = tables.upsert_keyed(rows(spark, [n, 1_000 + n], n + 1), str(home), "match_id", str(tmp_path / f"s{n}"), 16)
        want |= {f"m{n}": n + 1, f"m{1_000 + n}": n + 1}
        kept = {f for f in files if int(f.parent.name.split("=")[1]) not in touched}
        assert len(touched) <= 2 and kept and all(f.exists() and f.stat().st_mtime_ns == files[f] for f in kept)
    stored = tables.read_keyed(spark, str(home), rows(spark, [1], 1).schema)
    assert {r.match_id: r.score for r in stored.collect()} == want
    one = tables.find_keyed(stored, "match_id", "m1", 16)
    assert [r.score for r in one.collect()] == [2] and "(bucket" in plan(one).split("PartitionFilters")[1][:60]


def test_rows_that_tie_are_neither_lost_nor_doubled(spark):
    made = [("k", i // 2, "same", f"text {i}") for i in range(400)]
    incoming = spark.createDataFrame(made, "control_number string, seq int, source_payload_hash string, t string").repartition(7)
    done = insert_if_absent(incoming, incoming.filter("false")).collect()
    assert sorted(r.t for r in done) == sorted(m[3] for m in made)
    assert [r.seq for r in done if r.won] == [0]
