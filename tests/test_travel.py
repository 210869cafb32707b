"""What stored tables deal anew: each row once, ids as bytes, and nothing that lies in its place."""

import random

import pytest
from pyspark.sql import functions as F

from tenderloom.functions.values import uuid_bytes, uuid_text
from tenderloom.plans import catalog
from tenderloom.sources import tables
from tests.test_stored import plan

ID = "0a1b2c3d-4e5f-3a7b-8c9d-0e1f2a3b4c5d"
LAYOUT = "match_id string, control_number string, score int"


def dealt(df):
    """Shuffles of a plan that was not run yet, each once."""
    return [line for line in plan(df).splitlines() if "Exchange" in line and line.startswith("(")]


def test_only_canonical_uuids_become_bytes(spark):
    texts = [ID, ID.upper(), ID + "\n", ID.replace("-", ""), "m1", "", None, "x" + ID, "ffffffff-ffff-ffff-ffff-ffffffffffff"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", uuid_bytes(F.col("t")).alias("b"))
    got = rows.select("t", "b", uuid_text(F.col("b")).alias("back")).collect()
    assert [r.t for r in got if r.b is not None] == [texts[0], texts[-1]]
    assert all(len(r.b) == 16 and r.back == r.t for r in got if r.b is not None)
    held = tables._unpacked(tables._packed(rows.select("t"), "t"), "t").collect()
    assert [r.t for r in held] == texts


def made(spark, seed, count, score):
    dice = random.Random(seed)
    ids = [ID[:-2] + f"{i:02x}" for i in range(60)] + [f"m{i}" for i in range(60)] + [None, ""]
    rows = [(i, f"c{dice.randrange(5)}", score and dice.choice([None, 1, 2, 3])) for i in dice.choices(ids, k=count)]
    return spark.createDataFrame(rows, LAYOUT)


def test_upsert_of_a_stored_table_deals_rows_once(spark, tmp_path):
    home, scratch = str(tmp_path / "t"), str(tmp_path / "s")
    first = made(spark, 1, 150, 0).dropDuplicates(["match_id"])
    tables.store_keyed(first, home, "match_id", 16)
    incoming = made(spark, 2, 90, 1)
    # What a batch that broke off has left is not taken for rows of this one.
    tables._write_buckets(first.withColumns({"score": F.lit(99), "bucket": F.lit(5)}), scratch, "static")
    want = sorted(map(str, tables.upsert(first, incoming, "match_id").collect()))
    held = tables.read_keyed(spark, home, first.schema)
    assert len(dealt(tables._upsert_placed(held, incoming, "match_id", 16))) == 1
    tables.upsert_keyed(incoming, home, "match_id", scratch, 16)
    stored = tables.read_keyed(spark, home, first.schema)
    assert sorted(map(str, stored.drop("bucket").collect())) == want
    assert stored.filter(F.col("bucket") != tables.bucket_of(F.col("match_id"), 16)).count() == 0


def test_rows_in_their_buckets_are_written_as_they_lie(spark, tmp_path):
    rows = made(spark, 3, 400, 1)
    tables.store_keyed(rows, str(tmp_path / "a"), "match_id", 16)
    lying = tables.read_keyed(spark, str(tmp_path / "a"), rows.schema)
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    tables.store_keyed(lying, str(tmp_path / "b"), "match_id", 16, placed=True)
    tracker = spark.sparkContext.statusTracker()
    jobs = set(tracker.getJobIdsForGroup(None)) - set(before)
    assert jobs and all(len(tracker.getJobInfo(j).stageIds) == 1 for j in jobs)
    again = tables.read_keyed(spark, str(tmp_path / "b"), rows.schema)
    assert sorted(map(str, again.collect())) == sorted(map(str, lying.collect()))
    assert sorted(map(str, again.drop("bucket").collect())) == sorted(map(str, rows.collect()))


@pytest.mark.parametrize("ids", [["m1", "m2"], [ID, "m2"]])
def test_feedback_deals_events_once(spark, monkeypatch, ids):
    rows = spark.createDataFrame([(i,) for i in ids], "match_id string")
    monkeypatch.setattr(catalog, "_matched", lambda *_: rows)
    told = catalog.feedback_appended(spark, "/root/testdata/sf0.001")
    assert len(dealt(told)) == 1
    assert sorted(map(tuple, told.collect())) == sorted((i, 2, 2, "NOT_RELEVANT") for i in ids)
