"""Conditional writes at keys with few rows and with many."""

import pytest
from pyspark.sql import functions as F

from tenderloom.operators import ingest
from tenderloom.sources import tables


def arrivals(spark):
    """Ten arrivals of each of five keys, the first of them twice."""
    rows = spark.range(50).select(
        F.concat(F.lit("k"), (F.col("id") % 5).cast("string")).alias("control_number"),
        F.floor(F.col("id") / 5).alias("seq"),
        F.lit("h").alias("source_payload_hash"),
        F.timestamp_seconds("id").alias("source_updated_at"),
    )
    return rows.unionByName(rows.filter("seq = 0"))


@pytest.mark.parametrize("busy", [100_000, 4])
def test_one_arrival_of_a_key_wins(spark, monkeypatch, busy):
    monkeypatch.setattr(ingest, "BUSY_ROWS", busy)
    incoming = arrivals(spark)
    none = incoming.filter("false")
    done = ingest.insert_if_absent(incoming, none)
    assert done.count() == 55
    won = done.filter("won").select("control_number", "seq").collect()
    assert sorted(map(tuple, won)) == [(f"k{i}", 0) for i in range(5)]
    current = incoming.filter("seq = 3").drop("seq").withColumn("source_payload_hash", F.lit("old"))
    writers = incoming.withColumn("expected_hash", F.when(F.col("seq") > 5, "old").otherwise("none"))
    following, tried = ingest.replace_if_unchanged(writers, current)
    assert tried.count() == 55 and following.count() == 5
    won = tried.filter("won").select("control_number", "seq").collect()
    assert sorted(map(tuple, won)) == [(f"k{i}", 6) for i in range(5)]


def test_keys_with_few_rows_are_ranked_at_once(spark):
    """They are ranked where their rows meet, and what settles ties repeats no column."""
    plan = ingest.insert_if_absent(arrivals(spark), arrivals(spark))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert any("_part" not in line for line in windows)
    assert "struct(source_updated_at" in plan and "struct(control_number" not in plan


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(0, 60_000, 1, 4).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), "id")
    home = str(tmp_path / "kept")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        tables.store_keyed(rows, home, "key", 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    stored = tables.read_keyed(spark, home, rows.schema)
    assert len(stored.inputFiles()) > 2
    assert stored.count() == 60_000 == stored.select("id").distinct().count()
    assert stored.filter(F.col("bucket") != tables.bucket_of(F.col("key"), 2)).count() == 0
    assert tables.find_keyed(stored, "key", stored.first().key, 2).count() == 1
