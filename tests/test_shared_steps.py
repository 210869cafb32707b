"""Steps that several queries share: worked out once, and by every task."""

import pytest
from pyspark.sql import functions as F

from tenderloom.plans import catalog
from tenderloom.plans import examples as X
from tenderloom.sources import messages

SMALLEST = "/root/testdata/sf0.001"


@pytest.fixture
def counted(spark, monkeypatch):
    """Three matches, and how many were worked out."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def one(key):
        made.add(1)
        return f"m{key}"

    rows = spark.range(1, 4).select(
        one.asNondeterministic()("id").alias("match_id"),
        F.col("id").cast("string").alias("control_number"),
        F.lit("p").alias("profile_id"),
    )
    monkeypatch.setattr(catalog, "_matched", lambda *_: rows)
    return made


def test_feedback_works_matches_out_once(spark, counted):
    rows = catalog.feedback_appended(spark, SMALLEST).collect()
    assert sorted(r.match_id for r in rows) == ["m1", "m2", "m3"]
    assert counted.value == 3


def test_precision_works_matches_out_once(spark, counted):
    catalog.feedback_precision(spark, SMALLEST).collect()
    assert counted.value == 3


def test_raw_notices_and_pages_are_spread(spark):
    def tasks(rows):
        return rows.select(F.spark_partition_id()).distinct().count()

    assert tasks(X.raw_notices(spark, SMALLEST)) > 1
    assert tasks(X.landing(spark, SMALLEST)) > 1


def test_few_messages_are_published_in_few_files(spark, tmp_path):
    published = str(tmp_path / "messages")
    messages.publish(X.delivery_messages(spark, SMALLEST), published, 0)
    files = spark.read.parquet(f"{published}/run=0").inputFiles()
    assert len(files) == 1


def test_feedback_scores_judged_notices_only(spark, monkeypatch):
    scored = []
    matches = catalog.scoring.matches
    monkeypatch.setattr(catalog.scoring, "matches", lambda notices, *rest: scored.append(notices) or matches(notices, *rest))
    found = catalog.latest_feedback(spark, SMALLEST)
    labels = {str(r[0]) for r in X.table(spark, SMALLEST, "labels").select("doc_id").collect()}
    assert {r[0] for r in scored[0].select("control_number").collect()} <= labels
    every = catalog._matched(spark, SMALLEST).select("match_id", "control_number")
    assert found.count() == every.filter(F.col("control_number").isin(labels)).count() > 0


def test_replay_lands_pages_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(body):
        made.add(1)
        return body

    pages = X.landing(spark, SMALLEST).localCheckpoint()
    counted = pages.withColumn("body", seen.asNondeterministic()("body"))
    monkeypatch.setattr(catalog.X, "landing", lambda *_: counted)
    chunks = catalog.discovery_replay(spark, SMALLEST).collect()
    assert chunks and made.value == pages.count()


def test_outcomes_are_told_without_typed_columns(spark):
    opened = X.raw_notices(spark, SMALLEST).select("payload")
    outcomes = catalog.mapping.map_notices(opened).groupBy("outcome").count()
    assert "decimal(38,10)" not in outcomes._jdf.queryExecution().optimizedPlan().toString()
    # No pattern is matched twice for one instant: its trimmed text is a column.
    assert outcomes._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp_replace") == 0
