"""Keyed state in buckets of control numbers: fewer calls, the same verdicts and rows."""

import random

from pyspark.sql import functions as F

from tenderloom.operators import ingest
from tenderloom.schemas import MESSAGES
from tenderloom.sources import messages
from tenderloom.streaming import ingest as streaming
from tests.test_jobs import message, place
from tests.test_mapping import notice


def deliveries_of(run, numbers=30):
    dice = random.Random(run)
    rows = []
    for i in range(numbers * 4):
        updated = dice.choice([None, "2026-09-02T10:00:00.000001", "2026-09-02T10:00:00.000002", "2026-09-03T10:00:00"])
        content = notice(numeroControlePNCP=f"n{dice.randrange(numbers)}", dataAtualizacaoGlobal=updated,
                         valorTotalEstimado=dice.choice([None, 0.0000000001, 12345678.9]))
        rows.append(message(run * 1_000 + i, content))
    dice.shuffle(rows)
    return rows


def test_numbers_share_state_and_keep_their_verdicts(spark, tmp_path):
    home, sent, entries = str(tmp_path), [], {}
    for run in range(2):
        sent += deliveries_of(run)
        messages.publish(spark.createDataFrame(deliveries_of(run), MESSAGES), f"{home}/messages", run)
        for buckets in (4, 0):
            source = messages.read_message_stream(spark, f"{home}/messages")
            query = streaming.start_keyed_ingest(source, f"{home}/{buckets}", buckets=buckets)
            query.awaitTermination()
            entries[buckets] = max(p.stateOperators[0].numRowsTotal for p in query.recentProgress)
    assert entries[4] <= 4 < entries[0]
    arrived = streaming.stream_deliveries(spark.createDataFrame(sent, MESSAGES))
    want = sorted(map(str, ingest.verdicts(arrived, hash_covers_time=True).collect()))
    assert len(want) == 240 and {"stale", "unchanged", "stored"} == {w.split("outcome='")[1][:-2] for w in want}
    for buckets in (4, 0):
        got = spark.read.parquet(f"{home}/{buckets}/verdicts").drop("batch_id")
        assert sorted(map(str, got.collect())) == want


def test_rows_return_from_texts_as_they_were(spark):
    rows = [(place(1), "a", None, 1.5), (None, "", "0E-10", None), ((None, None, None, None, None, 7), None, "-12.0000000001", 0.1)]
    made = spark.createDataFrame(rows, f"seq {MESSAGES['seq'].dataType.simpleString()}, t string, d string, x double")
    made = made.withColumn("d", F.col("d").cast("decimal(38,10)"))
    texts = F.array(*[t for f in made.schema.fields for t in streaming._to_texts(F.col(f.name), f.dataType)])
    places = (F.get("_row", F.lit(i)) for i in range(100))
    back = [streaming._from_texts(places, f.dataType).alias(f.name) for f in made.schema.fields]
    assert made.select(texts.alias("_row")).select(*back).collect() == made.collect()
