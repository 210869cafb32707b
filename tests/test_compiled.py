"""Steps over many rows have no lambdas, which Spark does not compile, and mean what they meant with them."""

from pyspark.sql import functions as F

from tenderloom import vocabulary as V
from tenderloom.functions.text import run_key, run_rows, sentence
from tenderloom.operators import rules, scoring
from tenderloom.plans import examples as X

SMALLEST = "/root/testdata/sf0.001"


def plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString().lower()


def test_sentences_are_as_formatted(spark):
    rows = spark.createDataFrame([("a", 3), (None, None), ("50%", -7)], "s string, n int")
    for template, columns in [
        (V.NO_KEYWORD_HIT, ["n"]), (V.KEYWORD_HITS, ["n", "n", "s"]), (V.SEGMENT_SERVED, ["s", "s"]), ("%d%s%%", ["n", "s"])
    ]:
        values = [F.col(c) for c in columns]
        for r in rows.select(sentence(template, *values).alias("a"), F.format_string(template, *values).alias("b")).collect():
            assert r.a == r.b


def test_reasons_need_no_formatter_and_no_lambda(spark):
    reasons = scoring.breakdown(
        rules.all_rules(rules.instant(X.EVALUATED_AT), rules.Horizon()), rules.checked_weights(None)
    )
    subject = scoring.prepare_notices(X.notices(spark, SMALLEST), X.enrichments(spark, SMALLEST), scoring.keyword_terms(X.profiles(spark, SMALLEST)))
    pairs = subject.crossJoin(scoring.prepare_profiles(X.profiles(spark, SMALLEST)).limit(1)).withColumn("hit_count", F.lit(1))
    text = plan(pairs.select(reasons.alias("reasons")))
    assert "format_string" not in text and "transform(array_sort(" not in text


def test_plain_keywords_are_looked_for_without_lambdas(spark):
    texts = spark.createDataFrame([("1", "big red wheels, red")], "control_number string, folded_object string")
    terms = spark.createDataFrame([(["Red wheel"],)], "keywords array<string>")
    found = scoring.found_phrases(texts, scoring.keyword_terms(terms).localCheckpoint())
    assert "lambdafunction(split" not in plan(found) and "flatten(" not in plan(found)
    assert [r.phrases for r in found.collect()] == [["red wheel"]]


def test_runs_of_words(spark):
    texts = spark.createDataFrame(
        [("1", " big red\twheels, red-hot  "), ("2", ""), ("3", None), ("4", "one")], "k string, t string"
    )
    got = run_rows(texts, F.col("t"), [1, 2], "k")
    assert sorted((r.k, r.run) for r in got.collect()) == sorted(
        [("1", w) for w in ("big", "red", "wheels", "red", "hot", "big red", "red wheels")] + [("4", "one")]
    )
    over = run_rows(texts, F.col("t"), [3], "k", across=True)
    assert sorted(r.run for r in over.collect()) == ["big red wheels", "red wheels red", "wheels red hot"]
    assert got.filter(F.col("run_key") != run_key(F.col("run"))).count() == 0
