"""Pairs of notices and profiles: where they meet, how often, and what they count."""

import pytest
from pyspark.sql import functions as F

from tenderloom import vocabulary as V
from tenderloom.operators import scoring
from tests.conftest import AT


def found(notices, enrichments, profiles, rows):
    matched = scoring.matches(notices, enrichments, profiles, AT, broadcast_rows=rows)
    return sorted((r.control_number, r.profile_id, r.score) for r in matched.collect())


def crowd(make):
    """Forty notices that show the same evidence, in several ways at once."""
    shown = dict(keywords=["computadores", "material"], cnaes=["62"], states=["SP"])
    return (
        make.notices(*[dict(control_number=f"n{i}", estimated_value=None) for i in range(40)]),
        make.enrichments(*[dict(control_number=f"n{i}") for i in range(0, 40, 2)]),
        make.profiles(*[dict(profile_id=f"p{i}", minimum_score=30 + 10 * i, **shown) for i in range(4)]),
    )


def test_pairs_are_not_shuffled(spark, make):
    """Above the join that forms pairs nothing is dealt anew."""
    plan = scoring.matches(*crowd(make), AT, broadcast_rows=0).select("match_id", "score")
    lines = plan._jdf.queryExecution().sparkPlan().toString().splitlines()
    met = next(i for i, line in enumerate(lines) if "Join" in line and "evidence_key" in line)
    assert not [line for line in lines[:met] if "Aggregate" in line or "Join" in line]


def test_a_key_of_many_notices_is_cut(spark, make, monkeypatch):
    tables = crowd(make)
    whole = found(*tables, rows=200_000)
    assert whole and whole == found(*tables, rows=0)
    monkeypatch.setattr(scoring, "SLICE_ROWS", 3)
    assert whole == found(*tables, rows=0)


@pytest.mark.parametrize("rows", [200_000, 0])
def test_keywords_of_one_name_count_each(spark, make, rows):
    notices = make.notices(dict(object_description="Compra de mesas e cadeira"))
    keywords = ["mesa", "mesas", "MESA", "cadeira", "armário", "Mesa"]
    profiles = make.profiles(dict(keywords=keywords, cnaes=[], states=[], minimum_score=0))
    matched = scoring.matches(notices, make.enrichments().limit(0), profiles, AT, broadcast_rows=rows)
    row = matched.select("score", F.explode("reasons").alias("r")).filter(F.col("r.rule") == V.KEYWORD).first()
    assert row.r.reason.startswith("matched 5 of 6 keywords: mesa, mesas, MESA, cadeira, Mesa")
    assert row.r.points == 25 and row.score == 35
