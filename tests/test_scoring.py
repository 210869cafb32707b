import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tenderloom import vocabulary as V
from tenderloom.operators import scoring
from tenderloom.operators.rules import Horizon, checked_weights
from tests.conftest import AT

PERFECT = dict(
    keywords=["computador", "informatica"], cnaes=["6201-5/01"], states=["SP"],
    value_min=Decimal(10000), value_max=Decimal(100000), minimum_score=50,
)
VALUE = Decimal("50000.50")


def evaluate(spark, notices, enrichments, profiles, **options):
    pairs = notices.select("control_number").join(profiles.select("profile_id"))
    rows = scoring.evaluate_pairs(pairs, notices, enrichments, profiles, AT, **options).collect()
    return {(r.control_number, r.profile_id): r for r in rows}


def test_examples(spark, make):
    notices = make.notices(
        dict(control_number="full", estimated_value=VALUE),
        dict(control_number="secret"),
        dict(control_number="closed", proposal_closes_at=AT),
        dict(control_number="trade", object_description="Limpeza urbana", estimated_value=VALUE),
        dict(control_number="plain", estimated_value=VALUE),
    )
    enrichments = make.enrichments(
        *[dict(control_number=c) for c in ("full", "secret", "closed")],
        dict(control_number="full", segment="FURNITURE", generated_at=dt.datetime(2026, 9, 1)),
        dict(control_number="trade", segment="CLEANING_AND_MAINTENANCE"),
    )
    found = evaluate(spark, notices, enrichments, make.profiles(dict(profile_id="p", **PERFECT)))
    got = {c: (r.result, r.score, r.coverage, r.provisional) for (c, _), r in found.items()}
    assert got == {
        "full": (V.MATCHED, 100, 100, False),
        "secret": (V.MATCHED, 85, 85, False),
        "closed": (V.DISQUALIFIED, None, None, None),
        "trade": (V.BELOW_THRESHOLD, 40, 100, False),
        "plain": (V.MATCHED, 70, 70, True),
    }
    full = found["full", "p"].reasons
    assert [(r.rule, r.points) for r in full] == [
        ("KEYWORD", 30), ("SEGMENT", 30), ("ESTIMATED_VALUE", 15), ("STATE", 15),
        ("PROPOSAL_DEADLINE", 10),
    ]
    assert [r.reason for r in full] == [
        "matched 2 of 2 keywords: computador, informatica",
        "inferred segment IT_SERVICES is one the company serves, inferred with 100% confidence",
        "estimated at 50000.5, inside the 10000 to 100000 the profile asks for",
        "published in SP, which the profile asks for",
        "proposals close at 2026-10-13T12:00:00Z, 21 days away",
    ]
    closed = found["closed", "p"]
    assert closed.disqualified_by == "PROPOSAL_DEADLINE" and closed.reasons is None
    assert closed.reason == (
        "the proposal window closed at 2026-09-22T12:00:00Z, before the evaluation at "
        "2026-09-22T12:00:00Z"
    )


def test_empty_profile_and_other_segment(spark, make):
    notices = make.notices(dict(control_number="n", estimated_value=VALUE))
    enrichments = make.enrichments(dict(control_number="n", segment="OTHER", confidence=0.6))
    profiles = make.profiles(
        dict(profile_id="empty", minimum_score=10), dict(profile_id="other", cnaes=["99.01"])
    )
    found = evaluate(spark, notices, enrichments, profiles)
    empty = found["n", "empty"]
    assert (empty.result, empty.score, empty.coverage) == (V.MATCHED, 10, 10)
    assert [r.outcome for r in empty.reasons].count(V.UNAVAILABLE) == 4
    assert found["n", "other"].score == 28


def test_deadline_strengths(spark, make):
    days = [21, 14, 8, 5, 2, 1]
    notices = make.notices(
        *[dict(control_number=str(d), proposal_closes_at=AT + dt.timedelta(days=d)) for d in days]
    )
    found = evaluate(spark, notices, make.enrichments(), make.profiles())
    strengths = [
        next(r.strength for r in found[str(d), "p1"].reasons if r.rule == V.PROPOSAL_DEADLINE)
        for d in days
    ]
    assert strengths == pytest.approx([1, 1, 0.55, 0.325, 0.1, 0.1])


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        checked_weights({V.KEYWORD: 100})
    with pytest.raises(ValueError):
        checked_weights({**V.STANDARD_WEIGHTS, V.STATE: 16})
    with pytest.raises(ValueError):
        checked_weights({**V.STANDARD_WEIGHTS, V.STATE: -15, V.SEGMENT: 60})
    with pytest.raises(ValueError):
        Horizon(comfortable=dt.timedelta(1), viable=dt.timedelta(1))
    with pytest.raises(ValueError):
        Horizon(floor=1.0)


def test_minimal_combinations():
    weights = V.STANDARD_WEIGHTS
    pairs = scoring.minimal_combinations(50, weights)
    assert (V.ESTIMATED_VALUE, V.STATE) not in pairs and len(pairs) == 5
    assert scoring.minimal_combinations(10, weights) == [()]
    assert scoring.minimal_combinations(40, weights)[:2] == [(V.KEYWORD,), (V.SEGMENT,)]
    assert sum(weights.values()) == 100


WORDS = ["computador", "cabos", "material", "de", "limpeza", "rede", "c++", "pão", "pães", "日本"]


def world(make, seed, notices=60, profiles=25):
    rng = random.Random(seed)
    n = [
        dict(
            control_number=f"n{i}",
            object_description=" ".join(rng.choices(WORDS, k=rng.randint(1, 20))) + rng.choice(["", ".", "s"]),
            state=rng.choice(["SP", "RJ", "BA"]),
            estimated_value=rng.choice([None, Decimal(rng.randint(0, 90000))]),
            proposal_closes_at=AT + dt.timedelta(days=rng.randint(-10, 49)),
        )
        for i in range(notices)
    ]
    e = [
        dict(control_number=f"n{i}", segment=rng.choice(V.SEGMENTS[:4] + ["OTHER"]),
             confidence=rng.random(), generated_at=dt.datetime(2026, 9, rng.randint(1, 20)))
        for i in range(notices) for _ in range(rng.randint(0, 2))
    ]
    p = []
    for i in range(profiles):
        low = rng.randint(0, 50000)
        ranged = rng.random() < 0.7
        keywords = [" ".join(rng.sample(WORDS, rng.randint(1, 2))) for _ in range(rng.randint(0, 4))]
        p.append(
            dict(
                profile_id=f"p{i}", keywords=keywords, minimum_score=rng.choice([0, 5, 10, 25, 40, 41, 55, 70, 100]),
                cnaes=rng.sample(["41", "16", "62", "26", "99"], rng.randint(0, 3)),
                states=rng.sample(["SP", "RJ", "BA", "AM"], rng.randint(0, 3)),
                value_min=Decimal(low) if ranged else None,
                value_max=Decimal(low + rng.randint(0, 60000)) if ranged else None,
            )
        )
    return make.notices(*n), make.enrichments(*e), make.profiles(*p)


@pytest.mark.parametrize(
    "weights", [None, {V.KEYWORD: 10, V.SEGMENT: 20, V.ESTIMATED_VALUE: 40, V.STATE: 5, V.PROPOSAL_DEADLINE: 25}]
)
def test_pruned_search_finds_every_match(spark, make, weights):
    notices, enrichments, profiles = world(make, 20260922)
    every = evaluate(spark, notices, enrichments, profiles, weights=weights)
    assert len(every) == 60 * 25
    for r in every.values():
        assert (r.score is None) == (r.result == V.DISQUALIFIED)
        if r.score is not None:
            assert 0 <= r.score <= 100 and 0 <= r.coverage <= 100
            order = [(-x.points, x.rule) for x in r.reasons]
            assert order == sorted(order) and len(order) == 5
    expected = {k: r.score for k, r in every.items() if r.result == V.MATCHED}
    near = {
        k: r.score for k, r in every.items()
        if r.result == V.BELOW_THRESHOLD and r.score >= r.threshold - 15
    }
    assert expected and near
    for rows in (200_000, 0):
        found = scoring.matches(notices, enrichments, profiles, AT, weights=weights, broadcast_rows=rows)
        got = [((r.control_number, r.profile_id), r.score) for r in found.collect()]
        assert len(got) == len(expected) and dict(got) == expected
    missed = scoring.near_misses(notices, enrichments, profiles, AT, 15, weights=weights).collect()
    assert {(r.control_number, r.profile_id): r.score for r in missed} == near
    if weights is None:
        counts = scoring.outcome_counts(notices, profiles, found, AT).collect()
        for r in counts:
            mine = [x.result for (_, p), x in every.items() if p == r.profile_id]
            assert (r.matched, r.below_threshold, r.disqualified) == (
                mine.count(V.MATCHED), mine.count(V.BELOW_THRESHOLD), mine.count(V.DISQUALIFIED)
            )
        closed = scoring.disqualified(notices, AT).select("control_number").collect()
        assert {r[0] for r in closed} == {n for (n, _), x in every.items() if x.result == V.DISQUALIFIED}
        texts = notices.select("control_number", "object_description")
        hits = scoring.keyword_matches(texts, profiles).select(
            "control_number", "profile_id", F.size("found").alias("n")
        )
        open_hits = {
            k: x for k, r in every.items() if r.result != V.DISQUALIFIED
            for x in [next(q for q in r.reasons if q.rule == V.KEYWORD)]
            if x.outcome == V.CONTRIBUTED
        }
        keyed = {(r.control_number, r.profile_id): r.n for r in hits.collect()}
        assert set(open_hits) <= set(keyed)
        assert all(x.reason.startswith(f"matched {keyed[k]} of") for k, x in open_hits.items())
