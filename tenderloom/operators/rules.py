"""The five scoring rules as column expressions.

A rule answers a notice and a profile on one row with a kind, a strength in [0,1] and a sentence.
``kind`` tells apart what contributed, what stayed silent, what cannot be evaluated for this pair
and what is not known yet. Strengths are separate from sentences, so that a score can be computed
and filtered on before any text is built.

Columns expected: those of ``prepare_profiles`` and ``prepare_notices``, ``segment`` and
``confidence`` from the enrichment (null where there is none), and ``hit_count``, the number of
``keyword_hits``, which a score needs without their texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderloom import vocabulary as V
from tenderloom.functions.text import sentence
from tenderloom.functions.times import instant_text
from tenderloom.functions.values import plain_number

_DAY_MICROS = 86_400_000_000


@dataclass(frozen=True)
class Horizon:
    """Deadlines at or beyond ``comfortable`` count fully, at or inside ``viable`` as the floor."""

    comfortable: timedelta = timedelta(days=14)
    viable: timedelta = timedelta(days=2)
    floor: float = 0.10

    def __post_init__(self) -> None:
        if self.viable <= timedelta(0) or self.comfortable <= self.viable:
            raise ValueError("a horizon needs comfortable > viable > 0")
        if not 0.0 <= self.floor < 1.0:
            raise ValueError("the floor strength must be within [0,1)")


@dataclass(frozen=True)
class Rule:
    """``unknown`` says that a rule cannot be evaluated for a pair, for good or (``pending``) for now."""

    name: str
    kind: Column
    strength: Column
    reason: Column
    unknown: Column
    pending: Column = field(default_factory=lambda: F.lit(False))


def checked_weights(weights: dict[str, int] | None) -> dict[str, int]:
    """Weights of all five rules, none negative, adding up to 100."""
    chosen = dict(V.STANDARD_WEIGHTS if weights is None else weights)
    for rule in V.RULES:
        if chosen.get(rule) is None:
            raise ValueError(f"no weight was given for rule {rule}")
        if chosen[rule] < 0:
            raise ValueError(f"a negative weight was given for rule {rule}")
    if sum(chosen[r] for r in V.RULES) != 100:
        raise ValueError("weights must sum to 100")
    return chosen


def instant(at: datetime) -> Column:
    """A literal instant; a naive datetime is taken as UTC."""
    aware = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    micros = (aware - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
    return F.timestamp_micros(F.lit(micros))


def is_open(closes_at: Column, at: Column) -> Column:
    """Closed from the closing instant on."""
    return at < closes_at


def keyword_hits() -> Column:
    """Matchers of the keywords found, given the ``phrases`` that the text has."""
    return F.filter("matchers", lambda m: F.array_contains("phrases", m["phrase"]))


def keyword_rule() -> Rule:
    total = F.size("matchers")
    hits = F.col("hit_count")
    return Rule(
        V.KEYWORD,
        F.when(total == 0, V.UNAVAILABLE).when(hits == 0, V.SILENT).otherwise(V.CONTRIBUTED),
        F.when(total > 0, hits.cast("double") / total).otherwise(0.0),
        F.when(total == 0, V.NO_KEYWORDS)
        .when(hits == 0, sentence(V.NO_KEYWORD_HIT, total))
        .otherwise(
            sentence(
                V.KEYWORD_HITS,
                hits,
                total,
                F.array_join(F.transform(keyword_hits(), lambda h: h["text"]), ", "),
            )
        ),
        total == 0,
    )


def segment_rule() -> Rule:
    known = F.col("segment").isNotNull()
    served = F.array_contains("served", F.col("segment"))
    percent = F.round((F.col("confidence") * 100).cast("decimal(24,10)"), 0).cast("int")
    none = F.size("served") == 0
    return Rule(
        V.SEGMENT,
        F.when(none, V.UNAVAILABLE)
        .when(~known, V.PENDING)
        .when(served, V.CONTRIBUTED)
        .otherwise(V.SILENT),
        F.when(known & F.coalesce(served, F.lit(False)), F.col("confidence")).otherwise(0.0),
        F.when(none, V.NO_CNAES)
        .when(~known, V.NOT_ENRICHED)
        .when(
            served, sentence(V.SEGMENT_SERVED, F.col("segment"), percent.cast("string"))
        )
        .otherwise(
            sentence(
                V.SEGMENT_NOT_SERVED, F.col("segment"), F.array_join("served", ", ")
            )
        ),
        none | ~known,
        ~none & ~known,
    )


def value_in_range(
    value: Column, low: Column, high: Column, amount: Column | None = None
) -> Column:
    """Whether a value lies in a range. ``value`` may be cut after the decimals a limit can have;
    with ``amount``, its exact text, what was cut counts at the upper limit."""
    inside = value.between(low, high)
    if amount is not None:
        more = F.coalesce(amount != plain_number(value), F.lit(False))
        inside = inside & ~((value == high) & more)
    return F.coalesce(inside, F.lit(False))


def value_rule() -> Rule:
    value, low, high = F.col("estimated_value"), F.col("value_min"), F.col("value_max")
    amount = F.coalesce("estimated_amount", plain_number(value))
    inside = value_in_range(value, low, high, amount)
    texts = [amount, plain_number(low), plain_number(high)]
    no_range = low.isNull() | high.isNull()
    return Rule(
        V.ESTIMATED_VALUE,
        F.when(no_range | value.isNull(), V.UNAVAILABLE)
        .when(inside, V.CONTRIBUTED)
        .otherwise(V.SILENT),
        F.when(inside, 1.0).otherwise(0.0),
        F.when(no_range, V.NO_RANGE)
        .when(value.isNull(), V.SECRET_BUDGET)
        .when(inside, sentence(V.VALUE_INSIDE, *texts))
        .otherwise(sentence(V.VALUE_OUTSIDE, *texts)),
        no_range | value.isNull(),
    )


def state_rule() -> Rule:
    none = F.size("states") == 0
    wanted = F.array_contains("states", F.col("state"))
    return Rule(
        V.STATE,
        F.when(none, V.UNAVAILABLE).when(wanted, V.CONTRIBUTED).otherwise(V.SILENT),
        F.when(wanted, 1.0).otherwise(0.0),
        F.when(none, V.NO_STATES)
        .when(wanted, sentence(V.STATE_WANTED, F.col("state")))
        .otherwise(sentence(V.STATE_NOT_WANTED, F.col("state"))),
        none,
    )


def deadline_strength(closes_at: Column, at: Column, horizon: Horizon) -> Column:
    remaining = F.unix_micros(closes_at) - F.unix_micros(at)
    comfortable = horizon.comfortable // timedelta(microseconds=1)
    viable = horizon.viable // timedelta(microseconds=1)
    share = (remaining - viable).cast("double") / F.lit(float(comfortable - viable))
    return (
        F.when(remaining >= comfortable, 1.0)
        .when(remaining <= viable, F.lit(horizon.floor))
        .otherwise(F.lit(horizon.floor) + F.lit(1.0 - horizon.floor) * share)
    )


def deadline_rule(at: Column, horizon: Horizon) -> Rule:
    closes_at = F.col("proposal_closes_at")
    days = F.floor((F.unix_micros(closes_at) - F.unix_micros(at)) / F.lit(_DAY_MICROS))
    return Rule(
        V.PROPOSAL_DEADLINE,
        F.lit(V.CONTRIBUTED),
        deadline_strength(closes_at, at, horizon),
        sentence(V.DEADLINE_OPEN, instant_text(closes_at), days),
        F.lit(False),
    )


def closed_reason(at: Column) -> Column:
    return sentence(
        V.DEADLINE_CLOSED, instant_text(F.col("proposal_closes_at")), instant_text(at)
    )


def all_rules(at: Column, horizon: Horizon) -> list[Rule]:
    """In evaluation order, which is also the order strengths are added up in."""
    return [keyword_rule(), segment_rule(), value_rule(), state_rule(), deadline_rule(at, horizon)]
