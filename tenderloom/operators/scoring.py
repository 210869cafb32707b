"""Scoring notices against search profiles.

Three outcomes exist for a pair: disqualified (the notice is closed, whatever the profile),
below the profile's threshold, or matched. Pairs are never enumerated to find the matches: a
threshold can only be reached through certain combinations of rules, so notices and profiles are
joined by equality on the evidence those combinations need, and only such pairs are scored.
"""

from __future__ import annotations

from datetime import datetime
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom import vocabulary as V
from tenderloom.functions.rows import computed_once
from tenderloom.functions.text import (
    fold,
    is_run_of,
    keyword_phrase,
    keyword_term,
    odd_runs,
    run_key,
    run_rows,
)
from tenderloom.functions.values import match_id, round_half_up, segment_of, value_octave
from tenderloom.operators.enrich import latest_enrichments
from tenderloom.operators.rules import (
    Horizon,
    Rule,
    all_rules,
    checked_weights,
    closed_reason,
    instant,
    is_open,
    keyword_hits,
)
from tenderloom.plans.sizing import BROADCAST_ROWS, fits

# Evidence a pair can show besides the deadline, which every open notice has.
_EVIDENCE = [V.KEYWORD, V.SEGMENT, V.ESTIMATED_VALUE, V.STATE]
_BITS = {rule: 1 << place for place, rule in enumerate(_EVIDENCE)}
# Notices of one key that meet its profiles in one place; a key with more is cut into slices.
SLICE_ROWS = 20_000
_NOTICE_COLUMNS = [
    "control_number",
    "object_description",
    "state",
    "estimated_value",
    "estimated_amount",
    "proposal_closes_at",
]

def prepare_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles with the names of their keywords and served segments worked out once per profile."""
    named = F.transform("keywords", lambda k: F.struct(k.alias("text"), keyword_phrase(k).alias("phrase")))
    return profiles.select(
        "profile_id",
        named.alias("matchers"),
        F.array_sort(F.array_distinct(F.transform("cnaes", segment_of))).alias("served"),
        "states",
        "value_min",
        "value_max",
        "minimum_score",
    ).withColumn(
        "wanted_phrases",
        F.array_distinct(
            F.filter(F.transform("matchers", lambda m: m["phrase"]), lambda p: p.isNotNull())
        ),
    )


def keyword_terms(profiles: DataFrame) -> DataFrame:
    """Each keyword that is looked for, once, however many profiles have it."""
    keywords = profiles.select(F.explode("keywords").alias("keyword")).distinct()
    terms = keywords.select(keyword_term(F.col("keyword")).alias("t")).select("t.*")
    return terms.filter(F.col("phrase").isNotNull()).dropDuplicates(["phrase"])


def found_phrases(texts: DataFrame, terms: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(control_number, phrases)``: the keywords that occur in each text (``control_number``,
    ``folded_object``), as whole words, in singular or plural, by name.

    Runs of words and keywords meet by one equality on a hash of their words without endings, and are
    then compared word by word. Keywords with other characters meet texts that have their words in a row,
    where their pattern decides. What travels is an id and a run of words, never a text.
    """
    odd = F.col("pattern").isNotNull()
    facts = terms.agg(
        F.collect_set(F.when(~odd, F.col("length"))).alias("plain"),
        F.collect_set(F.when(odd, F.col("length"))).alias("odd"),
    ).first()
    small = fits(terms, broadcast_rows)
    keyed = terms.withColumns({"run_key": run_key(F.col("run")), "start": F.col("parts")[0]}).drop("run", "length")
    folded = F.col("folded_object")

    def meeting(shown: DataFrame, wanted: DataFrame) -> DataFrame:
        if small:
            return shown.join(F.broadcast(wanted), "run_key")
        return shown.distinct().join(wanted.hint("merge"), "run_key")

    shown = run_rows(texts, folded, sorted(facts["plain"]) or [1], "control_number")
    met = meeting(shown, keyed.filter(~odd))
    found = met.filter(is_run_of(F.col("run"), F.col("parts"))).select("control_number", "phrase")
    if facts["odd"]:
        shown = odd_runs(texts, folded, sorted(facts["odd"]), "control_number")
        met = meeting(shown, keyed.filter(odd))
        tried = texts.join(met.select("control_number", "phrase", "pattern", "start").distinct(), "control_number")
        tried = tried.filter(F.contains(folded, F.col("start")) & F.rlike(folded, F.col("pattern")))
        found = found.unionByName(tried.select("control_number", "phrase"))
    return found.groupBy("control_number").agg(F.collect_set("phrase").alias("phrases"))


def prepare_notices(
    notices: DataFrame, enrichments: DataFrame, terms: DataFrame, partitions: int | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Notices with the keywords found in their text and their latest enrichment, if any.

    Notices are spread by control number over ``partitions`` (by default as many as any shuffle):
    the joins need them so anyway, and the expensive scoring after them then runs on every core even
    when the notices came in a few files. Pass 0 for tables bucketed by control number. The text is
    read for its keywords and left behind.
    """
    latest = latest_enrichments(enrichments).select("control_number", "segment", "confidence")
    texts = _folded_texts(notices, partitions)
    columns = [c for c in _NOTICE_COLUMNS if c != "object_description"]
    return (
        _spread(notices.select(*columns), partitions)
        .join(latest, "control_number", "left")
        .join(found_phrases(texts, terms, broadcast_rows), "control_number", "left")
        .withColumn("phrases", F.coalesce("phrases", F.array().cast("array<string>")))
    )


def _folded_texts(texts: DataFrame, partitions: int | None) -> DataFrame:
    return _spread(texts.select("control_number", "object_description"), partitions).select(
        "control_number", fold(F.col("object_description")).alias("folded_object")
    )


def _spread(rows: DataFrame, partitions: int | None) -> DataFrame:
    if partitions is None:
        partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, "control_number") if partitions else rows


def open_notices(notices: DataFrame, at: datetime) -> DataFrame:
    return notices.filter(is_open(F.col("proposal_closes_at"), instant(at)))


# Combinations of evidence -----------------------------------------------------------------------


def _within_reach(combination: tuple[str, ...], weights: dict[str, int]) -> int:
    """The most a pair can score with only this evidence and the deadline."""
    return sum(weights[r] for r in combination) + weights[V.PROPOSAL_DEADLINE]


def minimal_combinations(threshold: int, weights: dict[str, int]) -> list[tuple[str, ...]]:
    """Smallest sets of evidence that can reach a threshold: every match shows one of them."""
    found: list[tuple[str, ...]] = []
    for size in range(len(_EVIDENCE) + 1):
        for chosen in combinations(_EVIDENCE, size):
            covered = any(set(smaller) <= set(chosen) for smaller in found)
            if not covered and _within_reach(chosen, weights) >= threshold:
                found.append(chosen)
    return found


def _key(combination: tuple[str, ...], value: dict[str, Column]) -> Column:
    """Hash of one way to show a combination. A clash adds a row that the evidence test drops."""
    return F.xxhash64(F.lit("+".join(combination)), *[value[rule] for rule in combination])


def _every(arrays: dict[str, Column], combination: tuple[str, ...]) -> Column:
    """All ways to show a combination: the hashes of the product of the evidence values."""

    def extend(left: tuple[str, ...], value: dict[str, Column]) -> Column:
        if not left:
            return F.array(_key(combination, value))
        return F.flatten(
            F.transform(arrays[left[0]], lambda v: extend(left[1:], {**value, left[0]: v}))
        )

    return extend(combination, {})


def _profile_evidence() -> dict[str, Column]:
    none = F.array().cast("array<int>")
    octaves = F.sequence("first_octave", "last_octave")
    return {
        V.KEYWORD: F.col("wanted_phrases"),
        V.SEGMENT: F.col("served"),
        V.ESTIMATED_VALUE: F.when(F.col("first_octave").isNotNull(), octaves).otherwise(none),
        V.STATE: F.array_distinct("states"),
    }


def _with_profile_evidence(profiles: DataFrame) -> DataFrame:
    low, high = F.col("value_min"), F.col("value_max")
    return profiles.withColumns(
        {
            "first_octave": F.when(low <= high, value_octave(low)),
            "last_octave": F.when(low <= high, value_octave(high)),
        }
    )


def _notice_keys(used: list[tuple[str, ...]]) -> Column:
    """What a notice shows, as rows of combination number, keyword and key."""
    value = {
        V.SEGMENT: F.col("segment"),
        V.ESTIMATED_VALUE: F.col("value_octave"),
        V.STATE: F.col("state"),
    }
    no_phrase = F.lit(None).cast("string")

    def row(number: int, phrase: Column, key: Column) -> Column:
        return F.struct(
            F.lit(number).alias("combination"), phrase.alias("phrase"), key.alias("evidence_key")
        )

    none = F.array().cast("array<struct<combination:int,phrase:string,evidence_key:bigint>>")
    parts = []
    for number, combination in enumerate(used):
        present = F.lit(True)
        for rule in combination:
            if rule != V.KEYWORD:
                present = present & value[rule].isNotNull()
        if V.KEYWORD in combination:
            rows = _phrase_rows(number, combination, value, row)
        else:
            rows = F.array(row(number, no_phrase, _key(combination, value)))
        parts.append(F.when(present, rows).otherwise(none))
    return F.flatten(F.array(*parts)) if parts else none


def _phrase_rows(number: int, combination: tuple[str, ...], value: dict[str, Column], row) -> Column:
    return F.transform(
        "phrases", lambda p: row(number, p, _key(combination, {**value, V.KEYWORD: p}))
    )


def _first_needed(used: list[tuple[str, ...]], needed: dict[int, list[tuple[str, ...]]]) -> Column:
    """For each set of evidence a pair may show (its place the sum of ``_BITS``), the number of the
    first combination that the profile needs and the set has."""
    sets = F.lit(None).cast("array<int>")
    for threshold, combinations_of in needed.items():
        firsts = [
            next((F.lit(n) for n, c in enumerate(used) if c in combinations_of and has >= {*c}), F.lit(None))
            for has in ({r for r, bit in _BITS.items() if place & bit} for place in range(2 ** len(_BITS)))
        ]
        sets = F.when(F.col("floor_score") == threshold, F.array(*[f.cast("int") for f in firsts])).otherwise(sets)
    return sets


def _evidence_shown() -> Column:
    """The evidence a pair shows, as a sum of ``_BITS``."""
    shown = {
        V.KEYWORD: F.size("shared") > 0,
        V.SEGMENT: F.array_contains("served", F.col("segment")),
        V.ESTIMATED_VALUE: F.col("value_octave").between(F.col("first_octave"), F.col("last_octave")),
        V.STATE: F.array_contains("states", F.col("state")),
    }
    total = F.lit(0)
    for rule, bit in _BITS.items():
        total = total + F.when(shown[rule], bit).otherwise(0)
    return total


def _repeat_layers(most: int) -> dict[str, Column]:
    """Keywords of a profile with one name count once each, so names are weighed: layer ``b`` has those
    whose number of keywords has the bit ``b``."""
    named = F.transform("matchers", lambda m: m["phrase"])

    def layer(bit: int) -> Column:
        times = lambda p: F.size(F.filter(named, lambda q: q == p))
        return F.filter("wanted_phrases", lambda p: times(p).bitwiseAND(1 << bit) != 0)

    return {f"layer_{bit}": layer(bit) for bit in range(most.bit_length())}


def _hit_count(most: int) -> Column:
    """Number of the profile's keywords that the text has, from built-in set operations only."""
    if most <= 1:
        return F.size("shared")
    total = F.lit(0)
    for bit in range(most.bit_length()):
        total = total + (1 << bit) * F.size(F.array_intersect(f"layer_{bit}", "phrases"))
    return total


def _needs(combination: tuple[str, ...], needed: dict[int, list[tuple[str, ...]]]) -> Column:
    return F.col("floor_score").isin([t for t, sets in needed.items() if combination in sets])


def candidate_pairs(
    notices: DataFrame, profiles: DataFrame, weights: dict[str, int],
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Prepared notices and profiles side by side, once for each pair that can reach the profile's
    ``floor_score``, with their ``hit_count``.

    A pair may share several keys; it is kept at the first combination it shows, and there at the smallest
    keyword, which the two rows tell, so pairs are never shuffled or compared with each other. With few
    profile keys these go to the notices, which never move. Otherwise both meet at their keys, and a key
    that many notices carry is cut into slices of them, each of which meets all its profiles. Keywords
    are evidence as found, not word by word, so only pairs that share one meet. Both ways return the same
    pairs.
    """
    profiles = _with_profile_evidence(profiles)
    named = F.transform("matchers", lambda m: m["phrase"])
    repeats = F.transform("wanted_phrases", lambda p: F.size(F.filter(named, lambda q: q == p)))
    # At most 101 different thresholds exist.
    facts = profiles.agg(
        F.collect_set(F.greatest(F.least("floor_score", F.lit(100)), F.lit(0))).alias("thresholds"),
        F.coalesce(F.max(F.array_max(repeats)), F.lit(0)).alias("repeats"),
    ).first()
    needed = {t: minimal_combinations(t, weights) for t in facts["thresholds"]}
    used = sorted({c for sets in needed.values() for c in sets})

    evidence = _profile_evidence()
    none = F.array().cast("array<bigint>")
    keys = F.flatten(
        F.array(none, *[F.when(_needs(c, needed), _every(evidence, c)).otherwise(none) for c in used])
    )
    layers = _repeat_layers(facts["repeats"]) if facts["repeats"] > 1 else {}
    profiles = profiles.withColumns({"first_needed": _first_needed(used, needed), **layers})
    # The outer form, because the plain one makes Spark work out the keys a second time to drop
    # rows without any; here the join drops them.
    one_key = F.explode_outer(F.array_distinct(keys)).alias("evidence_key")
    wanted = profiles.select("profile_id", one_key)
    shown = notices.withColumn("value_octave", value_octave(F.col("estimated_value")))
    shown = shown.withColumn("_shown", F.explode_outer(_notice_keys(used))).select(
        "*", "_shown.combination", "_shown.phrase", "_shown.evidence_key"
    ).drop("_shown")
    if fits(wanted, broadcast_rows):
        small = F.broadcast(profiles) if fits(profiles, broadcast_rows // 10) else profiles
        met = shown.join(F.broadcast(wanted), "evidence_key").join(small, "profile_id")
    else:
        met = _met_in_slices(shown, profiles.select("*", one_key))
    met = computed_once(met, {"shared": F.array_intersect("wanted_phrases", "phrases")})
    kept = met.filter(
        (F.col("combination") == F.get("first_needed", _evidence_shown()))
        & (F.col("phrase").isNull() | (F.col("phrase") == F.array_min("shared")))
    )
    return kept.withColumn("hit_count", _hit_count(facts["repeats"])).drop(
        "evidence_key", "combination", "phrase", "shared", "first_needed", *layers
    )


def _met_in_slices(shown: DataFrame, wanted: DataFrame) -> DataFrame:
    """Notices and profiles joined by key. What a key brings together is the product of its two sides,
    so one that many notices carry would keep one task busy; its notices are dealt into slices and its
    profiles go to each."""
    heavy = shown.groupBy("evidence_key").agg(F.count(F.lit(1)).alias("rows"))
    # At most one key for each so many rows.
    heavy = F.broadcast(
        heavy.filter(F.col("evidence_key").isNotNull() & (F.col("rows") > SLICE_ROWS)).select(
            "evidence_key", F.ceil(F.col("rows") / SLICE_ROWS).cast("int").alias("slices")
        )
    )
    slices = F.coalesce("slices", F.lit(1))
    notice = shown.join(heavy, "evidence_key", "left").withColumn(
        "slice", F.pmod(F.xxhash64("control_number"), slices).cast("int")
    )
    profile = wanted.join(heavy, "evidence_key", "left").withColumn(
        "slice", F.explode(F.sequence(F.lit(0), slices - 1))
    )
    return notice.drop("slices").join(profile.drop("slices").hint("merge"), ["evidence_key", "slice"]).drop("slice")


# Scoring ----------------------------------------------------------------------------------------


def scored(pairs: DataFrame, weights: dict[str, int], at: Column, horizon: Horizon) -> DataFrame:
    """Pairs of open notices, with their ``hit_count``, and the numbers: score, coverage, and whether a
    pending rule makes the score provisional."""
    rules = all_rules(at, horizon)
    points, pending = F.lit(0.0), F.lit(False)
    for rule in rules:
        points = points + F.lit(float(weights[rule.name])) * rule.strength
        pending = pending | rule.pending
    numbers = {
        "score": round_half_up(points),
        "coverage": _coverage(rules, weights),
        "provisional": pending,
    }
    return computed_once(pairs, numbers)


def _coverage(rules: list[Rule], weights: dict[str, int]) -> Column:
    """Weight of every rule that could be evaluated; a silent one counts."""
    total = F.lit(0)
    for rule in rules:
        total = total + F.when(rule.unknown, 0).otherwise(weights[rule.name])
    return total.cast("int")


def breakdown(rules: list[Rule], weights: dict[str, int]) -> Column:
    """Reasons with individually rounded points, by points descending, then by rule name.

    Lambdas are not compiled, nor is anything inside them, so there are none.
    """
    reasons = []
    for rule in rules:
        points = round_half_up(F.lit(float(weights[rule.name])) * rule.strength)
        reason = F.struct(
            F.lit(rule.name).alias("rule"),
            rule.kind.alias("outcome"),
            rule.strength.cast("double").alias("strength"),
            points.alias("points"),
            rule.reason.alias("reason"),
        )
        reasons.append(F.struct((-points).alias("o"), F.lit(rule.name).alias("n"), reason.alias("r")))
    return F.sort_array(F.array(*reasons)).getField("r")


def explained(pairs: DataFrame, weights: dict[str, int], at: Column, horizon: Horizon) -> DataFrame:
    """Scored pairs with their reasons."""
    return pairs.withColumn("reasons", breakdown(all_rules(at, horizon), weights))


def matches(
    notices: DataFrame, enrichments: DataFrame, profiles: DataFrame, at: datetime,
    weights: dict[str, int] | None = None, horizon: Horizon = Horizon(),
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Every matched pair, with its derived id, score, coverage and reasons."""
    pairs = _candidates(notices, enrichments, profiles, at, weights, horizon, 0, broadcast_rows)
    kept = pairs.filter(F.col("score") >= F.col("minimum_score"))
    return explained(kept, checked_weights(weights), instant(at), horizon).select(
        match_id(F.col("control_number"), F.col("profile_id")).alias("match_id"),
        "control_number",
        "profile_id",
        "score",
        "coverage",
        "provisional",
        "reasons",
        instant(at).alias("evaluated_at"),
    )


def near_misses(
    notices: DataFrame, enrichments: DataFrame, profiles: DataFrame, at: datetime, margin: int,
    weights: dict[str, int] | None = None, horizon: Horizon = Horizon(),
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Pairs below their threshold by at most ``margin`` points, with reasons. A margin of 100
    lists every pair below its threshold."""
    pairs = _candidates(notices, enrichments, profiles, at, weights, horizon, margin, broadcast_rows)
    kept = pairs.filter(
        (F.col("score") < F.col("minimum_score"))
        & (F.col("score") >= F.col("minimum_score") - margin)
    )
    return explained(kept, checked_weights(weights), instant(at), horizon).select(
        "control_number",
        "profile_id",
        "score",
        F.col("minimum_score").alias("threshold"),
        "reasons",
    )


def _candidates(notices, enrichments, profiles, at, weights, horizon, margin, broadcast_rows):
    chosen = checked_weights(weights)
    terms = keyword_terms(profiles)
    subject = prepare_notices(open_notices(notices, at), enrichments, terms, broadcast_rows=broadcast_rows)
    prepared = prepare_profiles(profiles).withColumn(
        "floor_score", F.greatest(F.col("minimum_score") - margin, F.lit(0))
    )
    return scored(candidate_pairs(subject, prepared, chosen, broadcast_rows), chosen, instant(at), horizon)


def disqualified(notices: DataFrame, at: datetime) -> DataFrame:
    """Closed notices, once each: the verdict holds against every profile."""
    now = instant(at)
    return notices.filter(~is_open(F.col("proposal_closes_at"), now)).select(
        "control_number", F.lit(V.PROPOSAL_DEADLINE).alias("rule"), closed_reason(now).alias("reason")
    )


def outcome_counts(
    notices: DataFrame, profiles: DataFrame, found: DataFrame, at: datetime
) -> DataFrame:
    """Matched, below-threshold and disqualified notices per profile.

    Every open notice that did not match is below the threshold, so the counts cover all pairs
    without forming them.
    """
    open_now = is_open(F.col("proposal_closes_at"), instant(at))
    per_profile = found.groupBy("profile_id").agg(F.count(F.lit(1)).alias("matched"))
    totals = notices.agg(
        F.count_if(open_now).alias("open"), F.count_if(~open_now).alias("closed")
    ).first()
    matched = F.coalesce("matched", F.lit(0))
    return profiles.join(per_profile, "profile_id", "left").select(
        "profile_id",
        matched.cast("bigint").alias("matched"),
        (F.lit(totals["open"]) - matched).cast("bigint").alias("below_threshold"),
        F.lit(totals["closed"]).cast("bigint").alias("disqualified"),
    )


def keyword_matches(
    texts: DataFrame, profiles: DataFrame, broadcast_rows: int = BROADCAST_ROWS,
    partitions: int | None = None,
) -> DataFrame:
    """Texts (``control_number``, ``object_description``) in which a profile's keywords occur, with
    the keywords found and their share, over the whole text."""
    phrases = found_phrases(_folded_texts(texts, partitions), keyword_terms(profiles), broadcast_rows)
    prepared = prepare_profiles(profiles).select("profile_id", "matchers", "wanted_phrases")
    wanted = prepared.select("profile_id", F.explode("wanted_phrases").alias("phrase"))
    found = phrases.select("control_number", F.explode("phrases").alias("phrase"))
    few = fits(wanted, broadcast_rows)
    pairs = (
        found.join(F.broadcast(wanted) if few else wanted.hint("merge"), "phrase")
        .groupBy("control_number", "profile_id")
        .agg(F.collect_set("phrase").alias("phrases"))
    )
    named = prepared.select("profile_id", "matchers")
    pairs = pairs.join(F.broadcast(named) if few and fits(named, broadcast_rows) else named, "profile_id")
    hits = computed_once(pairs, {"hits": keyword_hits()})
    return hits.select(
        "control_number",
        "profile_id",
        F.transform("hits", lambda h: h["text"]).alias("found"),
        (F.size("hits").cast("double") / F.size("matchers")).alias("share"),
    )


def evaluate_pairs(
    pairs: DataFrame, notices: DataFrame, enrichments: DataFrame, profiles: DataFrame,
    at: datetime, weights: dict[str, int] | None = None, horizon: Horizon = Horizon(),
) -> DataFrame:
    """The full result of given pairs (control number and profile id): matched, below threshold
    or disqualified, with score, coverage and reasons for the first two."""
    chosen, now = checked_weights(weights), instant(at)
    asked = pairs.select("control_number", "profile_id").distinct()
    open_now = F.coalesce(is_open(F.col("proposal_closes_at"), now), F.lit(False))

    # A closed notice is disqualified whatever its text says, so nothing of it is read but the date.
    closed = (
        asked.join(notices.filter(~open_now).select("control_number", "proposal_closes_at"), "control_number")
        .join(profiles.select("profile_id", "minimum_score"), "profile_id")
        .select(
            "control_number",
            "profile_id",
            F.lit(V.DISQUALIFIED).alias("result"),
            F.lit(V.PROPOSAL_DEADLINE).alias("disqualified_by"),
            closed_reason(now).alias("reason"),
            F.col("minimum_score").alias("threshold"),
        )
    )
    mine = notices.filter(open_now).join(asked.select("control_number").distinct(), "control_number", "left_semi")
    subject = prepare_notices(mine, enrichments, keyword_terms(profiles))
    joined = asked.join(subject, "control_number").join(prepare_profiles(profiles), "profile_id")
    joined = computed_once(joined, {"hit_count": F.size(keyword_hits())})
    numbers = explained(scored(joined, chosen, now, horizon), chosen, now, horizon)
    result = F.when(F.col("score") >= F.col("minimum_score"), V.MATCHED).otherwise(V.BELOW_THRESHOLD)
    evaluated = numbers.select(
        "control_number",
        "profile_id",
        result.alias("result"),
        F.lit(None).cast("string").alias("disqualified_by"),
        F.lit(None).cast("string").alias("reason"),
        F.col("minimum_score").alias("threshold"),
        "score",
        "coverage",
        "provisional",
        "reasons",
    )
    return evaluated.unionByName(closed, allowMissingColumns=True)
