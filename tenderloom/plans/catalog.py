"""Every job as a query over the sample tables, with the same question in SQL where SQL can ask it.

Dates and instants leave as text and money as plain decimals, so that results of two engines
compare as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom import vocabulary as V
from tenderloom.functions import times, values
from tenderloom.operators import (
    consume,
    coverage,
    enrich,
    ingest,
    mapping,
    reports,
    rules,
    scoring,
    validate,
)
from tenderloom.plans import discovery
from tenderloom.plans import examples as X
from tenderloom.plans.oracle_views import AT, with_views
from tenderloom.plans.sizing import BROADCAST_ROWS, fits
from tenderloom.session import configure, shared_folder
from tenderloom.sources import landing, messages, tables
from tenderloom.streaming import ingest as streaming


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Entry] = {}


def _query(name: str, needs: list[str] | None = None, sql: str | None = None):
    def register(run):
        def configured(spark: SparkSession, folder: str) -> DataFrame:
            return run(configure(spark), folder)

        CATALOG[name] = Entry(configured, None if sql is None else with_views(needs or [], sql))
        return run

    return register


def _text(column: str, alias: str | None = None) -> Column:
    """A date or a whole-second instant as text."""
    return F.col(column).cast("string").alias(alias or column)


def _inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return X.notices(spark, folder), X.enrichments(spark, folder), X.profiles(spark, folder)


def _day(text: str) -> Column:
    return F.lit(text).cast("date")


def _now() -> Column:
    return rules.instant(X.EVALUATED_AT)


def _matched(spark: SparkSession, folder: str, some: DataFrame | None = None) -> DataFrame:
    """Matches of all notices, or of those with a control number in ``some``."""
    notices, enrichments, profiles = _inputs(spark, folder)
    if some is not None:
        notices = notices.join(some, "control_number", "left_semi")
    return scoring.matches(notices, enrichments, profiles, X.EVALUATED_AT)


def _evaluated(spark: SparkSession, folder: str) -> DataFrame:
    notices, enrichments, profiles = _inputs(spark, folder)
    return scoring.evaluate_pairs(
        X.pairs(spark, folder), notices, enrichments, profiles, X.EVALUATED_AT
    )


def _stored_once(spark: SparkSession, rows: DataFrame, purpose: str) -> DataFrame:
    """Rows that feed several outputs, written to the shared folder so that they are worked out once."""
    home = shared_folder(spark, purpose)
    tables.write_batch(rows, home, 0)
    return spark.read.schema(rows.schema).parquet(f"{home}/batch_id=0")


# Scoring ----------------------------------------------------------------------------------------


@_query(
    "score_matches",
    ["matched"],
    """
    SELECT match_id, control_number, profile_id, score, coverage, provisional,
      '2026-09-22 12:00:00' AS evaluated_at
    FROM matched
    """,
)
def score_matches(spark, folder):
    return _matched(spark, folder).select(
        "match_id", "control_number", "profile_id", "score", "coverage", "provisional",
        _text("evaluated_at"),
    )


@_query(
    "score_near_misses",
    ["scored"],
    """
    SELECT control_number, profile_id, score, minimum_score AS threshold
    FROM scored WHERE NOT closed AND score < minimum_score AND score >= minimum_score - 10
    """,
)
def score_near_misses(spark, folder):
    return scoring.near_misses(*_inputs(spark, folder), X.EVALUATED_AT, margin=10).select(
        "control_number", "profile_id", "score", "threshold"
    )


@_query(
    "score_disqualified",
    ["notices"],
    f"""
    SELECT control_number, 'PROPOSAL_DEADLINE' AS rule,
      'the proposal window closed at ' || strftime(closes, '%Y-%m-%dT%H:%M:%SZ')
        || ', before the evaluation at 2026-09-22T12:00:00Z' AS reason
    FROM notices WHERE closes <= {AT}
    """,
)
def score_disqualified(spark, folder):
    return scoring.disqualified(X.notices(spark, folder), X.EVALUATED_AT)


@_query(
    "score_outcome_counts",
    ["scored"],
    """
    SELECT profile_id,
      count(*) FILTER (NOT closed AND score >= minimum_score) AS matched,
      count(*) FILTER (NOT closed AND score < minimum_score) AS below_threshold,
      count(*) FILTER (closed) AS disqualified
    FROM scored GROUP BY profile_id
    """,
)
def score_outcome_counts(spark, folder):
    notices, enrichments, profiles = _inputs(spark, folder)
    found = scoring.matches(notices, enrichments, profiles, X.EVALUATED_AT)
    return scoring.outcome_counts(notices, profiles, found, X.EVALUATED_AT)


@_query(
    "score_given_pairs",
    ["scored", "asked"],
    """
    SELECT control_number, profile_id,
      CASE WHEN closed THEN 'DISQUALIFIED' WHEN score >= minimum_score THEN 'MATCHED'
        ELSE 'BELOW_THRESHOLD' END AS result,
      CASE WHEN NOT closed THEN score END AS score,
      CASE WHEN NOT closed THEN coverage END AS coverage,
      CASE WHEN NOT closed THEN provisional END AS provisional
    FROM scored JOIN asked USING (control_number, profile_id)
    """,
)
def score_given_pairs(spark, folder):
    return _evaluated(spark, folder).select(
        "control_number", "profile_id", "result", "score", "coverage", "provisional"
    )


_REASONS = """
    SELECT control_number, profile_id, u.rule AS rule, u.kind AS outcome, u.points AS points,
      u.reason AS reason,
      CAST(row_number() OVER (PARTITION BY control_number, profile_id
        ORDER BY u.points DESC, u.rule) AS INTEGER) AS place
    FROM (
      SELECT control_number, profile_id, unnest([
        {'rule': 'KEYWORD', 'kind': keyword_kind,
         'points': CAST(floor(30 * keyword_strength + 0.5) AS INTEGER),
         'reason': CASE keyword_kind WHEN 'UNAVAILABLE' THEN 'the profile declares no keywords'
           WHEN 'SILENT' THEN 'none of the ' || keyword_count
             || ' profile keywords appear in the object description' END},
        {'rule': 'SEGMENT', 'kind': segment_kind,
         'points': CAST(floor(30 * segment_strength + 0.5) AS INTEGER),
         'reason': CASE segment_kind WHEN 'UNAVAILABLE' THEN
             'the profile declares no CNAEs, so no segment can be derived for the company'
           WHEN 'PENDING' THEN 'the procurement has not been enriched, so its segment is unknown'
           WHEN 'SILENT' THEN 'inferred segment ' || segment
             || ' is not one the company serves [' || array_to_string(served, ', ') || ']'
           ELSE 'inferred segment ' || segment || ' is one the company serves, inferred with '
             || CAST(round(confidence * 100) AS INTEGER) || '% confidence' END},
        {'rule': 'ESTIMATED_VALUE', 'kind': value_kind,
         'points': CAST(floor(15 * value_strength + 0.5) AS INTEGER),
         'reason': CASE WHEN value_min IS NULL THEN 'the profile declares no value range'
           WHEN estimated_value IS NULL THEN
             'the procurement carries no estimated value, the budget is secret'
           ELSE 'estimated at ' || regexp_replace(CAST(estimated_value AS VARCHAR), '\\.?0+$', '')
             || CASE value_kind WHEN 'CONTRIBUTED' THEN ', inside the ' ELSE ', outside the ' END
             || CAST(CAST(value_min AS BIGINT) AS VARCHAR) || ' to '
             || CAST(CAST(value_max AS BIGINT) AS VARCHAR) || ' the profile asks for' END},
        {'rule': 'STATE', 'kind': state_kind,
         'points': CAST(floor(15 * state_strength + 0.5) AS INTEGER),
         'reason': CASE state_kind WHEN 'UNAVAILABLE' THEN
             'the profile names no states, so geography cannot tell procurements apart'
           WHEN 'CONTRIBUTED' THEN 'published in ' || state || ', which the profile asks for'
           ELSE 'published in ' || state || ', which the profile does not ask for' END},
        {'rule': 'PROPOSAL_DEADLINE', 'kind': 'CONTRIBUTED',
         'points': CAST(floor(10 * deadline_strength + 0.5) AS INTEGER),
         'reason': 'proposals close at ' || strftime(closes, '%Y-%m-%dT%H:%M:%SZ') || ', '
           || date_diff('microsecond', TIMESTAMP '2026-09-22 12:00:00', closes) // 86400000000
           || ' days away'}]) AS u
      FROM strengths JOIN asked USING (control_number, profile_id) WHERE NOT closed)
    """


@_query("rule_breakdown", ["strengths", "asked"], _REASONS)
def rule_breakdown(spark, folder):
    """Reasons in order. What a keyword hit says is covered by ``keyword_hits``."""
    reasons = _evaluated(spark, folder).select(
        "control_number", "profile_id", F.posexplode("reasons").alias("place", "r")
    )
    listed = (F.col("r.rule") == V.KEYWORD) & (F.col("r.outcome") == V.CONTRIBUTED)
    return reasons.select(
        "control_number",
        "profile_id",
        F.col("r.rule").alias("rule"),
        F.col("r.outcome").alias("outcome"),
        F.col("r.points").alias("points"),
        F.when(~listed, F.col("r.reason")).alias("reason"),
        (F.col("place") + 1).alias("place"),
    )


@_query(
    "keyword_reasons",
    ["strengths", "asked", "texts", "keyword_patterns"],
    """
    SELECT control_number, profile_id, 'matched ' || count(*) || ' of ' || any_value(total)
      || ' keywords: ' || string_agg(keyword, ', ' ORDER BY place) AS reason
    FROM (SELECT control_number, profile_id FROM strengths JOIN asked USING (control_number, profile_id)
      WHERE NOT closed)
    JOIN (SELECT control_number, object_description FROM notices) USING (control_number)
    JOIN (SELECT profile_id, len(keywords) AS total, unnest(keywords) AS keyword,
      generate_subscripts(keywords, 1) AS place FROM profiles) USING (profile_id)
    JOIN (SELECT object_description, keyword FROM texts, keyword_patterns
      WHERE regexp_matches(folded, pattern)) USING (object_description, keyword)
    GROUP BY control_number, profile_id
    """,
)
def keyword_reasons(spark, folder):
    """The sentence of every keyword hit: which of the profile's keywords, as they are written there."""
    reasons = _evaluated(spark, folder).select("control_number", "profile_id", F.explode("reasons").alias("r"))
    hit = (F.col("r.rule") == V.KEYWORD) & (F.col("r.outcome") == V.CONTRIBUTED)
    return reasons.filter(hit).select("control_number", "profile_id", F.col("r.reason").alias("reason"))


@_query(
    "evidence_coverage",
    ["scored", "asked"],
    """
    SELECT coverage, provisional, count(*) AS pairs
    FROM scored JOIN asked USING (control_number, profile_id)
    WHERE NOT closed GROUP BY coverage, provisional
    """,
)
def evidence_coverage(spark, folder):
    pairs = _evaluated(spark, folder).filter(F.col("result") != V.DISQUALIFIED)
    return pairs.groupBy("coverage", "provisional").agg(F.count(F.lit(1)).alias("pairs"))


@_query(
    "keyword_hits",
    [],
    r"""
    WITH items AS MATERIALIZED (
      SELECT CAST(item_id AS VARCHAR) AS profile_id, unnest([split_part(text, ' ', 1),
        split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2),
        split_part(text, ' ', 2) || 's']) AS keyword FROM benchmark),
    patterns AS MATERIALIZED (
      SELECT keyword, '\b' || array_to_string(list_transform(
        list_filter(string_split_regex(trim(lower(strip_accents(keyword))), '\s+'),
          lambda t: t <> ''),
        lambda t: regexp_escape(CASE
          WHEN length(t) > 4 AND t LIKE '%es' THEN t[1:length(t) - 2]
          WHEN length(t) > 3 AND t LIKE '%s' THEN t[1:length(t) - 1] ELSE t END)
          || '(?:es|s)?'), '\s+') || '\b' AS pattern
      FROM (SELECT DISTINCT keyword FROM items)),
    folded AS MATERIALIZED (SELECT CAST(doc_id AS VARCHAR) AS control_number,
      lower(strip_accents(text)) AS body FROM documents),
    occurs AS MATERIALIZED (SELECT control_number, keyword FROM folded, patterns
      WHERE regexp_matches(body, pattern))
    SELECT control_number, profile_id, CAST(count(*) AS INTEGER) AS hits,
      CAST(count(*) AS DOUBLE) / 3 AS share
    FROM occurs JOIN items USING (keyword) GROUP BY control_number, profile_id
    """,
)
def keyword_hits(spark, folder):
    found = scoring.keyword_matches(
        X.keyword_texts(spark, folder), X.keyword_profiles(spark, folder)
    )
    return found.select("control_number", "profile_id", F.size("found").alias("hits"), "share")


@_query(
    "cnae_segment_map",
    ["profiles", "divisions"],
    """
    SELECT profile_id, cnae, regexp_replace(cnae, '[^0-9]', '', 'g')[1:2] AS division,
      coalesce(segment, 'OTHER') AS segment
    FROM (SELECT profile_id, unnest(cnaes) AS cnae FROM profiles)
    LEFT JOIN divisions ON division = regexp_replace(cnae, '[^0-9]', '', 'g')[1:2]
    """,
)
def cnae_segment_map(spark, folder):
    codes = X.profiles(spark, folder).select("profile_id", F.explode("cnaes").alias("cnae"))
    return codes.select(
        "profile_id",
        "cnae",
        values.cnae_division(F.col("cnae")).alias("division"),
        values.segment_of(F.col("cnae")).alias("segment"),
    )


@_query("served_segments", ["served"],
        "SELECT profile_id, array_to_string(served, ',') AS served FROM served")
def served_segments(spark, folder):
    prepared = scoring.prepare_profiles(X.profiles(spark, folder))
    return prepared.filter(F.size("served") > 0).select(
        "profile_id", F.array_join("served", ",").alias("served")
    )


@_query(
    "value_in_range",
    ["notices", "profiles", "asked"],
    """
    SELECT profile_id, count(*) AS inside FROM asked
    JOIN notices USING (control_number) JOIN profiles USING (profile_id)
    WHERE estimated_value BETWEEN value_min AND value_max GROUP BY profile_id
    """,
)
def value_in_range(spark, folder):
    joined = (
        X.pairs(spark, folder)
        .join(X.notices(spark, folder).select("control_number", "estimated_value"), "control_number")
        .join(X.profiles(spark, folder).select("profile_id", "value_min", "value_max"), "profile_id")
    )
    inside = rules.value_in_range(F.col("estimated_value"), F.col("value_min"), F.col("value_max"))
    return joined.filter(inside).groupBy("profile_id").agg(F.count(F.lit(1)).alias("inside"))


@_query(
    "deadline_strength",
    ["notices"],
    f"""
    SELECT control_number, CASE
      WHEN date_diff('microsecond', {AT}, closes) >= 1209600000000 THEN CAST(1 AS DOUBLE)
      WHEN date_diff('microsecond', {AT}, closes) <= 172800000000 THEN CAST(0.1 AS DOUBLE)
      ELSE CAST(0.1 AS DOUBLE) + CAST(0.9 AS DOUBLE)
        * (CAST(date_diff('microsecond', {AT}, closes) - 172800000000 AS DOUBLE)
          / CAST(1036800000000 AS DOUBLE)) END AS strength
    FROM notices WHERE closes > {AT}
    """,
)
def deadline_strength(spark, folder):
    still_open = scoring.open_notices(X.notices(spark, folder), X.EVALUATED_AT)
    strength = rules.deadline_strength(F.col("proposal_closes_at"), _now(), rules.Horizon())
    return still_open.select("control_number", strength.alias("strength"))


@_query(
    "match_ids",
    ["asked"],
    """
    SELECT control_number, profile_id,
      substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-'
        || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1)
        || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS match_id
    FROM (SELECT *, md5(control_number || '|' || profile_id) AS h FROM asked)
    """,
)
def match_ids(spark, folder):
    return X.pairs(spark, folder).select(
        "*", values.match_id(F.col("control_number"), F.col("profile_id")).alias("match_id")
    )


@_query(
    "matches_of_profile",
    ["matched"],
    "SELECT control_number, score FROM matched WHERE profile_id = '1'",
)
def matches_of_profile(spark, folder):
    """Read from the stored table."""
    return tables.find(_stored_matches(spark, folder)[0], profile_id="1").select("control_number", "score")


def _stored_matches(spark, folder):
    """Matches worked out once and stored by id; and where."""
    home = shared_folder(spark, "matches")
    found = _matched(spark, folder).select("match_id", "control_number", "profile_id", "score")
    tables.store_keyed(found, home, "match_id", 16)
    return tables.read_keyed(spark, home, found.schema), home


@_query(
    "match_by_id",
    ["matched"],
    """
    SELECT match_id, control_number, profile_id, score FROM matched
    WHERE match_id = (SELECT min(match_id) FROM matched)
    """,
)
def match_by_id(spark, folder):
    stored, _ = _stored_matches(spark, folder)
    wanted = stored.agg(F.min("match_id")).first()[0]
    return tables.find_keyed(stored, "match_id", wanted, 16)


@_query(
    "match_upsert",
    ["scored", "matched"],
    """
    SELECT match_id, control_number, profile_id,
      CAST(CASE WHEN segment IS NOT NULL THEN score ELSE -1 END AS INTEGER) AS score
    FROM matched
    """,
)
def match_upsert(spark, folder):
    """Matches are stored once without a score, then those of enriched notices are scored again."""
    found, _ = _stored_matches(spark, folder)
    home, scratch = shared_folder(spark, "matches"), shared_folder(spark, "matches-next")
    tables.store_keyed(found.withColumn("score", F.lit(-1)), home, "match_id", 16, placed=True)
    found = found.drop("bucket")
    enriched = X.enrichments(spark, folder).select("control_number").distinct()
    # Matches are many more than their notices, so they stay where they are if these can come to them.
    enriched = F.broadcast(enriched) if fits(enriched, 10 * BROADCAST_ROWS) else enriched
    again = found.join(enriched, "control_number", "left_semi").select(*found.columns)
    tables.upsert_keyed(again, home, "match_id", scratch, 16)
    return tables.read_keyed(spark, home, found.schema).drop("bucket")


@_query(
    "latest_enrichment",
    ["latest"],
    """
    SELECT control_number, segment, confidence,
      strftime(generated_at, '%Y-%m-%d %H:%M:%S') AS generated_at FROM latest
    """,
)
def latest_enrichment(spark, folder):
    return enrich.latest_enrichments(X.enrichments(spark, folder)).select(
        "control_number", "segment", "confidence", _text("generated_at")
    )


@_query(
    "enrichment_reuse_by_text",
    ["notices", "latest"],
    """
    SELECT n.control_number, k.segment, k.confidence
    FROM (SELECT * FROM notices WHERE control_number NOT IN (SELECT control_number FROM latest)) n
    JOIN (SELECT object_description, segment, confidence FROM notices JOIN latest
        USING (control_number)
      QUALIFY row_number() OVER (PARTITION BY object_description
        ORDER BY generated_at DESC, segment DESC, confidence DESC) = 1) k
    USING (object_description)
    """,
)
def enrichment_reuse_by_text(spark, folder):
    notices, enrichments, _ = _inputs(spark, folder)
    missing = enrich.missing_enrichment(notices, enrichments)
    return enrich.reuse_by_text(missing, notices, enrichments).select(
        "control_number", "segment", "confidence"
    )


_HINTS = [
    ("bolt", "CONSTRUCTION_MATERIALS"),
    ("plates", "CONSTRUCTION_MATERIALS"),
    ("gear", "VEHICLES_AND_FLEET"),
    ("furniture", "FURNITURE"),
    ("building", "CIVIL_WORKS"),
    ("machinery", "VEHICLES_AND_FLEET"),
]


@_query(
    "enrichment_by_words",
    ["notices", "latest"],
    """
    SELECT control_number, segment, votes / CAST(total AS DOUBLE) AS confidence FROM (
      SELECT control_number, segment, count(*) AS votes,
        sum(count(*)) OVER (PARTITION BY control_number) AS total
      FROM (SELECT DISTINCT control_number, unnest(regexp_split_to_array(
          lower(strip_accents(object_description)), '[^a-z0-9_]+')) AS word
        FROM notices WHERE control_number NOT IN (SELECT control_number FROM latest))
      JOIN (VALUES ('bolt', 'CONSTRUCTION_MATERIALS'), ('plates', 'CONSTRUCTION_MATERIALS'),
        ('gear', 'VEHICLES_AND_FLEET'), ('furniture', 'FURNITURE'), ('building', 'CIVIL_WORKS'),
        ('machinery', 'VEHICLES_AND_FLEET')) AS hints(word, segment) USING (word)
      GROUP BY control_number, segment)
    QUALIFY row_number() OVER (PARTITION BY control_number ORDER BY votes DESC, segment) = 1
    """,
)
def enrichment_by_words(spark, folder):
    notices, enrichments, _ = _inputs(spark, folder)
    hints = spark.createDataFrame(_HINTS, "word string, segment string")
    missing = enrich.missing_enrichment(notices, enrichments)
    return enrich.enrich_by_words(missing, hints, _now()).drop("generated_at")


@_query("text_hashes", ["notices"],
        "SELECT control_number, sha256(object_description) AS text_hash FROM notices")
def text_hashes(spark, folder):
    return X.notices(spark, folder).select(
        "control_number", values.text_hash(F.col("object_description")).alias("text_hash")
    )


_FEEDBACK = """
    SELECT profile_id, match_id, CASE WHEN toxic = 0 AND quality = 1 THEN 1 ELSE 0 END AS good
    FROM matched JOIN labels ON control_number = CAST(doc_id AS VARCHAR)
    """


@_query(
    "feedback_precision",
    ["matched"],
    f"""
    SELECT profile_id, count(*) FILTER (good = 1) AS relevant, count(*) AS judged,
      count(*) FILTER (good = 1) / CAST(count(*) AS DOUBLE) AS precision
    FROM ({_FEEDBACK}) GROUP BY profile_id
    """,
)
def feedback_precision(spark, folder):
    matched = _matched(spark, folder, X.judged(spark, folder)).select("match_id", "control_number", "profile_id")
    matched = _stored_once(spark, matched, "matched")
    return reports.feedback_precision(X.feedback(spark, folder, matched), matched)


@_query(
    "feedback_appended",
    ["matched"],
    """
    SELECT match_id, 2 AS events, 2 AS ids, 'NOT_RELEVANT' AS last_verdict FROM matched
    """,
)
def feedback_appended(spark, folder):
    """Two judgements of every match, the second taking the first back: both stay on record."""
    home = shared_folder(spark, "feedback")
    ids = _stored_once(spark, _matched(spark, folder).select("match_id"), "matched")
    for hours, verdict in enumerate(["RELEVANT", "NOT_RELEVANT"]):
        given = F.timestamp_micros(F.unix_micros(_now()) + hours * 3_600_000_000)
        tables.write_batch(tables.feedback_events(ids, F.lit(verdict), given), home, hours)
    events = spark.read.parquet(home)
    counts = [F.count(F.lit(1)).cast("int").alias("events"), F.count_distinct("feedback_id").cast("int").alias("ids")]
    last = tables.latest_verdicts(events, *counts)
    return last.select("match_id", "events", "ids", F.col("verdict").alias("last_verdict"))


@_query(
    "latest_feedback",
    ["matched"],
    f"""
    SELECT match_id, CASE good WHEN 1 THEN 'RELEVANT' ELSE 'NOT_RELEVANT' END AS verdict
    FROM ({_FEEDBACK})
    """,
)
def latest_feedback(spark, folder):
    matched = _matched(spark, folder, X.judged(spark, folder)).select("match_id", "control_number", "profile_id")
    return tables.latest_verdicts(X.feedback(spark, folder, matched)).select("match_id", "verdict")


# Ingestion --------------------------------------------------------------------------------------


@_query("lww_verdicts", ["plain_verdicts"],
        "SELECT control_number, seq, outcome FROM plain_verdicts")
def lww_verdicts(spark, folder):
    return ingest.verdicts(X.deliveries(spark, folder)).select("control_number", "seq", "outcome")


@_query("lww_verdicts_in_blocks", ["plain_verdicts"],
        "SELECT control_number, seq, outcome FROM plain_verdicts")
def lww_verdicts_in_blocks(spark, folder):
    decided = ingest.verdicts(X.deliveries(spark, folder), hash_covers_time=True, blocks=24)
    return decided.select("control_number", "seq", "outcome")


_UNEVEN = """CASE WHEN d.content = w.content THEN 'unchanged' WHEN d.t < w.t THEN 'stale'
      ELSE 'stored' END"""


@_query(
    "lww_verdicts_uneven",
    [],
    f"""
    SELECT control_number, seq, outcome FROM (
      WITH RECURSIVE numbered AS MATERIALIZED (
        SELECT *, row_number() OVER (PARTITION BY control_number ORDER BY seq) AS n FROM (
          SELECT 'S-' || l_suppkey AS control_number, ((CAST(l_orderkey AS BIGINT) * 10 + l_linenumber) * 4000
              + date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))) * 1000000 + l_partkey AS seq,
            l_partkey % 3 AS content,
            CASE WHEN l_returnflag <> 'R' THEN date_trunc('month', CAST(l_shipdate AS TIMESTAMP)) END AS t
          FROM lineitem)),
      walk AS (
        SELECT control_number, n, seq, content, t, 'stored' AS outcome FROM numbered WHERE n = 1
        UNION ALL
        SELECT control_number, d.n, d.seq,
          CASE WHEN {_UNEVEN} = 'stored' THEN d.content ELSE w.content END,
          CASE WHEN {_UNEVEN} = 'stored' THEN d.t ELSE w.t END, {_UNEVEN}
        FROM walk w JOIN numbered d USING (control_number) WHERE d.n = w.n + 1)
      SELECT * FROM walk)
    """,
)
def lww_verdicts_uneven(spark, folder):
    """Line items as deliveries of their supplier, with hashes that don't cover the time."""
    arrivals = X.uneven_deliveries(spark, folder)
    return ingest.verdicts(arrivals, blocks=8).select("control_number", "seq", "outcome")


@_query(
    "lww_current",
    ["plain_verdicts"],
    """
    SELECT control_number, h AS source_payload_hash, seq,
      strftime(t, '%Y-%m-%d %H:%M:%S') AS source_updated_at
    FROM plain_verdicts WHERE outcome = 'stored'
    QUALIFY row_number() OVER (PARTITION BY control_number ORDER BY seq DESC) = 1
    """,
)
def lww_current(spark, folder):
    decided = ingest.verdicts(X.deliveries(spark, folder), hash_covers_time=True)
    return ingest.last_stored(decided).select(
        "control_number", "source_payload_hash", "seq", _text("source_updated_at")
    )


@_query(
    "ingest_next_state",
    ["next_verdicts"],
    """
    SELECT control_number, h AS source_payload_hash,
      strftime(t, '%Y-%m-%d %H:%M:%S') AS source_updated_at
    FROM next_verdicts WHERE outcome = 'stored'
    QUALIFY row_number() OVER (PARTITION BY control_number ORDER BY seq DESC) = 1
    """,
)
def ingest_next_state(spark, folder):
    following, _ = ingest.apply_deliveries(
        X.deliveries(spark, folder), X.stored_versions(spark, folder), hash_covers_time=True
    )
    return following.select("control_number", "source_payload_hash", _text("source_updated_at"))


@_query(
    "ingest_outcome_counts",
    ["next_verdicts"],
    "SELECT outcome, count(*) AS deliveries FROM next_verdicts WHERE seq >= 0 GROUP BY outcome",
)
def ingest_outcome_counts(spark, folder):
    _, decided = ingest.apply_deliveries(
        X.deliveries(spark, folder), X.stored_versions(spark, folder), hash_covers_time=True
    )
    return reports.ingestion_outcomes(decided)


@_query(
    "insert_if_absent",
    ["deliveries", "stored_versions"],
    """
    SELECT control_number, seq, seq = min(seq) OVER (PARTITION BY control_number)
      AND control_number NOT IN (SELECT control_number FROM stored_versions) AS won
    FROM deliveries
    """,
)
def insert_if_absent(spark, folder):
    tried = ingest.insert_if_absent(X.deliveries(spark, folder), X.stored_versions(spark, folder))
    return tried.select("control_number", "seq", "won")


@_query(
    "replace_if_unchanged",
    ["deliveries", "stored_versions"],
    """
    SELECT control_number, coalesce(n.h, s.h) AS source_payload_hash, n.h IS NOT NULL AS replaced
    FROM stored_versions s LEFT JOIN (
      SELECT control_number, h, md5('1|' || coalesce(strftime(t, '%Y'), '-')) AS expected
      FROM deliveries
      QUALIFY row_number() OVER (PARTITION BY control_number ORDER BY seq) = 1) n
    USING (control_number)
    WHERE n.expected IS NULL OR n.expected = s.h
    UNION ALL
    SELECT control_number, s.h, false FROM stored_versions s JOIN (
      SELECT control_number, md5('1|' || coalesce(strftime(t, '%Y'), '-')) AS expected
      FROM deliveries
      QUALIFY row_number() OVER (PARTITION BY control_number ORDER BY seq) = 1) n
    USING (control_number) WHERE n.expected <> s.h
    """,
)
def replace_if_unchanged(spark, folder):
    """The first delivery of each notice, written by somebody who read content 1 of its year."""
    incoming = X.deliveries(spark, folder)
    firsts = incoming.groupBy("control_number").agg(
        F.min("seq").alias("seq"),
        F.min_by(F.struct("source_payload_hash", "source_updated_at"), "seq").alias("r"),
    ).select("control_number", "seq", "r.*")
    year = F.coalesce(F.date_format("source_updated_at", "yyyy"), F.lit("-"))
    tried = firsts.withColumn("expected_hash", F.md5(F.concat(F.lit("1|"), year)))
    following, results = ingest.replace_if_unchanged(tried, X.stored_versions(spark, folder))
    won = results.filter("won").select("control_number", F.lit(True).alias("won"))
    return following.join(won, "control_number", "left").select(
        "control_number",
        "source_payload_hash",
        F.coalesce("won", F.lit(False)).alias("replaced"),
    )


@_query(
    "concurrent_writers",
    ["deliveries", "stored_versions"],
    """
    SELECT * FROM (WITH tried AS (
      SELECT d.control_number, d.seq, d.h, s.h AS held, d.seq % 2 = 0 AND s.h IS NOT NULL AS may
      FROM deliveries d LEFT JOIN stored_versions s USING (control_number)),
    first AS (SELECT control_number, min(seq) AS seq FROM tried WHERE may GROUP BY 1)
    SELECT s.control_number, coalesce(t.h, s.h) AS source_payload_hash,
      t.seq AS winner, 1 AS stored_rows
    FROM stored_versions s LEFT JOIN first f USING (control_number)
    LEFT JOIN tried t ON t.control_number = f.control_number AND t.seq = f.seq)
    """,
)
def concurrent_writers(spark, folder):
    """Every delivery of an even part was written by somebody who read what is stored; the first of
    them wins, the others lose, and no key is stored twice."""
    stored = X.stored_versions(spark, folder)
    held = stored.select("control_number", F.col("source_payload_hash").alias("expected_hash"))
    even = (F.col("seq") % 1_000_000_000) % 2 == 0
    writers = X.deliveries(spark, folder).join(held, "control_number", "left").withColumn(
        "expected_hash", F.when(even, F.col("expected_hash")).otherwise(F.lit("something else"))
    )
    following, results = ingest.replace_if_unchanged(writers, stored)
    winners = results.filter("won").select("control_number", F.col("seq").alias("winner"))
    counted = following.groupBy("control_number").agg(
        F.min("source_payload_hash").alias("source_payload_hash"), F.count(F.lit(1)).cast("int").alias("stored_rows")
    )
    return counted.join(winners, "control_number", "left").select(
        "control_number", "source_payload_hash", "winner", "stored_rows"
    )


@_query(
    "two_runs_one_batch",
    ["raw"],
    """
    SELECT control_number, 'Compra de ' || trade AS object_description,
      CASE WHEN kind <> 15 THEN strftime(day, '%Y-%m-%d 15:00:00') END AS source_updated_at
    FROM raw WHERE outcome = 'mapped'
    """,
)
def two_runs_one_batch(spark, folder):
    """Two runs consumed at once: in the later one every notice has new text, undated ones too, and
    stands on an earlier page. What the later run says is what stays."""
    raw = X.raw_notices(spark, folder)
    later = raw.withColumn("payload", F.regexp_replace("payload", "Aquisição de", "Compra de"))
    sent = None
    for day, (rows, page) in enumerate([(raw, F.col("page_number") + 500), (later, 500 - F.col("page_number"))]):
        run = F.timestamp_micros(F.unix_micros(_now()) + day * 86_400_000_000)
        place = messages.arrival(run, F.col("publication_date"), F.lit(6), F.lit("SP"), page, F.col("o_orderkey"))
        mapped = mapping.with_change_token(mapping.map_notices(rows).filter(F.col("outcome") == V.MAPPED))
        one = messages.messages_for(mapped, place)
        sent = one if sent is None else sent.unionByName(one)
    arrived = _stored_once(spark, consume.deliveries(consume.read_messages(sent)), "arrived")
    kept = ingest.last_stored(ingest.verdicts(arrived, hash_covers_time=True))
    return kept.select("control_number", "object_description", _text("source_updated_at"))


@_query(
    "changed_notices",
    ["deliveries", "stored_versions"],
    """
    SELECT control_number, seq FROM deliveries d LEFT JOIN stored_versions s USING (control_number)
    WHERE d.h IS DISTINCT FROM s.h
    """,
)
def changed_notices(spark, folder):
    moved = mapping.changed(X.deliveries(spark, folder), X.stored_versions(spark, folder))
    return moved.select("control_number", "seq")


@_query("point_lookup", ["notices"],
        "SELECT control_number, object_description, state FROM notices WHERE control_number = '42'")
def point_lookup(spark, folder):
    return tables.find(X.notices(spark, folder), control_number="42").select(
        "control_number", "object_description", "state"
    )


@_query(
    "late_arrivals",
    ["notices"],
    """
    SELECT count(*) FILTER (age <= 1) AS within_1, count(*) FILTER (age <= 2) AS within_2,
      count(*) FILTER (age <= 3) AS within_3, count(*) FILTER (age <= 4) AS within_4,
      count(*) FILTER (age <= 5) AS within_5, count(*) FILTER (age <= 7) AS within_7,
      count(*) FILTER (age <= 14) AS within_14, count(*) AS late,
      CAST(max(age) AS INTEGER) AS oldest
    FROM (SELECT date_diff('day', CAST(closes - INTERVAL 14 DAY - INTERVAL 3 HOUR AS DATE),
        DATE '2026-09-10') AS age FROM notices)
    WHERE age >= 2
    """,
)
def late_arrivals(spark, folder):
    """Lateness at 2026-09-11 01:00 UTC, when it is still the 10th where notices are published,
    taking a notice's opening as its publication."""
    stored = X.notices(spark, folder).select(F.col("proposal_opens_at").alias("published_at"))
    return reports.lateness(stored, F.lit("2026-09-11 01:00:00").cast("timestamp"))


# Discovery and coverage -------------------------------------------------------------------------


def _ledger(spark, folder):
    return X.ledger(spark, folder)


@_query(
    "chunk_plan",
    ["ledger"],
    """
    SELECT CAST(cycle_date AS VARCHAR) AS cycle_date,
      CAST(cycle_date - n AS VARCHAR) AS publication_date, modality_code, state
    FROM (SELECT DISTINCT cycle_date FROM ledger), (VALUES (0), (1), (2), (3)) AS w(n),
      (VALUES (4), (6), (8)) AS m(modality_code), (VALUES ('SP'), ('RJ'), ('MG')) AS s(state)
    """,
)
def chunk_plan(spark, folder):
    """What every cycle on record had to plan."""
    cycles = _ledger(spark, folder).select("cycle_date").distinct()
    plan = coverage.chunk_plan(cycles, 3, X.SCOPE_MODALITIES, X.SCOPE_STATES, _now())
    return plan.select(_text("cycle_date"), _text("publication_date"), "modality_code", "state")


@_query(
    "plan_if_absent",
    ["ledger"],
    """
    SELECT CAST(c.cycle_date AS VARCHAR) AS cycle_date,
      CAST(c.cycle_date - n AS VARCHAR) AS publication_date, m.modality_code, s.state
    FROM (SELECT DISTINCT cycle_date FROM ledger) AS c, (VALUES (0), (1), (2), (3)) AS w(n),
      (VALUES (4), (6), (8)) AS m(modality_code), (VALUES ('SP'), ('RJ'), ('MG')) AS s(state)
    WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.cycle_date = c.cycle_date
      AND l.publication_date = c.cycle_date - n AND l.modality_code = m.modality_code
      AND l.state = s.state)
    """,
)
def plan_if_absent(spark, folder):
    ledger = _ledger(spark, folder)
    cycles = ledger.select("cycle_date").distinct()
    plan = coverage.chunk_plan(cycles, 3, X.SCOPE_MODALITIES, X.SCOPE_STATES, _now())
    return coverage.plan_if_absent(ledger, plan).select(
        _text("cycle_date"), _text("publication_date"), "modality_code", "state"
    )


@_query(
    "responsibility",
    ["responsible"],
    "SELECT modality_code, state, CAST(since AS VARCHAR) AS since FROM responsible",
)
def responsibility(spark, folder):
    found = coverage.responsibility(_ledger(spark, folder), X.SCOPE_MODALITIES, X.SCOPE_STATES)
    return found.select("modality_code", "state", _text("since"))


def _new_gaps(spark, folder):
    return coverage.new_gaps(
        _ledger(spark, folder),
        X.recorded_gaps(spark, folder),
        _day(X.WINDOW_START),
        X.SCOPE_MODALITIES,
        X.SCOPE_STATES,
        _now(),
    )


@_query(
    "coverage_gaps",
    ["new_gaps"],
    """
    SELECT CAST(publication_date AS VARCHAR) AS publication_date, modality_code, state
    FROM new_gaps
    """,
)
def coverage_gaps(spark, folder):
    return _new_gaps(spark, folder).select(_text("publication_date"), "modality_code", "state")


@_query(
    "expired_by_scope",
    ["new_gaps"],
    "SELECT modality_code, state, count(*) AS expired FROM new_gaps GROUP BY ALL",
)
def expired_by_scope(spark, folder):
    return reports.counts_by_scope(_new_gaps(spark, folder), "expired")


@_query(
    "covered_dates",
    ["covered"],
    "SELECT CAST(publication_date AS VARCHAR) AS publication_date, modality_code, state FROM covered",
)
def covered_dates(spark, folder):
    return (
        coverage.covered_dates(_ledger(spark, folder))
        .distinct()
        .select(_text("publication_date"), "modality_code", "state")
    )


_PENDING = """
    SELECT CAST(cycle_date AS VARCHAR) AS cycle_date,
      CAST(publication_date AS VARCHAR) AS publication_date, modality_code, state, origin, attempts
    FROM ledger
    WHERE completed_at IS NULL AND (cycle_date = DATE '2024-01-30' OR origin = 'MANUAL')
    ORDER BY publication_date, modality_code
    """


def _pending(ledger: DataFrame, cycle: Column) -> DataFrame:
    return coverage.pending(ledger, cycle).select(
        _text("cycle_date"), _text("publication_date"), "modality_code", "state", "origin", "attempts"
    )


@_query("pending_chunks", ["ledger"], _PENDING)
def pending_chunks(spark, folder):
    return _pending(_ledger(spark, folder), _day("2024-01-30"))


@_query("owed_now", ["ledger"], _PENDING)
def owed_now(spark, folder):
    """At 01:00 UTC on the 31st it is still the 30th where notices are published."""
    now = F.lit("2024-01-31 01:00:00").cast("timestamp")
    return _pending(_ledger(spark, folder), times.local_date(now))


@_query(
    "stuck_backfills",
    ["ledger"],
    """
    SELECT CAST(cycle_date AS VARCHAR) AS cycle_date,
      CAST(publication_date AS VARCHAR) AS publication_date, modality_code, state, attempts
    FROM ledger WHERE origin = 'MANUAL' AND completed_at IS NULL AND attempts >= 8
    """,
)
def stuck_backfills(spark, folder):
    return coverage.stuck_backfills(_ledger(spark, folder)).select(
        _text("cycle_date"), _text("publication_date"), "modality_code", "state", "attempts"
    )


@_query(
    "open_gaps",
    ["recorded_gaps"],
    """
    SELECT CAST(publication_date AS VARCHAR) AS publication_date, modality_code, state
    FROM recorded_gaps WHERE resolved_at IS NULL
    """,
)
def open_gaps(spark, folder):
    return coverage.open_gaps(X.recorded_gaps(spark, folder)).select(
        _text("publication_date"), "modality_code", "state"
    )


@_query(
    "resolvable_gaps",
    ["recorded_gaps", "covered"],
    """
    SELECT CAST(publication_date AS VARCHAR) AS publication_date, modality_code, state
    FROM recorded_gaps JOIN covered USING (publication_date, modality_code, state)
    WHERE resolved_at IS NULL
    """,
)
def resolvable_gaps(spark, folder):
    found = coverage.resolvable_gaps(X.recorded_gaps(spark, folder), _ledger(spark, folder))
    return found.select(_text("publication_date"), "modality_code", "state")


@_query(
    "resolve_gaps",
    ["recorded_gaps", "ledger"],
    """
    SELECT CAST(publication_date AS VARCHAR) AS publication_date, modality_code, state,
      epoch_us(coalesce(resolved_at, settled)) AS resolved_micros
    FROM recorded_gaps LEFT JOIN (
      SELECT publication_date, modality_code, state, min(completed_at) AS settled FROM ledger
      WHERE completed_at IS NOT NULL AND cycle_date > publication_date GROUP BY ALL)
    USING (publication_date, modality_code, state)
    """,
)
def resolve_gaps(spark, folder):
    settled = coverage.resolve_gaps(X.recorded_gaps(spark, folder), _ledger(spark, folder))
    return settled.select(
        _text("publication_date"),
        "modality_code",
        "state",
        F.unix_micros("resolved_at").alias("resolved_micros"),
    )


@_query(
    "backfill_request",
    ["ledger", "recorded_gaps"],
    """
    SELECT * FROM (WITH asked AS (
      SELECT DATE '2024-01-30' AS cycle_date, publication_date, modality_code, state
      FROM recorded_gaps WHERE resolved_at IS NULL)
    SELECT CAST(cycle_date AS VARCHAR) AS cycle_date,
      CAST(publication_date AS VARCHAR) AS publication_date, modality_code, state, origin, attempts,
      completed_at IS NOT NULL AS complete
    FROM ledger ANTI JOIN asked USING (cycle_date, publication_date, modality_code, state)
    UNION ALL
    SELECT CAST(cycle_date AS VARCHAR), CAST(publication_date AS VARCHAR), modality_code, state,
      'MANUAL', 0, false FROM asked)
    """,
)
def backfill_request(spark, folder):
    asked = coverage.open_gaps(X.recorded_gaps(spark, folder))
    ledger = _ledger(spark, folder)
    after = coverage.request_backfills(ledger, asked, _day("2024-01-30"), _now())
    return after.select(
        _text("cycle_date"),
        _text("publication_date"),
        "modality_code",
        "state",
        "origin",
        "attempts",
        F.col("completed_at").isNotNull().alias("complete"),
    )


@_query(
    "complete_chunks",
    ["ledger"],
    """
    SELECT CAST(cycle_date AS VARCHAR) AS cycle_date,
      CAST(publication_date AS VARCHAR) AS publication_date, modality_code, state,
      coalesce(epoch_us(completed_at), CASE WHEN attempts >= 3 THEN 1790078400000000 END)
        AS completed_micros,
      CAST(CASE WHEN completed_at IS NOT NULL THEN pages_fetched WHEN attempts >= 3 THEN 7 END
        AS INTEGER) AS pages_fetched,
      CAST(CASE WHEN completed_at IS NOT NULL THEN notices_published WHEN attempts >= 3 THEN
        attempts END AS INTEGER) AS notices_published
    FROM ledger
    """,
)
def complete_chunks(spark, folder):
    """Results for every chunk tried at least three times, complete already or not."""
    ledger = _ledger(spark, folder)
    results = ledger.filter(F.col("attempts") >= 3).select(
        "cycle_date", "publication_date", "modality_code", "state",
        _now().alias("at"), F.lit(7).alias("pages"), F.col("attempts").alias("published"),
    )
    after = coverage.complete_chunks(ledger, results)
    return after.select(
        _text("cycle_date"),
        _text("publication_date"),
        "modality_code",
        "state",
        F.unix_micros("completed_at").alias("completed_micros"),
        "pages_fetched",
        "notices_published",
    )


@_query(
    "record_attempts",
    ["ledger", "chunk_events"],
    """
    SELECT CAST(cycle_date AS VARCHAR) AS cycle_date,
      CAST(publication_date AS VARCHAR) AS publication_date, modality_code, state,
      CAST(2 * attempts AS INTEGER) AS attempts, epoch_us(last_failure_at) AS failed_micros,
      f.failure AS last_failure
    FROM ledger LEFT JOIN (
      SELECT cycle_date, publication_date, modality_code, state,
        arg_max('timeout after ' || CAST(trunc(value) AS BIGINT), moment) AS failure
      FROM chunk_events WHERE event_type = 'error' GROUP BY ALL) f
    USING (cycle_date, publication_date, modality_code, state)
    """,
)
def record_attempts(spark, folder):
    after = coverage.record_attempts(_ledger(spark, folder), X.attempt_log(spark, folder))
    return after.select(
        _text("cycle_date"),
        _text("publication_date"),
        "modality_code",
        "state",
        "attempts",
        F.unix_micros("last_failure_at").alias("failed_micros"),
        "last_failure",
    )


@_query(
    "attempts_per_chunk",
    ["chunk_events"],
    """
    SELECT CAST(cycle_date AS VARCHAR) AS cycle_date,
      CAST(publication_date AS VARCHAR) AS publication_date, modality_code, state,
      count(*) AS attempts
    FROM chunk_events GROUP BY ALL
    """,
)
def attempts_per_chunk(spark, folder):
    key = ["cycle_date", "publication_date", "modality_code", "state"]
    tally = reports.attempts_per_chunk(X.attempt_log(spark, folder), key)
    return tally.select(
        _text("cycle_date"), _text("publication_date"), "modality_code", "state", "attempts"
    )


@_query(
    "failed_by_scope",
    ["chunk_events"],
    """
    SELECT modality_code, state, count(*) AS failed FROM chunk_events
    WHERE event_type = 'error' GROUP BY ALL
    """,
)
def failed_by_scope(spark, folder):
    return reports.failed_chunks(X.attempt_log(spark, folder))


@_query(
    "volume_profile",
    ["chunk_events"],
    """
    SELECT sum(pages) AS pages_per_day, sum(pages) * 4 AS pages_per_run,
      sum(pages) * 4 * CAST(1.44 AS DOUBLE) AS peak_pages_per_run,
      max(pages) * CAST(1.44 AS DOUBLE) AS peak_pages_of_largest_chunk
    FROM (SELECT modality_code, state, ceil(count(*) / 10.0) / CAST(34 AS DOUBLE) AS pages
      FROM chunk_events WHERE state = 'SP' GROUP BY ALL)
    """,
)
def volume_profile(spark, folder):
    seen = X.attempt_log(spark, folder)
    observed = reports.observed_pages(seen, page_size=10, days=34)
    scope = spark.createDataFrame(
        [("SP", m) for m in X.SCOPE_MODALITIES], "state string, modality_code int"
    )
    return reports.volume_profile(observed, scope, lookback=3)


_PAGES = """
    SELECT state, modality_code, ceil(count(*) / 10.0) / CAST(34 AS DOUBLE) AS pages
      FROM chunk_events GROUP BY ALL
    """


@_query(
    "volume_per_state",
    ["chunk_events"],
    f"""
    SELECT state, sum(pages) AS pages_per_day, sum(pages) * 4 AS pages_per_run,
      sum(pages) * 4 * CAST(1.44 AS DOUBLE) AS peak_pages_per_run,
      max(pages) * CAST(1.44 AS DOUBLE) AS peak_pages_of_largest_chunk
    FROM ({_PAGES}) GROUP BY state
    """,
)
def volume_per_state(spark, folder):
    """The volume of every measured state."""
    observed = reports.observed_pages(X.attempt_log(spark, folder), page_size=10, days=34)
    scope = observed.select("state", "modality_code")
    return reports.volume_profile(observed, scope, lookback=3, by=["state"])


@_query(
    "national_pages",
    ["chunk_events"],
    f"SELECT sum(pages) * CAST(6.0 AS DOUBLE) * 4 AS pages_per_run FROM ({_PAGES}) WHERE state = 'SP'",
)
def national_pages(spark, folder):
    """The whole country, estimated from its best-measured state."""
    observed = reports.observed_pages(X.attempt_log(spark, folder), page_size=10, days=34)
    return reports.national_pages(observed.filter("state = 'SP'"), lookback=3)


@_query(
    "observed_pages",
    ["chunk_events"],
    """
    SELECT modality_code, state, ceil(sum(n) / 10.0) / CAST(34 AS DOUBLE) AS pages_per_day,
      max(n) / (sum(n) / CAST(34 AS DOUBLE)) AS peak
    FROM (SELECT modality_code, state, publication_date, count(*) AS n
      FROM chunk_events GROUP BY ALL)
    GROUP BY modality_code, state
    """,
)
def observed_pages(spark, folder):
    return reports.observed_pages(X.attempt_log(spark, folder), page_size=10, days=34).select(
        "modality_code", "state", "pages_per_day", "peak"
    )


@_query(
    "unmeasured_scope",
    ["chunk_events"],
    """
    SELECT s.state, m.modality_code FROM (VALUES ('SP'), ('AC')) AS s(state),
      (VALUES (4), (99)) AS m(modality_code)
    WHERE NOT EXISTS (SELECT 1 FROM chunk_events e WHERE e.state = s.state
      AND e.modality_code = m.modality_code)
    """,
)
def unmeasured_scope(spark, folder):
    observed = reports.observed_pages(X.attempt_log(spark, folder), page_size=10, days=34)
    scope = spark.createDataFrame(
        [(s, m) for s in ("SP", "AC") for m in (4, 99)], "state string, modality_code int"
    )
    return reports.unmeasured(observed, scope)


# Mapping ----------------------------------------------------------------------------------------


def _mapped_pages(spark, folder):
    opened = landing.open_pages(X.landing(spark, folder))
    return mapping.map_notices(landing.page_notices(opened))


@_query(
    "page_scan",
    ["raw"],
    """
    SELECT CAST(publication_date AS VARCHAR) AS publication_date, modality_code, state, page_number,
      CASE WHEN year(publication_date) = 2023 AND page_number = 1
        THEN 'the page is not JSON: <html>busy</html>' END AS page_failure,
      CASE WHEN year(publication_date) IN (2023, 2024) AND page_number = 1 THEN 0
        ELSE CAST(count(*) AS INTEGER) END AS notices,
      CASE WHEN year(publication_date) IN (2023, 2024) AND page_number = 1 THEN 0
        ELSE CAST(count(*) AS INTEGER) END AS total_records,
      CASE WHEN year(publication_date) IN (2023, 2024) AND page_number = 1 THEN 1
        ELSE CAST(any_value(pages) AS INTEGER) END AS total_pages
    FROM raw JOIN (SELECT publication_date, modality_code, state,
        count(DISTINCT page_number) AS pages FROM raw GROUP BY ALL)
      USING (publication_date, modality_code, state)
    GROUP BY publication_date, modality_code, state, page_number
    """,
)
def page_scan(spark, folder):
    opened = landing.open_pages(X.landing(spark, folder))
    return opened.select(
        _text("publication_date"), "modality_code", "state", "page_number", "page_failure",
        F.size("payloads").alias("notices"), "total_records", "total_pages",
    )


@_query(
    "map_notices",
    ["landed"],
    r"""
    SELECT control_number, 'Aquisição de ' || trade AS object_description, state,
      CASE WHEN kind NOT IN (13, 14) THEN regexp_replace(amount, '\.?0+$', '') END
        AS estimated_amount,
      CASE WHEN kind IN (13, 14) THEN NULL
        WHEN k % 2003 = 1 THEN repeat('9', 28) || '.' || repeat('9', 10)
        ELSE regexp_extract(amount, '\d+\.\d\d') || '00000000' END AS estimated_value,
      modality_code, strftime(day, '%Y-%m-%d 03:00:00') AS published_at,
      strftime(day + 1, '%Y-%m-%d 11:00:00') AS proposal_opens_at,
      epoch_us(day + 14 + INTERVAL '20 hours 30 minutes') + 500000 AS closes_micros,
      CASE WHEN kind <> 15 THEN strftime(day, '%Y-%m-%d 15:00:00') END AS source_updated_at
    FROM landed WHERE outcome = 'mapped'
    """,
)
def map_notices(spark, folder):
    mapped = _mapped_pages(spark, folder)
    return mapped.filter(F.col("outcome") == V.MAPPED).select(
        "control_number", "object_description", "state",
        "estimated_amount", F.col("estimated_value").cast("string").alias("estimated_value"),
        "modality_code", _text("published_at"), _text("proposal_opens_at"),
        F.unix_micros("proposal_closes_at").alias("closes_micros"), _text("source_updated_at"),
    )


@_query("rejected_notices", ["landed"],
        "SELECT control_number, field, reason FROM landed WHERE outcome = 'rejected'")
def rejected_notices(spark, folder):
    return mapping.rejected(_mapped_pages(spark, folder)).drop("payload")


@_query(
    "quoted_rejections",
    ["raw"],
    f"""
    SELECT control_number, field, reason, CASE WHEN kind = 0 THEN CASE WHEN length(body) <= {V.QUOTE_LENGTH}
      THEN body ELSE body[1:{V.QUOTE_LENGTH}] || '... <truncated, ' || length(body) || ' chars>' END END AS payload
    FROM (SELECT *, '{{"objetoCompra":"Aquisição de ' || repeat('muito ', CAST(k % 100 AS INTEGER)) || trade
        || '","unidadeOrgao":{{"ufNome":null,"ufSigla":" ' || lower(state) || '"}},"valorTotalEstimado":'
        || amount || ',"modalidadeId":' || modality_code || ',"modalidadeNome":"modalidade"'
        || ',"dataPublicacaoPncp":"' || strftime(day, '%Y-%m-%dT00:00:00')
        || '","dataAberturaProposta":"' || strftime(day + 1, '%Y-%m-%dT08:00')
        || '","dataEncerramentoProposta":"' || strftime(day + 14, '%Y-%m-%dT17:30:00.5')
        || '","dataAtualizacaoGlobal":"' || strftime(day, '%Y-%m-%dT12:00:00') || '"}}' AS body FROM raw)
    WHERE outcome = 'rejected'
    """,
)
def quoted_rejections(spark, folder):
    """Rejected notices, some with long descriptions; those without a number show what they were."""
    longer = F.concat(F.lit("Aquisição de "), F.repeat(F.lit("muito "), (F.col("o_orderkey") % 100).cast("int")))
    raw = X.raw_notices(spark, folder).withColumn("payload", F.replace("payload", F.lit("Aquisição de "), longer))
    stripped = raw.withColumn("payload", F.concat(F.lit(" \n"), "payload", F.lit("  ")))
    return mapping.rejected(mapping.map_notices(stripped))


@_query("not_biddable_notices", ["landed"],
        "SELECT control_number, reason FROM landed WHERE outcome = 'not_biddable'")
def not_biddable_notices(spark, folder):
    return mapping.not_biddable(_mapped_pages(spark, folder))


@_query(
    "rejections_by_field",
    ["landed"],
    "SELECT field, count(*) AS rejected FROM landed WHERE outcome = 'rejected' GROUP BY field",
)
def rejections_by_field(spark, folder):
    return reports.rejections_by_field(_mapped_pages(spark, folder))


@_query("mapping_outcomes", ["landed"],
        "SELECT outcome, count(*) AS notices FROM landed GROUP BY outcome")
def mapping_outcomes(spark, folder):
    return reports.mapping_outcomes(_mapped_pages(spark, folder))


@_query(
    "rejected_pages",
    ["landed"],
    """
    SELECT CAST(publication_date AS VARCHAR) AS publication_date, modality_code AS chunk_modality,
      state AS chunk_state, page_number, count(*) AS notices, count(*) AS rejected
    FROM landed GROUP BY publication_date, modality_code, state, page_number
    HAVING count(*) FILTER (outcome = 'rejected') = count(*)
    """,
)
def rejected_pages(spark, folder):
    notices = landing.page_notices(landing.open_pages(X.landing(spark, folder))).withColumnsRenamed(
        {"modality_code": "chunk_modality", "state": "chunk_state"}
    )
    page = ["publication_date", "chunk_modality", "chunk_state", "page_number"]
    bad = reports.rejected_pages(mapping.map_notices(notices), page)
    return bad.withColumn("publication_date", F.col("publication_date").cast("string"))


@_query(
    "biddability",
    ["raw"],
    f"""
    SELECT k AS o_orderkey, CASE WHEN kind = 8 THEN 'not_biddable' WHEN kind IN (6, 7)
        THEN 'malformed' ELSE 'biddable' END AS kind,
      CASE WHEN kind IN (6, 7, 8) THEN reason END AS reason
    FROM raw
    """,
)
def biddability(spark, folder):
    raw = X.raw_notices(spark, folder).select(
        "o_orderkey",
        *[
            times.local_instant(F.get_json_object("payload", f"$.{field}")).alias(name)
            for name, field in [
                ("opens", "dataAberturaProposta"), ("closes", "dataEncerramentoProposta")
            ]
        ],
    )
    return raw.select(
        "o_orderkey", F.inline(F.array(mapping.biddability(F.col("opens"), F.col("closes"))))
    )


@_query(
    "canonical_hash",
    ["raw"],
    r"""
    SELECT k AS o_orderkey, sha256('{"dataAberturaProposta":"' || strftime(day + 1, '%Y-%m-%dT08:00')
      || '","dataAtualizacaoGlobal":"' || strftime(day, '%Y-%m-%dT12:00:00')
      || '","dataEncerramentoProposta":"' || strftime(day + 14, '%Y-%m-%dT17:30:00.5')
      || '","dataPublicacaoPncp":"' || strftime(day, '%Y-%m-%dT00:00:00')
      || '","modalidadeId":' || modality_code || ',"modalidadeNome":"modalidade"'
      || ',"numeroControlePNCP":"C-' || k || '","objetoCompra":"Aquisição de ' || trade
      || '","unidadeOrgao":{"ufSigla":" ' || lower(state) || '"}'
      || CASE WHEN kind IN (13, 14) THEN '' ELSE ',"valorTotalEstimado":'
        || regexp_replace(CAST(amount AS VARCHAR), '\.?0+$', '') END || '}')
      AS source_payload_hash
    FROM raw WHERE outcome = 'mapped' AND kind <> 15
    """,
)
def canonical_hash(spark, folder):
    """Hashes of the mapped notices that carry an update time, spelled in source order."""
    mapped = mapping.map_notices(X.raw_notices(spark, folder))
    dated = mapped.filter(
        (F.col("outcome") == V.MAPPED) & F.col("source_updated_at").isNotNull()
    )
    return mapping.with_change_token(dated).select("o_orderkey", "source_payload_hash")


@_query(
    "canonical_hash_any",
    ["raw"],
    r"""
    SELECT k AS o_orderkey, sha256('{' || concat_ws(',', '"aspas":"\"\\"',
      CASE WHEN kind <> 8 THEN '"dataAberturaProposta":"' || strftime(day + 1, '%Y-%m-%dT08:00') || '"' END,
      CASE WHEN kind = 11 THEN '"dataAtualizacaoGlobal":"yesterday"' WHEN kind <> 15
        THEN '"dataAtualizacaoGlobal":"' || strftime(day, '%Y-%m-%dT12:00:00') || '"' END,
      CASE WHEN kind = 6 THEN '"dataEncerramentoProposta":"' || strftime(day - 5, '%Y-%m-%dT17:30:00') || '"'
        WHEN kind NOT IN (7, 8)
        THEN '"dataEncerramentoProposta":"' || strftime(day + 14, '%Y-%m-%dT17:30:00.5') || '"' END,
      '"dataPublicacaoPncp":"' || CASE WHEN kind = 9 THEN '' ELSE strftime(day, '%Y-%m-%dT00:00:00') END || '"',
      '"itens":[1.5,1000,0,null,{"a":"xç/' || chr(10) || '","b":true},[],' || k || ']',
      '"modalidadeId":' || CASE kind WHEN 4 THEN '"6"' WHEN 12 THEN '0' ELSE CAST(modality_code AS VARCHAR) END,
      '"modalidadeNome":"modalidade"',
      CASE WHEN kind <> 0 THEN '"numeroControlePNCP":"C-' || k || '"' END,
      CASE WHEN kind = 2 THEN '"objetoCompra":"  "'
        WHEN kind <> 1 THEN '"objetoCompra":"Aquisição de ' || trade || '"' END,
      CASE WHEN kind = 3 THEN '"unidadeOrgao":{"ufSigla":"XX"}'
        WHEN kind <> 10 THEN '"unidadeOrgao":{"ufSigla":" ' || lower(state) || '"}' END,
      CASE WHEN kind = 5 THEN '"valorTotalEstimado":-1.5' WHEN kind NOT IN (13, 14)
        THEN '"valorTotalEstimado":' || regexp_replace(CAST(amount AS VARCHAR), '\.?0+$', '') END)
      || '}') AS source_payload_hash
    FROM raw
    """,
)
def canonical_hash_any(spark, folder):
    """Hashes of all raw payloads, mapped or not, with arrays, exponents and escapes put in front."""
    extra = (
        r'{"aspas":"\"\\","itens":[1.50,1e3,-0.0,null,{"z":null,"b":true,"a":"x\u00e7\/\n"},[],'
    )
    front = F.concat(F.lit(extra), F.col("o_orderkey").cast("string"), F.lit(".0],"))
    raw = X.raw_notices(spark, folder).withColumn("payload", F.concat(front, F.expr("substring(payload, 2)")))
    return mapping.with_change_token(raw).select("o_orderkey", "source_payload_hash")


@_query(
    "range_scan",
    ["raw"],
    """
    SELECT o_orderkey, CAST(publication_date AS VARCHAR) AS publication_date, modality_code, state
    FROM (SELECT *, k AS o_orderkey FROM raw)
    WHERE publication_date BETWEEN DATE '2023-01-01' AND DATE '2025-01-01'
      AND modality_code IN (4, 8) AND state IN ('SP', 'RJ', 'BA')
    """,
)
def range_scan(spark, folder):
    return landing.scan_range(
        X.raw_notices(spark, folder), date(2023, 1, 1), date(2025, 1, 1), [4, 8], ["SP", "RJ", "BA"]
    ).select("o_orderkey", _text("publication_date"), "modality_code", "state")


@_query(
    "range_scan_every_state",
    ["raw"],
    """
    SELECT state, count(*) AS notices FROM raw
    WHERE publication_date BETWEEN DATE '2023-01-01' AND DATE '2025-01-01' AND modality_code = 6
    GROUP BY state
    """,
)
def range_scan_every_state(spark, folder):
    found = landing.scan_range(
        X.raw_notices(spark, folder), date(2023, 1, 1), date(2025, 1, 1), [6]
    )
    return found.groupBy("state").agg(F.count(F.lit(1)).alias("notices"))


@_query(
    "landed_range",
    ["raw"],
    """
    SELECT DISTINCT CAST(publication_date AS VARCHAR) AS publication_date, modality_code, state, page_number
    FROM raw WHERE publication_date BETWEEN DATE '2023-01-01' AND DATE '2025-01-01'
      AND modality_code IN (4, 8) AND state IN ('SP', 'RJ', 'BA')
    """,
)
def landed_range(spark, folder):
    """The range of a stored landing table, whose other folders are never listed."""
    home = shared_folder(spark, "landing")
    landing.write_landing(X.landing(spark, folder), home)
    found = landing.scan_range(
        landing.read_landing(spark, home), date(2023, 1, 1), date(2025, 1, 1), [4, 8], ["SP", "RJ", "BA"]
    )
    return found.select(_text("publication_date"), "modality_code", "state", "page_number")


@_query(
    "chunk_scan",
    ["raw"],
    """
    SELECT k AS o_orderkey, page_number FROM raw
    WHERE publication_date = DATE '2024-01-01' AND modality_code = 8 AND state = 'BA'
    """,
)
def chunk_scan(spark, folder):
    chunk = landing.scan_chunk(X.raw_notices(spark, folder), date(2024, 1, 1), 8, "BA")
    return chunk.select("o_orderkey", "page_number")


@_query(
    "landed_chunk_pages",
    ["raw"],
    """
    SELECT CAST(publication_date AS VARCHAR) AS publication_date, modality_code, state,
      count(DISTINCT page_number) AS pages
    FROM raw WHERE publication_date = DATE '2024-01-01' AND modality_code = 8 AND state = 'BA' GROUP BY ALL
    """,
)
def landed_chunk_pages(spark, folder):
    """One chunk of a stored landing table, with its number of pages."""
    home = shared_folder(spark, "landing")
    landing.write_landing(X.landing(spark, folder), home)
    chunk = landing.scan_chunk(landing.read_landing(spark, home), date(2024, 1, 1), 8, "BA")
    return landing.page_totals(chunk).select(_text("publication_date"), "modality_code", "state", "pages")


_CHUNK_FACTS = """
    WITH pages AS (
      SELECT publication_date, modality_code, state, page_number,
        CASE WHEN year(publication_date) = 2023 AND page_number = 1
            THEN 'the page is not JSON: <html>busy</html>'
          WHEN count(l.k) > 0 AND count(*) FILTER (l.outcome = 'rejected') = count(l.k)
            THEN 'all ' || count(l.k) || ' notices of page ' || page_number
              || ' were rejected, so the source changed its contract' END AS failure,
        count(*) FILTER (l.outcome = 'mapped') AS mapped
      FROM raw r LEFT JOIN (SELECT k, outcome FROM landed) l ON r.k = l.k
      GROUP BY publication_date, modality_code, state, page_number),
    chunks AS (
      SELECT publication_date, modality_code, state,
        arg_min(failure, page_number) FILTER (failure IS NOT NULL) AS failure,
        CAST(count(*) AS INTEGER) AS pages, CAST(sum(mapped) AS INTEGER) AS published
      FROM pages GROUP BY ALL
      UNION ALL
      SELECT DISTINCT CAST(publication_date + INTERVAL 50 YEAR AS DATE), modality_code, state,
        'no page was landed for this chunk', NULL, NULL FROM raw WHERE state = 'AC')
    """


def _owed(spark, folder):
    """The ledger of owed chunks, as it is stored: a run reads it many times."""
    return _stored_once(spark, X.owed_chunks(spark, folder), "owed")


def _discovered(spark, folder):
    return discovery.discover(_owed(spark, folder), X.landing(spark, folder), _now())


@_query(
    "discovery_attempts",
    ["raw", "landed"],
    _CHUNK_FACTS.replace("WITH pages", "SELECT * FROM (WITH pages")
    + """
    SELECT CAST(publication_date AS VARCHAR) AS publication_date, modality_code, state, failure
    FROM chunks)
    """,
)
def discovery_attempts(spark, folder):
    return _discovered(spark, folder).attempts.select(
        _text("publication_date"), "modality_code", "state", "failure"
    )


@_query(
    "discovery_results",
    ["raw", "landed"],
    _CHUNK_FACTS.replace("WITH pages", "SELECT * FROM (WITH pages")
    + """
    SELECT CAST(publication_date AS VARCHAR) AS publication_date, modality_code, state, pages,
      published FROM chunks WHERE failure IS NULL)
    """,
)
def discovery_results(spark, folder):
    return _discovered(spark, folder).results.select(
        _text("publication_date"), "modality_code", "state", "pages", "published"
    )


@_query(
    "landed_discovery",
    ["raw", "landed"],
    _CHUNK_FACTS.replace("WITH pages", "SELECT * FROM (WITH pages")
    + """
    SELECT CAST(publication_date AS VARCHAR) AS publication_date, modality_code, state, failure,
      CASE WHEN failure IS NULL THEN pages END AS pages,
      CASE WHEN failure IS NULL THEN published END AS published FROM chunks
    WHERE year(publication_date) = 2024 AND modality_code = 8)
    """,
)
def landed_discovery(spark, folder):
    """A run over a stored landing table that owes a part of it: no other folder is opened."""
    home = shared_folder(spark, "landing")
    landing.write_landing(X.landing(spark, folder), home)
    owed = X.owed_chunks(spark, folder).filter(
        (F.year("publication_date") == 2024) & (F.col("modality_code") == 8)
    )
    chunk = ["publication_date", "modality_code", "state"]
    run = discovery.discover(owed, landing.read_landing(spark, home), _now())
    told = run.results.select(*chunk, "pages", "published")
    return run.attempts.select(*chunk, "failure").join(told, chunk, "left").select(
        _text("publication_date"), "modality_code", "state", "failure", "pages", "published"
    )


@_query(
    "discovery_messages",
    ["raw", "landed"],
    _CHUNK_FACTS.replace("WITH pages", "SELECT * FROM (WITH pages")
    + """
    SELECT 1 AS schema_version, control_number,
      CASE WHEN kind <> 15 THEN strftime(day, '%Y-%m-%dT15:00:00Z') END AS source_updated_at,
      '2026-09-22 12:00:00' AS run, CAST(publication_date AS VARCHAR) AS publication_date,
      modality_code, state, page_number
    FROM landed JOIN chunks USING (publication_date, modality_code, state)
    WHERE outcome = 'mapped' AND failure IS NULL)
    """,
)
def discovery_messages(spark, folder):
    return _discovered(spark, folder).messages.select(
        "schema_version", "control_number", "source_updated_at",
        F.col("seq.run").cast("string").alias("run"),
        F.col("seq.publication_date").cast("string").alias("publication_date"),
        "seq.modality_code", "seq.state", "seq.page_number",
    )


_AFTER_RUN = """
    SELECT CAST(publication_date AS VARCHAR) AS publication_date, modality_code, state, failure,
      failure IS NULL AS completed, CASE WHEN failure IS NULL THEN pages END AS pages_fetched,
      CASE WHEN failure IS NULL THEN published END AS notices_published, 1 AS attempts,
      CASE WHEN failure IS NULL THEN '2026-09-22 12:00:00' END AS gap_resolved_at,
      CASE WHEN failure IS NULL THEN CAST(published AS BIGINT) ELSE 0 END AS messages
    FROM chunks)
    """


def _stored_run(spark, folder, crash: bool):
    """Runs that write. With ``crash`` the first one dies between publishing and the ledger."""
    home = shared_folder(spark, "discovery")
    owed = _owed(spark, folder)
    gaps = X.gaps_of(owed)
    pages = X.landing(spark, folder)
    if crash:
        # Both runs read the pages that landed.
        pages = _stored_once(spark, pages, "landed")
        earlier = F.timestamp_micros(F.unix_micros(_now()) - 3_600_000_000)
        found = discovery.discover(owed, pages, earlier, keep=lambda rows: _stored_once(spark, rows, "mapped"))
        messages.publish(found.messages, f"{home}/messages", 0)
    discovery.run_and_store(owed, pages, owed, gaps, _now(), home, 1)
    chunk = ["publication_date", "modality_code", "state"]
    sent = spark.read.parquet(f"{home}/messages").select(
        *[F.col(f"seq.{c}").alias(c) for c in chunk], "control_number"
    )
    per_chunk = sent.distinct().groupBy(*chunk).agg(F.count(F.lit(1)).alias("messages"))
    resolved = spark.read.parquet(f"{home}/gaps/batch_id=1").select(*chunk, "resolved_at")
    ledger = spark.read.parquet(f"{home}/ledger/batch_id=1")
    return ledger.join(resolved, chunk, "left").join(per_chunk, chunk, "left").select(
        _text("publication_date"), "modality_code", "state", F.col("last_failure").alias("failure"),
        F.col("completed_at").isNotNull().alias("completed"), "pages_fetched", "notices_published", "attempts",
        _text("resolved_at", "gap_resolved_at"), F.coalesce("messages", F.lit(0)).cast("bigint").alias("messages"),
    )


@_query("discovery_run", ["raw", "landed"],
        _CHUNK_FACTS.replace("WITH pages", "SELECT * FROM (WITH pages") + _AFTER_RUN)
def discovery_run(spark, folder):
    """A run that publishes, completes its chunks and resolves their gaps."""
    return _stored_run(spark, folder, crash=False)


@_query("discovery_replay", ["raw", "landed"],
        _CHUNK_FACTS.replace("WITH pages", "SELECT * FROM (WITH pages") + _AFTER_RUN)
def discovery_replay(spark, folder):
    """The same after a crash between publishing and the ledger: messages are repeated, none is lost,
    and every chunk is completed once."""
    return _stored_run(spark, folder, crash=True)


@_query(
    "run_report",
    ["raw", "landed"],
    _CHUNK_FACTS.replace("WITH pages", "SELECT * FROM (WITH pages")
    + """
    SELECT CAST(CAST(publication_date + INTERVAL 60 YEAR AS DATE) AS VARCHAR) AS cycle_date,
      CAST(sum(published) AS BIGINT) AS discovered, CAST(sum(published) AS BIGINT) AS published,
      true AS consistent
    FROM chunks WHERE failure IS NULL GROUP BY ALL)
    """,
)
def run_report(spark, folder):
    """Discovered is counted on the pages, published on the messages that were written."""
    home = shared_folder(spark, "report")
    owed = _owed(spark, folder)
    gaps = X.gaps_of(owed)
    run = discovery.run_and_store(owed, X.landing(spark, folder), owed, gaps, _now(), home, 1)
    report = reports.run_report(run.results)
    return report.withColumn("cycle_date", F.col("cycle_date").cast("string"))


# Messages ---------------------------------------------------------------------------------------

_STAMPS = (
    "[NULL, '2026-09-01T17:22:01Z', '2026-09-01T17:22:01.500Z', '2026-09-01T17:22:01.5Z',"
    " '2026-09-01T14:22:01-03:00', '2026-09-01T17:22:01.000Z', '2026-09-01T17:22:01Z', '']"
)
_FAULTS = f"""
    SELECT k AS seq, CASE
      WHEN k % 97 <> 0 AND k % 89 = 0 THEN 'schema versions start at 1 but was 0'
      WHEN k % 83 = 0 THEN 'control_number is required'
      WHEN k % 79 = 0 THEN 'content_hash must not be blank'
      WHEN k // 7 % 8 = 7 THEN 'source_updated_at must be absent or a timestamp, never blank'
      WHEN k // 7 % 8 IN (3, 4, 5) THEN
        'source_updated_at must be a UTC instant in its one canonical form: '
        || {_STAMPS}[k // 7 % 8 + 1] END AS fault, outcome, kind
    FROM raw
    """


@_query("message_contract", ["raw"], f"SELECT seq, fault FROM ({_FAULTS})")
def message_contract(spark, folder):
    return X.messages(spark, folder).select(
        F.col("seq.place").alias("seq"), messages.contract_fault().alias("fault")
    )


@_query(
    "version_gate",
    ["raw"],
    """
    SELECT CASE WHEN k % 97 = 0 THEN 2 WHEN k % 89 = 0 THEN 0 ELSE 1 END AS schema_version,
      CASE WHEN k % 97 = 0 THEN 'message version 2 is newer than the 1 this consumer reads' END
        AS fault,
      count(*) AS messages
    FROM raw GROUP BY ALL
    """,
)
def version_gate(spark, folder):
    gated = X.messages(spark, folder).select("schema_version", messages.version_fault().alias("fault"))
    return gated.groupBy("schema_version", "fault").agg(F.count(F.lit(1)).alias("messages"))


_KEPT_ASIDE = f"""
    SELECT seq, CASE WHEN fault IS NOT NULL THEN fault
      WHEN seq % 97 = 0 THEN 'message version 2 is newer than the 1 this consumer reads'
      WHEN seq % 73 = 0 THEN 'the payload cannot be mapped: notice: the payload is not JSON'
      ELSE 'the payload cannot be mapped: ' || field || ': ' || reason END AS reason
    FROM ({_FAULTS}) JOIN (SELECT k AS seq, field, reason FROM raw) USING (seq)
    WHERE fault IS NOT NULL OR seq % 97 = 0 OR seq % 73 = 0 OR outcome = 'rejected'
    """


@_query("quarantine", ["raw"], _KEPT_ASIDE)
def quarantine(spark, folder):
    return consume.quarantine(consume.read_messages(X.messages(spark, folder))).select(
        F.col("seq.place").alias("seq"), "reason"
    )


@_query(
    "consumed_messages",
    ["raw"],
    f"""
    SELECT seq, 'C-' || seq AS control_number FROM ({_FAULTS})
    WHERE fault IS NULL AND seq % 97 <> 0 AND seq % 73 <> 0 AND outcome = 'mapped'
    """,
)
def consumed_messages(spark, folder):
    read = consume.read_messages(X.messages(spark, folder))
    return consume.deliveries(read).select(F.col("seq.place").alias("seq"), "control_number")


# Validation -------------------------------------------------------------------------------------


@_query(
    "invariant_violations",
    ["notices", "deliveries"],
    """
    SELECT control_number, violation FROM (
      SELECT control_number, unnest([
        CASE WHEN modality_code = 4 THEN 'blank object description' END,
        CASE WHEN published_at >= TIMESTAMP '2000-01-01' THEN 'blank payload hash' END,
        CASE WHEN state IN ('AC', 'SP') THEN 'negative value' END,
        CASE WHEN state = 'BA' THEN 'unknown state' END,
        CASE WHEN modality_code = 6 THEN 'closes before it opens' END]) AS violation
      FROM notices)
    WHERE violation IS NOT NULL AND NOT (violation = 'negative value' AND control_number IN (
      SELECT control_number FROM notices WHERE estimated_value IS NULL))
    """,
)
def invariant_violations(spark, folder):
    """Notices broken on purpose, by what they are."""
    n = X.notices(spark, folder)
    broken = n.withColumns(
        {
            "object_description": F.when(F.col("modality_code") == 4, "  ").otherwise(
                F.col("object_description")
            ),
            "source_payload_hash": F.when(F.col("published_at") >= "2000-01-01", "").otherwise(
                F.col("source_payload_hash")
            ),
            "estimated_value": F.when(
                F.col("state").isin("AC", "SP"), -F.col("estimated_value")
            ).otherwise(F.col("estimated_value")),
            "state": F.when(F.col("state") == "BA", "??").otherwise(F.col("state")),
            "proposal_closes_at": F.when(
                F.col("modality_code") == 6,
                F.timestamp_micros(F.unix_micros("proposal_opens_at") - 1),
            ).otherwise(F.col("proposal_closes_at")),
        }
    )
    return validate.notice_violations(broken)


@_query(
    "ledger_violations",
    ["ledger"],
    """
    SELECT CAST(cycle_date AS VARCHAR) AS cycle_date,
      CAST(publication_date AS VARCHAR) AS publication_date, modality_code, state, violation
    FROM (SELECT *, unnest([
        CASE WHEN attempts > 8 THEN 'cycle before publication' END,
        CASE WHEN origin = 'MANUAL' THEN 'unknown origin' END,
        CASE WHEN attempts = 1 THEN 'negative attempts' END,
        CASE WHEN completed_at IS NOT NULL AND pages_fetched = 0 THEN 'half a completion' END])
        AS violation FROM ledger)
    WHERE violation IS NOT NULL
      AND NOT (violation = 'cycle before publication' AND cycle_date = publication_date)
    """,
)
def ledger_violations(spark, folder):
    """Ledger rows broken on purpose; keys are reported as they were."""
    ledger = _ledger(spark, folder)
    swapped = F.col("attempts") > 8
    broken = ledger.select(
        F.when(swapped, F.col("publication_date")).otherwise(F.col("cycle_date")).alias("cycle_date"),
        F.when(swapped, F.col("cycle_date")).otherwise(F.col("publication_date")).alias("publication_date"),
        "modality_code",
        "state",
        F.when(F.col("origin") == V.MANUAL, "manual").otherwise(F.col("origin")).alias("origin"),
        F.when(F.col("attempts") == 1, -1).otherwise(F.col("attempts")).alias("attempts"),
        "completed_at",
        F.when(F.col("pages_fetched") > 0, F.col("pages_fetched")).alias("pages_fetched"),
        "notices_published",
    )
    found = validate.ledger_violations(broken)
    was_swapped = F.col("cycle_date") < F.col("publication_date")
    return found.select(
        F.when(was_swapped, F.col("publication_date")).otherwise(F.col("cycle_date")).cast("string").alias("cycle_date"),
        F.when(was_swapped, F.col("cycle_date")).otherwise(F.col("publication_date")).cast("string").alias("publication_date"),
        "modality_code",
        "state",
        "violation",
    )


@_query(
    "profile_violations",
    ["profiles"],
    """
    SELECT profile_id, violation FROM (SELECT profile_id, unnest([
        CASE WHEN minimum_score = 70 AND len(keywords) > 0 THEN 'blank keyword' END,
        CASE WHEN minimum_score = 60 AND value_min IS NOT NULL THEN 'range upside down' END,
        CASE WHEN minimum_score = 30 AND len(cnaes) > 0 THEN 'cnae without a division' END,
        CASE WHEN minimum_score = 40 THEN 'score out of range' END]) AS violation FROM profiles)
    WHERE violation IS NOT NULL
    """,
)
def profile_violations(spark, folder):
    """Profiles broken on purpose, by their threshold."""
    score = F.col("minimum_score")
    broken = X.profiles(spark, folder).withColumns(
        {
            "keywords": F.when(score == 70, F.transform("keywords", lambda k: F.lit(" "))).otherwise(
                F.col("keywords")
            ),
            "value_min": F.when(score == 60, F.col("value_max") + 1).otherwise(F.col("value_min")),
            "cnaes": F.when(score == 30, F.transform("cnaes", lambda c: F.lit("6"))).otherwise(
                F.col("cnaes")
            ),
            "minimum_score": F.when(score == 40, 101).otherwise(score),
        }
    )
    return validate.profile_violations(broken)


@_query(
    "company_violations",
    [],
    """
    SELECT CAST(s_suppkey AS VARCHAR) AS company_id, 'cnpj is not 14 digits' AS violation
    FROM supplier WHERE s_acctbal < 1000
    """,
)
def company_violations(spark, folder):
    """Suppliers with punctuated registration numbers; those with a small account lost a digit."""
    number = F.lpad(F.col("s_suppkey").cast("string"), 12, "0")
    punctuated = F.concat(
        F.substring(number, 1, 2), F.lit("."), F.substring(number, 3, 10), F.lit("/0001-"),
    )
    short = F.col("s_acctbal") < 1000
    companies = X.table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("string").alias("company_id"),
        F.when(short, F.concat(punctuated, F.lit("9"))).otherwise(
            F.concat(F.substring(punctuated, 1, 13), F.lit("/1-0"))
        ).alias("cnpj"),
    )
    return validate.company_violations(companies)


@_query(
    "enrichment_violations",
    ["enrichments"],
    """
    SELECT control_number, 'confidence out of range' AS violation FROM enrichments
    WHERE confidence + 0.05 > 1
    UNION ALL
    SELECT control_number, 'unknown segment' FROM enrichments WHERE segment = 'FURNITURE'
    """,
)
def enrichment_violations(spark, folder):
    broken = X.enrichments(spark, folder).withColumns(
        {
            "confidence": F.col("confidence") + 0.05,
            "segment": F.when(F.col("segment") == "FURNITURE", "CHAIRS").otherwise(F.col("segment")),
        }
    )
    return validate.enrichment_violations(broken)


# Streaming --------------------------------------------------------------------------------------


def _publish_deliveries(spark: SparkSession, folder: str, home: str) -> None:
    """Three runs of messages: everything, everything again, then older versions."""
    everything = X.delivery_messages(spark, folder)
    for run in range(3):
        part = everything.filter(F.date_diff(F.col("seq.publication_date"), F.to_date(_now())) == run)
        messages.publish(part, f"{home}/messages", run)


_STREAMED = """
    SELECT control_number, 0 AS run, 'stored' AS outcome FROM raw WHERE outcome = 'mapped'
    UNION ALL SELECT control_number, 1, 'unchanged' FROM raw WHERE outcome = 'mapped'
    UNION ALL SELECT control_number, 2, CASE WHEN kind = 15 THEN 'unchanged' ELSE 'stale' END
    FROM raw WHERE outcome = 'mapped'
    """


@_query("stream_ingest", ["raw"], _STREAMED)
def stream_ingest(spark, folder):
    """The message stream through keyed state, twice; the second start has nothing left to do."""
    home = shared_folder(spark, "stream")
    _publish_deliveries(spark, folder, home)
    for _ in range(2):
        source = messages.read_message_stream(spark, f"{home}/messages")
        streaming.start_keyed_ingest(source, home).awaitTermination()
    verdicts = spark.read.parquet(f"{home}/verdicts")
    run = F.date_diff(F.col("seq.publication_date"), F.to_date(_now())).alias("run")
    return verdicts.select("control_number", run, "outcome")


@_query(
    "stream_lateness",
    ["raw"],
    """
    SELECT CAST(count(*) FILTER (age <= 7) AS BIGINT) AS within_7, count(*) AS late,
      CAST(max(age) AS INTEGER) AS oldest
    FROM (SELECT date_diff('day', day, DATE '2026-09-22') AS age FROM raw WHERE outcome = 'mapped')
    WHERE age >= 2
    """,
)
def stream_lateness(spark, folder):
    """How late the notices stored by the keyed stream came, over all micro-batches."""
    home = shared_folder(spark, "stream")
    _publish_deliveries(spark, folder, home)
    source = messages.read_message_stream(spark, f"{home}/messages", files_per_batch=8)
    streaming.start_keyed_ingest(source, home, _now()).awaitTermination()
    return spark.read.parquet(f"{home}/lateness").agg(
        F.sum("within_7").alias("within_7"), F.sum("late").alias("late"), F.max("oldest").alias("oldest")
    )


@_query("stream_quarantine", ["raw"], _KEPT_ASIDE)
def stream_quarantine(spark, folder):
    """What the stream keeps aside, with its reason."""
    home = shared_folder(spark, "stream")
    messages.publish(X.messages(spark, folder), f"{home}/messages", 0)
    source = messages.read_message_stream(spark, f"{home}/messages", files_per_batch=8)
    streaming.start_quarantine(source, home).awaitTermination()
    return spark.read.parquet(f"{home}/quarantine").select(F.col("seq.place").alias("seq"), "reason")


@_query(
    "stream_batch_ingest",
    ["raw"],
    """
    SELECT control_number, state, strftime(day, '%Y-%m-%d 03:00:00') AS published_at,
      CASE WHEN kind <> 15 THEN strftime(day, '%Y-%m-%d 15:00:00') END AS source_updated_at
    FROM raw WHERE outcome = 'mapped'
    """,
)
def stream_batch_ingest(spark, folder):
    """The message stream in micro-batches against the stored table."""
    home = shared_folder(spark, "stream")
    _publish_deliveries(spark, folder, home)
    source = messages.read_message_stream(spark, f"{home}/messages", files_per_batch=8)
    streaming.start_batch_ingest(source, home, _now()).awaitTermination()
    return streaming.current_notices(spark, home).select(
        "control_number", "state", _text("published_at"), _text("source_updated_at")
    )
