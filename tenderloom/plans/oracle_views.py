"""The sample views once more, as SQL common table expressions for an independent engine.

``with_views`` puts the views a query names in front of it.
"""

from __future__ import annotations

from tenderloom import vocabulary as V


def _list(values: list) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


_STATES = _list(V.STATES)
_SEGMENTS = _list(V.SEGMENTS)
_DIVISIONS = _list([*V.CNAE_DIVISIONS, "99"])
_SERVED = ", ".join(f"('{d}', '{s}')" for d, s in V.CNAE_DIVISIONS.items())
AT = "TIMESTAMP '2026-09-22 12:00:00'"

VIEWS: dict[str, tuple[list[str], str]] = {}


def _view(name: str, body: str, *needs: str) -> None:
    VIEWS[name] = (list(needs), body)


_view("divisions", f"SELECT * FROM (VALUES {_SERVED}) AS d(division, segment)")

_view(
    "notices",
    f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS control_number,
      'Aquisição de ' || CASE o_orderkey // 3 % 3
          WHEN 0 THEN translate(name, 'aeo', 'áéõ') || 's' WHEN 1 THEN upper(name) ELSE name END
        || ' (' || lower(c_mktsegment) || ')' AS object_description,
      {_STATES}[c_nationkey + 1] AS state,
      CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS estimated_value,
      CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 6 ELSE 8 END AS modality_code,
      o_orderdate AS published_at,
      {AT} + to_days(CAST(o_orderkey % 60 - 10 AS INTEGER))
        + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS closes
    FROM (
      SELECT o.*, c.c_nationkey, c.c_mktsegment, coalesce(p_name, 'item') AS name
      FROM orders o JOIN customer c ON o_custkey = c_custkey
      LEFT JOIN part ON p_partkey = o_orderkey // 8)
    """,
)

_view(
    "profiles",
    f"""
    SELECT CAST(k AS VARCHAR) AS profile_id,
      CASE WHEN k % 10 = 9 THEN CAST([] AS VARCHAR[])
        WHEN k % 4 = 0 THEN [second || 's']
        WHEN k % 4 = 1 THEN [first, second]
        WHEN k % 4 = 2 THEN [upper(second), name]
        WHEN k % 20 = 3 THEN [name || 's', 'Aquisições']
        ELSE [name || 's', first] END AS keywords,
      CASE WHEN k % 8 = 7 THEN CAST([] AS VARCHAR[]) ELSE
        [{_DIVISIONS}[k % 29 + 1] || '01-5/01', {_DIVISIONS}[(k * 7 + 3) % 29 + 1] || '01-5/01']
        END AS cnaes,
      CASE WHEN k % 6 = 5 THEN CAST([] AS VARCHAR[]) ELSE
        [{_STATES}[s_nationkey + 1], {_STATES}[(s_nationkey + 1) % 27 + 1]] END AS states,
      CASE WHEN k % 5 <> 4 THEN CAST(k % 5 * 100000 AS DECIMAL(18,2)) END AS value_min,
      CASE WHEN k % 5 <> 4 THEN CAST(k % 5 * 100000 + 200000 AS DECIMAL(18,2)) END AS value_max,
      [50, 50, 60, 50, 70, 50, 40, 50, 30, 50][k % 10 + 1] AS minimum_score
    FROM (
      SELECT s_suppkey AS k, s_nationkey, coalesce(p_name, 'small ring') AS name,
        split_part(coalesce(p_name, 'small ring'), ' ', 1) AS first,
        split_part(coalesce(p_name, 'small ring'), ' ', 2) AS second
      FROM supplier LEFT JOIN part ON p_partkey = s_suppkey)
    """,
)

_view(
    "enrichments",
    f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS control_number,
      {_SEGMENTS}[(o_orderkey * 7 + n) % 15 + 1] AS segment,
      CAST((o_orderkey + n) % 11 AS DOUBLE) / 10 AS confidence,
      o_orderdate + to_days(CAST(n + 1 AS INTEGER)) AS generated_at
    FROM orders, (VALUES (0), (1)) AS rounds(n)
    WHERE o_orderkey % 3 <> 2 AND (n = 0 OR o_orderkey % 5 = 0)
    """,
)

_view(
    "latest",
    """
    SELECT * FROM enrichments
    QUALIFY row_number() OVER (PARTITION BY control_number ORDER BY generated_at DESC) = 1
    """,
    "enrichments",
)

# Which keyword occurs in which text: every distinct pair, by a regular expression.
_view(
    "keyword_patterns",
    r"""
    SELECT keyword,
      '\b' || array_to_string(list_transform(
        list_filter(string_split_regex(trim(lower(strip_accents(keyword))), '\s+'),
          lambda t: t <> ''),
        lambda t: regexp_escape(CASE
          WHEN length(t) > 4 AND t LIKE '%es' THEN t[1:length(t) - 2]
          WHEN length(t) > 3 AND t LIKE '%s' THEN t[1:length(t) - 1] ELSE t END)
          || '(?:es|s)?'), '\s+') || '\b' AS pattern
    FROM (SELECT DISTINCT unnest(keywords) AS keyword FROM profiles)
    """,
    "profiles",
)

_view(
    "texts",
    """
    SELECT object_description, lower(strip_accents(object_description)) AS folded
    FROM (SELECT DISTINCT object_description FROM notices)
    """,
    "notices",
)

_view(
    "found",
    """
    SELECT object_description, profile_id, count(*) AS hits
    FROM texts, (SELECT profile_id, unnest(keywords) AS keyword FROM profiles) k
    JOIN keyword_patterns USING (keyword)
    WHERE regexp_matches(folded, pattern)
    GROUP BY object_description, profile_id
    """,
    "texts", "keyword_patterns", "profiles",
)

_view(
    "served",
    """
    SELECT profile_id, list_sort(list_distinct(list(coalesce(segment, 'OTHER')))) AS served
    FROM (SELECT profile_id, unnest(cnaes) AS cnae FROM profiles)
    LEFT JOIN divisions ON division = regexp_replace(cnae, '[^0-9]', '', 'g')[1:2]
    GROUP BY profile_id
    """,
    "profiles", "divisions",
)

# Every notice against every profile, rule by rule.
_view(
    "strengths",
    f"""
    SELECT n.control_number, p.profile_id, minimum_score, closes,
      closes <= {AT} AS closed,
      len(keywords) AS keyword_count, coalesce(hits, 0) AS hits,
      coalesce(served, CAST([] AS VARCHAR[])) AS served, segment, confidence,
      estimated_value, value_min, value_max, state, states,
      CASE WHEN len(keywords) = 0 THEN 'UNAVAILABLE' WHEN hits > 0 THEN 'CONTRIBUTED'
        ELSE 'SILENT' END AS keyword_kind,
      CASE WHEN len(keywords) > 0 THEN CAST(coalesce(hits, 0) AS DOUBLE) / len(keywords)
        ELSE 0 END AS keyword_strength,
      CASE WHEN len(cnaes) = 0 THEN 'UNAVAILABLE' WHEN segment IS NULL THEN 'PENDING'
        WHEN list_contains(served, segment) THEN 'CONTRIBUTED' ELSE 'SILENT' END AS segment_kind,
      CASE WHEN len(cnaes) > 0 AND list_contains(served, segment) THEN confidence
        ELSE CAST(0 AS DOUBLE) END AS segment_strength,
      CASE WHEN value_min IS NULL OR estimated_value IS NULL THEN 'UNAVAILABLE'
        WHEN estimated_value BETWEEN value_min AND value_max THEN 'CONTRIBUTED'
        ELSE 'SILENT' END AS value_kind,
      CASE WHEN estimated_value BETWEEN value_min AND value_max THEN CAST(1 AS DOUBLE)
        ELSE CAST(0 AS DOUBLE) END AS value_strength,
      CASE WHEN len(states) = 0 THEN 'UNAVAILABLE' WHEN list_contains(states, state)
        THEN 'CONTRIBUTED' ELSE 'SILENT' END AS state_kind,
      CASE WHEN list_contains(states, state) THEN CAST(1 AS DOUBLE)
        ELSE CAST(0 AS DOUBLE) END AS state_strength,
      CASE WHEN date_diff('microsecond', {AT}, closes) >= 1209600000000 THEN CAST(1 AS DOUBLE)
        WHEN date_diff('microsecond', {AT}, closes) <= 172800000000 THEN CAST(0.1 AS DOUBLE)
        ELSE CAST(0.1 AS DOUBLE) + CAST(0.9 AS DOUBLE)
          * (CAST(date_diff('microsecond', {AT}, closes) - 172800000000 AS DOUBLE)
            / CAST(1036800000000 AS DOUBLE)) END AS deadline_strength
    FROM notices n CROSS JOIN profiles p
    LEFT JOIN latest USING (control_number)
    LEFT JOIN served USING (profile_id)
    LEFT JOIN found f ON f.object_description = n.object_description AND f.profile_id = p.profile_id
    """,
    "notices", "profiles", "latest", "served", "found",
)

_view(
    "scored",
    """
    SELECT *,
      CAST(floor(CAST(30 AS DOUBLE) * keyword_strength + CAST(30 AS DOUBLE) * segment_strength
        + CAST(15 AS DOUBLE) * value_strength + CAST(15 AS DOUBLE) * state_strength
        + CAST(10 AS DOUBLE) * deadline_strength + CAST(0.5 AS DOUBLE)) AS INTEGER) AS score,
      CAST(CASE WHEN keyword_kind = 'UNAVAILABLE' THEN 0 ELSE 30 END
        + CASE WHEN segment_kind IN ('UNAVAILABLE', 'PENDING') THEN 0 ELSE 30 END
        + CASE WHEN value_kind = 'UNAVAILABLE' THEN 0 ELSE 15 END
        + CASE WHEN state_kind = 'UNAVAILABLE' THEN 0 ELSE 15 END + 10 AS INTEGER) AS coverage,
      segment_kind = 'PENDING' AS provisional
    FROM strengths
    """,
    "strengths",
)

_view(
    "matched",
    """
    SELECT *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-'
      || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1)
      || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS match_id
    FROM (SELECT *, md5(control_number || '|' || profile_id) AS h FROM scored
      WHERE NOT closed AND score >= minimum_score)
    """,
    "scored",
)

_view(
    "asked",
    """
    SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS control_number,
      CAST(l_suppkey AS VARCHAR) AS profile_id FROM lineitem
    """,
)

_view(
    "deliveries",
    """
    SELECT *, md5(CAST(content AS VARCHAR) || '|' || coalesce(strftime(t, '%Y'), '-')) AS h FROM (
      SELECT CAST(l_orderkey AS VARCHAR) AS control_number, l_partkey % 3 AS content,
        (CAST(l_linenumber AS BIGINT) * 4000
          + date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))) * 1000000000
          + l_partkey AS seq,
        CASE WHEN l_returnflag <> 'R' THEN date_trunc('year', l_shipdate) END AS t
      FROM lineitem)
    """,
)

_view(
    "stored_versions",
    """
    SELECT *, md5(CAST(content AS VARCHAR) || '|' || strftime(t, '%Y')) AS h FROM (
      SELECT CAST(o_orderkey AS VARCHAR) AS control_number, o_custkey % 3 AS content,
        date_trunc('year', o_orderdate) AS t
      FROM orders WHERE o_orderstatus <> 'P')
    """,
)


def fold_views(prefix: str, source: str, *needs: str) -> None:
    """Verdicts by window functions over one key at a time: ``<prefix>_verdicts``."""
    _view(
        f"{prefix}_segments",
        f"""
        SELECT *, sum(CASE WHEN t IS NULL THEN 1 ELSE 0 END) OVER (
          PARTITION BY control_number ORDER BY seq ROWS UNBOUNDED PRECEDING) AS seg FROM {source}
        """,
        *needs,
    )
    _view(
        f"{prefix}_states",
        f"""
        SELECT *,
          coalesce(arg_max(h, row(t, seq)) FILTER (t IS NOT NULL) OVER w, first_value(h) OVER w)
            AS state_h,
          max(t) OVER w AS state_t
        FROM {prefix}_segments
        WINDOW w AS (PARTITION BY control_number, seg ORDER BY seq ROWS UNBOUNDED PRECEDING)
        """,
        f"{prefix}_segments",
    )
    _view(
        f"{prefix}_verdicts",
        f"""
        SELECT *, CASE WHEN before_h IS NULL THEN 'stored' WHEN before_h = h THEN 'unchanged'
            WHEN t < before_t THEN 'stale' ELSE 'stored' END AS outcome
        FROM (SELECT *, lag(state_h) OVER w AS before_h, lag(state_t) OVER w AS before_t
          FROM {prefix}_states WINDOW w AS (PARTITION BY control_number ORDER BY seq))
        """,
        f"{prefix}_states",
    )


fold_views("plain", "deliveries", "deliveries")
_view(
    "after_stored",
    """
    SELECT control_number, seq, t, h FROM deliveries
    UNION ALL SELECT control_number, -1 AS seq, t, h FROM stored_versions
    """,
    "deliveries", "stored_versions",
)
fold_views("next", "after_stored", "after_stored")

_view(
    "chunk_events",
    """
    SELECT CAST(ts AS DATE) AS cycle_date,
      CAST(CAST(ts AS DATE) - CAST(user_id % 5 AS INTEGER) AS DATE) AS publication_date,
      [4, 6, 8][user_id // 5 % 3 + 1] AS modality_code,
      ['SP', 'RJ', 'MG', 'BA'][user_id // 15 % 4 + 1] AS state,
      ts AS moment, event_type, value
    FROM events
    """,
)
_view(
    "ledger",
    """
    SELECT cycle_date, publication_date, modality_code, state,
      CASE WHEN count(*) FILTER (event_type = 'signup') >= 3 THEN 'MANUAL' ELSE 'SCHEDULED' END
        AS origin,
      CAST(count(*) AS INTEGER) AS attempts,
      max(moment) FILTER (event_type = 'purchase') AS completed_at,
      CASE WHEN count(*) FILTER (event_type = 'purchase') > 0
        THEN count(*) FILTER (event_type = 'view') END AS pages_fetched,
      CASE WHEN count(*) FILTER (event_type = 'purchase') > 0
        THEN count(*) FILTER (event_type = 'click') END AS notices_published,
      max(moment) FILTER (event_type = 'error') AS last_failure_at
    FROM chunk_events GROUP BY ALL
    """,
    "chunk_events",
)
_view(
    "recorded_gaps",
    """
    SELECT publication_date, modality_code, state, min(moment) AS detected_at,
      CASE WHEN count(*) >= 2 THEN max(moment) END AS resolved_at
    FROM chunk_events WHERE event_type = 'error' AND value > 30 GROUP BY ALL
    """,
    "chunk_events",
)
_view(
    "covered",
    """
    SELECT DISTINCT publication_date, modality_code, state FROM ledger
    WHERE completed_at IS NOT NULL AND cycle_date > publication_date
    """,
    "ledger",
)
_view(
    "responsible",
    """
    SELECT modality_code, state, min(publication_date) AS since FROM ledger
    WHERE origin = 'SCHEDULED' AND modality_code IN (4, 6, 8) AND state IN ('SP', 'RJ', 'MG')
    GROUP BY ALL
    """,
    "ledger",
)
_view(
    "new_gaps",
    """
    SELECT CAST(d AS DATE) AS publication_date, modality_code, state
    FROM responsible, LATERAL (SELECT unnest(
      generate_series(CAST(since AS TIMESTAMP), TIMESTAMP '2024-01-27', INTERVAL 1 DAY)) AS d)
    WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.publication_date = CAST(d AS DATE)
        AND c.modality_code = responsible.modality_code AND c.state = responsible.state)
      AND NOT EXISTS (SELECT 1 FROM recorded_gaps g WHERE g.publication_date = CAST(d AS DATE)
        AND g.modality_code = responsible.modality_code AND g.state = responsible.state)
    """,
    "responsible", "covered", "recorded_gaps",
)

_WINDOW_TEXT = (
    "'the proposal window closes before it opens: ' || strftime(day + 1, '%Y-%m-%dT11:00:00Z')"
    " || ' then ' || strftime(day - 5, '%Y-%m-%dT20:30:00Z')"
)
# What mapping must make of every raw notice, from the defect it was given.
_view(
    "raw",
    f"""
    SELECT *, CAST(date_trunc('year', day) AS DATE) AS publication_date,
      CASE WHEN kind = 0 THEN 'unknown' ELSE 'C-' || k END AS control_number,
      CASE WHEN kind = 8 THEN 'not_biddable' WHEN kind IN (0,1,2,3,4,5,6,7,9,10,11,12)
        THEN 'rejected' ELSE 'mapped' END AS outcome,
      CASE kind WHEN 0 THEN 'numeroControlePNCP' WHEN 1 THEN 'objetoCompra'
        WHEN 2 THEN 'objetoCompra' WHEN 3 THEN 'unidadeOrgao.ufSigla' WHEN 4 THEN 'modalidadeId'
        WHEN 5 THEN 'valorTotalEstimado' WHEN 6 THEN 'proposalWindow' WHEN 7 THEN 'proposalWindow'
        WHEN 9 THEN 'dataPublicacaoPncp' WHEN 10 THEN 'unidadeOrgao'
        WHEN 11 THEN 'dataAtualizacaoGlobal' WHEN 12 THEN 'notice' END AS field,
      CASE kind WHEN 0 THEN '{V.FIELD_ABSENT}' WHEN 1 THEN '{V.FIELD_NULL}'
        WHEN 2 THEN '{V.FIELD_BLANK}' WHEN 3 THEN '{V.NOT_A_STATE}XX' WHEN 4 THEN '{V.NOT_WHOLE}6'
        WHEN 5 THEN '{V.NEGATIVE_VALUE}-1.5' WHEN 6 THEN {_WINDOW_TEXT}
        WHEN 7 THEN '{V.NO_CLOSING}' WHEN 8 THEN '{V.NO_WINDOW}' WHEN 9 THEN '{V.FIELD_BLANK}'
        WHEN 10 THEN '{V.UNIT_MISSING}' WHEN 11 THEN '{V.NOT_A_TIMESTAMP}yesterday'
        WHEN 12 THEN '{V.MODALITY_NOT_POSITIVE}0' END AS reason
    FROM (
      SELECT o_orderkey AS k, o_orderkey % 20 AS kind,
        CAST(o_orderdate + INTERVAL 27 YEAR AS DATE) AS day,
        CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 6 ELSE 8 END
          AS modality_code,
        {_STATES}[c_nationkey + 1] AS state, lower(c_mktsegment) AS trade,
        CASE WHEN o_orderkey % 2003 = 1 THEN '900000000000000000000000' ELSE '' END
          || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)
          || CASE WHEN o_orderkey % 29 = 1 AND o_orderkey % 2003 <> 1 THEN '0000000007' ELSE '' END
          AS amount,
        CAST(o_orderkey // 2000 + 1 AS INTEGER) AS page_number
      FROM orders JOIN customer ON o_custkey = c_custkey)
    """,
)
# Notices as they came on landed pages: one year failed, one was blank, one lost a field.
_view(
    "landed",
    f"""
    SELECT * REPLACE (
        CASE WHEN spoiled AND kind = 8 THEN 'not_biddable' WHEN spoiled THEN 'rejected'
          ELSE outcome END AS outcome,
        CASE WHEN spoiled AND kind NOT IN (0, 6, 7, 8) THEN 'objetoCompra' ELSE field END AS field,
        CASE WHEN spoiled AND kind NOT IN (0, 6, 7, 8) THEN '{V.FIELD_ABSENT}' ELSE reason END
          AS reason)
    FROM (SELECT *, year(publication_date) = 2025 AND modality_code = 4 AS spoiled FROM raw)
    WHERE NOT (year(publication_date) IN (2023, 2024) AND page_number = 1)
    """,
    "raw",
)


def with_views(needs: list[str], query: str) -> str:
    """A query preceded by the views it needs, in order of dependency."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in VIEWS[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        visit(name)
    # Views several others read are computed once.
    parts = [f"{name} AS MATERIALIZED ({VIEWS[name][1].strip()})" for name in ordered]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + query.strip()
