"""The generic sample tables seen as procurement data.

Each function reads ``<folder>/<table>.parquet`` and derives one of the tables the jobs work on,
so that the jobs can be run, checked and timed on the same data at every scale.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderloom import vocabulary as V
from tenderloom.functions.values import plain_number
from tenderloom.operators.rules import instant
from tenderloom.sources.messages import arrival

EVALUATED_AT = datetime(2026, 9, 22, 12, 0, 0)
MODALITIES = {4: "Concorrência", 6: "Pregão", 8: "Dispensa"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key to as many tasks as any shuffle has. A table may come in one or two files, and what
    is made of its rows costs more than reading them."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def pick(values: list, index: Column) -> Column:
    """An element of a fixed list by an index column."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def modality_code(priority: Column) -> Column:
    return F.when(priority == "1-URGENT", 4).when(priority == "2-HIGH", 6).otherwise(8)


def notices(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as notices: text from the customer's trade and a part, state from the nation."""
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    key = F.col("o_orderkey")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        part, F.floor(key / 8) == F.col("p_partkey"), "left"
    )
    name = F.coalesce("p_name", F.lit("item"))
    # Every third text is accented and plural, so that folding has something to do.
    form = F.floor(key / 3) % 3
    text = (
        F.when(form == 0, F.concat(F.translate(name, "aeo", "áéõ"), F.lit("s")))
        .when(form == 1, F.upper(name))
        .otherwise(name)
    )
    closes = F.timestamp_micros(
        F.unix_micros(instant(EVALUATED_AT))
        + ((key % 60) - 10) * F.lit(86_400_000_000)
        + (key % 24) * F.lit(3_600_000_000)
    )
    code = modality_code(F.col("o_orderpriority"))
    amount = F.when(key % 7 != 0, F.col("o_totalprice").cast("decimal(18,2)"))
    return joined.select(
        key.cast("string").alias("control_number"),
        F.concat(F.lit("Aquisição de "), text, F.lit(" ("), F.lower("c_mktsegment"), F.lit(")")).alias(
            "object_description"
        ),
        pick(V.STATES, F.col("c_nationkey")).alias("state"),
        amount.cast("decimal(38,10)").alias("estimated_value"),
        plain_number(amount).alias("estimated_amount"),
        code.alias("modality_code"),
        F.when(code == 4, MODALITIES[4]).when(code == 6, MODALITIES[6]).otherwise(MODALITIES[8])
        .alias("modality_name"),
        F.col("o_orderdate").cast("timestamp").alias("published_at"),
        F.timestamp_micros(F.unix_micros(closes) - F.lit(14 * 86_400_000_000)).alias(
            "proposal_opens_at"
        ),
        closes.alias("proposal_closes_at"),
        F.md5(F.concat_ws("|", key.cast("string"), "o_orderstatus")).alias("source_payload_hash"),
        F.col("o_orderdate").cast("timestamp").alias("source_updated_at"),
    )


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as search profiles: keywords from a part name, ranges from the account."""
    supplier = table(spark, folder, "supplier")
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    key = F.col("s_suppkey")
    joined = supplier.join(part, key == F.col("p_partkey"), "left")
    name = F.coalesce("p_name", F.lit("small ring"))
    first, second = F.split_part(name, F.lit(" "), F.lit(1)), F.split_part(name, F.lit(" "), F.lit(2))
    keywords = (
        F.when(key % 10 == 9, F.array().cast("array<string>"))
        .when(key % 4 == 0, F.array(F.concat(second, F.lit("s"))))
        .when(key % 4 == 1, F.array(first, second))
        .when(key % 4 == 2, F.array(F.upper(second), name))
        .when(key % 20 == 3, F.array(F.concat(name, F.lit("s")), F.lit("Aquisições")))
        .otherwise(F.array(F.concat(name, F.lit("s")), first))
    )
    divisions = [*V.CNAE_DIVISIONS, "99"]
    code = lambda c: F.concat(pick(divisions, c), F.lit("01-5/01"))
    ranged = key % 5 != 4
    low = ((key % 5) * 100_000).cast("decimal(38,10)")
    return joined.select(
        key.cast("string").alias("profile_id"),
        (key % 40).cast("string").alias("company_id"),
        keywords.alias("keywords"),
        F.when(key % 8 == 7, F.array().cast("array<string>"))
        .otherwise(F.array(code(key % 29), code((key * 7 + 3) % 29)))
        .alias("cnaes"),
        F.when(key % 6 == 5, F.array().cast("array<string>"))
        .otherwise(
            F.array(pick(V.STATES, F.col("s_nationkey")), pick(V.STATES, (F.col("s_nationkey") + 1) % 27))
        )
        .alias("states"),
        F.when(ranged, low).alias("value_min"),
        F.when(ranged, low + F.lit(200_000)).cast("decimal(38,10)").alias("value_max"),
        pick([50, 50, 60, 50, 70, 50, 40, 50, 30, 50], key % 10).alias("minimum_score"),
    )


def enrichments(spark: SparkSession, folder: str) -> DataFrame:
    """Two of three notices enriched, some of them twice."""
    key = F.col("o_orderkey")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    rounds = orders.filter(key % 3 != 2).select(
        "*", F.explode(F.when(key % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("n")
    )
    return rounds.select(
        key.cast("string").alias("control_number"),
        pick(V.SEGMENTS, (key * 7 + F.col("n")) % 15).alias("segment"),
        (((key + F.col("n")) % 11) / F.lit(10.0)).cast("double").alias("confidence"),
        (F.col("o_orderdate") + F.make_dt_interval(F.col("n") + 1)).cast("timestamp").alias("generated_at"),
    )


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs somebody asks about: the suppliers of each order."""
    return (
        table(spark, folder, "lineitem")
        .select(
            F.col("l_orderkey").cast("string").alias("control_number"),
            F.col("l_suppkey").cast("string").alias("profile_id"),
        )
        .distinct()
    )


def judged(spark: SparkSession, folder: str) -> DataFrame:
    """Control numbers of the notices that feedback is about."""
    return table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("control_number"))


def feedback(spark: SparkSession, folder: str, matched: DataFrame) -> DataFrame:
    """Document labels as judgements on the matches of the notice with the same number; a toxic
    label comes a day later and revokes the first judgement."""
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").cast("string").alias("control_number"), "quality", "toxic"
    )
    events = labels.join(matched.select("control_number", "match_id"), "control_number").select(
        "match_id", "quality", F.explode(F.sequence(F.lit(0), F.col("toxic"))).alias("n")
    )
    return events.select(
        F.concat_ws("-", "match_id", F.col("n").cast("string")).alias("feedback_id"),
        "match_id",
        F.when((F.col("quality") == 1) & (F.col("n") == 0), V.RELEVANT)
        .otherwise(V.NOT_RELEVANT)
        .alias("verdict"),
        (instant(EVALUATED_AT) + F.make_dt_interval(F.col("n"))).alias("given_at"),
    )


def keyword_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, whole, as texts to search."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("control_number"),
        F.col("text").alias("object_description"),
    )


def keyword_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items as profiles: their first word and their first two words as keywords."""
    word = lambda n: F.split_part("text", F.lit(" "), F.lit(n))
    none = F.array().cast("array<string>")
    return table(spark, folder, "benchmark").select(
        F.col("item_id").cast("string").alias("profile_id"),
        F.lit("0").alias("company_id"),
        F.array(word(1), F.concat(word(1), F.lit(" "), word(2)), F.concat(word(2), F.lit("s")))
        .alias("keywords"),
        none.alias("cnaes"),
        none.alias("states"),
        F.lit(None).cast("decimal(38,10)").alias("value_min"),
        F.lit(None).cast("decimal(38,10)").alias("value_max"),
        F.lit(50).alias("minimum_score"),
    )


def deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as deliveries of their order's notice, in an order all their own."""
    day = F.date_diff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date"))
    time = F.when(
        F.col("l_returnflag") != "R", F.date_trunc("year", F.col("l_shipdate").cast("timestamp"))
    )
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("control_number"),
        (
            (F.col("l_linenumber").cast("bigint") * 4000 + day) * F.lit(1_000_000_000)
            + F.col("l_partkey")
        ).alias("seq"),
        _version_hash(F.col("l_partkey") % 3, time).alias("source_payload_hash"),
        time.alias("source_updated_at"),
    )


def uneven_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as deliveries of their supplier, hundreds each, whose hashes don't cover the time."""
    time = F.date_trunc("month", F.col("l_shipdate").cast("timestamp"))
    day = F.date_diff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date"))
    line = F.col("l_orderkey").cast("bigint") * 10 + F.col("l_linenumber")
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit("S-"), F.col("l_suppkey").cast("string")).alias("control_number"),
        ((line * 4000 + day) * F.lit(1_000_000) + F.col("l_partkey")).alias("seq"),
        F.md5((F.col("l_partkey") % 3).cast("string")).alias("source_payload_hash"),
        F.when(F.col("l_returnflag") != "R", time).alias("source_updated_at"),
    )


def _version_hash(content: Column, time: Column) -> Column:
    """Covers the time, as the change token of a notice does."""
    return F.md5(
        F.concat_ws("|", content.cast("string"), F.coalesce(F.date_format(time, "yyyy"), F.lit("-")))
    )


def stored_versions(spark: SparkSession, folder: str) -> DataFrame:
    """What is stored before the deliveries come: one version of every order already open."""
    time = F.date_trunc("year", F.col("o_orderdate").cast("timestamp"))
    return table(spark, folder, "orders").filter(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").cast("string").alias("control_number"),
        _version_hash(F.col("o_custkey") % 3, time).alias("source_payload_hash"),
        time.alias("source_updated_at"),
    )


# Discovery --------------------------------------------------------------------------------------

WINDOW_START = "2024-01-28"
SCOPE_MODALITIES = [4, 6, 8]
SCOPE_STATES = ["SP", "RJ", "MG"]


def _chunks_of_events(spark: SparkSession, folder: str) -> DataFrame:
    user = F.col("user_id")
    cycle = F.to_date("ts")
    return table(spark, folder, "events").select(
        cycle.alias("cycle_date"),
        F.date_sub(cycle, (user % 5).cast("int")).alias("publication_date"),
        pick([4, 6, 8], F.floor(user / 5) % 3).alias("modality_code"),
        pick(["SP", "RJ", "MG", "BA"], F.floor(user / 15) % 4).alias("state"),
        F.col("ts").cast("timestamp").alias("at"),
        "event_type",
        "value",
    )


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Events as work on chunks: every event an attempt, a purchase a completion."""
    event = F.col("event_type")
    done = F.max(F.when(event == "purchase", F.col("at")))
    failed = event == "error"
    return (
        _chunks_of_events(spark, folder)
        .groupBy("cycle_date", "publication_date", "modality_code", "state")
        .agg(
            F.when(F.count_if(event == "signup") >= 3, V.MANUAL).otherwise(V.SCHEDULED).alias("origin"),
            F.min("at").alias("planned_at"),
            F.count(F.lit(1)).cast("int").alias("attempts"),
            done.alias("completed_at"),
            F.when(done.isNotNull(), F.count_if(event == "view")).cast("int").alias("pages_fetched"),
            F.when(done.isNotNull(), F.count_if(event == "click"))
            .cast("int")
            .alias("notices_published"),
            F.max(F.when(failed, F.col("at"))).alias("last_failure_at"),
            F.when(F.count_if(failed) > 0, "timeout").alias("last_failure"),
        )
    )


def attempt_log(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks_of_events(spark, folder).select(
        "cycle_date",
        "publication_date",
        "modality_code",
        "state",
        "at",
        F.when(F.col("event_type") == "error", F.concat(F.lit("timeout after "), F.col("value").cast("int").cast("string"))).alias("failure"),
    )


def recorded_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Gaps already on record: dates with expensive errors, some of them resolved."""
    return (
        _chunks_of_events(spark, folder)
        .filter((F.col("event_type") == "error") & (F.col("value") > 30))
        .groupBy("publication_date", "modality_code", "state")
        .agg(
            F.min("at").alias("detected_at"),
            F.when(F.count(F.lit(1)) >= 2, F.max("at")).alias("resolved_at"),
        )
    )


# Raw notices ------------------------------------------------------------------------------------


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'"{name}":'), value)


def _quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def raw_notices(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as JSON notices of a later year, most of the kinds of defect among them.

    Chunks are a publication year, a modality and a state; a page holds what falls on it of 2000
    consecutive orders.
    """
    key = F.col("o_orderkey")
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    day = F.add_months(F.to_date("o_orderdate"), 27 * 12)
    code = modality_code(F.col("o_orderpriority"))
    state = pick(V.STATES, F.col("c_nationkey"))
    kind = key % 20
    stamp = lambda shift, clock: _quoted(
        F.concat(F.date_format(F.date_add(day, shift), "yyyy-MM-dd"), F.lit(f"T{clock}"))
    )
    # Some amounts have more decimals, or more digits, than a money column holds.
    amount = F.concat(
        F.when(key % 2003 == 1, F.lit("900000000000000000000000")).otherwise(F.lit("")),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
        F.when((key % 29 == 1) & (key % 2003 != 1), F.lit("0000000007")).otherwise(F.lit("")),
    )
    null = F.lit("null")
    fields = [
        F.when(kind != 0, _field("numeroControlePNCP", _quoted(F.concat(F.lit("C-"), key.cast("string"))))),
        _field(
            "objetoCompra",
            F.when(kind == 1, null).when(kind == 2, F.lit('"  "')).otherwise(
                _quoted(F.concat(F.lit("Aquisição de "), F.lower("c_mktsegment")))
            ),
        ),
        _field(
            "unidadeOrgao",
            F.when(kind == 10, null)
            .when(kind == 3, F.lit('{"ufSigla":"XX"}'))
            .otherwise(F.concat(F.lit('{"ufNome":null,"ufSigla":" '), F.lower(state), F.lit('"}'))),
        ),
        F.when(
            kind != 14,
            _field(
                "valorTotalEstimado",
                F.when(kind == 13, null).when(kind == 5, F.lit("-1.5")).otherwise(amount),
            ),
        ),
        _field(
            "modalidadeId",
            F.when(kind == 4, F.lit('"6"')).when(kind == 12, F.lit("0")).otherwise(code.cast("string")),
        ),
        _field("modalidadeNome", _quoted(F.lit("modalidade"))),
        _field(
            "dataPublicacaoPncp",
            F.when(kind == 9, F.lit('""')).otherwise(stamp(0, "00:00:00")),
        ),
        F.when(~kind.isin(8), _field("dataAberturaProposta", stamp(1, "08:00"))),
        F.when(
            ~kind.isin(7, 8),
            _field(
                "dataEncerramentoProposta",
                F.when(kind == 6, stamp(-5, "17:30:00")).otherwise(stamp(14, "17:30:00.5")),
            ),
        ),
        _field(
            "dataAtualizacaoGlobal",
            F.when(kind == 11, F.lit('"yesterday"')).when(kind == 15, null).otherwise(
                stamp(0, "12:00:00")
            ),
        ),
    ]
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return _spread(joined, "o_orderkey").select(
        F.trunc(day, "year").alias("publication_date"),
        code.alias("modality_code"),
        state.alias("state"),
        (F.floor(key / 2000) + 1).cast("int").alias("page_number"),
        key.alias("o_orderkey"),
        F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("payload"),
    )


def landing(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of raw notices (each holds at most 2000). Some pages came back as an error page, some
    blank, some with notices that all lack a number."""
    chunk = ["publication_date", "modality_code", "state"]
    raw = raw_notices(spark, folder)
    number = F.col("page_number")
    day = F.dayofyear("publication_date")
    spoiled = (F.year("publication_date") == 2025) & (F.col("modality_code") == 4)
    # Pages stay where their notices meet, for what opens them.
    pages = _spread(raw, *chunk, "page_number").groupBy(*chunk, "page_number").agg(
        F.array_join(
            F.collect_list(
                F.when(spoiled, F.regexp_replace("payload", '"objetoCompra":', '"objeto":')).otherwise(
                    F.col("payload")
                )
            ),
            ",",
        ).alias("data")
    )
    totals = raw.select(*chunk, "page_number").distinct().groupBy(*chunk).agg(
        F.count(F.lit(1)).alias("pages")
    )
    body = (
        F.when((F.year("publication_date") == 2023) & (number == 1), F.lit("<html>busy</html>"))
        .when((F.year("publication_date") == 2024) & (number == 1), F.lit(" "))
        .otherwise(
            F.concat(
                F.lit('{"data":['), F.col("data"), F.lit('],"totalPaginas":'),
                F.col("pages").cast("string"), F.lit("}"),
            )
        )
    )
    return pages.join(totals, chunk).withColumn("day", day).select(*chunk, "page_number", body.alias("body"))


def owed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """A ledger that owes every chunk with landed pages, and one with none."""
    chunk = ["publication_date", "modality_code", "state"]
    keys = raw_notices(spark, folder).select(*chunk).distinct()
    empty = keys.filter(F.col("state") == "AC").select(
        F.add_months("publication_date", 12 * 50).alias("publication_date"), "modality_code", "state"
    )
    return keys.unionByName(empty).select(
        F.add_months("publication_date", 12 * 60).alias("cycle_date"),
        *chunk,
        F.lit(V.SCHEDULED).alias("origin"),
        instant(EVALUATED_AT).alias("planned_at"),
        F.lit(0).alias("attempts"),
        F.lit(None).cast("timestamp").alias("completed_at"),
        F.lit(None).cast("int").alias("pages_fetched"),
        F.lit(None).cast("int").alias("notices_published"),
        F.lit(None).cast("timestamp").alias("last_failure_at"),
        F.lit(None).cast("string").alias("last_failure"),
    )


def gaps_of(owed: DataFrame) -> DataFrame:
    """An open gap for every owed chunk."""
    return owed.select(
        "publication_date", "modality_code", "state", F.col("planned_at").alias("detected_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
    )


def _arrival(place: Column, run: Column | None = None) -> Column:
    """A place in the runs of consecutive days, the first of them at the time of evaluation."""
    day = F.lit(0) if run is None else run
    at = F.timestamp_micros(F.unix_micros(instant(EVALUATED_AT)) + day * F.lit(86_400_000_000))
    return arrival(at, F.to_date(at), F.lit(6), F.lit("SP"), F.lit(1), place)


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Raw notices as messages, some of a newer version, some breaking the contract."""
    key = F.col("o_orderkey")
    return raw_notices(spark, folder).select(
        _arrival(key).alias("seq"),
        F.when(key % 97 == 0, 2).when(key % 89 == 0, 0).otherwise(1).alias("schema_version"),
        F.when(key % 83 != 0, F.concat(F.lit("C-"), key.cast("string"))).alias("control_number"),
        F.when(key % 79 == 0, " ").otherwise(F.md5("payload")).alias("content_hash"),
        pick(
            [None, "2026-09-01T17:22:01Z", "2026-09-01T17:22:01.500Z", "2026-09-01T17:22:01.5Z",
             "2026-09-01T14:22:01-03:00", "2026-09-01T17:22:01.000Z", "2026-09-01T17:22:01Z", ""],
            F.floor(key / 7) % 8,
        ).alias("source_updated_at"),
        F.when(key % 73 == 0, "not json").otherwise(F.col("payload")).alias("raw_payload"),
    )


def delivery_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Every raw notice delivered, delivered again, and delivered in an older form that arrives
    late, as a queue would."""
    raw = raw_notices(spark, folder)
    copies = raw.select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("copy"))
    older = F.regexp_replace("payload", "T12:00:00", "T06:00:00")
    return copies.select(
        _arrival(F.col("o_orderkey"), F.col("copy")).alias("seq"),
        F.lit(1).alias("schema_version"),
        F.concat(F.lit("C-"), F.col("o_orderkey").cast("string")).alias("control_number"),
        F.lit("unused").alias("content_hash"),
        F.lit(None).cast("string").alias("source_updated_at"),
        F.when(F.col("copy") == 2, older).otherwise(F.col("payload")).alias("raw_payload"),
    )
