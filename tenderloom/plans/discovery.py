"""The discovery run over landed pages: from pages to messages and ledger updates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom import vocabulary as V
from tenderloom.operators.coverage import complete_chunks, record_attempts, resolve_gaps
from tenderloom.operators.mapping import map_notices, with_change_token
from tenderloom.operators.reports import with_published
from tenderloom.plans.sizing import fits
from tenderloom.schemas import LEDGER_KEY
from tenderloom.sources.landing import CHUNK, of_chunks, open_pages, page_notices
from tenderloom.sources.messages import arrival, messages_for, publish
from tenderloom.sources.tables import write_batch


@dataclass(frozen=True)
class DiscoveryRun:
    """Results of one run. Publish ``messages`` first and store the ledger last: a crash between
    the two repeats work that ingestion then recognises, the other order would lose notices."""

    messages: DataFrame
    results: DataFrame
    attempts: DataFrame
    mapped: DataFrame

    def next_ledger(self, ledger: DataFrame) -> DataFrame:
        return complete_chunks(record_attempts(ledger, self.attempts), self.results)


def run_and_store(
    owed: DataFrame, pages: DataFrame, ledger: DataFrame, gaps: DataFrame, now: Column, home: str, run: int
) -> DiscoveryRun:
    """One run, written: the mapped notices once, then the messages, then the ledger, then the gaps
    that it settles. Each table has a folder for the run, which a repeated run replaces, so a crash
    anywhere is mended by running again; until the ledger is written the chunks are owed as before."""
    spark = ledger.sparkSession

    def once(rows: DataFrame) -> DataFrame:
        write_batch(rows, f"{home}/mapped", run)
        return spark.read.schema(rows.schema).parquet(f"{home}/mapped/batch_id={run}")

    found = discover(owed, pages, now, keep=once)
    publish(found.messages, f"{home}/messages", run)
    sent = spark.read.schema(found.messages.schema).parquet(f"{home}/messages/run={run}")
    found = replace(found, results=with_published(found.results, sent))
    write_batch(found.next_ledger(ledger), f"{home}/ledger", run)
    following = spark.read.schema(ledger.schema).parquet(f"{home}/ledger/batch_id={run}")
    write_batch(resolve_gaps(gaps, following), f"{home}/gaps", run)
    return found


def discover(
    owed: DataFrame, pages: DataFrame, now: Column, keep: Callable[[DataFrame], DataFrame] | None = None
) -> DiscoveryRun:
    """Work the owed chunks (ledger rows) from the pages landed for them.

    A chunk publishes all of its mapped notices or nothing. It fails when a page cannot be read,
    when every notice of a page is rejected, when a page is missing, or when nothing landed; other
    chunks go on. Returned tables share ``mapped``; ``keep`` may store it, so that pages are read and
    mapped once.
    """
    chunks = owed.select(*LEDGER_KEY)
    asked = chunks.select(*CHUNK).distinct()
    # The owed chunks bound every list of chunks below, so one check decides for all of them.
    few = fits(asked)
    opened = open_pages(of_chunks(pages, asked, few))
    # The notice has a state and a modality of its own, so the chunk's get other names.
    origin = {"modality_code": "chunk_modality", "state": "chunk_state"}
    page = ["publication_date", "chunk_modality", "chunk_state", "page_number"]
    rows = map_notices(page_notices(opened, keep_pages=True).withColumnsRenamed(origin))
    rows = rows if keep is None else keep(rows)
    mapped = rows.filter(F.col("payload").isNotNull()).drop("page_failure", "total_pages")

    # Page counts first, then chunk counts, so that a chunk with very many pages spreads out.
    notice = F.col("payload").isNotNull()
    page_facts = (
        rows.groupBy(*page)
        .agg(
            F.count("payload").alias("notices"),
            F.count_if(notice & (F.col("outcome") == V.REJECTED)).alias("rejected"),
            F.count_if(notice & (F.col("outcome") == V.MAPPED)).alias("mapped"),
            F.max("page_failure").alias("page_failure"),
            F.max("total_pages").alias("total_pages"),
        )
        .withColumn(
            "failure",
            F.coalesce(
                "page_failure",
                F.when(
                    (F.col("notices") > 0) & (F.col("rejected") == F.col("notices")),
                    F.format_string(
                        "all %d notices of page %d were rejected, so the source changed its contract",
                        F.col("notices"),
                        F.col("page_number"),
                    ),
                ),
            ),
        )
    )
    back = {new: old for old, new in origin.items()}
    per_chunk = page_facts.withColumnsRenamed(back).groupBy(*CHUNK).agg(
        F.min(F.when(F.col("failure").isNotNull(), F.struct("page_number", "failure"))).alias("_bad"),
        F.count(F.lit(1)).alias("_pages"),
        F.max("total_pages").alias("_total"),
        F.coalesce(F.sum("mapped"), F.lit(0)).alias("_mapped"),
    )
    worked = chunks.join(per_chunk, CHUNK, "left").withColumn(
        "failure",
        F.coalesce(
            F.col("_bad.failure"),
            F.when(F.col("_pages").isNull(), F.lit("no page was landed for this chunk")),
            F.when(
                F.col("_pages") < F.col("_total"),
                F.format_string("%d of %d pages were landed", F.col("_pages"), F.col("_total")),
            ),
        ),
    )
    succeeded = worked.filter(F.col("failure").isNull())
    results = succeeded.select(
        *LEDGER_KEY,
        now.alias("at"),
        F.col("_pages").cast("int").alias("pages"),
        F.col("_mapped").cast("int").alias("discovered"),
        F.col("_mapped").cast("int").alias("published"),
    )
    attempts = worked.select(*LEDGER_KEY, now.alias("at"), "failure")
    settled = succeeded.select(*CHUNK).distinct().withColumnsRenamed(origin)
    if few:
        settled = F.broadcast(settled)
    publishable = mapped.filter(F.col("outcome") == V.MAPPED).join(settled, page[:-1], "left_semi")
    place = arrival(now, *[F.col(c) for c in page], F.col("position"))
    messages = messages_for(with_change_token(publishable), place)
    return DiscoveryRun(messages, results, attempts, mapped)

