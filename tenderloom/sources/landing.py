"""Landed pages: one row per fetched page body, laid out by publication date, modality, state."""

from __future__ import annotations

import json
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.functions.text import is_blank, quoted_payload
from tenderloom.functions.times import date_key
from tenderloom.schemas import LANDING
from tenderloom.vocabulary import EMPTY_BODY, QUOTE_LENGTH

CHUNK = ["publication_date", "modality_code", "state"]
# What a stored landing is laid out by, in the same order.
FOLDERS = ["publication_day", "modality_dir", "state_dir"]


def write_landing(pages: DataFrame, path: str) -> None:
    """Store pages partitioned by chunk; writing a chunk again replaces that chunk only."""
    (
        with_folders(pages)
        .write.partitionBy(*FOLDERS)
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def with_folders(chunks: DataFrame) -> DataFrame:
    """Where the pages of a chunk are stored."""
    values = [date_key("publication_date"), F.col("modality_code"), F.col("state")]
    return chunks.withColumns(dict(zip(FOLDERS, values)))


def of_chunks(pages: DataFrame, chunks: DataFrame, few: bool) -> DataFrame:
    """The pages of some chunks. Where few chunks are asked for from a stored landing, they are sent to
    every executor first, and Spark opens no folder but theirs."""
    on = CHUNK
    if set(FOLDERS) <= set(pages.columns):
        # The test on the day is always true; it tells the planner that the chunks are a selection.
        chunks, on = with_folders(chunks).filter(F.col("publication_day") > ""), [*CHUNK, *FOLDERS]
    found = pages.join(F.broadcast(chunks) if few else chunks, on, "left_semi")
    return found.drop(*FOLDERS)


def page_totals(pages: DataFrame) -> DataFrame:
    """Pages landed for each chunk."""
    return pages.groupBy(*CHUNK).agg(F.countDistinct("page_number").alias("pages"))


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    folders = "publication_day STRING, modality_dir INT, state_dir STRING"
    layout = T.StructType([*LANDING.fields, *T.StructType.fromDDL(folders).fields])
    return spark.read.schema(layout).parquet(path)


def scan_chunk(pages: DataFrame, day: date, modality: int, state: str) -> DataFrame:
    """All pages of one publication date, modality and state."""
    return scan_range(pages, day, day, [modality], [state])


def scan_range(
    rows: DataFrame, first: date, last: date, modalities: list[int], states: list[str] = ()
) -> DataFrame:
    """Rows published between two dates, both included. No state at all means every state."""
    if first > last:
        raise ValueError(f"a range must not end before it starts: {first} > {last}")
    wanted = F.col("publication_date").between(F.lit(first), F.lit(last)) & F.col(
        "modality_code"
    ).isin(list(modalities))
    if states:
        wanted = wanted & F.col("state").isin(list(states))
    if "publication_day" in rows.columns:
        # The folder columns let the file listing be pruned before anything is read.
        wanted = (
            wanted
            & F.col("publication_day").between(first.strftime("%Y%m%d"), last.strftime("%Y%m%d"))
            & F.col("modality_dir").isin(list(modalities))
        )
        if states:
            wanted = wanted & F.col("state_dir").isin(list(states))
    return rows.filter(wanted)


def _skip(body: str, at: int) -> int:
    while body[at] in " \t\r\n,:":
        at += 1
    return at


def _slices(body: str | None) -> list[str] | None:
    """The elements of the ``data`` array exactly as written."""
    if body is None:
        return None
    decode = json.JSONDecoder().raw_decode
    found = None
    at = _skip(body, _skip(body, 0) + 1)
    while body[at] != "}":
        key, at = decode(body, at)
        at = _skip(body, at)
        if key == "data" and body[at] == "[":
            found, at = [], _skip(body, at + 1)
            while body[at] != "]":
                start = at
                _, at = decode(body, at)
                found.append(body[start:at])
                at = _skip(body, at)
            at = _skip(body, at + 1)
        else:
            _, at = decode(body, at)
            at = _skip(body, at)
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def _exact_slices(bodies: pd.Series) -> pd.Series:
    return bodies.map(_slices)


def open_pages(pages: DataFrame) -> DataFrame:
    """Read each page envelope: its raw notices, its totals, or why it cannot be read.

    A blank body is an empty page, which is normal. A body that is not a JSON object with a
    ``data`` array carries a ``page_failure``. Notices are re-rendered from the parsed page; pages
    with a number the parsed form may not hold exactly (an exponent, or 17 digits and more) are cut
    from the text instead, so that no digit is lost.
    """
    quoted = quoted_payload(F.col("body"), QUOTE_LENGTH, EMPTY_BODY)
    parsed = pages.withColumn("_page", F.expr("try_parse_json(body)")).withColumn(
        "_data", F.try_variant_get("_page", "$.data", "array<variant>")
    )
    blank = F.coalesce(is_blank(F.col("body")), F.lit(True))
    failure = (
        F.when(blank, F.lit(None))
        .when(F.col("_page").isNull(), F.concat(F.lit("the page is not JSON: "), quoted))
        .when(F.col("_data").isNull(), F.concat(F.lit("the page has no data array: "), quoted))
    )
    delicate = F.col("_data").isNotNull() & F.col("body").rlike("[0-9](?:[eE][+-]?[0-9]|[0-9]{16})")
    rendered = F.when(
        ~delicate, F.transform("_data", lambda v: F.coalesce(F.to_json(v), F.lit("null")))
    )
    none = F.array().cast("array<string>")

    def number(name: str, default: Column) -> Column:
        return F.coalesce(F.try_variant_get("_page", f"$.{name}", "int"), default)

    return (
        parsed.withColumn("page_failure", failure)
        .withColumn("_exact", _exact_slices(F.when(delicate, F.col("body"))))
        .withColumn("payloads", F.coalesce(rendered, F.col("_exact"), none))
        .withColumn("total_records", number("totalRegistros", F.size("payloads")))
        .withColumn("total_pages", number("totalPaginas", F.lit(1)))
        .withColumn("page_number", number("numeroPagina", F.col("page_number")))
        .drop("_page", "_data", "_exact", "body")
    )


def page_notices(opened: DataFrame, keep_pages: bool = False) -> DataFrame:
    """One row per notice with its raw payload and its place on the page. With ``keep_pages`` a
    page without notices leaves one row with a null payload, and failures stay on the rows."""
    dropped = ("payloads",) if keep_pages else ("payloads", "page_failure")
    rows = opened.select(
        *[c for c in opened.columns if c not in dropped],
        F.posexplode_outer("payloads").alias("position", "payload"),
    )
    return rows if keep_pages else rows.filter(F.col("payload").isNotNull())
