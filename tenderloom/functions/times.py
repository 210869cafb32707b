"""Local times, calendar dates and the one spelling of an instant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderloom.functions.text import trimmed
from tenderloom.vocabulary import PUBLICATION_ZONE

_LOCAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?$"
_CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.(\d{3}|\d{6}|\d{9}))?Z$"


def local_instant(text: Column, zone: str = PUBLICATION_ZONE) -> Column:
    """Instant of a naive ISO local date-time; null when it is not one (an offset is refused)."""
    return trimmed_instant(trimmed(text), zone)


def trimmed_instant(body: Column, zone: str = PUBLICATION_ZONE) -> Column:
    """The same for a text without surrounding blanks, best a column, as it is read several times."""
    # Without seconds it has 16 characters.
    seconds = F.when(F.octet_length(body) == 16, F.lit(":00Z")).otherwise(F.lit("Z"))
    wall_clock = F.concat(body, seconds).try_cast("timestamp")
    return F.when(body.rlike(_LOCAL) & ~body.contains("T24:"), F.to_utc_timestamp(wall_clock, zone))


def local_date(instant: Column, zone: str = PUBLICATION_ZONE) -> Column:
    """Calendar date of an instant where notices are published."""
    return F.to_date(F.from_utc_timestamp(instant, zone))


def days_late(published_at: Column, seen_at: Column) -> Column:
    return F.date_diff(local_date(seen_at), local_date(published_at))


def window_dates(cycle_date: Column, lookback: int) -> Column:
    """Publication dates a cycle owes: the lookback and the day itself, oldest first."""
    if lookback < 1:
        raise ValueError("a lookback below one day leaves every date without a covering cycle")
    return F.sequence(F.date_sub(cycle_date, lookback), cycle_date)


def date_key(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def is_canonical_instant(text: Column) -> Column:
    """True when the text is the one spelling of a UTC instant: fraction in groups of three,
    never a group of trailing zeros."""
    fraction = F.regexp_extract(text, r"\.(\d+)Z$", 1)
    return F.coalesce(
        text.rlike(_CANONICAL)
        & ~fraction.rlike("000$")
        & text.try_cast("timestamp").isNotNull()
        & ~text.contains("T24:"),
        F.lit(False),
    )


def instant_text(instant: Column) -> Column:
    """Canonical UTC text of an instant (microsecond columns: no, 3 or 6 fraction digits)."""
    micros = F.pmod(F.unix_micros(instant), F.lit(1_000_000))
    pattern = (
        F.when(micros == 0, F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(micros % 1000 == 0, F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .otherwise(F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    )
    return pattern
