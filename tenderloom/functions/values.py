"""Numbers, identifiers and codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenderloom.vocabulary import CNAE_DIVISIONS, OTHER_SEGMENT


def round_half_up(points: Column) -> Column:
    return F.floor(points + F.lit(0.5)).cast("int")


def plain_number(value: Column) -> Column:
    """Decimal as text without trailing zeros; whole numbers without a point."""
    return plain_text(value.cast("string"))


def plain_text(text: Column) -> Column:
    """The same for a number that is text already."""
    return F.when(
        text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), "\\.$", "")
    ).otherwise(text)


def match_id(control_number: Column, profile_id: Column) -> Column:
    """Name-based UUID (version 3, no namespace) of a pair, so the same pair keeps one id."""
    digest = F.md5(F.concat(control_number, F.lit("|"), profile_id))
    # The digit's two low bits behind the bits 10.
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("3"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def uuid_bytes(text: Column) -> Column:
    """The 16 bytes of a UUID in its canonical form; null for any other text."""
    canonical = F.rlike(text, F.lit("\\A[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\\z"))
    return F.when(canonical, F.unhex(F.translate(text, "-", "")))


def uuid_text(data: Column) -> Column:
    """The canonical form of a UUID's 16 bytes."""
    digits = F.lower(F.hex(data))
    places = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.when(data.isNotNull(), F.concat_ws("-", *[F.substring(digits, *place) for place in places]))


def text_hash(object_description: Column) -> Column:
    """Hash of the text alone, the key under which an enrichment can be reused."""
    return F.sha2(object_description, 256)


def digits(code: Column) -> Column:
    return F.regexp_replace(code, "[^0-9]", "")


def cnae_division(code: Column) -> Column:
    return F.substring(digits(code), 1, 2)


def segment_of(code: Column) -> Column:
    """Segment of a CNAE through its division; OTHER where the map makes no claim."""
    table = F.create_map(*[F.lit(x) for pair in CNAE_DIVISIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, cnae_division(code)), F.lit(OTHER_SEGMENT))


def value_octave(value: Column) -> Column:
    """Coarse, order-preserving bin of a non-negative amount, used to turn a range test into an
    equality."""
    return F.floor(F.log2(value.cast("double") + F.lit(1.0))).cast("int")
