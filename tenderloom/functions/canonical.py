"""The change token: a hash of a JSON payload that ignores everything but content."""

from __future__ import annotations

import hashlib
import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _refuse(constant: str):
    raise ValueError(f"{constant} is not JSON")


# Digits of a number beyond which a payload is taken for broken.
_MOST_DIGITS = 20_000


class _Canonical(str):
    """A number in its one form."""


def _plain(text: str) -> _Canonical | Decimal:
    """A number as JSON writes it. One without an exponent is in its form but for zeros at its end; others are
    decimals until it is known whether they stay."""
    if len(text) > _MOST_DIGITS or "e" in text or "E" in text:
        return Decimal(text)
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return _Canonical("0" if text == "-0" else text)


_DECODER = json.JSONDecoder(parse_float=_plain, parse_int=_plain, parse_constant=_refuse)


def _number(value: Decimal) -> str:
    if not value:
        return "0"
    if abs(value.adjusted()) > _MOST_DIGITS:
        raise ValueError("a number too long to write out")
    text = format(value, "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def _string(value: str) -> str:
    if "\\" in value or '"' in value:
        value = value.replace("\\", "\\\\").replace('"', '\\"')
    return f'"{value}"'


def _names(node: dict) -> list[str]:
    """Names in UTF-16 order, which for ASCII is their own."""
    if "".join(node).isascii():
        return sorted(node)
    return sorted(node, key=lambda k: k.encode("utf-16-be", "surrogatepass"))


def _render(node) -> str:
    """Keys in UTF-16 order, null fields left out, nulls in arrays kept, one form per number."""
    kind = type(node)
    if kind is str:
        return _string(node)
    if kind is _Canonical:
        return node
    if kind is dict:
        fields = [f"{_string(k)}:{_render(node[k])}" for k in _names(node) if node[k] is not None]
        return "{" + ",".join(fields) + "}"
    if kind is list:
        return "[" + ",".join(map(_render, node)) + "]"
    if kind is Decimal:
        return _number(node)
    return {None: "null", True: "true", False: "false"}[node]


def _token(payload: str | None) -> str | None:
    try:
        node, _ = _DECODER.raw_decode((payload or "").lstrip(" \t\r\n"))
        return hashlib.sha256(_render(node).encode("utf-8", "replace")).hexdigest()
    except (ValueError, ArithmeticError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def _change_token(payloads: pd.Series) -> pd.Series:
    return payloads.map(_token)


def change_token(payload: Column) -> Column:
    """SHA-256 of the canonical form; null for a blank payload or one that is not JSON."""
    return _change_token(payload)
