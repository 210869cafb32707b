"""Keeping expensive columns from being worked out more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(rows: DataFrame, columns: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """Add columns in one step that later filters stay above.

    A filter on an ordinary computed column is moved below it, which repeats the computation in
    the filter. A generator's output stops that: the struct is built once per row and unpacked.
    """
    built = F.struct(*[column.alias(name) for name, column in columns.items()])
    kept = rows.columns if keep is None else keep
    return rows.select(*kept, F.inline(F.array(built)))
