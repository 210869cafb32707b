"""Size checks that decide between a broadcast and a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a side may have to be sent to every executor.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table has at most this many rows and bytes (as text). Each task stops reading
    once it alone has more rows."""
    width = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    facts = df.limit(rows + 1).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")
    ).first()
    return facts["rows"] <= rows and facts["bytes"] <= size
