"""Time arithmetic on wall-clock timestamps, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(col: str) -> Column:
    """Microseconds since 1970-01-01 of a ``timestamp_ntz`` column (no zone conversion)."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, `{col}`)")


def from_micros(col: Column | str) -> Column:
    """``timestamp_ntz`` from microseconds since 1970-01-01 (no zone conversion)."""
    name = col if isinstance(col, str) else None
    if name is not None:
        return F.expr(f"timestampadd(MICROSECOND, `{name}`, {EPOCH})")
    return F.timestamp_add("MICROSECOND", col, F.expr(EPOCH))
