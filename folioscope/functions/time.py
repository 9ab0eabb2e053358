"""Time expressions that accept timestamps with and without a time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch (zone-less timestamps are read in the session zone)."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))
