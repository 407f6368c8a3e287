"""Times as microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(time: Column | str) -> Column:
    """Microseconds since 1970 of a time without zone; times with one are taken in the session's zone."""
    time = F.col(time) if isinstance(time, str) else time
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time.cast("timestamp_ntz"))
