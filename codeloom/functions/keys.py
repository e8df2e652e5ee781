"""Normalisation of identifiers and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space at either end.
_EDGES = r"(?U)^\s+|\s+$"


def trimmed(col: Column | str) -> Column:
    """The text without white space (of any script) at either end; null stays null."""
    return F.regexp_replace(F.col(col) if isinstance(col, str) else col, _EDGES, "")


def norm_id(col: Column | str) -> Column:
    """An id as it is compared: trimmed, lower case; null if it is blank."""
    t = F.lower(trimmed(col))
    return F.when(F.length(t) > 0, t)


def micros(col: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone (one with zone is read in the session's)."""
    c = F.col(col) if isinstance(col, str) else col
    c = c.cast("timestamp_ntz")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, c)


def month_of(us: Column) -> Column:
    """`YYYY-MM` of microseconds since 1970."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.date_format(F.timestamp_add("MICROSECOND", us, epoch), "yyyy-MM")
