"""Time expressions that do not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(col: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, read as UTC."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(`{col}` as timestamp_ntz))")


def micros_of_text(text: Column) -> Column:
    """Microseconds since 1970 of ISO text, with or without an offset, or of seconds since 1970; else null."""
    zoned = F.when(text.rlike(r"(?i)(z|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    iso = F.unix_micros(zoned.try_cast("timestamp"))
    number = (text.try_cast("double") * 1_000_000).try_cast("bigint")
    return F.when(text.rlike(r"^\s*-?\d+(\.\d+)?\s*$"), number).otherwise(iso)
