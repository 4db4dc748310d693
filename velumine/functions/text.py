"""String expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"^[\s\u0085  -    　]+|[\s\u0085  -    　]+$"


def strip(col: Column | str) -> Column:
    """``col`` without surrounding white space of any kind."""
    return F.regexp_replace(F.col(col) if isinstance(col, str) else col, _EDGE, "")


def key(col: Column | str) -> Column:
    """A key without surrounding white space; blank keys are null. Case counts."""
    return F.nullif(strip(col), F.lit(""))


def level(col: Column | str) -> Column:
    """A level or type in its canonical notation: stripped and in lower case."""
    return F.lower(strip(col))
