"""Time differences that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_DAY = 24 * MICROS_PER_HOUR


def micros_between(start: str | Column, end: str | Column) -> Column:
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end))


def hours_between(start: str | Column, end: str | Column) -> Column:
    return micros_between(start, end) / F.lit(float(MICROS_PER_HOUR))


def epoch_micros(at: str | Column) -> Column:
    return micros_between(F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), _col(at).cast("timestamp_ntz"))


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value
