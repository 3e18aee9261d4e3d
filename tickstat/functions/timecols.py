"""Conversions between wall-clock (timestamp_ntz) and instant (timestamp)
columns that read the wall clock as UTC, whatever the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "1970-01-01 00:00:00"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ntz_to_instant(ts) -> Column:
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), _c(ts)))


def instant_to_ntz(ts) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(_c(ts)), F.lit(_EPOCH).cast("timestamp_ntz"))
