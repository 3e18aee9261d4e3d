"""Symbol parsing, tier labels and token-class predicates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values from the reference (must match for equal results):
# two-asset large-cap tier
LARGE_CAP_TWO = ("BTC", "ETH")
# configurable large-cap list, default order as given
LARGE_CAP_LIST = (
    "BTC", "ETH", "BNB", "XRP", "SOL", "ADA", "DOGE", "TRX", "DOT", "MATIC", "LTC", "LINK", "AVAX", "ATOM",
)
# leveraged-token markers and the suffix pattern built from them
LEVERAGED_MARKERS = ("UP", "DOWN", "BULL", "BEAR")
LEVERAGED_REGEX = r"(UP|DOWN|BULL|BEAR)(-|$)"
# quote assets kept for the beta study
KEEP_QUOTES = ("USDT", "USDC", "USD", "EUR")
# tier labels
LARGE, MID, SMALL = "LARGE_CAP", "MID_CAP", "SMALL_CAP"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _clean(values: Iterable[str]) -> list[str]:
    return [v.strip() for v in values if v and v.strip()]


def base_asset(symbol="symbol") -> Column:
    """Part before the first '-' (the whole name when there is no dash)."""
    return F.nullif(F.split_part(_c(symbol), F.lit("-"), F.lit(1)), F.lit(""))


def quote_asset(symbol="symbol") -> Column:
    """Part after the first '-'; null for a dash-less name (no ANSI index error)."""
    return F.nullif(F.split_part(_c(symbol), F.lit("-"), F.lit(2)), F.lit(""))


def tier(base="base_asset", large_caps: Iterable[str] = LARGE_CAP_TWO) -> Column:
    """LARGE_CAP when the base asset is listed, else SMALL_CAP (null base too)."""
    return F.when(_c(base).isin(_clean(large_caps)), F.lit(LARGE)).otherwise(F.lit(SMALL))


def is_leveraged_regex(symbol="symbol") -> Column:
    """Case-sensitive marker right before '-' or at the end."""
    return _c(symbol).rlike(LEVERAGED_REGEX)


def is_leveraged_contains(symbol="symbol") -> Column:
    """Upper-cased symbol contains any marker anywhere."""
    u = F.upper(_c(symbol))
    out = None
    for m in LEVERAGED_MARKERS:
        out = u.contains(m) if out is None else (out | u.contains(m))
    return out


def quote_allowed(quote="quote_asset", allowed: Iterable[str] = KEEP_QUOTES) -> Column:
    return _c(quote).isin(_clean(allowed))
