"""Per-bar feature expressions with the reference's null rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: natural log of 2, as written in the reference's Parkinson formula.
LN2 = 0.6931471805599453


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def null_double() -> Column:
    return F.lit(None).cast("double")


def log_return(close, prev_close) -> Column:
    """ln(close / prev_close); null unless both prices are present and > 0."""
    close, prev_close = _c(close), _c(prev_close)
    return F.when(
        prev_close.isNotNull() & (close > 0) & (prev_close > 0), F.ln(close / prev_close)
    ).otherwise(null_double())


def taker_ratio(taker_buy_quote="taker_buy_quote_asset_volume", quote_volume="quote_asset_volume") -> Column:
    """Taker-buy share of quote volume; 0.0 (not null) when quote volume <= 0 or null."""
    tbq, qv = _c(taker_buy_quote), _c(quote_volume)
    return F.when(qv > 0, tbq / qv).otherwise(F.lit(0.0))


def amihud(log_ret, quote_volume="quote_asset_volume") -> Column:
    """|log return| / quote volume; null when volume <= 0 / null or return null."""
    r, qv = _c(log_ret), _c(quote_volume)
    return F.when((qv > 0) & r.isNotNull(), F.abs(r) / qv).otherwise(null_double())


def zero_volume(volume="volume") -> Column:
    """True when volume is 0 or null; never null."""
    v = _c(volume)
    return F.coalesce(v == 0, F.lit(False)) | v.isNull()


def parkinson(high="high", low="low") -> Column:
    """(1 / (4 ln 2)) * ln(high/low)^2; null unless high > 0, low > 0, high >= low."""
    h, lo = _c(high), _c(low)
    lr = F.ln(h / lo)
    return F.when(
        (h > 0) & (lo > 0) & (h >= lo), (F.lit(1.0) / (F.lit(4.0) * F.lit(LN2))) * (lr * lr)
    ).otherwise(null_double())


def guarded_div(num, den) -> Column:
    """num / den, null when den is 0 or null (no ANSI divide-by-zero error)."""
    return F.try_divide(_c(num), _c(den))
