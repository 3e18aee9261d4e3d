"""M2: candles -> per-bar features (log return, taker share, Amihud, Parkinson,
zero-volume flag)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickstat.functions import bars as fb
from tickstat.functions.symbols import base_asset, quote_asset
from tickstat.operators.series import previous_value
from tickstat.schemas import COUNT_COLUMNS, PRICE_COLUMNS, VOLUME_COLUMNS, require_columns

FEATURE_COLUMNS = ("log_return", "taker_ratio", "amihud_illiq", "zero_volume_flag", "parkinson_var_1m")


def normalize_types(df: DataFrame) -> DataFrame:
    """One projection of casts: prices and volumes to double, trade count to long.

    Columns that are absent are skipped (a bar table may lack ``open``)."""
    casts = {c: "double" for c in PRICE_COLUMNS + VOLUME_COLUMNS}
    casts.update({c: "long" for c in COUNT_COLUMNS})
    return df.select(
        *[F.col(c).cast(casts[c]).alias(c) if c in casts else F.col(c) for c in df.columns]
    )


def bar_features(candles: DataFrame, bucket: str = "month") -> DataFrame:
    """Add the five feature columns to every bar.

    Rules (reference semantics): the previous bar is the previous *row* of the
    symbol by ``open_time``; ``log_return`` is null without a previous bar or
    with a price <= 0; ``taker_ratio`` is 0.0 when quote volume is <= 0 or
    null; ``amihud_illiq`` is null when volume <= 0 or the return is null;
    ``parkinson_var_1m`` is null unless high > 0, low > 0 and high >= low;
    ``zero_volume_flag`` is never null.

    One shuffle by (symbol, time bucket) serves the window; the previous-row
    carry across buckets comes from a one-row-per-bucket table.
    """
    require_columns(candles, ["open_time", "symbol", "high", "low", "close", "volume",
                              "quote_asset_volume", "taker_buy_quote_asset_volume"], "candles")
    df = normalize_types(candles)
    # bars made from trades or by resampling have no asset columns: they follow from the symbol
    df = df.withColumns({c: f() for c, f in (("base_asset", base_asset), ("quote_asset", quote_asset)) if c not in df.columns})
    df = previous_value(df, "close", "_prev_close", unit=bucket)
    lr = fb.log_return("close", "_prev_close")
    return (
        df.withColumn("log_return", lr)
        .withColumn("taker_ratio", fb.taker_ratio())
        .withColumn("amihud_illiq", fb.amihud(F.col("log_return")))
        .withColumn("zero_volume_flag", fb.zero_volume())
        .withColumn("parkinson_var_1m", fb.parkinson())
        .drop("_prev_close")
    )


def layout_by_symbol(features: DataFrame, mode: str = "sort") -> DataFrame:
    """Storage layout before a write.

    ``sort`` (default): sort each partition by (symbol, open_time). The
    feature window already hash-partitions rows by (symbol, month), so this
    adds no shuffle; every file holds whole symbol-months in order, and
    Parquet min/max statistics on ``symbol`` let later scans skip row groups.
    ``range``: one more full shuffle to range-partition by (symbol,
    open_time), for files that each cover a contiguous symbol range (a heavy
    symbol is still split over several files)."""
    if mode == "sort":
        return features.sortWithinPartitions("symbol", "open_time")
    if mode == "range":
        return features.repartitionByRange("symbol", "open_time").sortWithinPartitions("symbol", "open_time")
    raise ValueError("mode must be 'sort' or 'range'")
