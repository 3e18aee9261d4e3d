"""Trade files: ``BTCUSDT.parquet``, one pair each, time in milliseconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Quote assets that end a pair's name; the longest that fits is taken.
QUOTES = ("USDT", "USDC", "FDUSD", "TUSD", "BUSD", "USD", "EUR", "TRY", "BRL", "BTC", "ETH", "BNB")


def dashed(pair: Column, quotes: Sequence[str] = QUOTES) -> Column:
    """``BTCUSDT`` -> ``BTC-USDT``; a name with a dash, or without a known quote, stays."""
    suffix = "|".join(sorted(quotes, key=len, reverse=True))
    return F.when(pair.contains("-"), pair).otherwise(F.regexp_replace(pair, f"^(.+?)({suffix})$", "$1-$2"))


def normalize_trades(trades: DataFrame, quotes: Sequence[str] = QUOTES) -> DataFrame:
    """Symbols with a dash, prices as doubles, and ``time`` as a timestamp (whole
    numbers are milliseconds since 1970, UTC)."""
    if isinstance(trades.schema["time"].dataType, T.IntegralType):
        trades = trades.withColumn("time", F.timestamp_millis("time").cast("timestamp_ntz"))
    return trades.withColumns({c: F.col(c).cast("double") for c in ("price", "qty", "quote_qty")} | {"symbol": dashed(F.col("symbol"), quotes)})


def read_trades(spark: SparkSession, path: str | Sequence[str], quotes: Sequence[str] = QUOTES) -> DataFrame:
    """Scan a folder (or files) of trades; the pair comes from the file name."""
    df = spark.read.parquet(*([path] if isinstance(path, str) else path))
    name = F.regexp_extract(F.url_decode(F.col("_metadata.file_name")), r"^(.*)\.parquet$", 1)
    return normalize_trades(df.withColumn("symbol", name), quotes)
