"""Declared schemas of the bar tables (the reference only inferred them)."""

from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

PRICE_COLUMNS = ("open", "high", "low", "close")
VOLUME_COLUMNS = (
    "volume",
    "quote_asset_volume",
    "taker_buy_base_asset_volume",
    "taker_buy_quote_asset_volume",
)
COUNT_COLUMNS = ("number_of_trades",)

# Raw candle as stored, one file per pair named <BASE>-<QUOTE>.parquet (no symbol column).
RAW_CANDLE = StructType(
    [
        StructField("open_time", TimestampNTZType()),
        StructField("open", DoubleType()),
        StructField("high", DoubleType()),
        StructField("low", DoubleType()),
        StructField("close", DoubleType()),
        StructField("volume", DoubleType()),
        StructField("quote_asset_volume", DoubleType()),
        StructField("number_of_trades", LongType()),
        StructField("taker_buy_base_asset_volume", DoubleType()),
        StructField("taker_buy_quote_asset_volume", DoubleType()),
    ]
)

SYMBOL_FIELDS = [
    StructField("symbol", StringType()),
    StructField("base_asset", StringType()),
    StructField("quote_asset", StringType()),
]

FEATURE_FIELDS = [
    StructField("log_return", DoubleType()),
    StructField("taker_ratio", DoubleType()),
    StructField("amihud_illiq", DoubleType()),
    StructField("zero_volume_flag", BooleanType()),
    StructField("parkinson_var_1m", DoubleType()),
]

# Trade-level input declared by the reference's README.
TRADE = StructType(
    [
        StructField("id", LongType()),
        StructField("price", DoubleType()),
        StructField("qty", DoubleType()),
        StructField("quote_qty", DoubleType()),
        StructField("time", TimestampNTZType()),
        StructField("is_buyer_maker", BooleanType()),
        StructField("is_best_match", BooleanType()),
    ]
)

LAG_EFFECT_COLUMNS = (
    "symbol",
    "lag",
    "delta_vol",
    "delta_illiq",
    "vol_on_shock",
    "vol_on_noshock",
    "illiq_on_shock",
    "illiq_on_noshock",
    "n_shock_obs",
    "n_noshock_obs",
)


def require_columns(df, columns, what: str = "input") -> None:
    """Raise ``ValueError`` naming every missing column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}; it has {df.columns}")
