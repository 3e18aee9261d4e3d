"""Bar tables derived by Spark from the driver's TPC-H-like tables.

The reference reads exchange candles that are not available here. These
fixtures turn the given tables into bars with the same schema, so every
registered query reads the given data and its work grows with it.

* ``daily_bars`` (fixture D): ``lineitem JOIN part``, one bar per ship date and
  brand; 25 symbols, with BTC/ETH pairs, leveraged-looking names and quotes
  outside the allow-list.
* ``hourly_bars`` (fixture E): ``events`` per hour and event type; 14 symbols.
* ``event_trades``: ``events`` as a trade table (id, price, qty, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickstat.functions.symbols import base_asset, quote_asset

# Fixed values of fixture D (brand number k -> base asset); others get 'B' || k.
BRAND_BASE = {1: "BTC", 2: "ETH", 3: "BTC", 4: "BNB", 5: "XRP", 6: "SOL", 20: "SUPER",
              21: "ADAUP", 22: "ADADOWN", 23: "ETHBULL", 24: "ETHBEAR", 25: "JUP"}
# brand number -> quote asset; others: USDC when k % 3 = 0, else USDT
BRAND_QUOTE = {1: "USDT", 2: "USDT", 3: "EUR", 7: "BTC", 8: "BNB"}
# Fixed values of fixture E: event type -> base asset, user_id % 4 -> quote asset
EVENT_BASE = {"click": "BTC", "view": "ETH", "purchase": "BNB", "signup": "ADA", "error": "XRP"}
EVENT_QUOTE = ("USDT", "USDC", "EUR", "BTC")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(key: Column, mapping: dict, default: Column) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(key == F.lit(k), F.lit(v)) if out is None else out.when(key == F.lit(k), F.lit(v))
    return out.otherwise(default)


def _cents(price: Column) -> Column:
    return F.round(price * 100).cast("long")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture D: one bar per (ship date, brand)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    lines = li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_shipdate").alias("open_time"),
        F.substring("p_brand", 7, 1 << 20).cast("int").alias("k"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("px"),
        F.col("l_returnflag").alias("rf"),
        _cents(F.col("l_extendedprice")).alias("cents"),
    )
    traded = F.col("rf") != "R"
    taker = F.col("rf") == "A"
    bars = lines.groupBy("open_time", "k").agg(
        (F.sum("cents").cast("double") / 100.0 / F.sum("qty")).alias("close"),
        F.max(F.col("px") / F.col("qty")).alias("high"),
        F.min(F.col("px") / F.col("qty")).alias("low"),
        F.sum(F.when(traded, F.col("qty")).otherwise(F.lit(0.0))).alias("volume"),
        (F.sum(F.when(traded, F.col("cents")).otherwise(F.lit(0))).cast("double") / 100.0).alias(
            "quote_asset_volume"
        ),
        F.count(F.lit(1)).alias("number_of_trades"),
        F.sum(F.when(taker, F.col("qty")).otherwise(F.lit(0.0))).alias("taker_buy_base_asset_volume"),
        (F.sum(F.when(taker, F.col("cents")).otherwise(F.lit(0))).cast("double") / 100.0).alias(
            "taker_buy_quote_asset_volume"
        ),
    )
    k = F.col("k")
    base = _case(k, BRAND_BASE, F.concat(F.lit("B"), k.cast("string")))
    quote = _case(k, BRAND_QUOTE, F.when(k % 3 == 0, F.lit("USDC")).otherwise(F.lit("USDT")))
    return bars.select(
        "open_time",
        F.concat(base, F.lit("-"), quote).alias("symbol"),
        base.alias("base_asset"),
        quote.alias("quote_asset"),
        "high", "low", "close", "volume", "quote_asset_volume", "number_of_trades",
        "taker_buy_base_asset_volume", "taker_buy_quote_asset_volume",
    )


def _event_symbol() -> Column:
    et = F.col("event_type")
    base = _case(et, EVENT_BASE, F.lit(None).cast("string"))
    quote = F.when(et.isin("click", "view"), F.lit("USDT")).otherwise(
        F.element_at(F.array(*[F.lit(q) for q in EVENT_QUOTE]), (F.col("user_id") % 4 + 1).cast("int"))
    )
    return F.concat(base, F.lit("-"), quote)


def event_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as trades: id, price, qty, quote_qty, time, maker flag, symbol."""
    return trades_of_events(table(spark, sf_dir, "events"))


def trades_of_events(ev: DataFrame) -> DataFrame:
    """Trades of an ``events`` table or stream."""
    qty = (F.col("user_id") % 10 + 1).cast("double")
    return ev.select(
        _event_symbol().alias("symbol"),
        F.col("event_id").alias("id"),
        F.col("value").alias("price"),
        qty.alias("qty"),
        (F.col("value") * qty).alias("quote_qty"),
        F.col("ts").alias("time"),
        (F.col("user_id") % 2 == 0).alias("is_buyer_maker"),
        F.lit(True).alias("is_best_match"),
    )


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture E: one bar per (hour, symbol) from ``events``."""
    ev = table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value")
    qty = F.col("user_id") % 10 + 1
    qcents = _cents(F.col("value")) * qty
    taker = F.col("user_id") % 2 == 1
    bars = ev.groupBy(
        F.window("ts", "1 hour").start.alias("open_time"), _event_symbol().alias("symbol")
    ).agg(
        F.min_by("value", "ts").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "ts").alias("close"),
        F.sum(qty).cast("double").alias("volume"),
        (F.sum(qcents).cast("double") / 100.0).alias("quote_asset_volume"),
        F.count(F.lit(1)).alias("number_of_trades"),
        F.sum(F.when(taker, qty).otherwise(F.lit(0))).cast("double").alias("taker_buy_base_asset_volume"),
        (F.sum(F.when(taker, qcents).otherwise(F.lit(0))).cast("double") / 100.0).alias(
            "taker_buy_quote_asset_volume"
        ),
    )
    return bars.select(
        "open_time", "symbol", base_asset().alias("base_asset"), quote_asset().alias("quote_asset"),
        "open", "high", "low", "close", "volume", "quote_asset_volume", "number_of_trades",
        "taker_buy_base_asset_volume", "taker_buy_quote_asset_volume",
    )
