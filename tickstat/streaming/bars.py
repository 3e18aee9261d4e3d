"""Trades arriving as files -> bars, with Structured Streaming.

The aggregation is the batch ``trades_to_bars`` (N1) on an event-time window;
with a watermark, state for closed bars is dropped. Output mode is
``update`` through ``foreachBatch``: every micro-batch appends the bars it
changed, tagged with the batch id, to a Parquet folder; a reader keeps the
latest version of each bar. Unlike append mode this does not hold back the
newest bars until a later trigger, so an ``availableNow`` run ends with every
bar written. Checkpoint and output live in the shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickstat.functions.timecols import instant_to_ntz, ntz_to_instant
from tickstat.operators.ext import bar_aggregates
from tickstat.session import ensure_checkpoint_dir
from tickstat.sources.fixtures import trades_of_events


def stream_trades_to_bars(trades: DataFrame, width: str = "1 minute", watermark: str | None = "10 minutes") -> DataFrame:
    """Streaming bars from a streaming trade DataFrame (event time ``time``).

    A live stream needs a watermark to bound its state, and drops trades that
    come later than it. A bounded replay of stored files, which come in no time
    order, takes ``watermark=None``: no trade is late, and the state holds one
    row per bar of the replay."""
    if watermark is not None:
        trades = trades.withWatermark("time", watermark)
    bars = trades.groupBy("symbol", F.window("time", width).alias("w")).agg(*bar_aggregates())
    return bars.select("symbol", F.col("w.start").alias("open_time"), *[c for c in bars.columns if c not in ("symbol", "w")])


def run_available_now(bars: DataFrame, out: str, checkpoint: str) -> None:
    """Process everything available, append changed bars per batch, stop."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(out)

    q = (bars.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def latest_bars(spark: SparkSession, out: str, schema: StructType | None = None) -> DataFrame:
    """Final bars: the last written version of each (symbol, open_time)."""
    df = spark.read.parquet(out) if schema is None else spark.read.schema(schema).parquet(out)
    cols = [c for c in df.columns if c != "_batch"]
    return (df.groupBy("symbol", "open_time")
            .agg(F.max_by(F.struct(*[c for c in cols if c not in ("symbol", "open_time")]), "_batch").alias("_b"))
            .select("symbol", "open_time", "_b.*"))


def event_trade_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """The ``events`` table (one file or a folder of part files) read as a file
    stream of trades; event time becomes an instant (wall clock read as UTC),
    as watermarks need. ``max_files`` bounds the files of one micro-batch."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # a pattern: it may match a folder or a single file (a plain path must be a folder)
    trades = trades_of_events(reader.parquet(f"{sf_dir.rstrip('/')}/events.parque[t]"))
    return trades.withColumn("time", ntz_to_instant("time")).drop("is_best_match")


def stream_event_bars(spark: SparkSession, sf_dir: str, width: str = "1 hour", max_files: int | None = None) -> DataFrame:
    """Bars of the whole stored table, replayed as a stream without a watermark."""
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/stream-bars-{uuid.uuid4().hex[:12]}"
    run_available_now(stream_trades_to_bars(event_trade_stream(spark, sf_dir, max_files), width, None),
                      f"{base}/out", f"{base}/checkpoint")
    bars = latest_bars(spark, f"{base}/out")
    return bars.withColumn("open_time", instant_to_ntz("open_time"))
