"""Streaming bars over several micro-batches equal the batch bars."""

import tempfile

from pyspark.sql import functions as F

from tickstat.functions.timecols import instant_to_ntz, ntz_to_instant
from tickstat.operators.ext import trades_to_bars
from tickstat.sources.fixtures import event_trades
from tickstat.streaming.bars import latest_bars, run_available_now, stream_event_bars, stream_trades_to_bars


def test_stream_matches_batch_across_batches(spark, sf_small):
    d = tempfile.mkdtemp(prefix="tickstat-stream-", dir="/tmp")
    trades = event_trades(spark, sf_small).withColumn("time", ntz_to_instant("time")).drop("is_best_match")
    # three files whose time ranges cut through hourly windows
    cut1, cut2 = "2024-01-10 00:30:00", "2024-01-20 12:45:00"
    t = F.col("time").cast("string")
    for i, cond in enumerate([t < cut1, (t >= cut1) & (t < cut2), t >= cut2]):
        trades.where(cond).coalesce(1).write.parquet(f"{d}/in/part{i}")
    stream = (spark.readStream.schema(trades.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(f"{d}/in"))
    run_available_now(stream_trades_to_bars(stream, "1 hour", "3 days"), f"{d}/out", f"{d}/ckpt")
    got = latest_bars(spark, f"{d}/out").withColumn("open_time", instant_to_ntz("open_time"))
    want = trades_to_bars(event_trades(spark, sf_small), "1 hour")
    assert spark.read.parquet(f"{d}/out").select("_batch").distinct().count() >= 2
    cols = ["symbol", "open_time", "open", "close", "number_of_trades", "volume"]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())


def test_replay_of_part_files_in_any_order(spark, sf_small):
    """A table stored as unordered part files, several micro-batches: no trade is lost."""
    d = tempfile.mkdtemp(prefix="tickstat-parts-", dir="/tmp")
    spark.read.parquet(f"{sf_small}/events.parquet").repartition(4, "event_id").write.parquet(f"{d}/events.parquet")
    got = stream_event_bars(spark, d, "1 hour", max_files=1)
    want = trades_to_bars(event_trades(spark, sf_small), "1 hour")
    cols = ["symbol", "open_time", "open", "close", "number_of_trades", "volume"]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())
    assert got.agg(F.sum("number_of_trades")).first()[0] == spark.read.parquet(f"{sf_small}/events.parquet").count()
