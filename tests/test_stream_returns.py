"""Log returns of a stream equal those of the batch, whatever the order and cut of the micro-batches."""

import datetime as dt
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickstat.functions.bars import log_return
from tickstat.functions.timecols import ntz_to_instant
from tickstat.operators.series import previous_value
from tickstat.streaming.bars import run_available_now
from tickstat.streaming.returns import latest_returns, merge, replay_returns, stream_returns

BARS = "symbol string, open_time timestamp_ntz, close double"
START = dt.datetime(2024, 1, 30, 12, 0)


def _bars(spark, seed=1, n=400):
    rng = np.random.default_rng(seed)
    rows = []
    for s in ("A-B", "C-D"):
        for m in sorted(rng.choice(60 * 24 * 40, n, replace=False).tolist()):  # over three months
            rows.append((s, START + dt.timedelta(minutes=m), None if rng.random() < 0.1 else float(rng.choice([0.0, -1.0, *rng.uniform(1, 9, 8)]))))
    rows.append(("ONE", dt.datetime(2023, 3, 1), 5.0))
    rows += [("GAP", dt.datetime(2023, 3, 1), 5.0), ("GAP", dt.datetime(2023, 9, 1), 10.0)]
    return spark.createDataFrame(rows, BARS)


def _wanted(bars):
    return sorted((r.symbol, str(r.open_time), r.close or 0.0, r.log_return) if r.log_return is not None else (r.symbol, str(r.open_time), r.close or 0.0, -9.0)
                  for r in previous_value(bars, "close", "p").withColumn("log_return", log_return("close", "p")).collect())


def _got(df):
    return sorted((r.symbol, str(r.open_time), r.close or 0.0, -9.0 if r.log_return is None else r.log_return) for r in df.collect())


@pytest.mark.parametrize("files,each", [(1, None), (4, 1), (5, 2)])
def test_replay_in_any_order_equals_batch(spark, files, each):
    d = tempfile.mkdtemp(prefix="tickstat-returns-", dir="/tmp")
    bars = _bars(spark)
    extra = spark.createDataFrame([(None, START, 1.0), ("A-B", None, 1.0)], BARS)
    bars.unionByName(extra).repartition(files, F.xxhash64("symbol", "open_time")).write.parquet(f"{d}/in")
    got = replay_returns(spark, f"{d}/in", d, each)
    assert got.columns == ["symbol", "open_time", "close", "log_return"]
    assert _got(got) == _wanted(bars)


def test_watermark_keeps_late_bars_within_the_delay(spark):
    """Files nearly in time order: bars up to two days late, an allowed delay of three days."""
    d = tempfile.mkdtemp(prefix="tickstat-returns-", dir="/tmp")
    bars = _bars(spark, 2).where("symbol in ('A-B', 'C-D')").withColumn("open_time", ntz_to_instant("open_time"))
    late = F.xxhash64("symbol", "open_time") % 5 == 0
    cut = F.unix_seconds(F.col("open_time") + F.when(late, F.expr("INTERVAL 2 DAYS")).otherwise(F.expr("INTERVAL 0 DAYS")))
    parts = bars.withColumn("_p", F.floor(cut / (86400 * 8)))
    for i, p in enumerate(sorted(r[0] for r in parts.select("_p").distinct().collect())):
        parts.where(F.col("_p") == p).drop("_p").coalesce(1).write.parquet(f"{d}/in/part{i}")
    stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{d}/in")
    run_available_now(stream_returns(stream, "3 days"), f"{d}/out", f"{d}/ckpt")
    assert spark.read.parquet(f"{d}/out").select("_batch").distinct().count() >= 4
    assert _got(latest_returns(spark, f"{d}/out")) == _wanted(bars)


def test_merge_replaces_equal_times_and_names_successors():
    held = (np.array([10, 20, 30]), np.array([1.0, 2.0, 3.0]), np.array([True, True, True]))
    new = (np.array([25, 20, 25, 5]), np.array([7.0, 8.0, 9.0, 4.0]), np.array([True, True, False, True]))
    (us, close, has), at = merge(held, new)
    assert us.tolist() == [5, 10, 20, 25, 30] and close.tolist() == [4.0, 1.0, 8.0, 9.0, 3.0]
    assert has.tolist() == [True, True, True, False, True] and at.tolist() == [0, 1, 2, 3, 4]
    empty = tuple(a[:0] for a in held)
    assert merge(held, empty)[1].size == 0 and merge(empty, held)[1].tolist() == [0, 1, 2]
