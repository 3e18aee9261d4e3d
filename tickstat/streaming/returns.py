"""2.K: log returns of a stream of bars.

``lag`` does not run on a stream, and a late bar changes the return of the bar
after it. The state is kept per (symbol, calendar month), so a symbol with a
third of all bars is spread over its months and a state holds at most the
(time, close) pairs of one month. Each micro-batch merges its bars into
the state and emits, in update mode, the bars it changed: new ones, and the
successor of each. A reader keeps the latest version of a bar and takes the
previous close of a month's first bar from the symbol's earlier months.

With a watermark a state drops the pairs that no bar in time can still precede
(all but the last one at or below the watermark), and goes a day after its month
is over. Bars later than the watermark are dropped, as in any stream. Without
a watermark (a bounded replay in any order) nothing is late.

A bar that comes again replaces the earlier one. A null close is a bar without
a return, and so is its successor; bars without a symbol or a time are left out.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from tickstat.functions.bars import log_return
from tickstat.functions.timecols import instant_to_ntz, ntz_to_instant
from tickstat.operators.joins import broadcast_if_small
from tickstat.schemas import require_columns
from tickstat.streaming.bars import latest_bars, run_available_now

OUT = "symbol string, month string, us long, close double, has boolean, prev double, prev_has boolean, first boolean"
STATE = "us array<long>, close array<double>, has array<boolean>"


def merge(held: tuple, new: tuple) -> tuple[tuple, np.ndarray]:
    """Sorted (us, close, has) arrays, ``new`` replacing equal times, and the places of new bars and their successors."""
    us, close, has = (np.concatenate([a, b]) for a, b in zip(held, new))
    # of equal times the last one in arrival order stays
    order = np.lexsort((np.arange(us.size), us))
    last = np.append(us[order][1:] != us[order][:-1], True)
    kept = order[last]
    fresh = np.isin(us[kept], new[0])
    touched = fresh.copy()
    touched[1:] |= fresh[:-1]
    return (us[kept], close[kept], has[kept]), np.flatnonzero(touched)


def _month_end_ms(month: str) -> int:
    year, m = map(int, month.split("-"))
    end = dt.datetime(year + m // 12, m % 12 + 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=1)
    return int(end.timestamp() * 1000)


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, watermarked: bool) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    held = tuple(np.array(a, t) for a, t in zip(state.get, (np.int64, float, bool))) if state.exists else (np.empty(0, np.int64), np.empty(0), np.empty(0, bool))
    parts = [(f["us"].to_numpy(np.int64), f["close"].to_numpy(float), f["has"].to_numpy(bool)) for f in frames]
    new = tuple(np.concatenate(x) for x in zip(*parts))
    (us, close, has), at = merge(held, new)
    before = np.maximum(at - 1, 0)
    yield pd.DataFrame({"symbol": key[0], "month": key[1], "us": us[at], "close": close[at], "has": has[at],
                        "prev": close[before], "prev_has": has[before] & (at > 0), "first": at == 0})
    keep = 0
    if watermarked:
        now = state.getCurrentWatermarkMs()
        keep = max(int(np.searchsorted(us, now * 1000, side="right")) - 1, 0)
        state.setTimeoutTimestamp(max(_month_end_ms(key[1]), now + 1))
    state.update((us[keep:].tolist(), close[keep:].tolist(), has[keep:].tolist()))


def stream_returns(bars: DataFrame, watermark: str | None = "10 minutes") -> DataFrame:
    """Changed bars of each micro-batch, for ``run_available_now`` or any update sink
    that keeps the latest version of (symbol, open_time). ``open_time`` is an instant."""
    require_columns(bars, ("symbol", "open_time", "close"), "stream_returns")
    if watermark is not None:
        bars = bars.withWatermark("open_time", watermark)
    rows = bars.where("symbol IS NOT NULL AND open_time IS NOT NULL").select(
        "symbol", F.date_format("open_time", "yyyy-MM").alias("month"), "open_time", F.unix_micros("open_time").alias("us"),
        F.coalesce(F.col("close").cast("double"), F.lit(0.0)).alias("close"), F.col("close").isNotNull().alias("has"))
    timeout = GroupStateTimeout.NoTimeout if watermark is None else GroupStateTimeout.EventTimeTimeout
    out = rows.groupBy("symbol", "month").applyInPandasWithState(
        lambda key, frames, state: _update(key, frames, state, watermark is not None), OUT, STATE, "update", timeout)
    return out.select("symbol", "month", F.timestamp_micros("us").alias("open_time"), F.when(F.col("has"), F.col("close")).alias("close"),
                      F.when(F.col("prev_has"), F.col("prev")).alias("prev_close"), "first")


def latest_returns(spark: SparkSession, out: str) -> DataFrame:
    """(symbol, open_time, close, log_return) of the written versions so far.

    The first bar of a month looks back over a table of one row per symbol and month."""
    bars = latest_bars(spark, out)
    months = bars.groupBy("symbol", "month").agg(F.max_by(F.struct("close"), "open_time").alias("_last"))
    carry = months.select("symbol", "month", F.lag("_last").over(Window.partitionBy("symbol").orderBy("month"))["close"].alias("_carry"))
    rows = bars.join(broadcast_if_small(carry), ["symbol", "month"])
    prev = F.when(F.col("first"), F.col("_carry")).otherwise(F.col("prev_close"))
    return rows.withColumn("_prev", prev).select("symbol", "open_time", "close", log_return("close", "_prev").alias("log_return"))


def replay_returns(spark: SparkSession, path: str, base: str, max_files: int | None = None) -> DataFrame:
    """Log returns of a stored folder of bars, replayed as a file stream without a
    watermark in ``max_files`` files a micro-batch (default: all at once).
    Output and checkpoint go under ``base``; ``open_time`` keeps the wall clock."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    bars = reader.parquet(path).withColumn("open_time", ntz_to_instant("open_time"))
    run_available_now(stream_returns(bars, None), f"{base}/out", f"{base}/checkpoint")
    return latest_returns(spark, f"{base}/out").withColumn("open_time", instant_to_ntz("open_time"))
