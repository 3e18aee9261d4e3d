"""Nulls, zeros and constant series, which the fixtures hardly hold."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from tickstat.operators import dist, ext, stress
from tickstat.operators.features import bar_features
from tickstat.sources.trades import dashed, read_trades

T0 = dt.datetime(2024, 1, 1)


def _bars(spark, rows):
    return spark.createDataFrame([(s, T0 + dt.timedelta(minutes=i), x, y) for s, i, x, y in rows],
                                 "symbol string, open_time timestamp_ntz, number_of_trades long, parkinson_var_1m double")


def test_cross_correlation_uses_complete_pairs(spark):
    x = [1, 5, None, 2, 9, 4]
    y = [0.3, None, 0.1, 0.2, 0.9, 0.5]
    rows = [("BTC-USDT", i, v, 0.0) for i, v in enumerate(x)] + [("A-USDT", i, 1, v) for i, v in enumerate(y)] + [("C-USDT", i, 1, 0.5) for i in range(6)]
    got = {r.symbol: r for r in ext.cross_correlation(_bars(spark, rows), lags=[0]).collect()}
    pairs = [(a, b) for a, b in zip(x, y) if a is not None and b is not None]
    assert got["A-USDT"].n == len(pairs) == 4
    assert math.isclose(got["A-USDT"].corr, np.corrcoef(np.array(pairs).T)[0, 1], rel_tol=1e-12)
    assert got["C-USDT"].corr is None


def test_drawdown_of_zero_prices(spark):
    close = [0.0, 0.0, 2.0, 1.0, None, 0.0]
    frame = spark.createDataFrame([("A", T0 + dt.timedelta(minutes=i), c) for i, c in enumerate(close)], "symbol string, open_time timestamp_ntz, close double")
    got = [(r.drawdown, r.is_drawdown_stress) for r in ext.drawdown(frame, 0.4).orderBy("open_time").collect()]
    assert got == [(None, None), (None, None), (0.0, False), (-0.5, True), (None, None), (-1.0, True)]


def test_each_grain_has_its_own_tiers(spark):
    frame = spark.createDataFrame([("SOL",), ("BTC",), ("JUP",)], "base_asset string")
    p = stress.StressParams()
    minute = {r.base_asset: r.tier for r in stress.with_tier(frame, p.large_caps).collect()}
    day = {r.base_asset: r.tier for r in stress.with_tier(frame, p.day_large_caps).collect()}
    assert minute["SOL"] == minute["BTC"] == day["BTC"] == "LARGE_CAP" and day["SOL"] == minute["JUP"] == "SMALL_CAP"


def test_var_does_not_depend_on_the_unit(spark):
    rng = np.random.default_rng(0)
    y, x = np.cumsum(rng.normal(size=60)) * 0.01, rng.normal(size=60)
    rows = [(f"S{k}", T0 + dt.timedelta(minutes=i), float(y[i] * u), float(x[i] * u)) for k, u in enumerate((1.0, 1e-9)) for i in range(60)]
    frame = spark.createDataFrame(rows, "symbol string, open_time timestamp_ntz, ret double, btc_ret double")
    a, b = ext.var1_irf(frame).orderBy("symbol").collect()
    assert math.isclose(a.a_yy, b.a_yy, rel_tol=1e-6) and math.isclose(a.irf_2, b.irf_2, rel_tol=1e-6)


def test_samples_do_not_depend_on_partitions(spark):
    frame = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 2).cast("string").alias("s"))
    ids = lambda d: sorted(r.k for r in d.collect())
    one = ids(dist.sample_uniform(frame, ["k"], 0.1))
    assert one == ids(dist.sample_uniform(frame.repartition(7), ["k"], 0.1)) and 400 < len(one) < 600
    assert len(ids(dist.sample_uniform(frame, ["k"], 1.0))) == 5000
    capped = ids(dist.sample_uniform(frame, ["k"], 0.1, cap=20))
    assert capped == ids(dist.sample_uniform(frame.repartition(3), ["k"], 0.1, cap=20)) and set(capped) <= set(one)
    strata = ids(dist.sample_stratified(frame, ["k"], ["s"], {"1": 0.2}))
    assert strata and all(k % 2 for k in strata)


def test_trade_files_to_features(spark, tmp_path):
    rows = [(1, 10.0, 1.0, 10.0, 1_700_000_000_123, False, True), (2, 12.0, 2.0, 24.0, 1_700_000_001_000, True, True), (3, 11.0, 1.0, 11.0, 1_700_000_100_000, False, True)]
    frame = spark.createDataFrame(rows, "id long, price double, qty double, quote_qty double, time long, is_buyer_maker boolean, is_best_match boolean")
    for pair in ("BTCUSDT", "ADABTC"):
        frame.toPandas().to_parquet(tmp_path / f"{pair}.parquet")
    got = bar_features(ext.trades_to_bars(read_trades(spark, str(tmp_path)), "1 minute")).orderBy("symbol", "open_time").collect()
    assert [(r.symbol, r.base_asset, r.quote_asset, r.close, r.number_of_trades) for r in got] == [
        ("ADA-BTC", "ADA", "BTC", 12.0, 2), ("ADA-BTC", "ADA", "BTC", 11.0, 1), ("BTC-USDT", "BTC", "USDT", 12.0, 2), ("BTC-USDT", "BTC", "USDT", 11.0, 1)]
    assert got[0].open_time == dt.datetime(2023, 11, 14, 22, 13)
    names = spark.createDataFrame([("ETHUSDT",), ("ETH-USDT",), ("USDT",), ("XYZ",), ("BTCFDUSD",)], "p string").select(dashed(F.col("p")).alias("s"))
    assert [r.s for r in names.collect()] == ["ETH-USDT", "ETH-USDT", "USDT", "XYZ", "BTC-FDUSD"]
