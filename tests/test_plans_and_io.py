"""Physical plan shape, sinks, research jobs and the driver contract."""

import glob
import os
import tempfile

from pyspark.sql import functions as F

from tickstat.operators import shock as K
from tickstat.operators.features import bar_features
from tickstat.plans import research as R
from tickstat.plans.catalog import BETA_TEST, SHOCK_TEST
from tickstat.sources.candles import read_candles, schema_report
from tickstat.sources.fixtures import daily_bars, hourly_bars
from tickstat.sources.sinks import write_csv, write_small


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_window_is_per_symbol_and_bucket(spark, sf_small):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(bar_features(daily_bars(spark, sf_small)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # the big window is keyed by (symbol, bucket); no window over a whole symbol's rows
    assert "hashpartitioning(symbol" in plan and "_bucket" in plan
    assert "SinglePartition" not in plan


def test_lag_effects_scans_features_twice_not_per_lag(spark, sf_small):
    d = tempfile.mkdtemp(prefix="tickstat-test-", dir="/tmp")
    bar_features(hourly_bars(spark, sf_small)).write.parquet(f"{d}/f")
    f = spark.read.parquet(f"{d}/f")
    one = _plan(K.lag_effects(f, SHOCK_TEST)).count("FileScan parquet")
    many = _plan(K.lag_effects_union(f, SHOCK_TEST)).count("FileScan parquet")
    assert one <= 2 < many


def test_sinks_round_trip(spark):
    d = tempfile.mkdtemp(prefix="tickstat-test-", dir="/tmp")
    df = spark.range(10).withColumn("x", F.col("id") * 0.5)
    write_small(df, f"{d}/p")
    assert sorted(spark.read.parquet(f"{d}/p").collect()) == sorted(df.collect())
    write_csv(df, f"{d}/c")
    files = glob.glob(f"{d}/c/*.csv")
    assert len(files) == 1
    assert open(files[0]).readline().strip() == "id,x"


def test_read_candles_symbol_from_file_name(spark, sf_small):
    d = tempfile.mkdtemp(prefix="tickstat-test-", dir="/tmp")
    bars = daily_bars(spark, sf_small)
    import pyarrow as pa
    import pyarrow.parquet as pq

    os.makedirs(f"{d}/raw")
    for s in ("BTC-USDT", "ETH-USDT", "B7-BTC"):
        pdf = bars.where(F.col("symbol") == s).drop("symbol", "base_asset", "quote_asset").toPandas()
        pq.write_table(pa.Table.from_pandas(pdf, preserve_index=False), f"{d}/raw/{s}.parquet",
                       coerce_timestamps="us")
    c = read_candles(spark, f"{d}/raw", schema=None)
    got = {(r.symbol, r.base_asset, r.quote_asset) for r in c.select("symbol", "base_asset", "quote_asset").distinct().collect()}
    assert got == {("BTC-USDT", "BTC", "USDT"), ("ETH-USDT", "ETH", "USDT"), ("B7-BTC", "B7", "BTC")}
    capped = read_candles(spark, f"{d}/raw", schema=None, max_files=2)
    assert {r.symbol for r in capped.select("symbol").distinct().collect()} == {"B7-BTC", "BTC-USDT"}
    assert [r.column for r in schema_report(c).collect()][-3:] == ["symbol", "base_asset", "quote_asset"]


def test_research_jobs_write_outputs(spark, sf_small):
    d = tempfile.mkdtemp(prefix="tickstat-test-", dir="/tmp")
    fd = R.features_job(spark, daily_bars(spark, sf_small), f"{d}/d")
    fe = R.features_job(spark, hourly_bars(spark, sf_small), f"{d}/e")
    R.quality_job(spark, fd, f"{d}/out")
    R.stress_job(spark, fd, f"{d}/out")
    R.shock_job(spark, fe, f"{d}/out", K.ShockParams(q=0.95, unit="hours", min_shock=0, min_noshock=0), 1)
    R.beta_job(spark, fd, f"{d}/out", BETA_TEST)
    for name in ("quality_report", "rq1_compare", "rq1_results", "rq1_plot_table", "rq1_box_stats",
                 "rq2_results/lag_effects", "rq2_results/best_lag_by_vol", "rq2_results/lag_typical_stats",
                 "rq3_results/betas_overall", "rq3_results/beta_pivot", "rq3_results/beta_regime_summary"):
        assert os.path.exists(f"{d}/out/{name}/_SUCCESS"), name
    assert spark.read.parquet(f"{d}/out/rq1_compare").count() == 6


def test_entry_contract(spark):
    import __spark_entry__ as E
    from tickstat.plans.catalog import REGISTRY

    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 6 and set(df.columns) >= {"tier", "is_stress", "median_quote_volume"}
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 45
    assert set(REGISTRY) <= set(qs)


def test_calendar_joins_broadcast_when_small_and_shuffle_beyond(spark, sf_small):
    d = tempfile.mkdtemp(prefix="tickstat-test-", dir="/tmp")
    bar_features(hourly_bars(spark, sf_small)).write.parquet(f"{d}/f")
    f = spark.read.parquet(f"{d}/f")
    small = _plan(K.lag_effects(f, SHOCK_TEST))
    assert "BroadcastHashJoin" in small and "SortMergeJoin" not in small
    big = K.ShockParams(q=0.95, unit="hours", min_shock=40, min_noshock=280, max_broadcast_rows=1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert "SortMergeJoin" in _plan(K.lag_effects(f, big))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_cli_all_jobs_on_candle_files(spark, sf_small):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tickstat.plans.cli import main

    d = tempfile.mkdtemp(prefix="tickstat-cli-", dir="/tmp")
    os.makedirs(f"{d}/raw")
    bars = daily_bars(spark, sf_small).toPandas()
    for sym, g in bars.groupby("symbol"):
        pq.write_table(pa.Table.from_pandas(g.drop(columns=["symbol", "base_asset", "quote_asset"]),
                                            preserve_index=False), f"{d}/raw/{sym}.parquet", coerce_timestamps="us")
    assert main(["all", "--raw", f"{d}/raw", "--out", f"{d}/out", "--shock-q", "0.9", "--min-shock-obs", "1",
                 "--min-rows", "10", "--lags", "0,1,2"], spark=spark) == 0
    f = spark.read.parquet(f"{d}/out/features_1m")
    assert f.count() == len(bars) and f.select("symbol").distinct().count() == bars["symbol"].nunique()
    assert spark.read.parquet(f"{d}/out/rq1_compare").count() >= 2
    assert os.path.exists(f"{d}/out/rq3_results/betas_overall/_SUCCESS")


def test_registered_queries_prune_the_feature_table(spark, sf_small):
    """Filters and columns reach the scan of the shared feature table."""
    from tickstat.plans.catalog import REGISTRY

    for name, columns in (("btc_pick", 4), ("daily_close", 6)):
        plan = REGISTRY[name].build(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
        assert scans and all("PushedFilters: [" in s and "symbol" in s.split("PushedFilters:")[1] for s in scans), name
        assert all(s.split("ReadSchema: struct<")[1].count(":") <= columns for s in scans), name
