"""Hand-made frames, one per rule (null rules, tie-breaks, parameters)."""

import datetime as dt

from pyspark.sql import Row

from tickstat.functions import symbols as sym
from tickstat.operators import beta as B
from tickstat.operators import shock as K
from tickstat.operators import stress as S
from tickstat.operators.features import bar_features

T0 = dt.datetime(2024, 1, 1)
BAR = ("open_time timestamp_ntz, symbol string, base_asset string, quote_asset string, open double, high double, "
       "low double, close double, volume double, quote_asset_volume double, number_of_trades long, "
       "taker_buy_base_asset_volume double, taker_buy_quote_asset_volume double")


def bars(spark, rows):
    full = []
    for r in rows:
        d = dict(open=1.0, high=2.0, low=1.0, close=1.0, volume=1.0, quote_asset_volume=1.0, number_of_trades=1,
                 taker_buy_base_asset_volume=0.5, taker_buy_quote_asset_volume=0.5)
        d.update(r)
        sym_ = d["symbol"]
        d.setdefault("base_asset", sym_.split("-")[0] if sym_ else None)
        d.setdefault("quote_asset", sym_.split("-")[1] if sym_ and "-" in sym_ else None)
        full.append(d)
    cols = [c.split()[0] for c in BAR.split(", ")]
    return spark.createDataFrame([tuple(d.get(c) for c in cols) for d in full], BAR)


def minute(i):
    return T0 + dt.timedelta(minutes=i)


def test_feature_null_rules(spark):
    df = bars(spark, [
        dict(open_time=minute(0), symbol="A-USDT", close=10.0),                      # first bar: no return
        dict(open_time=minute(1), symbol="A-USDT", close=0.0),                       # close 0
        dict(open_time=minute(2), symbol="A-USDT", close=None),                      # null close
        dict(open_time=minute(3), symbol="A-USDT", close=20.0),                      # previous null
        dict(open_time=minute(9), symbol="A-USDT", close=40.0, quote_asset_volume=0.0),   # gap; qv 0
        dict(open_time=minute(10), symbol="A-USDT", close=80.0, quote_asset_volume=None, volume=None),
        dict(open_time=minute(11), symbol="A-USDT", close=80.0, high=1.0, low=2.0),  # high < low
        dict(open_time=minute(12), symbol="A-USDT", close=80.0, low=0.0, volume=0.0),  # low 0, volume 0
    ])
    r = {x.open_time: x for x in bar_features(df).collect()}
    assert r[minute(0)].log_return is None
    assert r[minute(1)].log_return is None
    assert r[minute(3)].log_return is None
    assert abs(r[minute(9)].log_return - 0.6931471805599453) < 1e-15      # previous row, not previous minute
    assert r[minute(9)].taker_ratio == 0.0 and r[minute(9)].amihud_illiq is None
    assert r[minute(10)].taker_ratio == 0.0 and r[minute(10)].zero_volume_flag is True
    assert r[minute(11)].parkinson_var_1m is None
    assert r[minute(12)].parkinson_var_1m is None and r[minute(12)].zero_volume_flag is True
    assert r[minute(3)].zero_volume_flag is False
    assert abs(r[minute(0)].parkinson_var_1m - (1 / (4 * 0.6931471805599453)) * 0.6931471805599453 ** 2) < 1e-15


def test_symbol_parts_and_tiers(spark):
    df = spark.createDataFrame([("BTC-USDT",), ("ABC",), (None,)], "symbol string")
    r = df.select(sym.base_asset().alias("b"), sym.quote_asset().alias("q"),
                  sym.tier(sym.base_asset()).alias("t")).collect()
    assert (r[0].b, r[0].q, r[0].t) == ("BTC", "USDT", "LARGE_CAP")
    assert (r[1].b, r[1].q, r[1].t) == ("ABC", None, "SMALL_CAP")
    assert (r[2].b, r[2].q, r[2].t) == (None, None, "SMALL_CAP")


def test_leveraged_rules_differ(spark):
    names = ["BTCUP-USDT", "ADABULL-USDT", "ETH-UP", "JUP-USDT", "SUPER-USDT", "UPX-USDT", "btcup-usdt", "BTC-USDT"]
    df = spark.createDataFrame([(n,) for n in names], "symbol string")
    r = {x.symbol: (x.rx, x.ct) for x in df.select(
        "symbol", sym.is_leveraged_regex().alias("rx"), sym.is_leveraged_contains().alias("ct")).collect()}
    for n in ("BTCUP-USDT", "ADABULL-USDT", "ETH-UP", "JUP-USDT"):
        assert r[n] == (True, True)
    for n in ("SUPER-USDT", "UPX-USDT", "btcup-usdt"):
        assert r[n] == (False, True)
    assert r["BTC-USDT"] == (False, False)


def test_btc_pick_prefers_usdt_then_symbol(spark):
    df = bar_features(bars(spark, [
        dict(open_time=minute(0), symbol="BTC-EUR", high=3.0),
        dict(open_time=minute(0), symbol="BTC-USDT", high=2.0),
        dict(open_time=minute(1), symbol="BTC-EUR", high=3.0),
        dict(open_time=minute(1), symbol="BTC-BUSD", high=4.0),
    ]))
    r = {x.open_time: x.btc_symbol for x in S.btc_pick(df).collect()}
    assert r == {minute(0): "BTC-USDT", minute(1): "BTC-BUSD"}


def test_no_btc_gives_null_stress(spark):
    df = bar_features(bars(spark, [dict(open_time=minute(i), symbol="ETH-USDT") for i in range(3)]))
    rows = S.stress_compare(df).collect()
    assert len(rows) == 1 and rows[0].is_stress is None and rows[0].tier == "LARGE_CAP"


def test_shock_calendar_one_driver_and_null_trades(spark):
    df = bar_features(bars(spark, [
        dict(open_time=minute(0), symbol="BTC-USDT", number_of_trades=100),
        dict(open_time=minute(1), symbol="BTC-USDT", number_of_trades=None),
        dict(open_time=minute(2), symbol="BTC-USDT", number_of_trades=1),
        dict(open_time=minute(2), symbol="ETH-USDT", number_of_trades=5),
    ]))
    p = K.ShockParams(q=0.5, exact=True)
    cal = {x.open_time: x.any_shock for x in K.shock_calendar(df, p).collect()}
    # BTC threshold = median of (100, 1) = 1 -> minute 0 and 2 shocked; null trades -> 0; ETH alone shocks minute 2
    assert cal == {minute(0): 1, minute(1): 0, minute(2): 1}


def _effects(spark, rows):
    schema = ("symbol string, lag int, vol_on_shock double, vol_on_noshock double, illiq_on_shock double, "
              "illiq_on_noshock double, n_shock_obs long, n_noshock_obs long, delta_vol double, delta_illiq double")
    return spark.createDataFrame(rows, schema)


def test_best_lag_nulls_last_and_ties(spark):
    eff = _effects(spark, [
        ("A-USDT", 5, None, None, None, None, 300, 900, None, None),
        ("A-USDT", 1, None, None, None, None, 300, 900, None, None),
        ("B-USDT", 30, 1.0, 0.0, 1.0, 0.0, 300, 900, 1.0, 1.0),
        ("B-USDT", 15, 1.0, 0.0, 1.0, 0.0, 300, 900, 1.0, 1.0),
        ("B-USDT", 0, 1.0, 0.0, 1.0, 0.0, 300, 900, 0.5, None),
        ("C-USDT", 0, 1.0, 0.0, 1.0, 0.0, 199, 900, 9.0, 9.0),    # below min obs
        ("CUP-USDT", 0, 1.0, 0.0, 1.0, 0.0, 300, 900, 9.0, 9.0),  # leveraged
    ])
    r = {x.symbol: x.lag for x in K.best_lag(eff, "delta_vol", 200).collect()}
    assert r == {"A-USDT": 1, "B-USDT": 15}
    stats, hist = K.lag_summary(eff, 200, exact=True)
    s = {x.metric: x for x in stats.collect()}
    assert s["delta_vol"].n_symbols == 2 and s["delta_vol"].median_lag == 1


def test_lag_min_is_renamed(spark):
    eff = _effects(spark, [("A-USDT", 1, 1.0, 0.0, 1.0, 0.0, 300, 900, 1.0, 1.0)]).withColumnRenamed("lag", "lag_min")
    assert K.best_lag(eff, "delta_vol", 1).columns[1] == "lag"


def test_missing_columns_raise(spark):
    import pytest

    eff = spark.createDataFrame([("A", 1)], "symbol string, lag int")
    with pytest.raises(ValueError, match="lacks the columns"):
        K.best_lag(eff, "delta_vol", 1)


def test_regime_rules(spark):
    d0 = dt.date(2024, 1, 1)
    daily = spark.createDataFrame([
        (d0, 100.0), (d0 + dt.timedelta(days=30), 110.0), (d0 + dt.timedelta(days=31), 100.0),
        (d0 + dt.timedelta(days=61), 87.5), (d0 + dt.timedelta(days=60), 95.0),
    ], "date date, btc_daily_close double")
    r = {x.date: (x.btc_ret_30d, x.regime) for x in B.price_regime(daily).collect()}
    assert r[d0] == (None, "NEUTRAL")                                        # unknown -> NEUTRAL
    assert r[d0 + dt.timedelta(days=30)][1] == "BULL"                         # exactly +0.10
    assert r[d0 + dt.timedelta(days=31)] == (None, "NEUTRAL")                 # no partner 30 days back
    assert r[d0 + dt.timedelta(days=60)][1] == "BEAR"                         # 95/110 - 1 (partner day 30)
    assert r[d0 + dt.timedelta(days=61)] == (-0.125, "BEAR")                  # 87.5/100 - 1 (partner day 31)


def test_zero_variance_and_min_rows(spark):
    rows = [Row(symbol="A-USDT", base_asset="A", quote_asset="USDT", ret=float(i), btc_ret=1.0) for i in range(5)]
    rows += [Row(symbol="B-USDT", base_asset="B", quote_asset="USDT", ret=2.0 * i, btc_ret=float(i)) for i in range(4)]
    df = spark.createDataFrame(rows)
    r = {x.symbol: x for x in B.ols_beta(df, B.KEYS, min_rows=4).collect()}
    assert r["A-USDT"].beta is None and r["A-USDT"].n == 5
    assert abs(r["B-USDT"].beta - 2.0) < 1e-12 and r["B-USDT"].n == 4
    assert set(x.symbol for x in B.ols_beta(df, B.KEYS, min_rows=5).collect()) == {"A-USDT"}


def test_receiver_allow_list_and_alpha(spark):
    df = bar_features(bars(spark, [
        dict(open_time=minute(i), symbol=s, number_of_trades=i, close=1.0 + i)
        for i in range(5) for s in ("BTC-USDT", "ETH-USDT", "A-USDT", "B-USDT")]))
    p = K.ShockParams(q=0.5, min_shock=-1, min_noshock=-1, receivers=("A-USDT",))
    assert {r.symbol for r in K.lag_effects(df, p).collect()} == {"A-USDT"}
    b = B.with_alpha(spark.createDataFrame([(2.0, 1.0, 5.0)], "beta double, mean_x double, mean_y double"))
    assert b.first().alpha == 3.0


def test_asof_join_inclusive_and_gaps(spark):
    from tickstat.operators.ext import asof_join

    left = spark.createDataFrame([("a", minute(0)), ("a", minute(5)), ("a", minute(60 * 24 * 70)), ("b", minute(1))],
                                 "k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", minute(5), 1.0), ("a", minute(3), 0.5), ("c", minute(0), 9.0)],
                                  "k string, rt timestamp_ntz, v double")
    got = {(r.k, r.t): r.v for r in asof_join(left, right, "k", "t", "rt", ["v"]).collect()}
    assert got == {("a", minute(0)): None, ("a", minute(5)): 1.0, ("a", minute(60 * 24 * 70)): 1.0,
                   ("b", minute(1)): None}


def test_approximate_mode_runs_end_to_end(spark, sf_small):
    from tickstat.plans.catalog import features_d

    f = features_d(spark, sf_small)
    p = S.StressParams(exact=False)
    assert len(S.stress_compare(f, p).collect()) >= 1
    assert S.stress_days(f, p).count() > 0
    b = B.regime_betas(f, B.BetaParams(min_rows=10, regime_min=5, exact=False))
    assert B.beta_regime_summary(B.betas_by_regime(b), exact=False).count() >= 1


def test_lag_summary_keeps_empty_metric(spark):
    eff = _effects(spark, [("A-USDT", 1, None, None, None, None, 10, 900, None, None)])
    stats, hist = K.lag_summary(eff, min_shock_obs=200)
    r = {x.metric: x for x in stats.collect()}
    assert r["delta_vol"].n_symbols == 0 and r["delta_vol"].median_lag is None
    assert hist.count() == 0


def test_box_stats_and_quality_in_both_modes(spark, sf_small):
    from tickstat.operators import dist as D
    from tickstat.plans.catalog import features_d

    lab = S.label_stress_minutes(features_d(spark, sf_small), S.StressParams(exact=True))
    for exact in (True, False):
        assert D.box_stats(lab, exact=exact).count() > 0
        assert S.market_quality(lab, ["tier", "is_stress"], exact=exact).count() > 0
