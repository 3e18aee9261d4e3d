"""Extensions declared by the reference's README without code.

Definitions are ours; each is a Spark job over bars or trades, with the same
skew rules as the core (bucketed windows, partial aggregation, small tables
joined back by key).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickstat.functions.bars import guarded_div
from tickstat.functions.symbols import LARGE, LARGE_CAP_TWO, MID, SMALL
from tickstat.operators.joins import broadcast_if_small
from tickstat.operators.quantiles import quantiles
from tickstat.sources.shared import stored
from tickstat.operators.series import last_known, previous_value, previous_values, running_total, trailing_moments


# ------------------------------------------------------------------ N1, N2, N5: bars
def trades_to_bars(trades: DataFrame, width: str = "1 minute") -> DataFrame:
    """Trades (id, price, qty, quote_qty, time, is_buyer_maker, symbol) ->
    candles. Open / close are the first / last trade by (time, id); the buyer
    is the taker when it is not the maker. Every aggregate is partial, so a
    hot (symbol, minute) is folded map-side."""
    return trades.groupBy("symbol", F.window("time", width).start.alias("open_time")).agg(*bar_aggregates())


def bar_aggregates() -> list[Column]:
    """The columns of a bar over the trades of its group (batch and streaming)."""
    order = F.struct("time", "id")
    taker = ~F.col("is_buyer_maker")
    return [
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("qty").alias("volume"),
        F.sum("quote_qty").alias("quote_asset_volume"),
        F.count(F.lit(1)).alias("number_of_trades"),
        F.sum(F.when(taker, F.col("qty")).otherwise(F.lit(0.0))).alias("taker_buy_base_asset_volume"),
        F.sum(F.when(taker, F.col("quote_qty")).otherwise(F.lit(0.0))).alias("taker_buy_quote_asset_volume"),
    ]


def resample(bars: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Coarser bars: first open, max high, min low, last close, sums."""
    sums = [c for c in ("volume", "quote_asset_volume", "number_of_trades", "taker_buy_base_asset_volume",
                        "taker_buy_quote_asset_volume") if c in bars.columns]
    return bars.groupBy("symbol", F.window("open_time", width).start.alias("open_time")).agg(
        F.min_by("open", "open_time").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "open_time").alias("close"),
        *[F.sum(c).alias(c) for c in sums],
    )


def taker_share(trades: DataFrame, width: str = "1 minute") -> DataFrame:
    """Buyer- vs seller-initiated share of volume and of trade count."""
    buy = ~F.col("is_buyer_maker")
    return trades.groupBy("symbol", F.window("time", width).start.alias("open_time")).agg(
        guarded_div(F.sum(F.when(buy, F.col("qty")).otherwise(F.lit(0.0))), F.sum("qty")).alias("buy_volume_share"),
        guarded_div(F.sum(F.when(~buy, F.col("qty")).otherwise(F.lit(0.0))), F.sum("qty")).alias("sell_volume_share"),
        (F.count_if(buy) / F.count(F.lit(1))).alias("buy_trade_share"),
    )


# ------------------------------------------------------------------ N3, N4: tiers and external data
def three_tiers(features: DataFrame, large_caps: Sequence[str] = LARGE_CAP_TWO, mid_max_rank: int = 30,
                size: str = "quote_asset_volume") -> DataFrame:
    """LARGE for listed bases, MID for the next ranks up to ``mid_max_rank``
    by total ``size`` (a market-cap proxy), SMALL otherwise.

    Totals are one row per base asset; the rank runs on that small table."""
    tot = features.groupBy("base_asset").agg(F.sum(size).alias("_size"))
    ranked = tot.select("base_asset", F.row_number().over(
        Window.orderBy(F.col("_size").desc_nulls_last(), F.col("base_asset"))).cast("long").alias("size_rank"))
    tier = (F.when(F.col("base_asset").isin(list(large_caps)), F.lit(LARGE))
            .when(F.col("size_rank") <= mid_max_rank, F.lit(MID)).otherwise(F.lit(SMALL)))
    return features.join(broadcast_if_small(ranked), "base_asset", "left").withColumn("tier3", tier)


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str,
              values: Sequence[str], unit: str = "month") -> DataFrame:
    """Each left row gets ``values`` of the latest right row of the same
    ``key`` with right_time <= left_time (null when none).

    Both sides are unioned -- each left row travels whole as a struct, so no
    row id and no join back are needed -- ordered by (time, right before
    left), and the last known right values are carried forward with
    ``last_known`` (bucketed windows, no per-key task, no candidate pairs)."""
    lcols = left.columns
    packed = F.struct(*[F.col(v) for v in values])
    lrow = F.struct(*[F.col(c) for c in lcols])
    r = right.select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"),
                     packed.alias("_val"), F.lit(None).cast(left.select(lrow.alias("x")).schema["x"].dataType).alias("_row"))
    l_ = left.select(F.col(key).alias("_k"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"),
                     F.lit(None).cast(r.schema["_val"].dataType).alias("_val"), lrow.alias("_row"))
    u = last_known(r.unionByName(l_), "_val", "_asof", key="_k", ts="_t", order="_side", unit=unit)
    return u.where(F.col("_side") == 1).select(*[F.col(f"_row.{c}").alias(c) for c in lcols],
                                               *[F.col(f"_asof.{v}").alias(v) for v in values])


def weekly_snapshots(features: DataFrame, value: str = "quote_asset_volume") -> DataFrame:
    """A snapshot table (base_asset, snap_time, weekly_size) published at the
    end of each week, standing in for an external market-cap source."""
    wk = F.window("open_time", "7 days")
    return features.groupBy("base_asset", wk.end.alias("snap_time")).agg(F.sum(value).alias("weekly_size"))


# ------------------------------------------------------------------ N6, N7, N9, N10, N11: series
def realized_vol(features: DataFrame) -> DataFrame:
    """Per symbol and day: n, realized volatility sqrt(sum r^2), mean |r|."""
    r = F.col("log_return")
    return features.groupBy("symbol", F.to_date("open_time").alias("date")).agg(
        F.count(r).alias("n_returns"),
        F.sqrt(F.sum(r * r)).alias("realized_vol"),
        F.avg(F.abs(r)).alias("abs_return_vol"),
    )


def drawdown(features: DataFrame, threshold: float = 0.2, unit: str = "month") -> DataFrame:
    """Close / running maximum close - 1, and a stress flag when the
    drawdown is <= -threshold. Both are null while the peak is zero."""
    x = running_total(features.select("symbol", "open_time", "close"), "close", "_peak", "max", unit=unit)
    dd = guarded_div(F.col("close"), F.col("_peak")) - F.lit(1.0)
    return x.select("symbol", "open_time", "close", dd.alias("drawdown"),
                    (dd <= F.lit(-threshold)).alias("is_drawdown_stress"))


def rolling_beta(joined: DataFrame, seconds: int, min_n: int = 2, y: str = "ret", x: str = "btc_ret") -> DataFrame:
    """Beta of ``y`` on ``x`` over a trailing time window per symbol, in time
    linear in the rows whatever the window's length (see ``trailing_moments``)."""
    out = trailing_moments(joined.select("symbol", "open_time", y, x), y, x, seconds)
    m = F.col("_m")
    cov, var = F.when(m["n"] > 0, m["c"] / m["n"]), F.when(m["nx"] > 0, m["v"] / m["nx"])
    beta = F.when((m["ny"] >= min_n) & (F.abs(var) > F.lit(1e-18)), cov / var)
    return out.select("symbol", "open_time", m["ny"].cast("bigint").alias("n_window"), beta.alias("rolling_beta"))


def cusum_break(features: DataFrame, symbols: Sequence[str] = ("BTC-USDT", "ETH-USDT"),
                value: str = "number_of_trades", unit: str = "month") -> DataFrame:
    """CUSUM of the de-meaned trade count; the break is the bar with the
    largest |CUSUM| (earliest on ties). Running sums are exact integers and
    CUSUM_k = S_k - k * mean, so the result does not depend on sum order."""
    d = features.where(F.col("symbol").isin(list(symbols)) & F.col(value).isNotNull()).select(
        "symbol", "open_time", F.col(value).cast("long").alias("_x"), F.lit(1).cast("long").alias("_one"))
    d = running_total(d, "_x", "_s", unit=unit)
    d = running_total(d, "_one", "_k", unit=unit)
    tot = d.groupBy("symbol").agg(F.sum("_x").alias("_sum"), F.count(F.lit(1)).alias("n"))
    d = d.join(F.broadcast(tot), "symbol")  # one row per listed symbol
    cus = F.col("_s") - F.col("_k") * (F.col("_sum") / F.col("n"))
    d = d.withColumn("_c", cus)
    best = F.struct(F.abs("_c").alias("a"), (-F.col("_k")).alias("k"))
    return d.groupBy("symbol").agg(
        F.first("n").alias("n"),
        F.max_by(F.struct("open_time", "_c"), best).alias("_b"),
    ).select("symbol", "n", F.col("_b.open_time").alias("break_time"), F.abs("_b._c").alias("max_abs_cusum"))


def intensity_jumps(features: DataFrame, q: float = 0.99, exact: bool = False, unit: str = "month") -> DataFrame:
    """|trades - previous trades| per symbol; a jump when it reaches the
    symbol's q-quantile of such changes."""
    d = previous_value(features.select("symbol", "open_time", "number_of_trades"), "number_of_trades", "_prev",
                       unit=unit)
    d = d.withColumn("trade_jump", F.abs(F.col("number_of_trades") - F.col("_prev"))).drop("_prev")
    thr = quantiles(d, "trade_jump", {"jump_threshold": q}, ["symbol"], exact=exact)
    return d.join(broadcast_if_small(stored(thr, "jump_thresholds")), "symbol", "left").withColumn(
        "is_jump", F.col("trade_jump") >= F.col("jump_threshold"))


# ------------------------------------------------------------------ N13, N14, N8: cross-asset
def cross_correlation(features: DataFrame, driver: str = "BTC-USDT", lags: Sequence[int] = (0, 1, 5, 15, 30, 60),
                      unit: str = "MINUTE", x: str = "number_of_trades", y: str = "parkinson_var_1m") -> DataFrame:
    """corr(driver x at t - lag, receiver y at t) per receiver and lag;
    the driver series is exploded by lag and joined once (as in lag_effects)."""
    drv = features.where(F.col("symbol") == driver).select(
        F.explode(F.array(*[F.lit(int(k)) for k in lags])).alias("lag"), "open_time", F.col(x).cast("double").alias("_x"))
    drv = drv.select("lag", F.timestamp_add(unit, F.col("lag"), F.col("open_time")).alias("open_time"), "_x")
    rec = features.where(F.col("symbol") != driver).select("symbol", "open_time", F.col(y).alias("_y"))
    # moments of complete pairs only: each series is masked where the other is null
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    pairs = rec.join(drv, "open_time").select("symbol", "lag", F.when(both, F.col("_x")).alias("_x"), F.when(both, F.col("_y")).alias("_y"))
    return pairs.groupBy("symbol", "lag").agg(
        F.count("_x").alias("n"),
        # Pearson r from population moments; null (not an ANSI divide error)
        # when either series is constant in the group
        guarded_div(F.covar_pop("_x", "_y"), F.sqrt(F.var_pop("_x") * F.var_pop("_y"))).alias("corr"))


def degradation_ratio(compare: DataFrame,
                      metrics: Sequence[str] = ("median_quote_volume", "zero_volume_ratio", "avg_amihud",
                                                "p95_amihud", "avg_parkinson_vol", "avg_abs_return")) -> DataFrame:
    """Per metric, stress / calm ratio of each tier and the small / large
    ratio of those ratios (is the small tier hit harder?)."""
    def val(tier, state, m):
        return F.max(F.when((F.col("tier") == tier) & (F.col("is_stress") == F.lit(state)), F.col(m)))

    rows = [F.struct(F.lit(m).alias("metric"), guarded_div(val(LARGE, True, m), val(LARGE, False, m)).alias("large_ratio"),
                     guarded_div(val(SMALL, True, m), val(SMALL, False, m)).alias("small_ratio")) for m in metrics]
    out = compare.agg(F.array(*rows).alias("_r")).select(F.explode("_r").alias("_r")).select("_r.*")
    return out.withColumn("small_over_large", guarded_div(F.col("small_ratio"), F.col("large_ratio")))


def var1_irf(joined: DataFrame, horizon: int = 5, min_n: int = 3, y: str = "ret", x: str = "btc_ret",
             unit: str = "month") -> DataFrame:
    """Bivariate VAR(1) of (receiver return y, BTC return x) per symbol,
    from grouped second moments in closed form, and the impulse response of
    y to a unit shock in x for horizons 1..``horizon``.

    z_t = c + A z_{t-1}; each equation is OLS on (y_{t-1}, x_{t-1}). The lags
    are previous rows of the joined series (bucketed, see series.py)."""
    d = previous_values(joined.select("symbol", "open_time", y, x), [y, x], ["_y1", "_x1"], unit=unit).where(
        F.col(y).isNotNull() & F.col(x).isNotNull() & F.col("_y1").isNotNull() & F.col("_x1").isNotNull())
    m = d.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"),
        F.covar_pop("_y1", "_y1").alias("suu"), F.covar_pop("_x1", "_x1").alias("svv"),
        F.covar_pop("_y1", "_x1").alias("suv"),
        F.covar_pop("_y1", y).alias("suy"), F.covar_pop("_x1", y).alias("svy"),
        F.covar_pop("_y1", x).alias("sux"), F.covar_pop("_x1", x).alias("svx"),
    ).where(F.col("n") >= min_n)
    det = F.col("suu") * F.col("svv") - F.col("suv") * F.col("suv")
    # relative to the product of the variances, so independent of the price unit
    ok = F.abs(det) > F.lit(1e-12) * F.col("suu") * F.col("svv")

    def coef(a, b, c, e):  # (a*b - c*e) / det
        return F.when(ok, (F.col(a) * F.col(b) - F.col(c) * F.col(e)) / det)

    m = m.select("symbol", "n",
                 coef("svv", "suy", "suv", "svy").alias("a_yy"), coef("suu", "svy", "suv", "suy").alias("a_yx"),
                 coef("svv", "sux", "suv", "svx").alias("a_xy"), coef("suu", "svx", "suv", "sux").alias("a_xx"))
    # response to a unit shock in x at t=0: r_h = A r_{h-1}, r_0 = (0, 1)
    ry, rx = F.lit(0.0), F.lit(1.0)
    cols = []
    for h in range(1, horizon + 1):
        m = m.withColumn(f"_ry{h}", F.col("a_yy") * ry + F.col("a_yx") * rx).withColumn(
            f"_rx{h}", F.col("a_xy") * ry + F.col("a_xx") * rx)
        ry, rx = F.col(f"_ry{h}"), F.col(f"_rx{h}")
        cols.append(F.col(f"_ry{h}").alias(f"irf_{h}"))
    return m.select("symbol", "n", "a_yy", "a_yx", "a_xy", "a_xx", *cols)
