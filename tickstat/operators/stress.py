"""RQ1: liquidity and volatility by tier under market stress (M4-M9)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickstat.functions.symbols import LARGE_CAP_LIST, LARGE_CAP_TWO, tier
from tickstat.operators.joins import MAX_BROADCAST_ROWS, broadcast_if_small
from tickstat.operators.quantiles import quantile_value, quantiles
from tickstat.sources.shared import stored


@dataclass(frozen=True)
class StressParams:
    q: float = 0.95                  # stress percentile of BTC Parkinson variance
    btc_prefix: str = "BTC-"         # minute grain: BTC pairs by symbol prefix
    preferred: str = "BTC-USDT"      # pair preferred when several trade in a minute
    btc_base: str = "BTC"            # day grain: BTC pairs by base asset
    large_caps: tuple = LARGE_CAP_LIST      # tiers of the minute comparison
    day_large_caps: tuple = LARGE_CAP_TWO   # tiers of the stress-day summary
    exact: bool = False              # percentile_approx (as the reference); True = exact selection
    # approximate mode: relative error 1/accuracy, as the reference used per step
    accuracy: int = 10000            # minute stress threshold and market-quality quantiles
    day_accuracy: int = 100          # stress-day threshold (relative error 0.01)
    max_broadcast_rows: int = MAX_BROADCAST_ROWS   # calendar broadcast bound (checked)


def with_tier(df: DataFrame, large_caps: Sequence[str] = LARGE_CAP_TWO, out: str = "tier") -> DataFrame:
    """M4: LARGE_CAP when base_asset is in ``large_caps``, else SMALL_CAP."""
    return df.withColumn(out, tier("base_asset", large_caps))


def btc_pick(features: DataFrame, p: StressParams = StressParams()) -> DataFrame:
    """one BTC bar per minute; the preferred pair first, then by symbol.

    An aggregate (``min_by`` on a (rank, symbol) struct) rather than a window:
    partial aggregation and no sort per minute.
    """
    rank = F.when(F.col("symbol") == p.preferred, F.lit(0)).otherwise(F.lit(1))
    return (
        features.where(F.col("symbol").startswith(p.btc_prefix))
        .groupBy("open_time")
        .agg(F.min_by(F.struct("symbol", "parkinson_var_1m"), F.struct(rank, F.col("symbol"))).alias("_p"))
        .select("open_time", F.col("_p.symbol").alias("btc_symbol"),
                F.col("_p.parkinson_var_1m").alias("btc_parkinson_var_1m"))
    )


def stress_threshold(features: DataFrame, p: StressParams = StressParams()):
    """Q-quantile of the picked BTC Parkinson variance (None without BTC bars)."""
    return quantile_value(btc_pick(features, p), "btc_parkinson_var_1m", p.q, exact=p.exact, accuracy=p.accuracy)


def stress_minutes(features: DataFrame, p: StressParams = StressParams()) -> DataFrame:
    """M5: per minute, the BTC bar and ``is_stress`` = Parkinson >= threshold.

    Null Parkinson or a null threshold (no BTC at all) gives a null flag."""
    pick = stored(btc_pick(features, p), "btc_pick")  # one row per minute, read for the threshold and the flag
    thr = quantile_value(pick, "btc_parkinson_var_1m", p.q, exact=p.exact, accuracy=p.accuracy)
    return pick.withColumn(
        "is_stress", F.col("btc_parkinson_var_1m") >= F.lit(thr).cast("double")
    )


def stress_days(features: DataFrame, p: StressParams = StressParams()) -> DataFrame:
    """M6: daily mean Parkinson of all BTC-base pairs; stress when >= q-quantile
    of the daily means. One row per BTC day with the flag."""
    daily = (
        features.where(F.col("base_asset") == p.btc_base)
        .groupBy(F.to_date("open_time").alias("date"))
        .agg(F.avg("parkinson_var_1m").alias("btc_daily_vol"))
    )
    daily = stored(daily, "btc_days")
    thr = quantile_value(daily, "btc_daily_vol", p.q, exact=p.exact, accuracy=p.day_accuracy)
    return daily.withColumn("is_stress", F.col("btc_daily_vol") >= F.lit(thr).cast("double"))


QUALITY_METRICS = (
    "n_bars", "avg_quote_volume", "median_quote_volume", "avg_amihud", "p95_amihud", "zero_volume_ratio",
    "avg_parkinson_vol", "p95_parkinson_vol", "avg_abs_return",
)


def market_quality(df: DataFrame, keys: Sequence[str], exact: bool = False, accuracy: int = 10000) -> DataFrame:
    """M7: the eight market-quality metrics (plus ``n_bars``) per group.

    Means come from one partial/final aggregate. The three quantiles (median
    quote volume, p95 Amihud, p95 Parkinson) come from one quantile job over
    the three metrics stacked as (metric, value) rows. A null key (unknown
    stress) is its own group; the two small results join null-safely.
    """
    keys = list(keys)
    means = [
        F.count(F.lit(1)).alias("n_bars"),
        F.avg("quote_asset_volume").alias("avg_quote_volume"),
        F.avg("amihud_illiq").alias("avg_amihud"),
        F.avg(F.col("zero_volume_flag").cast("double")).alias("zero_volume_ratio"),
        F.avg("parkinson_var_1m").alias("avg_parkinson_vol"),
        F.avg(F.abs("log_return")).alias("avg_abs_return"),
    ]
    if not exact:
        # sketches are ordinary mergeable aggregates: one pass, one shuffle
        return df.groupBy(*keys).agg(
            *means,
            F.percentile_approx(F.col("quote_asset_volume").cast("double"), 0.5, accuracy).alias("median_quote_volume"),
            F.percentile_approx(F.col("amihud_illiq").cast("double"), 0.95, accuracy).alias("p95_amihud"),
            F.percentile_approx(F.col("parkinson_var_1m").cast("double"), 0.95, accuracy).alias("p95_parkinson_vol"),
        ).select(*keys, *QUALITY_METRICS)
    base = df.groupBy(*keys).agg(*means)
    stacked = df.select(
        *keys,
        F.explode(F.array(
            F.struct(F.lit("qv").alias("m"), F.col("quote_asset_volume").cast("double").alias("v")),
            F.struct(F.lit("amihud").alias("m"), F.col("amihud_illiq").cast("double").alias("v")),
            F.struct(F.lit("parkinson").alias("m"), F.col("parkinson_var_1m").cast("double").alias("v")),
        )).alias("_s"),
    ).select(*keys, F.col("_s.m").alias("_metric"), F.col("_s.v").alias("_value"))
    qs = quantiles(stacked, "_value", {"p50": 0.5, "p95": 0.95}, keys + ["_metric"], "disc", exact, accuracy)
    wide = qs.groupBy(*keys).agg(
        F.max(F.when(F.col("_metric") == "qv", F.col("p50"))).alias("median_quote_volume"),
        F.max(F.when(F.col("_metric") == "amihud", F.col("p95"))).alias("p95_amihud"),
        F.max(F.when(F.col("_metric") == "parkinson", F.col("p95"))).alias("p95_parkinson_vol"),
    )
    if keys:
        # keys renamed on the quantile side: both sides derive from ``df``
        wide = wide.select(*[F.col(k).alias(f"_w_{k}") for k in keys], "median_quote_volume", "p95_amihud",
                           "p95_parkinson_vol")
        cond = [F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in keys]
        out = base.join(wide, cond, "left").drop(*[f"_w_{k}" for k in keys])
    else:
        # no grouping: both sides are one row, fetch the three scalars
        row = wide.first()
        out = base.select("*", *[F.lit(None if row is None else row[c]).cast("double").alias(c)
                                 for c in ("median_quote_volume", "p95_amihud", "p95_parkinson_vol")])
    return out.select(*keys, *QUALITY_METRICS)


def label_stress_minutes(features: DataFrame, p: StressParams = StressParams()) -> DataFrame:
    """Every bar with its tier and the minute's stress flag (left join, so
    bars in minutes without a BTC bar get is_stress = null). The calendar has
    one row per minute; it is broadcast when its row count is under the
    checked bound, so the bar table is not shuffled."""
    flags = broadcast_if_small(stress_minutes(features, p).select("open_time", "is_stress"), p.max_broadcast_rows)
    return with_tier(features, p.large_caps).join(flags, "open_time", "left")


def stress_compare(features: DataFrame, p: StressParams = StressParams()) -> DataFrame:
    """M8: metrics by (tier, is_stress)."""
    return market_quality(label_stress_minutes(features, p), ["tier", "is_stress"], p.exact, p.accuracy)


def label_stress_days(features: DataFrame, p: StressParams = StressParams()) -> DataFrame:
    """Bars on stress days only (semi join on the small day calendar)."""
    days = broadcast_if_small(stress_days(features, p).where(F.col("is_stress")).select("date"),
                              p.max_broadcast_rows)
    return features.withColumn("date", F.to_date("open_time")).join(days, "date", "left_semi")


def stress_day_summary(features: DataFrame, p: StressParams = StressParams()) -> DataFrame:
    """M9: metrics by tier over bars on stress days."""
    return market_quality(with_tier(label_stress_days(features, p), p.day_large_caps), ["tier"], p.exact, p.accuracy)
