"""RQ2: lagged event study of trading-intensity shocks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickstat.functions.symbols import is_leveraged_regex
from tickstat.operators.joins import MAX_BROADCAST_ROWS, fits_broadcast
from tickstat.operators.quantiles import quantiles
from tickstat.schemas import LAG_EFFECT_COLUMNS, require_columns
from tickstat.sources.shared import stored

# Fixed values from the reference: driver pairs and the scanned lags (minutes).
DRIVERS = ("BTC-USDT", "ETH-USDT")
LAGS = (0, 1, 5, 15, 30, 60, 120)
UNITS = {"minutes": "MINUTE", "hours": "HOUR", "days": "DAY"}


@dataclass(frozen=True)
class ShockParams:
    drivers: tuple = DRIVERS
    q: float = 0.99              # shock percentile of each driver's trade count
    lags: tuple = LAGS
    unit: str = "minutes"        # unit of ``lags``
    min_shock: int = 50          # keep n_shock_obs > min_shock
    min_noshock: int = 200       # keep n_noshock_obs > min_noshock
    receivers: tuple | None = None  # optional receiver allow-list (drivers are always kept)
    max_broadcast_rows: int = MAX_BROADCAST_ROWS  # shock-calendar broadcast bound (checked)
    exact: bool = False          # approximate quantiles (as the reference); True = exact selection
    accuracy: int = 1000         # approximate mode: relative error 0.001, as in the reference


def shock_thresholds(features: DataFrame, p: ShockParams = ShockParams()) -> DataFrame:
    """One row per driver: q-quantile of its trade count (nulls ignored)."""
    drv = features.where(F.col("symbol").isin(list(p.drivers))).select("symbol", "number_of_trades")
    q = quantiles(drv, "number_of_trades", {"threshold": p.q}, ["symbol"], exact=p.exact, accuracy=p.accuracy)
    return q.select("symbol", F.col("threshold").cast("double").alias("threshold"))


def shock_calendar(features: DataFrame, p: ShockParams = ShockParams()) -> DataFrame:
    """(open_time, any_shock) over minutes with at least one driver bar.

    A driver bar is a shock when trades >= its threshold; null trades and a
    missing driver count as no shock. The reference's full outer join of the
    two drivers is one group-by here (same rows, no outer join). The drivers'
    rows are written once, so the features are read once for the thresholds
    and the calendar."""
    drv = stored(features.where(F.col("symbol").isin(list(p.drivers))).select("open_time", "symbol", "number_of_trades"), "drivers")
    thr = F.broadcast(shock_thresholds(drv, p))  # at most len(p.drivers) rows
    flag = F.coalesce((F.col("number_of_trades") >= F.col("threshold")).cast("int"), F.lit(0))
    return (
        drv.join(thr, "symbol", "left")
        .groupBy("open_time")
        .agg(F.max(flag).alias("any_shock"))
    )


def restrict(features: DataFrame, p: ShockParams) -> DataFrame:
    """C4: keep only the listed receivers plus the drivers (debugging runs)."""
    if not p.receivers:
        return features
    keep = [s.strip() for s in p.receivers if s and s.strip()]
    return features.where(F.col("symbol").isin(keep + list(p.drivers)))


def receivers(features: DataFrame, p: ShockParams) -> DataFrame:
    return restrict(features, p).where(~F.col("symbol").isin(list(p.drivers))).select(
        "symbol", "open_time", "parkinson_var_1m", "amihud_illiq"
    )


def _effects(joined: DataFrame, p: ShockParams) -> DataFrame:
    shock = F.col("any_shock") == 1
    calm = F.col("any_shock") == 0
    out = joined.groupBy("symbol", "lag").agg(
        F.avg(F.when(shock, F.col("parkinson_var_1m"))).alias("vol_on_shock"),
        F.avg(F.when(calm, F.col("parkinson_var_1m"))).alias("vol_on_noshock"),
        F.avg(F.when(shock, F.col("amihud_illiq"))).alias("illiq_on_shock"),
        F.avg(F.when(calm, F.col("amihud_illiq"))).alias("illiq_on_noshock"),
        F.count_if(shock).alias("n_shock_obs"),
        F.count_if(calm).alias("n_noshock_obs"),
    )
    return keep_reliable(out, p)


def keep_reliable(out: DataFrame, p: ShockParams) -> DataFrame:
    """The deltas, and only rows with more than the minimum counts."""
    out = out.withColumn("delta_vol", F.col("vol_on_shock") - F.col("vol_on_noshock")).withColumn(
        "delta_illiq", F.col("illiq_on_shock") - F.col("illiq_on_noshock")
    )
    return out.where((F.col("n_shock_obs") > p.min_shock) & (F.col("n_noshock_obs") > p.min_noshock)).select(
        *LAG_EFFECT_COLUMNS_ORDER
    )


LAG_EFFECT_COLUMNS_ORDER = ("symbol", "lag", "vol_on_shock", "vol_on_noshock", "illiq_on_shock",
                            "illiq_on_noshock", "n_shock_obs", "n_noshock_obs", "delta_vol", "delta_illiq")


def lag_effects(features: DataFrame, p: ShockParams = ShockParams(), calendar: DataFrame | None = None) -> DataFrame:
    """Per (receiver symbol, lag), mean Parkinson / Amihud when the market
    was (not) in shock ``lag`` units earlier, counts, deltas and the
    reliability filter (strict >).

    One pass for all lags (each receiver row is read once, not once per lag).
    When the shock calendar (one row per minute) is under the checked
    broadcast bound, each receiver row is expanded map-side into its lagged
    keys and probes the broadcast calendar: the receivers are never shuffled
    before the partial aggregate. Otherwise the calendar is exploded by lag,
    shifted forward and joined once (one shuffle of the receivers). Receivers
    without a calendar row at t - lag drop out of both sides, as in the
    reference.
    """
    if p.unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}")
    cal = calendar if calendar is not None else stored(shock_calendar(features, p), "calendar")
    lags = F.array(*[F.lit(int(x)) for x in p.lags])
    if fits_broadcast(cal, p.max_broadcast_rows):
        rec = receivers(features, p).select("*", F.explode(lags).alias("lag"))
        rec = rec.withColumn("_t", F.timestamp_add(UNITS[p.unit], -F.col("lag"), F.col("open_time")))
        joined = rec.join(F.broadcast(cal.withColumnRenamed("open_time", "_t")), "_t").drop("_t")
    else:
        shifted = cal.select(F.explode(lags).alias("lag"), "open_time", "any_shock").select(
            "lag", F.timestamp_add(UNITS[p.unit], F.col("lag"), F.col("open_time")).alias("open_time"), "any_shock")
        joined = receivers(features, p).join(shifted, "open_time")
    return _effects(joined, p)


def lag_effects_union(features: DataFrame, p: ShockParams = ShockParams()) -> DataFrame:
    """H1: one shifted calendar per lag, united by name, and one join with the
    receivers. Kept as the cross-check of ``lag_effects``."""
    cal = stored(shock_calendar(features, p), "calendar")
    parts = [cal.select(F.lit(int(lag)).alias("lag"), F.timestamp_add(UNITS[p.unit], F.lit(int(lag)), F.col("open_time")).alias("open_time"), "any_shock") for lag in p.lags]
    shifted = reduce(lambda a, b: a.unionByName(b), parts)
    return _effects(receivers(features, p).join(shifted, "open_time"), p)


def top_by_delta(effects: DataFrame, lag: int = 0, k: int = 20) -> DataFrame:
    """The k strongest volatility responses at one lag (symbol breaks ties)."""
    return (
        effects.where(F.col(_lag_col(effects)) == lag)
        .orderBy(F.col("delta_vol").desc_nulls_last(), F.col("symbol").asc())
        .select("symbol", "delta_vol", "delta_illiq", "n_shock_obs")
        .limit(k)
    )


def top_best_lags(best: DataFrame, metric: str = "delta_vol", k: int = 10) -> DataFrame:
    """The k symbols with the strongest response at their best lag (symbol breaks ties)."""
    return best.orderBy(F.col(f"best_{metric}").desc_nulls_last(), F.col("symbol").asc()).limit(k)


def _lag_col(df: DataFrame) -> str:
    return "lag" if "lag" in df.columns else "lag_min"


def normalize_effects(effects: DataFrame) -> DataFrame:
    """Rename ``lag_min`` to ``lag`` and check the required columns."""
    if "lag" not in effects.columns and "lag_min" in effects.columns:
        effects = effects.withColumnRenamed("lag_min", "lag")
    require_columns(effects, LAG_EFFECT_COLUMNS, "lag_effects")
    return effects


def reliable(effects: DataFrame, min_shock_obs: int = 200, exclude_leveraged: bool = True) -> DataFrame:
    """C12 + C8: n_shock_obs >= min (inclusive), then drop leveraged tokens."""
    df = normalize_effects(effects).where(F.col("n_shock_obs") >= F.lit(min_shock_obs))
    if exclude_leveraged:
        df = df.where(~is_leveraged_regex("symbol"))
    return df


def best_lag(effects: DataFrame, metric: str = "delta_vol", min_shock_obs: int = 200,
             exclude_leveraged: bool = True) -> DataFrame:
    """Per symbol, the lag with the largest ``metric`` (nulls last), the
    earliest lag on ties; the metric is renamed ``best_<metric>``.

    The window holds at most len(lags) rows per symbol."""
    df = reliable(effects, min_shock_obs, exclude_leveraged)
    w = Window.partitionBy("symbol").orderBy(F.col(metric).desc_nulls_last(), F.col("lag").asc())
    return (
        df.withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") == 1)
        .drop("_rn")
        .withColumnRenamed(metric, f"best_{metric}")
    )


def best_metric_view(best_vol: DataFrame, mode: str = "vol") -> DataFrame:
    """One 'best metric' per symbol from the volatility pick.

    ``mode='vol'`` is what the reference computes (always the volatility
    delta); ``mode='abs_max'`` is what its comment intends: whichever of the
    two deltas is larger in absolute value."""
    if mode == "vol":
        metric, name = F.col("best_delta_vol"), F.lit("delta_vol")
    elif mode == "abs_max":
        pick_vol = F.abs("best_delta_vol") >= F.abs("delta_illiq")
        pick_vol = F.coalesce(pick_vol, F.col("delta_illiq").isNull())
        metric = F.when(pick_vol, F.col("best_delta_vol")).otherwise(F.col("delta_illiq"))
        name = F.when(pick_vol, F.lit("delta_vol")).otherwise(F.lit("delta_illiq"))
    else:
        raise ValueError("mode must be 'vol' or 'abs_max'")
    return best_vol.select(
        "symbol", "lag", "best_delta_vol", "delta_illiq", "n_shock_obs", "vol_on_shock", "vol_on_noshock",
        "illiq_on_shock", "illiq_on_noshock", "n_noshock_obs",
        metric.alias("best_metric"), name.alias("best_metric_name"),
    )


def lag_histogram(best: DataFrame, label: str) -> DataFrame:
    """How often each lag is the best one."""
    return best.groupBy("lag").agg(F.count(F.lit(1)).alias("count_symbols")).withColumn("metric", F.lit(label))


def lag_typical_stats(best: DataFrame, label: str, exact: bool = False) -> DataFrame:
    """N, mean, median, p25, p75 of the best lag across symbols."""
    base = best.agg(F.count(F.lit(1)).alias("n_symbols"), F.avg("lag").alias("mean_lag"))
    q = quantiles(best, "lag", {"median_lag": 0.5, "p25_lag": 0.25, "p75_lag": 0.75}, exact=exact).first()
    vals = {k: (None if q is None else q[k]) for k in ("median_lag", "p25_lag", "p75_lag")}
    return base.select(
        F.lit(label).alias("metric"), "n_symbols", "mean_lag",
        *[F.lit(v).cast("int").alias(k) for k, v in vals.items()],
    )


def lag_summary(effects: DataFrame, min_shock_obs: int = 200, exclude_leveraged: bool = True,
                exact: bool = False, accuracy: int = 10000) -> tuple[DataFrame, DataFrame]:
    """(typical-lag stats, lag histogram) for both metrics, each one long
    table (H2, H3). Both best-lag tables are stacked with a metric label, so
    one grouped aggregate and one grouped quantile call serve both metrics."""
    best = None
    for metric in ("delta_vol", "delta_illiq"):
        b = best_lag(effects, metric, min_shock_obs, exclude_leveraged).select(
            F.lit(metric).alias("metric"), "symbol", "lag")
        best = b if best is None else best.unionByName(b)
    metrics = ("delta_vol", "delta_illiq")
    # a global aggregate always yields a row, so a metric without symbols
    # still reports n_symbols = 0
    base = best.agg(*[x for i, m in enumerate(metrics) for x in (
        F.count_if(F.col("metric") == m).alias(f"_n{i}"),
        F.avg(F.when(F.col("metric") == m, F.col("lag"))).alias(f"_m{i}"))]).select(F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(f"_n{i}").alias("n_symbols"), F.col(f"_m{i}").alias("mean_lag"))
            for i, m in enumerate(metrics)])).alias("_s")).select("_s.*")
    q = quantiles(best, "lag", {"median_lag": 0.5, "p25_lag": 0.25, "p75_lag": 0.75}, ["metric"],
                  exact=exact, accuracy=accuracy)
    stats = base.join(q, "metric", "left").select("metric", "n_symbols", "mean_lag", "median_lag", "p25_lag",
                                                  "p75_lag")
    hist = best.groupBy("lag", "metric").agg(F.count(F.lit(1)).alias("count_symbols")).select(
        "lag", "count_symbols", "metric")
    return stats, hist
