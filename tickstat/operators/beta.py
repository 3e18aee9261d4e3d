"""RQ3: sensitivity (OLS beta) to BTC, overall and by price regime."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickstat.functions.symbols import KEEP_QUOTES, is_leveraged_contains, quote_allowed
from tickstat.operators.joins import MAX_BROADCAST_ROWS, broadcast_if_small
from tickstat.operators.quantiles import quantile_value, quantiles
from tickstat.sources.shared import stored

REGIMES = ("BULL", "BEAR", "NEUTRAL")
BETA_COLS = ("n", "beta", "var_x", "cov_xy", "mean_x", "mean_y")
KEYS = ("symbol", "base_asset", "quote_asset")


@dataclass(frozen=True)
class BetaParams:
    btc_symbol: str = "BTC-USDT"
    keep_quotes: tuple = KEEP_QUOTES
    exclude_btc_quoted: bool = True
    exclude_leveraged: bool = True
    horizon_days: int = 30
    bull: float = 0.10            # BULL when the horizon return >= bull
    bear: float = 0.10            # BEAR when the horizon return <= -bear
    min_rows: int = 50000         # overall betas need n >= min_rows
    regime_floor: int = 1000      # regime betas need n >= max(regime_floor, min_rows // 2)
    regime_min: int | None = None  # explicit regime minimum (overrides the rule above)
    hyper_q: float = 0.95
    var_eps: float = 1e-18        # beta is null when |var_x| <= var_eps
    exact: bool = False           # approximate quantiles (as the reference); True = exact selection
    accuracy: int = 100           # approximate hyper cutoff: relative error 0.01, as in the reference
    summary_accuracy: int = 10000  # approximate regime-summary quantiles
    max_broadcast_rows: int = MAX_BROADCAST_ROWS  # BTC-minute table broadcast bound (checked)

    @property
    def regime_min_rows(self) -> int:
        if self.regime_min is not None:
            return self.regime_min
        return max(self.regime_floor, self.min_rows // 2)


def universe_filter(df: DataFrame, p: BetaParams = BetaParams()) -> DataFrame:
    """Rows with time, symbol and return; allowed quotes; optionally no
    BTC-quoted pairs and no leveraged tokens (upper-cased 'contains' rule)."""
    out = df.where(F.col("open_time").isNotNull() & F.col("symbol").isNotNull() & F.col("log_return").isNotNull())
    out = out.where(quote_allowed("quote_asset", p.keep_quotes))
    if p.exclude_btc_quoted:
        out = out.where(~(F.col("quote_asset") == F.lit("BTC")))
    if p.exclude_leveraged:
        out = out.where(~is_leveraged_contains("symbol"))
    return out


def daily_close(btc: DataFrame, close: str = "close") -> DataFrame:
    """close of the last bar of each day (an aggregate, no sort per day)."""
    return btc.groupBy(F.to_date("open_time").alias("date")).agg(
        F.max_by(close, "open_time").alias("btc_daily_close")
    )


def price_regime(daily: DataFrame, p: BetaParams = BetaParams()) -> DataFrame:
    """BULL / BEAR / NEUTRAL from the return over ``horizon_days``
    calendar days (a date join, not a row lag: a missing day gives null, and
    a null return is NEUTRAL). The day's own last close is used, as in the
    reference (it sees later prices of the same day)."""
    lagged = daily.select(F.date_add("date", p.horizon_days).alias("date"),
                          F.col("btc_daily_close").alias("_lag_close"))
    ret = F.when(F.col("_lag_close").isNotNull() & (F.col("_lag_close") > 0),
                 F.col("btc_daily_close") / F.col("_lag_close") - F.lit(1.0))
    regime = (F.when(F.col("btc_ret_30d") >= F.lit(p.bull), F.lit("BULL"))
              .when(F.col("btc_ret_30d") <= F.lit(-p.bear), F.lit("BEAR"))
              .otherwise(F.lit("NEUTRAL")))
    return (daily.join(lagged, "date", "left")
            .withColumn("btc_ret_30d", ret)
            .withColumn("regime", regime)
            .select("date", "btc_ret_30d", "regime"))


def regime_input(features: DataFrame, p: BetaParams = BetaParams()) -> DataFrame:
    """Receiver returns with the same-minute BTC return and the day's regime.

    The regime is attached to the BTC side first (both small: one row per
    minute / day), so the large receiver table takes part in one join only,
    a broadcast join when the BTC table is under the checked bound."""
    u = universe_filter(features.select("open_time", *KEYS, "close", "log_return"), p)
    btc = u.where(F.col("symbol") == p.btc_symbol).select("open_time", "close", F.col("log_return").alias("btc_ret"))
    regime = price_regime(daily_close(btc), p).select("date", "regime")
    btc_x = btc.withColumn("date", F.to_date("open_time")).join(regime, "date").select("open_time", "btc_ret", "regime")
    receivers = u.where(F.col("symbol") != p.btc_symbol).select("open_time", *KEYS, F.col("log_return").alias("ret"))
    return receivers.join(broadcast_if_small(btc_x, p.max_broadcast_rows), "open_time")


def ols_moments(df: DataFrame, y: str = "ret", x: str = "btc_ret") -> list:
    """E12 aggregates: population moments, so beta = cov / var (= regr_slope)."""
    return [
        F.count(F.lit(1)).alias("n"),
        F.var_pop(x).alias("var_x"),
        F.covar_pop(y, x).alias("cov_xy"),
        F.avg(x).alias("mean_x"),
        F.avg(y).alias("mean_y"),
    ]


def _beta(var_eps: float):
    return F.when(F.abs("var_x") > F.lit(var_eps), F.col("cov_xy") / F.col("var_x"))


def ols_beta(df: DataFrame, keys: Sequence[str], y: str = "ret", x: str = "btc_ret", min_rows: int = 0,
             var_eps: float = 1e-18) -> DataFrame:
    """Beta of ``y`` on ``x`` per group with n >= min_rows."""
    return (df.groupBy(*keys).agg(*ols_moments(df, y, x))
            .where(F.col("n") >= min_rows)
            .withColumn("beta", _beta(var_eps))
            .select(*keys, *BETA_COLS))


def regime_betas(features: DataFrame, p: BetaParams = BetaParams()) -> DataFrame:
    """Overall and per-regime betas in one aggregation (grouping sets).

    ``level`` is 'overall' (regime null) or 'regime'; each level has its own
    minimum rows."""
    j = regime_input(features, p)
    g = j.groupingSets([list(KEYS), list(KEYS) + ["regime"]], *KEYS, "regime").agg(
        *ols_moments(j), F.grouping("regime").alias("_g"))
    level = F.when(F.col("_g") == 1, F.lit("overall")).otherwise(F.lit("regime"))
    need = F.when(F.col("_g") == 1, F.lit(p.min_rows)).otherwise(F.lit(p.regime_min_rows))
    return (g.where(F.col("n") >= need)
            .withColumn("beta", _beta(p.var_eps))
            .select(level.alias("level"), *KEYS, "regime", *BETA_COLS))


def betas_overall(betas: DataFrame) -> DataFrame:
    return betas.where(F.col("level") == "overall").select(*KEYS, *BETA_COLS)


def betas_by_regime(betas: DataFrame) -> DataFrame:
    return betas.where(F.col("level") == "regime").select(*KEYS, "regime", *BETA_COLS)


def beta_pivot(by_regime: DataFrame) -> DataFrame:
    """E15 + B11: regimes to columns and the bear-minus-bull change."""
    wide = by_regime.groupBy(*KEYS).agg(
        *[F.max(F.when(F.col("regime") == r, F.col("beta"))).alias(f"beta_{r.lower()}") for r in REGIMES])
    return wide.withColumn("delta_beta_bear_minus_bull", F.col("beta_bear") - F.col("beta_bull"))


def top_delta_beta(pivot: DataFrame) -> DataFrame:
    """C16 + G1: symbols with both bull and bear betas, largest increase first."""
    return (pivot.where(F.col("beta_bull").isNotNull() & F.col("beta_bear").isNotNull())
            .orderBy(F.col("delta_beta_bear_minus_bull").desc_nulls_last(), F.col("symbol")))


def strongest(betas: DataFrame, by: str, k: int = 15) -> DataFrame:
    """The k rows with the largest ``by`` (symbol breaks ties): hyper-sensitive
    pairs by ``beta``, regime changes by ``delta_beta_bear_minus_bull``."""
    return betas.orderBy(F.col(by).desc_nulls_last(), F.col("symbol")).limit(k)


def hyper_sensitive(overall: DataFrame, p: BetaParams = BetaParams()) -> DataFrame:
    """Overall betas at or above the ``hyper_q`` quantile of all betas."""
    nn = stored(overall.where(F.col("beta").isNotNull()), "betas")  # one row per symbol, read for the cutoff and the list
    cut = quantile_value(nn, "beta", p.hyper_q, exact=p.exact, accuracy=p.accuracy)
    return nn.where(F.col("beta") >= F.lit(cut).cast("double")).orderBy(F.col("beta").desc(), F.col("symbol"))


def beta_regime_summary(by_regime: DataFrame, exact: bool = False, accuracy: int = 10000) -> DataFrame:
    """Per regime, number of symbols and mean / p05 / median / p95 beta."""
    nn = by_regime.where(F.col("beta").isNotNull())
    if not exact:
        return nn.groupBy("regime").agg(
            F.count(F.lit(1)).alias("n_symbols"), F.avg("beta").alias("avg_beta"),
            *[F.percentile_approx("beta", p, accuracy).alias(n)
              for n, p in (("median_beta", 0.5), ("p95_beta", 0.95), ("p05_beta", 0.05))])
    base = nn.groupBy("regime").agg(F.count(F.lit(1)).alias("n_symbols"), F.avg("beta").alias("avg_beta"))
    q = quantiles(nn, "beta", {"median_beta": 0.5, "p95_beta": 0.95, "p05_beta": 0.05}, ["regime"],
                  exact=exact, accuracy=accuracy)
    return base.join(q, "regime", "left").select("regime", "n_symbols", "avg_beta", "median_beta", "p95_beta",
                                                 "p05_beta")


def with_alpha(betas: DataFrame) -> DataFrame:
    """The intercept the reference's model has but never outputs:
    alpha = mean_y - beta * mean_x (an extra column, our own op only)."""
    return betas.withColumn("alpha", F.col("mean_y") - F.col("beta") * F.col("mean_x"))
