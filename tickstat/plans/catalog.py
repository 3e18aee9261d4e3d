"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)``, reads the driver tables (or fixtures
that Spark derives from them) and returns a DataFrame whose double columns are
rounded canonically, like the oracle's.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickstat.functions.canon import canon
from tickstat.session import ensure_checkpoint_dir
from tickstat.operators.features import bar_features, layout_by_symbol
from tickstat.operators.tiers import ranked_tiers, ranks_of
from tickstat.plans import oracle as O
from tickstat.sources.fixtures import BRAND_BASE, daily_bars, hourly_bars
from tickstat.sources.marketcap import read_market_caps, write_market_caps
from tickstat.sources.sinks import write_csv, write_small, write_table

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Builder
    sql: str | None
    note: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None, note: str = ""):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = Query(lambda spark, sf_dir: canon(fn(spark, str(sf_dir).rstrip("/"))), sql, note)
        return fn

    return deco


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of a table that several jobs of one query read.

    One Parquet table in the shared folder (``spark.checkpoint.dir``): later
    jobs read the columns and rows they need from it instead of recomputing the
    fixture and its window, and a lost executor does not force recomputation
    from the raw tables."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/features-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def features_d(spark, sf_dir):
    return materialize(bar_features(daily_bars(spark, sf_dir)))


def features_e(spark, sf_dir):
    return materialize(bar_features(hourly_bars(spark, sf_dir)))


BAR_D_DOUBLES = ("high", "low", "close", "volume", "quote_asset_volume", "taker_buy_base_asset_volume",
                 "taker_buy_quote_asset_volume")
BAR_E_DOUBLES = ("open",) + BAR_D_DOUBLES
BAR_D_COLS = [c.strip() for c in O.BAR_COLS.split(",")]
BAR_E_COLS = BAR_D_COLS[:4] + ["open"] + BAR_D_COLS[4:]
FEAT_COLS = [c.strip() for c in O.FEATURE_COLS.split(",")]
FEAT_DOUBLES = ("log_return", "taker_ratio", "amihud_illiq", "parkinson_var_1m")


# ---------------------------------------------------------------- step 1-2: inputs
@register("candles_daily", O.final(O.with_ctes(O.BARS_D) + " SELECT * FROM bars_d", BAR_D_COLS, BAR_D_DOUBLES))
def q_candles_daily(spark, sf_dir):
    return daily_bars(spark, sf_dir)


@register("candles_hourly", O.final(O.with_ctes(O.BARS_E) + " SELECT * FROM bars_e", BAR_E_COLS, BAR_E_DOUBLES))
def q_candles_hourly(spark, sf_dir):
    return hourly_bars(spark, sf_dir)


# ---------------------------------------------------------------- step 3: features
def _one_feature(name: str, col: str, dbl: bool):
    sql = O.final(
        O.with_ctes(O.BARS_D, O.features("bars_d", "feat_d")) + f" SELECT symbol, open_time, {col} FROM feat_d",
        ["symbol", "open_time", col], [col] if dbl else [],
    )

    @register(name, sql)
    def _q(spark, sf_dir):
        return features_d(spark, sf_dir).select("symbol", "open_time", col)

    return _q


_one_feature("log_return", "log_return", True)
_one_feature("taker_ratio", "taker_ratio", True)
_one_feature("amihud", "amihud_illiq", True)
_one_feature("parkinson", "parkinson_var_1m", True)
_one_feature("zero_volume", "zero_volume_flag", False)


@register(
    "bar_features",
    O.final(O.with_ctes(O.BARS_E, O.features("bars_e", "feat_e")) + " SELECT * FROM feat_e",
            BAR_E_COLS + FEAT_COLS, BAR_E_DOUBLES + FEAT_DOUBLES),
)
def q_bar_features(spark, sf_dir):
    return features_e(spark, sf_dir)


# ---------------------------------------------------------------- step 2: symbols
from tickstat.functions.symbols import LARGE_CAP_LIST, base_asset, quote_asset  # noqa: E402
from tickstat.sources.candles import read_candles  # noqa: E402


@register(
    "symbol_from_file",
    """SELECT 'region' AS symbol, 'region' AS base_asset, CAST(NULL AS VARCHAR) AS quote_asset, count(*) AS n_rows
       FROM region
       UNION ALL
       SELECT 'nation', 'nation', CAST(NULL AS VARCHAR), count(*) FROM nation""",
)
def q_symbol_from_file(spark, sf_dir):
    df = read_candles(spark, [f"{sf_dir}/region.parquet", f"{sf_dir}/nation.parquet"], schema=None)
    return df.groupBy("symbol", "base_asset", "quote_asset").agg(F.count(F.lit(1)).alias("n_rows"))


@register(
    "symbol_parts",
    O.with_ctes(O.BARS_D, O.BARS_E)
    + """ SELECT symbol, NULLIF(split_part(symbol, '-', 1), '') AS base_asset,
               NULLIF(split_part(symbol, '-', 2), '') AS quote_asset, count(*) AS n_bars
        FROM (SELECT symbol FROM bars_d UNION ALL SELECT symbol FROM bars_e) AS s GROUP BY symbol""",
)
def q_symbol_parts(spark, sf_dir):
    syms = daily_bars(spark, sf_dir).select("symbol").unionByName(hourly_bars(spark, sf_dir).select("symbol"))
    return syms.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars")).select(
        "symbol", base_asset().alias("base_asset"), quote_asset().alias("quote_asset"), "n_bars")


# ---------------------------------------------------------------- step 4: quality
from tickstat.operators.quality import quality_report  # noqa: E402

_FD = O.with_ctes(O.BARS_D, O.features("bars_d", "feat_d"))
_QC_N_COLS = len(BAR_D_COLS) + len(FEAT_COLS)


@register(
    "qc_coverage",
    _FD + f""" SELECT count(*) AS n_rows, {_QC_N_COLS} AS n_columns, min(open_time) AS min_open_time,
      max(open_time) AS max_open_time, count(DISTINCT symbol) AS n_symbols,
      count(DISTINCT base_asset) AS n_base_assets FROM feat_d""",
)
def q_qc_coverage(spark, sf_dir):
    return quality_report(features_d(spark, sf_dir)).select(
        "n_rows", "n_columns", "min_open_time", "max_open_time", "n_symbols", "n_base_assets")


_NULL_RATES = ["log_return_null_rate", "amihud_illiq_null_rate", "parkinson_var_1m_null_rate", "taker_ratio_null_rate"]


@register(
    "qc_null_rates",
    O.final(_FD + " SELECT " + ", ".join(
        f"CAST(count(*) FILTER (WHERE {c[:-10]} IS NULL) AS DOUBLE) / count(*) AS {c}" for c in _NULL_RATES)
        + " FROM feat_d", _NULL_RATES, _NULL_RATES),
)
def q_qc_null_rates(spark, sf_dir):
    return quality_report(features_d(spark, sf_dir)).select(*_NULL_RATES)


@register(
    "qc_zero_rate",
    O.final(_FD + """ SELECT CAST(count(*) FILTER (WHERE zero_volume_flag) AS DOUBLE) / count(*) AS zero_volume_rate
        FROM feat_d""", ["zero_volume_rate"], ["zero_volume_rate"]),
)
def q_qc_zero_rate(spark, sf_dir):
    return quality_report(features_d(spark, sf_dir)).select("zero_volume_rate")


@register(
    "qc_duplicates",
    O.with_ctes(O.BARS_E) + """ SELECT count(*) AS dup_keys, count(*) = 0 AS passed FROM (
        SELECT base_asset AS symbol, open_time FROM bars_e GROUP BY 1, 2 HAVING count(*) > 1) AS d""",
)
def q_qc_duplicates(spark, sf_dir):
    # keyed by base asset, hourly bars of one base collide across quotes
    bars = hourly_bars(spark, sf_dir)
    feats = bar_features(bars.withColumn("symbol", F.col("base_asset")))
    return quality_report(feats).select("dup_keys", "passed")


# ---------------------------------------------------------------- step 5: stress
from tickstat.operators import stress as S  # noqa: E402

# Registered queries use exact quantiles so that DuckDB's quantile_disc can check them.
STRESS_TEST = S.StressParams(exact=True)


@register(
    "tier_two",
    O.with_ctes(O.BARS_D) + f" SELECT DISTINCT symbol, base_asset, {O.tier_case()} AS tier FROM bars_d",
)
def q_tier_two(spark, sf_dir):
    return S.with_tier(daily_bars(spark, sf_dir)).select("symbol", "base_asset", "tier").distinct()


@register(
    "tier_list",
    O.with_ctes(O.BARS_D) + f" SELECT DISTINCT symbol, base_asset, {O.tier_case('base_asset', LARGE_CAP_LIST)} AS tier FROM bars_d",
)
def q_tier_list(spark, sf_dir):
    return S.with_tier(daily_bars(spark, sf_dir), LARGE_CAP_LIST).select("symbol", "base_asset", "tier").distinct()


_FDS = O.with_ctes(O.BARS_D, O.features("bars_d", "feat_d"), O.stress_minutes_ctes())


@register("btc_pick", O.final(_FDS + " SELECT open_time, btc_symbol, btc_parkinson_var_1m FROM pick",
                              ["open_time", "btc_symbol", "btc_parkinson_var_1m"], ["btc_parkinson_var_1m"]))
def q_btc_pick(spark, sf_dir):
    return S.btc_pick(features_d(spark, sf_dir))


@register("stress_threshold", O.final(_FDS + " SELECT threshold FROM thr", ["threshold"], ["threshold"]))
def q_stress_threshold(spark, sf_dir):
    thr = S.stress_threshold(features_d(spark, sf_dir), STRESS_TEST)
    return spark.range(1).select(F.lit(thr).cast("double").alias("threshold"))


@register("stress_minutes", O.final(_FDS + " SELECT * FROM sm",
                                    ["open_time", "btc_symbol", "btc_parkinson_var_1m", "is_stress"],
                                    ["btc_parkinson_var_1m"]))
def q_stress_minutes(spark, sf_dir):
    return S.stress_minutes(features_d(spark, sf_dir), STRESS_TEST)


_FDD = O.with_ctes(O.BARS_D, O.features("bars_d", "feat_d"), O.stress_days_ctes())


@register("stress_days", O.final(_FDD + " SELECT * FROM sdays", ["date", "btc_daily_vol", "is_stress"],
                                 ["btc_daily_vol"]))
def q_stress_days(spark, sf_dir):
    return S.stress_days(features_d(spark, sf_dir), STRESS_TEST)


_QD = [c for c in O.QUALITY_COLS if c != "n_bars"]


@register(
    "stress_compare",
    O.final(_FDS + f""",
lab AS (SELECT f.*, {O.tier_case('base_asset', LARGE_CAP_LIST)} AS tier, sm.is_stress FROM feat_d f LEFT JOIN sm ON f.open_time = sm.open_time)
SELECT tier, is_stress, {O.QUALITY_SQL} FROM lab GROUP BY tier, is_stress""",
            ["tier", "is_stress"] + O.QUALITY_COLS, _QD),
)
def q_stress_compare(spark, sf_dir):
    return S.stress_compare(features_d(spark, sf_dir), STRESS_TEST)


@register(
    "stress_day_summary",
    O.final(_FDD + f""",
lab AS (SELECT f.*, {O.tier_case()} AS tier FROM feat_d f
        WHERE CAST(f.open_time AS DATE) IN (SELECT date FROM sdays WHERE is_stress))
SELECT tier, {O.QUALITY_SQL} FROM lab GROUP BY tier""",
            ["tier"] + O.QUALITY_COLS, _QD),
)
def q_stress_day_summary(spark, sf_dir):
    return S.stress_day_summary(features_d(spark, sf_dir), STRESS_TEST)


# ---------------------------------------------------------------- step 6-7: shocks and lags
from tickstat.operators import shock as K  # noqa: E402
from tickstat.operators.lagscan import lag_scan  # noqa: E402

# Test parameters (FIXTURES.md section 5): the reference's lags, read as hours on
# the hourly fixture; q 0.95; reliability 40 / 280; minimum shock observations 45.
SHOCK_TEST = K.ShockParams(q=0.95, unit="hours", min_shock=40, min_noshock=280, exact=True)
MIN_OBS_TEST = 45

_FE = O.with_ctes(O.BARS_E, O.features("bars_e", "feat_e"), O.shock_ctes())
_BEST = [O.EFFECT_COLS[0], O.EFFECT_COLS[1]]


@register("shock_thresholds", O.final(_FE + " SELECT symbol, threshold FROM sthr", ["symbol", "threshold"],
                                      ["threshold"]))
def q_shock_thresholds(spark, sf_dir):
    return K.shock_thresholds(features_e(spark, sf_dir), SHOCK_TEST)


@register("shock_calendar", _FE + " SELECT open_time, any_shock FROM cal")
def q_shock_calendar(spark, sf_dir):
    return K.shock_calendar(features_e(spark, sf_dir), SHOCK_TEST)


@register("lag_effects", O.final(_FE + " SELECT * FROM eff", O.EFFECT_COLS, O.EFFECT_DOUBLES))
def q_lag_effects(spark, sf_dir):
    return K.lag_effects(features_e(spark, sf_dir), SHOCK_TEST)


@register("lag_effects_union", O.final(_FE + " SELECT * FROM eff", O.EFFECT_COLS, O.EFFECT_DOUBLES))
def q_lag_effects_union(spark, sf_dir):
    return K.lag_effects_union(features_e(spark, sf_dir), SHOCK_TEST)


_ALL_LAGS = tuple(range(121))


@register("lag_effects_all", O.final(O.with_ctes(O.BARS_E, O.features("bars_e", "feat_e"), O.shock_ctes(lags=_ALL_LAGS)) + " SELECT * FROM eff",
                                     O.EFFECT_COLS, O.EFFECT_DOUBLES))
def q_lag_effects_all(spark, sf_dir):
    """Every lag from 0 to the maximum, not the seven of the standard study."""
    return lag_scan(features_e(spark, sf_dir), replace(SHOCK_TEST, lags=_ALL_LAGS))


@register("lag0_topk", O.final(_FE + """ SELECT symbol, delta_vol, delta_illiq, n_shock_obs FROM eff
    WHERE lag = 0 ORDER BY delta_vol DESC NULLS LAST, symbol ASC LIMIT 20""",
                               ["symbol", "delta_vol", "delta_illiq", "n_shock_obs"], ["delta_vol", "delta_illiq"]))
def q_lag0_topk(spark, sf_dir):
    return K.top_by_delta(K.lag_effects(features_e(spark, sf_dir), SHOCK_TEST), lag=0, k=20)


def _effects_e(spark, sf_dir):
    return K.lag_effects(features_e(spark, sf_dir), SHOCK_TEST)


_FEB = _FE + "," + O.best_ctes(MIN_OBS_TEST)


def _best_cols(metric: str):
    cols = [c if c != metric else f"best_{metric}" for c in O.EFFECT_COLS]
    dbl = [c if c != metric else f"best_{metric}" for c in O.EFFECT_DOUBLES]
    rename = ", ".join(c if c != f"best_{metric}" else f"{metric} AS best_{metric}" for c in cols)
    return cols, dbl, rename


for _m, _name in (("delta_vol", "best_lag_vol"), ("delta_illiq", "best_lag_illiq")):
    _cols, _dbl, _sel = _best_cols(_m)

    def _mk(metric=_m):
        def _q(spark, sf_dir):
            return K.best_lag(_effects_e(spark, sf_dir), metric, MIN_OBS_TEST)
        return _q

    register(_name, O.final(_FEB + f" SELECT {_sel} FROM best_{_m}", _cols, _dbl))(_mk())

_BMV_COLS = ["symbol", "lag", "best_delta_vol", "delta_illiq", "n_shock_obs", "vol_on_shock", "vol_on_noshock",
             "illiq_on_shock", "illiq_on_noshock", "n_noshock_obs", "best_metric", "best_metric_name"]
_BMV_DBL = ["best_delta_vol", "delta_illiq", "vol_on_shock", "vol_on_noshock", "illiq_on_shock",
            "illiq_on_noshock", "best_metric"]


@register("best_metric_view", O.final(_FEB + """ SELECT symbol, lag, delta_vol AS best_delta_vol, delta_illiq,
    n_shock_obs, vol_on_shock, vol_on_noshock, illiq_on_shock, illiq_on_noshock, n_noshock_obs,
    delta_vol AS best_metric, 'delta_vol' AS best_metric_name FROM best_delta_vol""", _BMV_COLS, _BMV_DBL))
def q_best_metric_view(spark, sf_dir):
    return K.best_metric_view(K.best_lag(_effects_e(spark, sf_dir), "delta_vol", MIN_OBS_TEST))


@register("best_metric_absmax", O.final(_FEB + """, bm AS (SELECT *,
      COALESCE(abs(delta_vol) >= abs(delta_illiq), delta_illiq IS NULL) AS pv FROM best_delta_vol)
    SELECT symbol, lag, delta_vol AS best_delta_vol, delta_illiq,
    n_shock_obs, vol_on_shock, vol_on_noshock, illiq_on_shock, illiq_on_noshock, n_noshock_obs,
    CASE WHEN pv THEN delta_vol ELSE delta_illiq END AS best_metric,
    CASE WHEN pv THEN 'delta_vol' ELSE 'delta_illiq' END AS best_metric_name FROM bm""", _BMV_COLS, _BMV_DBL))
def q_best_metric_absmax(spark, sf_dir):
    return K.best_metric_view(K.best_lag(_effects_e(spark, sf_dir), "delta_vol", MIN_OBS_TEST), "abs_max")


@register("lag_stats", O.final(_FEB + """ SELECT 'delta_vol' AS metric, count(*) AS n_symbols, avg(lag) AS mean_lag,
      quantile_disc(lag, 0.5) AS median_lag, quantile_disc(lag, 0.25) AS p25_lag, quantile_disc(lag, 0.75) AS p75_lag
    FROM best_delta_vol
    UNION ALL
    SELECT 'delta_illiq', count(*), avg(lag), quantile_disc(lag, 0.5), quantile_disc(lag, 0.25), quantile_disc(lag, 0.75)
    FROM best_delta_illiq""", ["metric", "n_symbols", "mean_lag", "median_lag", "p25_lag", "p75_lag"], ["mean_lag"]))
def q_lag_stats(spark, sf_dir):
    return K.lag_summary(_effects_e(spark, sf_dir), MIN_OBS_TEST, exact=True)[0]


@register("lag_hist", _FEB + """ SELECT lag, count(*) AS count_symbols, 'delta_vol' AS metric FROM best_delta_vol GROUP BY lag
    UNION ALL SELECT lag, count(*), 'delta_illiq' FROM best_delta_illiq GROUP BY lag""")
def q_lag_hist(spark, sf_dir):
    return K.lag_summary(_effects_e(spark, sf_dir), MIN_OBS_TEST, exact=True)[1]


@register("leveraged_regex", O.with_ctes(O.BARS_D) + f""" SELECT DISTINCT symbol,
    regexp_matches(symbol, '{O.LEV_REGEX}') AS is_leveraged FROM bars_d""")
def q_leveraged_regex(spark, sf_dir):
    from tickstat.functions.symbols import is_leveraged_regex
    return daily_bars(spark, sf_dir).select("symbol", is_leveraged_regex().alias("is_leveraged")).distinct()


# ---------------------------------------------------------------- step 8: betas and regimes
from tickstat.operators import beta as B  # noqa: E402

# Test parameters (FIXTURES.md section 5): minimum rows 850, regime minimum 230, hyper quantile 0.75.
BETA_TEST = B.BetaParams(min_rows=850, regime_min=230, hyper_q=0.75, exact=True)
_FDB = O.with_ctes(O.BARS_D, O.features("bars_d", "feat_d"), O.beta_ctes())


def _betas_d(spark, sf_dir):
    return B.regime_betas(features_d(spark, sf_dir), BETA_TEST)


@register("universe", _FDB + " SELECT symbol, count(*) AS n_rows FROM u GROUP BY symbol")
def q_universe(spark, sf_dir):
    return B.universe_filter(features_d(spark, sf_dir), BETA_TEST).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"))


@register("leveraged_contains", O.with_ctes(O.BARS_D) + f" SELECT DISTINCT symbol, {O.LEV_CONTAINS} AS is_leveraged FROM bars_d")
def q_leveraged_contains(spark, sf_dir):
    from tickstat.functions.symbols import is_leveraged_contains
    return daily_bars(spark, sf_dir).select("symbol", is_leveraged_contains().alias("is_leveraged")).distinct()


@register("daily_close", O.final(_FDB + " SELECT date, btc_daily_close FROM dclose", ["date", "btc_daily_close"],
                                 ["btc_daily_close"]))
def q_daily_close(spark, sf_dir):
    u = B.universe_filter(features_d(spark, sf_dir), BETA_TEST)
    return B.daily_close(u.where(F.col("symbol") == BETA_TEST.btc_symbol))


@register("regime", O.final(_FDB + " SELECT date, btc_ret_30d, regime FROM reg", ["date", "btc_ret_30d", "regime"],
                            ["btc_ret_30d"]))
def q_regime(spark, sf_dir):
    u = B.universe_filter(features_d(spark, sf_dir), BETA_TEST)
    return B.price_regime(B.daily_close(u.where(F.col("symbol") == BETA_TEST.btc_symbol)), BETA_TEST)


@register("beta_overall", O.final(_FDB + " SELECT * FROM overall", O.BETA_OUT, O.BETA_DBL))
def q_beta_overall(spark, sf_dir):
    return B.betas_overall(_betas_d(spark, sf_dir))


_BR_COLS = O.BETA_OUT[:3] + ["regime"] + O.BETA_OUT[3:]


@register("beta_by_regime", O.final(_FDB + " SELECT * FROM byreg", _BR_COLS, O.BETA_DBL))
def q_beta_by_regime(spark, sf_dir):
    return B.betas_by_regime(_betas_d(spark, sf_dir))


@register("beta_ols_single", O.final(_FDB + " SELECT * FROM overall", O.BETA_OUT, O.BETA_DBL))
def q_beta_ols_single(spark, sf_dir):
    j = B.regime_input(features_d(spark, sf_dir), BETA_TEST)
    return B.ols_beta(j, B.KEYS, min_rows=BETA_TEST.min_rows)


_PIV_COLS = ["symbol", "base_asset", "quote_asset", "beta_bull", "beta_bear", "beta_neutral", "delta_beta_bear_minus_bull"]


@register("beta_pivot", O.final(_FDB + " SELECT * FROM bpiv", _PIV_COLS, _PIV_COLS[3:]))
def q_beta_pivot(spark, sf_dir):
    return B.beta_pivot(B.betas_by_regime(_betas_d(spark, sf_dir)))


@register("top_delta", O.final(_FDB + """ SELECT * FROM bpiv WHERE beta_bull IS NOT NULL AND beta_bear IS NOT NULL
    ORDER BY delta_beta_bear_minus_bull DESC NULLS LAST, symbol""", _PIV_COLS, _PIV_COLS[3:]))
def q_top_delta(spark, sf_dir):
    return B.top_delta_beta(B.beta_pivot(B.betas_by_regime(_betas_d(spark, sf_dir))))


@register("hyper", O.final(_FDB + " SELECT o.* FROM overall o, hcut WHERE o.beta IS NOT NULL AND o.beta >= hcut.cut",
                           O.BETA_OUT, O.BETA_DBL))
def q_hyper(spark, sf_dir):
    return B.hyper_sensitive(B.betas_overall(_betas_d(spark, sf_dir)), BETA_TEST)


@register("regime_summary", O.final(_FDB + """ SELECT regime, count(*) AS n_symbols, avg(beta) AS avg_beta,
      quantile_disc(beta, 0.5) AS median_beta, quantile_disc(beta, 0.95) AS p95_beta, quantile_disc(beta, 0.05) AS p05_beta
    FROM byreg WHERE beta IS NOT NULL GROUP BY regime""",
                                    ["regime", "n_symbols", "avg_beta", "median_beta", "p95_beta", "p05_beta"],
                                    ["avg_beta", "median_beta", "p95_beta", "p05_beta"]))
def q_regime_summary(spark, sf_dir):
    return B.beta_regime_summary(B.betas_by_regime(_betas_d(spark, sf_dir)), exact=True)


# ---------------------------------------------------------------- step 9: distributions and samples
from tickstat.operators import dist as Dd  # noqa: E402

_LAB = _FDS + f""",
lab AS (SELECT f.*, {O.tier_case('base_asset', LARGE_CAP_LIST)} AS tier, sm.is_stress FROM feat_d f LEFT JOIN sm ON f.open_time = sm.open_time)"""
_PLOT_COLS = ["tier"] + [f"{m}_{s}" for m in Dd.PLOT_METRICS for s in ("stress", "calm", "unknown")]


@register("plot_table", O.final(_LAB + f""",
cmp AS (SELECT tier, is_stress, {O.QUALITY_SQL} FROM lab GROUP BY tier, is_stress)
SELECT tier, """ + ", ".join(
    f"max(CASE WHEN {cond} THEN {m} END) AS {m}_{s}"
    for m in Dd.PLOT_METRICS
    for s, cond in (("stress", "is_stress = true"), ("calm", "is_stress = false"), ("unknown", "is_stress IS NULL")))
    + " FROM cmp GROUP BY tier", _PLOT_COLS, _PLOT_COLS[1:]))
def q_plot_table(spark, sf_dir):
    return Dd.plot_table(S.stress_compare(features_d(spark, sf_dir), STRESS_TEST))


_BOX_COLS = ["tier", "is_stress", "metric", "n", "q1", "median", "q3", "whisker_lo", "whisker_hi"]


@register("box_stats", O.final(_LAB + """,
st AS (
  SELECT tier, is_stress, 'quote_asset_volume' AS metric, CAST(quote_asset_volume AS DOUBLE) AS v FROM lab
  UNION ALL SELECT tier, is_stress, 'amihud_illiq', amihud_illiq FROM lab
  UNION ALL SELECT tier, is_stress, 'parkinson_var_1m', parkinson_var_1m FROM lab
  UNION ALL SELECT tier, is_stress, 'abs_return', abs(log_return) FROM lab
),
qs AS (
  SELECT tier, is_stress, metric, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
         quantile_cont(v, 0.75) AS q3
  FROM st WHERE v IS NOT NULL GROUP BY tier, is_stress, metric
)
SELECT qs.tier, qs.is_stress, qs.metric, count(*) AS n, any_value(qs.q1) AS q1, any_value(qs.median) AS median,
       any_value(qs.q3) AS q3,
       min(CASE WHEN st.v >= qs.q1 - 1.5 * (qs.q3 - qs.q1) THEN st.v END) AS whisker_lo,
       max(CASE WHEN st.v <= qs.q3 + 1.5 * (qs.q3 - qs.q1) THEN st.v END) AS whisker_hi
FROM qs JOIN st ON qs.tier = st.tier AND qs.is_stress IS NOT DISTINCT FROM st.is_stress AND qs.metric = st.metric
WHERE st.v IS NOT NULL
GROUP BY qs.tier, qs.is_stress, qs.metric""", _BOX_COLS, ["q1", "median", "q3", "whisker_lo", "whisker_hi"]))
def q_box_stats(spark, sf_dir):
    return Dd.box_stats(S.label_stress_minutes(features_d(spark, sf_dir), STRESS_TEST), exact=True)


_KEY_D = ("symbol", "open_time")
_HASH_D = "md5(concat_ws('|', symbol, CAST(open_time AS VARCHAR), '42'))"


@register("sample_uniform", O.final(_FDS + f" SELECT symbol, open_time, log_return FROM feat_d WHERE substr({_HASH_D}, 1, 8) < '{Dd.hash_limit(0.01)}'",
                                    ["symbol", "open_time", "log_return"], ["log_return"]))
def q_sample_uniform(spark, sf_dir):
    return Dd.sample_uniform(features_d(spark, sf_dir), _KEY_D, 0.01, 42).select("symbol", "open_time", "log_return")


@register("sample_cap", O.final(_FDS + f""" SELECT symbol, open_time, log_return FROM feat_d WHERE substr({_HASH_D}, 1, 8) < '{Dd.hash_limit(0.1)}'
    ORDER BY {_HASH_D}, symbol, open_time LIMIT 50""", ["symbol", "open_time", "log_return"], ["log_return"]))
def q_sample_cap(spark, sf_dir):
    return Dd.sample_uniform(features_d(spark, sf_dir), _KEY_D, 0.1, 42, cap=50).select("symbol", "open_time", "log_return")


_STRATA = {"LARGE_CAP|true": 0.5, "LARGE_CAP|false": 0.05, "SMALL_CAP|true": 0.2, "SMALL_CAP|false": 0.01, "LARGE_CAP|null": 0.3, "SMALL_CAP|null": 0.02}


@register("sample_stratified", _LAB + " SELECT symbol, open_time, tier, is_stress FROM lab WHERE " + " OR ".join(
    f"(tier = '{k.split('|')[0]}' AND is_stress IS NOT DISTINCT FROM {k.split('|')[1]} AND substr({_HASH_D}, 1, 8) < '{Dd.hash_limit(f)}')" for k, f in _STRATA.items()))
def q_sample_stratified(spark, sf_dir):
    lab = S.label_stress_minutes(features_d(spark, sf_dir), STRESS_TEST)
    return Dd.sample_stratified(lab, _KEY_D, ["tier", "is_stress"], _STRATA, 42).select("symbol", "open_time", "tier", "is_stress")


# ---------------------------------------------------------------- step 11: README-declared extensions
from tickstat.operators import ext as X  # noqa: E402
from tickstat.operators.breaks import structural_breaks  # noqa: E402
from tickstat.operators.var import var_irf  # noqa: E402
from tickstat.sources.fixtures import event_trades  # noqa: E402
from tickstat.sources.trades import normalize_trades  # noqa: E402

_TE = O.with_ctes(O.TRADES_E)
_TB_COLS = ["symbol", "open_time", "open", "high", "low", "close", "volume", "quote_asset_volume", "number_of_trades",
            "taker_buy_base_asset_volume", "taker_buy_quote_asset_volume"]
_TB_DBL = [c for c in _TB_COLS if c not in ("symbol", "open_time", "number_of_trades")]


@register("trades_to_bars", O.final(_TE + """ SELECT symbol, date_trunc('hour', time) AS open_time,
    arg_min(price, time) AS open, max(price) AS high, min(price) AS low, arg_max(price, time) AS close,
    sum(qty) AS volume, sum(quote_qty) AS quote_asset_volume, count(*) AS number_of_trades,
    sum(CASE WHEN NOT is_buyer_maker THEN qty ELSE 0.0 END) AS taker_buy_base_asset_volume,
    sum(CASE WHEN NOT is_buyer_maker THEN quote_qty ELSE 0.0 END) AS taker_buy_quote_asset_volume
    FROM trades_e GROUP BY ALL""", _TB_COLS, _TB_DBL))
def q_trades_to_bars(spark, sf_dir):
    return X.trades_to_bars(event_trades(spark, sf_dir), "1 hour")


# raw trades as the exchange stores them (pair without a dash, time in milliseconds) up to the stress comparison
@register("trades_to_stress", O.final(O.with_ctes(O.TRADES_E, """
bars_t AS (SELECT symbol, date_trunc('hour', time) AS open_time, split_part(symbol, '-', 1) AS base_asset,
    arg_max(price, (time, id)) AS close, max(price) AS high, min(price) AS low,
    sum(qty) AS volume, sum(quote_qty) AS quote_asset_volume, count(*) AS number_of_trades,
    sum(CASE WHEN NOT is_buyer_maker THEN quote_qty ELSE 0.0 END) AS taker_buy_quote_asset_volume
    FROM (SELECT * REPLACE (date_trunc('millisecond', time) AS time) FROM trades_e) GROUP BY symbol, date_trunc('hour', time))""",
    O.features("bars_t", "feat_t"), O.stress_minutes_ctes("feat_t")) + f""",
lab AS (SELECT f.*, {O.tier_case('base_asset', LARGE_CAP_LIST)} AS tier, sm.is_stress FROM feat_t f LEFT JOIN sm ON f.open_time = sm.open_time)
SELECT tier, is_stress, {O.QUALITY_SQL} FROM lab GROUP BY tier, is_stress""", ["tier", "is_stress"] + O.QUALITY_COLS, _QD))
def q_trades_to_stress(spark, sf_dir):
    raw = event_trades(spark, sf_dir).withColumns(
        {"symbol": F.replace(F.col("symbol"), F.lit("-"), F.lit("")), "time": F.unix_millis(F.col("time").cast("timestamp"))})
    bars = X.trades_to_bars(normalize_trades(raw), "1 hour")
    return S.stress_compare(materialize(bar_features(bars)), STRESS_TEST)


_RS_DBL = ["open", "high", "low", "close", "volume", "quote_asset_volume", "taker_buy_base_asset_volume",
           "taker_buy_quote_asset_volume"]


@register("resample", O.final(O.with_ctes(O.BARS_E) + """ SELECT symbol,
    time_bucket(INTERVAL 4 HOUR, open_time, TIMESTAMP '1970-01-01') AS open_time,
    arg_min(open, open_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time) AS close,
    sum(volume) AS volume, sum(quote_asset_volume) AS quote_asset_volume,
    CAST(sum(number_of_trades) AS BIGINT) AS number_of_trades,
    sum(taker_buy_base_asset_volume) AS taker_buy_base_asset_volume,
    sum(taker_buy_quote_asset_volume) AS taker_buy_quote_asset_volume
    FROM bars_e GROUP BY ALL""", _TB_COLS, _RS_DBL))
def q_resample(spark, sf_dir):
    return X.resample(hourly_bars(spark, sf_dir), "4 hours")


@register("three_tiers", O.with_ctes(O.BARS_D) + f""",
tot AS (SELECT base_asset, sum(quote_asset_volume) AS s FROM bars_d GROUP BY 1),
rk AS (SELECT base_asset, row_number() OVER (ORDER BY s DESC NULLS LAST, base_asset) AS size_rank FROM tot)
SELECT DISTINCT b.symbol, b.base_asset, rk.size_rank,
  CASE WHEN b.base_asset IN ('BTC', 'ETH') THEN 'LARGE_CAP' WHEN rk.size_rank <= 10 THEN 'MID_CAP'
       ELSE 'SMALL_CAP' END AS tier3
FROM bars_d b LEFT JOIN rk ON b.base_asset = rk.base_asset""")
def q_three_tiers(spark, sf_dir):
    return X.three_tiers(daily_bars(spark, sf_dir), mid_max_rank=10).select(
        "symbol", "base_asset", "size_rank", "tier3").distinct()


@register("marketcap_join", O.final(O.with_ctes(O.BARS_D) + """,
snaps AS (
  SELECT base_asset, time_bucket(INTERVAL 7 DAY, open_time, TIMESTAMP '1970-01-01') + INTERVAL 7 DAY AS snap_time,
         sum(quote_asset_volume) AS weekly_size
  FROM bars_d GROUP BY ALL
)
SELECT b.symbol, b.base_asset, b.open_time, s.snap_time, s.weekly_size
FROM bars_d b ASOF LEFT JOIN snaps s ON b.base_asset = s.base_asset AND b.open_time >= s.snap_time""",
                                    ["symbol", "base_asset", "open_time", "snap_time", "weekly_size"], ["weekly_size"]))
def q_marketcap_join(spark, sf_dir):
    bars = daily_bars(spark, sf_dir)
    snaps = X.weekly_snapshots(bars)
    return X.asof_join(bars.select("symbol", "base_asset", "open_time"), snaps, "base_asset", "open_time",
                       "snap_time", ["snap_time", "weekly_size"])


# snapshots of the brands' assets from the part table alone, through dated CSV folders
_CAP_DAYS = 200
_BASE_OF_BRAND = "CASE k " + " ".join(f"WHEN {k} THEN '{a}'" for k, a in BRAND_BASE.items()) + " ELSE 'B' || k END"
_CAPS = f"""
parts AS (SELECT CAST(substr(p_brand, 7) AS INTEGER) AS k, p_partkey, p_size, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part),
caps AS (SELECT {_BASE_OF_BRAND} AS base_asset,
    CAST(make_date(1995 + p_size % 7, CAST(1 + p_partkey % 12 AS INTEGER), 1) AS TIMESTAMP) AS snap_time, CAST(sum(cents) AS DOUBLE) AS market_cap
  FROM parts GROUP BY 1, 2),
ranks AS (SELECT *, row_number() OVER (PARTITION BY snap_time ORDER BY market_cap DESC, base_asset) AS cap_rank FROM caps)"""


def _market_caps(spark, sf_dir):
    path = f"{_folder(spark)}/caps"
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.expr("CAST(substr(p_brand, 7) AS INT)").alias("k"), "p_partkey", "p_size", F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"))
    day = F.make_date(F.lit(1995) + F.col("p_size") % 7, (F.col("p_partkey") % 12 + 1).cast("int"), F.lit(1))
    write_market_caps(parts.groupBy(F.expr(_BASE_OF_BRAND).alias("base_asset"), day.cast("timestamp_ntz").alias("snap_time")).agg(
        F.sum("cents").cast("double").alias("market_cap")), path)
    return read_market_caps(spark, path)


@register("market_cap_tiers", O.final(O.with_ctes(O.BARS_D, _CAPS) + f"""
SELECT b.symbol, b.open_time, r.market_cap, r.cap_rank,
  CASE WHEN r.cap_rank <= 3 THEN 'LARGE_CAP' WHEN r.cap_rank <= 6 THEN 'MID_CAP' ELSE 'SMALL_CAP' END AS tier3
FROM bars_d b LEFT JOIN (
  SELECT *, least(lead(snap_time) OVER (PARTITION BY base_asset ORDER BY snap_time), snap_time + INTERVAL {_CAP_DAYS} DAY) AS ends FROM ranks) r
ON r.base_asset = b.base_asset AND b.open_time >= r.snap_time AND b.open_time < r.ends""",
                                      ["symbol", "open_time", "market_cap", "cap_rank", "tier3"], ["market_cap"]))
def q_market_cap_tiers(spark, sf_dir):
    """External snapshot files -> ranks with validity -> the tier of each bar at its time."""
    ranks = ranks_of(_market_caps(spark, sf_dir), _CAP_DAYS)
    return ranked_tiers(daily_bars(spark, sf_dir).select("symbol", "base_asset", "open_time"), ranks, 3, 6).drop("base_asset")


_TS_COLS = ["symbol", "open_time", "buy_volume_share", "sell_volume_share", "buy_trade_share"]


@register("taker_share_trades", O.final(_TE + """ SELECT symbol, date_trunc('hour', time) AS open_time,
    sum(CASE WHEN NOT is_buyer_maker THEN qty ELSE 0.0 END) / sum(qty) AS buy_volume_share,
    sum(CASE WHEN is_buyer_maker THEN qty ELSE 0.0 END) / sum(qty) AS sell_volume_share,
    CAST(count(*) FILTER (WHERE NOT is_buyer_maker) AS DOUBLE) / count(*) AS buy_trade_share
    FROM trades_e GROUP BY ALL""", _TS_COLS, _TS_COLS[2:]))
def q_taker_share_trades(spark, sf_dir):
    return X.taker_share(event_trades(spark, sf_dir), "1 hour")


_FEO = O.with_ctes(O.BARS_E, O.features("bars_e", "feat_e"))


@register("realized_vol", O.final(_FEO + """ SELECT symbol, CAST(open_time AS DATE) AS date,
    count(log_return) AS n_returns, sqrt(sum(log_return * log_return)) AS realized_vol,
    avg(abs(log_return)) AS abs_return_vol FROM feat_e GROUP BY ALL""",
                                  ["symbol", "date", "n_returns", "realized_vol", "abs_return_vol"],
                                  ["realized_vol", "abs_return_vol"]))
def q_realized_vol(spark, sf_dir):
    return X.realized_vol(features_e(spark, sf_dir))


@register("drawdown", O.final(O.with_ctes(O.BARS_D) + """ SELECT symbol, open_time, close,
    close / NULLIF(max(close) OVER (PARTITION BY symbol ORDER BY open_time ROWS UNBOUNDED PRECEDING), 0) - 1.0 AS drawdown,
    close / NULLIF(max(close) OVER (PARTITION BY symbol ORDER BY open_time ROWS UNBOUNDED PRECEDING), 0) - 1.0 <= -0.5
      AS is_drawdown_stress
    FROM bars_d""", ["symbol", "open_time", "close", "drawdown", "is_drawdown_stress"], ["close", "drawdown"]))
def q_drawdown(spark, sf_dir):
    return X.drawdown(daily_bars(spark, sf_dir), threshold=0.5)


@register("rolling_beta", O.final(_FDB + """ SELECT symbol, open_time, count(ret) OVER w AS n_window,
    CASE WHEN count(ret) OVER w >= 5 AND abs(var_pop(btc_ret) OVER w) > 1e-18
         THEN covar_pop(ret, btc_ret) OVER w / var_pop(btc_ret) OVER w END AS rolling_beta
    FROM j WINDOW w AS (PARTITION BY symbol ORDER BY CAST(epoch(open_time) AS BIGINT)
                        RANGE BETWEEN 2592000 PRECEDING AND CURRENT ROW)""",
                                  ["symbol", "open_time", "n_window", "rolling_beta"], ["rolling_beta"]))
def q_rolling_beta(spark, sf_dir):
    return X.rolling_beta(B.regime_input(features_d(spark, sf_dir), BETA_TEST), 30 * 86400, min_n=5)


@register("intensity_jump", _FEO + """,
jj AS (SELECT symbol, open_time, number_of_trades,
              abs(number_of_trades - lag(number_of_trades) OVER (PARTITION BY symbol ORDER BY open_time)) AS trade_jump
       FROM feat_e),
th AS (SELECT symbol, quantile_disc(trade_jump, 0.95) AS jump_threshold FROM jj GROUP BY symbol)
SELECT jj.symbol, jj.open_time, jj.number_of_trades, jj.trade_jump, th.jump_threshold,
       jj.trade_jump >= th.jump_threshold AS is_jump
FROM jj LEFT JOIN th ON jj.symbol = th.symbol""")
def q_intensity_jump(spark, sf_dir):
    return X.intensity_jumps(features_e(spark, sf_dir), q=0.95, exact=True)


_XC_LAGS = (0, 1, 2, 3, 6, 12)


@register("cross_corr", O.final(_FEO + f""",
lags AS (SELECT unnest([{', '.join(str(x) for x in _XC_LAGS)}]) AS lag)
SELECT r.symbol, l.lag,
  count(CASE WHEN d.number_of_trades IS NOT NULL AND r.parkinson_var_1m IS NOT NULL THEN 1 END) AS n,
  CASE WHEN coalesce(var_pop(CASE WHEN r.parkinson_var_1m IS NOT NULL THEN CAST(d.number_of_trades AS DOUBLE) END), 0) > 0
        AND coalesce(var_pop(CASE WHEN d.number_of_trades IS NOT NULL THEN r.parkinson_var_1m END), 0) > 0
       THEN corr(CAST(d.number_of_trades AS DOUBLE), r.parkinson_var_1m) END AS corr
FROM feat_e r CROSS JOIN lags l
JOIN feat_e d ON d.symbol = 'BTC-USDT' AND d.open_time = r.open_time - to_hours(l.lag)
WHERE r.symbol <> 'BTC-USDT'
GROUP BY r.symbol, l.lag""", ["symbol", "lag", "n", "corr"], ["corr"]))
def q_cross_corr(spark, sf_dir):
    return X.cross_correlation(features_e(spark, sf_dir), "BTC-USDT", _XC_LAGS, "HOUR")


@register("cusum_break", O.final(_FEO + """,
c0 AS (SELECT symbol, open_time, sum(number_of_trades) OVER w AS s, count(*) OVER w AS k
       FROM feat_e WHERE symbol IN ('BTC-USDT', 'ETH-USDT') AND number_of_trades IS NOT NULL
       WINDOW w AS (PARTITION BY symbol ORDER BY open_time ROWS UNBOUNDED PRECEDING)),
t AS (SELECT symbol, sum(number_of_trades) AS tot, count(*) AS n FROM feat_e
      WHERE symbol IN ('BTC-USDT', 'ETH-USDT') AND number_of_trades IS NOT NULL GROUP BY symbol),
c1 AS (SELECT c0.symbol, c0.open_time, c0.k, t.n, c0.s - c0.k * (CAST(t.tot AS DOUBLE) / t.n) AS c
       FROM c0 JOIN t ON c0.symbol = t.symbol)
SELECT symbol, any_value(n) AS n, first(open_time ORDER BY abs(c) DESC, k ASC) AS break_time,
       max(abs(c)) AS max_abs_cusum
FROM c1 GROUP BY symbol""", ["symbol", "n", "break_time", "max_abs_cusum"], ["max_abs_cusum"]))
def q_cusum_break(spark, sf_dir):
    return X.cusum_break(features_e(spark, sf_dir))


_DEG_METRICS = ("median_quote_volume", "zero_volume_ratio", "avg_amihud", "p95_amihud", "avg_parkinson_vol",
                "avg_abs_return")


def _deg_sql() -> str:
    def v(tier, state, m):
        return f"max(CASE WHEN tier = '{tier}' AND is_stress = {state} THEN {m} END)"
    parts = [f"SELECT '{m}' AS metric, {v('LARGE_CAP', 'true', m)} / {v('LARGE_CAP', 'false', m)} AS large_ratio, "
             f"{v('SMALL_CAP', 'true', m)} / {v('SMALL_CAP', 'false', m)} AS small_ratio FROM cmp" for m in _DEG_METRICS]
    return (_LAB + f""",
cmp AS (SELECT tier, is_stress, {O.QUALITY_SQL} FROM lab GROUP BY tier, is_stress),
rr AS ({' UNION ALL '.join(parts)})
SELECT metric, large_ratio, small_ratio, small_ratio / large_ratio AS small_over_large FROM rr""")


@register("degradation_ratio", O.final(_deg_sql(), ["metric", "large_ratio", "small_ratio", "small_over_large"],
                                       ["large_ratio", "small_ratio", "small_over_large"]))
def q_degradation_ratio(spark, sf_dir):
    return X.degradation_ratio(S.stress_compare(features_d(spark, sf_dir), STRESS_TEST), _DEG_METRICS)


_VAR_H = 3


def _var_sql() -> str:
    irf, ry, rx = [], "0.0", "1.0"
    lines = []
    for h in range(1, _VAR_H + 1):
        lines.append(f"a_yy * ({ry}) + a_yx * ({rx}) AS ry{h}, a_xy * ({ry}) + a_xx * ({rx}) AS rx{h}")
        ry, rx = f"ry{h}", f"rx{h}"
        irf.append(f"ry{h} AS irf_{h}")
    chain = "co"
    ctes = []
    for h, ln in enumerate(lines, 1):
        ctes.append(f"ir{h} AS (SELECT *, {ln} FROM {chain})")
        chain = f"ir{h}"
    coef = "CASE WHEN abs(det) > 1e-12 * suu * svv THEN ({a} * {b} - {c} * {e}) / det END"
    return (_FDB + f""",
v1 AS (SELECT symbol, open_time, ret, btc_ret, lag(ret) OVER w AS y1, lag(btc_ret) OVER w AS x1
       FROM j WINDOW w AS (PARTITION BY symbol ORDER BY open_time)),
v2 AS (SELECT symbol, count(*) AS n, covar_pop(y1, y1) AS suu, covar_pop(x1, x1) AS svv, covar_pop(y1, x1) AS suv,
              covar_pop(y1, ret) AS suy, covar_pop(x1, ret) AS svy, covar_pop(y1, btc_ret) AS sux,
              covar_pop(x1, btc_ret) AS svx
       FROM v1 WHERE ret IS NOT NULL AND btc_ret IS NOT NULL AND y1 IS NOT NULL AND x1 IS NOT NULL
       GROUP BY symbol HAVING count(*) >= 3),
v3 AS (SELECT *, suu * svv - suv * suv AS det FROM v2),
co AS (SELECT symbol, n,
         {coef.format(a='svv', b='suy', c='suv', e='svy')} AS a_yy,
         {coef.format(a='suu', b='svy', c='suv', e='suy')} AS a_yx,
         {coef.format(a='svv', b='sux', c='suv', e='svx')} AS a_xy,
         {coef.format(a='suu', b='svx', c='suv', e='sux')} AS a_xx
       FROM v3),
{', '.join(ctes)}
SELECT symbol, n, a_yy, a_yx, a_xy, a_xx, {', '.join(irf)} FROM {chain}""")


_VAR_COLS = ["symbol", "n", "a_yy", "a_yx", "a_xy", "a_xx"] + [f"irf_{h}" for h in range(1, _VAR_H + 1)]


@register("var1_irf", O.final(_var_sql(), _VAR_COLS, _VAR_COLS[2:]))
def q_var1_irf(spark, sf_dir):
    return X.var1_irf(B.regime_input(features_d(spark, sf_dir), BETA_TEST), horizon=_VAR_H, min_n=3)


_VARP_H = 4


def _varp_sql(p_max: int = 2) -> str:
    """VAR of order 1 to ``p_max`` by Gauss-Jordan steps, one common table each; BIC picks the order."""
    names = ["ret", "btc_ret"] + [f"{v}{j}" for j in range(1, p_max + 1) for v in ("y", "x")]
    lags = ", ".join(f"lag(ret, {j}) OVER w AS y{j}, lag(btc_ret, {j}) OVER w AS x{j}" for j in range(1, p_max + 1))
    moments = ", ".join(f"covar_pop({a}, {b}) AS m_{i}_{j}" for i, a in enumerate(names) for j, b in enumerate(names))
    ctes = [f"v1 AS (SELECT symbol, open_time, ret, btc_ret, {lags} FROM j WINDOW w AS (PARTITION BY symbol ORDER BY open_time))",
            f"mo AS (SELECT symbol, count(*) AS n, {moments} FROM v1 WHERE {' AND '.join(f'{a} IS NOT NULL' for a in names)} GROUP BY symbol HAVING count(*) >= 30)"]
    orders = []
    for p in range(1, p_max + 1):
        at, last = list(range(2, 2 + 2 * p)), "mo"
        keep = ", ".join(f"m_{i}_{j}" for i in (0, 1) for j in range(2 + 2 * p))
        for k in at:
            cols = [f"m_{i}_{j} - m_{i}_{k} * m_{k}_{j} / m_{k}_{k} AS m_{i}_{j}" if i != k else f"m_{k}_{j} / m_{k}_{k} AS m_{k}_{j}" for i in at for j in [0, 1, *at]]
            ctes.append(f"g{p}_{k} AS (SELECT symbol, n, {keep}, {', '.join(cols)} FROM {last})")
            last = f"g{p}_{k}"
        sig = lambda a, b: f"m_{a}_{b}" + "".join(f" - m_{i}_{a} * m_{b}_{i}" for i in at)  # noqa: E731, B023
        ctes.append(f"s{p} AS (SELECT *, {sig(0, 0)} AS syy, {sig(1, 1)} AS sxx, {sig(0, 1)} AS sxy FROM {last})")
        ctes.append(f"h{p}_0 AS (SELECT *, ln(syy * sxx - sxy * sxy) + {4 * p} * ln(n) / n AS bic, sxy / sqrt(sxx) AS xy0, sqrt(sxx) AS xx0, "
                    f"sqrt((syy * sxx - sxy * sxy) / sxx) AS yy0, 0.0::DOUBLE AS yx0 FROM s{p})")
        for h in range(1, _VARP_H + 1):
            step = lambda shock, c: " + ".join(f"m_{2 * j}_{c} * {shock}y{h - j} + m_{2 * j + 1}_{c} * {shock}x{h - j}" for j in range(1, min(p, h) + 1))  # noqa: E731, B023
            ctes.append(f"h{p}_{h} AS (SELECT *, {step('x', 0)} AS xy{h}, {step('x', 1)} AS xx{h}, {step('y', 0)} AS yy{h}, {step('y', 1)} AS yx{h} FROM h{p}_{h - 1})")
        of = lambda s: " + ".join(f"{s}y{h} * {s}y{h}" for h in range(_VARP_H + 1))
        orders.append(f"SELECT symbol, n, {p}::BIGINT AS p, bic, {', '.join(f'xy{h} AS irf_{h}' for h in range(_VARP_H + 1))}, ({of('x')}) / ({of('x')} + {of('y')}) AS fevd FROM h{p}_{_VARP_H}")
    ctes.append(f"allp AS ({' UNION ALL '.join(orders)})")
    return _FDB + ", " + ",\n".join(ctes) + " SELECT * FROM allp QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bic, p) = 1"


_VARP_COLS = ["symbol", "n", "p", "bic", *[f"irf_{h}" for h in range(_VARP_H + 1)], "fevd"]


@register("var_irf", O.final(_varp_sql(), _VARP_COLS, _VARP_COLS[3:]))
def q_var_irf(spark, sf_dir):
    return var_irf(B.regime_input(features_d(spark, sf_dir), BETA_TEST), p_max=2, horizon=_VARP_H, criterion="bic", min_n=30)


_BREAK_LAGS, _BREAK_MIN = 3, 20
_BREAK_COLS = ["symbol", "round", "seg_start", "seg_end", "n", "break_place", "break_time", "statistic", "mean_before", "mean_after"]


def _breaks_sql() -> str:
    lags = ", ".join(f"lag(x, {j}) OVER w AS x{j}" for j in range(1, _BREAK_LAGS + 1))
    lrv = "sum((x - m) * (x - m)) / max(n)" + "".join(f" + {2.0 * (1 - j / (_BREAK_LAGS + 1))!r} * sum((x - m) * (x{j} - m)) / max(n)" for j in range(1, _BREAK_LAGS + 1))
    return _FEO + f""",
b0 AS (SELECT symbol, open_time, CAST(number_of_trades AS BIGINT) AS x FROM feat_e WHERE number_of_trades IS NOT NULL),
b1 AS (SELECT *, row_number() OVER w AS k, sum(x) OVER w AS s, {lags} FROM b0 WINDOW w AS (PARTITION BY symbol ORDER BY open_time)),
b2 AS (SELECT *, count(*) OVER a AS n, sum(x) OVER a AS t, CAST(sum(x) OVER a AS DOUBLE) / count(*) OVER a AS m FROM b1 WINDOW a AS (PARTITION BY symbol)),
b3 AS (SELECT symbol, max(n) AS n, max(t) AS t, {lrv} AS lrv FROM b2 GROUP BY symbol),
b4 AS (SELECT symbol, open_time, k, s, abs(s - k * m) AS c FROM b2 WHERE k >= {_BREAK_MIN} AND n - k >= {_BREAK_MIN}
       QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY abs(s - k * m) DESC, k) = 1)
SELECT symbol, CAST(1 AS INTEGER) AS round, CAST(0 AS BIGINT) AS seg_start, n AS seg_end, n, k AS break_place, open_time AS break_time, c / sqrt(lrv * n) AS statistic,
  CAST(s AS DOUBLE) / k AS mean_before, CAST(t - s AS DOUBLE) / (n - k) AS mean_after
FROM b3 JOIN b4 USING (symbol) WHERE lrv > 0 AND c / sqrt(lrv * n) > 0.9"""


@register("structural_breaks", O.final(_breaks_sql(), _BREAK_COLS, _BREAK_COLS[7:]))
def q_structural_breaks(spark, sf_dir):
    return structural_breaks(features_e(spark, sf_dir), None, lags=_BREAK_LAGS, rounds=1, critical=0.9, min_size=_BREAK_MIN)


# ---------------------------------------------------------------- G3: the reference's previews
_B10 = _best_cols("delta_vol")


@register("best_lag_top10", O.final(_FEB + f" SELECT {_B10[2]} FROM best_delta_vol ORDER BY delta_vol DESC NULLS LAST, symbol LIMIT 10", _B10[0], _B10[1]))
def q_best_lag_top10(spark, sf_dir):
    return K.top_best_lags(K.best_lag(_effects_e(spark, sf_dir), "delta_vol", MIN_OBS_TEST))


@register("hyper_top15", O.final(_FDB + " SELECT o.* FROM overall o WHERE o.beta IS NOT NULL ORDER BY o.beta DESC, symbol LIMIT 15", O.BETA_OUT, O.BETA_DBL))
def q_hyper_top15(spark, sf_dir):
    return B.strongest(B.betas_overall(_betas_d(spark, sf_dir)).where("beta is not null"), "beta")


@register("top_delta15", O.final(_FDB + """ SELECT * FROM bpiv WHERE beta_bull IS NOT NULL AND beta_bear IS NOT NULL
    ORDER BY delta_beta_bear_minus_bull DESC NULLS LAST, symbol LIMIT 15""", _PIV_COLS, _PIV_COLS[3:]))
def q_top_delta15(spark, sf_dir):
    return B.strongest(B.top_delta_beta(B.beta_pivot(B.betas_by_regime(_betas_d(spark, sf_dir)))), "delta_beta_bear_minus_bull")


# ---------------------------------------------------------------- sinks, layouts and shapes of the reference's tables, each written and read back
def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"


@register("lag_min_effects", O.final(_FE + " SELECT * FROM eff", O.EFFECT_COLS, O.EFFECT_DOUBLES))
def q_lag_min_effects(spark, sf_dir):
    """An effects table with the older column name, as the summary step reads it."""
    return K.normalize_effects(_effects_e(spark, sf_dir).withColumnRenamed("lag", "lag_min"))


_LISTED = ("BNB-USDT", "ADA-EUR", "XRP-BTC")


@register("receiver_effects", O.final(_FE + f" SELECT * FROM eff WHERE symbol IN {_LISTED}", O.EFFECT_COLS, O.EFFECT_DOUBLES))
def q_receiver_effects(spark, sf_dir):
    """C4: the event study of an allow-list of receivers."""
    return K.lag_effects(features_e(spark, sf_dir), replace(SHOCK_TEST, receivers=_LISTED))


@register("table_round_trip", REGISTRY["bar_features"].sql)
def q_table_round_trip(spark, sf_dir):
    """The feature table in its stored layout, partitioned by quote asset, read back whole."""
    path = _folder(spark)
    write_table(layout_by_symbol(bar_features(hourly_bars(spark, sf_dir))), path, partition_by=["quote_asset"], rebalance=False)
    back = spark.read.parquet(path)
    return back.select(*BAR_E_COLS, *FEAT_COLS)


@register("small_round_trip", O.final(_FE + " SELECT * FROM eff", O.EFFECT_COLS, O.EFFECT_DOUBLES))
def q_small_round_trip(spark, sf_dir):
    """A result table in a fixed number of files."""
    path = _folder(spark)
    write_small(_effects_e(spark, sf_dir), path, files=3)
    return spark.read.parquet(path)


@register("csv_round_trip", O.final(_FE + " SELECT * FROM eff", O.EFFECT_COLS, O.EFFECT_DOUBLES))
def q_csv_round_trip(spark, sf_dir):
    """A summary as one CSV file with a header."""
    path = _folder(spark)
    effects = _effects_e(spark, sf_dir)
    write_csv(effects, path)
    return spark.read.schema(effects.schema).option("header", "true").csv(path)


# ---------------------------------------------------------------- step 12: streaming bars
@register("stream_bars", REGISTRY["trades_to_bars"].sql)
def q_stream_bars(spark, sf_dir):
    from tickstat.streaming.bars import stream_event_bars

    return stream_event_bars(spark, sf_dir, "1 hour")


@register("stream_log_return", O.final(O.with_ctes(O.BARS_E, O.features("bars_e", "feat_e")) + " SELECT symbol, open_time, close, log_return FROM feat_e",
                                       ["symbol", "open_time", "close", "log_return"], ["close", "log_return"]))
def q_stream_log_return(spark, sf_dir):
    """F1 on a stream: stored bars replayed in several micro-batches, in no time order."""
    from tickstat.streaming.returns import replay_returns

    base = _folder(spark)
    hourly_bars(spark, sf_dir).select("symbol", "open_time", "close").repartition(3, F.xxhash64("symbol", "open_time")).write.parquet(f"{base}/bars")
    return replay_returns(spark, f"{base}/bars", base, max_files=1)
