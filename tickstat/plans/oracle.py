"""DuckDB SQL oracles for the registered queries.

Each oracle is written independently of the Spark code, in plain SQL over the
driver's views (lineitem, part, events, ...). Helpers build the shared CTEs
(fixtures D and E, features) and the final canonical rounding, which uses the
same SQL text as ``tickstat.functions.canon`` on the Spark side.
"""

from __future__ import annotations

from collections.abc import Iterable

from tickstat.functions.canon import round_sig_sql

BAR_COLS = (
    "open_time, symbol, base_asset, quote_asset, high, low, close, volume, quote_asset_volume, "
    "number_of_trades, taker_buy_base_asset_volume, taker_buy_quote_asset_volume"
)
FEATURE_COLS = "log_return, taker_ratio, amihud_illiq, zero_volume_flag, parkinson_var_1m"

BARS_D = """
d_lines AS (
  SELECT l.l_shipdate AS open_time, CAST(substr(p.p_brand, 7) AS INTEGER) AS k,
         l.l_quantity AS qty, l.l_extendedprice AS px, l.l_returnflag AS rf,
         CAST(round(l.l_extendedprice * 100) AS BIGINT) AS cents
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
),
d_agg AS (
  SELECT open_time, k,
         CAST(sum(cents) AS DOUBLE) / 100.0 / sum(qty) AS close,
         max(px / qty) AS high, min(px / qty) AS low,
         sum(CASE WHEN rf <> 'R' THEN qty ELSE 0.0 END) AS volume,
         CAST(sum(CASE WHEN rf <> 'R' THEN cents ELSE 0 END) AS DOUBLE) / 100.0 AS quote_asset_volume,
         count(*) AS number_of_trades,
         sum(CASE WHEN rf = 'A' THEN qty ELSE 0.0 END) AS taker_buy_base_asset_volume,
         CAST(sum(CASE WHEN rf = 'A' THEN cents ELSE 0 END) AS DOUBLE) / 100.0 AS taker_buy_quote_asset_volume
  FROM d_lines GROUP BY open_time, k
),
d_named AS (
  SELECT *,
    CASE k WHEN 1 THEN 'BTC' WHEN 2 THEN 'ETH' WHEN 3 THEN 'BTC' WHEN 4 THEN 'BNB' WHEN 5 THEN 'XRP'
           WHEN 6 THEN 'SOL' WHEN 20 THEN 'SUPER' WHEN 21 THEN 'ADAUP' WHEN 22 THEN 'ADADOWN'
           WHEN 23 THEN 'ETHBULL' WHEN 24 THEN 'ETHBEAR' WHEN 25 THEN 'JUP'
           ELSE 'B' || CAST(k AS VARCHAR) END AS base_asset,
    CASE WHEN k IN (1, 2) THEN 'USDT' WHEN k = 3 THEN 'EUR' WHEN k = 7 THEN 'BTC' WHEN k = 8 THEN 'BNB'
         WHEN k % 3 = 0 THEN 'USDC' ELSE 'USDT' END AS quote_asset
  FROM d_agg
),
bars_d AS (
  SELECT open_time, base_asset || '-' || quote_asset AS symbol, base_asset, quote_asset,
         high, low, close, volume, quote_asset_volume, number_of_trades,
         taker_buy_base_asset_volume, taker_buy_quote_asset_volume
  FROM d_named
)"""

EVENT_SYMBOL = """(CASE event_type WHEN 'click' THEN 'BTC' WHEN 'view' THEN 'ETH' WHEN 'purchase' THEN 'BNB'
          WHEN 'signup' THEN 'ADA' WHEN 'error' THEN 'XRP' END)
     || '-' || (CASE WHEN event_type IN ('click', 'view') THEN 'USDT'
                     ELSE (['USDT', 'USDC', 'EUR', 'BTC'])[CAST(user_id % 4 AS INTEGER) + 1] END)"""

BARS_E = f"""
e_ev AS (
  SELECT date_trunc('hour', ts) AS open_time, ts, value, user_id,
         {EVENT_SYMBOL} AS symbol,
         user_id % 10 + 1 AS qty,
         CAST(round(value * 100) AS BIGINT) * (user_id % 10 + 1) AS qcents
  FROM events
),
bars_e AS (
  SELECT open_time, symbol,
         NULLIF(split_part(symbol, '-', 1), '') AS base_asset,
         NULLIF(split_part(symbol, '-', 2), '') AS quote_asset,
         arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close,
         CAST(sum(qty) AS DOUBLE) AS volume,
         CAST(sum(qcents) AS DOUBLE) / 100.0 AS quote_asset_volume,
         count(*) AS number_of_trades,
         CAST(sum(CASE WHEN user_id % 2 = 1 THEN qty ELSE 0 END) AS DOUBLE) AS taker_buy_base_asset_volume,
         CAST(sum(CASE WHEN user_id % 2 = 1 THEN qcents ELSE 0 END) AS DOUBLE) / 100.0 AS taker_buy_quote_asset_volume
  FROM e_ev GROUP BY open_time, symbol
)"""

TRADES_E = f"""
trades_e AS (
  SELECT {EVENT_SYMBOL} AS symbol, event_id AS id, value AS price,
         CAST(user_id % 10 + 1 AS DOUBLE) AS qty, value * CAST(user_id % 10 + 1 AS DOUBLE) AS quote_qty,
         ts AS time, (user_id % 2 = 0) AS is_buyer_maker, true AS is_best_match
  FROM events
)"""


def features(src: str, name: str) -> str:
    """CTEs ``{name}`` = features over bar CTE ``src`` (plain window lag)."""
    return f"""
{name}_p AS (
  SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY open_time) AS prev_close FROM {src}
),
{name}_r AS (
  SELECT *, CASE WHEN prev_close IS NOT NULL AND close > 0 AND prev_close > 0
                 THEN ln(close / prev_close) END AS log_return
  FROM {name}_p
),
{name} AS (
  SELECT * EXCLUDE (prev_close),
    CASE WHEN quote_asset_volume > 0 THEN taker_buy_quote_asset_volume / quote_asset_volume
         ELSE CAST(0.0 AS DOUBLE) END AS taker_ratio,
    CASE WHEN quote_asset_volume > 0 AND log_return IS NOT NULL
         THEN abs(log_return) / quote_asset_volume END AS amihud_illiq,
    (volume = 0 OR volume IS NULL) AS zero_volume_flag,
    CASE WHEN high > 0 AND low > 0 AND high >= low
         THEN (CAST(1.0 AS DOUBLE) / (CAST(4.0 AS DOUBLE) * CAST(0.6931471805599453 AS DOUBLE)))
              * (ln(high / low) * ln(high / low)) END AS parkinson_var_1m
  FROM {name}_r
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


def final(inner: str, cols: Iterable[str], doubles: Iterable[str] = ()) -> str:
    """Wrap ``inner`` (a SELECT) so that listed double columns are rounded canonically."""
    dbl = set(doubles)
    sel = [f"CAST({round_sig_sql(c, dialect='duckdb')} AS DOUBLE) AS {c}" if c in dbl else c for c in cols]
    return f"SELECT {', '.join(sel)} FROM (\n{inner}\n) AS t"


def tier_case(col: str = "base_asset", caps=("BTC", "ETH")) -> str:
    lst = ", ".join(f"'{c}'" for c in caps)
    return f"CASE WHEN {col} IN ({lst}) THEN 'LARGE_CAP' ELSE 'SMALL_CAP' END"


QUALITY_SQL = """count(*) AS n_bars,
  avg(quote_asset_volume) AS avg_quote_volume,
  quantile_disc(quote_asset_volume, 0.5) AS median_quote_volume,
  avg(amihud_illiq) AS avg_amihud,
  quantile_disc(amihud_illiq, 0.95) AS p95_amihud,
  avg(CAST(zero_volume_flag AS DOUBLE)) AS zero_volume_ratio,
  avg(parkinson_var_1m) AS avg_parkinson_vol,
  quantile_disc(parkinson_var_1m, 0.95) AS p95_parkinson_vol,
  avg(abs(log_return)) AS avg_abs_return"""
QUALITY_COLS = ["n_bars", "avg_quote_volume", "median_quote_volume", "avg_amihud", "p95_amihud",
                "zero_volume_ratio", "avg_parkinson_vol", "p95_parkinson_vol", "avg_abs_return"]


def stress_minutes_ctes(feat: str = "feat_d", q: float = 0.95) -> str:
    return f"""
pick AS (
  SELECT open_time, symbol AS btc_symbol, parkinson_var_1m AS btc_parkinson_var_1m FROM (
    SELECT *, row_number() OVER (PARTITION BY open_time
             ORDER BY CASE WHEN symbol = 'BTC-USDT' THEN 0 ELSE 1 END, symbol) AS rn
    FROM {feat} WHERE symbol LIKE 'BTC-%') AS b
  WHERE rn = 1
),
thr AS (SELECT quantile_disc(btc_parkinson_var_1m, {q}) AS threshold FROM pick),
sm AS (SELECT pick.*, pick.btc_parkinson_var_1m >= thr.threshold AS is_stress FROM pick, thr)"""


def stress_days_ctes(feat: str = "feat_d", q: float = 0.95) -> str:
    return f"""
daily AS (
  SELECT CAST(open_time AS DATE) AS date, avg(parkinson_var_1m) AS btc_daily_vol
  FROM {feat} WHERE base_asset = 'BTC' GROUP BY 1
),
dthr AS (SELECT quantile_disc(btc_daily_vol, {q}) AS thr FROM daily),
sdays AS (SELECT daily.date, daily.btc_daily_vol, daily.btc_daily_vol >= dthr.thr AS is_stress FROM daily, dthr)"""


def shock_ctes(feat: str = "feat_e", q: float = 0.95, lags=(0, 1, 5, 15, 30, 60, 120), unit: str = "hours",
               min_shock: int = 40, min_noshock: int = 280) -> str:
    lag_list = ", ".join(str(x) for x in lags)
    to_iv = {"minutes": "to_minutes", "hours": "to_hours", "days": "to_days"}[unit]
    return f"""
sthr AS (
  SELECT symbol, CAST(quantile_disc(number_of_trades, {q}) AS DOUBLE) AS threshold
  FROM {feat} WHERE symbol IN ('BTC-USDT', 'ETH-USDT') GROUP BY symbol
),
cal AS (
  SELECT f.open_time, max(COALESCE(CAST(f.number_of_trades >= t.threshold AS INTEGER), 0)) AS any_shock
  FROM {feat} f LEFT JOIN sthr t ON f.symbol = t.symbol
  WHERE f.symbol IN ('BTC-USDT', 'ETH-USDT') GROUP BY f.open_time
),
lags AS (SELECT unnest([{lag_list}]) AS lag),
eff0 AS (
  SELECT r.symbol, l.lag,
    avg(CASE WHEN c.any_shock = 1 THEN r.parkinson_var_1m END) AS vol_on_shock,
    avg(CASE WHEN c.any_shock = 0 THEN r.parkinson_var_1m END) AS vol_on_noshock,
    avg(CASE WHEN c.any_shock = 1 THEN r.amihud_illiq END) AS illiq_on_shock,
    avg(CASE WHEN c.any_shock = 0 THEN r.amihud_illiq END) AS illiq_on_noshock,
    count(CASE WHEN c.any_shock = 1 THEN 1 END) AS n_shock_obs,
    count(CASE WHEN c.any_shock = 0 THEN 1 END) AS n_noshock_obs
  FROM {feat} r CROSS JOIN lags l
  JOIN cal c ON c.open_time = r.open_time - {to_iv}(l.lag)
  WHERE r.symbol NOT IN ('BTC-USDT', 'ETH-USDT')
  GROUP BY r.symbol, l.lag
),
eff AS (
  SELECT *, vol_on_shock - vol_on_noshock AS delta_vol, illiq_on_shock - illiq_on_noshock AS delta_illiq
  FROM eff0 WHERE n_shock_obs > {min_shock} AND n_noshock_obs > {min_noshock}
)"""


EFFECT_COLS = ["symbol", "lag", "vol_on_shock", "vol_on_noshock", "illiq_on_shock", "illiq_on_noshock",
               "n_shock_obs", "n_noshock_obs", "delta_vol", "delta_illiq"]
EFFECT_DOUBLES = ["vol_on_shock", "vol_on_noshock", "illiq_on_shock", "illiq_on_noshock", "delta_vol", "delta_illiq"]
LEV_REGEX = "(UP|DOWN|BULL|BEAR)(-|$)"


def best_ctes(min_obs: int = 45) -> str:
    def one(metric: str) -> str:
        return f"""
best_{metric} AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY {metric} DESC NULLS LAST, lag ASC) AS rn
    FROM eff WHERE n_shock_obs >= {min_obs} AND NOT regexp_matches(symbol, '{LEV_REGEX}')) AS b
  WHERE rn = 1
)"""
    return one("delta_vol") + "," + one("delta_illiq")


LEV_CONTAINS = "(upper(symbol) LIKE '%UP%' OR upper(symbol) LIKE '%DOWN%' OR upper(symbol) LIKE '%BULL%' OR upper(symbol) LIKE '%BEAR%')"


def beta_ctes(feat: str = "feat_d", min_rows: int = 850, regime_min: int = 230, hyper_q: float = 0.75) -> str:
    def beta_sel(extra: str = "") -> str:
        return (f"symbol, base_asset, quote_asset{extra}, n, CASE WHEN abs(var_x) > 1e-18 THEN cov_xy / var_x END AS beta, "
                "var_x, cov_xy, mean_x, mean_y")
    mom = ("count(*) AS n, var_pop(btc_ret) AS var_x, covar_pop(ret, btc_ret) AS cov_xy, avg(btc_ret) AS mean_x, "
           "avg(ret) AS mean_y")
    return f"""
u AS (
  SELECT open_time, symbol, base_asset, quote_asset, close, log_return FROM {feat}
  WHERE open_time IS NOT NULL AND symbol IS NOT NULL AND log_return IS NOT NULL
    AND quote_asset IN ('USDT', 'USDC', 'USD', 'EUR') AND NOT (quote_asset = 'BTC')
    AND NOT {LEV_CONTAINS}
),
btc AS (SELECT open_time, close AS btc_close, log_return AS btc_ret FROM u WHERE symbol = 'BTC-USDT'),
dclose AS (SELECT CAST(open_time AS DATE) AS date, arg_max(btc_close, open_time) AS btc_daily_close FROM btc GROUP BY 1),
reg0 AS (
  SELECT d.date, CASE WHEN l.btc_daily_close IS NOT NULL AND l.btc_daily_close > 0
                      THEN d.btc_daily_close / l.btc_daily_close - 1.0 END AS btc_ret_30d
  FROM dclose d LEFT JOIN dclose l ON d.date = l.date + 30
),
reg AS (
  SELECT date, btc_ret_30d,
         CASE WHEN btc_ret_30d >= 0.1 THEN 'BULL' WHEN btc_ret_30d <= -0.1 THEN 'BEAR' ELSE 'NEUTRAL' END AS regime
  FROM reg0
),
j AS (
  SELECT r.open_time, r.symbol, r.base_asset, r.quote_asset, r.log_return AS ret, b.btc_ret, g.regime
  FROM u r JOIN btc b ON r.open_time = b.open_time JOIN reg g ON CAST(r.open_time AS DATE) = g.date
  WHERE r.symbol <> 'BTC-USDT'
),
bo AS (SELECT symbol, base_asset, quote_asset, {mom} FROM j GROUP BY ALL HAVING count(*) >= {min_rows}),
overall AS (SELECT {beta_sel()} FROM bo),
br AS (SELECT symbol, base_asset, quote_asset, regime, {mom} FROM j GROUP BY ALL HAVING count(*) >= {regime_min}),
byreg AS (SELECT {beta_sel(', regime')} FROM br),
piv AS (
  SELECT symbol, base_asset, quote_asset,
         max(CASE WHEN regime = 'BULL' THEN beta END) AS beta_bull,
         max(CASE WHEN regime = 'BEAR' THEN beta END) AS beta_bear,
         max(CASE WHEN regime = 'NEUTRAL' THEN beta END) AS beta_neutral
  FROM byreg GROUP BY ALL
),
bpiv AS (SELECT *, beta_bear - beta_bull AS delta_beta_bear_minus_bull FROM piv),
hcut AS (SELECT quantile_disc(beta, {hyper_q}) AS cut FROM overall WHERE beta IS NOT NULL)"""


BETA_OUT = ["symbol", "base_asset", "quote_asset", "n", "beta", "var_x", "cov_xy", "mean_x", "mean_y"]
BETA_DBL = ["beta", "var_x", "cov_xy", "mean_x", "mean_y"]
