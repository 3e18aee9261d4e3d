"""Command-line entry points (``spark-submit -m``-style): one subcommand per
research job, parameters as flags.

    python -m tickstat features --raw DIR --out DIR [--max-files N]
    python -m tickstat quality|stress|shock|beta --features DIR --out DIR [...]
    python -m tickstat all --raw DIR --out DIR

The session comes from ``SparkSession.builder.getOrCreate()``, so master and
configuration come from spark-submit; the CLI never stops a session it did
not create.
"""

from __future__ import annotations

import argparse
import sys

from tickstat.operators import beta as B
from tickstat.operators import shock as K
from tickstat.operators import stress as S
from tickstat.operators.ext import trades_to_bars
from tickstat.plans import research as R
from tickstat.sources.trades import read_trades


def _names(s: str) -> tuple:
    return tuple(x.strip() for x in s.split(",") if x.strip())


def _ints(s: str) -> tuple:
    """``0,1,5`` or ranges, ends included: ``0-120``."""
    out = []
    for part in filter(None, (x.strip() for x in s.split(","))):
        first, dash, last = part.partition("-")
        out += range(int(first), int(last) + 1) if dash and first else [int(part)]
    return tuple(out)


def build_parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="tickstat")
    sub = ap.add_subparsers(dest="job", required=True)
    f = sub.add_parser("features", help="candles -> features table")
    f.add_argument("--raw", required=True, help="folder of candle files, or of trade files with --trades")
    f.add_argument("--trades", metavar="WIDTH", default=None, help="the files hold trades: make bars of this width first, e.g. '1 minute'")
    f.add_argument("--out", required=True)
    f.add_argument("--max-files", type=int, default=None)
    for name in ("quality", "stress", "shock", "beta"):
        p = sub.add_parser(name)
        p.add_argument("--features", required=True)
        p.add_argument("--out", required=True)
    a = sub.add_parser("all", help="features, then every research job")
    a.add_argument("--raw", required=True)
    a.add_argument("--trades", metavar="WIDTH", default=None)
    a.add_argument("--out", required=True)
    a.add_argument("--max-files", type=int, default=None)
    for p in (sub.choices["stress"], sub.choices["shock"], sub.choices["beta"], a):
        p.add_argument("--exact", action="store_true", help="exact quantiles instead of percentile_approx")
    for p in (sub.choices["stress"], a):
        p.add_argument("--stress-q", type=float, default=0.95)
        p.add_argument("--large-caps", type=_names, default=None, help="comma list for both grains (default: 14 assets per minute, BTC,ETH per day)")
    for p in (sub.choices["shock"], a):
        p.add_argument("--shock-q", type=float, default=0.99)
        p.add_argument("--lags", type=_ints, default=K.LAGS)
        p.add_argument("--receivers", type=_names, default=None)
        p.add_argument("--min-shock-obs", type=int, default=200)
        p.add_argument("--keep-leveraged", action="store_true")
    for p in (sub.choices["beta"], a):
        p.add_argument("--min-rows", type=int, default=50000)
        p.add_argument("--hyper-q", type=float, default=0.95)
        p.add_argument("--bull", type=float, default=0.10)
        p.add_argument("--bear", type=float, default=0.10)
        p.add_argument("--btc-symbol", default="BTC-USDT")
    return ap


def _stress(a) -> S.StressParams:
    kw = dict(q=a.stress_q, exact=a.exact)
    if a.large_caps:
        kw["large_caps"] = kw["day_large_caps"] = a.large_caps
    return S.StressParams(**kw)


def _shock(a) -> K.ShockParams:
    return K.ShockParams(q=a.shock_q, lags=a.lags, receivers=a.receivers, exact=a.exact)


def _beta(a) -> B.BetaParams:
    return B.BetaParams(min_rows=a.min_rows, hyper_q=a.hyper_q, bull=a.bull, bear=a.bear,
                        btc_symbol=a.btc_symbol, exact=a.exact)


def main(argv: list[str] | None = None, spark=None) -> int:
    a = build_parser().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName(f"tickstat-{a.job}").getOrCreate()
    if a.job in ("features", "all"):
        raw = trades_to_bars(read_trades(spark, a.raw), a.trades) if a.trades else a.raw
        feat = R.features_job(spark, raw, a.out, max_files=a.max_files)
    else:
        feat = a.features
    if a.job in ("quality", "all"):
        R.quality_job(spark, feat, a.out)
    if a.job in ("stress", "all"):
        R.stress_job(spark, feat, a.out, _stress(a))
    if a.job in ("shock", "all"):
        R.shock_job(spark, feat, a.out, _shock(a), a.min_shock_obs, not a.keep_leveraged)
    if a.job in ("beta", "all"):
        R.beta_job(spark, feat, a.out, _beta(a))
    return 0


if __name__ == "__main__":
    sys.exit(main())
