"""End-to-end research jobs: what a user of the reference runs.

Each job reads a table, runs operators and writes its outputs with the sinks.
Intermediate tables that several outputs reuse (features, lag effects,
betas) are written once and read back, which also cuts the lineage: a lost
executor never forces recomputation from the raw candles.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from tickstat.operators import beta as B
from tickstat.operators import dist as D
from tickstat.operators import shock as K
from tickstat.operators import stress as S
from tickstat.operators.features import bar_features, layout_by_symbol
from tickstat.operators.lagscan import lag_scan
from tickstat.operators.quality import quality_report
from tickstat.session import require_utc
from tickstat.sources.candles import read_candles
from tickstat.sources.sinks import write_csv, write_small, write_table

MANY_LAGS = 16  # beyond this the lag scan reads fewer expanded rows


def run_concurrently(tasks: list[Callable[[], None]], workers: int = 4) -> None:
    """Submit independent outputs as concurrent Spark jobs (the scheduler
    interleaves their tasks); errors are re-raised."""
    if workers <= 1 or len(tasks) <= 1:
        for t in tasks:
            t()
        return
    with ThreadPoolExecutor(max_workers=min(workers, len(tasks))) as pool:
        for f in [pool.submit(t) for t in tasks]:
            f.result()


def features_job(spark: SparkSession, raw: str | DataFrame, out: str, max_files: int | None = None,
                 bucket: str = "month", layout: str = "sort") -> str:
    """Candles (folder of <BASE>-<QUOTE>.parquet or a DataFrame) -> features
    table, written straight from the window's partitioning (no extra
    shuffle with the default layout)."""
    require_utc(spark)
    candles = raw if isinstance(raw, DataFrame) else read_candles(spark, raw, max_files=max_files)
    write_table(layout_by_symbol(bar_features(candles, bucket), layout), f"{out}/features_1m", rebalance=False)
    return f"{out}/features_1m"


def quality_job(spark: SparkSession, features: str, out: str) -> None:
    require_utc(spark)
    write_small(quality_report(spark.read.parquet(features)), f"{out}/quality_report")


def stress_job(spark: SparkSession, features: str, out: str, p: S.StressParams = S.StressParams(),
               workers: int = 4) -> None:
    """RQ1: tier x stress-minute comparison (Parquet + one CSV), plot table,
    stress-day summary and box statistics."""
    require_utc(spark)
    f = spark.read.parquet(features)
    labelled = S.label_stress_minutes(f, p)          # threshold computed once

    def compare_branch():
        write_small(S.market_quality(labelled, ["tier", "is_stress"], p.exact, p.accuracy), f"{out}/rq1_compare")
        compare = spark.read.parquet(f"{out}/rq1_compare")
        write_csv(compare, f"{out}/rq1_compare_csv")
        write_small(D.plot_table(compare), f"{out}/rq1_plot_table")

    run_concurrently([
        compare_branch,
        lambda: write_small(S.stress_day_summary(f, p), f"{out}/rq1_results"),
        lambda: write_small(D.box_stats(labelled, exact=p.exact), f"{out}/rq1_box_stats"),
    ], workers)


def shock_job(spark: SparkSession, features: str, out: str, p: K.ShockParams = K.ShockParams(),
              min_shock_obs: int = 200, exclude_leveraged: bool = True, workers: int = 4) -> None:
    """RQ2: lag effects (written once), then best lags, stats and histograms.

    Many lags (e.g. every minute up to two hours) are scanned without expanding
    each receiver row by lag; the rows are the same."""
    require_utc(spark)
    f = spark.read.parquet(features)
    effects = lag_scan if len(p.lags) > MANY_LAGS else K.lag_effects
    write_small(effects(f, p), f"{out}/rq2_results/lag_effects", files=4)
    eff = spark.read.parquet(f"{out}/rq2_results/lag_effects")

    def summary():
        stats, hist = K.lag_summary(eff, min_shock_obs, exclude_leveraged, p.exact)
        write_small(stats, f"{out}/rq2_results/lag_typical_stats")
        write_small(hist, f"{out}/rq2_results/best_lag_hist")

    run_concurrently([
        lambda: write_small(K.best_lag(eff, "delta_vol", min_shock_obs, exclude_leveraged),
                            f"{out}/rq2_results/best_lag_by_vol"),
        lambda: write_small(K.best_lag(eff, "delta_illiq", min_shock_obs, exclude_leveraged),
                            f"{out}/rq2_results/best_lag_by_illiq"),
        summary,
    ], workers)


def beta_job(spark: SparkSession, features: str, out: str, p: B.BetaParams = B.BetaParams(),
             workers: int = 4) -> None:
    """RQ3: overall and regime betas in one aggregation (written once), then
    pivot, hyper-sensitive list, regime summary and top changes."""
    require_utc(spark)
    f = spark.read.parquet(features)
    write_small(B.regime_betas(f, p), f"{out}/rq3_results/betas_all")
    allb = spark.read.parquet(f"{out}/rq3_results/betas_all")
    overall, by_regime = B.betas_overall(allb), B.betas_by_regime(allb)
    pivot = B.beta_pivot(by_regime)
    run_concurrently([
        lambda: write_small(overall, f"{out}/rq3_results/betas_overall"),
        lambda: write_small(by_regime, f"{out}/rq3_results/betas_by_regime"),
        lambda: write_small(pivot, f"{out}/rq3_results/beta_pivot"),
        lambda: write_small(B.hyper_sensitive(overall, p), f"{out}/rq3_results/hyper_overall"),
        lambda: write_small(B.beta_regime_summary(by_regime, p.exact, p.summary_accuracy),
                            f"{out}/rq3_results/beta_regime_summary"),
        lambda: write_small(B.top_delta_beta(pivot), f"{out}/rq3_results/top_delta_beta"),
    ], workers)


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    """The first rows of a result, as a DataFrame (the caller shows it)."""
    return df.limit(n)


def schema_of(df: DataFrame) -> DataFrame:
    """A6 on any table (e.g. raw candles): column, type, nullable."""
    from tickstat.sources.candles import schema_report

    return schema_report(df)


__all__ = ["run_concurrently", "features_job", "quality_job", "stress_job", "shock_job", "beta_job", "preview",
           "schema_of"]
