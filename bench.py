"""Benchmark of the headline operators.

Reads ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]``
and prints one JSON line: {"metric", "value", "unit", "queries", "sf"}.

As in production, bar features are computed once and written as a table
(under the session's checkpoint folder); then each research job reads that
table and writes all of its outputs (Parquet, CSV). The figure per job is the
median of the timed runs after one warm-up run. Quantiles use the production
mode (``percentile_approx`` with the reference's accuracies); ``BENCH_EXACT=1``
measures the exact distributed selection instead.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickstat.session import ensure_checkpoint_dir, local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    spark = local_session(cores=CPUS, shuffle_partitions=int(CPUS) if CPUS.isdigit() else 8, app="tickstat-bench")
    from dataclasses import replace

    from tickstat.operators import stress as S
    from tickstat.operators.features import bar_features
    from tickstat.plans import research as R
    from tickstat.plans.catalog import BETA_TEST, MIN_OBS_TEST, SHOCK_TEST

    # the fixtures' thresholds and minimums, production quantile mode
    exact = os.environ.get("BENCH_EXACT", "0") == "1"
    stress_p = S.StressParams(exact=exact)
    shock_p = replace(SHOCK_TEST, exact=exact)
    beta_p = replace(BETA_TEST, exact=exact)
    from tickstat.sources.fixtures import daily_bars, hourly_bars

    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/bench-{uuid.uuid4().hex[:8]}"
    paths = {"d": f"{base}/features_daily", "e": f"{base}/features_hourly"}

    def build_features():
        R.run_concurrently([
            lambda: bar_features(daily_bars(spark, SF_DIR)).write.mode("overwrite").parquet(paths["d"]),
            lambda: bar_features(hourly_bars(spark, SF_DIR)).write.mode("overwrite").parquet(paths["e"]),
        ])

    def fd():
        return paths["d"]

    def fe():
        return paths["e"]

    out = f"{base}/out"
    queries = {
        "features": build_features,
        "quality_job": lambda: R.quality_job(spark, fd(), out),
        "stress_job": lambda: R.stress_job(spark, fd(), out, stress_p),
        "shock_job": lambda: R.shock_job(spark, fe(), out, shock_p, MIN_OBS_TEST),
        "beta_job": lambda: R.beta_job(spark, fd(), out, beta_p),
    }
    times: dict[str, list[float]] = {k: [] for k in queries}
    for run in range(RUNS + 1):
        for name, fn in queries.items():
            t0 = time.perf_counter()
            fn()
            if run > 0:
                times[name].append(time.perf_counter() - t0)
    med = {k: round(statistics.median(v), 3) for k, v in times.items()}
    sf = os.path.basename(SF_DIR).removeprefix("sf")
    print(json.dumps({"metric": "headline_total_median", "value": round(sum(med.values()), 3), "unit": "sec",
                      "queries": med, "sf": sf, "cpus": CPUS, "runs": RUNS,
                      "quantiles": "exact" if exact else "approx"}))


if __name__ == "__main__":
    main()
