"""Trailing moments, vector autoregressions and structural breaks against plain versions."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickstat.operators import ext, var
from tickstat.operators.breaks import structural_breaks
from tickstat.operators.series import lagged_values, rolling, trailing_moments

START = dt.datetime(2024, 1, 30, 23, 0)


def _series(spark, rows, names="symbol string, open_time timestamp_ntz, ret double, btc_ret double"):
    return spark.createDataFrame(rows, names).repartition(6)


@pytest.mark.parametrize("seconds,most", [(3600, 86400), (5 * 3600, 3600), (7 * 3600 + 1, 2000), (40 * 86400, 30 * 86400)])
def test_trailing_moments_equal_the_sliding_frame(spark, seconds, most):
    rng = np.random.default_rng(seconds)
    rows = []
    for s, n in (("A-B", 300), ("C-D", 60), ("E-F", 1)):
        at = np.sort(rng.integers(0, 4 * 86400, n))  # some at the same second, and gaps
        at[n // 2 :] += 86400
        for t in at.tolist():
            y, x = (None if rng.random() < 0.1 else float(v) for v in rng.normal(1e3, 1, 2))
            rows.append((s, START + dt.timedelta(seconds=t), y, x))
    frame = _series(spark, rows)
    wanted = rolling(frame, {"n": F.count("ret"), "cov": F.covar_pop("ret", "btc_ret"), "v": F.var_pop("btc_ret")}, seconds)
    m = F.col("_m")
    got = trailing_moments(frame, "ret", "btc_ret", seconds, most=most).select("symbol", "open_time", m["ny"].alias("n"), F.when(m["n"] > 0, m["c"] / m["n"]).alias("cov"), F.when(m["nx"] > 0, m["v"] / m["nx"]).alias("v"))
    order = lambda df: sorted((r.symbol, r.open_time, r.n, r.cov, r.v) for r in df.select("symbol", "open_time", "n", F.coalesce("cov", F.lit(-1.0)).alias("cov"), F.coalesce("v", F.lit(-1.0)).alias("v")).collect())
    a, b = order(got), order(wanted)
    assert [x[:3] for x in a] == [x[:3] for x in b]
    assert np.allclose([x[3:] for x in a], [x[3:] for x in b], rtol=1e-9, atol=1e-9)


def test_rolling_beta_has_no_sliding_frame(spark):
    frame = _series(spark, [("A-B", START, 0.1, 0.2)])
    plan = ext.rolling_beta(frame, 30 * 86400)._jdf.queryExecution().executedPlan().toString()
    frames = [p for p in plan.split("specifiedwindowframe(")[1:]]
    assert frames and all(p.startswith("RangeFrame, unboundedpreceding") for p in frames)


def test_lagged_values_over_buckets(spark):
    """Buckets with fewer rows than lags, and empty months between."""
    at = [dt.datetime(2024, m, d) for m, d in ((1, 30), (1, 31), (2, 1), (3, 5), (7, 1), (7, 2), (7, 3), (7, 4), (8, 1))]
    rows = [(s, t, None if i == 3 else float(i)) for s in ("a", "b") for i, t in enumerate(at)]
    got = lagged_values(spark.createDataFrame(rows, "symbol string, open_time timestamp_ntz, v double"), ["v"], 4).collect()
    value = {(r[0], r[1]): r[2] for r in rows}
    for r in got:
        i = at.index(r.open_time)
        assert [r[f"v_{j}"] for j in range(1, 5)] == [value[r.symbol, at[i - j]] if i >= j else None for j in range(1, 5)]


def _plain_var(y, x, p_max, horizon, criterion):
    best = None
    for p in range(1, p_max + 1):
        t = np.arange(p_max, len(y))
        z = np.stack([np.ones(len(t))] + [v[t - j] for j in range(1, p + 1) for v in (y, x)], axis=1)
        w = np.stack([y[t], x[t]], axis=1)
        coef = np.linalg.lstsq(z, w, rcond=None)[0]
        e = w - z @ coef
        sigma = e.T @ e / len(t)
        cost = np.log(np.linalg.det(sigma)) + 4 * p * (2 if criterion == "aic" else np.log(len(t))) / len(t)
        if best is None or cost < best[1]:
            a = [coef[1 + 2 * j : 3 + 2 * j].T for j in range(p)]
            chol = np.linalg.cholesky(sigma[::-1, ::-1])[::-1, ::-1]  # BTC first
            psi = [np.eye(2)]
            for h in range(1, horizon + 1):
                psi.append(sum(a[j] @ psi[h - 1 - j] for j in range(min(p, h))))
            r = np.array([(m @ chol)[0] for m in psi])
            best = (p, cost, r[:, 1].tolist(), (r[:, 1] ** 2).sum() / (r**2).sum())
    return best


@pytest.mark.parametrize("p_max,criterion", [(1, "bic"), (2, "bic"), (3, "aic"), (4, "bic")])
def test_var(spark, p_max, criterion):
    rng = np.random.default_rng(p_max)
    rows, wanted = [], {}
    for s in range(3):
        n = 400
        y, x = np.zeros(n), np.zeros(n)
        for t in range(n):
            x[t] = 0.3 * x[t - 1] + rng.normal()
            y[t] = 0.5 * y[t - 1] * (t > 0) + (0.6 if s else 0.0) * x[t - p_max] * (t >= p_max) + 0.4 * x[t] + rng.normal()
        y, x = y * 0.01 + 0.2, x * 0.01
        rows += [(f"s{s}", START + dt.timedelta(hours=5 * t), float(y[t]), float(x[t])) for t in range(n)]
        wanted[f"s{s}"] = _plain_var(y, x, p_max, 5, criterion)
    rows += [("flat", START + dt.timedelta(hours=t), 0.5, 0.25) for t in range(60)] + [("few", START, 1.0, 1.0)]
    got = {r.symbol: r for r in var.var_irf(_series(spark, rows), p_max, 5, criterion).collect()}
    assert set(got) == {*wanted, "flat"}
    assert got["flat"].p is None and got["flat"].fevd is None and got["flat"].irf_0 is None
    for s, (p, cost, irf, fevd) in wanted.items():
        assert got[s].p == p and got[s].n == 400 - p_max
        assert np.allclose([got[s][criterion], got[s].fevd, *[got[s][f"irf_{h}"] for h in range(6)]], [cost, fevd, *irf], rtol=1e-6, atol=1e-12)
    if p_max == 4:
        assert got["s1"].p == 4


def test_structural_breaks(spark):
    rng = np.random.default_rng(8)
    n = 900
    level = {"two": np.repeat([100, 160, 90], n // 3), "one": np.where(np.arange(n) < 250, 50, 80), "flat": np.full(n, 100), "still": np.full(n, 7)}
    rows = [(s, START + dt.timedelta(hours=3 * i), int(v + (rng.normal() * 8 if s != "still" else 0))) for s, lv in level.items() for i, v in enumerate(lv)]
    rows += [("short", START + dt.timedelta(hours=i), i) for i in range(40)] + [("one", START - dt.timedelta(hours=1), None)]
    frame = _series(spark, rows, "symbol string, open_time timestamp_ntz, number_of_trades bigint")
    got = structural_breaks(frame).collect()
    places = {s: sorted(r.break_place for r in got if r.symbol == s) for s in level}
    assert places["flat"] == [] and places["still"] == [] and not any(r.symbol == "short" for r in got)
    assert len(places["two"]) == 2 and all(abs(a - b) <= 8 for a, b in zip(places["two"], (300, 600)))
    assert len(places["one"]) == 1 and abs(places["one"][0] - 250) <= 8
    for r in got:
        assert r.statistic > 1.358 and r.seg_start < r.break_place < r.seg_end and r.break_time == START + dt.timedelta(hours=3 * (r.break_place - 1))
        x = np.array([v[2] for v in rows if v[0] == r.symbol and v[2] is not None], float)
        assert abs(r.mean_before - x[r.seg_start : r.break_place].mean()) < 1e-9 and abs(r.mean_after - x[r.break_place : r.seg_end].mean()) < 1e-9
    assert {r.round for r in got if r.symbol == "two"} == {1, 2}
    assert structural_breaks(frame.where("false")).collect() == []
    assert [r.symbol for r in structural_breaks(frame, ["one"]).collect()] == ["one"]


def test_distribution_summary_is_its_two_tables(spark, sf_small):
    from tickstat.operators import dist, stress
    from tickstat.operators.features import bar_features
    from tickstat.sources.fixtures import daily_bars

    labelled = stress.label_stress_minutes(bar_features(daily_bars(spark, sf_small)), stress.StressParams(exact=True))
    compare = stress.market_quality(labelled, ["tier", "is_stress"], True)
    rows = lambda df: sorted(map(str, df.collect()))
    for given in (None, compare):
        plot, box = dist.distribution_summary(labelled, given, exact=True)
        assert plot.columns == dist.plot_table(compare).columns and rows(plot.select("tier")) == rows(dist.plot_table(compare).select("tier"))
        assert rows(box.select("tier", "is_stress", "metric")) == rows(dist.box_stats(labelled, exact=True).select("tier", "is_stress", "metric"))
