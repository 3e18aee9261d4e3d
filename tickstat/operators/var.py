"""Vector autoregression of (receiver return, BTC return) per symbol, any order.

All second moments of the two series and their lags come from one grouped
aggregate (centred, mergeable, partial per task). What is left is one small
matrix per symbol; a batch of symbols is solved at once by Cholesky factors.
The order is chosen by an information criterion on a common sample. Shocks are
orthogonalised with BTC first: a BTC shock may move the receiver at once, a
receiver's own shock doesn't move BTC at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickstat.operators.series import lagged_values

CRITERIA = ("aic", "bic")


def lag_moments(joined: DataFrame, p_max: int, y: str = "ret", x: str = "btc_ret", unit: str = "month") -> DataFrame:
    """symbol, n, and ``_c``: covariances (upper triangle, row by row) of
    y, x, y_1, x_1, ..., y_p, x_p over the rows where all of them are known."""
    d = lagged_values(joined.select("symbol", "open_time", y, x), [y, x], p_max, unit=unit)
    names = [y, x] + [f"{v}_{j}" for j in range(1, p_max + 1) for v in (y, x)]
    d = d.dropna(subset=names)
    pairs = [F.covar_pop(a, b) for i, a in enumerate(names) for b in names[i:]]
    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.array(*pairs).alias("_c"))


def cholesky(m: np.ndarray, least: float = 1e-12) -> np.ndarray:
    """Lower factors of symmetric matrices (batch x k x k); nan where a pivot is
    not above ``least`` of its own variance (collinear or constant series)."""
    low = np.zeros_like(m)
    with np.errstate(invalid="ignore", divide="ignore"):
        for j in range(m.shape[1]):
            left = m[:, j, j] - (low[:, j, :j] ** 2).sum(axis=1)
            low[:, j, j] = np.where(left > least * m[:, j, j], np.sqrt(np.maximum(left, 0)), np.nan)
            for i in range(j + 1, m.shape[1]):
                low[:, i, j] = (m[:, i, j] - (low[:, i, :j] * low[:, j, :j]).sum(axis=1)) / low[:, j, j]
    return low


def solve(m: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """m^-1 rhs for batches of positive definite matrices."""
    low = cholesky(m)
    z = np.zeros_like(rhs)
    k = m.shape[1]
    for i in range(k):
        z[:, i] = (rhs[:, i] - np.einsum("nj,njc->nc", low[:, i, :i], z[:, :i])) / low[:, i, i, None]
    for i in range(k - 1, -1, -1):
        z[:, i] = (z[:, i] - np.einsum("nj,njc->nc", low[:, i + 1 :, i], z[:, i + 1 :])) / low[:, i, i, None]
    return z


def estimate(cov: np.ndarray, n: np.ndarray, p_max: int, horizon: int, criterion: str) -> dict[str, np.ndarray]:
    """Order, criterion value, responses of y to an orthogonal x shock (0..horizon)
    and the share of y's forecast error variance that x shocks explain."""
    rows = len(n)
    best = np.full(rows, np.inf)
    out = {"p": np.full(rows, np.nan), criterion: np.full(rows, np.nan), "fevd": np.full(rows, np.nan)}
    out |= {f"irf_{h}": np.full(rows, np.nan) for h in range(horizon + 1)}
    for p in range(1, p_max + 1):
        at = np.arange(2, 2 + 2 * p)
        coef = solve(cov[:, at[:, None], at], cov[:, at, :2])  # rows: y_1, x_1, y_2, ...; columns: y, x
        sigma = cov[:, :2, :2] - np.einsum("nkc,nkd->ncd", coef, cov[:, at, :2])
        with np.errstate(invalid="ignore", divide="ignore"):
            sxx, syy, sxy = sigma[:, 1, 1], sigma[:, 0, 0], sigma[:, 0, 1]
            det = sxx * syy - sxy**2
            cost = np.log(det) + 4 * p * (2.0 if criterion == "aic" else np.log(n)) / n
            better = np.isfinite(cost) & (cost < best)
            impact = {"x": (sxy / np.sqrt(sxx), np.sqrt(sxx)), "y": (np.sqrt(det / sxx), np.zeros(rows))}
        path = {}
        for shock, first in impact.items():
            r = [np.stack(first, axis=1)]
            for h in range(1, horizon + 1):
                r.append(sum(np.einsum("nkc,nk->nc", coef[:, 2 * j : 2 * j + 2], r[h - 1 - j]) for j in range(min(p, h))))
            path[shock] = np.stack([v[:, 0] for v in r], axis=1)
        of_x, of_y = (path["x"] ** 2).sum(axis=1), (path["y"] ** 2).sum(axis=1)
        new = {"p": np.full(rows, float(p)), criterion: cost, "fevd": of_x / (of_x + of_y)} | {f"irf_{h}": path["x"][:, h] for h in range(horizon + 1)}
        for name, value in new.items():
            out[name] = np.where(better, value, out[name])
        best = np.where(better, cost, best)
    return out


def var_irf(joined: DataFrame, p_max: int = 4, horizon: int = 5, criterion: str = "bic", min_n: int = 30, y: str = "ret", x: str = "btc_ret",
            unit: str = "month") -> DataFrame:
    """symbol, n, p (chosen order), the criterion's value, irf_0..irf_<horizon> and fevd.
    All are null where no order has a regular solution. Symbols with fewer than ``min_n`` complete rows are left out."""
    if criterion not in CRITERIA:
        raise ValueError(f"criterion must be one of {CRITERIA}, got {criterion!r}")
    if p_max < 1:
        raise ValueError("p_max must be at least 1")
    moments = lag_moments(joined, p_max, y, x, unit).where(F.col("n") >= min_n)
    k = 2 + 2 * p_max
    upper = np.triu_indices(k)
    names = [criterion, *[f"irf_{h}" for h in range(horizon + 1)], "fevd"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cov = np.zeros((len(batch), k, k))
            if len(batch):
                cov[:, upper[0], upper[1]] = cov[:, upper[1], upper[0]] = np.stack(batch["_c"].to_numpy())
            got = estimate(cov, batch["n"].to_numpy(float), p_max, horizon, criterion)
            frame = pd.DataFrame({"symbol": batch["symbol"], "n": batch["n"], "p": pd.array(np.nan_to_num(got["p"]), "Int64")})
            frame["p"] = frame["p"].mask(frame["p"] == 0)
            yield frame.assign(**{c: got[c] for c in names})

    out = moments.mapInPandas(run, "symbol string, n bigint, p bigint, " + ", ".join(f"{c} double" for c in names))
    return out.select("symbol", "n", "p", *[F.when(F.col("p").isNotNull(), F.col(c)).alias(c) for c in names])
