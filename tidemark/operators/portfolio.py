"""Portfolio weights. Covariances are one aggregation in Spark; the matrix of the symbols, of a checked size, is solved on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .risk import correlations

MOST_SYMBOLS = 2000  # 32 MB of matrix
RIDGE = 1e-6


def shrunk(rets: DataFrame, delta: float = 0.2) -> DataFrame:
    """(a, b, covar) for a <= b: sample covariances on common days, those of two symbols times 1 - delta."""
    delta = min(max(delta, 0.0), 1.0)
    own = rets.where("ret is not null").groupBy(F.col("symbol").alias("a")).agg(F.var_samp("ret").alias("covar")).select("a", F.col("a").alias("b"), "covar")
    return correlations(rets).select("a", "b", (F.col("covar") * (1 - delta)).alias("covar")).unionByName(own)


def matrix(covariances: DataFrame) -> tuple[list[str], np.ndarray]:
    rows = covariances.limit(MOST_SYMBOLS * (MOST_SYMBOLS + 1) // 2 + 1).collect()
    names = sorted({r.a for r in rows} | {r.b for r in rows})
    if len(names) > MOST_SYMBOLS:
        raise ValueError(f"more than {MOST_SYMBOLS} symbols")
    at = {s: i for i, s in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in rows:
        m[at[r.a], at[r.b]] = m[at[r.b], at[r.a]] = r.covar or 0.0
    return names, m


def _normal(w: np.ndarray, long_only: bool = False) -> np.ndarray:
    w = np.clip(w, 0, None) if long_only else w
    return w / w.sum() if len(w) and w.sum() > 1e-12 else equal(len(w))


def equal(n: int) -> np.ndarray:
    return np.full(n, 1 / n) if n else np.zeros(0)


def inverse_volatility(cov: np.ndarray) -> np.ndarray:
    v = np.diag(cov)
    return _normal(1 / np.where(v > 1e-12, np.sqrt(np.maximum(v, 0)), 1e-6))


def _solve(cov: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    try:
        return np.linalg.solve(cov + RIDGE * np.eye(len(cov)), y)
    except np.linalg.LinAlgError:
        return None


def minimum_variance(cov: np.ndarray, long_only: bool = True) -> np.ndarray:
    w = _solve(cov, np.ones(len(cov)))
    return equal(len(cov)) if w is None else _normal(w, long_only)


def max_sharpe(cov: np.ndarray, expected: np.ndarray, rate: float = 0.0, long_only: bool = True) -> np.ndarray:
    w = _solve(cov, expected - rate)
    return equal(len(cov)) if w is None else _normal(w, long_only)


def risk_parity(cov: np.ndarray, sweeps: int = 200, tolerance: float = 1e-10) -> np.ndarray:
    """Equal risk contributions: minimises half the variance less the mean log weight, a convex problem, one coordinate at a time."""
    n = len(cov)
    w = inverse_volatility(cov)
    for _ in range(sweeps):
        before = w.copy()
        for i in range(n):
            a, b = cov[i, i], cov[i] @ w - cov[i, i] * w[i]
            w[i] = (-b + np.sqrt(b * b + 4 * a / n)) / (2 * a) if a > 1e-12 else w[i]
        if np.abs(w - before).max(initial=0) < tolerance * max(w.max(initial=0), 1):
            break
    return _normal(w)


def metrics(w: np.ndarray, cov: np.ndarray, expected: np.ndarray, rate: float = 0.0) -> dict[str, float]:
    """Expected return, variance, volatility, Sharpe ratio and diversification ratio (1 where undefined)."""
    var = max(float(w @ cov @ w), 0.0)
    vol = var**0.5
    ret = float(w @ expected)
    return {"ret": ret, "variance": var, "volatility": vol, "sharpe": (ret - rate) / vol if vol > 1e-12 else 0.0, "diversification": float(w @ np.sqrt(np.maximum(np.diag(cov), 0))) / vol if vol > 1e-12 else 1.0}


def weights(rets: DataFrame, delta: float = 0.2) -> DataFrame:
    """(method, symbol, weight) by equal, inverse-volatility, minimum-variance, maximum-Sharpe and risk-parity weights."""
    names, cov = matrix(shrunk(rets, delta))
    mean = {r.symbol: r.m for r in rets.groupBy("symbol").agg(F.avg("ret").alias("m")).where(F.col("symbol").isin(names)).collect()}
    mu = np.array([mean.get(s) or 0.0 for s in names])
    by = {"equal": equal(len(names)), "inverse_volatility": inverse_volatility(cov), "minimum_variance": minimum_variance(cov), "max_sharpe": max_sharpe(cov, mu), "risk_parity": risk_parity(cov)}
    return rets.sparkSession.createDataFrame([(m, s, float(x)) for m, w in by.items() for s, x in zip(names, w)], "method string, symbol string, weight double")
