"""Risk measures of return series, one row per symbol."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .features import adjusted_skewness, by_symbol

DAYS = 365


def tail(rets: DataFrame, level: float = 0.95) -> DataFrame:
    """(symbol, hist_var, es): the return of rank floor((1 - level) n), and the mean of the worst such returns, negated."""
    r = rets.where("ret is not null").select(
        "symbol", "ret", F.row_number().over(Window.partitionBy("symbol").orderBy("ret")).alias("k"), F.count("*").over(Window.partitionBy("symbol")).alias("n")
    )
    at = F.floor(F.lit(1 - level) * F.col("n") + 1e-9)
    return r.groupBy("symbol").agg(
        (-F.max(F.when(F.col("k") == at + 1, F.col("ret")))).alias("hist_var"), (-F.avg(F.when(F.col("k") <= F.greatest(at, F.lit(1)), F.col("ret")))).alias("es")
    )


def drawdown(rets: DataFrame) -> DataFrame:
    """(symbol, day, equity, peak, drawdown): equity starts at 1, and so does its peak. A total loss takes the equity to 0."""
    upto = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    e = rets.where("ret is not null").select("symbol", "day", F.product(1 + F.col("ret")).over(upto).alias("equity"))
    e = e.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(upto)))
    return e.withColumn("drawdown", 1 - F.col("equity") / F.col("peak"))


def max_drawdown(rets: DataFrame) -> DataFrame:
    """(symbol, max_drawdown, max_drawdown_duration): the deepest fall from a peak, and the most bars in a row without a new one."""
    e = drawdown(rets)
    before = F.greatest(F.lit(1.0), F.max("equity").over(by_symbol().rowsBetween(Window.unboundedPreceding, -1)))
    high = F.col("equity") > F.coalesce(before, F.lit(1.0))
    e = e.withColumn("high", high.cast("int")).withColumn("stretch", F.sum("high").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0)))
    s = e.groupBy("symbol", "stretch").agg(F.max("drawdown").alias("d"), F.sum(1 - F.col("high")).alias("bars"))
    return s.groupBy("symbol").agg(F.max("d").alias("max_drawdown"), F.max("bars").cast("long").alias("max_drawdown_duration"))


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution function by Acklam's rational approximation; -1e9 from 0 down and 1e9 from 1 up."""
    # Acklam's coefficients and the edge of his tails
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
    edge = 0.02425

    def poly(k: tuple[float, ...], x: Column) -> Column:
        out = F.lit(k[0])
        for v in k[1:]:
            out = out * x + v
        return out

    q, r = F.sqrt(-2 * F.ln(F.least(p, 1 - p))), p - 0.5
    tail_ = poly(c, q) / poly(d, q)
    return F.when(p <= 0, -1e9).when(p >= 1, 1e9).when(p < edge, tail_).when(p > 1 - edge, -tail_).otherwise(r * poly(a, r * r) / poly(b, r * r))


def raw_moments(rets: DataFrame) -> DataFrame:
    """(symbol, skew_raw, kurt_raw): means of the third and fourth powers of standardised returns (sample deviation, no bias correction), the latter less 3."""
    n = F.count("ret")
    shrink = (n - 1) / n
    return rets.where("ret is not null").groupBy("symbol").agg(
        (F.skewness("ret") * F.pow(shrink, F.lit(1.5))).alias("skew_raw"), ((F.kurtosis("ret") + 3) * shrink * shrink - 3).alias("kurt_raw")
    )


def full_report(rets: DataFrame, risk_free: float = 0.0, periods: float = DAYS) -> DataFrame:
    """All measures by symbol: moments; Gaussian, Cornish-Fisher and historical VaR and expected shortfall at 95 and 99 %; maximum
    drawdown and its duration; annualised return and volatility; Sharpe, Sortino and Calmar ratios. A ratio over nothing is 0."""
    x = F.col("ret")
    n = F.count(x)
    base = risk_free / periods
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))
    m = rets.where("ret is not null").groupBy("symbol").agg(
        n.alias("n"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("sd"), adjusted_skewness(x).alias("skew"), kurt.alias("kurt"),
        F.sqrt(F.avg(F.when(x < base, (x - base) * (x - base)).otherwise(0.0)) * periods).alias("down"),
    )
    some = F.col("sd") > 1e-12
    m = m.withColumns({c: F.when(some, F.coalesce(c, F.lit(0.0))).otherwise(0.0) for c in ("skew", "kurt")})
    s, k = F.col("skew"), F.col("kurt")
    for level in (0.95, 0.99):
        z, name = NormalDist().inv_cdf(1 - level), round(level * 100)
        cf = z + (z * z - 1) * s / 6 + (z**3 - 3 * z) * k / 24 - (2 * z**3 - 5 * z) * s * s / 36
        m = m.withColumns({f"var_gauss_{name}": -(F.col("mean") + z * F.col("sd")), f"var_cf_{name}": -(F.col("mean") + cf * F.col("sd"))})
        m = m.join(tail(rets, level).toDF("symbol", f"hist_var_{name}", f"es_{name}"), "symbol")
    m = m.join(max_drawdown(rets), "symbol").withColumns({"ann_return": F.col("mean") * periods, "ann_vol": F.col("sd") * math.sqrt(periods)})
    ratio = lambda a, b: F.when(F.col(b) > 1e-12, a / F.col(b)).otherwise(0.0)
    excess = F.col("ann_return") - risk_free
    return m.withColumns({"sharpe": ratio(excess, "ann_vol"), "sortino": ratio(excess, "down"), "calmar": ratio(F.col("ann_return"), "max_drawdown")}).drop("down")


def report(rets: DataFrame, level: float = 0.95) -> DataFrame:
    """Moments, Gaussian, Cornish-Fisher and historical VaR, expected shortfall, Sharpe and Sortino ratios by symbol."""
    x = F.col("ret")
    n = F.count(x)
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)).otherwise(0.0)
    m = rets.where("ret is not null").groupBy("symbol").agg(
        n.alias("n"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("sd"), F.coalesce(adjusted_skewness(x), F.lit(0.0)).alias("skew"),
        kurt.alias("kurt"), F.sqrt(F.avg(F.when(x < 0, x * x).otherwise(0.0))).alias("down"),
    )
    z = NormalDist().inv_cdf(1 - level)
    s, k = F.col("skew"), F.col("kurt")
    cf = z + (z * z - 1) * s / 6 + (z**3 - 3 * z) * k / 24 - (2 * z**3 - 5 * z) * s * s / 36
    year = math.sqrt(DAYS)
    m = m.withColumns(
        {
            "var_gauss": -(F.col("mean") + z * F.col("sd")),
            "var_cf": -(F.col("mean") + cf * F.col("sd")),
            "sharpe": F.when(F.col("sd") > 1e-12, F.col("mean") / F.col("sd") * year).otherwise(0.0),
            "sortino": F.when(F.col("down") > 1e-12, F.col("mean") / F.col("down") * year).otherwise(0.0),
        }
    )
    return m.join(tail(rets, level), "symbol")


BLOCK = 256  # symbols in a block


def _sums(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """For columns of x and y (days in rows, nan: none) over their common days: number, sums, sums of squares and of products."""
    u, v = np.isfinite(x).astype(float), np.isfinite(y).astype(float)
    x, y = np.nan_to_num(x), np.nan_to_num(y)
    return u.T @ v, x.T @ v, u.T @ y, (x * x).T @ v, u.T @ (y * y), x.T @ y


def correlations(rets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b, corr, covar): Pearson correlation and sample covariance of every two symbols a < b on their common days.

    Symbols are dealt to blocks, and two blocks' histories meet in one task as matrices: a return is sent once for each block, not
    paired with every other of its day. Returns are taken less their symbol's mean, which keeps the sums of products exact.
    """
    r = rets.where("ret is not null").groupBy("symbol", "day").agg(F.max("ret").alias("ret"))
    mean = r.groupBy("symbol").agg(F.avg("ret").alias("mean"))
    n = max(1, math.ceil(mean.count() / block))
    r = r.join(mean, "symbol").select("symbol", F.unix_date(F.to_date("day")).alias("day"), (F.col("ret") - F.col("mean")).alias("x"), F.pmod(F.xxhash64("symbol"), n).cast("int").alias("own"))
    r = r.withColumn("met", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("symbol", "day", "x", "own", F.least("own", "met").alias("i"), F.greatest("own", "met").alias("j"))

    def run(keys: tuple, t: pa.Table) -> pa.Table:
        names, at = np.unique(np.array(t["symbol"].to_pylist(), object), return_inverse=True)
        days, on = np.unique(np.asarray(t["day"]), return_inverse=True)
        own = np.zeros(len(names), int)
        own[at] = np.asarray(t["own"])
        m = np.full((len(days), len(names)), np.nan)
        m[on, at] = np.asarray(t["x"])
        left, right = (np.flatnonzero(own == k.as_py()) for k in keys)
        n_, sx, sy, xx, yy, xy = _sums(m[:, left], m[:, right])
        with np.errstate(divide="ignore", invalid="ignore"):
            co = xy - sx * sy / n_
            covar = np.where(n_ > 1, co / (n_ - 1), np.nan)
            spread = np.sqrt(np.maximum(xx - sx * sx / n_, 0) * np.maximum(yy - sy * sy / n_, 0))
            corr = np.where(spread > 0, co / spread, np.nan)
        keep = n_ > 0
        if keys[0] == keys[1]:
            keep &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
        x, y = np.nonzero(keep)
        one, two = names[left[x]], names[right[y]]
        swap = one > two
        return pa.table(
            {"a": pa.array(np.where(swap, two, one), pa.string()), "b": pa.array(np.where(swap, one, two), pa.string()), "corr": pa.array(corr[x, y], from_pandas=True), "covar": pa.array(covar[x, y], from_pandas=True)}
        )

    return r.groupBy("i", "j").applyInArrow(run, "a string, b string, corr double, covar double")
