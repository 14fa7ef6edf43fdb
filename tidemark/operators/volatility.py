"""Conditional variance of return series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fold import ordered_fold

OMEGA, ALPHA, BETA, DECAY, FLOOR = 1e-6, 0.08, 0.90, 0.94, 1e-12
LEAST_VARIANCE, USUAL_DEVIATION = 1e-8, 0.02
REGIMES = (("low", 0.75), ("normal", 1.35), ("elevated", 2.0))  # below these ratios; beyond, "extreme"


def garch_path(rets: DataFrame, omega: float = OMEGA, alpha: float = ALPHA, beta: float = BETA, decay: float = DECAY, long_run: bool = False) -> DataFrame:
    """(symbol, day, variance, ewma) after each non-null return, by the GARCH(1,1) and the exponentially weighted recursion.

    Both start from the first squared return, or with long_run from the variance omega / (1 - alpha - beta) before it.
    """
    r = rets.where(F.col("ret").isNotNull()).select("symbol", "day", "ret").withColumn("omega", F.lit(omega))
    return _path(r, alpha, beta, decay, long_run).select("symbol", "day", "variance", "ewma")


def _path(r: DataFrame, alpha: float, beta: float, decay: float, long_run: bool = False) -> DataFrame:
    decay = min(max(decay, 0.5), 0.999)

    def step(state, row):
        q, omega = row[2] * row[2], row[3]
        if state is None and long_run:
            state = (omega / (1 - alpha - beta),) * 2
        v, e = (omega + (alpha + beta) * q, q) if state is None else (omega + alpha * q + beta * state[0], decay * state[1] + (1 - decay) * q)
        state = max(v, FLOOR), max(e, FLOOR)
        return state, state

    return ordered_fold(r.select("symbol", "day", "ret", "omega"), ["symbol"], ["day"], step, "variance double, ewma double")


def fit(rets: DataFrame, alpha: float = ALPHA, beta: float = BETA, decay: float = DECAY) -> DataFrame:
    """(symbol, omega, long_run, variance, ewma): omega from each symbol's sample variance, and the state after its last return.

    long_run is null where alpha + beta is 1 or more; then omega stays at its default.
    """
    r = rets.where(F.col("ret").isNotNull()).select("symbol", "day", "ret")
    left = 1 - alpha - beta
    s = F.greatest(F.coalesce(F.var_samp("ret"), F.lit(1e-4)), F.lit(LEAST_VARIANCE))
    omega = r.groupBy("symbol").agg((s * left if left > 0 else F.lit(OMEGA)).alias("omega"))
    path = _path(r.join(omega, "symbol"), alpha, beta, decay)
    last = path.groupBy("symbol").agg(F.max(F.struct("day", "omega", "variance", "ewma")).alias("x"))
    return last.select("symbol", "x.omega", (F.col("x.omega") / left if left > 0 else F.lit(None).cast("double")).alias("long_run"), "x.variance", "x.ewma")


def forecast(fitted: DataFrame, horizons: list[int], alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """(symbol, horizon, variance): the expected variance after so many steps; 0 and 1 give the current one, as does a process without a long run."""
    f = fitted.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    ahead = F.col("long_run") + F.pow(F.lit(alpha + beta), F.col("horizon") - 1) * (F.col("variance") - F.col("long_run"))
    return f.select("symbol", "horizon", F.when((F.col("horizon") > 1) & F.col("long_run").isNotNull(), ahead).otherwise(F.col("variance")).alias("variance"))


def regime(variance: Column, long_run: Column) -> Column:
    """low, normal, elevated or extreme, by the ratio of the deviation to the long run's (to USUAL_DEVIATION where that is not above 0)."""
    ratio = F.sqrt(variance) / F.when(long_run > 0, F.sqrt(long_run)).otherwise(USUAL_DEVIATION)
    out = F.when(ratio < REGIMES[0][1], REGIMES[0][0])
    for name, below in REGIMES[1:]:
        out = out.when(ratio < below, name)
    return out.otherwise("extreme")
