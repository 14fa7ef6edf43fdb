"""Rolling behavioural features over daily bars.

Everything over a symbol's history shares one partitioning by symbol; the cross-section takes one shuffle by day.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

WINDOW, LEAST = 60, 30

# Prospect theory's curvature, loss aversion, and weighting of gains and losses
ALPHA, LAMBDA, GAMMA_POS, GAMMA_NEG = 0.88, 2.25, 0.61, 0.69


def by_symbol():
    return Window.partitionBy("symbol").orderBy("day")


def returns(bars: DataFrame) -> DataFrame:
    """Adds ret: the close over the one before, less one; null for a symbol's first bar and after a zero close."""
    return bars.withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(by_symbol())) - 1)


def adjusted_skewness(x: Column, over=None) -> Column:
    """Fisher-Pearson skewness with the small-sample factor; null below three values."""
    n, g = F.count(x), F.skewness(x)
    if over is not None:
        n, g = n.over(over), g.over(over)
    return F.when(n > 2, g * F.sqrt(n * (n - 1)) / (n - 2))


def rolling_stats(rets: DataFrame) -> DataFrame:
    """Adds roll_skew, roll_max, roll_vol over WINDOW bars with LEAST returns at least."""
    w = by_symbol().rowsBetween(-(WINDOW - 1), 0)
    enough = F.count("ret").over(w) >= LEAST
    return rets.withColumns(
        {
            "roll_skew": F.when(enough, adjusted_skewness(F.col("ret"), w)),
            "roll_max": F.when(enough, F.max("ret").over(w)),
            "roll_vol": F.when(enough, F.stddev_samp("ret").over(w)),
        }
    )


def rolling_stats_short(rets: DataFrame) -> DataFrame:
    """Adds roll_skew, roll_max, roll_vol over up to WINDOW bars from the first on: 3, 1 and 2 returns are enough; skewness without spread is 0."""
    w = by_symbol().rowsBetween(-(WINDOW - 1), 0)
    spread = F.coalesce(F.var_pop("ret").over(w), F.lit(0.0)) > 1e-14
    skew = F.when(F.count("ret").over(w) > 2, F.when(spread, adjusted_skewness(F.col("ret"), w)).otherwise(0.0))
    return rets.withColumns({"roll_skew": skew, "roll_max": F.max("ret").over(w), "roll_vol": F.stddev_samp("ret").over(w)})


def weight(p: Column, gamma: float) -> Column:
    q = F.pow(p, F.lit(gamma))
    return F.when(p <= 0, 0.0).when(p >= 1, 1.0).otherwise(q / F.pow(q + F.pow(1 - p, F.lit(gamma)), F.lit(1 / gamma)))


def _cpt_values(x: np.ndarray, window: int, least: int) -> np.ndarray:
    """The value of the last `window` entries of x (nan: no return) at each entry, nan below `least` returns; blocks of rows keep memory bounded."""
    out = np.full(len(x), np.nan)
    padded = np.concatenate((np.full(window - 1, np.nan), x))
    for at in range(0, len(x), 4096):
        frame = sliding_window_view(padded[at : min(at + 4096, len(x)) + window - 1], window)
        n = np.isfinite(frame).sum(1)
        total = np.zeros(len(frame))
        for gamma, sign, factor in ((GAMMA_POS, 1.0, 1.0), (GAMMA_NEG, -1.0, -LAMBDA)):
            own = frame >= 0 if sign > 0 else frame < 0
            # Of one sign, the largest first; the others, as -1, come last and count for nothing.
            size = -np.sort(-np.where(own, np.abs(frame), -1.0), axis=1)
            share = np.minimum(np.arange(window + 1)[None, :] / np.maximum(n, 1)[:, None], 1.0)
            q = share**gamma
            w = q / (q + (1 - share) ** gamma) ** (1 / gamma)
            total += factor * np.where(size >= 0, np.diff(w, axis=1) * np.abs(size) ** ALPHA, 0.0).sum(1)
        out[at : at + len(frame)] = np.where(n >= least, total, np.nan)
    return out


def rolling_cpt(rets: DataFrame, extra: tuple[str, ...] = (), window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """(symbol, day, pt_value) and the extra columns: cumulative prospect theory value of the last `window` returns, null below `least` of them.

    One shuffle by symbol. A symbol's rows are read in order as Arrow batches; window - 1 returns are carried from batch to batch, and each
    batch's windows are ranked in numpy.
    """
    df = rets.select("symbol", "day", "ret", *[c for c in extra if c != "ret"])
    schema = T.StructType([f for f in df.schema if f.name != "ret" or "ret" in extra] + [T.StructField("pt_value", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(0)
        for b in batches:
            x = b.column("ret").to_numpy(zero_copy_only=False).astype(float)
            names = b.column("symbol").to_pylist()
            values = np.full(len(x), np.nan)
            at = 0
            while at < len(x):
                end = at + 1
                while end < len(x) and names[end] == names[at]:
                    end += 1
                held = held if last == (names[at],) else np.zeros(0)
                own = np.concatenate((held, x[at:end]))
                values[at:end] = _cpt_values(own, window, least)[len(held) :]
                last, held = (names[at],), own[-(window - 1) :]
                at = end
            columns = [b.column(f.name) for f in schema[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.float64(), from_pandas=True)], names=schema.names)

    return df.repartition("symbol").sortWithinPartitions("symbol", "day").mapInArrow(run, schema)


def lottery_features(bars: DataFrame) -> DataFrame:
    """Features of the day before and today's label: pt_value, roll_skew, roll_max, roll_vol, turnover, composite, y; rows with a null go."""
    rets = returns(bars).withColumn("turnover", F.try_divide("volume", "market_cap"))
    f = rolling_cpt(rolling_stats(rets), ("ret", "turnover", "roll_skew", "roll_max", "roll_vol"))
    day = Window.partitionBy("day")
    z = lambda c: F.try_divide(F.col(c) - F.avg(c).over(day), F.stddev_samp(c).over(day))
    f = f.withColumn("composite", z("pt_value") + z("roll_skew") + z("roll_max"))
    cut = F.expr("percentile(composite, 0.75) over (partition by day)")
    # Rounded on both sides, so that the quartile itself counts as in the quartile however sums are ordered.
    f = f.withColumn("y", F.coalesce((F.round("composite", 9) >= F.round(cut, 9)).cast("double"), F.lit(0.0)))
    moved = ["pt_value", "roll_skew", "roll_max", "roll_vol", "turnover", "composite"]
    f = f.select("symbol", "day", "ret", "y", *[F.lag(c).over(by_symbol()).alias(c) for c in moved])
    return f.na.drop("any")


def donchian(bars: DataFrame, lookback: int = 20, least: int | None = None) -> DataFrame:
    """Adds the highest and lowest of the lookback closes before the bar, null where there are fewer than `least` (all of them, if not given)."""
    w = by_symbol().rowsBetween(-lookback, -1)
    full = F.count("close").over(w) >= (lookback if least is None else least)
    return bars.withColumns({"channel_high": F.when(full, F.max("close").over(w)), "channel_low": F.when(full, F.min("close").over(w))})


def pair_spread(bars: DataFrame, a: str, b: str, beta: float = 1.0, window: int = 30) -> DataFrame:
    """(day, spread, z): log spread of two symbols on their common days, and its z-score over the window, today included."""
    left = bars.where(F.col("symbol") == a).select("day", F.col("close").alias("close_a"))
    right = bars.where(F.col("symbol") == b).select("day", F.col("close").alias("close_b"))
    s = left.join(right, "day").select("day", (F.ln("close_a") - beta * F.ln("close_b")).alias("spread"))
    w = Window.partitionBy(F.lit(f"{a}/{b}")).orderBy("day").rowsBetween(-(window - 1), 0)  # one pair's days: a row each, not a table's
    sd = F.stddev_samp("spread").over(w)
    z = F.when(F.count("*").over(w) >= window, F.when(sd < 1e-8, 0.0).otherwise((F.col("spread") - F.avg("spread").over(w)) / sd))
    return s.withColumn("z", z)
