"""Queries on strategies, orders, volatility and portfolios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.market import table
from ..operators import features, feed, forest, portfolio, strategy, volatility
from .registry import BARS, QUOTES, _bars, _quotes, _round, query

A, B, DECAY, FLOOR = volatility.ALPHA, volatility.BETA, volatility.DECAY, volatility.FLOOR
FITTED = f"""{BARS},
n AS (SELECT symbol, day, ret * ret AS q, row_number() OVER (PARTITION BY symbol ORDER BY day) AS i FROM rets WHERE ret IS NOT NULL),
o AS (SELECT symbol, greatest(coalesce(var_samp(ret), 1e-4), {volatility.LEAST_VARIANCE}) * {1 - A - B} AS omega, count(*) AS last FROM rets WHERE ret IS NOT NULL GROUP BY symbol),
g AS (SELECT symbol, i, greatest(omega + {A + B} * q, {FLOOR}) AS v FROM n JOIN o USING (symbol) WHERE i = 1
  UNION ALL SELECT n.symbol, n.i, greatest(o.omega + {A} * n.q + {B} * g.v, {FLOOR}) FROM g JOIN n ON n.symbol = g.symbol AND n.i = g.i + 1 JOIN o ON o.symbol = n.symbol),
fitted AS (SELECT symbol, v AS variance, omega / {1 - A - B} AS long_run FROM g JOIN o USING (symbol) WHERE i = last)"""


@query(
    f"""WITH RECURSIVE {FITTED} SELECT symbol, horizon, round(CASE WHEN horizon > 1 THEN long_run + pow({A + B}, horizon - 1) * (variance - long_run) ELSE variance END, 6) + 0.0 AS variance
FROM fitted, (SELECT unnest([0, 1, 10, 100]) AS horizon)"""
)
def garch_forecast(spark, d):
    return _round(volatility.forecast(volatility.fit(features.returns(_bars(spark, d))), [0, 1, 10, 100]), "variance")


@query(
    f"""WITH RECURSIVE {FITTED}, r AS (SELECT symbol, sqrt(variance) / sqrt(long_run) AS ratio FROM fitted)
SELECT symbol, CASE WHEN ratio < 0.75 THEN 'low' WHEN ratio < 1.35 THEN 'normal' WHEN ratio < 2 THEN 'elevated' ELSE 'extreme' END AS regime FROM r"""
)
def vol_regime(spark, d):
    return volatility.fit(features.returns(_bars(spark, d))).select("symbol", volatility.regime(F.col("variance"), F.col("long_run")).alias("regime"))


@query(
    f"""WITH RECURSIVE {BARS},
c AS (SELECT symbol, day, close, CASE WHEN count(close) OVER w >= 20 THEN max(close) OVER w END AS hi, CASE WHEN count(close) OVER w >= 20 THEN min(close) OVER w END AS lo,
  row_number() OVER (PARTITION BY symbol ORDER BY day) AS i FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
s AS (SELECT symbol, day, close, i, 0 AS position, CAST(0 AS DOUBLE) AS entry, CAST(0 AS DOUBLE) AS peak, 0 AS signal, CAST(NULL AS DOUBLE) AS gain FROM c WHERE i = 1
  UNION ALL SELECT c.symbol, c.day, c.close, c.i, x.p, CASE WHEN x.p = 1 THEN x.e ELSE 0 END, CASE WHEN x.p = 1 THEN greatest(x.e, s.peak, c.close) ELSE 0 END, x.p - s.position, CASE WHEN x.p < s.position THEN c.close / s.entry - 1 END
  FROM s JOIN c ON c.symbol = s.symbol AND c.i = s.i + 1, LATERAL (SELECT CASE WHEN c.hi IS NULL THEN s.position WHEN s.position = 0 THEN CAST(c.close > c.hi AS INTEGER)
    WHEN c.close <= s.entry * 0.95 OR c.close <= greatest(s.peak, c.close) * 0.92 OR c.close < c.lo THEN 0 ELSE 1 END AS p, CASE WHEN s.position = 1 THEN s.entry ELSE c.close END AS e) x)
SELECT symbol, day, signal, position, round(gain, 6) + 0.0 AS gain FROM s WHERE signal <> 0"""
)
def breakout_backtest(spark, d):
    return _round(strategy.breakout(_bars(spark, d)).where("signal <> 0").select("symbol", "day", "signal", "position", "gain"), "gain")


@query(
    f"""WITH RECURSIVE {BARS}, p AS (SELECT a.day, ln(a.close) - ln(b.close) AS spread FROM bars a JOIN bars b USING (day) WHERE a.symbol = 'AF' AND b.symbol = 'RF'),
c AS (SELECT day, spread, CASE WHEN count(*) OVER w >= 30 THEN CASE WHEN stddev_samp(spread) OVER w > 0 THEN (spread - avg(spread) OVER w) / stddev_samp(spread) OVER w ELSE 0 END END AS z,
  row_number() OVER (ORDER BY day) AS i FROM p WINDOW w AS (ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
s AS (SELECT day, spread, z, i, 0 AS state, CAST(0 AS DOUBLE) AS entry, 0 AS signal, CAST(NULL AS DOUBLE) AS gain FROM c WHERE i = 1
  UNION ALL SELECT c.day, c.spread, c.z, c.i, x.st, CASE WHEN s.state = 0 THEN c.spread ELSE s.entry END, x.st - s.state, CASE WHEN s.state <> 0 AND x.st = 0 THEN (c.spread - s.entry) * s.state END
  FROM s JOIN c ON c.i = s.i + 1, LATERAL (SELECT CASE WHEN c.z IS NULL THEN s.state WHEN s.state = 0 THEN CASE WHEN c.z <= -2 THEN 1 WHEN c.z >= 2 THEN -1 ELSE 0 END
    WHEN c.z * s.state >= -0.2 OR c.z * s.state <= -3.5 THEN 0 ELSE s.state END AS st) x)
SELECT day, signal, state, round(z, 6) + 0.0 AS z, round(gain, 6) + 0.0 AS gain FROM s WHERE signal <> 0"""
)
def pair_backtest(spark, d):
    s = features.pair_spread(_bars(spark, d), "AF", "RF").select(F.lit("AF/RF").alias("pair"), "day", "spread")
    return _round(strategy.pair_trades(s).where("signal <> 0").select("day", "signal", "state", "z", "gain"), "z", "gain")


_FILLS = f"""{QUOTES},
f AS (SELECT symbol, seq, CASE WHEN user_id % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign, (1 + seq % 3)::DOUBLE AS qty, CASE WHEN user_id % 2 = 0 THEN ask * 1.00005::DOUBLE ELSE bid * 0.99995::DOUBLE END AS price,
  row_number() OVER (PARTITION BY symbol ORDER BY seq) AS i FROM quotes WHERE bid > 0),
s AS (SELECT symbol, seq, i, sign, qty, price, 0.0::DOUBLE AS realized, sign * qty AS position, price AS avg_entry, false AS closing FROM f WHERE i = 1
  UNION ALL SELECT f.symbol, f.seq, f.i, f.sign, f.qty, f.price, CASE WHEN s.position * f.sign < 0 THEN least(abs(s.position), f.qty) * (s.avg_entry - f.price) * f.sign ELSE 0 END,
    CASE WHEN abs(s.position + f.sign * f.qty) < 1e-6 THEN 0 ELSE s.position + f.sign * f.qty END,
    CASE WHEN s.position * f.sign >= 0 THEN (abs(s.position) * s.avg_entry + f.qty * f.price) / (abs(s.position) + f.qty) WHEN abs(s.position + f.sign * f.qty) < 1e-6 THEN 0 ELSE s.avg_entry END, s.position * f.sign < 0
  FROM s JOIN f ON f.symbol = s.symbol AND f.i = s.i + 1),
t AS (SELECT *, qty * price * 0.0005::DOUBLE AS fee FROM s)"""


def _fills(spark, d):
    q = _quotes(spark, d).where("bid > 0")
    f = q.select(F.lit("main").alias("account"), "symbol", "seq", "bid", "ask", F.when(F.col("user_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"), (1 + F.col("seq") % 3).cast("double").alias("qty"), F.lit(False).alias("maker"))
    return strategy.positions(strategy.market_price(f))


@query(f"WITH RECURSIVE {_FILLS} SELECT symbol, seq, round(fee, 6) + 0.0 AS fee, round(realized, 6) + 0.0 AS realized, round(position, 6) + 0.0 AS position, round(avg_entry, 6) + 0.0 AS avg_entry FROM t")
def broker_fills(spark, d):
    return _round(_fills(spark, d).select("symbol", "seq", "fee", "realized", "position", "avg_entry"), "fee", "realized", "position", "avg_entry")


@query(
    f"""WITH RECURSIVE {_FILLS}, m AS (SELECT symbol, arg_max(last, seq) AS mark FROM quotes GROUP BY symbol),
v AS (SELECT sum(p.position * m.mark) AS asset_value FROM (SELECT symbol, arg_max(position, seq) AS position FROM t GROUP BY symbol) p JOIN m USING (symbol))
SELECT round(100000 + sum(-sign * qty * price - fee), 4) + 0.0 AS cash, round(any_value(asset_value), 4) + 0.0 AS asset_value, round(100000 + sum(-sign * qty * price - fee) + any_value(asset_value), 4) + 0.0 AS equity,
  round(sum(realized) - sum(CASE WHEN closing THEN fee ELSE 0 END), 4) + 0.0 AS realized, count(*) AS trades, round(count_if(realized > 0) * 100.0 / (count_if(realized > 0) + count_if(realized < 0)), 6) + 0.0 AS win_rate,
  round(sum(greatest(realized, 0)) / -sum(least(realized, 0)), 6) + 0.0 AS profit_factor FROM t, v"""
)
def account_summary(spark, d):
    marks = _quotes(spark, d).groupBy("symbol").agg(F.max_by("last", "seq").alias("mark"))
    a = strategy.accounts(_fills(spark, d), marks).drop("account")
    return _round(_round(a, "cash", "asset_value", "equity", "realized", places=4), "win_rate", "profit_factor")


@query(
    f"""WITH {QUOTES}, o AS (SELECT seq AS order_id, symbol, ts_us AS placed, user_id % 2 = 0 AS buy, user_id % 3 > 0 AS lim,
  last * CASE WHEN (user_id % 2 = 0) = (user_id % 3 > 0) THEN 0.5::DOUBLE ELSE 1.5::DOUBLE END AS price FROM quotes),
h AS (SELECT order_id, seq, ts_us, CASE WHEN buy THEN ask ELSE bid END AS fill_price, row_number() OVER (PARTITION BY order_id ORDER BY ts_us, seq) AS k FROM o JOIN quotes q ON o.symbol = q.symbol AND q.ts_us >= placed
  AND CASE WHEN buy AND lim THEN ask <= price WHEN lim THEN bid >= price WHEN buy THEN ask >= price ELSE bid <= price END)
SELECT order_id, seq, ts_us, round(fill_price, 6) + 0.0 AS fill_price FROM h WHERE k = 1"""
)
def resting_order_fills(spark, d):
    q = _quotes(spark, d)
    buy, limit = F.col("user_id") % 2 == 0, F.col("user_id") % 3 > 0
    o = q.select(
        F.col("seq").alias("order_id"), "symbol", "ts_us", F.when(buy, "BUY").otherwise("SELL").alias("side"), F.when(limit, "LIMIT").otherwise("STOP").alias("type"),
        (F.col("last") * F.when(buy == limit, 0.5).otherwise(1.5)).alias("price"),
    )
    return _round(strategy.resting_fills(o, q), "fill_price")


@query(
    f"""WITH RECURSIVE {QUOTES}, a AS (SELECT *, ts_us - lag(ts_us) OVER w AS delta_us FROM quotes WINDOW w AS (PARTITION BY symbol ORDER BY ts_us, seq)),
b AS (SELECT *, lag(delta_us) OVER w AS p, row_number() OVER w AS i FROM a WINDOW w AS (PARTITION BY symbol ORDER BY ts_us, seq)), j AS (SELECT symbol, seq, i, CASE WHEN p > 0 THEN abs(delta_us - p)::DOUBLE END AS jit FROM b),
s AS (SELECT symbol, seq, i, coalesce((1 - 0.95::DOUBLE) * jit, 0) AS m FROM j WHERE i = 1 UNION ALL SELECT j.symbol, j.seq, j.i, coalesce(0.95::DOUBLE * s.m + (1 - 0.95::DOUBLE) * j.jit, s.m) FROM s JOIN j ON j.symbol = s.symbol AND j.i = s.i + 1)
SELECT symbol, seq, round(m, 3) + 0.0 AS mean_jitter FROM s"""
)
def feed_jitter_ema(spark, d):
    return _round(feed.jitter_average(_quotes(spark, d)), "mean_jitter", places=3)


_SYMBOLS = ["AF", "RF"]


@query(f"WITH {BARS}, w AS (SELECT day, max(CASE WHEN symbol = 'AF' THEN ret END) AS \"AF\", max(CASE WHEN symbol = 'RF' THEN ret END) AS \"RF\" FROM rets GROUP BY day) SELECT day, round(\"AF\", 8) + 0.0 AS \"AF\", round(\"RF\", 8) + 0.0 AS \"RF\" FROM w WHERE \"AF\" IS NOT NULL AND \"RF\" IS NOT NULL")
def aligned_returns(spark, d):
    r = features.returns(_bars(spark, d)).where(F.col("symbol").isin(_SYMBOLS))
    return _round(r.groupBy("day").pivot("symbol", _SYMBOLS).agg(F.first("ret", ignorenulls=True)).na.drop("any"), *_SYMBOLS, places=8)


@query(f"WITH {BARS} SELECT a.symbol AS a, b.symbol AS b, round(covar_samp(a.ret, b.ret) * CASE WHEN a.symbol = b.symbol THEN 1 ELSE 0.8 END, 6) + 0.0 AS covar FROM rets a JOIN rets b USING (day) WHERE a.symbol <= b.symbol AND a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY a.symbol, b.symbol")
def cov_shrunk(spark, d):
    return _round(portfolio.shrunk(features.returns(_bars(spark, d))), "covar")


@query()
def portfolio_weights(spark, d):
    return _round(portfolio.weights(features.returns(_bars(spark, d))), "weight")


def _trees(node) -> str:
    return repr(node) if not isinstance(node, tuple) else f"CASE WHEN coalesce({node[0]}, 0) <= {node[1]} THEN {_trees(node[2])} ELSE {_trees(node[3])} END"


_FEATURES = "event_id, value / 1000 AS pt_value, value / 100 AS roll_skew, (user_id % 20) / 100.0 AS roll_max, CASE WHEN event_id % 5 > 0 THEN (event_id % 9) / 100.0 END AS turnover"


@query(f"WITH f AS (SELECT {_FEATURES} FROM events), p AS (SELECT event_id, ({' + '.join(f'CAST({_trees(t)} AS DOUBLE)' for t in forest.TREES)}) / 3 AS p FROM f) SELECT event_id, round(p, 6) + 0.0 AS probability, CAST(p >= 0.5 AS INTEGER) AS predicted, p >= 0.7 AS alert FROM p")
def forest_score(spark, d):
    f = table(spark, d, "events").selectExpr(*_FEATURES.split(", "))
    f = f.withColumns({c: F.col(c).cast("double") for c in ("pt_value", "roll_skew", "roll_max", "turnover")})
    return _round(forest.scored(f).select("event_id", "probability", "predicted", "alert"), "probability")
