"""Queries over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.market import daily_bars, quotes, rounded, table
from ..operators import features, feed, quality, risk, volatility

BARS = """
trades AS (SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS day, l_extendedprice / l_quantity AS price, l_orderkey * 10 + l_linenumber AS seq,
  l_quantity AS q, l_extendedprice AS v FROM lineitem WHERE l_quantity > 0),
bars AS (SELECT symbol, day, min(struct_pack(s := seq, p := price)).p AS open, max(price) AS high, min(price) AS low, max(struct_pack(s := seq, p := price)).p AS close, sum(q) AS volume, sum(v) / sum(q) AS vwap,
  sum(v) AS market_cap, count(*) AS tick_count FROM trades GROUP BY ALL),
rets AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY day), 0) - 1 AS ret FROM bars)"""
ROLL = """,
stats AS (SELECT symbol, day, ret, volume / nullif(market_cap, 0) AS turnover, CASE WHEN count(ret) OVER w >= 30 THEN skewness(ret) OVER w END AS roll_skew,
  CASE WHEN count(ret) OVER w >= 30 THEN max(ret) OVER w END AS roll_max, CASE WHEN count(ret) OVER w >= 30 THEN stddev_samp(ret) OVER w END AS roll_vol
  FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"""


def _w(p: str, g: float) -> str:
    return f"(CASE WHEN {p} <= 0 THEN 0 WHEN {p} >= 1 THEN 1 ELSE pow({p}, {g}) / pow(pow({p}, {g}) + pow(1 - {p}, {g}), {1 / g!r}) END)"


_P, _B = "(k / n)", "((k - 1) / n)"
CPT = f""",
num AS (SELECT symbol, day, ret, row_number() OVER (PARTITION BY symbol ORDER BY day) AS i FROM rets),
pairs AS (SELECT a.symbol, a.day, b.ret FROM num a JOIN num b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 59 AND a.i WHERE b.ret IS NOT NULL),
ranked AS (SELECT symbol, day, ret, CAST(row_number() OVER (PARTITION BY symbol, day, ret >= 0 ORDER BY abs(ret) DESC) AS DOUBLE) AS k, CAST(count(*) OVER (PARTITION BY symbol, day) AS DOUBLE) AS n FROM pairs),
cpt AS (SELECT symbol, day, CASE WHEN max(n) >= 30 THEN sum(CASE WHEN ret >= 0 THEN ({_w(_P, 0.61)} - {_w(_B, 0.61)}) * pow(ret, 0.88)
  ELSE ({_w(_P, 0.69)} - {_w(_B, 0.69)}) * -2.25 * pow(-ret, 0.88) END) END AS pt_value FROM ranked GROUP BY symbol, day)"""
QUOTES = """quotes AS (SELECT event_type AS symbol, event_id AS seq, epoch_us(ts) AS ts_us, value - (user_id % 3 - 1) * 0.01 AS bid, value + 0.01 AS ask, value AS last,
  (event_id * 7919) % 5000 AS latency_us, user_id FROM events)"""

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name. A column `day` is given as text in both, so that no date type is compared."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumn("day", F.col("day").cast("string")) if "day" in df.columns else df

        _queries[f.__name__] = run
        if sql:
            _sql[f.__name__] = f"SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM ({sql})" if "lineitem" in sql and re.search(r"\bday\b", sql.rpartition("SELECT")[2].partition("FROM")[0]) else sql
        return run

    return add


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return daily_bars(table(spark, d, "lineitem"))


def _quotes(spark: SparkSession, d: str) -> DataFrame:
    return quotes(table(spark, d, "events"))


def _round(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), places) for c in cols})


@query(f"WITH {BARS} SELECT symbol, day, round(open, 9) + 0.0 AS open, round(high, 9) + 0.0 AS high, round(low, 9) + 0.0 AS low, round(close, 9) + 0.0 AS close, round(volume, 9) + 0.0 AS volume, round(vwap, 9) + 0.0 AS vwap, tick_count FROM bars")
def bars_daily(spark, d):
    return _round(_bars(spark, d), "open", "high", "low", "close", "volume", "vwap", places=9).drop("market_cap")


@query(f"WITH {BARS} SELECT symbol, day, round(ret, 8) + 0.0 AS ret FROM rets")
def returns_pct_change(spark, d):
    return _round(features.returns(_bars(spark, d)).select("symbol", "day", "ret"), "ret", places=8)


@query(f"WITH {BARS}{ROLL} SELECT symbol, day, round(roll_skew, 6) + 0.0 AS roll_skew, round(roll_max, 6) + 0.0 AS roll_max, round(roll_vol, 6) + 0.0 AS roll_vol FROM stats")
def rolling_stats_60(spark, d):
    return _round(features.rolling_stats(features.returns(_bars(spark, d))).select("symbol", "day", "roll_skew", "roll_max", "roll_vol"), "roll_skew", "roll_max", "roll_vol")


@query(f"WITH {BARS}{CPT} SELECT num.symbol, num.day, round(pt_value, 6) + 0.0 AS pt_value FROM num LEFT JOIN cpt USING (symbol, day)")
def rolling_cpt_60(spark, d):
    return _round(features.rolling_cpt(features.returns(_bars(spark, d))), "pt_value")


@query(
    f"""WITH {BARS}{ROLL}{CPT},
f AS (SELECT s.*, pt_value FROM stats s LEFT JOIN cpt USING (symbol, day)),
z AS (SELECT *, (pt_value - avg(pt_value) OVER w) / nullif(stddev_samp(pt_value) OVER w, 0) + (roll_skew - avg(roll_skew) OVER w) / nullif(stddev_samp(roll_skew) OVER w, 0)
  + (roll_max - avg(roll_max) OVER w) / nullif(stddev_samp(roll_max) OVER w, 0) AS composite FROM f WINDOW w AS (PARTITION BY day)),
y AS (SELECT *, coalesce(CAST(round(composite, 9) >= round(quantile_cont(composite, 0.75) OVER (PARTITION BY day), 9) AS DOUBLE), 0.0) AS y FROM z),
l AS (SELECT symbol, day, ret, y, lag(pt_value) OVER w AS pt_value, lag(roll_skew) OVER w AS roll_skew, lag(roll_max) OVER w AS roll_max, lag(roll_vol) OVER w AS roll_vol,
  lag(turnover) OVER w AS turnover, lag(composite) OVER w AS composite FROM y WINDOW w AS (PARTITION BY symbol ORDER BY day))
SELECT symbol, day, y, round(ret, 6) + 0.0 AS ret, round(pt_value, 6) + 0.0 AS pt_value, round(roll_skew, 6) + 0.0 AS roll_skew, round(roll_max, 6) + 0.0 AS roll_max, round(roll_vol, 6) + 0.0 AS roll_vol,
  round(turnover, 9) + 0.0 AS turnover, round(composite, 5) + 0.0 AS composite FROM l
WHERE ret IS NOT NULL AND pt_value IS NOT NULL AND roll_skew IS NOT NULL AND roll_max IS NOT NULL AND roll_vol IS NOT NULL AND turnover IS NOT NULL AND composite IS NOT NULL"""
)
def lottery_features(spark, d):
    f = features.lottery_features(_bars(spark, d))
    return _round(_round(_round(f, "ret", "pt_value", "roll_skew", "roll_max", "roll_vol"), "turnover", places=9), "composite", places=5)


@query(
    f"""WITH {BARS} SELECT symbol, day, round(close, 9) + 0.0 AS close, round(CASE WHEN count(close) OVER w >= 20 THEN max(close) OVER w END, 9) + 0.0 AS channel_high,
round(CASE WHEN count(close) OVER w >= 20 THEN min(close) OVER w END, 9) + 0.0 AS channel_low FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"""
)
def donchian_channel(spark, d):
    return _round(features.donchian(_bars(spark, d)).select("symbol", "day", "close", "channel_high", "channel_low"), "close", "channel_high", "channel_low", places=9)


@query(
    f"""WITH {BARS}, s AS (SELECT a.day, ln(a.close) - ln(b.close) AS spread FROM bars a JOIN bars b USING (day) WHERE a.symbol = 'AF' AND b.symbol = 'RF')
SELECT day, round(spread, 6) + 0.0 AS spread, round(CASE WHEN count(*) OVER w >= 30 THEN CASE WHEN stddev_samp(spread) OVER w < 1e-8 THEN 0 ELSE (spread - avg(spread) OVER w) / stddev_samp(spread) OVER w END END, 6) + 0.0 AS z
FROM s WINDOW w AS (ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""
)
def pair_spread_zscore(spark, d):
    return _round(features.pair_spread(_bars(spark, d), "AF", "RF"), "spread", "z")


_Z = NormalDist().inv_cdf(0.05)
_TAIL = """,
o AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY ret) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM rets WHERE ret IS NOT NULL),
tail AS (SELECT symbol, -max(ret) FILTER (k = floor(0.05 * n + 1e-9) + 1) AS hist_var, -avg(ret) FILTER (k <= greatest(floor(0.05 * n + 1e-9), 1)) AS es FROM o GROUP BY symbol)"""


@query(f"WITH {BARS}{_TAIL} SELECT symbol, round(hist_var, 8) + 0.0 AS hist_var, round(es, 8) + 0.0 AS es FROM tail")
def hist_var_es(spark, d):
    return _round(risk.tail(features.returns(_bars(spark, d))), "hist_var", "es", places=8)


@query(
    f"""WITH {BARS}{_TAIL}, m AS (SELECT symbol, count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, skewness(ret) AS skew, kurtosis(ret) AS kurt,
  sqrt(avg(CASE WHEN ret < 0 THEN ret * ret ELSE 0 END)) AS down FROM rets WHERE ret IS NOT NULL GROUP BY symbol),
c AS (SELECT *, CAST({_Z!r} AS DOUBLE) AS z FROM m)
SELECT symbol, n, round(mean, 6) + 0.0 AS mean, round(sd, 6) + 0.0 AS sd, round(skew, 6) + 0.0 AS skew, round(kurt, 6) + 0.0 AS kurt, round(down, 6) + 0.0 AS down,
  round(-(mean + z * sd), 6) + 0.0 AS var_gauss, round(-(mean + (z + (z * z - 1) * skew / 6 + (z * z * z - 3 * z) * kurt / 24 - (2 * z * z * z - 5 * z) * skew * skew / 36) * sd), 6) + 0.0 AS var_cf,
  round(mean / sd * sqrt(365), 6) + 0.0 AS sharpe, round(mean / down * sqrt(365), 6) + 0.0 AS sortino, round(hist_var, 6) + 0.0 AS hist_var, round(es, 6) + 0.0 AS es FROM c JOIN tail USING (symbol)"""
)
def risk_report(spark, d):
    r = risk.report(features.returns(_bars(spark, d)))
    return _round(r, *[c for c in r.columns if c not in ("symbol", "n")])


@query(
    f"""WITH {BARS}, e AS (SELECT symbol, day, product(1 + ret) OVER w AS equity FROM rets WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY day)),
p AS (SELECT *, greatest(1, max(equity) OVER (PARTITION BY symbol ORDER BY day)) AS peak FROM e)
SELECT symbol, day, round(equity, 6) + 0.0 AS equity, round(1 - equity / peak, 6) + 0.0 AS drawdown FROM p"""
)
def drawdown(spark, d):
    return _round(risk.drawdown(features.returns(_bars(spark, d))).drop("peak"), "equity", "drawdown")


@query(f"WITH {BARS} SELECT a.symbol AS a, b.symbol AS b, round(corr(a.ret, b.ret), 6) + 0.0 AS corr, round(covar_samp(a.ret, b.ret), 6) + 0.0 AS covar FROM rets a JOIN rets b USING (day) WHERE a.symbol < b.symbol AND a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY a.symbol, b.symbol")
def corr_pairs(spark, d):
    return _round(risk.correlations(features.returns(_bars(spark, d))), "corr", "covar")


@query(f"WITH {QUOTES}, l AS (SELECT *, lag(seq) OVER (PARTITION BY symbol ORDER BY ts_us, seq) AS p FROM quotes) SELECT symbol, seq, CASE WHEN p IS NOT NULL THEN greatest(seq - p - 1, 0) ELSE 0 END AS gap, coalesce(seq <= p, false) AS out_of_order FROM l")
def feed_gaps(spark, d):
    return feed.gaps(_quotes(spark, d)).select("symbol", "seq", F.coalesce("gap", F.lit(0)).cast("long").alias("gap"), "out_of_order")


@query(
    f"""WITH {QUOTES}, a AS (SELECT *, ts_us - lag(ts_us) OVER w AS delta_us FROM quotes WINDOW w AS (PARTITION BY symbol ORDER BY ts_us, seq)),
b AS (SELECT *, lag(delta_us) OVER (PARTITION BY symbol ORDER BY ts_us, seq) AS p FROM a) SELECT symbol, seq, delta_us, CASE WHEN p > 0 THEN abs(delta_us - p) END AS jitter_us FROM b"""
)
def feed_jitter(spark, d):
    return feed.jitter(_quotes(spark, d)).select("symbol", "seq", "delta_us", "jitter_us")


@query(f"WITH {QUOTES} SELECT symbol, seq, round(bid, 6) + 0.0 AS bid, round(ask, 6) + 0.0 AS ask FROM quotes WHERE bid > 0 AND ask > 0 AND bid >= ask")
def feed_crossed(spark, d):
    return _round(feed.crossed(_quotes(spark, d)).select("symbol", "seq", "bid", "ask"), "bid", "ask")


@query(
    f"""WITH {QUOTES}, l AS (SELECT *, lag(seq) OVER (PARTITION BY symbol ORDER BY ts_us, seq) AS p FROM quotes)
SELECT symbol, count(*) AS packets, CAST(sum(CASE WHEN p IS NOT NULL THEN greatest(seq - p - 1, 0) ELSE 0 END) AS BIGINT) AS gap_total, count(*) FILTER (seq <= p) AS out_of_order, count(*) FILTER (bid > 0 AND ask > 0 AND bid >= ask) AS crossed,
  min(latency_us) AS latency_min, max(latency_us) AS latency_max, round(avg(latency_us), 6) + 0.0 AS latency_avg FROM l GROUP BY symbol"""
)
def feed_stats(spark, d):
    return _round(feed.stats(_quotes(spark, d)), "latency_avg")


@query(
    f"""WITH {QUOTES}, k AS (SELECT symbol, latency_us, row_number() OVER (PARTITION BY symbol ORDER BY ts_us DESC, seq DESC) AS k FROM quotes),
s AS (SELECT symbol, list(latency_us ORDER BY latency_us) AS a FROM k WHERE k <= 1000 GROUP BY symbol) SELECT symbol, a[CAST(floor(0.99 * (len(a) - 1)) AS INTEGER) + 1] AS p99_us FROM s"""
)
def feed_p99(spark, d):
    return feed.late_p99(_quotes(spark, d))


@query(f"WITH {QUOTES} SELECT symbol, seq, ts_us, last FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_us DESC, seq DESC) AS k FROM quotes) WHERE k <= 80")
def last_n_ticks(spark, d):
    return feed.last_n(_quotes(spark, d), 80).select("symbol", "seq", "ts_us", "last")


@query("SELECT event_id, event_type, value FROM events WHERE value >= 100")
def row_filter(spark, d):
    return table(spark, d, "events").where("value >= 100").select("event_id", "event_type", "value")


_SUBS = [("ui", 3, None, 1), ("risk", None, "purchase", 0), ("log", 1, "click", 2)]


@query(
    """WITH s(subscriber, topic, type, min_priority) AS (VALUES ('ui', 3, NULL, 1), ('risk', NULL, 'purchase', 0), ('log', 1, 'click', 2)),
e AS (SELECT event_id, user_id % 5 AS topic, event_type AS type, event_id % 4 AS priority FROM events)
SELECT subscriber, event_id, 'topic' AS via FROM e JOIN s ON e.topic = s.topic WHERE priority >= min_priority
UNION ALL SELECT subscriber, event_id, 'type' AS via FROM e JOIN s ON e.type = s.type WHERE priority >= min_priority"""
)
def event_routing(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 5).cast("int").alias("topic"), F.col("event_type").alias("type"), (F.col("event_id") % 4).cast("int").alias("priority"))
    return feed.route(e, spark.createDataFrame(_SUBS, "subscriber string, topic int, type string, min_priority int"))


@query(
    f"""WITH {QUOTES}, p AS (SELECT symbol, ts_us + 1000000 AS ts_us, seq AS pos_id FROM quotes)
SELECT p.symbol, p.ts_us, p.pos_id, q.last AS mark FROM p ASOF JOIN quotes q ON p.symbol = q.symbol AND p.ts_us >= q.ts_us"""
)
def mark_to_market(spark, d):
    q = _quotes(spark, d)
    return feed.mark_to_market(q.select("symbol", (F.col("ts_us") + 1_000_000).alias("ts_us"), F.col("seq").alias("pos_id")), q)


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) + 0.0 AS dot FROM embeddings")
def vector_dot(spark, d):
    return _round(table(spark, d, "embeddings").select("vec_id", feed.dot(F.col("embedding"), F.col("embedding")).alias("dot")), "dot")


_SEEDED = {
    "open": "CASE WHEN day(day) = 17 THEN CAST('NaN' AS DOUBLE) ELSE open END",
    "high": "CASE WHEN day(day) = 7 THEN low - 1 ELSE high END",
    "close": "CASE WHEN day(day) IN (11, 17) THEN -1.0 ELSE close END",
    "volume": "CASE WHEN day(day) = 13 THEN -1.0 ELSE volume END",
}
SEEDED = f""",
seeded AS (SELECT * REPLACE ({", ".join(f"{v} AS {k}" for k, v in _SEEDED.items())}) FROM bars),
x AS (SELECT symbol, day, {", ".join(f"CASE WHEN isfinite({c}) THEN {c} END AS {c[0]}" for c in ("open", "high", "low", "close", "volume"))} FROM seeded),
q AS (SELECT symbol, day, o IS NULL OR h IS NULL OR l IS NULL OR c IS NULL OR v IS NULL AS number, coalesce(least(o, h, l, c) <= 0, false) AS price,
  coalesce(v < 0, false) AS volume, coalesce(h < l, false) AS high_low, coalesce(o < l, false) OR coalesce(o > h, false) OR coalesce(c < l, false) OR coalesce(c > h, false) AS outside FROM x)"""


def _seeded(spark, d):
    """Bars of which some days are made to break a rule."""
    return _bars(spark, d).withColumns({k: F.expr(v).cast("double") for k, v in _SEEDED.items()})


@query(
    f"""WITH {BARS}{SEEDED} SELECT symbol, day, concat_ws(',', CASE WHEN number THEN 'number' END, CASE WHEN price THEN 'price' END, CASE WHEN volume THEN 'volume' END,
  CASE WHEN high_low THEN 'high_low' END, CASE WHEN outside THEN 'outside' END) AS broken FROM q WHERE number OR price OR volume OR high_low OR outside"""
)
def quarantine_split(spark, d):
    return quality.split(_seeded(spark, d))[1].select("symbol", "day", "broken")


@query(
    f"""WITH {BARS}{SEEDED} SELECT count_if(number)::BIGINT AS number, count_if(price)::BIGINT AS price, count_if(volume)::BIGINT AS volume, count_if(high_low)::BIGINT AS high_low, count_if(outside)::BIGINT AS outside,
  count_if(number OR price OR volume OR high_low OR outside)::BIGINT AS quarantined, count(*) AS rows FROM q"""
)
def quarantine_counts(spark, d):
    return quality.counts(_seeded(spark, d))


@query(
    f"""WITH RECURSIVE {BARS}, n AS (SELECT symbol, day, ret * ret AS q, row_number() OVER (PARTITION BY symbol ORDER BY day) AS i FROM rets WHERE ret IS NOT NULL),
g AS (SELECT symbol, day, i, greatest({volatility.OMEGA} + {volatility.ALPHA + volatility.BETA} * q, {volatility.FLOOR}) AS v, greatest(q, {volatility.FLOOR}) AS e FROM n WHERE i = 1
UNION ALL SELECT n.symbol, n.day, n.i, greatest({volatility.OMEGA} + {volatility.ALPHA} * n.q + {volatility.BETA} * g.v, {volatility.FLOOR}), greatest({volatility.DECAY} * g.e + {1 - volatility.DECAY} * n.q, {volatility.FLOOR})
  FROM g JOIN n ON n.symbol = g.symbol AND n.i = g.i + 1)
SELECT symbol, day, round(v, 6) + 0.0 AS variance, round(e, 6) + 0.0 AS ewma FROM g"""
)
def garch_path(spark, d):
    return _round(volatility.garch_path(features.returns(_bars(spark, d))), "variance", "ewma")

_LEVELS = ((95, 0.05), (99, 0.01))
_TAILS = "".join(
    f""",
tail{n} AS (SELECT symbol, -max(ret) FILTER (k = floor({1 - (1 - a)!r} * n + 1e-9) + 1) AS hist_var_{n}, -avg(ret) FILTER (k <= greatest(floor({1 - (1 - a)!r} * n + 1e-9), 1)) AS es_{n} FROM o GROUP BY symbol)"""
    for n, a in _LEVELS
)
_DRAWN = """,
eq AS (SELECT symbol, day, product(1 + ret) OVER (PARTITION BY symbol ORDER BY day) AS equity FROM rets WHERE ret IS NOT NULL),
pk AS (SELECT *, greatest(1, coalesce(max(equity) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)) AS before FROM eq),
st AS (SELECT *, sum(CASE WHEN equity > before THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY day) AS stretch FROM pk),
sd AS (SELECT symbol, max(1 - equity / greatest(before, equity)) AS d, count_if(equity <= before) AS bars FROM st GROUP BY symbol, stretch),
drawn AS (SELECT symbol, max(d) AS max_drawdown, max(bars)::BIGINT AS max_drawdown_duration FROM sd GROUP BY symbol)"""


def _var(n: int, p: float) -> str:
    z = NormalDist().inv_cdf(1 - (1 - p))
    cf = f"({z!r} + ({z * z - 1!r}) * skew / 6 + ({z**3 - 3 * z!r}) * kurt / 24 - ({2 * z**3 - 5 * z!r}) * skew * skew / 36)"
    return f"round(-(mean + ({z!r}) * sd), 6) + 0.0 AS var_gauss_{n}, round(-(mean + {cf} * sd), 6) + 0.0 AS var_cf_{n}, round(hist_var_{n}, 6) + 0.0 AS hist_var_{n}, round(es_{n}, 6) + 0.0 AS es_{n}"


@query(
    f"""WITH {BARS}, o AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY ret) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM rets WHERE ret IS NOT NULL){_TAILS}{_DRAWN},
m AS (SELECT symbol, count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, skewness(ret) AS skew, kurtosis(ret) AS kurt, avg(ret) * 365 AS ann_return, stddev_samp(ret) * sqrt(365) AS ann_vol,
  sqrt(avg(CASE WHEN ret < 0.02 / 365 THEN pow(ret - 0.02 / 365, 2) ELSE 0 END) * 365) AS down FROM rets WHERE ret IS NOT NULL GROUP BY symbol)
SELECT symbol, n, round(mean, 6) + 0.0 AS mean, round(sd, 6) + 0.0 AS sd, round(skew, 6) + 0.0 AS skew, round(kurt, 6) + 0.0 AS kurt, {", ".join(_var(n, p) for n, p in _LEVELS)},
  round(max_drawdown, 6) + 0.0 AS max_drawdown, max_drawdown_duration, round(ann_return, 6) + 0.0 AS ann_return, round(ann_vol, 6) + 0.0 AS ann_vol, round((ann_return - 0.02) / ann_vol, 6) + 0.0 AS sharpe,
  round((ann_return - 0.02) / down, 6) + 0.0 AS sortino, round(ann_return / max_drawdown, 6) + 0.0 AS calmar FROM m JOIN tail95 USING (symbol) JOIN tail99 USING (symbol) JOIN drawn USING (symbol)"""
)
def risk_report_full(spark, d):
    r = risk.full_report(features.returns(_bars(spark, d)), risk_free=0.02)
    return _round(r, *[c for c in r.columns if c not in ("symbol", "n", "max_drawdown_duration")])


@query(f"WITH {BARS}{_DRAWN} SELECT symbol, round(max_drawdown, 6) + 0.0 AS max_drawdown, max_drawdown_duration FROM drawn")
def max_drawdown(spark, d):
    return _round(risk.max_drawdown(features.returns(_bars(spark, d))), "max_drawdown")


@query(f"WITH {BARS} SELECT symbol, round(skewness(ret) * (count(ret) - 2) / sqrt(count(ret) * (count(ret) - 1)) * pow((count(ret) - 1) / count(ret), 1.5), 6) + 0.0 AS skew_raw, round((kurtosis_pop(ret) + 3) * pow((count(ret) - 1) / count(ret), 2) - 3, 6) + 0.0 AS kurt_raw FROM rets WHERE ret IS NOT NULL GROUP BY symbol")
def moments_raw(spark, d):
    return _round(risk.raw_moments(features.returns(_bars(spark, d))), "skew_raw", "kurt_raw")


@query(
    f"""WITH {BARS} SELECT symbol, day, round(CASE WHEN count(ret) OVER w > 2 THEN CASE WHEN var_pop(ret) OVER w > 1e-14 THEN skewness(ret) OVER w ELSE 0 END END, 5) + 0.0 AS roll_skew, round(max(ret) OVER w, 6) + 0.0 AS roll_max,
round(stddev_samp(ret) OVER w, 6) + 0.0 AS roll_vol FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"""
)
def rolling_stats_minperiods(spark, d):
    r = features.rolling_stats_short(features.returns(_bars(spark, d))).select("symbol", "day", "roll_skew", "roll_max", "roll_vol")
    return _round(_round(r, "roll_skew", places=5), "roll_max", "roll_vol")


def _garch_sql(omega: float, start: str) -> str:
    return f"""WITH RECURSIVE {BARS}, n AS (SELECT symbol, day, ret * ret AS q, row_number() OVER (PARTITION BY symbol ORDER BY day) AS i FROM rets WHERE ret IS NOT NULL),
g AS (SELECT symbol, day, i, greatest({omega} + {volatility.ALPHA} * q + {volatility.BETA} * {start}, {volatility.FLOOR}) AS v, greatest({volatility.DECAY} * {start} + {1 - volatility.DECAY} * q, {volatility.FLOOR}) AS e FROM n WHERE i = 1
UNION ALL SELECT n.symbol, n.day, n.i, greatest({omega} + {volatility.ALPHA} * n.q + {volatility.BETA} * g.v, {volatility.FLOOR}), greatest({volatility.DECAY} * g.e + {1 - volatility.DECAY} * n.q, {volatility.FLOOR})
  FROM g JOIN n ON n.symbol = g.symbol AND n.i = g.i + 1)"""


@query(f"{_garch_sql(1.2e-5, repr(1.2e-5 / (1 - volatility.ALPHA - volatility.BETA)))} SELECT symbol, day, round(v, 6) + 0.0 AS variance, round(e, 6) + 0.0 AS ewma FROM g")
def garch_path_long_run(spark, d):
    return _round(volatility.garch_path(features.returns(_bars(spark, d)), omega=1.2e-5, long_run=True), "variance", "ewma")


@query(f"{_garch_sql(volatility.OMEGA, 'q')} SELECT symbol, day, round(e, 6) + 0.0 AS ewma FROM g")
def ewma_path(spark, d):
    return _round(volatility.garch_path(features.returns(_bars(spark, d))).select("symbol", "day", "ewma"), "ewma")


@query(f"WITH {QUOTES} SELECT symbol, seq, ts_us, round(bid, 6) + 0.0 AS bid, round(ask, 6) + 0.0 AS ask, last FROM quotes q WHERE seq = (SELECT max(seq) FROM quotes p WHERE p.symbol = q.symbol)")
def market_snapshot(spark, d):
    return _round(feed.latest(_quotes(spark, d)).select("symbol", "seq", "ts_us", "bid", "ask", "last"), "bid", "ask")


@query(f"WITH {QUOTES}, k AS (SELECT symbol, latency_us, row_number() OVER (PARTITION BY symbol ORDER BY latency_us) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM quotes) SELECT symbol, max(latency_us) FILTER (k = ceil(0.99 * n)) AS latency_us FROM k GROUP BY symbol")
def latency_nearest_rank(spark, d):
    return feed.nearest_rank(_quotes(spark, d), 0.99).withColumn("latency_us", F.col("latency_us").cast("long"))


@query(
    f"""WITH {QUOTES}, l AS (SELECT *, lag(seq) OVER w AS p, ts_us - lag(ts_us) OVER w AS delta FROM quotes WINDOW w AS (PARTITION BY symbol ORDER BY ts_us, seq)), j AS (SELECT *, lag(delta) OVER (PARTITION BY symbol ORDER BY ts_us, seq) AS b FROM l)
SELECT symbol, count(*) AS packets, CAST(sum(CASE WHEN p IS NOT NULL THEN greatest(seq - p - 1, 0) ELSE 0 END) AS BIGINT) AS gap_total, count(*) FILTER (seq <= p) AS out_of_order, count(*) FILTER (bid > 0 AND ask > 0 AND bid >= ask) AS crossed,
  count(*) FILTER (delta > 1000000000) AS stale, count(*) FILTER (latency_us > 4500) AS spikes, round(avg(CASE WHEN b > 0 THEN abs(delta - b) END), 3) + 0.0 AS jitter_avg FROM j GROUP BY symbol"""
)
def feed_counters(spark, d):
    c = feed.counters(_quotes(spark, d), stale_us=1_000_000_000, spike_us=4500)
    return _round(c.drop("latency_min", "latency_max", "latency_avg"), "jitter_avg", places=3)


@query("SELECT event_id, CASE WHEN value >= 100 THEN round(value, 2) WHEN value >= 1 THEN round(value, 4) ELSE round(value, 6) END + 0.0 AS price FROM events")
def price_precision(spark, d):
    return table(spark, d, "events").select("event_id", feed.tick_price(F.col("value")).alias("price"))


@query("SELECT event_id, event_type FROM events WHERE lower(event_type) IN ('click', 'purchase')")
def symbol_filter(spark, d):
    return feed.symbols(table(spark, d, "events").select("event_id", "event_type"), ["CLICK", "Purchase"], "event_type")


@query(f"WITH {QUOTES} SELECT symbol, count_if(seq IS NULL)::BIGINT AS seq, count_if(last IS NULL)::BIGINT AS last FROM quotes GROUP BY symbol")
def null_counts(spark, d):
    return _quotes(spark, d).groupBy("symbol").agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("seq", "last")])



from . import engine, evaluation, streams, tables, trading  # noqa: E402, F401  (they register theirs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
