"""Queries on the order-driven engine, tasks and the live feed, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.market import table
from ..operators import engine, schedule
from .registry import _P, _B, BARS, _bars, _round, _w, query
from .trading import _fills, _FILLS

_ENGINE_CPT = f""",
num AS (SELECT symbol, day, close, ret, row_number() OVER (PARTITION BY symbol ORDER BY day) AS i FROM rets),
near AS (SELECT a.symbol, a.i, b.ret FROM num a JOIN num b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 39 AND a.i WHERE b.ret IS NOT NULL),
ranked AS (SELECT symbol, i, ret, CAST(row_number() OVER (PARTITION BY symbol, i, ret >= 0 ORDER BY abs(ret) DESC) AS DOUBLE) AS k, CAST(count(*) OVER (PARTITION BY symbol, i) AS DOUBLE) AS n FROM near),
cpt AS (SELECT symbol, i, CASE WHEN max(n) >= 10 THEN sum(CASE WHEN ret >= 0 THEN ({_w(_P, 0.61)} - {_w(_B, 0.61)}) * pow(ret, 0.88) ELSE ({_w(_P, 0.69)} - {_w(_B, 0.69)}) * -2.25 * pow(-ret, 0.88) END) ELSE 0 END AS cpt FROM ranked GROUP BY symbol, i),
c AS (SELECT num.symbol, day, close, num.i, coalesce(cpt, 0) AS cpt, CASE WHEN count(close) OVER w >= 19 THEN max(close) OVER w END AS hi, CASE WHEN count(close) OVER w >= 19 THEN min(close) OVER w END AS lo
  FROM num LEFT JOIN cpt USING (symbol, i) WINDOW w AS (PARTITION BY num.symbol ORDER BY num.i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""


@query(
    f"""WITH RECURSIVE {BARS}{_ENGINE_CPT},
s AS (SELECT symbol, day, close, i, 0 AS held, 0.0::DOUBLE AS entry, 0.0::DOUBLE AS peak, NULL::VARCHAR AS side, 0.0::DOUBLE AS gain FROM c WHERE i = 1
  UNION ALL SELECT c.symbol, c.day, c.close, c.i, x.h, CASE WHEN x.h = 0 THEN 0 WHEN s.held = 0 THEN c.close ELSE s.entry END, CASE WHEN x.h = 0 THEN 0 WHEN s.held = 0 OR c.hi IS NULL THEN greatest(s.peak * s.held, c.close) ELSE greatest(s.peak, c.close) END,
    CASE WHEN x.h > s.held THEN 'BUY' WHEN x.h < s.held THEN 'SELL' END, s.gain + CASE WHEN x.h < s.held THEN c.close - s.entry ELSE 0 END
  FROM s JOIN c ON c.symbol = s.symbol AND c.i = s.i + 1, LATERAL (SELECT CASE WHEN c.hi IS NULL THEN s.held WHEN s.held = 0 THEN CAST(c.close > c.hi AND c.cpt >= -0.05 AS INTEGER)
    WHEN c.close <= s.entry * (1 - 0.03::DOUBLE) OR c.close <= greatest(s.peak, c.close) * (1 - 0.05::DOUBLE) OR c.close < c.lo THEN 0 ELSE 1 END AS h) x)
SELECT symbol, day, side AS order_side, round(close, 6) + 0.0 AS close, round(gain, 4) + 0.0 AS realized FROM s WHERE side IS NOT NULL"""
)
def engine_breakout(spark, d):
    o = engine.breakout_orders(engine.breakout_events(_bars(spark, d)), gate=-0.05, fill_at_close=True)
    return _round(_round(o.where("order_side is not null").select("symbol", "day", "order_side", "close", "realized"), "close"), "realized", places=4)


_PAIRED = f"""{BARS},
legs AS (SELECT day, symbol = 'RF' AS leg, close, row_number() OVER (ORDER BY day, symbol = 'RF') AS i FROM bars WHERE symbol IN ('AF', 'RF')),
m AS (SELECT i, day, CASE WHEN NOT leg THEN close ELSE 0 END AS a, CASE WHEN leg THEN close ELSE 0 END AS b, NOT leg AS new_a, leg AS new_b, false AS met FROM legs WHERE i = 1
  UNION ALL SELECT l.i, l.day, CASE WHEN l.leg THEN m.a ELSE l.close END, CASE WHEN l.leg THEN l.close ELSE m.b END, ((m.new_a AND NOT m.met) OR NOT l.leg), ((m.new_b AND NOT m.met) OR l.leg),
    ((m.new_a AND NOT m.met) OR NOT l.leg) AND ((m.new_b AND NOT m.met) OR l.leg) FROM m JOIN legs l ON l.i = m.i + 1),
paired AS (SELECT day, a, b, row_number() OVER (ORDER BY i) AS i FROM m WHERE met)"""


@query(f"WITH RECURSIVE {_PAIRED} SELECT day, round(a, 9) + 0.0 AS price_a, round(b, 9) + 0.0 AS price_b FROM paired")
def pair_latest_bars(spark, d):
    return _round(engine.paired_bars(_bars(spark, d), "AF", "RF").drop("pair"), "price_a", "price_b", places=9)


@query(
    f"""WITH RECURSIVE {_PAIRED}, sp AS (SELECT day, i, a, b, ln(a) - 0.8::DOUBLE * ln(b) AS spread FROM paired),
z AS (SELECT day, i, a, b, CASE WHEN count(*) OVER w >= 30 THEN CASE WHEN stddev_samp(spread) OVER w < 1e-8 THEN NULL ELSE (spread - avg(spread) OVER w) / stddev_samp(spread) OVER w END END AS z
  FROM sp WINDOW w AS (ORDER BY i ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
s AS (SELECT day, i, z, 0 AS state, 0.0::DOUBLE AS held, 0 AS trade FROM z WHERE i = 1
  UNION ALL SELECT z.day, z.i, z.z, x.st, CASE WHEN s.state = 0 THEN 2.0::DOUBLE * 0.8::DOUBLE * (z.a / z.b) ELSE s.held END, x.st - s.state FROM s JOIN z ON z.i = s.i + 1,
    LATERAL (SELECT CASE WHEN z.z IS NULL THEN s.state WHEN s.state = 0 THEN CASE WHEN z.z <= -2 THEN 1 WHEN z.z >= 2 THEN -1 ELSE 0 END WHEN z.z * s.state >= -0.2 OR z.z * s.state <= -3.5 THEN 0 ELSE s.state END AS st) x)
SELECT day, round(z, 6) + 0.0 AS z, state, CASE WHEN trade > 0 THEN 'BUY' ELSE 'SELL' END AS side_a, 2.0::DOUBLE AS qty_a, CASE WHEN trade > 0 THEN 'SELL' ELSE 'BUY' END AS side_b, round(held, 6) + 0.0 AS qty_b FROM s WHERE trade <> 0"""
)
def engine_pairs(spark, d):
    o = engine.pair_orders(engine.paired_bars(_bars(spark, d), "AF", "RF"), hedge=0.8, qty=2.0).where("side_a is not null")
    return _round(o.select("day", "z", "state", "side_a", "qty_a", "side_b", "qty_b"), "z", "qty_b")


@query(
    """WITH RECURSIVE e AS (SELECT n_nationkey AS task, n_nationkey - 3 AS needed FROM nation WHERE n_nationkey >= 3 UNION ALL SELECT n_nationkey, n_nationkey // 2 FROM nation WHERE n_nationkey > 0),
l AS (SELECT n_nationkey AS task, 0 AS wave FROM nation UNION SELECT e.task, l.wave + 1 FROM l JOIN e ON e.needed = l.task),
w AS (SELECT task, max(wave)::INTEGER AS wave FROM l GROUP BY task)
SELECT w.task, wave, (row_number() OVER (PARTITION BY wave ORDER BY n_regionkey DESC, lpad(w.task::VARCHAR, 2, '0')))::INTEGER AS place FROM w JOIN nation ON n_nationkey = w.task"""
)
def task_waves(spark, d):
    n = {f"{r.n_nationkey:02d}": r.n_regionkey for r in table(spark, d, "nation").collect()}  # a graph of tasks, not a table of rows
    needs = [(f"{i:02d}", f"{i - 3:02d}") for i in range(3, len(n))] + [(f"{i:02d}", f"{i // 2:02d}") for i in range(1, len(n))]
    rows = [(int(t), w, i + 1) for w, wave in enumerate(schedule.waves(n, needs)) for i, t in enumerate(wave)]
    return spark.createDataFrame(rows, "task int, wave int, place int")


@query(
    """WITH RECURSIVE t AS (SELECT n_nationkey AS task, (n_nationkey * 10)::BIGINT AS first, CASE WHEN n_nationkey % 4 > 0 THEN (7 + n_regionkey)::BIGINT END AS every, n_nationkey % 2 = 0 AS skip FROM nation),
x AS (SELECT 1 AS i, 40::BIGINT AS time UNION ALL SELECT 2, 95 UNION ALL SELECT 3, 100 UNION ALL SELECT 4, 230 UNION ALL SELECT 5, 260),
s AS (SELECT task, 0 AS i, 0::BIGINT AS time, every, skip, false AS due, first AS next FROM t
  UNION ALL SELECT s.task, x.i, x.time, s.every, s.skip, coalesce(s.next <= x.time, false), CASE WHEN coalesce(s.next > x.time, true) THEN s.next WHEN s.every IS NULL THEN NULL WHEN s.skip THEN s.next + s.every * ((x.time - s.next) // s.every + 1) ELSE s.next + s.every END
  FROM s JOIN x ON x.i = s.i + 1)
SELECT task, time, due, coalesce(next, -1) AS next FROM s WHERE i > 0"""
)
def scheduler_steps(spark, d):
    t = table(spark, d, "nation").select(
        F.col("n_nationkey").alias("task"), (F.col("n_nationkey") * 10).alias("first"), F.when(F.col("n_nationkey") % 4 > 0, 7 + F.col("n_regionkey")).alias("every"), (F.col("n_nationkey") % 2 == 0).alias("skip_missed")
    )
    return schedule.steps(t, [40, 95, 100, 230, 260]).withColumn("next", F.coalesce("next", F.lit(-1).cast("long")))


@query(f"WITH RECURSIVE {_FILLS} SELECT symbol, seq, CASE WHEN sign > 0 THEN 'BUY' ELSE 'SELL' END AS side, qty FROM t ORDER BY seq DESC, symbol LIMIT 100")
def trade_blotter(spark, d):
    return schedule.blotter(_fills(spark, d).select("symbol", "seq", "side", "qty"), 100)
