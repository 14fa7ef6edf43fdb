"""Resting orders against ticks: one walk back in time, with the prices yet to come kept as ladders of new extremes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of `way`. Orders wait for 0: a low ask, 1: a high ask, 2: a low bid, 3: a high bid; at one time they come before ticks.
TICK, FILL = 4, 5
KEYS = ("symbol", "ts_us", "way", "seq")


def rows(orders: DataFrame, ticks: DataFrame) -> DataFrame:
    """(symbol, ts_us, way, order_id, seq, x, y): ticks with ask and bid as x and y, orders with their price as x."""
    buy = F.col("side") == "BUY"
    low = F.coalesce(buy == (F.col("type") == "LIMIT"), F.lit(False))  # buy limits and sell stops wait for a low price
    way = F.when(buy, 0).otherwise(2) + F.when(low, 0).otherwise(1)
    o = orders.where("symbol is not null and ts_us is not null and price is not null").select(
        "symbol", F.col("ts_us").cast("long").alias("ts_us"), way.cast("byte").alias("way"), "order_id", F.lit(None).cast(ticks.schema["seq"].dataType).alias("seq"), F.col("price").cast("double").alias("x"), F.lit(None).cast("double").alias("y")
    )
    t = ticks.where("symbol is not null and ts_us is not null").select(
        "symbol", F.col("ts_us").cast("long").alias("ts_us"), F.lit(TICK).cast("byte").alias("way"), F.lit(None).cast(orders.schema["order_id"].dataType).alias("order_id"), "seq", F.col("ask").cast("double").alias("x"), F.col("bid").cast("double").alias("y")
    )
    return o.unionByName(t)


def backwards(df: DataFrame, last: bool) -> DataFrame:
    """Fills of each partition's orders by its own ticks, and unless it is the last walk, what other partitions need of it.

    Every partition holds a gapless range of the rows by symbol and time. What is left: open orders of its latest symbol, which
    later ticks may meet, and of its earliest symbol the ticks that are first to reach a price, which earlier orders may wait for.
    """
    return df.sortWithinPartitions(*(F.col(k).desc() for k in (*KEYS, "x", "y"))).mapInArrow(_walk(last), df.schema)


def _walk(last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    none = np.iinfo(np.int64).max

    def code(a: pa.Array, way: int) -> np.ndarray:
        """Integers in the order of the numbers, NaN above all; descending for high prices, so that an order always waits for no more than its own. Null: never met."""
        v = a.fill_null(0.0).to_numpy(zero_copy_only=False) + 0.0  # -0.0 is 0.0
        bits = np.where(np.isnan(v), np.nan, v).view(np.int64)
        bits = np.where(bits < 0, bits ^ none, bits)
        return np.where(a.is_null().to_numpy(zero_copy_only=False), none, ~bits if way % 2 else bits)

    def first(v: np.ndarray, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """For each place in `at` the first one from there on where v is no more than `most`; len(v) if there is none."""
        n = len(v)
        least = [np.append(v, none)]  # the k-th has the least of 2 ** k values from each place on
        while 1 << (len(least) - 1) < n:
            a, step = least[-1], 1 << (len(least) - 1)
            b = a.copy()
            np.minimum(a[: n - step], a[step:n], out=b[: n - step])
            least.append(b)
        for k in range(len(least) - 1, -1, -1):
            at = np.where(least[k][at] > most, np.minimum(at + (1 << k), n), at)
        return at

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, latest, symbol, ladders, seen = None, None, None, None, 0
        # ladders[way]: of the symbol last walked, the codes and rows of ticks that are first to reach a price, from the earliest on
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            schema = pa.schema([f.with_nullable(True) for f in batch.schema])
            b = pa.Table.from_batches([batch]).cast(schema).take(pa.array(np.arange(n - 1, -1, -1))).combine_chunks()  # forwards in time
            col = {c: b.column(c).combine_chunks() for c in b.column_names}
            named = col["symbol"].dictionary_encode().indices.to_numpy(zero_copy_only=False)
            part = np.append(0, np.cumsum(named[1:] != named[:-1]))
            early, late = col["symbol"][0].as_py(), col["symbol"][n - 1].as_py()
            if latest is None:
                latest = (late,)
            ways = col["way"].to_numpy(zero_copy_only=False)
            ticks = np.flatnonzero(ways == TICK)
            before = np.cumsum(ways == TICK)
            quotes = b.take(pa.array(ticks)).append_column("n", pa.array(seen - n + ticks))
            seen -= n
            goes_on = part[-1] == 0 and (early,) == symbol
            own, made, unmet = np.searchsorted(part[ticks], 0, "right"), [], []
            new = []
            for way in range(4):
                price = "y" if way > 1 else "x"
                v = code(quotes.column(price).combine_chunks(), way)
                o = np.flatnonzero(ways == way)
                if len(o):
                    most = code(col["x"].take(pa.array(o)), way)
                    hit = first(v, before[o], most)
                    met = hit < len(v)
                    met[met] = part[ticks[hit[met]]] == part[o[met]]
                    made.append((o[met], quotes.take(pa.array(hit[met])), price))
                    o, most = o[~met], most[~met]
                    if (late,) == symbol:
                        w, to_come = ladders[way]
                        ends = part[o] == part[-1]
                        hit = np.where(ends, np.searchsorted(~w, ~most, "left"), len(w))
                        met = hit < len(w)
                        made.append((o[met], to_come.take(pa.array(hit[met])), price))
                        o = o[~met]
                    if (late,) == latest and not last:
                        unmet.append(o[part[o] == part[-1]])
                least = np.minimum.accumulate(v[:own])
                rung = np.flatnonzero(least < np.append(none, least[:-1]))
                w, to_come = v[rung], quotes.take(pa.array(rung))
                if goes_on:
                    k = np.searchsorted(~ladders[way][0], ~least[-1], "right") if own else 0
                    w, to_come = np.append(w, ladders[way][0][k:]), pa.concat_tables([to_come, ladders[way][1].slice(k)]).combine_chunks()
                new.append((w, to_come))
            symbol, ladders = (early,), new
            for o, t, price in made:
                if len(o):
                    fills = {"symbol": col["symbol"].take(pa.array(o)), "ts_us": t.column("ts_us"), "way": pa.array(np.full(len(o), FILL, np.int8)), "order_id": col["order_id"].take(pa.array(o)), "seq": t.column("seq"), "x": t.column(price), "y": pa.nulls(len(o), pa.float64())}
                    yield from pa.table([fills[f.name] for f in schema], schema).to_batches()
            if unmet and (o := np.concatenate(unmet)).size:
                yield from b.take(pa.array(o)).to_batches()
        if symbol is not None and not last:
            rungs = pa.concat_tables([t for _, t in ladders]).combine_chunks()
            _, once = np.unique(rungs.column("n").to_numpy(), return_index=True)
            yield from rungs.select(schema.names).take(pa.array(once)).to_batches()

    return walk
