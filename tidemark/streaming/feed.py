"""Feed monitoring on a stream: state for each symbol, anomalies as rows, and a watchdog for silent feeds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ANOMALIES = "symbol string, type string, seq long, expected long, ts_us long, latency_us double, jitter_us double"
STATE = "last_seq long, last_ts long, last_delta long, packets long"


def _changes(state: tuple | None, key: str, rows) -> tuple[tuple, list[tuple]]:
    """Folds packets (seq, ts_us, bid, ask, latency_us) in order of arrival; gives the state and the anomalies."""
    last_seq, last_ts, delta, n = state or (None, None, None, 0)
    out = []
    for seq, ts, bid, ask, latency in rows:
        step = None if last_ts is None else ts - last_ts
        jitter = float(abs(step - delta)) if step is not None and delta is not None and delta > 0 else None
        if last_seq is not None and seq > last_seq + 1:
            out.append((key, "gap", seq, last_seq + 1, ts, latency, jitter))
        elif last_seq is not None and seq <= last_seq:
            out.append((key, "out_of_order", seq, last_seq + 1, ts, latency, jitter))
        if bid > 0 and ask > 0 and bid >= ask:
            out.append((key, "crossed", seq, seq, ts, latency, jitter))
        last_seq, last_ts, delta, n = seq, ts, step, n + 1
    return (last_seq, last_ts, delta, n), out


def anomalies(packets: DataFrame, silent_ms: int | None = 500) -> DataFrame:
    """Anomalies of a stream of packets (symbol, seq, ts_us, bid, ask, latency_us): gap, out_of_order, crossed, stale.

    A micro-batch's packets of a symbol are taken by time. A symbol without packets for longer than silent_ms is stale, and
    again after each such time until it speaks; its row holds its last packet. Without silent_ms there is no watchdog, and a
    stream over files that are there can end; with it, Spark keeps running empty batches.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = tuple(None if v is None or v != v else int(v) for v in state.get) if state.exists else None
        if state.hasTimedOut:
            out = [(key[0], "stale", old[0], old[0] + 1, old[1], None, None)]
            new = old
        else:
            rows = pd.concat(list(batches)).sort_values(["ts_us", "seq"])
            new, out = _changes(old, key[0], rows[["seq", "ts_us", "bid", "ask", "latency_us"]].itertuples(index=False, name=None))
        state.update(new)
        if silent_ms is not None:
            state.setTimeoutDuration(silent_ms)
        yield pd.DataFrame(out, columns=["symbol", "type", "seq", "expected", "ts_us", "latency_us", "jitter_us"]).astype({"latency_us": float, "jitter_us": float})

    p = packets.select("symbol", "seq", "ts_us", "bid", "ask", packets["latency_us"].cast("double").alias("latency_us"))
    return p.groupBy("symbol").applyInPandasWithState(run, ANOMALIES, STATE, "append", GroupStateTimeout.NoTimeout if silent_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
