"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

A first query warms the session up and is not counted. `more` has times beside the headline: newer queries, and a scan of a table apart from building it.
"""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from tidemark.plans import registry
from tidemark.sources.storage import scratch
from tidemark.sources.versioned import VersionedTable

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NAMES = "bars_daily returns_pct_change rolling_stats_60 rolling_cpt_60 lottery_features risk_report drawdown corr_pairs feed_stats mark_to_market event_routing garch_forecast breakout_backtest resting_order_fills roc_auc skipping_scan".split()


MORE = "risk_report_full max_drawdown rolling_stats_minperiods engine_breakout engine_pairs broker_fills".split()


def scan_only(spark: SparkSession, timed) -> float:
    """A read with a predicate of a table that is there already."""
    bars = registry.queries()["bars_daily"](spark, SF)
    t = VersionedTable.create(spark, scratch(spark, "bench"), bars.schema, [("symbol", "identity", "symbol")])
    t.append(bars)
    return timed(lambda: t.read([("close", ">", 1000.0)], {"symbol": "AF"}))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='bench-')}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    def timed(df) -> float:
        began = time.time()
        df().write.format("noop").mode("overwrite").save()
        return round(time.time() - began, 3)

    queries = registry.queries()
    timed(lambda: queries["bars_daily"](spark, SF))
    took = {name: timed(lambda: queries[name](spark, SF)) for name in NAMES}
    more = {name: timed(lambda: queries[name](spark, SF)) for name in MORE}
    more["scan_only"] = scan_only(spark, timed)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF, "more": more}))


if __name__ == "__main__":
    main()
