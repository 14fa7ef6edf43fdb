"""Stages over batches or streams, fan-out to subscribers, and running a stream to its end."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import forest

Stage = Callable[[DataFrame], DataFrame]


def chain(df: DataFrame, *stages: Stage) -> DataFrame:
    """The stages one after another. Sources are read at the pace of the slowest: nothing is dropped."""
    for s in stages:
        df = df.transform(s)
    return df


def inference(df: DataFrame) -> DataFrame:
    """Stage: the forest's probability and alert, with counts of rows and alerts as observed metrics of each batch."""
    return forest.scored(df).observe("inference", F.count("*").alias("rows"), F.count_if("alert").alias("alerts"))


@dataclass
class Bus:
    """Subscribers by topic or type with a least priority, served batch by batch; one that fails does not stop the others."""

    subscribers: list[tuple[str, Column, Callable[[DataFrame], None]]] = field(default_factory=list)
    failures: dict[str, int] = field(default_factory=dict)

    def subscribe(self, name: str, handler: Callable[[DataFrame], None], topic: int | None = None, type: str | None = None, min_priority: int = 0) -> None:
        wanted = F.lit(True) if topic is None and type is None else F.lit(False)
        wanted = wanted if topic is None else wanted | (F.col("topic") == topic)
        wanted = wanted if type is None else wanted | (F.col("type") == type)
        self.subscribers.append((name, wanted & (F.col("priority") >= min_priority), handler))

    def publish(self, events: DataFrame, batch: int = 0) -> None:
        """For foreachBatch, or for a batch by itself."""
        events = events.persist()
        try:
            for name, wanted, handler in self.subscribers:
                try:
                    handler(events.where(wanted))
                except Exception:
                    self.failures[name] = self.failures.get(name, 0) + 1
        finally:
            events.unpersist()


def run_to_end(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that its sources hold now, into Parquet files under path, and reads them."""
    q = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out")
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out")
