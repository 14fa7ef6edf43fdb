"""Running streams together: sources at a bounded rate, admission of a batch, plugins, and an engine that starts, watches and stops queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.errors import AlreadyExists, InvalidArgument, NotFound


def files(spark: SparkSession, path: str, schema: StructType | str, per_trigger: int = 100, kind: str = "parquet") -> DataFrame:
    """A stream over a folder's files, so many at most in one batch: the pace is bounded at the source and nothing is dropped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(path)


def admit(batch: DataFrame, capacity: int, policy: str = "block", order: str = "seq") -> DataFrame:
    """The rows of a batch that go on: all (block), the first `capacity` by order (reject_new), or the last (drop_oldest)."""
    if policy == "block":
        return batch
    if policy == "reject_new":
        return batch.orderBy(order).limit(capacity)
    if policy == "drop_oldest":
        return batch.orderBy(F.desc(order)).limit(capacity)
    raise InvalidArgument(f"unknown policy {policy}")


@dataclass
class Plugin:
    """Named functions of a batch; with hooks, only for these events."""

    id: str
    name: str
    version: str
    handle: Callable[[str, DataFrame], None]
    hooks: frozenset[str] = frozenset()
    on_activate: Callable[[], None] | None = None
    on_deactivate: Callable[[], None] | None = None


@dataclass
class Plugins:
    """Plugins by id. One that fails is counted and does not stop the others."""

    known: dict[str, Plugin] = field(default_factory=dict)
    active: dict[str, Plugin] = field(default_factory=dict)
    calls: dict[str, int] = field(default_factory=dict)
    faults: dict[str, int] = field(default_factory=dict)

    def register(self, plugin: Plugin) -> None:
        if not (plugin.id and plugin.name and plugin.version):
            raise InvalidArgument("a plugin needs an id, a name and a version")
        if plugin.id in self.known:
            raise AlreadyExists(plugin.id)
        self.known[plugin.id] = plugin

    def activate(self, id_: str) -> None:
        """Again for an active one does nothing; one whose start fails stays inactive."""
        if id_ not in self.known:
            raise NotFound(id_)
        if id_ not in self.active:
            if start := self.known[id_].on_activate:
                start()
            self.active[id_] = self.known[id_]

    def deactivate(self, id_: str) -> None:
        if id_ not in self.known:
            raise NotFound(id_)
        if (p := self.active.pop(id_, None)) and p.on_deactivate:
            p.on_deactivate()

    def dispatch(self, hook: str, batch: DataFrame) -> int:
        """Gives the batch to the active plugins that want the hook; how many took it without a fault."""
        done = 0
        for id_, p in list(self.active.items()):
            if p.hooks and hook not in p.hooks:
                continue
            try:
                p.handle(hook, batch)
                self.calls[id_] = self.calls.get(id_, 0) + 1
                done += 1
            except Exception:
                self.faults[id_] = self.faults.get(id_, 0) + 1
        return done


class Engine:
    """Streaming queries by name: started in the order they were added, stopped in reverse.

    The state is created, running, stopped or faulted. Health comes from the queries themselves: an ended one with an error makes the engine
    unhealthy, one that ended otherwise makes it degraded.
    """

    def __init__(self):
        self.state = "created"
        self._starts: dict[str, Callable[[], StreamingQuery]] = {}
        self._queries: dict[str, StreamingQuery] = {}

    def add(self, name: str, start: Callable[[], StreamingQuery]) -> None:
        if name in self._starts:
            raise AlreadyExists(name)
        self._starts[name] = start

    def start(self) -> None:
        for name, start in self._starts.items():
            try:
                self._queries[name] = start()
            except Exception:
                self.stop()
                self.state = "faulted"
                raise
        self.state = "running"

    def stop(self) -> None:
        for name in reversed(list(self._queries)):
            self._queries.pop(name).stop()
        self.state = "stopped"

    def health(self) -> str:
        if self.state == "faulted" or any(q.exception() for q in self._queries.values()):
            return "unhealthy"
        return "healthy" if all(q.isActive for q in self._queries.values()) else "degraded"

    def drain(self) -> None:
        """Waits until every query has read what its sources hold now; nothing unless running."""
        if self.state == "running":
            for q in self._queries.values():
                q.processAllAvailable()

    def metrics(self) -> dict[str, dict]:
        """Of each query: its last batch, rows read in it and what its plan observes."""
        out = {}
        for name, q in self._queries.items():
            p = q.lastProgress
            observed = {} if not p else {k: v.asDict() if hasattr(v, "asDict") else dict(v) for k, v in (p["observedMetrics"] or {}).items()}
            out[name] = {"active": q.isActive, "batch": p["batchId"] if p else -1, "rows": p["numInputRows"] if p else 0, "observed": observed}
        return out
