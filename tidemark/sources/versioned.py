"""Tables of Parquet files with a log of versions: appends, replacement, time travel, skipping, compaction, vacuum and audit.

A version is one file of JSON lines in `_log`, put there only if absent: of two writers from the same version one succeeds.
Lines add or remove files, with the bounds of their columns. The state at a version is the last line of each path, found by
Spark over the log; the driver holds only the paths that a scan selects, and the new files of its own commit.
Every CHECKPOINT versions the state is also written as Parquet, so that a read takes the last such state and the few log files since.
"""

from __future__ import annotations

import json
import math
import random
import time
import uuid
from collections.abc import Callable, Iterable
from datetime import date, datetime
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .errors import AlreadyExists, ConcurrentModification, InvalidArgument, NotFound
from .schemas import conform, drift
from .storage import Store

LOG = (
    "kind string, version long, parent long, time_ms long, operation string, schema string, spec string, "
    "path string, bytes long, rows long, part map<string,string>, low map<string,double>, high map<string,double>, low_text map<string,string>, high_text map<string,string>, nulls map<string,long>"
)
STATE = ("kind", "bytes", "rows", "part", "low", "high", "low_text", "high_text", "nulls")
CHECKPOINT = 10
NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz"}
TIME_FORMATS = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd-HH"}


def partition_value(column: Column, transform: str) -> Column:
    """identity, bucket[n], or year, month, day, hour of a time or of epoch nanoseconds; as text, "null" for a null."""
    if transform.startswith("bucket["):
        v = F.pmod(F.xxhash64(column.cast("string")), F.lit(max(int(transform[7:-1]), 1)))
        v = F.when(column.isNotNull(), v)
    elif transform in TIME_FORMATS:
        v = F.date_format(column, TIME_FORMATS[transform])
    elif transform == "identity":
        v = column
    else:
        raise InvalidArgument(f"unknown transform {transform}")
    return F.coalesce(v.cast("string"), F.lit("null"))


def ns_time(column: Column) -> Column:
    return F.timestamp_micros(F.floor(column / 1000))


def _measure(name: str, kind: str) -> Column:
    """A column's value as bounds hold it."""
    c = F.col(f"`{name}`")
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)")
    return F.unix_date(c) if kind == "date" else c


def _bound(value, kind: str):
    """A predicate's value in the same measure."""
    if kind == "timestamp_ntz":
        return (value - datetime(1970, 1, 1)).total_seconds() * 1e6
    if kind == "timestamp":
        return value.timestamp() * 1e6
    if kind == "date":
        return float((value - date(1970, 1, 1)).days)
    return float(value) if kind in NUMBERS else str(value)


OPS = {
    "=": lambda c, v: c == v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
}


class VersionedTable:
    """Predicates are (column, op, value) with op one of =, <, <=, >, >= and between (value: a pair); all must hold."""

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location, self.store = spark, location.rstrip("/"), Store(spark, location)
        if not self.store.exists("_log"):
            raise NotFound(location)

    @classmethod
    def create(cls, spark: SparkSession, location: str, schema: StructType, spec: Iterable[tuple[str, str, str]] = ()) -> VersionedTable:
        """spec: (name, transform, column) of each partition value."""
        store = Store(spark, location)
        store.make("_log")
        store.make("data")
        t = cls(spark, location)
        for _, transform, column in spec:
            if column not in schema.names:
                raise InvalidArgument(f"no column {column}")
            partition_value(F.lit(None), transform)
        if not t._put(0, {"operation": "create", "parent": -1, "schema": schema.json(), "spec": json.dumps([list(s) for s in spec])}, []):
            raise AlreadyExists(location)
        return t

    # The log

    def _put(self, version: int, head: dict, lines: list[dict]) -> bool:
        rows = [{"kind": "commit", "version": version, "time_ms": int(time.time() * 1000), **head}, *({"version": version, **x} for x in lines)]
        return self.store.put_if_absent(f"_log/{version:020d}.json", "\n".join(map(json.dumps, rows)) + "\n")

    def version(self) -> int:
        return max(int(n[:-5]) for n in self.store.names("_log") if n.endswith(".json") and n[0].isdigit())

    def log(self, version: int | None = None, after: int = -1) -> DataFrame:
        """The lines of the versions up to the given one (the last, if none is), but for those up to `after`."""
        last = self.version() if version is None else version
        names = [n for n in self.store.names("_log") if n.endswith(".json") and n[0].isdigit() and int(n[:-5]) <= last]
        if version is not None and f"{version:020d}.json" not in names:
            raise NotFound(f"version {version}")
        names = [n for n in names if int(n[:-5]) > after]
        if not names:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).json([f"{self.location}/_log/{n}" for n in names])

    def history(self) -> DataFrame:
        return self.log().where("kind = 'commit'").select("version", "parent", "time_ms", "operation")

    def as_of(self, time_ms: int) -> int:
        """The version of the greatest time that is not later; the first of equal times."""
        r = self.history().where(F.col("time_ms") <= time_ms).orderBy(F.desc("time_ms"), "version").first()
        if r is None:
            raise NotFound(f"no version at {time_ms}")
        return r.version

    def lineage(self) -> list[str]:
        """What is wrong with the chain of versions: gaps, parents that are not the version before, times that go back."""
        w = Window.orderBy("version")  # one row for each version
        h = self.history().withColumns({"before": F.lag("version").over(w), "then": F.lag("time_ms").over(w)})
        bad = h.where("before is not null and (parent <> before or version <> before + 1 or time_ms < then) or before is null and parent <> -1")
        return [f"version {r.version}: parent {r.parent}, before it {r.before}" for r in bad.orderBy("version").collect()]

    def checkpoint(self, version: int | None = None) -> int:
        """Writes the state of a version, so that later reads need no log file up to it. Which state of two writers counts makes no difference."""
        version = self.version() if version is None else version
        folder = f"_states/{version:020d}-{uuid.uuid4().hex}"
        self.files(version).write.parquet(f"{self.location}/{folder}")
        schema, spec = self._meta(version)
        self.store.make("_states")
        self.store.put_if_absent(f"_states/{version:020d}.json", json.dumps({"folder": folder, "schema": schema.json(), "spec": json.dumps(spec)}))
        return version

    def _state(self, version: int) -> tuple[int, dict | None]:
        """The last version up to the given one whose state was written, and where; -1 without one."""
        known = [int(n[:-5]) for n in self.store.names("_states") if n.endswith(".json")]
        at = max((v for v in known if v <= version), default=-1)
        return at, json.loads(self.store.read(f"_states/{at:020d}.json")) if at >= 0 else None

    def _meta(self, version: int) -> tuple[StructType, list]:
        at, state = self._state(version)
        if state:
            r = self.log(version, at).where("kind = 'commit' and schema is not null").agg(F.max_by(F.struct("schema", "spec"), "version").alias("m")).head().m or Row(**state)
            return StructType.fromJson(json.loads(r.schema)), json.loads(r.spec)
        r = self.log(version).where("kind = 'commit' and schema is not null").agg(F.max_by(F.struct("schema", "spec"), "version").alias("m")).head().m
        return StructType.fromJson(json.loads(r.schema)), json.loads(r.spec)

    def schema(self, version: int | None = None) -> StructType:
        return self._meta(self.version() if version is None else version)[0]

    def files(self, version: int | None = None) -> DataFrame:
        """Files of a version with their sizes, rows, partition values, bounds and null counts."""
        version = self.version() if version is None else version
        at, state = self._state(version)
        lines = self.log(version, at).where("kind <> 'commit'").select("path", "version", *STATE)
        if state:
            before = self.spark.read.schema(lines.drop("version", "kind").schema).parquet(f"{self.location}/{state['folder']}")
            lines = lines.unionByName(before.select("*", F.lit("add").alias("kind"), F.lit(at).cast("long").alias("version")))
        last = lines.groupBy("path").agg(F.max_by(F.struct(*STATE), "version").alias("x"))
        return last.where("x.kind = 'add'").select("path", "x.*").drop("kind")

    # Reading

    def select_files(self, where=(), partitions: dict[str, str] | None = None, version: int | None = None) -> DataFrame:
        """The files that can hold rows for the predicates, by partition values and bounds. A file without bounds of a column stays."""
        kinds = {f.name: f.dataType.simpleString() for f in self.schema(version)}
        f = self.files(version)
        for k, v in (partitions or {}).items():
            f = f.where(F.coalesce(F.col("part")[k] == v, F.lit(False)))
        for c, op, v in where:
            if c not in kinds:
                raise NotFound(f"column {c}")
            number = kinds[c] in NUMBERS
            if not number and kinds[c] != "string":
                continue
            low, high = (F.col("low")[c], F.col("high")[c]) if number else (F.col("low_text")[c], F.col("high_text")[c])
            lo, hi = (_bound(x, kinds[c]) for x in (v if op == "between" else (v, v)))
            skip = {"=": (low > hi) | (high < lo), "between": (low > hi) | (high < lo), "<": low >= hi, "<=": low > hi, ">": high <= lo, ">=": high < lo}[op]
            f = f.where(~F.coalesce(skip, F.lit(False)))
        return f

    def _residual(self, df: DataFrame, where) -> DataFrame:
        kinds = dict(df.dtypes)
        for c, op, v in where:
            lit = lambda x: F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz") if kinds[c] == "timestamp_ntz" else F.lit(x)  # noqa: B023, E731
            col = F.col(f"`{c}`")
            df = df.where((col >= lit(v[0])) & (col <= lit(v[1])) if op == "between" else OPS[op](col, lit(v)))
        return df

    def _read_paths(self, paths: list[str], schema: StructType) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.location}/data/{p}" for p in paths])

    def read(self, where=(), partitions: dict[str, str] | None = None, version: int | None = None, as_of: int | None = None) -> DataFrame:
        """Rows of a version (or of the last one at a time) that meet the predicates. A missing file fails the read."""
        version = self.as_of(as_of) if as_of is not None else self.version() if version is None else version
        paths = [r.path for r in self.select_files(where, partitions, version).select("path").orderBy("path").collect()]
        return self._residual(self._read_paths(paths, self.schema(version)), where)

    # Writing

    def stage(self, df: DataFrame, schema: StructType, spec: list, group: Column | None = None) -> list[dict]:
        """Writes df's rows as new files, which no version holds yet, and gives their log lines."""
        folder = uuid.uuid4().hex
        df = conform(df, schema) if group is None else df.select(*conform(df, schema).columns, group.alias("part__group"))
        kinds = {f.name: f.dataType.simpleString() for f in schema}
        parts = {}
        for name, transform, column in spec:
            source = F.col(f"`{column}`")
            parts[f"part_{name}"] = partition_value(ns_time(source) if transform in TIME_FORMATS and kinds[column] == "bigint" else source, transform)
        out = df.withColumns(parts) if parts else df
        by = [*parts, *(["part__group"] if group is not None else [])]
        writer = (out.hint("rebalance", *[F.col(c) for c in by]) if by else out).write
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.location}/data/{folder}")
        written = self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.location}/data/{folder}")
        aggs = [F.count("*").alias("rows"), F.max("_metadata.file_size").alias("bytes")]
        bounded = [c for c, k in kinds.items() if k in NUMBERS or k == "string"]
        for i, c in enumerate(bounded):
            m = _measure(c, kinds[c])
            aggs += [F.min(m).alias(f"low{i}"), F.max(m).alias(f"high{i}")]
        aggs += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"null{i}") for i, c in enumerate(kinds)]
        lines = []
        for r in written.groupBy(F.col("_metadata.file_path").alias("path")).agg(*aggs).collect():
            path = unquote(r.path).split(f"/data/{folder}/", 1)[1]
            names = dict(s.split("=", 1) for s in path.split("/")[:-1])
            line = {"kind": "add", "path": f"{folder}/{path}", "bytes": r.bytes, "rows": r.rows, "part": {k[5:]: unquote(v) for k, v in names.items() if k != "part__group"}}
            line |= {"low": {}, "high": {}, "low_text": {}, "high_text": {}, "nulls": {c: r[f"null{i}"] for i, c in enumerate(kinds)}}
            for i, c in enumerate(bounded):
                for end, v in (("low", r[f"low{i}"]), ("high", r[f"high{i}"])):
                    if v is None or v != v or (isinstance(v, float) and math.isinf(v)):
                        continue
                    if kinds[c] == "string":
                        line[f"{end}_text"][c] = v
                    else:  # a double may be nearer than the long it stands for
                        line[end][c] = math.nextafter(float(v), math.inf if end == "high" else -math.inf) if abs(v) > 2**53 else float(v)
            lines.append(line)
        return lines

    def commit(self, base: int, operation: str, lines: list[dict], schema: StructType | None = None, rebase: bool = False, reads_all: bool = False) -> int:
        """Makes the lines version base + 1. If that exists, ConcurrentModification; with `rebase`, only if a version since touches the same partitions or files.

        Lines that depend on rows of the whole table (`reads_all`) and changes of schema are never rebased.
        """
        head = {"operation": operation}
        if schema is not None:
            head |= {"schema": schema.json(), "spec": json.dumps(self._meta(base)[1])}
        while True:
            if self._put(base + 1, {**head, "parent": base}, lines):
                if (base + 1) % CHECKPOINT == 0:
                    self.checkpoint(base + 1)
                return base + 1
            if not rebase or reads_all or schema is not None or self._conflict(base, lines):
                raise ConcurrentModification(f"version {base + 1} exists")
            base = self.version()

    def _conflict(self, base: int, lines: list[dict]) -> bool:
        since = self.log().where(F.col("version") > base)
        if since.where("kind = 'commit' and schema is not null").limit(1).count():
            return True
        mine = {tuple(sorted(x["part"].items())) for x in lines}
        theirs = since.where("kind <> 'commit'").select(F.array_sort(F.map_entries("part")).alias("part")).distinct().collect()
        return any(tuple(map(tuple, r.part or ())) in mine for r in theirs)

    def append(self, df: DataFrame, base: int | None = None, additive: bool = True, rebase: bool = False) -> int:
        """Adds df's rows. Columns may be new or wider (the schema then evolves); InvalidArgument if they do not fit."""
        base = self.version() if base is None else base
        schema, spec = self._meta(base)
        incoming = StructType([f if f.name not in schema.names or schema[f.name].nullable else type(f)(f.name, f.dataType, False) for f in df.schema])
        change = drift(schema, incoming, additive)
        if not change.valid:
            raise InvalidArgument("; ".join(change.errors))
        required = [f.name for f in schema if not f.nullable]
        for c in required:
            df = df.withColumn(c, F.when(F.col(f"`{c}`").isNull(), F.raise_error(F.lit(f"null in {c}")).cast(df.schema[c].dataType)).otherwise(F.col(f"`{c}`")))
        return self.commit(base, "append", self.stage(df, change.evolved, spec), change.evolved if change.changes else None, rebase)

    def overwrite(self, df: DataFrame, base: int | None = None) -> int:
        """Replaces all rows."""
        base = self.version() if base is None else base
        schema, spec = self._meta(base)
        gone = self._removals(self.files(base))
        return self.commit(base, "overwrite", [*gone, *self.stage(df, schema, spec)], reads_all=True)

    def delete(self, where, base: int | None = None) -> int:
        """Deletes the rows that meet the predicates; only files that can hold such rows are written anew."""
        base = self.version() if base is None else base
        schema, spec = self._meta(base)
        found = self.select_files(where, version=base)
        gone = self._removals(found)
        whole = self._read_paths([x["path"] for x in gone], schema)
        hit = F.lit(True)
        for c, op, v in where:
            one = F.col(f"`{c}`")
            lit = lambda x: F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz") if dict(whole.dtypes)[c] == "timestamp_ntz" else F.lit(x)  # noqa: B023, E731
            hit = hit & ((one >= lit(v[0])) & (one <= lit(v[1])) if op == "between" else OPS[op](one, lit(v)))
        kept = whole.where(~F.coalesce(hit, F.lit(False)))
        return self.commit(base, "delete", [*gone, *self.stage(kept, schema, spec)], reads_all=True)

    @staticmethod
    def _removals(files: DataFrame) -> list[dict]:
        return [{"kind": "remove", "path": r.path, "part": dict(r.part or {})} for r in files.select("path", "part").collect()]

    def retrying(self, action: Callable[[VersionedTable], int], retries: int = 20, wait_ms: float = 10) -> int:
        """Runs the action again after each ConcurrentModification, waiting longer each time."""
        for k in range(retries + 1):
            try:
                return action(self)
            except ConcurrentModification:
                if k == retries:
                    raise
                time.sleep(wait_ms * 2 ** min(k, 8) / 1000 * (0.5 + random.random()))
        raise AssertionError

    # Maintenance

    def compaction_plan(self, target: int = 128 << 20, most: int = 50, version: int | None = None) -> DataFrame:
        """(path, part, group): files below the target, by path, in groups of one partition of about the target or of `most` files; groups of one are left out."""
        f = self.files(version).where(F.col("bytes") < target).withColumn("key", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("part")))))
        w = Window.partitionBy("key").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
        g = f.withColumn("n", F.greatest(F.floor(F.coalesce(F.sum("bytes").over(w), F.lit(0)) / target), F.floor(F.count("*").over(w) / most)))
        g = g.withColumn("group", F.concat_ws("-", F.md5("key"), F.col("n").cast("string")))
        return g.withColumn("size", F.count("*").over(Window.partitionBy("group"))).where("size > 1").select("path", "part", "group")

    def compact(self, target: int = 128 << 20, most: int = 50, merge: Callable[[DataFrame], DataFrame] = lambda df: df) -> int | None:
        """Writes each group of the plan as one file, in one job and one version. None if there is nothing to do."""
        base = self.version()
        schema, spec = self._meta(base)
        plan = self.compaction_plan(target, most, base)
        gone = [{"kind": "remove", "path": r.path, "part": dict(r.part or {}), "group": r.group} for r in plan.collect()]
        if not gone:
            return None
        groups = self.spark.createDataFrame([(x["path"], x.pop("group")) for x in gone], "__path string, __group string")
        rows = self._read_paths([x["path"] for x in gone], schema)
        name = F.regexp_replace(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")), r"^.*/data/(?=[0-9a-f]{32}/)", "")
        rows = merge(rows.withColumn("__path", name).join(F.broadcast(groups), "__path", "left").drop("__path"))
        lines = self.stage(rows, schema, spec, F.col("__group"))
        return self.commit(base, "compaction", [*gone, *lines])

    def pin(self, version: int) -> None:
        self.log(version)
        self.store.write(f"_pins/{version}", "")

    def unpin(self, version: int) -> None:
        self.store.remove(f"_pins/{version}")

    def pins(self) -> list[int]:
        return sorted(int(n) for n in self.store.names("_pins") if n.isdigit())

    def vacuum(self, retain_ms: int = 7 * 86_400_000, dry_run: bool = False) -> list[str]:
        """Deletes files removed longer ago than that, but for those of pinned versions. Gives their paths."""
        log = self.log()
        when = log.where("kind = 'commit'").select("version", F.col("time_ms").alias("gone_ms"))
        gone = log.where("kind = 'remove'").groupBy("path").agg(F.max("version").alias("version")).join(when, "version")
        born = log.where("kind = 'add'").groupBy("path").agg(F.min("version").alias("born"))
        old = gone.where(F.col("gone_ms") <= int(time.time() * 1000) - retain_ms).join(self.files(), "path", "left_anti").join(born, "path")
        for p in self.pins():
            old = old.where(~((F.col("born") <= p) & (F.col("version") > p)))
        paths = [r.path for r in old.select("path").orderBy("path").collect() if self.store.exists(f"data/{r.path}")]
        if not dry_run:
            for p in paths:
                self.store.remove(f"data/{p}")
        return paths

    def on_disk(self) -> DataFrame:
        """(path, bytes) of the Parquet files that are there, contents unread."""
        d = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{self.location}/data")
        return d.select(F.regexp_replace("path", r"^.*/data/(?=[0-9a-f]{32}/|[^/]*$)", "").alias("path"), F.col("length").alias("bytes"))

    def audit(self) -> DataFrame:
        """(problem, path): orphans (no version knows them), missing files of the current version, files of another size, and bounds or counts that cannot be."""
        known, active, disk = self.log().where("path is not null").select("path").distinct(), self.files(), self.on_disk()
        crossed = F.exists(F.map_keys("low"), lambda k: F.col("low")[k] > F.col("high")[k]) | F.exists(F.map_keys("low_text"), lambda k: F.col("low_text")[k] > F.col("high_text")[k])
        out = orphan_files(disk, known).select(F.lit("orphan").alias("problem"), "path").unionByName(missing_files(disk, active).select(F.lit("missing").alias("problem"), "path"))
        out = out.unionByName(active.join(disk.withColumnRenamed("bytes", "real"), "path").where("bytes <> real").select(F.lit("size").alias("problem"), "path"))
        return out.unionByName(active.where(F.coalesce(crossed, F.lit(False)) | (F.col("rows") < 0) | (F.col("bytes") < 0)).select(F.lit("bounds").alias("problem"), "path"))

    def clean_orphans(self) -> int:
        """Deletes the orphans; not while others are writing, as their files are orphans until they commit."""
        paths = [r.path for r in self.audit().where("problem = 'orphan'").collect()]
        return sum(self.store.remove(f"data/{p}") for p in paths)


def orphan_files(disk: DataFrame, known: DataFrame) -> DataFrame:
    return disk.join(known.select("path"), "path", "left_anti")


def missing_files(disk: DataFrame, active: DataFrame) -> DataFrame:
    return active.join(disk.select("path"), "path", "left_anti")


class Catalog:
    """Tables by namespace and name under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.store = spark, root.rstrip("/"), Store(spark, root)

    def _path(self, namespace: str, name: str) -> str:
        for part in (namespace, name):
            if not part or "/" in part or part[0] in "._":
                raise InvalidArgument(f"name {part!r}")
        return f"{namespace}/{name}"

    def create(self, namespace: str, name: str, schema: StructType, spec=()) -> VersionedTable:
        return VersionedTable.create(self.spark, f"{self.root}/{self._path(namespace, name)}", schema, spec)

    def load(self, namespace: str, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/{self._path(namespace, name)}")

    def exists(self, namespace: str, name: str) -> bool:
        return self.store.exists(f"{self._path(namespace, name)}/_log")

    def drop(self, namespace: str, name: str, purge: bool = False) -> None:
        """Without purge the log goes and the files stay."""
        if not self.exists(namespace, name):
            raise NotFound(f"{namespace}.{name}")
        self.store.remove(self._path(namespace, name) + ("" if purge else "/_log"))

    def namespaces(self) -> list[str]:
        return self.store.names("")

    def tables(self, namespace: str) -> list[str]:
        return [n for n in self.store.names(namespace) if self.store.exists(f"{namespace}/{n}/_log")]

    def view(self, namespace: str, name: str, version: int | None = None) -> str:
        """Registers a version as a temporary view for SQL, and gives the view's name."""
        view = f"{namespace}_{name}"
        self.load(namespace, name).read(version=version).createOrReplaceTempView(view)
        return view
