"""Tasks: execution waves of a dependency graph, and steps of a scheduler.

A graph of tasks is small and lives on the driver; the runs of many scheduled tasks are rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fold import ordered_fold


def waves(tasks: dict[str, int], needs: Iterable[tuple[str, str]]) -> list[list[str]]:
    """Waves of tasks (name: priority) whose needs (task, needed) are all in earlier waves; in a wave by priority, largest first, then by name.

    A cycle or an unknown task raises ValueError.
    """
    open_ = {t: set() for t in tasks}
    for task, needed in needs:
        if task not in open_ or needed not in open_:
            raise ValueError(f"unknown task: {task} needs {needed}")
        open_[task].add(needed)
    out: list[list[str]] = []
    done: set[str] = set()
    while len(done) < len(tasks):
        wave = sorted((t for t, n in open_.items() if t not in done and n <= done), key=lambda t: (-tasks[t], t))
        if not wave:
            raise ValueError("the tasks depend on each other in a cycle")
        out.append(wave)
        done.update(wave)
    return out


def execute(tasks: dict[str, tuple[int, Callable[[], None]]], needs: Iterable[tuple[str, str]]) -> list[str]:
    """Runs (priority, function) tasks wave by wave and gives their names in order; a failing one stops the rest."""
    order = [t for wave in waves({k: v[0] for k, v in tasks.items()}, needs) for t in wave]
    for t in order:
        tasks[t][1]()
    return order


def steps(tasks: DataFrame, times: list[int]) -> DataFrame:
    """(task, time, due, next): of tasks (task, first, every, skip_missed), at each of the scheduler's times, whether it runs and when it is next due.

    A task runs at most once a step. One that runs moves on by its interval, or, with skip_missed, past the step's time; without an
    interval (null) it runs once.
    """
    at = F.explode(F.array(*[F.lit(t).cast("long") for t in times]))
    rows = tasks.select("task", at.alias("time"), F.col("first").cast("long").alias("first"), F.col("every").cast("long").alias("every"), "skip_missed")
    rows = rows.withColumns({"once": F.col("every").isNull(), "every": F.coalesce("every", F.lit(0).cast("long"))})

    def step(state, row):
        _, time, first, every, skip, once = row
        due = first if state is None else state[0]
        if due is None or due > time:
            return (due,), (False, due)
        new = None if once else due + every * max(1, (time - due) // every + 1) if skip else due + every
        return (new,), (True, new)

    out = ordered_fold(rows, ["task"], ["time"], step, "due boolean, next double")
    return out.select("task", "time", "due", F.col("next").cast("long").alias("next"))


def due(tasks: DataFrame, now: int) -> DataFrame:
    """Tasks due at a time, earliest first."""
    return tasks.where(F.col("next") <= now).orderBy("next", "task")


def blotter(fills: DataFrame, n: int | None = None) -> DataFrame:
    """Fills, the most recent first."""
    out = fills.orderBy(F.desc("seq"), "symbol")
    return out if n is None else out.limit(n)
