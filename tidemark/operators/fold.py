"""Ordered folds: a state carried through the rows of each key in order, where no window function can express the recursion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], step: Callable[[tuple | None, tuple], tuple[tuple, tuple]], adds: str) -> DataFrame:
    """df with the columns `adds` (a DDL string): step(state, row) gives the next state and their values; the state is None at a key's first row.

    One shuffle by key and a sort that may spill. Partitions are then read as a stream of Arrow batches with the state held
    between them, so a key's rows never have to fit in memory together.
    """
    names = df.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), adds])
    new = [a.strip().split()[0] for a in adds.split(",")]
    at = [names.index(k) for k in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for b in batches:
            out = []
            for row in b.itertuples(index=False, name=None):
                key = tuple(None if row[i] != row[i] else row[i] for i in at)  # a null number arrives as NaN
                if key != last:
                    last, state = key, None
                state, values = step(state, row)
                out.append(values)
            for j, c in enumerate(new):
                b[c] = [v[j] for v in out]
            yield b

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
