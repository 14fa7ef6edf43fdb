"""Row rules for bars: rows that break one are set aside, and counted by rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")


def rules() -> dict[str, Column]:
    """Name of each rule, and whether a row breaks it. Nulls, NaN and infinities break `number`, and are not compared by the others."""
    x = {c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)) for c in (*PRICES, "volume")}
    any_of = lambda cs: reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in cs))
    return {
        "number": any_of(v.isNull() for v in x.values()),
        "price": any_of(x[c] <= 0 for c in PRICES),
        "volume": any_of([x["volume"] < 0]),
        "high_low": any_of([x["high"] < x["low"]]),
        "outside": any_of(f for c in ("open", "close") for f in (x[c] < x["low"], x[c] > x["high"])),
    }


def checked(bars: DataFrame) -> DataFrame:
    """bars with `broken`: the names of the rules that a row breaks, comma-joined; empty for a good row."""
    return bars.withColumn("broken", F.concat_ws(",", *[F.when(c, F.lit(k)) for k, c in rules().items()]))


def split(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rows set aside."""
    c = checked(bars)
    return c.where("broken = ''").drop("broken"), c.where("broken <> ''")


def counts(bars: DataFrame) -> DataFrame:
    """One row: how many rows break each rule (a row may count for several), and how many break any."""
    named = rules()
    return bars.agg(*[F.count_if(c).alias(k) for k, c in named.items()], F.count_if(reduce(lambda a, b: a | b, named.values())).alias("quarantined"), F.count("*").alias("rows"))
