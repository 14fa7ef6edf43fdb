"""Market schemas, and whether incoming columns fit a table's."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DoubleType, IntegerType, LongType, ShortType, StructField, StructType


_TYPES = {"byte": ByteType(), "short": ShortType(), "int": IntegerType(), "long": LongType(), "double": DoubleType()}


def _required(columns: str) -> StructType:
    return StructType([StructField(name, _TYPES[kind], False) for name, kind in (c.split() for c in columns.split(", "))])


QUOTE_L1 = _required("timestamp_ns long, symbol_id int, bid_price double, bid_size double, ask_price double, ask_size double, sequence_num long")
ORDER_BOOK_L2 = _required("timestamp_ns long, symbol_id int, depth_level short, side byte, price double, quantity double, order_count int")
TRADE_TICK = _required("timestamp_ns long, symbol_id int, trade_id long, price double, quantity double, aggressor_side byte")
BAR_OHLCV = _required(
    "bar_timestamp_ns long, symbol_id int, resolution_ms int, open double, high double, low double, close double, volume double, vwap double, tick_count long, buy_volume double, sell_volume double"
)

_WIDER = [["tinyint", "smallint", "int", "bigint"], ["float", "double"]]


def promotes(a: str, b: str) -> bool:
    """Whether type a widens to b: among integers, or float to double."""
    return any(a in order and b in order and order.index(a) < order.index(b) for order in _WIDER)


@dataclass
class Drift:
    evolved: StructType
    errors: list[str] = field(default_factory=list)
    changes: list[str] = field(default_factory=list)  # what the table has to change
    notes: list[str] = field(default_factory=list)

    @property
    def valid(self) -> bool:
        return not self.errors


def drift(table: StructType, incoming: StructType, additive: bool = True) -> Drift:
    """Errors for columns of another type, nullable ones where the table requires values, missing required ones, and new ones unless `additive`.

    Wider types and new columns change the table; narrower ones are cast.
    """
    have = {f.name: f for f in table}
    evolved = dict(have)
    out = Drift(table)
    for f in incoming:
        old = have.get(f.name)
        if old is None:
            if additive:
                evolved[f.name] = f
                out.changes.append(f"new column {f.name} {f.dataType.simpleString()}")
            else:
                out.errors.append(f"unexpected column {f.name}")
            continue
        a, b = old.dataType.simpleString(), f.dataType.simpleString()
        if a != b and promotes(a, b):
            evolved[f.name] = StructField(f.name, f.dataType, old.nullable)
            out.changes.append(f"column {f.name} from {a} to {b}")
        elif a != b and promotes(b, a):
            out.notes.append(f"column {f.name} cast from {b} to {a}")
        elif a != b:
            out.errors.append(f"column {f.name} is {a}, not {b}")
        if f.nullable and not old.nullable:
            out.errors.append(f"column {f.name} must not be nullable")
    names = set(incoming.names)
    out.errors += [f"missing column {f.name}" for f in table if not f.nullable and f.name not in names]
    out.evolved = StructType(list(evolved.values()))
    return out


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """df's columns in the schema's order and types; columns that df lacks are null."""
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
