"""Encodings of number series and rows. Parquet's own serve storage; these are for exchange, an array or a batch of rows at a time."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.errors import Corruption, InvalidArgument

_MASK = (1 << 64) - 1


class Bits:
    """A growing or shrinking row of bits."""

    def __init__(self, data: bytes = b""):
        self.value, self.size = int.from_bytes(data, "big"), len(data) * 8

    def put(self, x: int, n: int) -> None:
        self.value, self.size = (self.value << n) | x, self.size + n

    def reader(self):
        at = self.size

        def take(n: int) -> int:
            nonlocal at
            if n > at:
                raise Corruption("truncated")
            at -= n
            return (self.value >> at) & ((1 << n) - 1)

        return take

    def bytes(self) -> bytes:
        pad = -self.size % 8
        return (self.value << pad).to_bytes((self.size + pad) // 8, "big")


CHUNK = 512  # values whose bits are gathered in one integer


def xor_encode(values: list[float]) -> bytes:
    """Doubles by their difference in bits from the one before: 0 if equal, else 1, 6 bits of leading zeros, 6 of length less one, the bits. NaN and infinities are refused."""
    x = np.asarray(values, float)
    if not np.isfinite(x).all():
        raise InvalidArgument("values must be finite")
    out, last = [struct.pack(">I", len(x))], 0
    for at in range(0, len(x), CHUNK):
        b = Bits()
        for v in x[at : at + CHUNK].view(np.uint64).tolist():
            d, last = v ^ last, v
            if not d:
                b.put(0, 1)
                continue
            lead = 64 - d.bit_length()
            zeros = (d & -d).bit_length() - 1
            n = 64 - lead - zeros
            b.put(1, 1), b.put(lead, 6), b.put(n - 1, 6), b.put(d >> zeros, n)
        data = b.bytes()
        out += [struct.pack(">I", len(data)), data]
    return b"".join(out)


def _chunks(data: bytes) -> tuple[int, Iterator[Bits]]:
    if len(data) < 4:
        raise Corruption("truncated")

    def parts():
        at = 4
        while at < len(data):
            if at + 4 > len(data):
                raise Corruption("truncated")
            n = struct.unpack_from(">I", data, at)[0]
            if at + 4 + n > len(data):
                raise Corruption("truncated")
            yield Bits(data[at + 4 : at + 4 + n])
            at += 4 + n

    return struct.unpack_from(">I", data)[0], parts()


def xor_decode(data: bytes) -> list[float]:
    count, parts = _chunks(data)
    out: list[int] = []
    last = 0
    for p in parts:
        take = p.reader()
        for _ in range(min(CHUNK, count - len(out))):
            if take(1):
                lead, n = take(6), take(6) + 1
                if lead + n > 64:
                    raise Corruption("length")
                last ^= take(n) << (64 - lead - n)
            out.append(last)
    if len(out) != count:
        raise Corruption("truncated")
    return np.array(out, np.uint64).view(float).tolist()


def zigzag(x: Column) -> Column:
    """Longs to unsigned order of size: 0, -1, 1, -2, ... become 0, 1, 2, 3, ..."""
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(x: Column) -> Column:
    return F.shiftrightunsigned(x, 1).bitwiseXOR(-(x.bitwiseAND(F.lit(1).cast("long"))))


def _zig(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def delta_encode(times: list[int], strict: bool = False, regress: bool = False) -> bytes:
    """Longs by the change of their differences, zigzagged, as 7 bits a byte. A time below the one before is refused (unless `regress`), with `strict` an equal one too."""
    out, last, step = bytearray(struct.pack(">I", len(times))), 0, 0
    for i, t in enumerate(times):
        d = t - last
        if i and ((d < 0 and not regress) or (d <= 0 and strict)):
            raise Corruption(f"time {t} after {last}")
        u = _zig(d - step if i > 1 else d)
        last, step = t, d if i else 0
        while u > 127:
            out.append(u & 127 | 128)
            u >>= 7
        out.append(u)
    return bytes(out)


def delta_decode(data: bytes) -> list[int]:
    if len(data) < 4:
        raise Corruption("truncated")
    count, at = struct.unpack_from(">I", data)[0], 4
    out: list[int] = []
    last = step = 0
    while len(out) < count:
        u = shift = 0
        while True:
            if at >= len(data):
                raise Corruption("truncated")
            b = data[at]
            at, u, shift = at + 1, u | (b & 127) << shift, shift + 7
            if b < 128:
                break
        v = (u >> 1) ^ -(u & 1)
        d = v + step if len(out) > 1 else v
        last, step = last + d, d if out else 0
        out.append(last)
    return out


def _over(f, kind: str):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else f(v))

    return run


def encode_doubles(column: Column) -> Column:
    return _over(xor_encode, "binary")(column)


def decode_doubles(column: Column) -> Column:
    return _over(xor_decode, "array<double>")(column)


def encode_times(column: Column) -> Column:
    return _over(lambda v: delta_encode([int(x) for x in v]), "binary")(column)


def decode_times(column: Column) -> Column:
    return _over(delta_decode, "array<bigint>")(column)


def crc32c_table(polynomial: int = 0x82F63B78) -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (polynomial if n & 1 else 0)
        out.append(n)
    return out


_CRC = crc32c_table()


def crc32c(data: bytes, before: int = 0) -> int:
    """The Castagnoli checksum; `before` is that of the bytes that come first."""
    c = before ^ 0xFFFFFFFF
    for b in data:
        c = _CRC[(c ^ b) & 255] ^ c >> 8
    return c ^ 0xFFFFFFFF


def crc32c_column(column: Column) -> Column:
    return _over(lambda v: crc32c(bytes(v)), "bigint")(column)


# The column types of the analytic database that exports are for
_EXPORT_TYPES = {"boolean": "UInt8", "tinyint": "Int8", "smallint": "Int16", "int": "Int32", "bigint": "Int64", "float": "Float32", "double": "Float64", "string": "String"}
_TIMES = ("timestamp_ns", "bar_timestamp_ns")


def merge_tree_ddl(table: str, schema: StructType, order_by: str = "") -> str:
    """CREATE TABLE of a merge tree: by month of its time column, ordered by symbol_id and time unless order_by says otherwise."""

    def kind(f) -> str:
        k = "DateTime64(9, 'UTC')" if f.name in _TIMES else _EXPORT_TYPES.get(f.dataType.simpleString(), "String")
        return f"Nullable({k})" if f.nullable else k

    time = next((t for t in _TIMES if t in schema.names), None)
    keys = order_by or ", ".join(f"`{c}`" for c in ("symbol_id", time) if c in schema.names) or "tuple()"
    lines = ",\n".join(f"    `{f.name}` {kind(f)}" for f in schema)
    part = f"PARTITION BY toYYYYMM({time})\n" if time else ""
    return f"CREATE TABLE IF NOT EXISTS {table} (\n{lines}\n) ENGINE = MergeTree()\n{part}ORDER BY ({keys});"


def row_binary(df: DataFrame) -> DataFrame:
    """(data binary, rows long): row-major little-endian rows, one value for each Arrow batch. A nullable column has a byte before its value, 1 for null.

    Strings are refused, and so is a null where the schema has none.
    """
    widths = {"boolean": "u1", "tinyint": "i1", "smallint": "<i2", "int": "<i4", "bigint": "<i8", "float": "<f4", "double": "<f8"}
    fields = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema]
    if bad := [n for n, k, _ in fields if k not in widths]:
        raise InvalidArgument(f"no binary form of {', '.join(bad)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            parts = []  # of each column: (null bytes or none, value bytes)
            for i, (_, kind, nullable) in enumerate(fields):
                c = b.column(i)
                none = c.is_null().to_numpy(zero_copy_only=False)
                if nullable:
                    parts.append(none.astype("u1").view("u1").reshape(-1, 1))
                elif none.any():
                    raise InvalidArgument("null in a required column")
                v = np.ascontiguousarray(c.fill_null(False if kind == "boolean" else 0).to_numpy(zero_copy_only=False).astype(widths[kind])).view("u1").reshape(b.num_rows, -1)
                parts.append(v)
            flat = np.concatenate(parts, 1)
            nulls = [i for i, f in enumerate(fields) if f[2] and b.column(i).null_count]
            if nulls:  # a null is its byte alone
                keep, at = np.ones(flat.shape, bool), 0
                for i, (_, kind, nullable) in enumerate(fields):
                    at += nullable
                    w = np.dtype(widths[kind]).itemsize
                    if i in nulls:
                        keep[:, at : at + w] = ~b.column(i).is_null().to_numpy(zero_copy_only=False)[:, None]
                    at += w
                data = flat[keep].tobytes()
            else:
                data = flat.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([b.num_rows], pa.int64())], names=["data", "rows"])

    return df.mapInArrow(run, "data binary, rows long")
