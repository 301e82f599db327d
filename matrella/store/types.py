"""Declared (Arrow) types and the types they are stored as.

Unsigned integers are widened, the widest to a decimal; nanosecond times are stored as integers.  What the engine doesn't support is refused with a TypeError:
half floats, dates, times of day, durations, times with a zone, and nested types.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import types as T

_STORED: dict[str, T.DataType] = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "binary": T.BinaryType(),
    "timestamp[s]": T.TimestampNTZType(), "timestamp[ms]": T.TimestampNTZType(), "timestamp[us]": T.TimestampNTZType(), "timestamp[ns]": T.LongType(),
}

#: bounds of integer index columns; the last value is kept free
_BITS = {"int8": (-(2**7), 2**7 - 2), "int16": (-(2**15), 2**15 - 2), "int32": (-(2**31), 2**31 - 2), "int64": (-(2**63), 2**63 - 2), "uint8": (0, 2**8 - 2), "uint16": (0, 2**16 - 2), "uint32": (0, 2**32 - 2), "uint64": (0, 2**64 - 2)}


def declared(kind: pa.DataType) -> str:
    """The name under which an Arrow type is declared."""
    if pa.types.is_large_string(kind):
        return "string"
    if pa.types.is_large_binary(kind):
        return "binary"
    if pa.types.is_timestamp(kind) and kind.tz is not None:
        raise TypeError("times with a zone are not supported")
    name = str(kind)
    if name not in _STORED:
        raise TypeError(f"type {name} is not supported")
    return name


def stored(name: str) -> T.DataType:
    return _STORED[name]


def column(f: pa.Field) -> dict:
    """A schema entry: name, type, nullable, and for dictionary types the levels and whether they are ordered."""
    if pa.types.is_dictionary(f.type):
        return {"name": f.name, "type": declared(f.type.value_type), "nullable": f.nullable, "levels": [], "ordered": f.type.ordered}
    return {"name": f.name, "type": declared(f.type), "nullable": f.nullable}


def arrow_field(c: dict) -> pa.Field:
    t = c["type"]
    kind = pa.timestamp(t[10:-1]) if t.startswith("timestamp") else pa.type_for_alias("large_string" if t == "string" else "large_binary" if t == "binary" else t)
    if "levels" in c:
        kind = pa.dictionary(pa.int32(), kind, ordered=c["ordered"])
    return pa.field(c["name"], kind, c["nullable"])


def struct(schema: list[dict]) -> T.StructType:
    return T.StructType([T.StructField(c["name"], stored(c["type"]), True) for c in schema])


def bounds(name: str) -> tuple:
    """The widest domain of an index column of a type; strings and bytes have none."""
    return _BITS.get(name, ("", "") if name in ("string", "binary") else (None, None))
