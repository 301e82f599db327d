"""Stored objects: opened in one mode at one time, read as lazy frames.

Modes: "r" reads, "w" writes, "d" deletes.  A timestamp (milliseconds) fixes what a reader sees and what a writer stamps; 0 or None means now.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Mapping, MutableMapping, Sequence
from contextlib import suppress
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrameWriter, SparkSession
from pyspark.sql import DataFrame as Frame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type as arrow_type

from matrella.errors import DoesNotExistError, MatrellaError
from matrella.functions.coords import MAX_BROADCAST, check_coords, points_of, select_coords, slice_bounds
from matrella.functions.filter_lang import columns_of, compile_tree, parse, parse_r
from matrella.operators import core
from matrella.operators.assemble import Compressed, represented, rows_per_block
from matrella.store import types
from matrella.store.log import Log, State, now_ms

TS, FRAG, PLACE = "__ts", "__frag", "__place"
#: Fragments of one read whose places are broadcast (about 60 bytes each); beyond that the engine chooses the join.
MAX_PLACES = 100_000


def session(spark: SparkSession | None = None) -> SparkSession:
    got = spark or SparkSession.getActiveSession()
    if got is None:
        raise MatrellaError("no Spark session is active")
    return got


class Metadata(MutableMapping):
    """Scalars by name, versioned like data."""

    def __init__(self, owner: StoredObject):
        self.owner = owner

    def _now(self) -> dict:
        return self.owner.state.metadata

    def __getitem__(self, key: str) -> object:
        return self._now()[key]

    def __setitem__(self, key: str, value: object) -> None:
        if not isinstance(key, str):
            raise TypeError("metadata keys are strings")
        if isinstance(value, np.generic):
            value = value.item()
        if not isinstance(value, bytes | float | int | str):
            raise TypeError(f"metadata values are bytes, float, int or str, not {type(value).__name__}")
        self.owner.need("w")
        packed = {"bytes": value.hex()} if isinstance(value, bytes) else {"float": repr(value)} if isinstance(value, float) and not math.isfinite(value) else value
        self.owner.record({"op": "meta", "key": key, "value": packed})

    def __delitem__(self, key: str) -> None:
        self.owner.need("w", "d")
        if key not in self._now():
            raise KeyError(key)
        self.owner.record({"op": "meta", "key": key, "gone": True})

    def __iter__(self) -> Iterator[str]:
        return iter(dict(self._now()))

    def __len__(self) -> int:
        return len(self._now())


def _unpacked(value: object) -> object:
    if isinstance(value, dict):
        return bytes.fromhex(value["bytes"]) if "bytes" in value else float(value["float"])
    return value


class StoredObject:
    kind = ""

    def __init__(self, uri: str, mode: str = "r", *, spark: SparkSession | None = None, timestamp: int | None = None):
        if mode not in ("r", "w", "d"):
            raise ValueError(f"unknown mode {mode!r}")
        self.spark = session(spark)
        self.uri, self.mode, self.timestamp, self.closed = uri.rstrip("/"), mode, timestamp or None, False
        self.log = Log(self.spark, self.uri)
        self._state: State | None = None

    @classmethod
    def open(cls, uri: str, mode: str = "r", *, spark: SparkSession | None = None, timestamp: int | None = None):
        obj = cls(uri, mode, spark=spark, timestamp=timestamp)
        if cls.kind and obj.state.kind.lower() != cls.kind.lower():
            raise MatrellaError(f"{uri} is a {obj.state.kind}, not a {cls.kind}")
        return obj

    @classmethod
    def exists(cls, uri: str, *, spark: SparkSession | None = None, timestamp: int | None = None) -> bool:
        """Whether such an object is stored there; an object of another kind, or none, is no error."""
        with suppress(DoesNotExistError):
            kind = Log(session(spark), uri).state(timestamp or None).kind
            return not cls.kind or kind.lower() == cls.kind.lower()
        return False

    @classmethod
    def _create(cls, uri: str, spark: SparkSession | None, timestamp: int | None, **event: object):
        obj = cls(uri, "w", spark=spark, timestamp=timestamp)
        obj.log.start({"op": "create", "ts": obj.stamp(), "kind": cls.kind, **event})
        return obj

    @property
    def state(self) -> State:
        if self.closed:
            raise MatrellaError(f"{self.uri} is closed")
        if self._state is None:
            self._state = self.log.state(self.timestamp)
            self._state.metadata = {k: _unpacked(v) for k, v in self._state.metadata.items()}
        return self._state

    def stamp(self) -> int:
        return self.timestamp or now_ms()

    def need(self, *modes: str) -> None:
        if self.closed:
            raise MatrellaError(f"{self.uri} is closed")
        if self.mode not in modes:
            raise MatrellaError(f"{self.uri} is open in mode {self.mode!r}, this needs {' or '.join(modes)}")

    def record(self, event: dict) -> None:
        self.log.add({"ts": self.stamp(), **event})
        self._state = None

    def reopen(self, mode: str, timestamp: int | None = None):
        self.mode, self.timestamp, self.closed, self._state = mode, timestamp or None, False, None
        return self

    def close(self) -> None:
        self.closed = True

    def __enter__(self):
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    @property
    def metadata(self) -> Metadata:
        return Metadata(self)


# --- reads -----------------------------------------------------------------------------------------------------------------------------


def _to_ipc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, b.schema) as w:
            w.write_batch(b)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["ipc"])


def arrow_batches(df: Frame) -> Iterator[pa.Table]:
    """Arrow tables one after the other, the next partition being computed while this one is used; the driver holds about two."""
    for row in df.mapInArrow(_to_ipc, "ipc binary").toLocalIterator(prefetchPartitions=True):
        yield pa.ipc.open_stream(bytes(row.ipc)).read_all()


class TableRead:
    """A lazy read: `df` is the frame, iteration gives Arrow tables, `concat` all that is left as one."""

    def __init__(self, df: Frame):
        self.df = df
        self._left: Iterator[pa.Table] | None = None

    def __iter__(self):
        return self

    def __next__(self) -> pa.Table:
        if self._left is None:
            self._left = arrow_batches(self.df)
        return next(self._left)

    def concat(self) -> pa.Table:
        if self._left is None:
            self._left = iter(())
            return self.df.toArrow()
        parts = list(self._left)
        return pa.concat_tables(parts) if parts else self.df.limit(0).toArrow()

    def over(self, work: Callable[[pa.Table], pa.Table], schema: str) -> Frame:
        """Run `work` on each table of the whole read in a task, as they come: a lazy frame of any size, no rows come to the driver."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield from work(pa.Table.from_batches([b])).to_batches()

        return self.df.mapInArrow(run, schema)


class BatchSize:
    """How large batches should be; only the default is supported, as partitions decide."""

    def __init__(self, count: int | None = None, bytes: int | None = None):
        if count is not None and bytes is not None:
            raise ValueError("give count or bytes, not both")
        self.count, self.bytes = count, bytes


class IOfN:
    """The i-th of n partitions of a read; only 0 of 1 is supported."""

    def __init__(self, i: int, n: int):
        if not 0 <= i < n:
            raise ValueError(f"{i} of {n} is no partition")
        self.i, self.n = i, n


def _check_read(batch_size: object, partitions: object) -> None:
    if isinstance(batch_size, BatchSize) and (batch_size.count or batch_size.bytes):
        raise NotImplementedError("batch sizes other than the default are not supported")
    if isinstance(partitions, IOfN) and (partitions.i, partitions.n) != (0, 1):
        raise ValueError("partitioned reads are not supported")


@dataclass(frozen=True)
class WriteOptions:
    """How the files of a fragment are written."""

    compression: str = "zstd"
    level: int | None = None
    row_group_bytes: int | None = None
    max_records: int = 100_000_000  # rows of one file
    max_file_bytes: int | None = None  # bytes of one file before compression, by the widths of the columns' types

    def applied(self, writer: DataFrameWriter, struct: types.T.StructType) -> DataFrameWriter:
        most = self.max_records
        if self.max_file_bytes:
            most = min(most, max(1, self.max_file_bytes // sum(_WIDTH.get(f.dataType.simpleString(), 16) for f in struct)))
        writer = writer.option("compression", self.compression).option("maxRecordsPerFile", most)
        if self.level is not None:
            writer = writer.option(f"parquet.compression.codec.{self.compression}.level", self.level)
        return writer if self.row_group_bytes is None else writer.option("parquet.block.size", self.row_group_bytes)


_WIDTH = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "bigint": 8, "double": 8, "timestamp_ntz": 8}


# --- arrays ----------------------------------------------------------------------------------------------------------------------------


def _jsonable(value: object) -> object:
    if isinstance(value, np.datetime64):
        value = value.astype("datetime64[us]").item()
    if isinstance(value, datetime):
        return {"at": value.isoformat(sep=" ")}
    if isinstance(value, np.generic):
        return value.item()
    return value


class StoredArray(StoredObject):
    """An object whose rows are fragments of Parquet files, latest row of a key first."""

    write_options = WriteOptions()

    @property
    def schema(self) -> pa.Schema:
        return pa.schema([types.arrow_field(c) for c in self.state.schema])

    @property
    def index_column_names(self) -> tuple[str, ...]:
        return tuple(self.state.index)

    @property
    def domain(self) -> tuple:
        return tuple(tuple(d) for d in self.state.domain)

    @property
    def maxdomain(self) -> tuple:
        return tuple(tuple(d) for d in self.state.maxdomain)

    def _type(self, name: str) -> str:
        return next(c["type"] for c in self.state.schema if c["name"] == name)

    @property
    def _units(self) -> dict[str, str]:
        return {c["name"]: c["type"][10:-1] for c in self.state.schema if c["type"].startswith("timestamp") and "ns" not in c["type"]}

    def _fragments_for(self, coords: Sequence) -> list[dict]:
        """Fragments whose key range can meet slices and scalars of integers."""
        out = []
        for f in self.state.fragments:
            ok = True
            for low, high, c in zip(f["low"], f["high"], coords):
                if not isinstance(low, int):
                    continue
                if isinstance(c, int | np.integer) and not isinstance(c, bool):
                    ok &= low <= c <= high
                elif isinstance(c, slice) and not any(isinstance(x, str | datetime | np.datetime64) for x in (c.start, c.stop)):
                    ok &= (c.start is None or high >= c.start) and (c.stop is None or low <= c.stop)
                elif isinstance(c, list | tuple) and c and all(isinstance(p, int | np.integer) for p in c):
                    ok &= max(c) >= low and min(c) <= high
            if ok:
                out.append(f)
        return out

    def snapshot(self, coords: object = ()) -> Frame:
        """The rows at the object's time.  Keys are selected before versions are resolved, values never are: they could bring old rows back."""
        s = self.state
        coords = check_coords(coords, len(s.index), s.index)
        struct = types.struct(s.schema)
        fragments = self._fragments_for(coords)
        if not fragments:
            df = select_coords(self.spark.createDataFrame([], struct), s.index, coords, self._domains())
            return df
        physical = types.T.StructType([*struct.fields, types.T.StructField(FRAG, types.T.StringType())])
        df = self.spark.read.schema(physical).parquet(*[f"{self.uri}/{f.get('dir', 'frag')}/{f['id']}" for f in fragments])
        df = select_coords(df, s.index, coords, self._domains())
        # a fragment's place in the order of (time, sequence) says which of two versions is the later and which deletes follow it
        places = {f["id"]: k for k, f in enumerate(s.fragments)}
        if len(fragments) == 1:
            df = df.withColumn(PLACE, F.lit(places[fragments[0]["id"]])).drop(FRAG)
        elif s.deletes or not s.options.get("allows_duplicates"):
            ids = pa.table({FRAG: [f["id"] for f in fragments], PLACE: pa.array([places[f["id"]] for f in fragments], pa.int32())})
            at = self.spark.createDataFrame(ids)
            df = df.join(F.broadcast(at) if len(fragments) <= MAX_PLACES else at, FRAG).drop(FRAG)
        if len(fragments) > 1 and not s.options.get("allows_duplicates"):
            df = core.latest(df, [f"`{k}`" for k in s.index], [F.desc(PLACE)])
        for d in s.deletes:
            before = sum(f["at"] < (d["ts"], d["seq"]) for f in s.fragments)
            if before:
                df = self._without(df, d, struct, F.col(PLACE) < before)
        return df.select(*[f"`{c}`" for c in struct.fieldNames()])

    def _domains(self) -> list[tuple] | None:
        return [tuple(d) if d and not isinstance(d[0], str) else None for d in self.state.domain] if self.state.domain else None

    def _without(self, df: Frame, d: dict, struct: types.T.StructType, old: Column) -> Frame:
        if "ids" in d:
            ids = self.spark.read.parquet(d["ids"]).select(F.col("soma_joinid").alias("__gone"))
            for dim in d["dims"]:
                df = df.join(ids, (F.col(f"`{dim}`") == F.col("__gone")) & old, "left_anti")
            return df
        hit: Column = F.lit(True)
        for name, c in zip(self.state.index, d["coords"]):
            col, kind = F.col(f"`{name}`"), struct[name].dataType
            lit = lambda v: F.lit(v["at"] if isinstance(v, dict) else v).cast(kind)  # noqa: B023, E731
            if c is None:
                continue
            if "points" in c:
                hit = hit & col.isin([lit(p) for p in c["points"]])
            else:
                hit = hit & (col >= lit(c["low"]) if c["low"] is not None else F.lit(True)) & (col <= lit(c["high"]) if c["high"] is not None else F.lit(True))
        if d.get("filter"):
            hit = hit & compile_tree(parse(d["filter"]), struct, self._units)
        return df.where(~F.coalesce(hit & old, F.lit(False)))

    @property
    def count(self) -> int:
        s = self.state
        if not s.deletes and (len(s.fragments) <= 1 or s.options.get("allows_duplicates")):
            return self.fragment_cell_count()  # the log knows
        return self.snapshot().count()

    def fragment_cell_count(self) -> int:
        """Upper bound of the rows, from the log alone: updates count twice, deletes not at all."""
        return sum(f["rows"] for f in self.state.fragments)

    def non_empty_domain(self) -> tuple | None:
        """Least and largest key of each index column over all fragments, as written."""
        fs = self.state.fragments
        if not any(f["rows"] for f in fs):
            return None
        return tuple((min(f["low"][k] for f in fs if f["rows"]), max(f["high"][k] for f in fs if f["rows"])) for k in range(len(self.state.index)))

    # writing

    def _frame_of(self, values: object) -> Frame:
        if isinstance(values, Frame):
            return values
        if isinstance(values, pd.DataFrame):
            values = pa.Table.from_pandas(values, preserve_index=False)
        if isinstance(values, pa.RecordBatch):
            values = pa.Table.from_batches([values])
        if not isinstance(values, pa.Table):
            raise TypeError(f"can't write a {type(values).__name__}")
        cols = []
        for name, c in zip(values.column_names, values.columns):
            t = c.type
            if pa.types.is_dictionary(t):
                c = c.cast(t.value_type)
            elif pa.types.is_uint64(t):
                c = c.cast(pa.decimal128(20, 0))
            elif pa.types.is_unsigned_integer(t):
                c = c.cast(pa.int64())
            elif pa.types.is_timestamp(t):
                c = c.cast(pa.int64()) if t.unit == "ns" and self._type(name).endswith("[ns]") else c.cast(pa.timestamp("us"))
            cols.append(c)
        table = pa.table(cols, names=values.column_names)
        return self.spark.createDataFrame(table) if table.num_rows else self.spark.createDataFrame([], types.struct([c for c in self.state.schema if c["name"] in table.column_names]))

    def _completed(self, df: Frame) -> Frame:
        """df with the columns that the object works out by itself."""
        return df

    def _write(self, df: Frame, within: Sequence[tuple] | None = None, **note: object) -> None:
        """Write df as one fragment, its keys within the domain and the box that may be given; `note` goes into its log entry."""
        self.need("w")
        s = self.state
        names = [c["name"] for c in s.schema]
        if unknown := [c for c in df.columns if c not in names]:
            raise ValueError(f"no such columns: {', '.join(unknown)}")
        if missing := [c["name"] for c in s.schema if c["name"] not in df.columns and (c["name"] in s.index or not c["nullable"])]:
            raise ValueError(f"columns are missing: {', '.join(missing)}")
        cols = []
        for c in s.schema:
            kind = types.stored(c["type"])
            if c["name"] in df.columns:
                have = df.schema[c["name"]].dataType
                text, other = isinstance(kind, types.T.StringType | types.T.BinaryType), isinstance(have, types.T.StringType | types.T.BinaryType)
                if text != other and not isinstance(have, types.T.NullType):
                    raise MatrellaError(f"column {c['name']!r} holds {c['type']}, not {have.simpleString()}")
            cols.append((F.col(f"`{c['name']}`") if c["name"] in df.columns else F.lit(None)).cast(kind).alias(c["name"]))
        df = df.select(*cols)
        keys = [f"`{k}`" for k in s.index]
        if not s.options.get("allows_duplicates"):
            # of rows with equal keys in one write the largest counts, whatever their order
            rest = [F.desc(f"`{n}`") for n in names if n not in s.index]
            df = core.latest(df, keys, rest or [F.desc(keys[0])])
        stats = [F.count(F.lit(1)).alias("n")]
        for k, key in enumerate(keys):
            stats += [F.min(key).alias(f"low{k}"), F.max(key).alias(f"high{k}"), F.count_if(F.col(key).isNull()).alias(f"null{k}")]
        for k, c in enumerate(s.schema):
            if not c["nullable"] and c["name"] not in s.index:
                stats.append(F.count_if(F.col(f"`{c['name']}`").isNull()).alias(f"hole{k}"))
        ts, name = self.stamp(), None
        name = f"{ts:015d}_{uuid.uuid4().hex}"
        out = f"{self.uri}/stage/{name}"
        order = df.withColumn(TS, F.lit(ts).cast("bigint")).withColumn(FRAG, F.lit(name))
        clustered = order if s.options.get("unsorted") else order.repartitionByRange(*keys).sortWithinPartitions(*keys)
        # what is wrong shows in the data written, which lies apart until it is found right; nothing is visible to readers before the log entry
        self.write_options.applied(clustered.write, order.schema).parquet(out)
        got = self.spark.read.schema(order.schema).parquet(out).agg(*stats).first()
        try:
            self._check_written(s, got, within)
            self._extend_levels(s, self.spark.read.schema(order.schema).parquet(out))
        except Exception:
            self.log.files.delete(out)
            raise
        self.log.files.move(out, f"{self.uri}/frag/{name}")
        self.record({"op": "fragment", **note, "ts": ts, "id": name, "rows": got.n, "low": [_jsonable(got[f"low{k}"]) for k in range(len(keys))], "high": [_jsonable(got[f"high{k}"]) for k in range(len(keys))]})

    def _check_written(self, s: State, got: object, within: Sequence[tuple] | None) -> None:
        if not got.n:
            return
        for k, key in enumerate(s.index):
            if got[f"null{k}"]:
                raise ValueError(f"index column {key!r} holds nulls")
            dom = within[k] if within else s.domain[k] if s.domain else None
            low, high = got[f"low{k}"], got[f"high{k}"]
            if dom and dom[0] is not None and not isinstance(dom[0], str):
                lo, hi = ((datetime.fromisoformat(x["at"]) if isinstance(x, dict) else x) for x in dom)
                if low < lo or high > hi:
                    raise MatrellaError(f"values {low}..{high} of {key!r} lie outside its domain {lo}..{hi}")
        for k, c in enumerate(s.schema):
            if not c["nullable"] and c["name"] not in s.index and got[f"hole{k}"]:
                raise ValueError(f"column {c['name']!r} may not be null")

    def _extend_levels(self, s: State, df: Frame) -> None:
        for c in s.schema:
            if "levels" not in c:
                continue
            seen = [r[0] for r in df.select(f"`{c['name']}`").where(F.col(f"`{c['name']}`").isNotNull()).distinct().limit(MAX_LEVELS + 1).collect()]
            if len(seen) > MAX_LEVELS:
                raise MatrellaError(f"column {c['name']!r} has more than {MAX_LEVELS} levels")
            if new := sorted(v for v in seen if v not in c["levels"]):
                self.record({"op": "levels", "column": c["name"], "levels": new})

    def consolidate_and_vacuum(self) -> None:
        """Rewrite what is visible now as one fragment.  Earlier times are lost: the fragments it replaces are deleted."""
        self.need("w")
        s = self.state
        if len(s.fragments) < 2 and not s.deletes:
            return
        ts = self.stamp()
        name = f"{ts:015d}_{uuid.uuid4().hex}"
        keys = [f"`{k}`" for k in s.index]
        # apart from the written fragments: whoever follows those has seen these rows
        df = self.snapshot().withColumn(TS, F.lit(ts).cast("bigint")).withColumn(FRAG, F.lit(name))
        self.write_options.applied(df.repartitionByRange(*keys).sortWithinPartitions(*keys).write, df.schema).parquet(f"{self.uri}/base/{name}")
        got = self.spark.read.schema(df.schema).parquet(f"{self.uri}/base/{name}").agg(F.count(F.lit(1)).alias("n"), *[f(k).alias(f"{n}{i}") for i, k in enumerate(keys) for f, n in ((F.min, "low"), (F.max, "high"))]).first()
        fragment = {"id": name, "dir": "base", "ts": ts, "rows": got.n, "low": [_jsonable(got[f"low{k}"]) for k in range(len(keys))], "high": [_jsonable(got[f"high{k}"]) for k in range(len(keys))]}
        old = {f["id"]: f.get("dir", "frag") for f in s.fragments}
        self.record({"op": "consolidate", "ts": ts, "fragment": fragment, "replaces": list(old), "applied": [d["seq"] for d in s.deletes]})
        for f, place in old.items():
            self.log.files.delete(f"{self.uri}/{place}/{f}")

    # deleting

    def _delete(self, coords: object, value_filter: str | None) -> None:
        self.need("d")
        s = self.state
        coords = check_coords(coords, len(s.index), s.index)
        packed = []
        for k, (name, c) in enumerate(zip(s.index, coords)):
            dom = (s.domain[k] if s.domain else None) or (None, None)
            bounded = dom[0] is not None and not isinstance(dom[0], str | dict)
            if c is None or c == slice(None) if isinstance(c, slice | None) else False:
                packed.append(None)
            elif isinstance(c, slice):
                if bounded and ((c.start is not None and c.start > dom[1]) or (c.stop is not None and c.stop < dom[0])):
                    if c.start is not None and c.stop is not None and c.start > c.stop:
                        raise ValueError(f"slice of {name!r} is inverted")
                    raise IndexError(f"the slice of {name!r} doesn't overlap its domain")
                lo, hi = slice_bounds(c, None if not bounded else tuple(dom), name)
                packed.append({"low": _jsonable(lo), "high": _jsonable(hi)})
            else:
                points = points_of(c)
                points = [c] if points is None else points
                if bounded and any(not dom[0] <= p <= dom[1] for p in points):
                    raise IndexError(f"a point of {name!r} lies outside its domain")
                packed.append({"points": [_jsonable(p) for p in points]})
        if value_filter is None and all(p is None for p in packed):
            raise ValueError("a delete needs coordinates or a value filter")
        if value_filter is not None:
            if not isinstance(value_filter, str):
                raise TypeError("the value filter of a delete is a string: it goes into the log")
            compile_tree(parse(value_filter), types.struct(s.schema), self._units)
        if any(p and "points" in p and not p["points"] for p in packed):
            return
        self.record({"op": "delete", "coords": packed, "filter": value_filter})

    def _delete_ids(self, ids: Frame, dims: Sequence[str]) -> None:
        """Delete rows of which any of the dims is among the ids, however many: the ids are stored as a table."""
        self.need("d")
        path = f"{self.uri}/del/{uuid.uuid4().hex}"
        ids.select(F.col(ids.columns[0]).cast("bigint").alias("soma_joinid")).distinct().write.parquet(path)
        if not self.spark.read.parquet(path).isEmpty():
            self.record({"op": "delete", "ids": path, "dims": list(dims)})

    # domains

    def _grow(self, new: list, check_only: bool) -> tuple[bool, str]:
        s = self.state
        reason = ""
        if len(new) != len(s.domain):
            reason = f"{len(new)} ranges for {len(s.domain)} index columns"
        else:
            for name, have, want, most in zip(s.index, s.domain, new, s.maxdomain):
                if want is None or isinstance(have[0], str | dict) or have[0] is None:
                    continue
                if want[0] > have[0] or want[1] < have[1]:
                    reason = f"{name}: {want} would shrink the domain {tuple(have)}"
                elif most and most[0] is not None and (want[0] < most[0] or want[1] > most[1]):
                    reason = f"{name}: {want} exceeds the largest domain {tuple(most)}"
        if check_only:
            return not reason, reason
        if reason:
            raise ValueError(reason)
        self.need("w")
        self.record({"op": "domain", "domain": [list(h if w is None else w) for h, w in zip(s.domain, new)]})
        return True, ""


MAX_LEVELS = 32_767


class DataFrame(StoredArray):
    """A table with index columns: a write replaces rows of equal keys."""

    kind = "DataFrame"

    @classmethod
    def create(cls, uri: str, *, schema: pa.Schema, index_column_names: Sequence[str] = ("soma_joinid",), domain: Sequence | None = None, spark: SparkSession | None = None, timestamp: int | None = None, allows_duplicates: bool = False, override_naming_restriction: bool = False, sort_coords: bool = True) -> DataFrame:
        names = schema.names
        if len(set(names)) != len(names):
            raise ValueError("column names must be unique")
        for n in names:
            if n.startswith("soma_") and n != "soma_joinid" and not override_naming_restriction and n not in cls._reserved:
                raise ValueError(f"column names may not begin with soma_: {n}")
        cols = [types.column(f) for f in schema]
        if "soma_joinid" not in names:
            cols.insert(0, {"name": "soma_joinid", "type": "int64", "nullable": False})
        by = {c["name"]: c for c in cols}
        if by["soma_joinid"]["type"] != "int64":
            raise ValueError("soma_joinid must be int64")
        by["soma_joinid"]["nullable"] = False
        index = list(index_column_names)
        if not index or len(set(index)) != len(index):
            raise ValueError("index columns must be given once each")
        for n in index:
            if n not in by:
                raise ValueError(f"index column {n!r} is not in the schema")
            if "levels" in by[n] or by[n]["type"] == "bool":
                raise TypeError(f"column {n!r} can't be an index column")
            by[n]["nullable"] = False
        if domain is not None and len(domain) != len(index):
            raise ValueError("a domain needs a range for each index column")
        now, most = [], []
        for k, n in enumerate(index):
            widest = (0, 2**63 - 2) if n == "soma_joinid" else types.bounds(by[n]["type"])
            want = domain[k] if domain is not None else None
            if by[n]["type"] in ("string", "binary"):
                if want not in (None, ("", ""), ["", ""], (b"", b"")):
                    raise ValueError(f"index column {n!r} of strings takes no domain")
                want = ("", "")
            if want is not None and not isinstance(want[0], str):
                if want[0] > want[1]:
                    raise ValueError(f"the domain of {n!r} is inverted")
                if n == "soma_joinid" and want[0] < 0:
                    raise ValueError("soma_joinid may not be negative")
            if want is None:
                want = (0, 0) if domain is not None or widest[0] is None else (0, 0)
                want = want if widest[0] is not None else (None, None)
            now.append([_jsonable(x) for x in want])
            most.append([_jsonable(x) for x in widest])
        return cls._create(uri, spark, timestamp, schema=cols, index=index, domain=now, maxdomain=most, options={"allows_duplicates": allows_duplicates, "unsorted": not sort_coords})

    _reserved: tuple[str, ...] = ()

    def read(self, coords: object = (), column_names: Sequence[str] | None = None, *, result_order: str = "auto", value_filter: str | None = None, syntax: str = "python", batch_size: object = None, partitions: object = None) -> TableRead:
        """Rows of the coordinates that match the filter (spelled as in Python or, with syntax "r", as in R); the filter's columns join the projection."""
        self.need("r")
        _check_read(batch_size, partitions)
        df = self.snapshot(coords)
        names: list[str] = []
        if value_filter is not None:
            tree = parse(value_filter) if syntax == "python" else parse_r(value_filter)
            df, names = df.where(compile_tree(tree, df.schema, self._units)), columns_of(tree)
        if column_names is not None:
            if missing := [c for c in column_names if c not in df.columns]:
                raise ValueError(f"no such columns: {', '.join(missing)}")
        df = core.in_order(df, [f"`{k}`" for k in self.state.index], result_order)
        if column_names is not None:
            df = df.select(*[f"`{c}`" for c in dict.fromkeys([*column_names, *names])])
        return TableRead(df)

    def __len__(self) -> int:
        return self.count

    def write(self, values: object) -> DataFrame:
        self._write(self._completed(self._frame_of(values)))
        return self

    def delete_cells(self, coords: object = (), *, value_filter: str | None = None) -> None:
        self._delete(coords, value_filter)

    def get_enumeration_values(self, column_names: Sequence[str]) -> dict[str, list]:
        out = {}
        for n in column_names:
            c = next((c for c in self.state.schema if c["name"] == n), None)
            if c is None:
                raise KeyError(n)
            if "levels" not in c:
                raise KeyError(f"column {n!r} is no categorical")
            out[n] = list(c["levels"])
        return out

    def extend_enumeration_values(self, values: dict[str, Sequence], deduplicate: bool = False) -> None:
        self.need("w")
        have = self.get_enumeration_values(list(values))
        for n, new in values.items():
            new = points_of(new)
            if any(v is None for v in new):
                raise ValueError(f"levels of {n!r} may not be null")
            if len(set(new)) != len(new):
                raise ValueError(f"levels of {n!r} occur twice in the values given")
            if not deduplicate and (again := [v for v in new if v in have[n]]):
                raise ValueError(f"levels of {n!r} are there already: {again}")
            if add := [v for v in new if v not in have[n]]:
                self.record({"op": "levels", "column": n, "levels": add})

    def update_schema(self, add: Sequence[pa.Field] = (), drop: Sequence[str] = ()) -> None:
        """Add nullable columns, drop columns; types never change."""
        self.need("w")
        names = self.schema.names
        for f in add:
            if f.name in names and f.name not in drop:
                raise ValueError(f"column {f.name!r} is there already")
        for n in drop:
            if n not in names or n in self.state.index or n == "soma_joinid":
                raise ValueError(f"column {n!r} can't be dropped")
        self.record({"op": "schema", "add": [types.column(f.with_nullable(True)) for f in add], "drop": list(drop)})

    def change_domain(self, newdomain: Sequence, check_only: bool = False) -> tuple[bool, str]:
        return self._grow(list(newdomain), check_only)

    def resize_soma_joinid_shape(self, newshape: int, check_only: bool = False) -> tuple[bool, str]:
        """Let soma_joinid grow to newshape - 1; nothing to do where it is no index column."""
        return self._grow([(0, newshape - 1) if n == "soma_joinid" else None for n in self.state.index], check_only)


class NDArray(StoredArray):
    @classmethod
    def create(cls, uri: str, *, type: pa.DataType, shape: Sequence[int], spark: SparkSession | None = None, timestamp: int | None = None, allows_duplicates: bool = False):
        if not shape or any(n is None or n < 1 for n in shape):
            raise ValueError("each dimension of a shape must be at least 1")
        kind = types.declared(type)
        if kind in ("string", "binary"):
            raise TypeError("arrays hold no strings")
        cols = [{"name": f"soma_dim_{k}", "type": "int64", "nullable": False} for k in range(len(shape))] + [{"name": "soma_data", "type": kind, "nullable": False}]
        return cls._create(uri, spark, timestamp, schema=cols, index=[c["name"] for c in cols[:-1]], domain=[[0, n - 1] for n in shape], maxdomain=[[0, 2**63 - 2]] * len(shape), options={"allows_duplicates": allows_duplicates})

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(d[1] + 1 for d in self.state.domain)

    @property
    def maxshape(self) -> tuple[int, ...]:
        return tuple(d[1] + 1 for d in self.state.maxdomain)

    @property
    def ndim(self) -> int:
        return len(self.state.index)

    @property
    def type(self) -> pa.DataType:
        return self.schema.field("soma_data").type

    def resize(self, newshape: Sequence[int], check_only: bool = False) -> tuple[bool, str]:
        return self._grow([(0, n - 1) for n in newshape], check_only)


class SparseNDArray(NDArray):
    """COO cells; absent ones are 0, zeros that were written are cells."""

    kind = "SparseNDArray"

    @property
    def nnz(self) -> int:
        return self.count

    def read(self, coords: object = (), *, result_order: str = "auto", batch_size: object = None, partitions: object = None) -> SparseRead:
        self.need("r")
        _check_read(batch_size, partitions)
        return SparseRead(self, coords, core.in_order(self.snapshot(coords), self.state.index, result_order))

    def write(self, values: object, bbox: Sequence[tuple[int, int]] | None = None) -> SparseNDArray:
        """COO as a table or frame, an Arrow COO, CSR or CSC tensor, or a compressed block; cells outside a bounding box that is given are an error."""
        if isinstance(values, Compressed):
            i, j, d = values.to_coo()
            values = pa.table({"soma_dim_0": i, "soma_dim_1": j, "soma_data": d})
        elif isinstance(values, pa.SparseCOOTensor):
            data, at = values.to_numpy()
            values = pa.table({f"soma_dim_{k}": np.ascontiguousarray(at[:, k]).astype(np.int64) for k in range(at.shape[1])} | {"soma_data": data.reshape(-1)})
        elif isinstance(values, pa.SparseCSRMatrix | pa.SparseCSCMatrix):
            data, indptr, indices = values.to_numpy()
            kind = "csr" if isinstance(values, pa.SparseCSRMatrix) else "csc"
            return self.write(Compressed(indptr.reshape(-1), indices.reshape(-1), data.reshape(-1), values.shape, kind), bbox)
        if bbox is not None and (len(bbox) != self.ndim or any(not d[0] <= a <= b <= d[1] for d, (a, b) in zip(self.state.domain, bbox))):
            raise ValueError(f"the box {bbox} does not lie in the shape {self.shape}")
        self._write(self._frame_of(values), bbox)
        return self

    def delete_cells(self, coords: object) -> None:
        self._delete(coords, None)


#: Cells of one tensor that the driver is handed (24 MB of a matrix of 8-byte values).
TENSOR_CELLS = 1 << 20


def coo_tensor(t: pa.Table, dims: Sequence[str], shape: Sequence[int]) -> pa.SparseCOOTensor:
    at = np.stack([t[n].to_numpy() for n in dims], axis=1)
    return pa.SparseCOOTensor.from_numpy(t["soma_data"].to_numpy(), at, shape=tuple(shape))


class SparseRead:
    """A lazy sparse read; the form of the result is chosen later."""

    def __init__(self, array: SparseNDArray, coords: object, df: Frame):
        self.array, self.coords, self.df = array, coords, df

    def tables(self) -> TableRead:
        return TableRead(self.df)

    def matrix(self, as_: str = "T") -> object:
        """The cells in memory as sorted triplets ("T"), compressed by rows ("R") or by columns ("C"), in the array's shape."""
        if self.array.ndim != 2:
            raise ValueError("only matrices have such forms")
        return represented(self.df.toArrow(), self.array.shape, as_)

    def _shape(self, shape: Sequence[int] | None) -> tuple[int, ...]:
        shape = tuple(shape or self.array.shape)
        if len(shape) != self.array.ndim:
            raise ValueError(f"a shape of {len(shape)} dimensions for an array of {self.array.ndim}")
        return shape

    def coos(self, shape: Sequence[int] | None = None) -> Iterator[pa.SparseCOOTensor]:
        """Tensors of the whole shape one after the other, together all cells (none where there are no cells): up to TENSOR_CELLS in each, so that the driver never holds them all."""
        shape, dims = self._shape(shape), self.array.index_column_names
        parts: list[pa.Table] = []
        have = 0
        for t in arrow_batches(self.df):
            while have + t.num_rows > TENSOR_CELLS:
                yield coo_tensor(pa.concat_tables([*parts, t.slice(0, TENSOR_CELLS - have)]), dims, shape)
                t, parts, have = t.slice(TENSOR_CELLS - have), [], 0
            parts.append(t)
            have += t.num_rows
        if have:
            yield coo_tensor(pa.concat_tables(parts), dims, shape)

    def coos_over(self, work: Callable[[pa.SparseCOOTensor], pa.Table], schema: str, shape: Sequence[int] | None = None) -> Frame:
        """Run `work` on tensors of the whole shape in tasks, together all cells; no cells come to the driver."""
        shape, dims = self._shape(shape), self.array.index_column_names
        return self.tables().over(lambda t: work(coo_tensor(t, dims, shape)), schema)

    def blockwise(self, axis: int | Sequence[int], *, size: int | None = None, reindex_disable_on_axis: int | Sequence[int] | None = None) -> Blockwise:
        axes = [axis] if isinstance(axis, int) else list(axis)
        if len(axes) != 1 or not 0 <= axes[0] < self.array.ndim:
            raise ValueError("blocks are made along one axis of the array")
        off = [] if reindex_disable_on_axis is None else [reindex_disable_on_axis] if isinstance(reindex_disable_on_axis, int) else list(reindex_disable_on_axis)
        return Blockwise(self, axes[0], size or (1 << 16 if axes[0] == 0 else 1 << 8), off)


class Span:
    """Consecutive joinids, written out only where they are asked for."""

    def __init__(self, first: int, end: int):
        self.first, self.end = first, max(first, end)

    def __len__(self) -> int:
        return self.end - self.first

    def __getitem__(self, at: slice) -> np.ndarray:
        lo, hi, step = at.indices(len(self))
        return np.arange(self.first + lo, self.first + hi, step)

    def __array__(self, dtype: object = None, copy: object = None) -> np.ndarray:
        return np.arange(self.first, self.end, dtype=dtype or np.int64)

    def tolist(self) -> list[int]:
        return list(range(self.first, self.end))


class Blockwise:
    """Blocks of complete rows (axis 0) or columns (axis 1); joinids say which they are.

    `frame` and `over` work on all blocks at once in tasks; the iterators hand them to the driver one after the other, from one job whose partitions come
    in the order of the blocks.
    """

    def __init__(self, read: SparseRead, axis: int, size: int, keep: Sequence[int]):
        self.read, self.axis, self.size, self.keep = read, axis, size, keep
        self.array = read.array

    def _ids(self, k: int) -> Span | np.ndarray:
        c = check_coords(self.read.coords, self.array.ndim, self.array.index_column_names)[k]
        n = self.array.shape[k]
        if c is None or isinstance(c, slice):
            s = c or slice(None)
            return Span(s.start or 0, n if s.stop is None else min(n, s.stop + 1))
        points = points_of(c)
        ids = np.array([c] if points is None else points, np.int64)
        if len(np.unique(ids)) < len(ids):
            raise ValueError("keys must be unique")
        return ids

    def frame(self) -> Frame:
        """The cells with the number of their block; coordinates are places within the block, or within the other axes' coordinates, unless reindexing is disabled."""
        df = self.read.df
        for k, d in enumerate(self.array.index_column_names):
            ids, col = self._ids(k), F.col(d)
            if isinstance(ids, Span):
                at = col - ids.first
            elif k == self.axis or k not in self.keep:
                points = self.array.spark.createDataFrame(pa.table({"__id": ids, "__at": np.arange(len(ids))}))
                df = df.join(F.broadcast(points) if len(ids) <= MAX_BROADCAST else points, col == F.col("__id")).drop("__id").withColumnRenamed("__at", f"__at{k}")
                at = F.col(f"__at{k}")
            if k == self.axis:
                df = df.withColumn("block", F.floor(at / self.size).cast("bigint"))
                at = at - F.col("block") * self.size
            if k not in self.keep:
                df = df.withColumn(d, at.cast("bigint"))
        return df.select("block", *self.array.index_column_names, "soma_data")

    def over(self, work: Callable[[int, pa.Table], pa.Table], schema: str) -> Frame:
        """Run `work` on (number, cells) of each block in a task; a block must fit into a task: see `rows_per_partition`."""

        def run(t: pa.Table) -> pa.Table:
            return work(t["block"][0].as_py(), t.drop_columns("block"))

        return self.frame().groupBy("block").applyInArrow(run, schema)

    def assembled(self) -> Frame:
        """One row a non-empty block, assembled in a task: (block, n_rows, n_columns, indptr, indices, data), rows as CSR, columns as CSC."""
        ids, axis, size, kind = [self._ids(k) for k in range(2)], self.axis, self.size, "csr" if self.axis == 0 else "csc"
        width = [self.array.shape[k] if k in self.keep else len(x) for k, x in enumerate(ids)]
        total = len(ids[axis])
        data = self.read.df.schema["soma_data"].dataType.simpleString()
        if axis in self.keep:
            raise ValueError("the axis of the blocks must be reindexed to be compressed")

        def work(block: int, t: pa.Table) -> pa.Table:
            shape = list(width)
            shape[axis] = min(size, total - block * size)
            m = Compressed.from_ijd(*(t[n].to_numpy() for n in ("soma_dim_0", "soma_dim_1", "soma_data")), tuple(shape), kind)
            return pa.table({"block": [block], "n_rows": [shape[0]], "n_columns": [shape[1]], "indptr": [m.indptr.astype(np.int64)], "indices": [m.indices.astype(np.int64)], "data": [m.data]})

        return self.over(work, f"block bigint, n_rows bigint, n_columns bigint, indptr array<bigint>, indices array<bigint>, data array<{data}>")

    def tables(self) -> Iterator[tuple[pa.Table, tuple]]:
        """(table, joinids of each axis), empty blocks included; places as in `frame`."""
        dims = self.array.index_column_names
        ids = [self._ids(k) for k in range(len(dims))]
        # ranges of (block, cell): the order of the partitions is that of the blocks, and a hot block spreads over several of them
        cells = self.frame().repartitionByRange("block", *dims).sortWithinPartitions("block", *dims)
        empty = pa.schema([pa.field(d, pa.int64()) for d in dims] + [pa.field("soma_data", arrow_type(cells.schema["soma_data"].dataType))]).empty_table()
        parts: list[pa.Table] = []
        now = 0

        def out() -> tuple[pa.Table, tuple]:
            t = pa.concat_tables(parts) if parts else empty
            parts.clear()
            return t, tuple(x[now * self.size : (now + 1) * self.size] if k == self.axis else x for k, x in enumerate(ids))

        for t in arrow_batches(cells):
            block = t["block"].to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]]) if len(block) else np.zeros(1, np.int64)
            for a, b in zip(edges[:-1], edges[1:]):
                while now < block[a]:
                    yield out()
                    now += 1
                parts.append(t.slice(a, b - a).drop_columns("block"))
        while now * self.size < len(ids[self.axis]):
            yield out()
            now += 1

    def compressed(self, compress: bool = True) -> Iterator[tuple[object, tuple]]:
        """(block, joinids): rows as CSR, columns as CSC, or coordinates where compress is off."""
        if self.array.ndim != 2:
            raise ValueError("only matrices can be compressed")
        if compress and self.axis in self.keep:
            raise ValueError("the axis of the blocks must be reindexed to be compressed")
        for t, ids in self.tables():
            i, j, d = (t[n].to_numpy() for n in ("soma_dim_0", "soma_dim_1", "soma_data"))
            shape = tuple(self.array.shape[k] if k in self.keep else len(ids[k]) for k in range(2))
            if compress:
                yield Compressed.from_ijd(i, j, d, shape, "csr" if self.axis == 0 else "csc"), ids
            else:
                order = np.lexsort((j, i) if self.axis == 0 else (i, j))
                yield (i[order], j[order], d[order], shape), ids

    def matrices(self, as_: str = "T") -> Iterator[tuple[object, tuple]]:
        """(block, joinids) in the form asked for: triplets ("T"), by rows ("R") or by columns ("C")."""
        if as_ == ("R" if self.axis == 0 else "C"):
            yield from self.compressed()
        else:
            for t, ids in self.tables():
                yield represented(t, tuple(self.array.shape[k] if k in self.keep else len(ids[k]) for k in range(2)), as_), ids

    def scipy(self, compress: bool = True) -> Iterator[tuple[object, tuple]]:
        """As `compressed`, as matrices of the sparse library where it is installed."""
        for block, ids in self.compressed(compress):
            yield (block.to_scipy() if compress else block), ids

    def coos(self) -> None:
        raise NotImplementedError("blockwise reads give tables or compressed blocks")


class DenseNDArray(NDArray):
    """A tensor; cells that were never written read as 0."""

    kind = "DenseNDArray"

    def _box(self, coords: object) -> list[tuple[int, int]]:
        out = []
        for k, c in enumerate(check_coords(coords, self.ndim, self.state.index)):
            n = self.shape[k]
            if c is None:
                out.append((0, n - 1))
            elif isinstance(c, slice):
                lo, hi = slice_bounds(c, (0, n - 1), f"soma_dim_{k}")
                out.append((0 if lo is None else lo, n - 1 if hi is None else hi))
            elif isinstance(c, int | np.integer):
                if not 0 <= c < n:
                    raise ValueError(f"{c} lies outside dimension {k} of {n}")
                out.append((int(c), int(c)))
            else:
                raise ValueError("dense arrays are read by slices and scalars")
        return out

    def read_frame(self, coords: object = ()) -> Frame:
        """All cells of the box as a lazy frame."""
        self.need("r")
        box = self._box(coords)
        return core.dense_box(self.snapshot([slice(a, b) for a, b in box]), self.state.index, box, "soma_data")

    def read(self, coords: object = (), *, result_order: str = "row-major") -> pa.Tensor:
        if result_order not in ("row-major", "column-major"):
            raise ValueError("a dense read is row-major or column-major")
        box = self._box(coords)
        self.need("r")
        t = self.snapshot([slice(a, b) for a, b in box]).toArrow()
        kind = self.type.to_pandas_dtype()
        out = np.zeros([b - a + 1 for a, b in box], kind)
        out[tuple(t[n].to_numpy() - a for n, (a, _) in zip(self.state.index, box))] = t["soma_data"].to_numpy().astype(kind)
        if result_order == "column-major":
            out = np.ascontiguousarray(out.T)
        return pa.Tensor.from_numpy(out)

    def read_table(self, coords: object = (), *, result_order: str = "row-major") -> pa.Table:
        """The cells of the box, absent ones filled, as a table in the order asked for."""
        dims = self.state.index
        return core.in_order(self.read_frame(coords), dims, result_order).select(*dims, "soma_data").toArrow()

    def write(self, coords: object, values: object) -> DenseNDArray:
        values = values.to_numpy() if isinstance(values, pa.Tensor) else np.asarray(values)
        self.need("w")
        box = self._box(coords)
        if values.shape != tuple(b - a + 1 for a, b in box):
            raise ValueError(f"values of shape {values.shape} don't fill the box {box}")
        at = np.indices(values.shape).reshape(values.ndim, -1)
        self._write(self._frame_of(pa.table({n: at[k] + box[k][0] for k, n in enumerate(self.state.index)} | {"soma_data": values.reshape(-1)})))
        return self

    def delete_cells(self, *_: object, **__: object) -> None:
        raise NotImplementedError("cells of a dense array can't be deleted")


def rows_per_partition(array: SparseNDArray) -> int:
    """Rows of a part of about 96 Mi cells, by the array's density in the log."""
    return rows_per_block(array.shape[0], array.fragment_cell_count())


def in_row_parts(array: SparseNDArray, df: Frame) -> Frame:
    """The cells by ranges of rows, as many as the array's density asks for, rows in order within each: tasks of about equal work, each with complete rows."""
    parts = max(1, -(-array.shape[0] // rows_per_partition(array)))
    return df.repartitionByRange(parts, "soma_dim_0").sortWithinPartitions("soma_dim_0", "soma_dim_1")
