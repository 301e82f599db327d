"""Schemas that drift between files: rescue-column ingestion.

Every line of every file is brought into one target schema.  Whatever the target does not know, or what cannot be
cast to the target's type, is kept as JSON in the column `_rescued`, so nothing is lost.  The lines are parsed once: the rescue table, which is
written to the shared folder, also holds the names, types and texts of each line's fields as they were.  From it each change between a file and the one
before it is reported.  Renames among them are promoted: they map a drifted name to a target field, and rescued values are
replayed into the typed columns.

Nulls and dirt: null, empty and cut lines are ignored (they give no row); a line without a usable soma_joinid still
shows which fields its file has.  Repeated lines change nothing in the report and stay repeated in the table.
A file without any valid line has no fields.  Files of one stream with equal export times are ordered by file_id.
Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matrella.session import cut, written

KEY = "soma_joinid"


class _Number(str):
    """A number as it is written."""


class _Decimal(_Number):
    pass


def _refuse(text: str) -> None:
    raise ValueError(text)


def decoder() -> json.JSONDecoder:
    """One for many lines: making it costs as much as a line."""
    return json.JSONDecoder(parse_float=_Decimal, parse_int=_Number, parse_constant=_refuse)


def parse_line(text: str | None, decode: Callable[[str], object] | None = None) -> dict | None:
    """The object of a line with numbers kept as written; None if the line is not a valid JSON object."""
    if not text:
        return None
    try:
        got = (decode or decoder().decode)(text)
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def flat_fields(obj: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    """Fields with inner objects opened as outer/inner."""
    for name, value in obj.items():
        if isinstance(value, dict):
            yield from flat_fields(value, f"{prefix}{name}/")
        else:
            yield prefix + name, value


def kind_and_text(value: object) -> tuple[str | None, str | None]:
    if value is None:
        return None, None
    if isinstance(value, _Decimal):
        return "decimal", str(value)
    if isinstance(value, _Number):
        return "integer", str(value)
    if isinstance(value, bool):
        return "boolean", "true" if value else "false"
    if isinstance(value, str):
        return "string", value
    return "array", json.dumps(value)


def _joinid(value: object) -> int | None:
    text = str(value) if isinstance(value, str) else ""
    return int(text) if re.fullmatch(r"-?[0-9]{1,18}", text) else None


#: where a file mixes types in one field, the widest of them is the field's type there
WIDTH = {"string": 5, "array": 4, "decimal": 3, "integer": 2, "boolean": 1}

_INT = re.compile(r"\s*([+-]?[0-9]+)(?:\.0*)?\s*", re.ASCII)
_DOUBLE = re.compile(r"\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|NaN|Infinity)\s*", re.ASCII)
_BOOL = {"true": True, "t": True, "yes": True, "y": True, "1": True, "false": False, "f": False, "no": False, "n": False, "0": False}


def _whole(bits: int) -> Callable[[str], int | None]:
    def cast(text: str) -> int | None:
        m = _INT.fullmatch(text)
        value = int(m[1]) if m and len(text) < 40 else None
        return value if value is not None and -(1 << (bits - 1)) <= value < 1 << (bits - 1) else None

    return cast


#: Spark type -> text to value, None where it can't be cast; whole numbers may be written as 3.0
CASTS: dict[str, Callable[[str], object]] = {
    "string": lambda text: text,
    "int": _whole(32),
    "bigint": _whole(64),
    "double": lambda text: float(text) if _DOUBLE.fullmatch(text) else None,
    "boolean": lambda text: _BOOL.get(text.strip().lower()),
}
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def _candidates(names: tuple[str, ...], target: Mapping[str, str]) -> list[list[int]]:
    """For each target field the places of the names that may fill it: its own first, then those that equal it without case (last part of an inner name), by name."""
    last: dict[str, list[str]] = {}
    for n in names:
        last.setdefault(n.rsplit("/", 1)[-1].lower(), []).append(n)
    at = {n: k for k, n in enumerate(names)}
    return [[at[n] for n in sorted(last.get(f.lower(), ()), key=lambda n, f=f: (n != f, n))] + ([at[f]] if "/" in f and f in at else []) for f in target]


def _flat(obj: dict, prefix: str, names: list[str], values: list) -> None:
    for name, value in obj.items():
        if type(value) is dict:
            _flat(value, f"{prefix}{name}/", names, values)
        else:
            names.append(prefix + name)
            values.append(value)


_KINDS = {_Number: 2, _Decimal: 3, str: 5}
_PARSED = ("names", "widths", "texts")


def _lines(target: Mapping[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each line parsed, typed and rescued; lines that are no valid object stay as rows without names, as their file was there."""
    casts = [CASTS[k] for k in target.values()]
    kinds = [_ARROW[k] for k in target.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, ...], tuple[list[str], list[list[int]]]] = {}
        decode, encode = decoder().decode, json.JSONEncoder(ensure_ascii=False).encode
        for batch in batches:
            ids, shape, widths, texts, sizes, rescued = [], [], [], [], [], []
            typed: list[list] = [[] for _ in casts]
            for line in batch.column("payload").to_pylist():
                obj = parse_line(line, decode)
                if obj is None:
                    ids.append(None)
                    shape.append(None)
                    sizes.append(0)
                    rescued.append(None)
                    for column in typed:
                        column.append(None)
                    continue
                ids.append(_joinid(obj.pop(KEY, None)))
                names: list[str] = []
                values: list = []
                _flat(obj, "", names, values)
                key = tuple(names)
                if len(set(key)) < len(key):  # an inner name may be spelled like an outer one: the later counts
                    names, values = zip(*dict(zip(names, values)).items())
                    key = tuple(names)
                if key not in known:
                    known[key] = (list(key), _candidates(key, target))
                row = []
                for v in values:
                    if v is None:
                        widths.append(0)
                        row.append(None)
                    elif (w := _KINDS.get(type(v))) is not None:
                        widths.append(w)
                        row.append(v)
                    else:
                        kind, text = kind_and_text(v)
                        widths.append(WIDTH[kind])
                        row.append(text)
                texts += row
                sizes.append(len(row))
                shape.append(known[key][0])
                taken = set()
                for column, cast, places in zip(typed, casts, known[key][1]):
                    value = None
                    for k in places:
                        got = None if row[k] is None else cast(row[k])
                        if got is not None and value is None:
                            value = got
                        if got is not None and (got == value or got != got and value != value):
                            taken.add(k)
                    column.append(value)
                left = {n: t for k, (n, t) in enumerate(zip(key, row)) if t is not None and k not in taken}
                rescued.append(encode(left) if left else None)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            cols = [batch.column(n) for n in ("stream_id", "file_id", "exported_at", "line_no")]
            cols += [pa.array(ids, pa.int64()), pa.array(shape, pa.list_(pa.string())), pa.ListArray.from_arrays(ends, pa.array(widths, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(texts, pa.string()))]
            cols += [pa.array(c, k) for c, k in zip(typed, kinds)] + [pa.array(rescued, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["stream_id", "file_id", "exported_at", "line_no", KEY, *_PARSED, *target, "_rescued"])

    return run


def rescued_lines(files: DataFrame, target: Mapping[str, str]) -> DataFrame:
    """All lines with their target fields typed, the rest in `_rescued`, and their fields as they were: names, widths (see WIDTH, 0 for null) and texts.

    names is null where a line is no valid object.
    """
    if unknown := sorted(set(target.values()) - set(CASTS)):
        raise ValueError(f"no such target types: {', '.join(unknown)}")
    typed = "".join(f", `{f}` {k}" for f, k in target.items())
    src = files.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("file_id").cast("bigint").alias("file_id"), F.col("exported_at").cast("timestamp_ntz").alias("exported_at"), F.col("line_no").cast("int").alias("line_no"), "payload")
    return src.mapInArrow(_lines(target), f"stream_id string, file_id bigint, exported_at timestamp_ntz, line_no int, soma_joinid bigint, names array<string>, widths array<int>, texts array<string>{typed}, _rescued string")


#: Files whose wanted names are broadcast (a few names each); beyond that the engine chooses the join.
MAX_FILES = 100_000


def changes(files: DataFrame, min_equal: int = 5) -> DataFrame:
    """`changes_in` of files that nothing else is wanted of: everything is rescued."""
    return changes_in(written(rescued_lines(files, {})), min_equal)


def changes_in(lines: DataFrame, min_equal: int = 5) -> DataFrame:
    """Every change (stream_id, file_id, change_kind, old_field, new_field) of a file against the one before it in its stream, from a rescue table.

    renamed: the old name is gone, the new one is new, and at least `min_equal` records have values in both that are all equal as text;
    removed, added: gone or new without a rename; retyped: the type differs, a field of nulls keeping the type it had before.

    Names come first: what is there in each file is small, and values are looked up only in files with vanished and new names, and of these names only.
    """
    of_file = ["stream_id", "file_id"]
    order = Window.partitionBy("stream_id").orderBy("exported_at", "file_id")
    # a file without a valid line has one row without a field: it stands in the order of the files all the same
    field = lines.select(*of_file, "exported_at", F.explode_outer(F.arrays_zip("names", "widths")).alias("f")).select(*of_file, "exported_at", F.col("f.names").alias("field"), F.col("f.widths").alias("width"))
    seen = cut(field.groupBy(*of_file, "field").agg(F.max("width").alias("width"), F.min("exported_at").alias("exported_at")))
    seq = seen.groupBy(*of_file).agg(F.min("exported_at").alias("exported_at")).select(*of_file, F.row_number().over(order).alias("seq"), F.lead("file_id").over(order).alias("next_file"))
    seen = seen.where("field is not null").drop("exported_at").join(seq, of_file)
    by_field = Window.partitionBy("stream_id", "field").orderBy("seq")
    seen = seen.withColumn("type", F.last(F.when(F.col("width") > 0, F.col("width")), ignorenulls=True).over(by_field.rowsBetween(Window.unboundedPreceding, 0)))
    seen = seen.withColumns({"before": F.lag("seq").over(by_field), "after": F.lead("seq").over(by_field), "old_type": F.lag("type").over(by_field), "file_before": F.lag("file_id").over(by_field)})
    fresh = (F.col("seq") > 1) & F.coalesce(F.col("before") < F.col("seq") - 1, F.lit(True))
    stale = F.col("next_file").isNotNull() & F.coalesce(F.col("after") > F.col("seq") + 1, F.lit(True))
    moved = (F.col("before") == F.col("seq") - 1) & (F.col("old_type") != F.col("type"))
    here = lambda what, file, source: F.struct(F.lit(what).alias("what"), F.col(file).alias("file_id"), F.col(source).alias("source"))
    events = F.array_compact(F.array(F.when(fresh, here("new", "file_id", "file_id")), F.when(stale, here("gone", "next_file", "file_id")), F.when(moved, here("retyped", "file_id", "file_id"))))
    # (file_id, what, field, type, source): one row a change of names; source is the file that has the values
    found = cut(seen.select("stream_id", "field", "type", F.explode(events).alias("e")).select("stream_id", "e.*", "field", "type"))
    gone, new = found.where("what = 'gone'").drop("what"), found.where("what = 'new'").drop("what")

    # values of vanished and of new fields meet per record, in files that have both
    both = gone.select(*of_file).join(new.select(*of_file), of_file, "left_semi").distinct()
    wanted = found.where("what <> 'retyped'").join(both, of_file, "left_semi").groupBy("stream_id", F.col("source").alias("__source")).agg(F.collect_set(F.struct("file_id", "what", "field")).alias("wanted"))
    wanted = cut(wanted.withColumnRenamed("stream_id", "__stream"))
    if wanted.count() <= MAX_FILES:
        wanted = F.broadcast(wanted)
    value = lambda w: F.struct(w["file_id"].alias("file_id"), w["what"].alias("what"), w["field"].alias("field"), F.get("texts", F.array_position("names", w["field"]).cast("int") - 1).alias("value"))
    at = lines.where("names is not null and soma_joinid is not null").select("stream_id", F.col("file_id").alias("__file"), KEY, "names", "texts").join(wanted, (F.col("stream_id").eqNullSafe(F.col("__stream"))) & (F.col("__file") == F.col("__source")))
    # written out: both sides of the join below start from one pass over the lines
    values = cut(at.select("stream_id", KEY, F.explode(F.filter(F.transform("wanted", value), lambda v: v["value"].isNotNull())).alias("v")).select("stream_id", KEY, "v.*").distinct())
    old = values.where("what = 'gone'").select(*of_file, KEY, F.col("field").alias("old_field"), F.col("value").alias("old_value"))
    cur = values.where("what = 'new'").select(*of_file, KEY, F.col("field").alias("new_field"), F.col("value").alias("new_value"))
    met = old.join(cur, [*of_file, KEY]).groupBy(*of_file, KEY, "old_field", "new_field").agg(F.min((F.col("old_value") == F.col("new_value")).cast("int")).alias("equal"))
    pairs = met.groupBy(*of_file, "old_field", "new_field").agg(F.count(F.lit(1)).alias("n"), F.min("equal").alias("equal"))
    pairs = cut(pairs.where((F.col("n") >= min_equal) & (F.col("equal") == 1)).select(*of_file, "old_field", "new_field"))

    def out(df: DataFrame, kind: str, old_name: str, new_name: str) -> DataFrame:
        return df.select(*of_file, F.lit(kind).alias("change_kind"), F.col(old_name).alias("old_field"), F.col(new_name).alias("new_field"))

    types = pairs.join(gone.select(*of_file, F.col("field").alias("old_field"), F.col("type").alias("old_type")), [*of_file, "old_field"])
    types = types.join(new.select(*of_file, F.col("field").alias("new_field"), "type"), [*of_file, "new_field"]).where("old_type <> type")
    parts = [
        out(pairs, "renamed", "old_field", "new_field"),
        out(gone.join(pairs.withColumnRenamed("old_field", "field"), [*of_file, "field"], "left_anti"), "removed", "field", "field"),
        out(new.join(pairs.withColumnRenamed("new_field", "field"), [*of_file, "field"], "left_anti"), "added", "field", "field"),
        out(found.where("what = 'retyped'"), "retyped", "field", "field"),
        out(types, "retyped", "new_field", "new_field"),
    ]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionAll(p)
    return result.distinct()


def promotions(found: DataFrame, target: Iterable[str], max_names: int = 10_000) -> dict[str, str]:
    """Drifted name -> target field, from the renames found.

    Names linked by renames, directly or through others, stand for one field; such a set is promoted if it holds exactly one target
    name (compared without case, last part of an inner name).  Renames found in more files count first: one that would link two targets is
    refused, so a chance rename does not undo better ones.  Where renames of as many files contradict each other, the names concerned are
    not promoted; a warning names them.  The distinct names of fields, not of records, come to the driver; more than `max_names` of them
    are refused.
    """
    renamed = found.where("change_kind = 'renamed'").groupBy("old_field", "new_field").agg(F.countDistinct("file_id").alias("n"))
    edges = renamed.limit(max_names + 1).collect()
    if len(edges) > max_names:
        raise ValueError(f"more than {max_names} distinct renames; these are not field names")
    wanted = {t.lower(): t for t in target}
    weight: dict[tuple[str, str], int] = {}
    for e in edges:
        pair = min(e.old_field, e.new_field), max(e.old_field, e.new_field)
        weight[pair] = weight.get(pair, 0) + e.n
    of = {name: k for k, name in enumerate(sorted({x for pair in weight for x in pair}))}  # number of the set of each name
    sets = {k: {name} for name, k in of.items()}
    hits = {k: {wanted[t]} if (t := name.rsplit("/", 1)[-1].lower()) in wanted else set() for name, k in of.items()}
    doubtful: set[int] = set()
    for n in sorted(set(weight.values()), reverse=True):
        beside: dict[int, set[int]] = {}
        for (x, y), w in weight.items():
            if w == n and of[x] != of[y]:
                beside.setdefault(of[x], set()).add(of[y])
                beside.setdefault(of[y], set()).add(of[x])
        while beside:
            group, new = set(), {next(iter(beside))}
            while new:
                group |= new
                new = {z for k in new for z in beside.pop(k)} - group
            if len(set().union(*(hits[k] for k in group))) > 1 or group & doubtful:
                warnings.warn(f"renames contradict each other: {', '.join(sorted(x for k in group for x in sets[k]))}", stacklevel=2)
                doubtful |= {k for k in group if not hits[k]}
                continue
            first = min(group)
            for k in group - {first}:
                sets[first] |= sets[k]
                hits[first] |= hits[k]
                of |= dict.fromkeys(sets.pop(k), first)
    return {name: min(hits[k]) for k, names in sets.items() if hits[k] for name in sorted(names)}


def table_of(lines: DataFrame) -> DataFrame:
    """The valid lines of a rescue table as (file_id, line_no, soma_joinid, target fields typed, _rescued)."""
    return lines.where("names is not null").drop("stream_id", "exported_at", *_PARSED)


def ingest(files: DataFrame, target: Mapping[str, str]) -> DataFrame:
    """All lines as (file_id, line_no, soma_joinid, target fields typed, _rescued).

    target: field -> Spark type (one of CASTS).  A field of exactly that name is taken if it can be cast, else the first by name of those that equal it without case
    (last part of an inner name); every other non-null field, and every value
    that cannot be cast, stays in `_rescued` (a JSON object of texts, null when nothing is left).
    """
    return table_of(rescued_lines(files, target))


def replay(table: DataFrame, target: Mapping[str, str], promoted: Mapping[str, str]) -> DataFrame:
    """Rescued values moved into typed columns: promoted maps a rescued name to its target field.

    A typed value that is already there stays; what cannot be cast stays rescued.
    """
    return _fill(table.withColumn("__m", F.from_json("_rescued", "map<string,string>")), target, promoted)


def _cast(text: Column, kind: str) -> Column:
    if kind in ("int", "bigint"):  # whole numbers may be written as 3.0
        return F.when(text.rlike(r"^\s*[+-]?[0-9]+(\.0*)?\s*$"), F.regexp_replace(F.trim(text), r"\..*$", "").try_cast(kind))
    if kind == "double":
        return F.when(text.rlike(r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|NaN|Infinity)\s*$"), text.try_cast(kind))
    return text if kind == "string" else text.try_cast(kind)


def _fill(df: DataFrame, target: Mapping[str, str], names: Mapping[str, str]) -> DataFrame:
    cols, used = {}, []
    for field, kind in target.items():
        sources = sorted(n for n, f in names.items() if f == field)
        tries = [_cast(F.try_element_at("__m", F.lit(n)), kind) for n in sources]
        cols[field] = F.coalesce(F.col(f"`{field}`"), *tries) if tries else F.col(f"`{field}`")
        # a value leaves the rescue column when it agrees with what the typed column now holds
        used += [(n, _cast(F.try_element_at("__m", F.lit(n)), kind).eqNullSafe(F.col(f"`{field}`")) & F.col(f"`{field}`").isNotNull()) for n in sources]
    df = df.withColumns(cols)
    gone = F.array_compact(F.array(*[F.when(done, F.lit(n)) for n, done in used])) if used else F.array().cast("array<string>")
    df = df.withColumn("__gone", gone)
    left = F.map_filter("__m", lambda k, _: ~F.array_contains("__gone", k))
    df = df.withColumn("_rescued", F.when(F.size(left) > 0, F.to_json(left)))
    return df.drop("__m", "__gone")
