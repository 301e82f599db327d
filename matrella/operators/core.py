"""The small algebra of annotated matrices as DataFrame compositions.

Every function takes and returns frames; no rows come to the driver.  All are lazy but `numbered` and what builds on it, which write the keys out once and count
them, `in_sequence`, which writes the rows out once, and `number_new`, which asks for the largest id.  A matrix is a COO frame (soma_dim_0, soma_dim_1, ..., soma_data); an axis is a
frame with an integer id.  Null keys never match a selection or a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matrella.functions.filter_lang import compile_filter
from matrella.session import cut, written

#: Up to so many keys are numbered by one sort task (1 MB of ids), and so many lie in a range; see `numbered`.
NUMBERING_STEP = 1 << 17


def read_rows(df: DataFrame, columns: Sequence[str] | None = None, value_filter: str | None = None, syntax: str = "python") -> DataFrame:
    """Filter and project; the columns that the filter names are added to the projection."""
    names: list[str] = []
    if value_filter is not None:
        cond, names = compile_filter(value_filter, df.schema, syntax)
        df = df.where(cond)
    if columns is not None:
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"no such columns: {', '.join(missing)}")
        df = df.select(*[f"`{c}`" for c in dict.fromkeys([*columns, *names])])
    return df


def in_order(df: DataFrame, dims: Sequence[str], result_order: str = "auto") -> DataFrame:
    """auto: as it comes; row-major: by the dimensions; column-major: by the dimensions from last to first."""
    if result_order in ("auto", "unordered"):
        return df
    if result_order not in ("row-major", "column-major"):
        raise ValueError(f"unknown result order {result_order!r}")
    return df.orderBy(*(dims if result_order == "row-major" else dims[::-1]))


def semi(matrix: DataFrame, dim: str, ids: DataFrame, key: str = "soma_joinid") -> DataFrame:
    """Cells of the matrix whose dimension is among the ids; the engine broadcasts the ids if they are small enough."""
    keys = ids.select(F.col(key).alias("__id"))
    return matrix.join(keys, F.col(dim) == F.col("__id"), "left_semi")


def anti(matrix: DataFrame, dim: str, ids: DataFrame, key: str = "soma_joinid") -> DataFrame:
    """Cells whose dimension is not among the ids; cells with a null key stay."""
    keys = ids.select(F.col(key).alias("__id"))
    return matrix.join(keys, F.col(dim) == F.col("__id"), "left_anti")


def axis_matrix(matrix: DataFrame, obs_ids: DataFrame | None, var_ids: DataFrame | None, dims: Sequence[str] = ("soma_dim_0", "soma_dim_1")) -> DataFrame:
    """The flagship slice: COO cells whose row is among obs_ids and whose column is among var_ids."""
    if obs_ids is not None:
        matrix = semi(matrix, dims[0], obs_ids)
    if var_ids is not None:
        matrix = semi(matrix, dims[1], var_ids)
    return matrix


def numbered(keys: DataFrame, by: str | Sequence[str], name: str, start: int = 0) -> DataFrame:
    """keys (distinct, not null) with their place in ascending order of `by` (one column or several), from `start`.

    The keys are written out once, so what selects them runs once.  Up to NUMBERING_STEP of them are numbered by one sort.  More are range-partitioned and
    written again, so that the ranges stay as they are when
    tasks are repeated; each range is numbered by its own task and shifted by the sizes of the ranges before (one row a range).
    """
    by = [by] if isinstance(by, str) else list(by)
    keys = cut(keys)
    n = keys.count()
    if n <= NUMBERING_STEP:
        return keys.withColumn(name, (F.row_number().over(Window.orderBy(*by)) - 1 + F.lit(start)).cast("bigint"))
    ranges = cut(keys.repartitionByRange(-(-n // NUMBERING_STEP), *by).withColumn("__range", F.spark_partition_id()))
    sizes = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*by)) - 1
    out = ranges.withColumn("__within", within).join(before, "__range")
    return out.withColumn(name, (F.col("__within") + F.col("__before") + F.lit(start)).cast("bigint")).drop("__range", "__within", "__before")


def in_sequence(df: DataFrame, name: str, start: int = 0) -> DataFrame:
    """df with the place of each row in the order in which df gives its rows (say, after `in_order`), from `start`.

    The rows are written out once, each with its partition and its place there, so that the order stays as it is when tasks are repeated; places are shifted by the
    sizes of the partitions before (one row a partition, of which the driver keeps track anyway).  No row is sorted again.
    """
    bits = 33  # of the place within a partition
    rows = written(df.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", bits)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    out = rows.withColumn("__part", part).join(F.broadcast(before), "__part")
    place = F.col("__id") - F.shiftleft("__part", bits) + F.col("__before") + F.lit(start)
    return out.withColumn(name, place.cast("bigint")).drop("__id", "__part", "__before")


def ordinals(ids: DataFrame, key: str = "soma_joinid", name: str = "ordinal") -> DataFrame:
    """(key, ordinal): the place of each distinct non-null key in ascending order, from 0."""
    return numbered(ids.select(F.col(key).cast("bigint").alias(key)).where(F.col(key).isNotNull()).distinct(), key, name)


def lookup(df: DataFrame, col: str, index: DataFrame, key: str = "soma_joinid", name: str = "ordinal", out: str | None = None) -> DataFrame:
    """df with the ordinal of `col` in the index, -1 where the key is absent or null."""
    ix = index.select(F.col(key).alias("__key"), F.col(name).alias("__ord"))
    return df.join(ix, F.col(col) == F.col("__key"), "left").withColumn(out or name, F.coalesce("__ord", F.lit(-1))).drop("__key", "__ord")


def reindexed(matrix: DataFrame, obs: DataFrame, var: DataFrame, dims: Sequence[str] = ("soma_dim_0", "soma_dim_1"), names: Sequence[str] = ("i", "j")) -> DataFrame:
    """The matrix with dense ordinals of both axes."""
    for dim, ids, name in zip(dims, (obs, var), names):
        matrix = lookup(matrix, dim, ordinals(ids), out=name)
    return matrix


def latest(df: DataFrame, keys: Sequence[str], version: Sequence[Column]) -> DataFrame:
    """The newest row of each key: latest wins.  Predicates on keys pass below this, predicates on values must not."""
    w = Window.partitionBy(*keys).orderBy(*version)
    return df.withColumn("__nth", F.row_number().over(w)).where(F.col("__nth") == 1).drop("__nth")


#: Minor indices that one piece of a compressed row spans.
PIECE = 1 << 16


def compressed_rows(matrix: DataFrame, major: str, minor: str, value: str, width: int | None = None) -> DataFrame:
    """(major, piece, indices, data, nnz): each non-empty major index in pieces of `width` minor indices (PIECE if none is given), minor indices ascending.

    A piece holds at most `width` cells of a matrix without duplicates, so a row with any number of cells is spread over tasks; pieces one after the other are the row,
    and `row_pointers` tells where it begins.
    """
    width = width or PIECE
    cells = F.array_sort(F.collect_list(F.struct(F.col(minor).alias("j"), F.col(value).alias("v"))))
    piece = F.floor(F.col(minor) / width).cast("bigint").alias("piece")
    g = matrix.where(F.col(major).isNotNull() & F.col(minor).isNotNull()).groupBy(major, piece).agg(cells.alias("c"))
    return g.select(major, "piece", F.col("c.j").alias("indices"), F.col("c.v").alias("data"), F.size("c").alias("nnz"))


def row_pointers(matrix: DataFrame, major: str, block: int = 1 << 20) -> DataFrame:
    """(major, nnz, start, end): where each non-empty major index begins and ends in the compressed data.

    Counts combine on the map side; the running sum is taken within blocks of major indices and shifted by the sums of the blocks before.
    """
    counts = matrix.where(F.col(major).isNotNull()).groupBy(major).agg(F.count(F.lit(1)).alias("nnz")).withColumn("__block", F.floor(F.col(major) / block))
    sums = counts.groupBy("__block").agg(F.sum("nnz").alias("__n"))
    before = sums.select("__block", F.coalesce(F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    run = F.sum("nnz").over(Window.partitionBy("__block").orderBy(major))
    out = counts.withColumn("__run", run).join(before, "__block")
    end = F.col("__run") + F.col("__before")
    return out.select(major, "nnz", (end - F.col("nnz")).alias("start"), end.alias("end"))


def blockwise(matrix: DataFrame, dim: str, size: int | None = None, axis: int = 0) -> DataFrame:
    """The matrix with the number of the block of `dim` that each cell lies in; blocks hold complete rows (or columns)."""
    size = size or (1 << 16 if axis == 0 else 1 << 8)
    return matrix.where(F.col(dim).isNotNull()).withColumn("block", F.floor(F.col(dim) / size).cast("bigint"))


def dense_box(matrix: DataFrame, dims: Sequence[str], box: Sequence[tuple[int, int]], value: str, fill: object = 0) -> DataFrame:
    """All cells of a closed box, absent ones filled.

    The box is unfolded from one row by sequences, split over tasks by the first dimension, and joined to the cells inside it.
    """
    spark = matrix.sparkSession
    lo, hi = box[0]
    grid = spark.range(lo, hi + 1).withColumnRenamed("id", dims[0])
    for dim, (a, b) in zip(dims[1:], box[1:]):
        grid = grid.withColumn(dim, F.explode(F.sequence(F.lit(a).cast("bigint"), F.lit(b).cast("bigint"))))
    inside = matrix
    for dim, (a, b) in zip(dims, box):
        inside = inside.where(F.col(dim).between(a, b))
    return grid.join(inside.select(*dims, value), list(dims), "left").withColumn(value, F.coalesce(F.col(value), F.lit(fill)))


def filled_where_not(df: DataFrame, value: str, value_filter: str, fill: object = 0, syntax: str = "python") -> DataFrame:
    """A dense read under a value filter: cells that don't match keep their place and hold the fill value."""
    cond, _ = compile_filter(value_filter, df.schema, syntax)
    return df.withColumn(value, F.when(cond, F.col(value)).otherwise(F.lit(fill)))


def first_seen(*inputs: DataFrame) -> DataFrame:
    """(label, pos): the distinct non-null labels of several frames (label, pos) with the first place of each, inputs one after the other."""
    out = None
    for k, df in enumerate(inputs):
        part = df.select("label", F.struct(F.lit(k).alias("input"), F.col("pos").cast("bigint").alias("pos")).alias("seen"))
        out = part if out is None else out.unionAll(part)
    first = out.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("seen").alias("seen"))
    return first.select("label", "seen.input", "seen.pos")


def number_new(known: DataFrame, incoming: DataFrame, label: str, joinid: str = "soma_joinid", place: str | Sequence[str] | None = None) -> DataFrame:
    """(label, joinid, is_new): known labels keep their id; new ones are numbered after the largest, by the first place of each (by label where none is named)."""
    place = [label] if place is None else [place] if isinstance(place, str) else list(place)
    known = known.select(F.col(label), F.col(joinid).cast("bigint").alias(joinid))
    new = incoming.where(F.col(label).isNotNull()).groupBy(label).agg(F.min(F.struct(*place)).alias("__seen")).join(known.select(label), label, "left_anti")
    new = new.select(label, *[F.col(f"__seen.{p}").alias(p) for p in place if p != label])
    last = known.agg(F.max(joinid)).first()[0]
    start = 0 if last is None else last + 1
    got = numbered(new, place, joinid, start).select(label, joinid)
    return known.withColumn("is_new", F.lit(False)).unionByName(got.withColumn("is_new", F.lit(True)))
