"""Most similar vectors for every vector: cross-polytope hashing with multiprobe and exact reranking.

Each hash applies three rounds of random signs and a fast Hadamard transform to the unit vectors (a pseudo-random
rotation in O(d log d)) and assigns a vector to the nearest signed axis.  A table's buckets are named by several hashes, the more the more vectors there
are, so that their size does not grow with the collection.  A vector lies in the bucket of its nearest axes and asks the
`probes` buckets that cost the least change of axes in each of `tables` tables.  A bucket travels to a task as a whole; within it one more hash, asked for
`inner` nearest axes, tells which rows are compared at all; those are reranked by exact cosine.  Buckets of any size are worked through in blocks, never as
pairs of rows in a shuffle.

Equal vectors are hashed once: a group of copies is one vector with its smallest ids, which are the only ones that
can be among anybody's nearest.  Ties go to the smaller id.  Vectors of zeros, and null ids, take no part.
Empty input gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrella.llm.vectors import each_batch, in_blocks, unit, unpack, unpacked
from matrella.session import cut

ROUNDS = 3
DENSE = 128


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    rows = rows.copy()
    n, width = rows.shape
    step = 1
    while step < width:
        pairs = rows.reshape(n, width // (2 * step), 2, step)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, width)
        step *= 2
    return rows / np.sqrt(width)


def rotated(rows: np.ndarray, table: int, nth: int, seed: int = 7) -> np.ndarray:
    """Unit rows after the rotation of the table's nth hash, padded to a power of two."""
    width = 1 << (rows.shape[1] - 1).bit_length()
    signs = np.random.default_rng([seed, table, nth]).choice(np.array([-1, 1], np.float32), (ROUNDS, width))
    if width <= DENSE:  # narrow vectors: the same rotation, of the unit axes once, is quicker as a product
        turned = np.eye(rows.shape[1], width, dtype=np.float32)
    else:
        turned = np.zeros((len(rows), width), np.float32)
        turned[:, : rows.shape[1]] = rows
    for s in signs:
        turned = hadamard(turned * s)
    return rows.astype(np.float32) @ turned if width <= DENSE else turned


def nearest_axes(rows: np.ndarray, table: int, probes: int, nth: int = 0) -> np.ndarray:
    """For each unit row its `probes` nearest signed axes, nearest first: 2 * axis + (1 if negative)."""
    return _ranked(rotated(rows, table, nth), probes)[0]


def _ranked(turned: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest signed axes, and the size of the component on each."""
    size = np.abs(turned)
    probes = min(probes, turned.shape[1])
    best = np.argpartition(-size, probes - 1, axis=1)[:, :probes]
    best = np.take_along_axis(best, np.argsort(-np.take_along_axis(size, best, 1), axis=1, kind="stable"), 1)
    return 2 * best + (np.take_along_axis(turned, best, 1) < 0), np.take_along_axis(size, best, 1)


def buckets(rows: np.ndarray, table: int, hashes: int, probes: int) -> np.ndarray:
    """For each unit row its own bucket and the `probes` - 1 next ones, by how much shorter the components on their axes are in all."""
    width = 2 << (rows.shape[1] - 1).bit_length()
    code, cost = np.zeros((len(rows), 1), np.int64), np.zeros((len(rows), 1), np.float32)
    for k in range(hashes):
        axes, size = _ranked(rotated(rows, table, k), probes)
        code = (code[:, :, None] * width + axes[:, None, :]).reshape(len(rows), -1)
        cost = (cost[:, :, None] + (size[:, :1] - size)[:, None, :]).reshape(len(rows), -1)
        order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        code, cost = np.take_along_axis(code, order, 1), np.take_along_axis(cost, order, 1)
    return code


INNER = 100  # number of the hash within buckets, beyond those that name them


def _hashed(dims: int, tables: int, hashes: int, probes: int, inner: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to each row its buckets in all tables (`probes` a table), and its `inner` nearest axes within the buckets of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in each_batch(batches, 8192):
            rows = unit(unpack(t["vec"], dims)).astype(np.float32)
            keys, axes = [], []
            for table in range(tables):
                keys.append(buckets(rows, table, hashes, probes) * tables + table)
                axes.append(nearest_axes(rows, table, inner, INNER).astype("<u2"))
            keys = np.hstack(keys)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
            within = np.stack(axes, axis=1).reshape(len(rows) * tables, -1)
            width = within.shape[1] * 2
            blobs = pa.BinaryArray.from_buffers(pa.binary(), len(within), [None, pa.py_buffer(np.arange(len(within) + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(within))])
            of = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * tables), blobs)
            yield from pa.table([t["id"], t["vec"], t["ids"], lists, of], ["id", "vec", "ids", "keys", "within"]).to_batches()

    return run


def _first_by_cosine(asked: np.ndarray, held: np.ndarray, itself: np.ndarray, n: int) -> np.ndarray:
    """For each asked row the places of its first n held rows by (rounded cosine, place) but `itself`, in no order; held rows stand in the order of their ids."""
    place = np.arange(len(held))
    key = -np.rint((asked @ held.T) * 1e6).astype(np.int64) * len(held) + place
    key[itself[:, None] == place] = np.iinfo(np.int64).max
    return np.argpartition(key, n - 1, axis=1)[:, :n]


#: Buckets of at most so many held rows are compared as a whole.
SMALL = 64


def _meeting(asked: np.ndarray, held: np.ndarray, axes: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows asked and rows held that meet: all in a small bucket, else those held on an axis with those that ask for it; fewer rows share coarser axes."""
    if len(held) <= SMALL:
        yield asked, held
        return
    kinds = min(width, 1 << (len(held) // 16).bit_length())
    axes = axes * kinds // width
    order = held[np.argsort(axes[held, 0], kind="stable")]
    edge = np.searchsorted(axes[order, 0], np.arange(kinds + 1))
    wanted = np.zeros((kinds, len(asked)), bool)
    for probe in axes[asked].T:
        wanted[probe, np.arange(len(asked))] = True
    for kind in np.flatnonzero(np.diff(edge)):
        q = asked[wanted[kind]]
        if len(q):
            yield q, order[edge[kind] : edge[kind + 1]]


def _best_of_block(dims: int, k: int, least: float) -> Callable[[pa.Table], pa.Table]:
    """Of each asked row its k best held rows by (rounded cosine, smaller id), of those that it meets."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, rows = t["id"].to_numpy(), unit(unpack(t["vec"], dims))
        axes = unpacked(t["within"].combine_chunks(), "<u2")[0].reshape(len(ids), -1).astype(np.int64)
        small = rows.astype(np.float32)
        wide = k + 4  # candidates by float32, where that leaves no doubt; the order among them is exact
        # float32 scores err by less than (dims + 2) / 2^24; scores farther apart than this have different rounded cosines in the same order
        margin = 1e-6 + 2 * (dims + 2) / 2**24
        out_q, out_c, out_s = [], [], []
        for asked, among in _meeting(np.flatnonzero(t["is_q"].to_numpy()), np.flatnonzero(t["is_d"].to_numpy()), axes, 2 << (dims - 1).bit_length()):
            if not len(among):
                continue
            among = among[np.argsort(ids[among])]
            place = np.full(len(ids), -1)
            place[among] = np.arange(len(among))
            for at in range(0, len(asked), 512):
                q = asked[at : at + 512]
                best_i, best_e = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
                for from_ in range(0, len(among), 4096):
                    d = among[from_ : from_ + 4096]
                    s = small[q] @ small[d].T
                    itself = place[q] - from_
                    here = np.flatnonzero((itself >= 0) & (itself < len(d)))
                    s[here, itself[here]] = -2
                    n = min(wide, len(d))
                    if n < len(d):
                        top = np.argpartition(-s, n - 1, axis=1)[:, :n]
                        kept = np.sort(np.take_along_axis(s, top, 1), axis=1)
                        kth = kept[:, n - k]
                        doubt = np.flatnonzero((kept[:, 0] >= kth - margin) & (kth >= least - margin))
                        for x in np.array_split(doubt, -(-len(doubt) // 128)) if len(doubt) else []:
                            top[x] = _first_by_cosine(rows[q[x]], rows[d], itself[x], n)
                    else:
                        top = np.tile(np.arange(len(d)), (len(q), 1))
                    exact = np.round(np.einsum("qd,qcd->qc", rows[q], rows[d[top]]), 6)
                    exact[top == itself[:, None]] = -2
                    best_i, best_e = np.hstack([best_i, d[top]]), np.hstack([best_e, exact])
                    order = np.lexsort((ids[best_i], -best_e), axis=1)[:, :k]
                    best_i, best_e = np.take_along_axis(best_i, order, 1), np.take_along_axis(best_e, order, 1)
                exact, found = best_e, ids[best_i]
                ok = exact >= least
                out_q.append(np.repeat(ids[q], ok.sum(1)))
                out_c.append(found[ok])
                out_s.append(exact[ok])
        cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        of, other, score = cat(out_q, np.int64), cat(out_c, np.int64), cat(out_s, np.float64)
        order = np.lexsort((other, -score, of))
        of, other, score = of[order], other[order], score[order]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
        nth = np.arange(len(of)) - np.repeat(first, np.diff(np.r_[first, len(of)]))
        return pa.table({"id": of[nth < k], "other": other[nth < k], "similarity": score[nth < k]})

    return run


def hashes_for(n: int, dims: int, rows: int = 8192) -> int:
    """How many hashes name a bucket: so many that buckets of an even spread hold about `rows` vectors at most, one at least."""
    width = 2 << (dims - 1).bit_length()
    return max(1, math.ceil(math.log(max(n, 1) / rows, width)))


def nearest(vectors: DataFrame, dims: int, k: int = 5, least: float = 0.9, tables: int = 3, probes: int = 2, inner: int = 3) -> DataFrame:
    """(id, other, similarity): for each vector its k most similar other vectors of cosine (6 decimals) at least `least`.

    vectors: (id, vec) with unique ids, packed by `vectors.pack`.  Recall against brute force is measured in the tests (0.97 and more at the
    defaults); what is returned is exact.  Each hash beyond the first adds a probe.
    """
    vectors = cut(vectors)
    hashes = hashes_for(vectors.count(), dims)
    probes += hashes - 1
    same = Window.partitionBy("vec").orderBy("id")
    # the k + 2 smallest ids of each group of copies; the limit is applied before the shuffle
    first = vectors.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 2)
    groups = first.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "vec", "ids")
    groups = cut(groups.mapInArrow(_hashed(dims, tables, hashes, probes, inner), "id bigint, vec binary, ids array<bigint>, keys array<bigint>, within array<binary>"))

    at = groups.select("id", "vec", "within", F.posexplode("keys").alias("p", "grp"))
    at = at.select("grp", "id", "vec", F.element_at("within", (F.floor(F.col("p") / probes) + 1).cast("int")).alias("within"), F.lit(True).alias("is_q"), (F.col("p") % probes == 0).alias("is_d"))
    found = in_blocks(at, _best_of_block(dims, k, least), "id bigint, other bigint, similarity double")
    found = found.repartition("id").distinct()
    per = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    found = found.withColumn("nth", F.row_number().over(per)).where(F.col("nth") <= k).drop("nth")

    copies = groups.where(F.size("ids") > 1).select(F.col("id").alias("rep"), "ids")
    entries = found.join(copies.withColumnRenamed("rep", "other"), "other", "left")
    entries = entries.select("id", "similarity", F.explode(F.coalesce("ids", F.array("other"))).alias("other"))
    own = copies.select(F.col("rep").alias("id"), F.lit(1.0).alias("similarity"), F.explode("ids").alias("other"))
    entries = entries.unionByName(own)
    # one more than k: a member of the group itself may stand in its own list
    entries = entries.withColumn("nth", F.row_number().over(per)).where(F.col("nth") <= k + 1).drop("nth")

    singles = groups.where(F.size("ids") == 1).select("id")
    of_singles = entries.join(singles, "id", "left_semi").select("id", "other", "similarity")
    # members of groups of copies: those beyond the smallest k + 2 ids have the list of the group as well
    big = groups.where(F.size("ids") > 1).select("vec", F.col("id").alias("rep"))
    members = vectors.join(big, "vec").select("id", "rep")
    of_members = members.join(entries.withColumnRenamed("id", "rep"), "rep").where(F.col("id") != F.col("other")).select("id", "other", "similarity")
    both = of_singles.unionByName(of_members)
    return both.withColumn("nth", F.row_number().over(per)).where(F.col("nth") <= k).drop("nth")


def pairs(found: DataFrame) -> DataFrame:
    """Unordered pairs (joinid_a < joinid_b) in which one is among the nearest of the other."""
    return found.select(F.least("id", "other").alias("joinid_a"), F.greatest("id", "other").alias("joinid_b")).distinct()
