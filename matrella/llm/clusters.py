"""Grouping records into similarity clusters by mergeable cluster-feature trees.

1. Each partition grows a cluster-feature tree: a leaf keeps the count and the linear sum of its unit vectors, from which centre
   and radius follow; leaves hang below coarse branches, so a vector is compared with branches first.
2. Leaf summaries are merged in a tree of reductions; the sum of two features is the feature of the union.
3. One pass over all vectors assigns each to its nearest leaf; vectors beyond all of them are leaves of their own.
4. Ward agglomeration joins the leaves, component by component, and the members nearest to a cluster's centre describe it.

For groups by the rule "linked if similar enough, directly or through others" the same four steps propose the groups, and an exact check follows.  Two
vectors within half the threshold angle of one leaf's centre are certainly similar, so such a leaf is one clique; leaves whose angles leave no doubt are linked or
separated at once.  Leaves of one Ward cluster are tried next: of each pair of them the member nearest to the other leaf is compared with that leaf's members.
What is then still in doubt, within or across clusters, is compared vector by vector, in blocks.  The result is exact, whatever Ward proposed.

Equal vectors count once with their smallest id; vectors of zeros and null ids take no part; empty input gives empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrella.llm.graph import components
from matrella.llm.vectors import distinct_vectors, each_batch, in_blocks, unit, unpack
from matrella.operators.core import numbered
from matrella.session import cut

#: Bound of a merged set of leaves: 4,096 leaves of 50 components are 1.6 MB.  Where more would be left, those with the fewest vectors are
#: set aside; their vectors are treated one by one afterwards, none is lost.
MAX_LEAVES = 4096
#: Where vectors outside all kept leaves are more than LOOSE, another set of leaves is grown over them, up to ROUNDS sets (ROUNDS * MAX_LEAVES leaves of 50
#: components are 13 MB of float32).
LOOSE, ROUNDS = 20_000, 16
FAN_IN = 8
SLACK = 1e-3  # radians; far above the float32 error of an angle that matters here

LEAF = "part int, n bigint, total binary"


class CFTree:
    """Leaves (count, linear sum) below branches; absorbs weighted unit vectors or other leaves."""

    def __init__(self, dims: int, angle: float, branch_angle: float = 1.05):
        self.dims, self.near, self.branch_near = dims, np.cos(angle), np.cos(branch_angle)
        self.n = np.zeros(0, np.int64)
        self.total = np.zeros((0, dims))
        self.branch_of = np.zeros(0, np.int64)
        self.branch_total = np.zeros((0, dims))

    def _nearest_leaf(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf and cosine of the nearest leaf in the nearest branch; -1 where there is none."""
        leaf, cosine = np.full(len(rows), -1), np.full(len(rows), -2.0)
        if not len(self.n):
            return leaf, cosine
        centres = unit(self.total)
        branch = np.argmax(rows @ unit(self.branch_total).T, axis=1)
        for b in np.unique(branch):
            mine, below = np.flatnonzero(branch == b), np.flatnonzero(self.branch_of == b)
            s = rows[mine] @ centres[below].T
            k = np.argmax(s, axis=1)
            leaf[mine], cosine[mine] = below[k], s[np.arange(len(mine)), k]
        return leaf, cosine

    def add(self, rows: np.ndarray, n: np.ndarray, total: np.ndarray) -> None:
        """rows: unit vectors (or centres of leaves); n, total: their features."""
        leaf, cosine = self._nearest_leaf(rows)
        fits = cosine >= self.near
        np.add.at(self.n, leaf[fits], n[fits])
        np.add.at(self.total, leaf[fits], total[fits])
        np.add.at(self.branch_total, self.branch_of[leaf[fits]], total[fits])
        rest = np.flatnonzero(~fits)
        new_n, new_total = [], []
        while len(rest):  # each round makes one leaf of all that is near to the first one left
            close = rows[rest] @ rows[rest[0]] >= self.near
            close[0] = True
            new_n.append(n[rest[close]].sum())
            new_total.append(total[rest[close]].sum(0))
            rest = rest[~close]
        if new_n:
            new_total = np.array(new_total)
            branch = self._branches(unit(new_total), new_total)
            self.n = np.concatenate([self.n, np.array(new_n, np.int64)])
            self.total = np.vstack([self.total, new_total])
            self.branch_of = np.concatenate([self.branch_of, branch])

    def _branches(self, centres: np.ndarray, total: np.ndarray) -> np.ndarray:
        out = np.zeros(len(centres), np.int64)
        for k, c in enumerate(centres):
            near = unit(self.branch_total) @ c if len(self.branch_total) else np.zeros(0)
            if len(near) and (near.max() >= self.branch_near or len(near) >= 64):
                out[k] = np.argmax(near)
                self.branch_total[out[k]] += total[k]
            else:
                out[k] = len(near)
                self.branch_total = np.vstack([self.branch_total, total[k]])
        return out

    def largest(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        keep = np.sort(np.argsort(-self.n, kind="stable")[:most])
        return self.n[keep], self.total[keep]


def _leaf_table(part: int, n: np.ndarray, total: np.ndarray) -> pa.Table:
    width = total.shape[1] * 8
    blobs = pa.array([t.astype("<f8").tobytes() for t in total], pa.binary()) if len(total) else pa.array([], pa.binary())
    assert not len(blobs) or len(blobs[0].as_py()) == width
    return pa.table([pa.array(np.full(len(n), part), pa.int32()), pa.array(n, pa.int64()), blobs], ["part", "n", "total"])


def _totals(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dims)


def _grow(dims: int, angle: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tree = CFTree(dims, angle)
        for t in each_batch(batches, 2048):
            rows = unit(unpack(t["vec"], dims))
            tree.add(rows, np.ones(len(rows), np.int64), rows)
        ctx = TaskContext.get()
        yield from _leaf_table(ctx.partitionId() if ctx else 0, *tree.largest(MAX_LEAVES)).to_batches()

    return run


def _merge(dims: int, angle: float) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        n, total = t["n"].to_numpy(), _totals(t["total"], dims)
        order = np.lexsort((total[:, 0], -n))  # heavy leaves first: light ones join them
        tree = CFTree(dims, angle)
        for at in range(0, len(order), 1024):
            o = order[at : at + 1024]
            tree.add(unit(total[o]), n[o], total[o])
        return _leaf_table(int(t["part"][0].as_py()), *tree.largest(MAX_LEAVES))

    return run


def leaves(vectors: DataFrame, dims: int, angle: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged leaves of all partitions, at most MAX_LEAVES, on the driver: centres as float32, counts and linear sums."""
    found = cut(vectors.mapInArrow(_grow(dims, angle), LEAF))
    parts = (found.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        parts = -(-parts // FAN_IN)
        found = found.withColumn("part", F.pmod("part", F.lit(parts)).cast("int")).groupBy("part").applyInArrow(_merge(dims, angle), LEAF)
    got = found.select("n", "total").toArrow()
    if not got.num_rows:
        return np.zeros((0, dims), np.float32), np.zeros(0, np.int64), np.zeros((0, dims))
    n, total = got["n"].to_numpy(), _totals(got["total"], dims)
    order = np.lexsort((total[:, 0], -n))
    return unit(total[order]).astype(np.float32), n[order], total[order]


def _outside(dims: int, centres: np.ndarray, angle: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The vectors farther than `angle` from all centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in each_batch(batches, 1024):
            far = (unit(unpack(t["vec"], dims)).astype(np.float32) @ centres.T).max(axis=1) < np.cos(angle)
            yield from t.filter(pa.array(far)).to_batches()

    return run


def warded_leaves(vectors: DataFrame, dims: int, angle: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres of leaves and the Ward cluster of each; where MAX_LEAVES binds and many vectors are left outside, further sets of leaves follow over those alone."""
    centres, cluster, rest, before = [], [], vectors, None
    while True:
        c, n, total = leaves(rest, dims, angle)
        cluster.append(ward(c, n, total, least) + sum(map(len, centres)))
        centres.append(c)
        if len(c) < MAX_LEAVES or not len(c) or len(centres) == ROUNDS:
            break
        rest = cut(rest.mapInArrow(_outside(dims, c, angle), rest.schema))
        left = rest.count()
        if left <= LOOSE or before is not None and left > 0.95 * before:
            break
        before = left
    return np.vstack(centres), np.concatenate(cluster)


def ward(centres: np.ndarray, n: np.ndarray, total: np.ndarray, least: float) -> np.ndarray:
    """Cluster number of each leaf: Ward agglomeration by nearest-neighbour chains.

    Two clusters may merge only if their centres' similarity, and the mean similarity within the union (|sum|^2 / n^2 of its unit vectors), is
    at least `least`; so a small cluster is not swallowed by a large one far from it.
    """
    m = len(n)
    n, total = n.astype(float).copy(), total.astype(float).copy()
    square = (total**2).sum(1)
    label, alive = np.arange(m), n > 0
    chain: list[int] = []
    while True:
        if not chain:
            left = np.flatnonzero(alive)
            if not len(left):
                return label
            chain.append(int(left[0]))
        a = chain[-1]
        dot = total @ total[a]
        joint_n = n + n[a]
        joint = square + square[a] + 2 * dot
        ok = alive & (joint >= least * joint_n**2) & (dot >= least * np.sqrt(square * square[a]))
        ok[a] = False
        at = np.flatnonzero(ok)
        if not len(at):
            alive[a] = False  # nothing may join it any more
            chain = []
            continue
        cost = n[at] * n[a] / joint_n[at] * (square[at] / n[at] ** 2 + square[a] / n[a] ** 2 - 2 * dot[at] / (n[at] * n[a]))
        b = int(at[np.argmin(cost)])
        if len(chain) > 1 and ok[chain[-2]] and cost[at == chain[-2]][0] <= cost.min() * (1 + 1e-12) + 1e-15:
            b = chain[-2]
            chain = chain[:-2]
            n[a] += n[b]
            total[a] += total[b]
            square[a] = total[a] @ total[a]
            alive[b] = False
            label[label == b] = a
        else:
            chain.append(b)


def _assign(dims: int, centres: np.ndarray, cluster: np.ndarray, reach: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, vec, leaf, angle, near): nearest leaf of each vector, and all other leaves within `reach`, with whether they are of the same cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in each_batch(batches, 1024):
            rows = unit(unpack(t["vec"], dims)).astype(np.float32)
            if len(centres):
                s = rows @ centres.T
                leaf = np.argmax(s, axis=1)
                angle = np.arccos(np.clip(s[np.arange(len(rows)), leaf], -1, 1))
                hit = s >= np.cos(reach)
                hit[np.arange(len(rows)), leaf] = False
                r, c = np.nonzero(hit)
                near = pa.StructArray.from_arrays([pa.array(c.astype(np.int32)), pa.array(np.arccos(np.clip(s[r, c], -1, 1)).astype(np.float64)), pa.array(cluster[leaf[r]] == cluster[c])], ["leaf", "angle", "fellow"])
                offsets = pa.array(np.concatenate([[0], np.cumsum(hit.sum(1))]).astype(np.int32))
                nears = pa.ListArray.from_arrays(offsets, near)
            else:
                leaf, angle = np.full(len(rows), -1), np.full(len(rows), np.pi)
                nears = pa.array([[] for _ in rows], pa.list_(pa.struct([("leaf", pa.int32()), ("angle", pa.float64()), ("fellow", pa.bool_())])))
            yield from pa.table([t["id"], t["vec"], pa.array(leaf.astype(np.int32)), pa.array(angle.astype(np.float64)), nears], ["id", "vec", "leaf", "angle", "near"]).to_batches()

    return run


def assign(vectors: DataFrame, centres: np.ndarray, cluster: np.ndarray, dims: int, reach: float) -> DataFrame:
    """The full assignment pass; the centres (at most MAX_LEAVES rows a set of leaves) travel with the task."""
    return vectors.mapInArrow(_assign(dims, centres, cluster, reach), "id bigint, vec binary, leaf int, angle double, near array<struct<leaf:int,angle:double,fellow:boolean>>")


def _linked(dims: int, least: float) -> Callable[[pa.Table], pa.Table]:
    """A spanning forest of the asked and held rows of a block that are similar enough, as (a, b) of their ids."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, rows = t["id"].to_numpy(), unit(unpack(t["vec"], dims))
        small = rows.astype(np.float32)
        asked, held = np.flatnonzero(t["is_q"].to_numpy()), np.flatnonzero(t["is_d"].to_numpy())
        root = np.arange(len(ids))
        a, b = [], []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for at in range(0, len(asked), 256):
            q = asked[at : at + 256]
            s = small[q] @ small[held].T
            for k in np.flatnonzero((s >= least - 1e-5).any(axis=1)):
                hits = held[s[k] >= least - 1e-5]
                hits = hits[np.round(rows[hits] @ rows[q[k]], 6) >= least]
                for h in hits[np.unique(root[hits], return_index=True)[1]]:
                    x, y = find(q[k]), find(int(h))
                    if x != y:
                        root[y] = x
                        a.append(ids[q[k]])
                        b.append(ids[h])
        return pa.table([pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64))], ["a", "b"])

    return run


def linked_groups(vectors: DataFrame, dims: int, least: float = 0.9) -> DataFrame:
    """(cluster_key, id): groups of two and more vectors linked by cosine (6 decimals) >= `least`, directly or through others.

    vectors: (id, vec) with unique ids.  cluster_key is the smallest id of the group.
    """
    theta = float(np.arccos(least - 5e-7))
    half = theta / 2 - SLACK
    vectors = cut(vectors)
    reps = cut(distinct_vectors(vectors))
    centres, cluster = warded_leaves(reps, dims, half, least)
    seen = cut(assign(reps, centres, cluster, dims, theta + half + SLACK))

    # a vector within half the angle of its leaf's centre is of the leaf's clique; the clique goes by its smallest id
    core = seen.where(F.col("angle") <= half)
    cliques = cut(core.groupBy("leaf").agg(F.min("id").alias("unit"), F.max("angle").alias("reach")))
    units = seen.join(cliques.select("leaf", F.col("unit").alias("clique")), "leaf", "left")
    units = cut(units.select("id", "vec", "leaf", "angle", "near", F.when(F.col("angle") <= half, F.col("clique")).otherwise(F.col("id")).alias("unit")))

    # where angles decide; a loose vector also looks at the clique of its own leaf
    own = F.when(F.col("angle") > half, F.array(F.struct("leaf", "angle", F.lit(True).alias("fellow")))).otherwise(F.array().cast("array<struct<leaf:int,angle:double,fellow:boolean>>"))
    looks = units.select("id", "unit", F.explode(F.concat("near", own)).alias("x")).select("id", "unit", "x.leaf", F.col("x.angle").alias("angle"), "x.fellow")
    looks = looks.join(cliques.withColumnRenamed("unit", "to"), "leaf").where(F.col("angle") <= theta + F.col("reach") + SLACK)
    sure = looks.where(F.col("angle") <= theta - F.col("reach") - SLACK).select(F.col("unit").alias("a"), F.col("to").alias("b")).distinct()

    def against(pairs: DataFrame) -> DataFrame:
        """Vectors asked (id, leaf) and the cliques they are asked against, as groups by leaf."""
        asked = units.join(pairs.withColumnRenamed("leaf", "grp"), "id").select(F.col("grp").cast("bigint").alias("grp"), "id", "vec", F.lit(True).alias("is_q"), F.lit(False).alias("is_d"))
        held = units.where(F.col("angle") <= half).join(pairs.select("leaf").distinct(), "leaf", "left_semi").select(F.col("leaf").cast("bigint").alias("grp"), "id", "vec", F.lit(False).alias("is_q"), F.lit(True).alias("is_d"))
        return asked.unionAll(held)

    def by_unit(found: DataFrame) -> DataFrame:
        unit_of = units.select("id", "unit")
        found = found.join(unit_of.select(F.col("id").alias("a"), F.col("unit").alias("ua")), "a").join(unit_of.select(F.col("id").alias("b"), F.col("unit").alias("ub")), "b")
        return found.select(F.col("ua").alias("a"), F.col("ub").alias("b"))

    # what Ward proposes: of each unit the vector nearest to another leaf of its cluster, against that leaf's clique; and loose vectors against each other
    doubtful = looks.where(F.col("angle") > theta - F.col("reach") - SLACK)
    tried = cut(doubtful.where("fellow and unit <> to").groupBy("unit", "leaf").agg(F.min_by("id", F.struct("angle", "id")).alias("id")).select("id", "leaf").distinct())
    loose = units.where(F.col("angle") > half).select(F.lit(-1).cast("bigint").alias("grp"), "id", "vec", F.lit(True).alias("is_q"), F.lit(True).alias("is_d"))
    among = by_unit(in_blocks(loose.unionAll(against(tried)), _linked(dims, least), "a bigint, b bigint"))
    joined = cut(components(sure.unionAll(among)))

    # the exact rest: only where a vector and a clique are not yet in one component
    def top(df: DataFrame, col: str, out: str) -> DataFrame:
        return df.join(joined.select(F.col("node").alias(col), F.col("component").alias(out)), col, "left").withColumn(out, F.coalesce(out, col))

    doubt = top(top(doubtful, "unit", "from_top"), "to", "to_top").where("from_top <> to_top")
    doubt = cut(doubt.select("id", "leaf").distinct())
    more = cut(by_unit(in_blocks(against(doubt), _linked(dims, least), "a bigint, b bigint")))
    if not more.isEmpty():  # the components found so far are stars already: few rounds join them
        joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more))

    keys = top(units.select("id", "vec", "unit"), "unit", "cluster_key").select("vec", "cluster_key")
    rows = vectors.join(keys, "vec").select("cluster_key", "id")
    big = rows.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("cluster_key")
    return rows.join(big, "cluster_key", "left_semi")


def describe(vectors: DataFrame, dims: int, least: float = 0.9, typical: int = 3) -> DataFrame:
    """(cluster, id, size, nearness, nth): each vector's Ward cluster; nth orders the members of a cluster by nearness to its centre.

    Only the `typical` members nearest to each centre and the size are returned; copies count in the size.  Every vector is in a cluster: one that is
    farther from every kept leaf than the threshold angle is a leaf of its own.  Clusters are numbered in the order of their smallest ids.

    Ward joins two clusters only if some leaf of the one and some leaf of the other have means whose product reaches `_least_product`; so leaves that are not
    linked by it, directly or through others, never meet, and agglomerating each component by itself gives what all leaves at once would give.
    """
    theta = float(np.arccos(least))
    spark = vectors.sparkSession
    copies = vectors.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    reps = cut(copies)
    centres, *_ = leaves(reps.select("id", "vec"), dims, theta / 2)
    seen = cut(assign(reps.select("id", "vec"), centres, np.zeros(len(centres)), dims, 0.0).drop("near").join(reps.select("id", "copies"), "id"))
    covered, rest = seen.where(F.col("angle") <= theta), seen.where(F.col("angle") > theta)

    # the kept leaves, at most MAX_LEAVES; a leaf goes by the smallest id of its members
    first = {r.leaf: r.unit for r in covered.groupBy("leaf").agg(F.min("id").alias("unit")).collect()}
    sums: dict[int, list] = {}
    for leaf, k, blob in _leaf_sums(covered, dims):
        was = sums.setdefault(leaf, [0, np.zeros(dims)])
        was[0], was[1] = was[0] + k, was[1] + np.frombuffer(blob, "<f8")
    at = sorted(first)
    n, total = np.array([sums[k][0] for k in at], np.int64), np.array([sums[k][1] for k in at]).reshape(-1, dims)
    unit_of = np.array([first[k] for k in at], np.int64)
    mean = total / n[:, None]
    needed = _least_product(np.linalg.norm(mean, axis=1), least)
    node = unit_of[_components_of_leaves(mean, needed)]
    blobs = pa.array([x.astype("<f8").tobytes() for x in total], pa.binary())
    kept = spark.createDataFrame(pa.table([pa.array(at, pa.int32()), pa.array(unit_of), pa.array(node), pa.array(n), blobs], ["leaf", "unit", "node", "n", "total"]))

    # the rest against the kept leaves, and against each other in blocks
    to_kept = rest.select("id", "vec").mapInArrow(_beside_leaves(dims, mean, needed, node, least), "a bigint, b bigint")
    both = rest.select(F.pmod("id", F.lit(1)).alias("grp"), "id", "vec", F.lit(True).alias("is_q"), F.lit(True).alias("is_d"))
    among = in_blocks(both, _linked(dims, least**2 - 2e-6), "a bigint, b bigint").where("a <> b")
    joined = cut(components(to_kept.unionAll(among)))
    component = F.coalesce("component", "node").alias("component")
    units = kept.join(joined, "node", "left").select(component, "unit", "n", "total")
    loose = rest.join(joined.withColumnRenamed("node", "id"), "id").select("component", "id", "copies", "vec").mapInArrow(_as_leaves(dims), units.schema)
    labels = cut(units.unionAll(loose).groupBy("component").applyInArrow(_warded(dims, least), "unit bigint, cluster_key bigint, middle binary"))

    here = covered.join(F.broadcast(kept.select("leaf", "unit").join(labels, "unit").drop("unit")), "leaf").select("id", "vec", "copies", "cluster_key", "middle")
    here = here.unionAll(rest.join(labels.withColumnRenamed("unit", "id"), "id").select("id", "vec", "copies", "cluster_key", "middle"))
    alone = rest.join(joined, F.col("id") == F.col("node"), "left_anti").select("id", "copies", F.col("id").alias("cluster_key"), F.lit(1.0).alias("nearness"))
    members = cut(here.mapInArrow(_nearness(dims), "id bigint, copies bigint, cluster_key bigint, nearness double").unionAll(alone))
    order = Window.partitionBy("cluster_key").orderBy(F.desc("nearness"), "id")
    top = members.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= typical)
    size = members.groupBy("cluster_key").agg(F.sum("copies").alias("size"))
    number = numbered(size.select("cluster_key"), "cluster_key", "cluster").withColumn("cluster", F.col("cluster").cast("int"))
    return top.join(size, "cluster_key").join(number, "cluster_key").select("cluster", "id", "size", "nearness", "nth")


def _least_product(length: np.ndarray, least: float) -> np.ndarray:
    """The share of leaves with means of this length in the bound of `describe`: leaves i and j are linked if their means' product is at least share i * share j.

    Ward's first condition is sum a . sum b >= least |sum a| |sum b|, so some pair of leaves reaches least times the lengths of the clusters' means; the mean of
    a cluster of several leaves is at least sqrt(least) long, that of one leaf as long as it is.
    """
    return np.sqrt(least) * np.minimum(length, np.sqrt(least))


def _components_of_leaves(mean: np.ndarray, share: np.ndarray) -> np.ndarray:
    """For each leaf the first leaf of its component."""
    root = np.full(len(mean), -1)
    for k in range(len(mean)):
        front = np.array([k] if root[k] < 0 else [], np.int64)
        root[front] = k
        while len(front):
            hit = np.zeros(len(mean), bool)
            for at in range(0, len(front), 256):
                f = front[at : at + 256]
                hit |= (mean @ mean[f].T >= share[:, None] * share[f] - 1e-6).any(axis=1)
            front = np.flatnonzero(hit & (root < 0))
            root[front] = k
    return root


def _beside_leaves(dims: int, mean: np.ndarray, share: np.ndarray, node: np.ndarray, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(a, b): a vector that is a leaf of its own and the node of each component of kept leaves that it is linked to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in each_batch(batches, 1024):
            r, c = np.nonzero(unit(unpack(t["vec"], dims)) @ mean.T >= _least_product(np.ones(1), least) * share - 1e-6)
            found = np.unique(np.stack([t["id"].to_numpy()[r], node[c]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return run


def _as_leaves(dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in each_batch(batches, 8192):
            total = unit(unpack(t["vec"], dims)) * t["copies"].to_numpy()[:, None]
            yield from pa.table([t["component"], t["id"], t["copies"], pa.array([x.astype("<f8").tobytes() for x in total], pa.binary())], ["component", "unit", "n", "total"]).to_batches()

    return run


def _warded(dims: int, least: float) -> Callable[[pa.Table], pa.Table]:
    """(unit, cluster_key, middle): cluster of each leaf of a component, by its smallest unit, and the cluster's centre."""

    def run(t: pa.Table) -> pa.Table:
        ids, n, total = t["unit"].to_numpy(), t["n"].to_numpy(), _totals(t["total"], dims)
        order = np.lexsort((ids, -n))  # the result does not depend on the order of rows
        ids, n, total = ids[order], n[order], total[order]
        kinds, at = np.unique(ward(unit(total), n, total, least), return_inverse=True)
        key = np.full(len(kinds), np.iinfo(np.int64).max)
        np.minimum.at(key, at, ids)
        middle = np.zeros((len(kinds), dims))
        np.add.at(middle, at, total)
        blobs = [x.astype("<f8").tobytes() for x in unit(middle)]
        return pa.table([pa.array(ids), pa.array(key[at]), pa.array([blobs[k] for k in at], pa.binary())], ["unit", "cluster_key", "middle"])

    return run


def _nearness(dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in each_batch(batches, 8192):
            near = np.round((unit(unpack(t["vec"], dims)) * _totals(t["middle"], dims)).sum(1), 6)
            yield from pa.table([t["id"], t["copies"], t["cluster_key"], pa.array(near)], ["id", "copies", "cluster_key", "nearness"]).to_batches()

    return run


def _leaf_sums(seen: DataFrame, dims: int) -> list:
    """(leaf, n, total) per task and leaf; at most MAX_LEAVES rows a task reach the second step, and MAX_LEAVES rows the driver."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, float] = {}
        total: dict[int, np.ndarray] = {}
        for t in each_batch(batches, 8192):
            leaf, copies, rows = t["leaf"].to_numpy(), t["copies"].to_numpy(), unit(unpack(t["vec"], dims))
            for k in np.unique(leaf):
                m = leaf == k
                n[k] = n.get(k, 0) + int(copies[m].sum())
                total[k] = total.get(k, 0) + (rows[m] * copies[m, None]).sum(0)
        keys = sorted(n)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([n[k] for k in keys], pa.int64()), pa.array([total[k].astype("<f8").tobytes() for k in keys], pa.binary())], ["leaf", "n", "total"])

    def merge(t: pa.Table) -> pa.Table:
        return pa.table([t["leaf"].slice(0, 1), pa.array([pc.sum(t["n"]).as_py()], pa.int64()), pa.array([_totals(t["total"], dims).sum(0).astype("<f8").tobytes()], pa.binary())], ["leaf", "n", "total"])

    part = seen.select("leaf", "copies", "vec").mapInArrow(local, "leaf int, n bigint, total binary")
    return [(r.leaf, r.n, bytes(r.total)) for r in part.groupBy("leaf").applyInArrow(merge, "leaf int, n bigint, total binary").collect()]
