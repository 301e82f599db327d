"""Queries that go through stored objects: the star tables are written into objects in several fragments and read, changed and queried there.

An experiment of the whole tables (orders as obs, parts as var, line items as X) is written once a session and folder; queries that change something write objects of
their own.  All lie in the shared checkpoint folder and go with the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame as Frame
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from matrella.api import AxisQuery, BatchSize, Collection, DataFrame, DenseNDArray, Experiment, GeometryDataFrame, IOfN, Measurement, MultiscaleImage, PointCloudDataFrame, Scene, SparseNDArray, X_as_series, exists, open_object
from matrella.errors import MatrellaError
from matrella.functions.filter_lang import combine, in_or_not, triple
from matrella.operators import core
from matrella.plans.matrix import _OBS, _VAR, OBS, VAR
from matrella.session import scratch, table
from matrella.sources import bundles, spots
from matrella.spatial.transforms import AffineTransform, ScaleTransform, transform_from_json
from matrella.streaming.appends import append_stream

QUERIES: dict[str, Callable[[SparkSession, str], Frame]] = {}
SQL: dict[str, str] = {}
_made: dict[tuple[str, str], str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], Frame]) -> Callable[[SparkSession, str], Frame]:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def rows(spark: SparkSession, names: str, values: list[tuple]) -> Frame:
    return spark.createDataFrame(values, names)


OBS_SCHEMA = pa.schema([("soma_joinid", pa.int64()), ("o_custkey", pa.int64()), ("o_orderstatus", pa.dictionary(pa.int32(), pa.string())), ("o_totalprice", pa.float64()), ("o_orderdate", pa.timestamp("us"))])
VAR_SCHEMA = pa.schema([("soma_joinid", pa.int64()), ("p_brand", pa.string()), ("p_size", pa.int32())])
_XS = """SELECT l_orderkey AS soma_dim_0, l_partkey AS soma_dim_1, CAST(l_quantity AS BIGINT) AS soma_data FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey
  ORDER BY l_linenumber > 3 DESC, l_quantity DESC) AS nth FROM lineitem) WHERE nth = 1"""


def _cells(lines: Frame) -> Frame:
    return lines.select(F.col("l_orderkey").alias("soma_dim_0"), F.col("l_partkey").alias("soma_dim_1"), F.col("l_quantity").cast("bigint").alias("soma_data"))


def _top(df: Frame, col: str) -> int:
    return df.agg(F.max(col)).first()[0]


def _build(spark: SparkSession, d: str, uri: str) -> str:
    orders, part, lines = table(spark, d, "orders"), table(spark, d, "part"), table(spark, d, "lineitem")
    n_obs, n_var = _top(orders, "o_orderkey") + 1, _top(part, "p_partkey") + 1
    exp = Experiment.create(uri, spark=spark)
    obs = exp.add_new_dataframe("obs", schema=OBS_SCHEMA, domain=[(0, n_obs - 1)])
    good = orders.select(F.col("o_orderkey").alias("soma_joinid"), *OBS_SCHEMA.names[1:])
    obs.write(good.withColumn("o_totalprice", F.lit(-1.0)))  # superseded by the next fragment
    obs.write(good)
    m = exp.add_new_collection("ms").add_new_collection("RNA", Measurement)
    m.add_new_dataframe("var", schema=VAR_SCHEMA, domain=[(0, n_var - 1)]).write(part.select(F.col("p_partkey").alias("soma_joinid"), "p_brand", "p_size"))
    x = m.add_new_collection("X").add_new_sparse_ndarray("data", type=pa.int64(), shape=(n_obs, n_var))
    x.write(_cells(lines.where("l_linenumber <= 3")))
    x.write(_cells(lines.where("l_linenumber > 3")))
    p = m.add_new_collection("obsp").add_new_sparse_ndarray("next", type=pa.int64(), shape=(n_obs, n_obs))
    p.write(orders.where(F.col("o_orderkey") < n_obs - 1).select(F.col("o_orderkey").alias("soma_dim_0"), (F.col("o_orderkey") + 1).alias("soma_dim_1"), F.col("o_custkey").alias("soma_data")))
    e = m.add_new_collection("obsm").add_new_sparse_ndarray("emb", type=pa.float32(), shape=(n_obs, 64))
    e.write(table(spark, d, "embeddings").select(F.col("vec_id").alias("soma_dim_0"), F.posexplode("embedding").alias("soma_dim_1", "soma_data")))
    v = m.add_new_collection("varm").add_new_sparse_ndarray("size", type=pa.int64(), shape=(n_var, 1))
    v.write(part.select(F.col("p_partkey").alias("soma_dim_0"), F.lit(0).alias("soma_dim_1"), F.col("p_size").alias("soma_data")))
    w = m.add_new_collection("varp").add_new_sparse_ndarray("same", type=pa.int64(), shape=(n_var, n_var))
    w.write(part.select(F.col("p_partkey").alias("soma_dim_0"), F.col("p_partkey").alias("soma_dim_1"), F.col("p_size").alias("soma_data")))
    s = exp.add_new_dataframe("obs_spatial_presence", schema=pa.schema([("scene_id", pa.string()), ("data", pa.bool_())]), index_column_names=["soma_joinid", "scene_id"], domain=[(0, n_obs - 1), ("", "")])
    s.write(orders.select(F.col("o_orderkey").alias("soma_joinid"), F.concat(F.lit("scene"), (F.col("o_custkey") % 3).cast("string")).alias("scene_id"), (F.col("o_orderkey") % 5 != 0).alias("data")))
    exp.metadata["origin"] = "orders and parts"
    return uri


def _experiment(spark: SparkSession, d: str) -> Experiment:
    key = (spark.sparkContext.applicationId, d)
    if key not in _made:
        _made[key] = _build(spark, d, f"{scratch(spark)}/exp")
    return Experiment.open(_made[key], spark=spark)


def _axis(spark: SparkSession, d: str):
    return _experiment(spark, d).axis_query("RNA", obs_query=AxisQuery(OBS), var_query=AxisQuery(VAR))


def _x(spark: SparkSession, d: str) -> SparseNDArray:
    return _experiment(spark, d)["ms"]["RNA"]["X"]["data"]


# --- reads -----------------------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS soma_joinid, o_custkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 200 AND 4000 AND o_totalprice > 50000 AND o_orderstatus IN ('F', 'O')")
def stored_frame_read(spark: SparkSession, d: str) -> Frame:
    """Opened by its place alone; the filter's columns join the projection, old versions stay away."""
    obs = open_object(_experiment(spark, d)["obs"].uri, spark=spark, soma_type="DataFrame")
    return obs.read((slice(200, 4000),), ["soma_joinid", "o_custkey"], value_filter="o_totalprice > 50000 and o_orderstatus in ['F', 'O']").df


@query("SELECT o_orderkey AS soma_joinid, o_totalprice, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND (o_orderstatus <> 'P' OR o_custkey < 50)")
def stored_frame_r_filter(spark: SparkSession, d: str) -> Frame:
    obs = _experiment(spark, d)["obs"]
    return obs.read(value_filter="o_orderdate >= as.Date('1995-01-01') && (o_orderstatus != 'P' || o_custkey < 50L)", syntax="r").df.select("soma_joinid", "o_totalprice", "o_orderdate")


@query("SELECT o_orderkey AS soma_joinid FROM orders WHERE NOT (o_orderstatus IN ('F', 'P') AND o_totalprice >= 1000)")
def stored_frame_tree_filter(spark: SparkSession, d: str) -> Frame:
    """A filter built of calls instead of text."""
    tree = combine(combine(in_or_not("o_orderstatus", ["F", "P"]), triple("o_totalprice", 1000, ">="), "&&"), None, "!")
    return _experiment(spark, d)["obs"].read(column_names=["soma_joinid"], value_filter=tree).df.select("soma_joinid")


@query("SELECT o_orderkey AS soma_joinid, o_custkey FROM orders")
def stored_frame_arrow(spark: SparkSession, d: str) -> Frame:
    """As Arrow tables one after the other, the rest as one."""
    read = _experiment(spark, d)["obs"].read(column_names=["soma_joinid", "o_custkey"])
    return spark.createDataFrame(pa.concat_tables([next(read), read.concat()]))


@query(f"SELECT * FROM ({_XS}) WHERE soma_dim_0 BETWEEN 100 AND 9000 AND soma_dim_1 IN (1, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41)")
def stored_sparse_read(spark: SparkSession, d: str) -> Frame:
    return _x(spark, d).read({"soma_dim_1": pa.array([1, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41]), "soma_dim_0": slice(100, 9000)}).df


@query(f"SELECT *, row_number() OVER (ORDER BY soma_dim_1, soma_dim_0) - 1 AS nth FROM ({_XS})")
def stored_sparse_ordered(spark: SparkSession, d: str) -> Frame:
    """Cells in column-major order, with the place at which each arrives."""
    return core.in_sequence(_x(spark, d).read(result_order="column-major").df, "nth")


@query(f"SELECT * FROM ({_XS})")
def stored_coos(spark: SparkSession, d: str) -> Frame:
    """As tensors, taken apart again in the tasks that make them."""

    def cells(tensor: pa.SparseCOOTensor) -> pa.Table:
        values, at = tensor.to_numpy()
        return pa.table({"soma_dim_0": np.ascontiguousarray(at[:, 0]), "soma_dim_1": np.ascontiguousarray(at[:, 1]), "soma_data": values.reshape(-1)})

    return _x(spark, d).read().coos_over(cells, "soma_dim_0 bigint, soma_dim_1 bigint, soma_data bigint")


@query(f"SELECT * FROM ({_XS})")
def stored_series(spark: SparkSession, d: str) -> Frame:
    """As series by both dimensions, made and taken apart in tasks table by table."""

    def cells(t: pa.Table) -> pa.Table:
        return pa.Table.from_pandas(X_as_series(t).reset_index(), preserve_index=False)

    return _x(spark, d).read().tables().over(cells, "soma_dim_0 bigint, soma_dim_1 bigint, soma_data bigint")


@query(f"SELECT soma_dim_0 // 700 AS block, soma_dim_0 % 700 AS i, soma_dim_1 AS j, soma_data FROM ({_XS})")
def stored_blocks(spark: SparkSession, d: str) -> Frame:
    """Blocks of rows as one lazy frame, rows by place within their block."""
    return _x(spark, d).read().blockwise(0, size=700).frame().withColumnsRenamed({"soma_dim_0": "i", "soma_dim_1": "j"})


@query(f"SELECT soma_dim_0 // 700 AS block, count(*) AS nnz, CAST(sum(soma_data) AS BIGINT) AS total, max(soma_dim_0 % 700) AS last_row, 700 * (soma_dim_0 // 700) AS first_id FROM ({_XS}) GROUP BY soma_dim_0 // 700")
def stored_block_tables(spark: SparkSession, d: str) -> Frame:
    """Blocks handed to the driver one after the other, from one job."""
    got = [(n, t.num_rows, int(np.sum(t["soma_data"].to_numpy())), int(np.max(t["soma_dim_0"].to_numpy())), int(ids[0][0])) for n, (t, ids) in enumerate(_x(spark, d).read().blockwise(0, size=700).tables()) if t.num_rows]
    return rows(spark, "block bigint, nnz bigint, total bigint, last_row bigint, first_id bigint", got)


@query(f"""WITH x AS ({_XS}) SELECT soma_dim_1 // 300 AS block, soma_dim_1 % 300 AS nth, count(*) AS nnz, CAST(string_agg(soma_dim_0 || ':' || soma_data, ',' ORDER BY soma_dim_0) AS VARCHAR) AS cells FROM x GROUP BY 1, 2""")
def stored_block_compressed(spark: SparkSession, d: str) -> Frame:
    """Blocks of columns assembled as compressed matrices in tasks, taken apart again."""
    b = _x(spark, d).read().blockwise(1, size=300).assembled()
    b = b.select("block", "indices", "data", "indptr", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_columns") - 1)).alias("nth"))
    lo, hi = F.element_at("indptr", (F.col("nth") + 1).cast("int")), F.element_at("indptr", (F.col("nth") + 2).cast("int"))
    part = lambda c: F.slice(c, lo.cast("int") + 1, (hi - lo).cast("int"))
    cells = F.zip_with(part("indices"), part("data"), lambda j, v: F.concat_ws(":", j.cast("string"), v.cast("string")))
    return b.select("block", "nth", (hi - lo).alias("nnz"), F.array_join(cells, ",").alias("cells")).where("nnz > 0")


@query(f"SELECT block, count(*) AS nnz, CAST(sum(soma_data) AS BIGINT) AS total FROM (SELECT soma_dim_0 // 1000 AS block, soma_data FROM ({_XS})) GROUP BY 1")
def stored_block_work(spark: SparkSession, d: str) -> Frame:
    """A function run on each block in tasks."""

    def work(block: int, t: pa.Table) -> pa.Table:
        return pa.table({"block": [block], "nnz": [t.num_rows], "total": [int(np.sum(t["soma_data"].to_numpy()))]})

    return _x(spark, d).read().blockwise(0, size=1000).over(work, "block bigint, nnz bigint, total bigint")


@query(f"""SELECT (SELECT count(*) FROM ({_XS})) AS nnz, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber > 3 FROM lineitem)) AS written, max(l_orderkey) AS top_0, max(l_partkey) AS top_1, min(l_orderkey) AS low_0,
(SELECT max(o_orderkey) + 1 FROM orders) AS rows_, (SELECT max(p_partkey) + 1 FROM part) AS columns_ FROM lineitem""")
def stored_counts(spark: SparkSession, d: str) -> Frame:
    """Cells that count, cells as written (from the log alone), where they lie, and the shape."""
    x = _x(spark, d)
    (low, top), (_, top1) = x.non_empty_domain()
    return rows(spark, "nnz bigint, written bigint, top_0 bigint, top_1 bigint, low_0 bigint, rows_ bigint, columns_ bigint", [(x.nnz, x.fragment_cell_count(), top, top1, low, *x.shape)])


def _dense(spark: SparkSession, d: str) -> DenseNDArray:
    e = table(spark, d, "embeddings").orderBy("vec_id").toArrow()
    values = np.array(e["embedding"].to_pylist(), np.float32)
    a = DenseNDArray.create(f"{scratch(spark)}/dense", type=pa.float32(), shape=values.shape, spark=spark)
    a.write((), np.zeros_like(values))
    a.write((slice(0, len(values) - 1), slice(0, 31)), values[:, :32])  # the right half keeps the zeros
    return a.reopen("r")


@query("SELECT vec_id AS i, unnest(range(64)) AS j, unnest(list_concat(embedding[1:32], list_transform(range(32), lambda x: CAST(0 AS FLOAT)))) AS v FROM embeddings")
def stored_dense_read(spark: SparkSession, d: str) -> Frame:
    """The whole array as a tensor."""
    t = _dense(spark, d).read().to_numpy()
    i, j = np.indices(t.shape)
    return spark.createDataFrame(pa.table({"i": i.ravel(), "j": j.ravel(), "v": t.ravel()}))


@query("SELECT vec_id AS soma_dim_0, unnest(range(20, 40)) AS soma_dim_1, unnest(list_concat(embedding[21:32], list_transform(range(8), lambda x: CAST(0 AS FLOAT)))) AS soma_data FROM embeddings WHERE vec_id BETWEEN 3 AND 90")
def stored_dense_box(spark: SparkSession, d: str) -> Frame:
    return _dense(spark, d).read_frame((slice(3, 90), slice(20, 39)))


@query("SELECT vec_id AS j, 8 AS n, round(CAST(embedding[4] AS DOUBLE), 6) AS v FROM embeddings WHERE vec_id < 8")
def stored_dense_column_major(spark: SparkSession, d: str) -> Frame:
    t = _dense(spark, d).read((slice(0, 7), 3), result_order="column-major").to_numpy()
    return rows(spark, "j bigint, n bigint, v double", [(k, t.shape[1], round(float(v), 6)) for k, v in enumerate(t[0])])


# --- axis queries ------------------------------------------------------------------------------------------------------------------------


@query(f"WITH o AS ({_OBS}), v AS ({_VAR}), x AS ({_XS}) SELECT * FROM x WHERE soma_dim_0 IN (SELECT soma_joinid FROM o) AND soma_dim_1 IN (SELECT soma_joinid FROM v)")
def stored_axis_x(spark: SparkSession, d: str) -> Frame:
    return _axis(spark, d).X("data").df


@query(f"WITH o AS ({_OBS}), v AS ({_VAR}), x AS ({_XS}) SELECT * FROM x WHERE soma_dim_0 IN (SELECT soma_joinid FROM o) AND soma_dim_1 IN (SELECT soma_joinid FROM v)")
def stored_axis_parts(spark: SparkSession, d: str) -> Frame:
    """The same by ranges of rows, as many as the layer's density asks for."""
    return _axis(spark, d).X_parts("data")


_PLACES = f"oi AS (SELECT soma_joinid, row_number() OVER (ORDER BY soma_joinid) - 1 AS i FROM ({_OBS})), vi AS (SELECT soma_joinid, row_number() OVER (ORDER BY soma_joinid) - 1 AS j FROM ({_VAR}))"


@query(f"WITH x AS ({_XS}), {_PLACES} SELECT i, j, soma_data FROM x JOIN oi ON soma_dim_0 = oi.soma_joinid JOIN vi ON soma_dim_1 = vi.soma_joinid")
def stored_axis_reindexed(spark: SparkSession, d: str) -> Frame:
    return _axis(spark, d).X_reindexed("data")


@query(f"WITH x AS ({_XS}), {_PLACES} SELECT i, j, soma_data FROM x JOIN oi ON soma_dim_0 = oi.soma_joinid JOIN vi ON soma_dim_1 = vi.soma_joinid")
def stored_bundle_x(spark: SparkSession, d: str) -> Frame:
    """The compressed matrix of the query's bundle, taken apart."""
    i, j, v = _axis(spark, d).to_bundle().X.to_coo()
    return spark.createDataFrame(pa.table({"i": i, "j": j, "soma_data": v}))


@query(f"""WITH x AS ({_XS}) SELECT 'order ' || soma_dim_0 AS row_label, CAST(soma_dim_1 AS BIGINT) AS column_label, soma_data FROM x WHERE soma_dim_0 IN (SELECT soma_joinid FROM ({_OBS})) AND soma_dim_1 IN (SELECT soma_joinid FROM ({_VAR}))""")
def stored_labelled_matrix(spark: SparkSession, d: str) -> Frame:
    m = _axis(spark, d).to_labelled_matrix("X", "data")
    i, j, v = m.matrix.to_coo()
    return spark.createDataFrame(pa.table({"row_label": [f"order {m.rows[k]}" for k in i], "column_label": [m.columns[k] for k in j], "soma_data": v}))


@query(f"SELECT 'obs' AS axis, soma_joinid, o_custkey AS n FROM orders JOIN ({_OBS}) ON soma_joinid = o_orderkey UNION ALL SELECT 'var', soma_joinid, p_size FROM part JOIN ({_VAR}) ON soma_joinid = p_partkey")
def stored_axis_frames(spark: SparkSession, d: str) -> Frame:
    q = _axis(spark, d)
    obs, var = q.obs(["soma_joinid", "o_custkey"]).df.select(F.lit("obs").alias("axis"), "soma_joinid", F.col("o_custkey").alias("n")), q.var(["soma_joinid", "p_size"]).df
    return obs.unionAll(var.select(F.lit("var"), "soma_joinid", F.col("p_size").cast("bigint")))


@query(f"SELECT (SELECT count(*) FROM ({_OBS})) AS n_obs, (SELECT count(*) FROM ({_VAR})) AS n_vars, (SELECT CAST(sum(soma_joinid) AS BIGINT) FROM ({_OBS})) AS obs_sum, (SELECT CAST(sum(soma_joinid) AS BIGINT) FROM ({_VAR})) AS var_sum")
def stored_axis_counts(spark: SparkSession, d: str) -> Frame:
    q = _axis(spark, d)
    sums = [int(np.sum(x.to_numpy())) for x in (q.obs_joinids(), q.var_joinids())]
    return rows(spark, "n_obs bigint, n_vars bigint, obs_sum bigint, var_sum bigint", [(q.n_obs, q.n_vars, *sums)])


@query(f"WITH {_PLACES} SELECT o_orderkey AS id, coalesce(i, -1) AS place FROM orders LEFT JOIN oi ON o_orderkey = soma_joinid")
def stored_axis_indexer(spark: SparkSession, d: str) -> Frame:
    ids = _experiment(spark, d)["obs"].read(column_names=["soma_joinid"]).concat()["soma_joinid"].to_numpy()
    return spark.createDataFrame(pa.table({"id": ids, "place": _axis(spark, d).indexer.by_obs(ids)}))


@query(f"WITH o AS ({_OBS}), v AS ({_VAR}) SELECT 'obsp' AS slot, o_orderkey AS soma_dim_0, o_orderkey + 1 AS soma_dim_1, o_custkey AS soma_data FROM orders WHERE o_orderkey IN (SELECT * FROM o) AND o_orderkey + 1 IN (SELECT * FROM o) UNION ALL SELECT 'varp', p_partkey, p_partkey, p_size FROM part WHERE p_partkey IN (SELECT * FROM v)")
def stored_axis_pairwise(spark: SparkSession, d: str) -> Frame:
    q = _axis(spark, d)
    return q.obsp("next").df.select(F.lit("obsp").alias("slot"), "*").unionAll(q.varp("same").df.select(F.lit("varp"), "*"))


@query(f"WITH o AS ({_OBS}), v AS ({_VAR}) SELECT 'obsm' AS slot, vec_id AS soma_dim_0, unnest(range(64)) AS soma_dim_1, round(CAST(unnest(embedding) AS DOUBLE), 6) AS soma_data FROM embeddings WHERE vec_id IN (SELECT * FROM o) UNION ALL SELECT 'varm', p_partkey, 0, CAST(p_size AS DOUBLE) FROM part WHERE p_partkey IN (SELECT * FROM v)")
def stored_axis_embedding(spark: SparkSession, d: str) -> Frame:
    q = _axis(spark, d)
    value = F.round(F.col("soma_data").cast("double"), 6).alias("soma_data")
    a, b = q.obsm("emb").df, q.varm("size").df
    return a.select(F.lit("obsm").alias("slot"), "soma_dim_0", "soma_dim_1", value).unionAll(b.select(F.lit("varm"), "soma_dim_0", "soma_dim_1", value))


@query(f"SELECT DISTINCT 'scene' || (o_custkey % 3) AS scene_id FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey IN ({_OBS})")
def stored_scene_ids(spark: SparkSession, d: str) -> Frame:
    return rows(spark, "scene_id string", [(s,) for s in _axis(spark, d).obs_scene_ids()])


@query("SELECT * FROM (VALUES ('', 'Experiment'), ('ms', 'Collection'), ('ms/RNA', 'Measurement'), ('ms/RNA/X', 'Collection'), ('ms/RNA/X/data', 'SparseNDArray'), ('ms/RNA/obsm', 'Collection'), ('ms/RNA/obsm/emb', 'SparseNDArray'), ('ms/RNA/obsp', 'Collection'), ('ms/RNA/obsp/next', 'SparseNDArray'), ('ms/RNA/var', 'DataFrame'), ('ms/RNA/varm', 'Collection'), ('ms/RNA/varm/size', 'SparseNDArray'), ('ms/RNA/varp', 'Collection'), ('ms/RNA/varp/same', 'SparseNDArray'), ('obs', 'DataFrame'), ('obs_spatial_presence', 'DataFrame')) AS t(path, kind)")
def stored_members(spark: SparkSession, d: str) -> Frame:
    """Everything in the experiment, each opened by its place and found to be what it is."""
    out: list[tuple] = []

    def walk(c: Collection, path: str) -> None:
        assert exists(c.uri, spark=spark)
        out.append((path, c.kind))
        for k, (uri, kind) in c.members().items():
            m = open_object(uri, spark=spark)
            here = f"{path}/{k}" if path else k
            walk(m, here) if isinstance(m, Collection) else out.append((here, kind))

    walk(_experiment(spark, d), "")
    return rows(spark, "path string, kind string", out)


@query("SELECT 'levels' AS what, CAST(string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS VARCHAR) AS value FROM orders UNION ALL SELECT 'origin', 'orders and parts' UNION ALL SELECT 'obs columns', 'soma_joinid,o_custkey,o_orderstatus,o_totalprice,o_orderdate'")
def stored_levels_metadata(spark: SparkSession, d: str) -> Frame:
    exp = _experiment(spark, d)
    levels = exp["obs"].get_enumeration_values(["o_orderstatus"])["o_orderstatus"]
    return rows(spark, "what string, value string", [("levels", ",".join(sorted(levels))), ("origin", exp.metadata["origin"]), ("obs columns", ",".join(exp["obs"].schema.names))])


# --- versions and deletes ------------------------------------------------------------------------------------------------------------------

EVENT_SCHEMA = pa.schema([("user_id", pa.int64()), ("event_id", pa.int64()), ("value", pa.float64())])


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events by user, in three fragments of one millisecond: thirds of the event ids, one after the other."""
    e = table(spark, d, "events").select(F.col("user_id"), F.col("event_id"), "value")
    n, top = _top(e, "event_id") + 1, _top(e, "user_id")
    f = DataFrame.create(f"{scratch(spark)}/events", schema=EVENT_SCHEMA, index_column_names=["user_id"], domain=[(0, max(top, 99))], spark=spark, timestamp=10)
    for k in range(3):
        part = e.where(F.floor(F.col("event_id") * 3 / n) == k).withColumn("soma_joinid", F.col("event_id"))
        f.reopen("w", 20).write(part)
    return f


# of equal keys in one write the largest rest counts: rest is (soma_joinid, event_id, value), soma_joinid = event_id
_LAST = "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC, value DESC) AS nth FROM events {where}) WHERE nth = 1"


@query(_LAST.format(where=""))
def stored_upsert(spark: SparkSession, d: str) -> Frame:
    """Three writes in one millisecond: the last one wins."""
    return _events(spark, d).reopen("r").read(column_names=["user_id", "event_id", "value"]).df


@query("SELECT 1 AS step, * FROM (" + _LAST.format(where="WHERE event_id * 3 // (SELECT max(event_id) + 1 FROM events) < 1") + ") UNION ALL SELECT 2, * FROM (" + _LAST.format(where="WHERE event_id * 3 // (SELECT max(event_id) + 1 FROM events) < 2") + ") UNION ALL SELECT 3, * FROM (" + _LAST.format(where="") + ")")
def stored_time_travel(spark: SparkSession, d: str) -> Frame:
    """The same table read at three times."""
    e = table(spark, d, "events")
    n, top = _top(e, "event_id") + 1, _top(e, "user_id")
    f = DataFrame.create(f"{scratch(spark)}/travel", schema=EVENT_SCHEMA, index_column_names=["user_id"], domain=[(0, top)], spark=spark, timestamp=1)
    for k in range(3):
        f.reopen("w", 10 * (k + 1)).write(e.where(F.floor(F.col("event_id") * 3 / n) == k).select("user_id", "event_id", "value", F.col("event_id").alias("soma_joinid")))
    out = [DataFrame.open(f.uri, spark=spark, timestamp=t).read().df.select(F.lit(k).alias("step"), "user_id", "event_id", "value") for k, t in ((1, 19), (2, 20), (3, 0))]
    return out[0].unionAll(out[1]).unionAll(out[2])


_KEPT = f"SELECT * FROM ({_LAST.format(where='')}) WHERE NOT (user_id BETWEEN 10 AND 60 AND value > 50) AND user_id NOT IN (3, 70)"


@query(_KEPT)
def stored_delete(spark: SparkSession, d: str) -> Frame:
    """Deleted by coordinates with a filter, and by points; no older version comes back."""
    f = _events(spark, d)
    f.reopen("d", 20).delete_cells((slice(10, 60),), value_filter="value > 50")
    f.reopen("d", 20).delete_cells(([3, 70],))
    return f.reopen("r").read(column_names=["user_id", "event_id", "value"]).df


@query(f"SELECT * FROM ({_KEPT}) WHERE user_id NOT IN (5, 7) UNION ALL SELECT user_id, event_id, value + 1 FROM ({_LAST.format(where='')}) WHERE user_id IN (3, 5)")
def stored_delete_rewrite(spark: SparkSession, d: str) -> Frame:
    """Deletes and writes within one millisecond, in their order, then one more delete; consolidated on the way."""
    f = _events(spark, d)
    again = f.reopen("r").read().df.where("user_id in (3, 5)").withColumn("value", F.col("value") + 1)
    again = spark.createDataFrame(again.toArrow())  # two rows, as they were
    f.reopen("d", 20).delete_cells((slice(10, 60),), value_filter="value > 50")
    f.reopen("d", 20).delete_cells(([3, 5, 70],))
    f.reopen("w", 20).consolidate_and_vacuum()
    f.reopen("w", 20).write(again)
    f.reopen("d", 20).delete_cells(([7],))
    return f.reopen("r").read(column_names=["user_id", "event_id", "value"]).df


@query(f"SELECT 'rows' AS what, count(*) AS n FROM ({_KEPT}) UNION ALL SELECT 'fragments', 1 UNION ALL SELECT 'deletes', 0 UNION ALL SELECT 'written', count(*) FROM ({_KEPT})")
def stored_consolidated(spark: SparkSession, d: str) -> Frame:
    f = _events(spark, d)
    f.reopen("d", 20).delete_cells((slice(10, 60),), value_filter="value > 50")
    f.reopen("d", 20).delete_cells(([3, 70],))
    f.reopen("w").consolidate_and_vacuum()
    f.reopen("r")
    return rows(spark, "what string, n bigint", [("rows", f.count), ("fragments", len(f.state.fragments)), ("deletes", len(f.state.deletes)), ("written", f.fragment_cell_count())])


@query("SELECT l_orderkey AS soma_dim_0, l_partkey AS soma_dim_1, CAST(l_quantity AS BIGINT) AS soma_data FROM lineitem WHERE NOT (l_orderkey BETWEEN 5 AND 50)")
def stored_duplicates(spark: SparkSession, d: str) -> Frame:
    """An array that allows duplicates keeps every cell written, in any number of fragments; a delete takes all of them."""
    lines = table(spark, d, "lineitem")
    a = SparseNDArray.create(f"{scratch(spark)}/many", type=pa.int64(), shape=(_top(lines, "l_orderkey") + 1, _top(lines, "l_partkey") + 1), allows_duplicates=True, spark=spark)
    for part in ("l_linenumber <= 2", "l_linenumber > 2"):
        a.write(_cells(lines.where(part)))
    a.reopen("d").delete_cells((slice(5, 50),))
    return a.reopen("r").read().df


def _copy(spark: SparkSession, d: str) -> str:
    return _build(spark, d, f"{scratch(spark)}/exp")


_GONE = "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000"


@query(f"""SELECT 'obs' AS slot, count(*) AS n FROM orders WHERE o_orderkey NOT IN ({_GONE}) UNION ALL SELECT 'X', count(*) FROM ({_XS}) WHERE soma_dim_0 NOT IN ({_GONE})
UNION ALL SELECT 'obsp', count(*) FROM orders WHERE o_orderkey < (SELECT max(o_orderkey) FROM orders) AND o_orderkey NOT IN ({_GONE}) AND o_orderkey + 1 NOT IN ({_GONE})
UNION ALL SELECT 'obsm', 64 * count(*) FROM embeddings WHERE vec_id NOT IN ({_GONE}) UNION ALL SELECT 'presence', count(*) FROM orders WHERE o_orderkey NOT IN ({_GONE}) UNION ALL SELECT 'var', count(*) FROM part""")
def stored_cascade_obs(spark: SparkSession, d: str) -> Frame:
    """Observations deleted everywhere; a pair goes with either of its ends."""
    uri = _copy(spark, d)
    Experiment.open(uri, "d", spark=spark).obs_axis_delete(value_filter="o_orderstatus == 'F' and o_totalprice > 200000")
    exp = Experiment.open(uri, spark=spark)
    m = exp["ms"]["RNA"]
    return rows(spark, "slot string, n bigint", [("obs", exp["obs"].count), ("X", m["X"]["data"].nnz), ("obsp", m["obsp"]["next"].nnz), ("obsm", m["obsm"]["emb"].nnz), ("presence", exp["obs_spatial_presence"].count), ("var", m["var"].count)])


@query(f"""SELECT 'var' AS slot, count(*) AS n FROM part WHERE p_size > 20 OR p_partkey < 100 UNION ALL SELECT 'X', count(*) FROM ({_XS}) JOIN part ON p_partkey = soma_dim_1 WHERE p_size > 20 OR p_partkey < 100
UNION ALL SELECT 'varm', count(*) FROM part WHERE p_size > 20 OR p_partkey < 100 UNION ALL SELECT 'varp', count(*) FROM part WHERE p_size > 20 OR p_partkey < 100 UNION ALL SELECT 'obs', count(*) FROM orders""")
def stored_cascade_var(spark: SparkSession, d: str) -> Frame:
    uri = _copy(spark, d)
    Experiment.open(uri, "d", spark=spark).var_axis_delete("RNA", (slice(100, None),), value_filter="p_size <= 20")
    exp = Experiment.open(uri, spark=spark)
    m = exp["ms"]["RNA"]
    return rows(spark, "slot string, n bigint", [("var", m["var"].count), ("X", m["X"]["data"].nnz), ("varm", m["varm"]["size"].nnz), ("varp", m["varp"]["same"].nnz), ("obs", exp["obs"].count)])


@query("""SELECT p_partkey AS soma_joinid, p_brand, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS half, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS kind FROM part""")
def stored_schema_change(spark: SparkSession, d: str) -> Frame:
    """Columns dropped and added: an old row lacks the new ones until it is written again."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("soma_joinid"), "p_brand", "p_size")
    f = DataFrame.create(f"{scratch(spark)}/parts", schema=VAR_SCHEMA, domain=[(0, _top(part, "soma_joinid"))], spark=spark)
    f.write(part)
    f.update_schema([pa.field("half", pa.int32()), pa.field("kind", pa.dictionary(pa.int32(), pa.string()))], ["p_size"])
    kind = F.when(F.col("p_size") > 25, "large").otherwise("small")
    f.write(part.where("soma_joinid % 2 = 0").select("soma_joinid", "p_brand", F.col("p_size").alias("half"), kind.alias("kind")))
    f.write(part.where("soma_joinid % 2 = 1").select("soma_joinid", "p_brand", kind.alias("kind")))
    return f.reopen("r").read().df


@query("SELECT p_partkey AS soma_joinid, p_brand, p_size * 2 AS p_size, p_size > 10 AS big FROM part")
def stored_update_var(spark: SparkSession, d: str) -> Frame:
    """An annotation frame replaced from a Spark frame, with a column more."""
    uri = _copy(spark, d)
    part = table(spark, d, "part")
    bundles.update_var(uri, part.select(F.col("p_partkey").alias("soma_joinid"), "p_brand", (F.col("p_size") * 2).cast("int").alias("p_size"), (F.col("p_size") > 10).alias("big")), spark=spark)
    return Experiment.open(uri, spark=spark)["ms"]["RNA"]["var"].read().df


@query("""WITH n AS (SELECT max(o_orderkey) + 1 AS o, (SELECT max(p_partkey) + 1 FROM part) AS p FROM orders) SELECT 'ms/RNA/X/data' AS path, o + 10 AS rows_, p + 5 AS columns_ FROM n UNION ALL SELECT 'ms/RNA/obsp/next', o + 10, o + 10 FROM n
UNION ALL SELECT 'ms/RNA/obsm/emb', o + 10, 64 FROM n UNION ALL SELECT 'ms/RNA/varm/size', p + 5, 1 FROM n UNION ALL SELECT 'ms/RNA/varp/same', p + 5, p + 5 FROM n UNION ALL SELECT 'smaller is refused', 0, 0""")
def stored_resize(spark: SparkSession, d: str) -> Frame:
    uri = _copy(spark, d)
    exp = Experiment.open(uri, spark=spark)
    o, p = exp["ms"]["RNA"]["X"]["data"].shape
    refused = not bundles.resize_experiment(uri, nobs=o - 1, nvars={"RNA": p}, check_only=True, spark=spark)[0]
    bundles.resize_experiment(uri, nobs=o + 10, nvars={"RNA": p + 5}, spark=spark)
    got = [(path, *s["shape"]) for path, s in bundles.experiment_shapes(uri, spark).items() if "shape" in s]
    return rows(spark, "path string, rows_ bigint, columns_ bigint", got + ([("smaller is refused", 0, 0)] if refused else []))


@query(f"SELECT * FROM ({_XS}) WHERE soma_dim_0 >= 1000 UNION ALL SELECT soma_dim_0, soma_dim_1, soma_data * 2 FROM ({_XS}) WHERE soma_dim_0 < 1000")
def stored_update_matrix(spark: SparkSession, d: str) -> Frame:
    """Cells overwritten, the others left; and the result again as a layer of its own."""
    uri = _copy(spark, d)
    m = Experiment.open(uri, "w", spark=spark)["ms"]["RNA"]
    old = Experiment.open(uri, spark=spark)["ms"]["RNA"]["X"]["data"].read().df
    bundles.update_matrix(m["X"]["data"], old.where("soma_dim_0 < 1000").withColumn("soma_data", F.col("soma_data") * 2))
    now = Experiment.open(uri, spark=spark)["ms"]["RNA"]["X"]["data"].read().df
    bundles.add_X_layer(uri, "RNA", "again", now, spark)
    return Experiment.open(uri, spark=spark)["ms"]["RNA"]["X"]["again"].read().df


# --- ingest ------------------------------------------------------------------------------------------------------------------------------


def _source(spark: SparkSession, d: str, nations: str) -> bundles.Source:
    """Customers of some nations by their names, their orders per priority as columns."""
    c = table(spark, d, "customer").where(nations)
    c = core.numbered(c.select("c_custkey", "c_name", "c_acctbal"), "c_custkey", "place")
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority").where("o_orderpriority is not null")
    counts = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("place", "o_orderpriority").agg(F.count(F.lit(1)).cast("double").alias("n"))
    var = core.numbered(counts.select("o_orderpriority").distinct(), "o_orderpriority", "place").withColumnRenamed("o_orderpriority", "var_id")
    x = counts.join(var.withColumnRenamed("place", "j"), F.col("o_orderpriority") == F.col("var_id")).select(F.col("place").alias("i"), "j", "n")
    return bundles.Source(c.select("place", F.col("c_name").alias("obs_id"), "c_acctbal"), var, x)


def _appended(spark: SparkSession, d: str) -> tuple[str, bundles.Registration]:
    uri = f"{scratch(spark)}/appended"
    a, b = _source(spark, d, "c_nationkey % 3 = 1"), _source(spark, d, "c_nationkey % 3 <> 1")
    bundles.write_experiment(uri, a, registration=bundles.register([a], spark=spark), spark=spark)
    reg = bundles.register([b], uri, spark=spark)
    reg.prepare(uri, "RNA", spark=spark)
    bundles.append(uri, b, reg.subset(b, spark), spark=spark)
    return uri, reg


_REG = "SELECT c_name AS obs_id, c_acctbal, c_custkey, row_number() OVER (ORDER BY c_nationkey % 3 <> 1, c_custkey) - 1 AS soma_joinid FROM customer"


@query(f"SELECT soma_joinid, obs_id, c_acctbal FROM ({_REG})")
def stored_append_obs(spark: SparkSession, d: str) -> Frame:
    """Two inputs registered and written one after the other: new ids follow the largest, by first place."""
    return Experiment.open(_appended(spark, d)[0], spark=spark)["obs"].read().df


@query(f"""WITH r AS ({_REG}) SELECT obs_id, o_orderpriority AS var_id, CAST(count(*) AS DOUBLE) AS n FROM orders JOIN r ON o_custkey = c_custkey WHERE o_orderpriority IS NOT NULL GROUP BY 1, 2""")
def stored_append_x(spark: SparkSession, d: str) -> Frame:
    """Cells of both inputs at their joinids, read back by label."""
    exp = Experiment.open(_appended(spark, d)[0], spark=spark)
    m = exp["ms"]["RNA"]
    obs, var = exp["obs"].read().df.select(F.col("soma_joinid").alias("soma_dim_0"), "obs_id"), m["var"].read().df.select(F.col("soma_joinid").alias("soma_dim_1"), "var_id")
    return m["X"]["data"].read().df.join(obs, "soma_dim_0").join(F.broadcast(var), "soma_dim_1").select("obs_id", "var_id", F.col("soma_data").alias("n"))


@query(f"SELECT obs_id AS label, soma_joinid, c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey % 3 = 1) AS is_new FROM ({_REG})")
def stored_registration(spark: SparkSession, d: str) -> Frame:
    return _appended(spark, d)[1].obs


@query("SELECT n_name AS label, n_regionkey AS region, 'the nations' AS title, 3 AS number_, 7.5 AS deep FROM nation")
def stored_uns(spark: SparkSession, d: str) -> Frame:
    """Free-form entries, in and out."""
    n = table(spark, d, "nation").orderBy("n_nationkey").toPandas()
    c = Collection.create(f"{scratch(spark)}/uns", spark=spark)
    bundles.update_uns(c, {"title": "nothing yet", "inner": {"deep": 7.5}, "names": n["n_name"].tolist(), "regions": n["n_regionkey"].to_numpy()})
    bundles.update_uns(c, {"title": "the nations", "number_": 3}, "ignore")
    got = bundles.read_uns(c.reopen("r"))
    return rows(spark, "label string, region bigint, title string, number_ bigint, deep double", [(str(a), int(b), got["title"], got["number_"], got["inner"]["deep"]) for a, b in zip(got["names"], got["regions"])])


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC, value DESC) AS nth FROM events) WHERE nth = 1")
def stored_stream(spark: SparkSession, d: str) -> Frame:
    """A stream of files into a frame, interrupted and taken up again."""
    base = scratch(spark)
    e = table(spark, d, "events").select("user_id", "event_id", "value", F.col("event_id").alias("soma_joinid"))
    n = _top(e, "event_id") + 1
    f = DataFrame.create(f"{base}/streamed", schema=EVENT_SCHEMA, index_column_names=["user_id"], domain=[(0, _top(e, "user_id"))], spark=spark)
    for k in range(3):
        e.where(F.floor(F.col("event_id") * 3 / n) == k).write.mode("append").parquet(f"{base}/files")
        stream = spark.readStream.schema(e.schema).parquet(f"{base}/files")
        append_stream(stream, f, f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return f.reopen("r").read(column_names=["user_id", "event_id", "value"]).df


# --- spatial -----------------------------------------------------------------------------------------------------------------------------


def _cloud(spark: SparkSession, d: str) -> PointCloudDataFrame:
    p = table(spark, d, "embeddings").select(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("vec_id").alias("soma_joinid"), "label")
    c = PointCloudDataFrame.create(f"{scratch(spark)}/points", schema=pa.schema([("x", pa.float64()), ("y", pa.float64()), ("label", pa.int32())]), domain=[(-100, 100), (-100, 100), (0, _top(p, "soma_joinid"))], spark=spark)
    c.write(p)
    return c.reopen("r")


@query("SELECT vec_id AS soma_joinid, label FROM embeddings WHERE CAST(embedding[1] AS DOUBLE) BETWEEN -0.05 AND 0.1 AND CAST(embedding[2] AS DOUBLE) BETWEEN 0 AND 0.25 AND label < 8")
def stored_point_region(spark: SparkSession, d: str) -> Frame:
    """A box in coordinates twice as large, with a filter."""
    return _cloud(spark, d).read_spatial_region([-0.1, 0.0, 0.2, 0.5], ["soma_joinid", "label"], region_transform=ScaleTransform(["x", "y"], ["x", "y"], [2.0, 2.0]), value_filter="label < 8").df


_TRIANGLE = """SELECT vec_id AS soma_joinid, label, least(e1, e3, e5) AS x0, greatest(e1, e3, e5) AS x1, least(e2, e4, e6) AS y0, greatest(e2, e4, e6) AS y1 FROM (SELECT vec_id, label,
  CAST(embedding[1] AS DOUBLE) AS e1, CAST(embedding[2] AS DOUBLE) AS e2, CAST(embedding[3] AS DOUBLE) AS e3, CAST(embedding[4] AS DOUBLE) AS e4, CAST(embedding[5] AS DOUBLE) AS e5, CAST(embedding[6] AS DOUBLE) AS e6 FROM embeddings)"""


@query(f"SELECT soma_joinid, label FROM ({_TRIANGLE}) WHERE x0 <= 0.2 AND x1 >= 0.1 AND y0 <= 0.2 AND y1 >= 0.1 AND label > 2")
def stored_geometry_region(spark: SparkSession, d: str) -> Frame:
    """Triangles whose envelopes overlap a box."""
    g = GeometryDataFrame.create(f"{scratch(spark)}/shapes", schema=pa.schema([("label", pa.int32())]), spark=spark)
    g.from_outlines(table(spark, d, "embeddings").select(F.col("vec_id").alias("soma_joinid"), "label", F.slice("embedding", 1, 6).cast("array<double>").alias("soma_geometry")))
    return g.reopen("r").read_spatial_region([0.1, 0.1, 0.2, 0.2], ["soma_joinid", "label"], value_filter="label > 2").df


@query("SELECT l_orderkey AS y, x, CAST(coalesce(v, 0) AS BIGINT) AS v, 4.0 AS back_x, 2.0 AS back_y FROM (SELECT unnest(range(1, 4)) AS l_orderkey) CROSS JOIN (SELECT unnest(range(2, 6)) AS x) LEFT JOIN (SELECT o_orderkey // 8 AS yy, o_orderkey % 8 AS xx, o_custkey % 200 AS v FROM orders WHERE o_orderkey < 64) ON yy = l_orderkey AND xx = x")
def stored_image_region(spark: SparkSession, d: str) -> Frame:
    """A box of a smaller level, given in the coordinates of the largest."""
    v = table(spark, d, "orders").where("o_orderkey < 64").orderBy("o_orderkey").select(F.col("o_custkey") % 200).toPandas().to_numpy().reshape(1, 8, 8).astype("u1")
    m = MultiscaleImage.create(f"{scratch(spark)}/image", type=pa.uint8(), level_shape=(1, 16, 16), spark=spark)
    m.add_new_level("half", shape=(1, 8, 8)).write((), v)
    t, back = m.reopen("r").read_spatial_region("half", [4, 2, 11.9, 7.9])
    x0, y0 = back.apply([[0, 0]])[0]
    return rows(spark, "y bigint, x bigint, v bigint, back_x double, back_y double", [(1 + i, 2 + j, int(p), float(x0), float(y0)) for i, line in enumerate(t.to_numpy()[0]) for j, p in enumerate(line)])


@query("SELECT vec_id AS soma_joinid, round(4 * CAST(embedding[1] AS DOUBLE) + 1, 6) AS x, round(4 * CAST(embedding[2] AS DOUBLE) - 2, 6) AS y, 1.5 AS radius FROM embeddings WHERE vec_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def stored_scene_export(spark: SparkSession, d: str) -> Frame:
    """Points of a scene as circles in the scene's coordinates, of some observations; transforms go through their stored form."""
    from matrella.api.spatial import scene_export

    s = Scene.create(f"{scratch(spark)}/scene", coordinate_space=["x", "y"], spark=spark)
    s.add_new_collection("obsl").set("points", _cloud(spark, d).reopen("w"))
    down = ScaleTransform(["u", "v"], ["x", "y"], [0.25, 0.25]) @ AffineTransform(["x", "y"], ["u", "v"], [[1, 0, -1], [0, 1, 2], [0, 0, 1]])
    s.set_transform("obsl", "points", transform_from_json(down.to_json()))
    ids = _experiment(spark, d)["obs"].read(column_names=["soma_joinid"], value_filter="o_orderstatus == 'O'").df.select("soma_joinid")
    got = scene_export(Scene.open(s.uri, spark=spark), ids, radius=1.5)["shapes"]["points"]
    return got.select("soma_joinid", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "radius")


@query("SELECT s_suppkey AS soma_joinid, s_suppkey % 2 AS in_tissue, s_acctbal AS x, 's1' AS scene_id FROM supplier WHERE s_suppkey % 3 = 0")
def stored_spots(spark: SparkSession, d: str) -> Frame:
    """Suppliers as observations, positions of a third of them as spots of a scene, with their presence."""
    s = core.numbered(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), "s_suppkey", "place")
    at = s.where("s_suppkey % 3 = 0").select(F.col("s_name").alias("barcode"), (F.col("s_suppkey") % 2).cast("int").alias("in_tissue"), F.lit(0).alias("array_row"), F.lit(0).alias("array_col"), F.lit(1.0).alias("pxl_row_in_fullres"), F.col("s_acctbal").alias("pxl_col_in_fullres"))
    source = bundles.Source(s.select("place", F.col("s_name").alias("obs_id")), table(spark, d, "region").select(F.col("r_regionkey").alias("place"), F.col("r_name").alias("var_id")))
    uri = spots.write_spots(f"{scratch(spark)}/spots", source, at, "s1", radius=3, spark=spark)
    exp = Experiment.open(uri, spark=spark)
    here = exp["obs_spatial_presence"].read().df.where("data").select("soma_joinid", "scene_id")
    keys = s.select(F.col("place").alias("soma_joinid"), "s_suppkey")
    out = exp["spatial"]["s1"]["obsl"]["loc"].read().df.join(here, "soma_joinid").join(keys, "soma_joinid")
    return out.select(F.col("s_suppkey").alias("soma_joinid"), F.col("in_tissue").cast("bigint").alias("in_tissue"), "x", "scene_id")


# --- refusals ------------------------------------------------------------------------------------------------------------------------------


def _refusals(spark: SparkSession, d: str) -> list[tuple[str, Callable[[], object]]]:
    exp = _experiment(spark, d)
    obs, x = exp["obs"], _x(spark, d)
    base = scratch(spark)
    dense = DenseNDArray.create(f"{base}/d", type=pa.int32(), shape=(2, 2), spark=spark)
    frame = DataFrame.create(f"{base}/f", schema=VAR_SCHEMA, domain=[(0, 9)], spark=spark)
    one = pa.table({"soma_joinid": [1], "p_brand": ["b"], "p_size": pa.array([1], pa.int32())})
    return [
        ("batch size", lambda: obs.read(batch_size=BatchSize(count=5))),
        ("part of a read", lambda: obs.read(partitions=IOfN(1, 2))),
        ("blocks as tensors", lambda: x.read().blockwise(0).coos()),
        ("block axis not reindexed", lambda: next(x.read().blockwise(0, reindex_disable_on_axis=0).compressed())),
        ("unknown column in a filter", lambda: obs.read(value_filter="nothing > 1")),
        ("columns compared", lambda: obs.read(value_filter="o_custkey > o_totalprice")),
        ("call in a filter", lambda: obs.read(value_filter="f(o_custkey) > 1")),
        ("text against a number", lambda: obs.read(value_filter="o_custkey == 'a'")),
        ("empty membership", lambda: obs.read(value_filter="o_custkey in []")),
        ("write while reading", lambda: obs.write(one)),
        ("key outside the domain", lambda: frame.write(one.set_column(0, "soma_joinid", pa.array([10])))),
        ("unknown column written", lambda: frame.write(one.append_column("more", pa.array([1])))),
        ("null key", lambda: frame.write(one.set_column(0, "soma_joinid", pa.array([None], pa.int64())))),
        ("dense delete", lambda: dense.reopen("d").delete_cells()),
        ("delete of everything", lambda: frame.reopen("d").delete_cells(())),
        ("delete outside the domain", lambda: frame.reopen("d").delete_cells((slice(20, 30),))),
        ("inverted slice", lambda: obs.read((slice(9, 3),))),
        ("slice with steps", lambda: obs.read((slice(1, 9, 2),))),
        ("negative slice", lambda: obs.read((slice(-4, 9),))),
        ("shrinking domain", lambda: frame.reopen("w").change_domain([(0, 3)])),
        ("key set twice", lambda: Experiment.open(exp.uri, "w", spark=spark).add_new_collection("ms")),
        ("wrong kind of slot", lambda: Experiment.create(f"{base}/e", spark=spark).set("obs", exp["ms"])),
        ("unknown measurement", lambda: exp.axis_query("none")),
        ("unknown layer", lambda: _axis(spark, d).X("none")),
        ("wrong kind opened", lambda: open_object(exp.uri, soma_type="DataFrame", spark=spark)),
        ("nothing there", lambda: open_object(f"{base}/none", spark=spark)),
        ("something there", lambda: DataFrame.create(frame.uri, schema=VAR_SCHEMA, spark=spark)),
        ("reserved name", lambda: DataFrame.create(f"{base}/g", schema=pa.schema([("soma_other", pa.int64())]), spark=spark)),
        ("unsupported type", lambda: DataFrame.create(f"{base}/g", schema=pa.schema([("x", pa.date32())]), spark=spark)),
        ("list as metadata", lambda: frame.reopen("w").metadata.__setitem__("k", [1])),
    ]


_EXPECTED = {
    "batch size": "NotImplementedError", "part of a read": "ValueError", "blocks as tensors": "NotImplementedError", "block axis not reindexed": "ValueError", "unknown column in a filter": "FilterError", "columns compared": "FilterError",
    "call in a filter": "FilterError", "text against a number": "FilterError", "empty membership": "FilterError", "write while reading": "MatrellaError", "key outside the domain": "MatrellaError", "unknown column written": "ValueError", "null key": "ValueError",
    "dense delete": "NotImplementedError", "delete of everything": "ValueError", "delete outside the domain": "IndexError", "inverted slice": "ValueError", "slice with steps": "ValueError", "negative slice": "ValueError", "shrinking domain": "ValueError",
    "key set twice": "MatrellaError", "wrong kind of slot": "TypeError", "unknown measurement": "ValueError", "unknown layer": "KeyError", "wrong kind opened": "TypeError", "nothing there": "DoesNotExistError", "something there": "AlreadyExistsError",
    "reserved name": "ValueError", "unsupported type": "TypeError", "list as metadata": "TypeError",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _EXPECTED.items()) + ") AS t(asked, refused_by)")
def stored_refusals(spark: SparkSession, d: str) -> Frame:
    """What may not be asked, and the error that says so."""
    got = []
    for name, ask in _refusals(spark, d):
        try:
            ask()
            got.append((name, "nothing"))
        except (MatrellaError, ValueError, TypeError, KeyError, IndexError, NotImplementedError) as e:
            got.append((name, type(e).__name__))
    return rows(spark, "asked string, refused_by string", got)
