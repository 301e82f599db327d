"""The engine's own operators over the star tables: orders are the rows (obs), parts the columns (var), line items the matrix (X)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrella.functions.coords import select_coords
from matrella.operators import core
from matrella.operators.assemble import Compressed, over_blocks
from matrella.session import table
from matrella.sources.spots import with_regions
from matrella.spatial.regions import boxes_overlapping, points_in
from matrella.spatial.transforms import AffineTransform, ScaleTransform
from matrella.spatial.wkb import outlines_to_geometry, with_envelope

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
Read = Callable[[str], DataFrame]


def query(sql: str | None = None):
    """Registers a function of a table reader under its name, with its SQL."""

    def add(f: Callable[[Read], DataFrame]) -> Callable[[Read], DataFrame]:
        QUERIES[f.__name__] = lambda spark, d: f(lambda name: table(spark, d, name))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


ORDER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
PART = ["p_partkey", "p_brand", "p_size"]
_O, _P = ", ".join(ORDER), ", ".join(PART)

# --- frames: coordinates -----------------------------------------------------------------------------------------------------------


@query(f"SELECT {_O} FROM orders WHERE o_orderkey BETWEEN 200 AND 400")
def frame_slice_closed(t: Read) -> DataFrame:
    return select_coords(t("orders"), ["o_orderkey"], [slice(200, 400)]).select(*ORDER)


@query(f"SELECT {_O} FROM orders WHERE o_orderkey = 17")
def frame_point(t: Read) -> DataFrame:
    return select_coords(t("orders"), ["o_orderkey"], [17]).select(*ORDER)


@query(f"SELECT {_O} FROM orders WHERE o_orderkey IN (1, 3, 999, 1000000007)")
def frame_points(t: Read) -> DataFrame:
    return select_coords(t("orders"), ["o_orderkey"], [[1, 3, 3, 999, 1_000_000_007]]).select(*ORDER)


@query(f"SELECT {_O} FROM orders WHERE o_orderkey % 7 = 3 AND o_orderkey < 7000")
def frame_points_large(t: Read) -> DataFrame:
    return select_coords(t("orders"), ["o_orderkey"], [list(range(3, 7000, 7))]).select(*ORDER)


@query(f"SELECT {_O} FROM orders WHERE false")
def frame_no_points(t: Read) -> DataFrame:
    return select_coords(t("orders"), ["o_orderkey"], [[]]).select(*ORDER)


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_orderkey BETWEEN 10 AND 900 AND l_partkey IN (1, 2, 3, 4, 5, 6, 7)")
def frame_two_dims(t: Read) -> DataFrame:
    return select_coords(t("lineitem"), ["l_orderkey", "l_partkey"], [slice(10, 900), [1, 2, 3, 4, 5, 6, 7]]).select("l_orderkey", "l_partkey", "l_linenumber")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name >= 'Customer#000000100' AND c_name <= 'Customer#000000200'")
def frame_string_slice(t: Read) -> DataFrame:
    return select_coords(t("customer"), ["c_name"], [slice("Customer#000000100", "Customer#000000200")]).select("c_custkey", "c_name")


@query("SELECT event_id, ts, user_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-09 12:00:00'")
def frame_time_slice(t: Read) -> DataFrame:
    from datetime import datetime

    return select_coords(t("events"), ["ts"], [slice(datetime(2024, 1, 5), datetime(2024, 1, 9, 12))]).select("event_id", "ts", "user_id")


# --- frames: value filters -----------------------------------------------------------------------------------------------------------


def _filter(name: str, table_name: str, columns: list[str], text: str, where: str, syntax: str = "python") -> None:
    def run(t: Read) -> DataFrame:
        return core.read_rows(t(table_name), None, text, syntax).select(*columns)

    run.__name__ = name
    query(f"SELECT {', '.join(columns)} FROM {table_name} WHERE {where}")(run)


_filter("filter_cmp", "part", PART, "p_size >= 30", "p_size >= 30")
_filter("filter_chain", "part", PART, "10 <= p_size < 20", "p_size >= 10 AND p_size < 20")
_filter("filter_reversed", "part", PART, "25 < p_size", "p_size > 25")
_filter("filter_in", "part", PART, "p_brand in ['Brand#11', 'Brand#23', 'none']", "p_brand IN ('Brand#11', 'Brand#23', 'none')")
_filter("filter_not_in", "part", PART, "p_size not in [1, 2, 3, 4, 5]", "p_size NOT IN (1, 2, 3, 4, 5)")
_filter("filter_bool", "part", PART, "(p_size > 40 and p_brand == 'Brand#11') or (p_size < 5) & (p_brand != 'Brand#12')", "(p_size > 40 AND p_brand = 'Brand#11') OR (p_size < 5 AND p_brand <> 'Brand#12')")
_filter("filter_not", "part", PART, "not (p_size > 10 or p_brand == 'Brand#33')", "NOT (p_size > 10 OR p_brand = 'Brand#33')")
_filter("filter_attr_val", "part", PART, "attr('p_size') == val(+7)", "p_size = 7")
_filter("filter_float", "lineitem", ["l_orderkey", "l_partkey", "l_linenumber"], "l_discount > 0.05 and l_quantity <= 10", "l_discount > 0.05 AND l_quantity <= 10")
_filter("filter_null", "documents", ["doc_id"], "lang == None or text == None", "lang IS NULL OR text IS NULL")
_filter("filter_not_null", "obs", ["soma_joinid", "experiment_id"], "seurat_clusters != None and seurat_clusters != '0'", "seurat_clusters IS NOT NULL AND seurat_clusters <> '0'")
_filter("filter_nan", "obs", ["soma_joinid", "loaded_at"], "ncount_rna > 5000", "ncount_rna > 5000 AND NOT isnan(ncount_rna)")
_filter("filter_time", "events", ["event_id"], "ts < 1704844800000000", "ts < TIMESTAMP '2024-01-10 00:00:00'")
_filter("filter_bool_column", "obs", ["soma_joinid", "loaded_at"], "is_primary_data == True and attr('percent.mt') < 4", 'is_primary_data AND "percent.mt" < 4')
_filter("filter_r_syntax", "part", PART, "p_size > 10 && !(p_brand %in% c('Brand#11', 'Brand#12')) || p_size %nin% 1:1".replace("1:1", "c(1, 2, 50)") + " && p_size <= 3L", "(p_size > 10 AND p_brand NOT IN ('Brand#11', 'Brand#12')) OR (p_size NOT IN (1, 2, 50) AND p_size <= 3)", "r")


@query("SELECT p_brand, p_size, p_type FROM part WHERE p_size > 20 AND p_type <> 'x'")
def projection_union(t: Read) -> DataFrame:
    return core.read_rows(t("part"), ["p_brand"], "p_size > 20 and p_type != 'x'")


# --- axis queries --------------------------------------------------------------------------------------------------------------------

OBS = "o_orderstatus == 'F' and o_totalprice > val(100000)"
VAR = "0 < p_size <= 10"
_OBS = "SELECT o_orderkey AS soma_joinid FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000"
_VAR = "SELECT p_partkey AS soma_joinid FROM part WHERE p_size > 0 AND p_size <= 10"
_X = """SELECT l_orderkey AS soma_dim_0, l_partkey AS soma_dim_1, CAST(l_quantity AS BIGINT) AS soma_data FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey
  ORDER BY l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS nth FROM lineitem) WHERE nth = 1"""


def _obs(t: Read) -> DataFrame:
    return core.read_rows(t("orders"), None, OBS).select(F.col("o_orderkey").alias("soma_joinid"))


def _var(t: Read) -> DataFrame:
    return core.read_rows(t("part"), None, VAR).select(F.col("p_partkey").alias("soma_joinid"))


def _x(t: Read, obs: DataFrame | None = None, var: DataFrame | None = None) -> DataFrame:
    """The matrix, of wanted ids only: ids are keys, so other cells go before versions are resolved."""
    raw = t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity")
    raw = core.axis_matrix(raw, obs, var, ("l_orderkey", "l_partkey"))
    newest = [F.desc(c) for c in ("l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity")]
    one = core.latest(raw, ["l_orderkey", "l_partkey"], newest)
    return one.select(F.col("l_orderkey").alias("soma_dim_0"), F.col("l_partkey").alias("soma_dim_1"), F.col("l_quantity").cast("bigint").alias("soma_data"))


@query(f"WITH o AS ({_OBS}), v AS ({_VAR}), x AS ({_X}) SELECT * FROM x WHERE soma_dim_0 IN (SELECT soma_joinid FROM o) AND soma_dim_1 IN (SELECT soma_joinid FROM v)")
def axis_x(t: Read) -> DataFrame:
    return _x(t, _obs(t), _var(t))


@query(f"""WITH o AS ({_OBS}), v AS ({_VAR}), x AS ({_X}), oi AS (SELECT soma_joinid, row_number() OVER (ORDER BY soma_joinid) - 1 AS i FROM o), vi AS (SELECT soma_joinid, row_number() OVER (ORDER BY soma_joinid) - 1 AS j FROM v)
SELECT i, j, soma_data FROM x JOIN oi ON soma_dim_0 = oi.soma_joinid JOIN vi ON soma_dim_1 = vi.soma_joinid""")
def axis_x_reindexed(t: Read) -> DataFrame:
    obs, var = _obs(t), _var(t)
    return core.reindexed(_x(t, obs, var), obs, var).select("i", "j", "soma_data")


@query(f"SELECT (SELECT count(*) FROM ({_OBS})) AS n_obs, (SELECT count(*) FROM ({_VAR})) AS n_vars")
def axis_counts(t: Read) -> DataFrame:
    each = _obs(t).select(F.lit("o").alias("axis")).unionAll(_var(t).select(F.lit("v")))
    return each.agg(F.count_if(F.col("axis") == "o").alias("n_obs"), F.count_if(F.col("axis") == "v").alias("n_vars"))


@query(f"SELECT 'obs' AS axis, soma_joinid FROM ({_OBS}) UNION ALL SELECT 'var', soma_joinid FROM ({_VAR})")
def axis_joinids(t: Read) -> DataFrame:
    return _obs(t).select(F.lit("obs").alias("axis"), "soma_joinid").unionAll(_var(t).select(F.lit("var"), "soma_joinid"))


@query(f"WITH o AS ({_OBS}), oi AS (SELECT soma_joinid, row_number() OVER (ORDER BY soma_joinid) - 1 AS n FROM o) SELECT o_orderkey, coalesce(n, -1) AS ordinal FROM orders LEFT JOIN oi ON o_orderkey = soma_joinid")
def axis_indexer(t: Read) -> DataFrame:
    return core.lookup(t("orders").select("o_orderkey"), "o_orderkey", core.ordinals(_obs(t)))


_PAIRS = """SELECT a.c_custkey AS soma_dim_0, b.c_custkey AS soma_dim_1, a.c_nationkey AS soma_data FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND b.c_custkey = a.c_custkey + 25"""


def _pairs(t: Read) -> DataFrame:
    c = t("customer").select("c_custkey", "c_nationkey")
    b = c.select((F.col("c_custkey") - 25).alias("c_custkey"), F.col("c_custkey").alias("soma_dim_1"), F.col("c_nationkey").alias("other"))
    return c.join(b, "c_custkey").where(F.col("c_nationkey") == F.col("other")).select(F.col("c_custkey").alias("soma_dim_0"), "soma_dim_1", F.col("c_nationkey").alias("soma_data"))


@query(f"WITH p AS ({_PAIRS}), ids AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0) SELECT * FROM p WHERE soma_dim_0 IN (SELECT * FROM ids) AND soma_dim_1 IN (SELECT * FROM ids)")
def axis_pairwise(t: Read) -> DataFrame:
    ids = core.read_rows(t("customer"), None, "c_acctbal > 0").select(F.col("c_custkey").alias("soma_joinid"))
    return core.axis_matrix(_pairs(t), ids, ids)


_EMB = "SELECT vec_id AS soma_dim_0, unnest(range(64)) AS soma_dim_1, unnest(embedding) AS soma_data FROM embeddings"


def _emb(t: Read) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("soma_dim_0"), F.posexplode("embedding").alias("k", "soma_data")).select("soma_dim_0", F.col("k").cast("bigint").alias("soma_dim_1"), "soma_data")


@query(f"SELECT * FROM ({_EMB}) WHERE soma_dim_0 IN (SELECT vec_id FROM embeddings WHERE label IN (1, 2))")
def axis_embedding(t: Read) -> DataFrame:
    ids = core.read_rows(t("embeddings"), None, "label in [1, 2]").select(F.col("vec_id").alias("soma_joinid"))
    return core.semi(_emb(t), "soma_dim_0", ids)


@query(f"WITH o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings WHERE label = 3) SELECT i, soma_dim_1 AS j, CASE WHEN soma_data > 0 THEN soma_data ELSE 0 END AS soma_data FROM ({_EMB}) e JOIN o ON o.vec_id = soma_dim_0")
def embedding_dense(t: Read) -> DataFrame:
    """Positive components only, the rest filled again: rows by ordinal, all 64 columns."""
    ids = core.ordinals(core.read_rows(t("embeddings"), None, "label == 3").select(F.col("vec_id").alias("soma_joinid")), name="i")
    rows = ids.select("i", F.col("soma_joinid").alias("soma_dim_0"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(63).cast("bigint"))).alias("soma_dim_1"))
    kept = _emb(t).where("soma_data > 0")
    return rows.join(kept, ["soma_dim_0", "soma_dim_1"], "left").select("i", F.col("soma_dim_1").alias("j"), F.coalesce("soma_data", F.lit(0).cast("float")).alias("soma_data"))


@query("SELECT DISTINCT scene_id FROM obs_presence WHERE soma_data AND soma_joinid IN (SELECT soma_joinid FROM obs WHERE experiment_id = 1)")
def scene_ids(t: Read) -> DataFrame:
    ids = core.read_rows(t("obs"), None, "experiment_id == 1").select("soma_joinid").distinct()
    return core.semi(t("obs_presence"), "soma_joinid", ids).where("soma_data").select("scene_id").distinct()


# --- counts, domains, assembly ---------------------------------------------------------------------------------------------------------


@query(f"SELECT count(*) AS nnz FROM ({_X})")
def nnz(t: Read) -> DataFrame:
    return _x(t).agg(F.count(F.lit(1)).alias("nnz"))


@query("SELECT min(l_orderkey) AS dim_0_min, max(l_orderkey) AS dim_0_max, min(l_partkey) AS dim_1_min, max(l_partkey) AS dim_1_max FROM lineitem")
def non_empty_domain(t: Read) -> DataFrame:
    return t("lineitem").agg(F.min("l_orderkey").alias("dim_0_min"), F.max("l_orderkey").alias("dim_0_max"), F.min("l_partkey").alias("dim_1_min"), F.max("l_partkey").alias("dim_1_max"))


@query(f"""WITH c AS (SELECT soma_dim_0, count(*) AS nnz FROM ({_X}) GROUP BY 1), r AS (SELECT *, CAST(sum(nnz) OVER (ORDER BY soma_dim_0) AS BIGINT) AS "end" FROM c) SELECT soma_dim_0, nnz, "end" - nnz AS start, "end" FROM r""")
def csr_indptr(t: Read) -> DataFrame:
    return core.row_pointers(_x(t), "soma_dim_0", 4096)


@query(f"WITH x AS ({_X}) SELECT soma_dim_0, soma_dim_1 // 65536 AS piece, CAST(string_agg(soma_dim_1 || ':' || soma_data, ',' ORDER BY soma_dim_1) AS VARCHAR) AS cells FROM x GROUP BY 1, 2")
def csr_rows(t: Read) -> DataFrame:
    rows = core.compressed_rows(_x(t), "soma_dim_0", "soma_dim_1", "soma_data")
    cells = F.zip_with("indices", "data", lambda j, v: F.concat_ws(":", j.cast("string"), v.cast("string")))
    return rows.select("soma_dim_0", "piece", F.array_join(cells, ",").alias("cells"))


@query(f"WITH x AS ({_X}) SELECT soma_dim_1, soma_dim_0 // 65536 AS piece, CAST(string_agg(soma_dim_0 || ':' || soma_data, ',' ORDER BY soma_dim_0) AS VARCHAR) AS cells FROM x GROUP BY 1, 2")
def csc_columns(t: Read) -> DataFrame:
    rows = core.compressed_rows(_x(t), "soma_dim_1", "soma_dim_0", "soma_data")
    cells = F.zip_with("indices", "data", lambda j, v: F.concat_ws(":", j.cast("string"), v.cast("string")))
    return rows.select("soma_dim_1", "piece", F.array_join(cells, ",").alias("cells"))


@query(f"SELECT soma_dim_0 // 1000 AS block, count(*) AS nnz, count(DISTINCT soma_dim_0) AS n_rows, CAST(sum(soma_data) AS BIGINT) AS total FROM ({_X}) GROUP BY 1")
def blockwise_stats(t: Read) -> DataFrame:
    return core.blockwise(_x(t), "soma_dim_0", 1000).groupBy("block").agg(F.count(F.lit(1)).alias("nnz"), F.countDistinct("soma_dim_0").alias("n_rows"), F.sum("soma_data").alias("total"))


@query(f"""WITH x AS ({_X}) SELECT a.i AS soma_dim_0, b.j AS soma_dim_1, coalesce(soma_data, 0) AS soma_data FROM (SELECT unnest(range(100, 151)) AS i) a CROSS JOIN (SELECT unnest(range(0, 41)) AS j) b
LEFT JOIN x ON soma_dim_0 = i AND soma_dim_1 = j""")
def dense_box_fill(t: Read) -> DataFrame:
    return core.dense_box(_x(t), ["soma_dim_0", "soma_dim_1"], [(100, 150), (0, 40)], "soma_data")


@query(f"""WITH x AS ({_X}) SELECT a.i AS soma_dim_0, b.j AS soma_dim_1, CASE WHEN coalesce(soma_data, 0) > 25 THEN soma_data ELSE 0 END AS soma_data FROM (SELECT unnest(range(0, 81)) AS i) a
CROSS JOIN (SELECT unnest(range(0, 61)) AS j) b LEFT JOIN x ON soma_dim_0 = i AND soma_dim_1 = j""")
def dense_filter_fill(t: Read) -> DataFrame:
    return core.filled_where_not(core.dense_box(_x(t), ["soma_dim_0", "soma_dim_1"], [(0, 80), (0, 60)], "soma_data"), "soma_data", "soma_data > 25")


@query(f"SELECT soma_dim_0 // 500 AS block, count(*) AS nnz, max(soma_dim_0 % 500) + 1 AS n_rows, count(DISTINCT soma_dim_1) AS n_columns FROM ({_X}) GROUP BY 1")
def blockwise_compressed(t: Read) -> DataFrame:
    """Each block of 500 rows assembled as a compressed matrix in a task, and what it holds."""
    import numpy as np
    import pyarrow as pa

    def work(block: pa.Table) -> pa.Table:
        i, j, d = (block[n].to_numpy() for n in ("soma_dim_0", "soma_dim_1", "soma_data"))
        first = int(block["block"][0].as_py()) * 500
        m = Compressed.from_ijd(i - first, j, d, (500, int(j.max()) + 1))
        return pa.table({"block": [first // 500], "nnz": [m.nnz], "n_rows": [int(np.flatnonzero(np.diff(m.indptr)).max()) + 1], "n_columns": [len(np.unique(m.indices))]})

    return over_blocks(_x(t), "soma_dim_0", 500, work, "block bigint, nnz bigint, n_rows bigint, n_columns bigint")


# --- versions, deletes, registration ---------------------------------------------------------------------------------------------------


@query(_X)
def upsert_latest(t: Read) -> DataFrame:
    return _x(t)


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00') WHERE nth = 1""")
def time_travel(t: Read) -> DataFrame:
    seen = t("events").where(F.col("ts") <= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return core.latest(seen, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "value")


@query("""SELECT soma_joinid, experiment_id, loaded_at FROM (SELECT o.*, row_number() OVER (PARTITION BY soma_joinid ORDER BY loaded_at DESC) AS nth FROM obs o WHERE soma_joinid IS NOT NULL) o WHERE nth = 1
AND NOT EXISTS (SELECT 1 FROM obs_deletes d WHERE d.soma_joinid = o.soma_joinid AND d.deleted_at >= o.loaded_at)""")
def delete_log(t: Read) -> DataFrame:
    """Latest version of each cell, dropped if a delete follows it: an older version never comes back."""
    last = core.latest(t("obs").where("soma_joinid is not null").select("soma_joinid", "experiment_id", "loaded_at"), ["soma_joinid"], [F.desc("loaded_at"), F.desc("experiment_id")])
    gone = t("obs_deletes").groupBy("soma_joinid").agg(F.max("deleted_at").alias("deleted_at"))
    return last.join(gone, "soma_joinid", "left").where("deleted_at is null or deleted_at < loaded_at").select("soma_joinid", "experiment_id", "loaded_at")


@query(f"SELECT {_O} FROM orders WHERE NOT (o_orderkey BETWEEN 100 AND 5000 AND o_orderstatus = 'O')")
def delete_cells(t: Read) -> DataFrame:
    doomed = core.read_rows(select_coords(t("orders"), ["o_orderkey"], [slice(100, 5000)]), ["o_orderkey"], "o_orderstatus == 'O'")
    return core.anti(t("orders"), "o_orderkey", doomed, "o_orderkey").select(*ORDER)


@query(f"SELECT * FROM ({_X}) WHERE soma_dim_0 NOT IN ({_OBS})")
def obs_axis_delete(t: Read) -> DataFrame:
    return core.anti(_x(t), "soma_dim_0", _obs(t))


@query(f"SELECT * FROM ({_X}) WHERE soma_dim_1 NOT IN ({_VAR})")
def var_axis_delete(t: Read) -> DataFrame:
    return core.anti(_x(t), "soma_dim_1", _var(t))


@query(f"WITH ids AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0) SELECT * FROM ({_PAIRS}) WHERE soma_dim_0 NOT IN (SELECT * FROM ids) AND soma_dim_1 NOT IN (SELECT * FROM ids)")
def pairwise_delete(t: Read) -> DataFrame:
    """A pair goes if either of its ends is deleted."""
    ids = core.read_rows(t("customer"), None, "c_acctbal < 0").select(F.col("c_custkey").alias("soma_joinid"))
    return core.anti(core.anti(_pairs(t), "soma_dim_0", ids), "soma_dim_1", ids)


@query("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 1000)")
def append_anti(t: Read) -> DataFrame:
    known = core.read_rows(t("customer"), ["c_custkey"], "c_acctbal > 1000")
    return core.anti(t("orders").select(F.col("o_custkey").alias("id")), "id", known, "c_custkey").distinct()


@query("""WITH known AS (SELECT c_name AS label, c_custkey AS soma_joinid FROM customer WHERE c_custkey < 1000),
new AS (SELECT n AS label, min({'i': i, 'p': p}) AS seen FROM (SELECT c_name AS n, 0 AS i, c_custkey AS p FROM customer UNION ALL SELECT s_name, 1, s_suppkey FROM supplier) WHERE n NOT IN (SELECT label FROM known) GROUP BY 1)
SELECT label, soma_joinid, false AS is_new FROM known UNION ALL SELECT label, (SELECT max(soma_joinid) FROM known) + row_number() OVER (ORDER BY seen), true FROM new""")
def register_joinids(t: Read) -> DataFrame:
    """New labels follow the largest id in the order in which the inputs first show them."""
    known = t("customer").where("c_custkey < 1000").select(F.col("c_name").alias("label"), F.col("c_custkey").alias("soma_joinid"))
    incoming = t("customer").select(F.col("c_name").alias("label"), F.lit(0).alias("input"), F.col("c_custkey").alias("pos"))
    incoming = incoming.unionAll(t("supplier").select("s_name", F.lit(1), "s_suppkey"))
    return core.number_new(known, incoming, "label", place=["input", "pos"])


@query("""SELECT label, input, min(pos) AS pos FROM (SELECT label, pos, input, min(input) OVER (PARTITION BY label) AS first FROM (
  SELECT p_brand AS label, p_partkey AS pos, 0 AS input FROM part WHERE p_size < 10 UNION ALL SELECT p_brand, p_partkey, 1 FROM part UNION ALL SELECT p_type, p_partkey, 2 FROM part) WHERE label IS NOT NULL) WHERE input = first GROUP BY 1, 2""")
def register_first_seen(t: Read) -> DataFrame:
    p = t("part")
    one = lambda df, c: df.select(F.col(c).alias("label"), F.col("p_partkey").alias("pos"))
    return core.first_seen(one(p.where("p_size < 10"), "p_brand"), one(p, "p_brand"), one(p, "p_type"))


@query("SELECT c_custkey, n_nationkey AS nation, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20")
def region_join(t: Read) -> DataFrame:
    regions = t("nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_nationkey").alias("nation"), "n_name")
    return with_regions(t("customer").select("c_custkey", "c_nationkey"), regions, "c_nationkey").select("c_custkey", "nation", "n_name")


@query("SELECT DISTINCT o_orderpriority AS level FROM orders WHERE o_orderpriority IS NOT NULL")
def enum_levels(t: Read) -> DataFrame:
    return t("orders").select(F.col("o_orderpriority").alias("level")).where("level is not null").distinct()


def _ordered(matrix: DataFrame, order: str) -> DataFrame:
    """The matrix in a result order, with the place of each cell in it, numbered by ranges."""
    dims = ["soma_dim_0", "soma_dim_1"]
    return core.in_order(core.numbered(matrix, dims if order == "row-major" else dims[::-1], "place", 1), dims, order)


@query(f"SELECT *, row_number() OVER (ORDER BY soma_dim_0, soma_dim_1) AS place FROM ({_X})")
def result_order_row_whole(t: Read) -> DataFrame:
    return _ordered(_x(t), "row-major")


@query(f"SELECT *, row_number() OVER (ORDER BY soma_dim_1, soma_dim_0) AS place FROM ({_X})")
def result_order_column_whole(t: Read) -> DataFrame:
    return _ordered(_x(t), "column-major")


# --- spatial ---------------------------------------------------------------------------------------------------------------------------


def _points(t: Read) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("soma_joinid"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label")


_POINTS = "SELECT vec_id AS soma_joinid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label FROM embeddings"


@query(f"SELECT * FROM ({_POINTS}) WHERE x BETWEEN -0.1 AND 0.2 AND y BETWEEN 0 AND 0.5 AND label < 8")
def point_box(t: Read) -> DataFrame:
    return core.read_rows(points_in(_points(t), ["x", "y"], [-0.1, 0.0, 0.2, 0.5]), None, "label < 8")


@query(f"SELECT * FROM ({_POINTS}) WHERE x BETWEEN -0.05 AND 0.05 AND y BETWEEN -0.0625 AND 0.0625")
def point_box_scaled(t: Read) -> DataFrame:
    to_region = ScaleTransform(["x", "y"], ["x", "y"], [2.0, 4.0])
    return points_in(_points(t), ["x", "y"], [-0.1, -0.25, 0.1, 0.25], to_region)


@query(f"SELECT soma_joinid, round(2 * x - y + 1, 9) AS u, round(0.5 * y - 3, 9) AS v FROM ({_POINTS})")
def affine_points(t: Read) -> DataFrame:
    move = AffineTransform(["x", "y"], ["u", "v"], [[2, -1, 1], [0, 0.5, -3], [0, 0, 1]])
    return move.columns(_points(t)).select("soma_joinid", F.round("u", 9).alias("u"), F.round("v", 9).alias("v"))


@query(f"SELECT soma_joinid FROM ({_POINTS}) WHERE x - 0.1 <= 0.3 AND x + 0.1 >= 0.1 AND y - 0.05 <= 0 AND y + 0.05 >= -0.2")
def bbox_overlap(t: Read) -> DataFrame:
    half = {"x__min": F.col("x") - 0.1, "x__max": F.col("x") + 0.1, "y__min": F.col("y") - 0.05, "y__max": F.col("y") + 0.05}
    return boxes_overlapping(_points(t).withColumns(half), ["x", "y"], [0.1, -0.2, 0.3, 0.0]).select("soma_joinid")


_OUTLINE = """SELECT vec_id AS soma_joinid, least(e1, e3, e5) AS x__min, greatest(e1, e3, e5) AS x__max, least(e2, e4, e6) AS y__min, greatest(e2, e4, e6) AS y__max FROM (SELECT vec_id,
  CAST(embedding[1] AS DOUBLE) AS e1, CAST(embedding[2] AS DOUBLE) AS e2, CAST(embedding[3] AS DOUBLE) AS e3, CAST(embedding[4] AS DOUBLE) AS e4, CAST(embedding[5] AS DOUBLE) AS e5, CAST(embedding[6] AS DOUBLE) AS e6 FROM embeddings)"""


@query(f"SELECT * FROM ({_OUTLINE}) WHERE x__min <= 0.2 AND x__max >= 0.1 AND y__min <= 0.2 AND y__max >= 0.1")
def outline_envelopes(t: Read) -> DataFrame:
    """Triangles from outlines to well-known binary and back to their envelopes, those that overlap a box."""
    o = t("embeddings").select(F.col("vec_id").alias("soma_joinid"), F.slice("embedding", 1, 6).cast("array<double>").alias("outline"))
    geometries = outlines_to_geometry(o).select("soma_joinid", "soma_geometry")
    return boxes_overlapping(with_envelope(geometries), ["x", "y"], [0.1, 0.1, 0.2, 0.2]).drop("soma_geometry")
