"""Queries for references, drift and skew over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrella.functions.labels import plain_integer
from matrella.operators import drift, eager_agg, orphans
from matrella.session import table, written

TARGET = {"obs_id": "string", "ncount_rna": "double", "nfeature_rna": "int", "percent.mt": "double", "seurat_clusters": "bigint", "cell_type": "string", "is_primary_data": "boolean"}


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = orphans.references({
        "x_rna": (table(spark, d, "x_rna"), "soma_dim_0", "written_at"),
        "obsm_pca": (table(spark, d, "obsm_pca"), "soma_dim_0", "written_at"),
        "obs_presence": (table(spark, d, "obs_presence"), "soma_joinid", "written_at"),
    })
    parents = table(spark, d, "obs").select("soma_joinid", F.col("loaded_at").alias("at"))
    deletes = table(spark, d, "obs_deletes").select("soma_joinid", F.col("deleted_at").alias("at"))
    return orphans.orphans(refs, parents, deletes, table(spark, d, "obs_controls"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every orphan reference per table and month, with its reason."""
    return _orphans(spark, d).select("table_name", "period", "soma_joinid", "reason").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Number of orphan keys per table, month and reason."""
    return orphans.orphan_report(_orphans(spark, d)).select("table_name", "period", "reason", "n_keys")


def _rescue_table(spark: SparkSession, d: str) -> DataFrame:
    return written(drift.rescued_lines(table(spark, d, "obs_files"), TARGET))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of fields between successive files of a stream, from the rescue table."""
    return drift.changes_in(_rescue_table(spark, d)).select("file_id", "change_kind", "old_field", "new_field").distinct()


def p3_table(spark: SparkSession, d: str) -> DataFrame:
    """All lines of all files in one consistent obs table, the rest rescued."""
    lines = _rescue_table(spark, d)
    promoted = drift.promotions(drift.changes_in(lines), TARGET)
    out = drift.replay(drift.table_of(lines), TARGET, promoted)
    return out.withColumnRenamed("percent.mt", "percent_mt")


def p3_rescued(spark: SparkSession, d: str) -> DataFrame:
    """All lines in the target schema before any promotion, and how many fields of each are rescued."""
    out = drift.table_of(drift.rescued_lines(table(spark, d, "obs_files"), TARGET)).withColumnRenamed("percent.mt", "percent_mt")
    return out.withColumn("n_rescued", F.coalesce(F.size(F.json_object_keys("_rescued")), F.lit(0)).cast("bigint")).drop("_rescued")


def _cell_states(spark: SparkSession, d: str) -> DataFrame:
    return eager_agg.fact_states(table(spark, d, "x_rna"), F.col("soma_dim_0"), F.col("soma_data"))


def _joined(spark: SparkSession, d: str) -> DataFrame:
    """x_rna and obs reduced to one state per cell (and label), joined by cell."""
    obs = table(spark, d, "obs").select(F.col("soma_joinid").alias("key"), plain_integer(F.col("seurat_clusters")).alias("cluster"))
    groups = obs.groupBy("key", "cluster").agg(F.count(F.lit(1)).alias("n_dim"))
    return eager_agg.join_inputs(_cell_states(spark, d), groups, group="cluster")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Cells with at least 2 % of all rows of x_rna and labels with at least 5 % of all rows of obs, rolled up from the joined states."""
    joined = _joined(spark, d)
    cells = eager_agg.heavy_keys(eager_agg.per_key(joined), 0.02)
    labels = eager_agg.heavy_keys(eager_agg.per_group(joined, "cluster"), 0.05, "cluster")
    out = [x.select(F.lit(n).alias("field_name"), F.col(k).cast("string").alias("key_value")) for n, k, x in (("x_rna.soma_dim_0", "key", cells), ("obs.seurat_clusters", "cluster", labels))]
    return out[0].unionAll(out[1])


def p6_per_cell(spark: SparkSession, d: str) -> DataFrame:
    """Rows, values, sum and mean of x_rna per cell."""
    s = eager_agg.with_mean(_cell_states(spark, d)).where("key is not null")
    return s.select(F.col("key").alias("soma_dim_0"), "n_rows", "n_values", F.round("sum_values", 2).alias("sum_values"), F.round("mean_value", 3).alias("mean_value"))


def p6_per_cluster(spark: SparkSession, d: str) -> DataFrame:
    """x_rna joined to all rows of obs, per cluster label: from joined states, never from joined rows."""
    s = eager_agg.with_mean(eager_agg.per_joined_group(_joined(spark, d), "cluster"))
    return s.select("cluster", "n_rows", "n_values", F.round("sum_values", 1).alias("sum_values"), F.round("mean_value", 3).alias("mean_value"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_report, p3_found, p3_table, p3_rescued, p6_found, p6_per_cell, p6_per_cluster)}

_REFS = """
refs AS (SELECT 'x_rna' AS table_name, soma_dim_0 AS k, written_at AS w FROM x_rna
  UNION ALL SELECT 'obsm_pca', soma_dim_0, written_at FROM obsm_pca
  UNION ALL SELECT 'obs_presence', soma_joinid, written_at FROM obs_presence),
open_refs AS (SELECT table_name, k, w, count(*) AS n FROM refs WHERE k IS NOT NULL AND w IS NOT NULL
  AND k NOT IN (SELECT soma_joinid FROM obs_controls WHERE soma_joinid IS NOT NULL) GROUP BY 1, 2, 3),
loads AS (SELECT DISTINCT soma_joinid AS k, loaded_at AS t FROM obs WHERE soma_joinid IS NOT NULL),
dels AS (SELECT DISTINCT soma_joinid AS k, deleted_at AS t FROM obs_deletes WHERE soma_joinid IS NOT NULL),
judged AS (SELECT table_name, strftime(w, '%Y-%m') AS period, k AS soma_joinid,
  CASE WHEN NOT EXISTS (SELECT 1 FROM loads l WHERE l.k = r.k) THEN 'missing'
    WHEN l_at IS NULL AND d_at IS NULL THEN 'late'
    WHEN d_at IS NOT NULL AND (l_at IS NULL OR d_at > l_at) THEN 'deleted' END AS reason
  FROM (SELECT o.*, (SELECT max(t) FROM loads l WHERE l.k = o.k AND l.t <= o.w) AS l_at,
    (SELECT max(t) FROM dels d WHERE d.k = o.k AND d.t <= o.w) AS d_at FROM open_refs o) r)
"""
_LABEL = r"""CASE WHEN regexp_full_match(trim(seurat_clusters), '[+-]?[0-9]{1,18}(\.0*)?') THEN CAST(regexp_replace(trim(seurat_clusters), '\..*$', '') AS BIGINT) END"""
_CELLS = "SELECT soma_dim_0 AS k, count(*) AS n_rows, count(CASE WHEN NOT isnan(soma_data) THEN 1 END) AS n_values, coalesce(sum(CASE WHEN NOT isnan(soma_data) THEN CAST(soma_data AS DOUBLE) END), 0) AS sum_values FROM x_rna GROUP BY 1"

_NUMBER = r"'[ \t]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t]*'"
_TYPED = {
    "string": "val",
    "int": r"CASE WHEN regexp_full_match(val, '[ \t]*[+-]?[0-9]+(\.0*)?[ \t]*') THEN CAST(TRY_CAST(regexp_extract(val, '[+-]?[0-9]+') AS INTEGER) AS VARCHAR) END",
    "bigint": r"CASE WHEN regexp_full_match(val, '[ \t]*[+-]?[0-9]+(\.0*)?[ \t]*') THEN CAST(TRY_CAST(regexp_extract(val, '[+-]?[0-9]+') AS BIGINT) AS VARCHAR) END",
    "double": f"CASE WHEN regexp_full_match(val, {_NUMBER}) THEN CAST(TRY_CAST(val AS DOUBLE) AS VARCHAR) END",
    "boolean": "CASE WHEN lower(trim(val)) IN ('true', 't', 'yes', 'y', '1') THEN 'true' WHEN lower(trim(val)) IN ('false', 'f', 'no', 'n', '0') THEN 'false' END",
}
_RESCUED = f"""
WITH rows_ AS (SELECT row_number() OVER () AS rid, file_id, line_no, payload FROM obs_files),
lines AS (SELECT * FROM rows_ WHERE payload IS NOT NULL AND json_valid(payload)), objects AS (SELECT * FROM lines WHERE json_type(payload) = 'OBJECT'),
top AS (SELECT rid, e.key AS name, e.value AS v, e.type AS t FROM objects, json_each(payload) e WHERE e.key <> 'soma_joinid'),
flat AS (SELECT rid, name AS field, v, t FROM top WHERE t <> 'OBJECT' UNION ALL SELECT rid, name || '/' || e.key, e.value, e.type FROM top, json_each(v) e WHERE t = 'OBJECT'),
vals AS (SELECT rid, field, lower(string_split(field, '/')[-1]) AS short, json_extract_string(v, '$') AS val FROM flat WHERE t <> 'NULL'),
cast_ AS (SELECT rid, field, short, CASE short {" ".join(f"WHEN '{f}' THEN {_TYPED[k]}" for f, k in TARGET.items())} END AS v FROM vals),
picked AS (SELECT rid, short, arg_min(v, (CASE WHEN field = short THEN 0 ELSE 1 END) || field) AS v FROM cast_ WHERE v IS NOT NULL GROUP BY rid, short),
left_ AS (SELECT c.rid, count(*) AS n FROM cast_ c LEFT JOIN picked p ON p.rid = c.rid AND p.short = c.short WHERE c.v IS NULL OR p.v IS NULL OR c.v <> p.v GROUP BY c.rid)
SELECT o.file_id, o.line_no, CASE WHEN regexp_full_match(json_extract_string(o.payload, '$.soma_joinid'), '-?[0-9]{{1,18}}') THEN CAST(json_extract_string(o.payload, '$.soma_joinid') AS BIGINT) END AS soma_joinid,
{", ".join(f"CAST(max(CASE WHEN short = '{f}' THEN p.v END) AS {k.replace('string', 'varchar')}) AS {f.replace('.', '_')}" for f, k in TARGET.items())}, coalesce(max(n), 0) AS n_rescued
FROM objects o LEFT JOIN picked p ON p.rid = o.rid LEFT JOIN left_ l ON l.rid = o.rid GROUP BY o.rid, o.file_id, o.line_no, o.payload"""

SQL: dict[str, str] = {
    "p3_rescued": _RESCUED,
    "p1_found": f"WITH {_REFS} SELECT DISTINCT table_name, period, soma_joinid, reason FROM judged WHERE reason IS NOT NULL",
    "p1_report": f"WITH {_REFS} SELECT table_name, period, reason, count(DISTINCT soma_joinid) AS n_keys FROM judged WHERE reason IS NOT NULL GROUP BY 1, 2, 3",
    "p3_found": """
WITH lines AS (SELECT stream_id, file_id, payload FROM obs_files WHERE payload IS NOT NULL AND json_valid(payload)),
top AS (SELECT stream_id, file_id, TRY_CAST(json_extract_string(payload, '$.soma_joinid') AS BIGINT) AS k, e.key AS name, e.value AS v, e.type AS t
  FROM lines, json_each(payload) e WHERE json_type(payload) = 'OBJECT' AND e.key <> 'soma_joinid'),
flat AS (SELECT stream_id, file_id, k, name AS field, v, t FROM top WHERE t <> 'OBJECT'
  UNION ALL SELECT stream_id, file_id, k, name || '/' || e.key, e.value, e.type FROM top, json_each(v) e WHERE t = 'OBJECT'),
seq AS (SELECT stream_id, file_id, row_number() OVER (PARTITION BY stream_id ORDER BY exported_at, file_id) AS s
  FROM (SELECT stream_id, file_id, min(exported_at) AS exported_at FROM obs_files GROUP BY 1, 2)),
facts AS (SELECT stream_id, s, file_id, k, field, CASE t WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN 'decimal' WHEN 'BIGINT' THEN 'integer' WHEN 'UBIGINT' THEN 'integer' END AS kind,
    CASE WHEN t <> 'NULL' THEN json_extract_string(v, '$') END AS val
  FROM flat JOIN seq USING (stream_id, file_id)),
seen AS (SELECT stream_id, s, field, last_value(kind IGNORE NULLS) OVER (PARTITION BY stream_id, field ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kind
  FROM (SELECT stream_id, s, field, max(kind) AS kind FROM facts GROUP BY 1, 2, 3)),
both_files AS (SELECT q.stream_id, q.s, q.file_id, f.field, n.field IS NOT NULL AS here, o.field IS NOT NULL AS was, n.kind AS new_kind, o.kind AS old_kind
  FROM seq q JOIN (SELECT DISTINCT stream_id, field FROM seen) f ON f.stream_id = q.stream_id
  LEFT JOIN seen n ON n.stream_id = q.stream_id AND n.s = q.s AND n.field = f.field
  LEFT JOIN seen o ON o.stream_id = q.stream_id AND o.s = q.s - 1 AND o.field = f.field WHERE q.s > 1),
gone AS (SELECT * FROM both_files WHERE was AND NOT here),
fresh AS (SELECT * FROM both_files WHERE here AND NOT was),
moved AS (SELECT g.file_id, g.field AS old_field, n.field AS new_field, g.old_kind, n.new_kind
  FROM gone g JOIN fresh n ON n.stream_id = g.stream_id AND n.s = g.s
  JOIN facts a ON a.stream_id = g.stream_id AND a.s = g.s - 1 AND a.field = g.field AND a.val IS NOT NULL
  JOIN facts b ON b.stream_id = g.stream_id AND b.s = g.s AND b.field = n.field AND b.val IS NOT NULL AND b.k = a.k
  GROUP BY ALL HAVING count(DISTINCT a.k) >= 5 AND bool_and(a.val = b.val))
SELECT file_id, 'renamed' AS change_kind, old_field, new_field FROM moved
UNION SELECT file_id, 'retyped', new_field, new_field FROM moved WHERE old_kind <> new_kind
UNION SELECT file_id, 'retyped', field, field FROM both_files WHERE here AND was AND old_kind <> new_kind
UNION SELECT file_id, 'removed', field, field FROM gone g WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.file_id = g.file_id AND m.old_field = g.field)
UNION SELECT file_id, 'added', field, field FROM fresh n WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.file_id = n.file_id AND m.new_field = n.field)""",
    "p6_found": f"""
SELECT 'x_rna.soma_dim_0' AS field_name, CAST(soma_dim_0 AS VARCHAR) AS key_value FROM x_rna WHERE soma_dim_0 IS NOT NULL
GROUP BY soma_dim_0 HAVING count(*) >= 0.02 * (SELECT count(*) FROM x_rna)
UNION ALL SELECT 'obs.seurat_clusters', CAST(label AS VARCHAR) FROM (SELECT {_LABEL} AS label FROM obs) WHERE label IS NOT NULL
GROUP BY label HAVING count(*) >= 0.05 * (SELECT count(*) FROM obs)""",
    "p6_per_cell": f"SELECT k AS soma_dim_0, n_rows, n_values, round(sum_values, 2) AS sum_values, round(CASE WHEN n_values > 0 THEN sum_values / n_values END, 3) AS mean_value FROM ({_CELLS}) WHERE k IS NOT NULL",
    "p6_per_cluster": f"""
SELECT label AS cluster, count(*) AS n_rows, count(v) AS n_values, round(coalesce(sum(v), 0), 1) AS sum_values, round(avg(v), 3) AS mean_value
FROM (SELECT soma_joinid, {_LABEL} AS label FROM obs) o
JOIN (SELECT soma_dim_0, CASE WHEN NOT isnan(soma_data) THEN CAST(soma_data AS DOUBLE) END AS v FROM x_rna) x ON x.soma_dim_0 = o.soma_joinid
WHERE label IS NOT NULL GROUP BY label""",
}
