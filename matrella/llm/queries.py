"""Registered queries of the subpackage, over whole tables and whole texts."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrella.functions.labels import plain_integer
from matrella.llm import clusters, leaks, neighbours, packing, percentiles, repetition, vectors
from matrella.session import table

DIMS = 50


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return vectors.latest_vectors(table(spark, d, "obsm_pca"), "soma_dim_0", "soma_dim_1", "soma_data", "written_at", DIMS)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of cells of which one is among the five most similar of the other."""
    return neighbours.pairs(neighbours.nearest(_vectors(spark, d), DIMS))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Cells in groups of mutually similar vectors, by the smallest cell of the group."""
    return clusters.linked_groups(_vectors(spark, d), DIMS).select("cluster_key", F.col("id").alias("soma_joinid"))


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each Ward cluster's size and most typical cells, next to the labels of these cells in obs."""
    found = clusters.describe(_vectors(spark, d), DIMS)
    obs = table(spark, d, "obs")
    labels = obs.groupBy("soma_joinid").agg(F.max_by(plain_integer(F.col("seurat_clusters")), "loaded_at").alias("label"))
    return found.join(labels, found.id == labels.soma_joinid, "left").select("cluster", "size", "nth", F.col("id").alias("soma_joinid"), "nearness", "label")


def p5_checked(spark: SparkSession, d: str) -> DataFrame:
    """One row on all Ward clusters: vectors in them, clusters with more typical members than asked for, members named twice, and members of no cluster's cone."""
    found = clusters.describe(_vectors(spark, d), DIMS)
    of = found.groupBy("cluster").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("nearness").alias("least"))
    sizes = of.agg(F.sum("size").alias("n_vectors"), F.count_if((F.col("n") > 3) | (F.col("n") > F.col("size"))).alias("too_many"), F.count_if(F.col("least") < 0.5).alias("far")).withColumn("one", F.lit(1))
    twice = found.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("twice")).withColumn("one", F.lit(1))
    return sizes.join(twice, "one").select("n_vectors", "too_many", "twice", "far")


FIELDS = ("ncount_rna", "nfeature_rna", "percent.mt")
P4_KEYS = ("experiment_id", "seurat_clusters", "field_name")
MIN_VALUES = 50


def _measurements(spark: SparkSession, d: str) -> DataFrame:
    """(experiment_id, seurat_clusters, field_name, value) of the latest row of each cell, measured values only."""
    obs = table(spark, d, "obs").where("soma_joinid is not null")
    row = F.struct("loaded_at", "experiment_id", plain_integer(F.col("seurat_clusters")).alias("label"), *[F.col(f"`{f}`").cast("double").alias(f.replace(".", "_")) for f in FIELDS])
    last = obs.groupBy("soma_joinid").agg(F.max(row).alias("r")).select("r.*").where("label is not null and experiment_id is not null")
    stack = ", ".join(f"'{f}', `{f.replace('.', '_')}`" for f in FIELDS)
    long = last.selectExpr("experiment_id", "label as seurat_clusters", f"stack({len(FIELDS)}, {stack}) as (field_name, value)")
    return long.where("value is not null and not isnan(value) and value >= 0")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups whose percentile of a field is at least its limit: by sketches, the doubtful ones by exact counts."""
    values = _measurements(spark, d)
    limits: dict[str, list[tuple[int, float]]] = {}
    for r in table(spark, d, "percentile_limits").where("pct is not null and limit_value is not null").collect():  # 9 rows, fixed
        limits.setdefault(r.field_name, []).append((r.pct, r.limit_value))
    states = percentiles.sketches(values, P4_KEYS, F.col("value"))
    judged = percentiles.against_limits(states, lambda key: limits.get(json.loads(key)["field_name"], ()))
    judged = judged.where(F.col("n") >= MIN_VALUES).withColumn("k", F.from_json("key", "experiment_id bigint, seurat_clusters bigint, field_name string"))
    judged = judged.select("k.*", "n", "pct", "limit_value", "reaches")
    doubt = judged.where("reaches is null").select(*P4_KEYS, "n", "pct", "limit_value")
    counted = values.join(doubt, list(P4_KEYS)).groupBy(*P4_KEYS, "n", "pct").agg(F.count_if(F.col("value") < F.col("limit_value")).alias("less"))
    sure = judged.where("reaches").select(*P4_KEYS, "pct")
    return sure.unionAll(counted.where("less < greatest(1, (pct * n + 99) div 100)").select(*P4_KEYS, "pct"))


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Median, 90th and 99th percentile of each field per experiment and label, with certain bounds of the rank."""
    got = percentiles.percentiles(percentiles.merge(percentiles.sketches(_measurements(spark, d), P4_KEYS, F.col("value"))), (50, 90, 99))
    return got.select(F.from_json("key", "experiment_id bigint, seurat_clusters bigint, field_name string").alias("k"), "n", "pct", "value", "low", "high").select("k.*", "n", "pct", "value", "low", "high")


def p4_checked(spark: SparkSession, d: str) -> DataFrame:
    """Each estimate against exact counts: whether its rank lies within the bounds given, and no farther from the wanted one than 1 % of the values above (one at least)."""
    values = _measurements(spark, d)
    got = p4_percentiles(spark, d)
    estimates = got.withColumnRenamed("value", "estimate")
    counts = values.join(estimates, list(P4_KEYS)).groupBy(*P4_KEYS, "n", "pct", "low", "high").agg(F.count_if(F.col("value") < F.col("estimate")).alias("less"), F.count_if(F.col("value") <= F.col("estimate")).alias("upto"))
    wanted = F.greatest(F.lit(1), F.ceil(F.col("pct") * F.col("n") / 100)).cast("bigint")
    off = F.greatest(F.col("less") + 1 - wanted, wanted - F.col("upto"), F.lit(0))
    bounded = (F.col("low") <= F.col("upto")) & (F.col("high") >= F.col("less") + 1)
    return counts.select(*P4_KEYS, "pct", "n", bounded.alias("bounded"), (off <= F.greatest(F.lit(1.0), 0.01 * (F.col("n") - wanted + 1))).alias("near"))


CAPACITY = 8192


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(packing.sized_items(table(spark, d, "documents")), CAPACITY)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that had to be split over containers."""
    return _placed(spark, d).where("n_pieces > 1").select("doc_id").distinct()


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Containers with what they hold and what room is left."""
    return packing.containers(_placed(spark, d), CAPACITY)


def p7_checked(spark: SparkSession, d: str) -> DataFrame:
    """One row on all containers: texts and tokens placed, texts split, containers too full, texts not placed whole, and whether at most 1 % (and a container) of room is unused."""
    placed = _placed(spark, d)
    of_doc = placed.groupBy("doc_id").agg(F.sum("tokens").alias("placed"), F.count(F.lit(1)).alias("pieces"), F.max("n_pieces").alias("n_pieces"))
    want = table(spark, d, "documents").where("text is not null").select("doc_id", (F.octet_length("text") + 1).cast("bigint").alias("tokens"))
    docs = want.join(of_doc, "doc_id", "full").agg(
        F.count("placed").alias("n_docs"), F.sum("placed").alias("tokens"), F.count_if(F.col("n_pieces") > 1).alias("n_split"),
        F.count_if(~(F.col("placed").eqNullSafe(F.col("tokens")) & (F.col("pieces") == F.col("n_pieces")) & (F.col("pieces") == F.ceil(F.col("tokens") / CAPACITY)))).alias("wrong"),
    )
    boxes = packing.containers(placed, CAPACITY).agg(F.count_if(F.col("unused") < 0).alias("too_full"), F.count(F.lit(1)).alias("n_containers"))
    return docs.withColumn("one", F.lit(1)).join(boxes.withColumn("one", F.lit(1)), "one").select("n_docs", "tokens", "n_split", "wrong", "too_full", (F.col("n_containers") <= 1 + 1.01 * F.col("tokens") / CAPACITY).alias("well_filled"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the items of which they hold a stretch of ten words, up to one edit, and how much of it."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the items of which they hold ten consecutive words unchanged."""
    return p8_leaks(spark, d).where("exact_words >= 10").select("doc_id", "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which at least 0.3 of the words lie in repeated runs of six words: of those that are suspect by their host's verdict, those that fail the rule."""
    suspects = repetition.judged(table(spark, d, "documents")).where("runs_suspect and n_words > 0")
    return suspects.where("runs_fails").select("doc_id").distinct()


def p9_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Failures of each rule per host, with shrunk rates and verdict."""
    got = repetition.host_verdicts(repetition.shares(table(spark, d, "documents")))
    return got.withColumns({f"{rule}_rate": F.round(f"{rule}_rate", 6) for rule in repetition.RULES})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p4_found, p4_percentiles, p4_checked, p5_found, p5_clusters, p5_checked, p7_found, p7_containers, p7_checked, p8_found, p8_leaks, p9_found, p9_hosts)}

_VALUES = r"""
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY soma_joinid ORDER BY loaded_at DESC) AS nth FROM obs WHERE soma_joinid IS NOT NULL) WHERE nth = 1),
labelled AS (SELECT *, CASE WHEN regexp_full_match(trim(seurat_clusters), '[+-]?[0-9]{1,18}(\.0*)?') THEN CAST(regexp_replace(trim(seurat_clusters), '\..*$', '') AS BIGINT) END AS label FROM last),
vals AS (SELECT experiment_id, label AS seurat_clusters, 'ncount_rna' AS field_name, ncount_rna AS v FROM labelled
  UNION ALL SELECT experiment_id, label, 'nfeature_rna', CAST(nfeature_rna AS DOUBLE) FROM labelled
  UNION ALL SELECT experiment_id, label, 'percent.mt', "percent.mt" FROM labelled),
ranked AS (SELECT *, row_number() OVER (PARTITION BY experiment_id, seurat_clusters, field_name ORDER BY v) AS nth, count(*) OVER (PARTITION BY experiment_id, seurat_clusters, field_name) AS n
  FROM vals WHERE seurat_clusters IS NOT NULL AND experiment_id IS NOT NULL AND v IS NOT NULL AND NOT isnan(v) AND v >= 0)
"""

_SIMS = """
last AS (SELECT soma_dim_0 AS id, soma_dim_1 AS j, soma_data AS v FROM (SELECT *, row_number() OVER (PARTITION BY soma_dim_0, soma_dim_1 ORDER BY written_at DESC, soma_data DESC) AS nth
  FROM obsm_pca WHERE soma_dim_0 IS NOT NULL AND soma_dim_1 BETWEEN 0 AND 49) WHERE nth = 1),
vec AS (SELECT id, list(coalesce(CAST(v AS DOUBLE), 0) ORDER BY j) AS x FROM (SELECT DISTINCT id FROM last) CROSS JOIN (SELECT unnest(range(50)) AS j) LEFT JOIN last USING (id, j) GROUP BY id),
sims AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.x, b.x), 6) AS s FROM vec a JOIN vec b ON a.id <> b.id
  WHERE list_dot_product(a.x, a.x) > 0 AND list_dot_product(b.x, b.x) > 0)
"""


def _words(table_name: str, key: str, column: str) -> str:
    """(key, w): the list of words of each text."""
    line = r"regexp_replace(line, '<[^<>]*>|\{[^{}]*\}|\[[^\[\]]*\]|\([^()]*\)', ' ', 'g')"
    return rf"""SELECT {key}, regexp_extract_all(lower(replace(replace(string_agg({line}, chr(10) ORDER BY nth), chr(39), ''), chr(8217), '')), '[\p{{L}}\p{{N}}]+') AS w
FROM (SELECT {key}, unnest(lines) AS line, unnest(range(len(lines))) AS nth FROM (SELECT {key}, string_split(replace({column}, chr(13), ''), chr(10)) AS lines FROM {table_name} WHERE {column} IS NOT NULL))
WHERE NOT contains(line, '-->') AND NOT regexp_full_match(line, '[ \t]*[0-9]+[ \t]*') GROUP BY {key}"""


def _runs(words: str, key: str, n: int) -> str:
    """(key, pos, run): every run of n consecutive words."""
    return f"SELECT {key}, pos, array_to_string(w[pos : pos + {n - 1}], ' ') AS run FROM (SELECT {key}, w, unnest(range(1, len(w) - {n - 2})) AS pos FROM ({words}))"


_HOSTS = f"""WITH w AS ({_words("documents", "doc_id", "text")}), r AS ({_runs("SELECT * FROM w", "doc_id", 6)}),
hit AS (SELECT DISTINCT doc_id, pos + k AS place FROM r JOIN (SELECT doc_id, run FROM r GROUP BY 1, 2 HAVING count(*) > 1) USING (doc_id, run) CROSS JOIN (SELECT unnest(range(6)) AS k)),
runs AS (SELECT doc_id, n / len(w) AS share FROM (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id) JOIN w USING (doc_id)),
kept AS (SELECT doc_id, line, nth FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS nth FROM (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS lines FROM documents WHERE text IS NOT NULL))
  WHERE NOT contains(line, '-->') AND NOT regexp_full_match(line, '[ \\t]*[0-9]+[ \\t]*')),
lines AS (SELECT doc_id, 1 - sum(CASE WHEN first THEN length(s) ELSE 0 END) / sum(length(s)) AS share FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id, s) = 1 AS first
  FROM (SELECT doc_id, trim(line, ' ' || chr(9)) AS s FROM kept) WHERE s <> '') GROUP BY doc_id),
blocks AS (SELECT doc_id, 1 - sum(CASE WHEN first THEN length(s) ELSE 0 END) / sum(length(s)) AS share FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id, s) = 1 AS first
  FROM (SELECT doc_id, trim(unnest(string_split(t, chr(10) || chr(10))), ' ' || chr(9) || chr(10)) AS s FROM (SELECT doc_id, string_agg(line, chr(10) ORDER BY nth) AS t FROM kept GROUP BY doc_id)) WHERE s <> '') GROUP BY doc_id),
fails AS (SELECT source AS host, count(*) AS n_docs, count(*) FILTER (runs.share >= 0.3) AS runs_failed, count(*) FILTER (lines.share >= 0.3) AS lines_failed, count(*) FILTER (blocks.share >= 0.2) AS blocks_failed
  FROM documents d LEFT JOIN runs USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN blocks USING (doc_id) GROUP BY source),
""" + ",\n".join(f"""{x}_m AS (SELECT sum({x}_failed) / sum(n_docs) AS m, var_samp({x}_failed / n_docs) - avg(1.0 / n_docs) * m * (1 - m) AS spread FROM fails),
{x}_p AS (SELECT m, greatest(1, least(coalesce(CASE WHEN spread > 1e-9 THEN m * (1 - m) / spread - 1 END, 1e4), 1e4)) AS s FROM {x}_m)""" for x in repetition.RULES) + """
SELECT *, greatest(runs_rate, lines_rate, blocks_rate) > 0.2 AS host_bad FROM (SELECT host, n_docs, runs_failed, lines_failed, blocks_failed, """ + ", ".join(f"round(({x}_failed + {x}_p.m * {x}_p.s) / (n_docs + {x}_p.s), 6) AS {x}_rate" for x in repetition.RULES) + """
FROM fails, runs_p, lines_p, blocks_p)"""

SQL: dict[str, str] = {
    "p9_hosts": _HOSTS,
    "p2_found": f"""WITH {_SIMS} SELECT DISTINCT least(a, b) AS joinid_a, greatest(a, b) AS joinid_b
FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS nth FROM sims WHERE s >= 0.9) WHERE nth <= 5""",
    "p5_found": f"""WITH RECURSIVE {_SIMS}, edges AS (SELECT a, b FROM sims WHERE s >= 0.9),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT least(a, min(b)) AS cluster_key, a AS soma_joinid FROM reach GROUP BY a""",
    "p8_found": f"""WITH d AS ({_runs(_words("documents", "doc_id", "text"), "doc_id", 10)}), i AS ({_runs(_words("eval_items", "item_id", "passage"), "item_id", 10)})
SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (run)""",
    "p9_found": f"""WITH w AS ({_words("documents", "doc_id", "text")}), r AS ({_runs("SELECT * FROM w", "doc_id", 6)}),
hit AS (SELECT DISTINCT doc_id, pos + k AS place FROM r JOIN (SELECT doc_id, run FROM r GROUP BY 1, 2 HAVING count(*) > 1) USING (doc_id, run) CROSS JOIN (SELECT unnest(range(6)) AS k))
SELECT doc_id FROM (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id) JOIN w USING (doc_id) WHERE n >= 0.3 * len(w)""",
    "p7_found": "SELECT doc_id FROM documents WHERE text IS NOT NULL AND octet_length(encode(text)) + 1 > 8192",
    "p5_checked": """WITH last AS (SELECT soma_dim_0 AS id, soma_data AS v FROM (SELECT *, row_number() OVER (PARTITION BY soma_dim_0, soma_dim_1 ORDER BY written_at DESC, soma_data DESC) AS nth
  FROM obsm_pca WHERE soma_dim_0 IS NOT NULL AND soma_dim_1 BETWEEN 0 AND 49) WHERE nth = 1)
SELECT count(DISTINCT id) AS n_vectors, 0 AS too_many, 0 AS twice, 0 AS far FROM last WHERE v IS NOT NULL AND NOT isnan(v) AND v <> 0""",
    "p7_checked": """SELECT count(*) AS n_docs, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS tokens, count(*) FILTER (octet_length(encode(text)) + 1 > 8192) AS n_split, 0 AS wrong, 0 AS too_full, true AS well_filled
FROM documents WHERE text IS NOT NULL""",
    "p4_checked": f"""WITH {_VALUES} SELECT DISTINCT experiment_id, seurat_clusters, field_name, pct, n, true AS bounded, true AS near FROM ranked CROSS JOIN (SELECT unnest([50, 90, 99]) AS pct)""",
    "p4_found": f"""WITH {_VALUES} SELECT experiment_id, seurat_clusters, r.field_name, pct FROM ranked r JOIN percentile_limits l ON l.field_name = r.field_name
WHERE n >= 50 AND nth = greatest(1, (pct * n + 99) // 100) AND v >= limit_value""",
}
