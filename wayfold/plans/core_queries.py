"""Registered queries of the core: data checks on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.orphans import find_orphans, orphan_report
from wayfold.operators.proximity import distinct_points, near_pairs, near_pairs_on_sphere, placed
from wayfold.operators.zones import locate_in_zones
from wayfold.session import table

NODES_RADIUS_M = 8.0
ELEMENTS_RADIUS_M = 30.0


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return near_pairs(distinct_points(table(spark, d, "nodes_df"), "node_id", ["x", "y"]), NODES_RADIUS_M)


def _pairs_on_sphere(spark: SparkSession, d: str) -> DataFrame:
    return near_pairs_on_sphere(distinct_points(table(spark, d, "nodes"), "id", ["lat", "lon"]), ELEMENTS_RADIUS_M)


def _zones(spark: SparkSession, d: str) -> DataFrame:
    points = distinct_points(table(spark, d, "nodes"), "id", ["lat", "lon"])
    return locate_in_zones(points, table(spark, d, "zone_rings"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return (
        _pairs(spark, d)
        .select(F.lit("nodes_df").alias("kind"), "a_id", "b_id")
        .unionByName(_pairs_on_sphere(spark, d).select(F.lit("nodes").alias("kind"), "a_id", "b_id"))
        .unionByName(
            _zones(spark, d).select(F.lit("zone").alias("kind"), F.col("zone_id").alias("a_id"), F.col("id").alias("b_id"))
        )
    )


def p2_zone_counts(spark: SparkSession, d: str) -> DataFrame:
    """Elements per zone."""
    return _zones(spark, d).groupBy("zone_id").agg(F.count(F.lit(1)).alias("elements"))


#: Codes that stand for table and column in the shuffle.
_REFERENCE_SOURCES = [("edges_df", "from"), ("edges_df", "to"), ("initialize_acc_var", "node_idx")]


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    edges, observed = table(spark, d, "edges_df"), table(spark, d, "initialize_acc_var")
    references = edges.select(
        F.col("edge_id").alias("row_id"),
        F.col("loaded_at"),
        F.posexplode(F.array(F.col("from"), F.col("to"))).alias("source", "key"),
    ).unionByName(
        observed.select(
            F.col("obs_id").alias("row_id"), F.col("loaded_at"), F.lit(2).alias("source"), F.col("node_idx").alias("key")
        )
    )
    parents = table(spark, d, "nodes_df").select(
        F.col("node_id").alias("key"), placed(F.col("x"), F.col("y")).alias("placed"), "loaded_at", "deleted_at"
    )
    named = references.select("row_id", "source", F.col("loaded_at").alias("at"), "key", "loaded_at")
    found = find_orphans(named, parents)
    names = F.array(*[F.struct(F.lit(t).alias("tbl"), F.lit(c).alias("ref_col")) for t, c in _REFERENCE_SOURCES])
    return found.withColumn("name", names[F.col("source")]).select(
        F.col("name.tbl").alias("tbl"), "row_id", F.col("name.ref_col").alias("ref_col"), "reason", "at"
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).drop("at").distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, column, month of loading and reason."""
    return orphan_report(_orphans(spark, d), ["tbl", "ref_col"], "month", "at")


QUERIES = {"p2_found": p2_found, "p2_zone_counts": p2_zone_counts, "p3_found": p3_found, "p3_report": p3_report}

_ORPHANS_SQL = """
WITH refs AS (
  SELECT 'edges_df' AS tbl, edge_id AS row_id, 'from' AS ref_col, "from" AS k, loaded_at AS t FROM edges_df
  UNION SELECT 'edges_df', edge_id, 'to', "to", loaded_at FROM edges_df
  UNION SELECT 'initialize_acc_var', obs_id, 'node_idx', node_idx, loaded_at FROM initialize_acc_var
), parents AS (
  SELECT node_id, loaded_at, deleted_at, x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) AS placed
  FROM nodes_df
), judged AS (
  SELECT tbl, row_id, ref_col, t,
         count(p.node_id) AS n,
         count(*) FILTER (p.placed) AS n_placed,
         count(*) FILTER (p.placed AND p.loaded_at <= t) AS n_loaded,
         count(*) FILTER (p.placed AND p.loaded_at <= t AND (p.deleted_at IS NULL OR p.deleted_at > t)) AS n_valid
  FROM refs LEFT JOIN parents p ON p.node_id = refs.k
  WHERE k IS NOT NULL
  GROUP BY tbl, row_id, ref_col, k, t
), orphans AS (
  SELECT DISTINCT tbl, row_id, ref_col, t,
         CASE WHEN n = 0 THEN 'missing' WHEN n_placed = 0 THEN 'unplaced' WHEN n_loaded = 0 THEN 'late' ELSE 'deleted' END AS reason
  FROM judged WHERE n_valid = 0
)
"""

ORACLE_SQL = {
    "p3_found": _ORPHANS_SQL + "SELECT DISTINCT tbl, row_id, ref_col, reason FROM orphans",
    "p3_report": _ORPHANS_SQL
    + """SELECT tbl, ref_col, CAST(date_trunc('month', t) AS DATE) AS period, reason, count(*) AS orphans
FROM orphans GROUP BY ALL""",
}

_POINTS_SQL = """
WITH a AS (SELECT DISTINCT node_id AS id, x, y FROM nodes_df WHERE NOT isnan(x) AND NOT isnan(y)),
e AS (SELECT DISTINCT id, lat, lon FROM nodes WHERE NOT isnan(lat) AND NOT isnan(lon)),
s AS (SELECT id, 6371008.8 * cos(radians(lat)) * cos(radians(lon)) AS u, 6371008.8 * cos(radians(lat)) * sin(radians(lon)) AS v,
             6371008.8 * sin(radians(lat)) AS w FROM e),
ends AS (
  SELECT zone_id, lon AS x1, lat AS y1,
         coalesce(lead(lon) OVER r, first_value(lon) OVER r) AS x2, coalesce(lead(lat) OVER r, first_value(lat) OVER r) AS y2
  FROM zone_rings WINDOW r AS (PARTITION BY zone_id, ring_no ORDER BY vertex_no)
),
boxes AS (SELECT zone_id, min(x1) AS xa, max(x1) AS xb, min(y1) AS ya, max(y1) AS yb FROM ends GROUP BY zone_id),
near AS (SELECT b.zone_id, e.id, e.lon, e.lat FROM boxes b JOIN e ON e.lon BETWEEN xa AND xb AND e.lat BETWEEN ya AND yb),
inside AS (
  SELECT n.zone_id, n.id FROM near n JOIN ends s ON n.zone_id = s.zone_id
  WHERE (s.x1 > n.lon) <> (s.x2 > n.lon) AND n.lat > s.y1 + (s.y2 - s.y1) * (n.lon - s.x1) / (s.x2 - s.x1)
  GROUP BY n.zone_id, n.id HAVING count(*) % 2 = 1
)
"""
ORACLE_SQL |= {
    "p2_found": _POINTS_SQL
    + """
SELECT 'nodes_df' AS kind, p.id AS a_id, q.id AS b_id FROM a p JOIN a q
  ON q.x BETWEEN p.x - 8.0 AND p.x + 8.0 AND p.id < q.id WHERE (p.x - q.x) ** 2 + (p.y - q.y) ** 2 <= 64.0
UNION ALL
SELECT 'nodes', p.id, q.id FROM s p JOIN s q
  ON q.w BETWEEN p.w - 30.0 AND p.w + 30.0 AND p.id < q.id
  WHERE 2 * 6371008.8 * asin(sqrt((p.u - q.u) ** 2 + (p.v - q.v) ** 2 + (p.w - q.w) ** 2) / (2 * 6371008.8)) <= 30.0
UNION ALL
SELECT 'zone', zone_id, id FROM inside""",
    "p2_zone_counts": _POINTS_SQL + "SELECT zone_id, count(*) AS elements FROM inside GROUP BY zone_id",
}
