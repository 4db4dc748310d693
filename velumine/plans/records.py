"""Queries over references and hierarchies of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velumine.operators import hierarchy, orphans
from velumine.plans.registry import query
from velumine.session import Workspace
from velumine.sources.tables import load

_BLANK = r"'^[\s\x{0b}\x{85}\p{Z}]+|[\s\x{0b}\x{85}\p{Z}]+$'"


def _key(column: str) -> str:
    return f"nullif(regexp_replace({column}, {_BLANK}, '', 'g'), '')"


_ORPHANS = f"""
WITH n AS (
  SELECT {_key('id')} AS k, min(created_at) AS early, min(coalesce(
    to_timestamp(TRY_CAST(json_extract_string(CASE WHEN json_valid(properties) THEN properties END, '$.removed_at') AS DOUBLE)) AT TIME ZONE 'UTC',
    TRY_CAST(replace(replace(json_extract_string(CASE WHEN json_valid(properties) THEN properties END, '$.removed_at'), 'T', ' '), 'Z', '') AS TIMESTAMP))) AS gone
  FROM nodes GROUP BY 1),
m AS (
  SELECT {_key('id')} AS k, CASE WHEN count(created_at) = count(*) THEN min(created_at) END AS early,
    min(CASE WHEN forgotten = 1 THEN coalesce(forgotten_at, TIMESTAMP '0001-01-01') END) AS gone
  FROM memories GROUP BY 1),
r AS (
  SELECT DISTINCT 'edges' AS t, 'source_id' AS f, {_key('id')} AS id, {_key('source_id')} AS k, created_at AS c FROM edges
  UNION ALL SELECT DISTINCT 'edges', 'target_id', {_key('id')}, {_key('target_id')}, created_at FROM edges
  UNION ALL SELECT DISTINCT 'memory_edges', 'target_id', {_key('id')}, {_key('target_id')}, created_at FROM memory_edges),
j AS (
  SELECT t, f, id, c, n.k AS hit, early, gone FROM r LEFT JOIN n USING (k) WHERE t = 'edges' AND r.k IS NOT NULL
  UNION ALL SELECT t, f, id, c, m.k, early, gone FROM r LEFT JOIN m USING (k) WHERE t = 'memory_edges' AND r.k IS NOT NULL),
o AS (
  SELECT t AS table_name, f AS field, id AS record_id, coalesce(strftime(c, '%Y-%m'), 'unknown') AS period,
    CASE WHEN hit IS NULL THEN 'missing' WHEN gone <= c THEN 'deleted' WHEN early > c THEN 'late' END AS reason FROM j)
"""


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = [load(spark, sf_dir, t) for t in ("edges", "nodes", "memory_edges", "memories")]
    return orphans.table_orphans(*tables, Workspace(spark, "p1"))


@query("p1_found", _ORPHANS + "SELECT * FROM o WHERE reason IS NOT NULL")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir)


@query("p1_report", _ORPHANS + "SELECT table_name, field, period, reason, count(*) AS orphans FROM o WHERE reason IS NOT NULL GROUP BY ALL")
def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).groupBy("table_name", "field", "period", "reason").agg(F.count(F.lit(1)).alias("orphans"))


def _forest(spark: SparkSession, sf_dir: str) -> hierarchy.Forest:
    rows = hierarchy.links(load(spark, sf_dir, "nodes"), "nodes").unionByName(hierarchy.links(load(spark, sf_dir, "chunks"), "chunks"))
    return hierarchy.Forest(rows, Workspace(spark, "p6"))


_TREES = f"""
WITH RECURSIVE l AS (
  SELECT 'nodes' AS t, {_key('id')} AS id, min({_key('parent_id')}) AS p FROM nodes GROUP BY 1, 2
  UNION ALL SELECT 'chunks', {_key('id')}, min({_key('parent_id')}) FROM chunks GROUP BY 1, 2),
n AS (SELECT l.t, l.id, q.id AS p FROM l LEFT JOIN l q ON l.t = q.t AND l.p = q.id),
w AS (
  SELECT t, id, id AS root_id, 0 AS depth, id AS path FROM n WHERE p IS NULL
  UNION ALL SELECT n.t, n.id, w.root_id, w.depth + 1, w.path || '/' || n.id FROM n JOIN w ON n.t = w.t AND n.p = w.id),
c AS (SELECT t, id, p FROM n WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.t = n.t AND w.id = n.id)),
s AS (
  SELECT t, id, p AS spot, 1 AS step FROM c
  UNION ALL SELECT s.t, s.id, c.p, step + 1 FROM s JOIN c ON c.t = s.t AND c.id = s.spot WHERE step < 64),
o AS (SELECT t, id FROM s WHERE spot = id GROUP BY ALL),
r AS (SELECT s.t, s.id, min(spot) AS root_id FROM s JOIN o ON o.t = s.t AND o.id = s.spot GROUP BY ALL)
"""


@query("p6_found", _TREES + "SELECT t AS table_name, id AS item_id, root_id, depth FROM w WHERE depth >= 5 UNION ALL SELECT t, id, root_id, -1 FROM r")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = _forest(spark, sf_dir)
    deep = forest.trees().filter("depth >= 5").select("table_name", "item_id", "root_id", "depth")
    return deep.unionByName(forest.cycles())


@query("p6_trees", _TREES + """
SELECT w.t AS table_name, w.id AS item_id, w.root_id, w.depth, w.path FROM w""")
def p6_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forest(spark, sf_dir).trees().select("table_name", "item_id", "root_id", "depth", "path")


@query("p6_ranges", _TREES + """, v AS (
  SELECT t, id, id AS root_id, 0 AS depth, id AS path, [id] AS chain FROM n WHERE p IS NULL
  UNION ALL SELECT n.t, n.id, v.root_id, v.depth + 1, v.path || '/' || n.id, list_append(v.chain, n.id) FROM n JOIN v ON n.t = v.t AND n.p = v.id),
z AS (SELECT t, id, count(*) AS size FROM (SELECT t, unnest(chain) AS id FROM v) GROUP BY ALL),
q AS (SELECT v.*, size, 2 * row_number() OVER (PARTITION BY t, root_id ORDER BY chain) - depth - 1 AS lft FROM v JOIN z USING (t, id))
SELECT t AS table_name, id AS item_id, root_id, depth, path, lft, lft + 2 * size - 1 AS rgt, size - 1 AS descendants FROM q""")
def p6_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forest(spark, sf_dir).trees()


@query("p6_descendants", _TREES + """, d AS (
  SELECT t, id AS item_id, id AS descendant_id, 0 AS distance FROM w WHERE depth >= 3
  UNION ALL SELECT n.t, d.item_id, n.id, distance + 1 FROM n JOIN d ON n.t = d.t AND n.p = d.descendant_id)
SELECT t AS table_name, item_id, descendant_id, distance FROM d WHERE distance > 0""")
def p6_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = _forest(spark, sf_dir)
    trees = forest.work.keep(forest.trees())
    return hierarchy.descendants(trees, trees.filter("depth >= 3"))


@query("p6_descendants_all", _TREES + """, d AS (
  SELECT t, id AS item_id, id AS descendant_id, 0 AS distance FROM w
  UNION ALL SELECT n.t, d.item_id, n.id, distance + 1 FROM n JOIN d ON n.t = d.t AND n.p = d.descendant_id)
SELECT t AS table_name, item_id, descendant_id, distance FROM d WHERE distance > 0""")
def p6_descendants_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of each record; ``p6_descendants`` has those of records at depth 3 and more only."""
    forest = _forest(spark, sf_dir)
    trees = forest.work.keep(forest.trees())
    return hierarchy.descendants(trees, trees)
