"""The register of queries, and the SQL for the graph that the driver's tables form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers fn(spark, sf_dir) under a name, with SQL that gives the same rows."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def when(c) -> F.Column:
    """A time as text, which both engines print alike."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


WHEN = "strftime({}, '%Y-%m-%d %H:%M:%S')"

NODES = """nodes AS (
  SELECT 'R-' || r_regionkey AS id, 'Master' AS label, r_name AS name, 'stable' AS stability, TIMESTAMP '1992-01-01' AS valid_from FROM region
  UNION ALL SELECT 'N-' || n_nationkey, 'Spec', n_name, 'stable', TIMESTAMP '1992-01-01' FROM nation
  UNION ALL SELECT 'S-' || s_suppkey, 'Adr', s_name, 'active', TIMESTAMP '1992-01-01' FROM supplier
  UNION ALL SELECT 'C-' || c_custkey, 'Customer', c_name, 'active', TIMESTAMP '1992-01-01' FROM customer
  UNION ALL SELECT 'P-' || p_partkey, 'Part', p_name, 'deprecated', TIMESTAMP '1992-01-01' FROM part
  UNION ALL SELECT 'O-' || o_orderkey, 'Order', o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'stable' WHEN 'O' THEN 'active' ELSE 'draft' END, o_orderdate FROM orders)"""
EDGES = """edges AS (
  SELECT 'EC-' || c_custkey AS id, 'C-' || c_custkey AS src, 'N-' || c_nationkey AS dst, 'LOCATED_IN' AS rel, TIMESTAMP '1992-01-01' AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to FROM customer
  UNION ALL SELECT 'ES-' || s_suppkey, 'S-' || s_suppkey, 'N-' || s_nationkey, 'LOCATED_IN', TIMESTAMP '1992-01-01', NULL FROM supplier
  UNION ALL SELECT 'EN-' || n_nationkey, 'N-' || n_nationkey, 'R-' || n_regionkey, 'PART_OF', TIMESTAMP '1992-01-01', NULL FROM nation
  UNION ALL SELECT 'EO-' || o_orderkey, 'O-' || o_orderkey, 'C-' || o_custkey, 'PLACED_BY', o_orderdate, NULL FROM orders
  UNION ALL SELECT 'EL-' || l_orderkey || '-' || l_linenumber, 'O-' || l_orderkey, 'P-' || l_partkey, 'CONTAINS', l_shipdate, l_shipdate + INTERVAL 365 DAYS FROM lineitem
  UNION ALL SELECT DISTINCT 'EP-' || l_partkey || '-' || l_suppkey, 'P-' || l_partkey, 'S-' || l_suppkey, 'SUPPLIED_BY', TIMESTAMP '1992-01-01', CAST(NULL AS TIMESTAMP) FROM lineitem)"""
GRAPH = f"WITH RECURSIVE {NODES}, {EDGES}"
#: Weight of a tier by label, and of a stability.
TIER = "CASE label WHEN 'Master' THEN 1.0 WHEN 'Spec' THEN 0.8 WHEN 'Adr' THEN 0.6 ELSE 0.3 END"
STABILITY = "CASE stability WHEN 'stable' THEN 1.0 WHEN 'active' THEN 0.8 WHEN 'draft' THEN 0.4 WHEN 'deprecated' THEN 0.1 ELSE 0.8 END"
IMPACTS = f"""deg AS (SELECT dst AS id, count(DISTINCT id) AS n FROM edges GROUP BY dst),
impacts AS (SELECT nodes.id, label, coalesce(n, 0) AS in_degree, CAST(0.5 AS DOUBLE) * least(CAST(1 AS DOUBLE), coalesce(n, 0) / CAST(10 AS DOUBLE)) + CAST(0.3 AS DOUBLE) * CAST({TIER} AS DOUBLE) + CAST(0.2 AS DOUBLE) * CAST({STABILITY} AS DOUBLE) AS impact FROM nodes LEFT JOIN deg USING (id))"""
