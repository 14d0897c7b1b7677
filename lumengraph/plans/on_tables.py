"""Sources, writes, filters and version history over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import runtime
from ..functions import scalar
from ..operators import changes, filters, graph, sync
from ..sources import tables
from .base import EDGES, GRAPH, NODES, WHEN, query, when

NOW, THEN = "1998-01-01T00:00:00", "1996-06-01T00:00:00"
VERSIONS = "v AS (SELECT user_id, event_id, value, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events)"


def event_lines(spark, sf_dir):
    """The events as lines of a log: each sets the state of its user."""
    e = tables.table(spark, sf_dir, "events")
    node = F.struct(
        F.concat(F.lit("U-"), F.col("user_id").cast("string")).alias("id"), F.array("event_type").alias("labels"), F.parse_json("props").alias("props"),
        F.struct(F.col("event_id").alias("time"), F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("peer_id")).alias("clock"),
    )
    return e.select(F.col("event_id").alias("position"), F.to_json(F.struct(F.struct(node.alias("Node")).alias("event"))).alias("line"))


LAST = "SELECT 'U-' || user_id AS id, max(event_id) AS time, arg_max(event_type, event_id) AS label, arg_max(CAST(props->>'$.k' AS BIGINT), event_id) AS k FROM events GROUP BY user_id"


REPLAYED = """WITH e AS (SELECT *, event_id % 5 AS f, CASE WHEN event_id % 11 = 0 THEN 'd' ELSE 'n' END AS what FROM events),
n AS (SELECT user_id, max(event_id) AS last FROM e WHERE what = 'n' GROUP BY 1), d AS (SELECT user_id, max(event_id) AS gone FROM e WHERE what = 'd' GROUP BY 1),
kept AS (SELECT n.user_id, last, gone FROM n LEFT JOIN d USING (user_id))
SELECT 'Node' AS kind, 'U-' || k.user_id AS id, last AS time, event_type AS label FROM kept k JOIN events ON event_id = last WHERE gone IS NULL OR gone < last
UNION ALL SELECT 'Edge', 'E-' || e.event_id, e.event_id, e.event_type FROM e JOIN kept k USING (user_id) WHERE f = 2 AND what = 'n' AND (gone IS NULL OR gone < e.event_id)"""


@query("s1_log_replay", REPLAYED)
def log_replay(spark, sf_dir):
    """A log of several appends of unlike size: every event sets its user, every fifth in a batch with an edge, every eleventh is the user's tombstone."""
    path = f"{runtime.shared_folder(spark)}/log-{uuid.uuid4()}"
    e = tables.table(spark, sf_dir, "events")
    user, clock = F.concat(F.lit("U-"), F.col("user_id").cast("string")), F.struct(F.col("event_id").alias("time"), F.lit("p").alias("peer_id"))
    node = F.struct(F.struct(user.alias("id"), F.array("event_type").alias("labels"), F.parse_json("props").alias("props"), clock.alias("clock")).alias("Node"))
    edge = F.struct(F.struct(F.concat(F.lit("E-"), F.col("event_id").cast("string")).alias("id"), user.alias("from"), F.concat(F.lit("T-"), F.col("event_type")).alias("to"), F.col("event_type").alias("rel"), clock.alias("clock")).alias("Edge"))
    both = F.struct(F.array(F.to_variant_object(node), F.to_variant_object(edge)).alias("Batch"))
    line = F.when(F.col("event_id") % 11 == 0, F.to_json(F.struct(F.struct(user.alias("id")).alias("Delete")))).when(F.col("event_id") % 5 == 2, F.concat(F.lit('{"event":'), F.to_json(both), F.lit("}"))).otherwise(F.to_json(node))
    ends, at = [0, *(e.agg((F.max("event_id") * F.lit(x)).cast("bigint")).first()[0] for x in (0.05, 0.1, 0.8)), 1 << 60], "event_id"
    for a, b in zip(ends, ends[1:]):
        tables.append_log(e.where((F.col(at) >= a) & (F.col(at) < b)).select(at, line.alias("line")), path, at)
    r = tables.replay(tables.read_log(spark, path))
    return r.select("kind", "id", "time", F.coalesce(F.get_json_object("payload", "$.labels[0]"), F.get_json_object("payload", "$.rel")).alias("label"))


@query("s2_snapshot", f"{GRAPH} SELECT 'node' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'edge', rel, count(*) FROM edges GROUP BY rel")
def snapshot(spark, sf_dir):
    path = f"{runtime.shared_folder(spark)}/snapshot-{uuid.uuid4()}"
    tables.save_snapshot({"nodes": tables.business_nodes(spark, sf_dir), "edges": tables.business_edges(spark, sf_dir)}, path)
    t = tables.load_snapshot(spark, path)
    nodes = t["nodes"].groupBy(F.element_at("labels", 1).alias("name")).count().select(F.lit("node").alias("kind"), "name", F.col("count").alias("n"))
    return nodes.union(t["edges"].groupBy("rel").count().select(F.lit("edge"), "rel", "count"))


@query("s3_node_scan", f"WITH {NODES} SELECT id, label, name, stability FROM nodes")
def node_scan(spark, sf_dir):
    return tables.business_nodes(spark, sf_dir).select("id", F.element_at("labels", 1).alias("label"), scalar.json_field(F.col("props"), "name").alias("name"), scalar.json_field(F.col("props"), "stability").alias("stability"))


@query("s4_edge_scan", f"WITH {EDGES} SELECT id, src, dst, rel, {WHEN.format('valid_from')} AS valid_from FROM edges")
def edge_scan(spark, sf_dir):
    return tables.business_edges(spark, sf_dir).select("id", "src", "dst", "rel", when("valid_from").alias("valid_from"))


@query("s5_id_lookup", f"WITH {NODES} SELECT id, label, name FROM nodes WHERE id = 'C-42'")
def id_lookup(spark, sf_dir):
    """One table is read, and the key reaches its scan."""
    return tables.business_node(spark, sf_dir, "C-42").select("id", F.element_at("labels", 1).alias("label"), scalar.json_field(F.col("props"), "name").alias("name"))


@query("s6_adjacency", f"WITH {EDGES} SELECT id, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM (SELECT src AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY id")
def adjacency(spark, sf_dir):
    return graph.adjacency(tables.business_edges(spark, sf_dir))


LINE = "CAST(event_id AS VARCHAR) || ':' || event_type || ':' || props"


def lines(spark, sf_dir):
    return tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("position"), F.concat_ws(":", F.col("event_id").cast("string"), "event_type", "props").alias("line"))


@query("s11_log_digest", f"SELECT sha256(string_agg({LINE}, '' ORDER BY event_id)) AS digest FROM events")
def log_digest(spark, sf_dir):
    return sync.digest(lines(spark, sf_dir))


@query("s11_block_digests", f"SELECT event_id // 10000 AS block, sha256(string_agg({LINE}, '' ORDER BY event_id)) AS digest FROM events GROUP BY 1")
def block_digests(spark, sf_dir):
    return sync.digests(lines(spark, sf_dir))


@query("m4_batch_guard", f"WITH {NODES} SELECT label AS batch, NOT bool_or(label = 'Master') AS accepted, count(*) AS n FROM nodes GROUP BY label")
def batch_guard(spark, sf_dir):
    n = tables.business_nodes(spark, sf_dir).withColumn("batch", F.element_at("labels", 1))
    return filters.batches_accepted(n, "batch")


@query("m5_supersede", f"""WITH {NODES}, hit AS (SELECT 'C-' || c_custkey AS id FROM customer WHERE c_acctbal < 0)
SELECT id, name, {WHEN.format('valid_from')} AS valid_from, CASE WHEN id IN (FROM hit) THEN '1998-01-01 00:00:00' END AS valid_to FROM nodes
UNION ALL SELECT id, 'overdrawn', '1998-01-01 00:00:00', NULL FROM hit""")
def supersede(spark, sf_dir):
    n = tables.business_nodes(spark, sf_dir)
    ids = tables.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.concat(F.lit("C-"), F.col("c_custkey").cast("string")).alias("hit"))
    new = n.join(ids, F.col("id") == F.col("hit"), "left_semi").withColumn("props", F.lit('{"name":"overdrawn"}'))
    return changes.supersede(n, new, NOW).select("id", scalar.json_field(F.col("props"), "name").alias("name"), when("valid_from").alias("valid_from"), when("valid_to").alias("valid_to"))


@query("m2_supersede_edges", f"""WITH {EDGES}, new AS (SELECT 'X-' || s_suppkey AS id, 'S-' || s_suppkey AS src, 'N-' || s_nationkey AS dst, 'LOCATED_IN' AS rel FROM supplier WHERE s_acctbal > 5000)
SELECT e.id, e.src, e.dst, n.id AS superseded_by, CASE WHEN n.id IS NOT NULL THEN '1998-01-01 00:00:00' ELSE {WHEN.format('e.valid_to')} END AS valid_to FROM edges e LEFT JOIN new n ON e.src = n.src AND e.dst = n.dst AND e.rel = n.rel AND e.valid_to IS NULL
UNION ALL SELECT id, src, dst, NULL, NULL FROM new""")
def supersede_edges(spark, sf_dir):
    e = tables.business_edges(spark, sf_dir).withColumn("superseded_by", F.lit(None).cast("string"))
    s = tables.table(spark, sf_dir, "supplier").where("s_acctbal > 5000")
    new = s.select(F.concat(F.lit("X-"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("S-"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("N-"), F.col("s_nationkey").cast("string")).alias("dst"), F.lit("LOCATED_IN").alias("rel"), filters.moment(NOW).alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit(None).cast("string").alias("superseded_by"))
    return changes.supersede_edges(e, new, NOW).select("id", "src", "dst", "superseded_by", when("valid_to").alias("valid_to"))


GONE = "gone AS (SELECT 'S-' || s_suppkey AS id FROM supplier WHERE s_acctbal < 0)"


def overdrawn(spark, sf_dir):
    return tables.table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("S-"), F.col("s_suppkey").cast("string")).alias("id"))


@query("m6_retract_nodes", f"WITH {NODES}, {EDGES}, {GONE} SELECT 'node' AS kind, id FROM nodes WHERE id NOT IN (FROM gone) UNION ALL SELECT 'edge', id FROM edges WHERE src NOT IN (FROM gone) AND dst NOT IN (FROM gone)")
def retract_nodes(spark, sf_dir):
    n, e = changes.retract_nodes(tables.business_nodes(spark, sf_dir), tables.business_edges(spark, sf_dir), overdrawn(spark, sf_dir))
    return n.select(F.lit("node").alias("kind"), "id").union(e.select(F.lit("edge"), "id"))


@query("m7_retract_edges", f"WITH {EDGES} SELECT id, rel, CASE WHEN rel = 'SUPPLIED_BY' THEN '1998-01-01 00:00:00' ELSE {WHEN.format('valid_to')} END AS valid_to FROM edges")
def retract_edges(spark, sf_dir):
    e = tables.business_edges(spark, sf_dir)
    return changes.close(e, e.where("rel = 'SUPPLIED_BY'"), NOW).select("id", "rel", when("valid_to").alias("valid_to"))


@query("m11_compact", f"WITH {NODES}, {EDGES} SELECT 'edge' AS kind, id FROM edges WHERE valid_to IS NULL UNION ALL SELECT 'node', id FROM nodes WHERE label <> 'Order' OR TIMESTAMP '1998-01-01' <= valid_from + INTERVAL 900 DAYS")
def compact(spark, sf_dir):
    """Orders expire after 900 days."""
    nodes, edges = changes.compact(expiring(spark, sf_dir), tables.business_edges(spark, sf_dir), NOW)
    return edges.select(F.lit("edge").alias("kind"), "id").union(nodes.select(F.lit("node"), "id"))


@query("m12_vector_compaction", "SELECT vec_id AS node_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def vector_compaction(spark, sf_dir):
    live = tables.table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return changes.compact_vectors(tables.vectors(spark, sf_dir), live).select("node_id")


@query("f1_edge_query", f"WITH {EDGES} SELECT id, src, dst, rel FROM edges WHERE dst = 'N-7' AND rel = 'LOCATED_IN' AND valid_to IS NULL")
def edge_query(spark, sf_dir):
    return filters.edge_query(tables.business_edges(spark, sf_dir), dst="N-7", rel="LOCATED_IN").select("id", "src", "dst", "rel")


@query("f2_as_of", f"WITH {EDGES} SELECT id, rel, {WHEN.format('valid_from')} AS valid_from FROM edges WHERE valid_from <= TIMESTAMP '1996-06-01' AND (valid_to IS NULL OR TIMESTAMP '1996-06-01' < valid_to)")
def as_of(spark, sf_dir):
    return filters.as_of(tables.business_edges(spark, sf_dir), THEN).select("id", "rel", when("valid_from").alias("valid_from"))


@query("f3_relations", f"WITH {EDGES} SELECT id, rel FROM edges WHERE rel IN ('PLACED_BY', 'PART_OF')")
def relations(spark, sf_dir):
    return filters.relations(tables.business_edges(spark, sf_dir), rels=["PLACED_BY", "PART_OF"]).select("id", "rel")


@query("f4_expired", f"SELECT 'O-' || o_orderkey AS id, {WHEN.format('o_orderdate + INTERVAL 90 DAYS')} AS expires_at FROM orders WHERE TIMESTAMP '1998-01-01' > o_orderdate + INTERVAL 90 DAYS")
def expired(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders")
    return filters.expired(o.select(F.concat(F.lit("O-"), F.col("o_orderkey").cast("string")).alias("id"), scalar.add_seconds(F.col("o_orderdate"), F.lit(90 * 86400)).alias("expires_at")), NOW).select("id", when("expires_at").alias("expires_at"))


@query("f5_live", f"WITH {VERSIONS} SELECT user_id AS id, event_id FROM v WHERE valid_to IS NULL")
def live(spark, sf_dir):
    return filters.live(history(spark, sf_dir)).select("id", "event_id")


@query("f6_orphans", f"WITH {NODES}, {EDGES}, e AS (SELECT * FROM edges WHERE rel <> 'PLACED_BY' AND id NOT LIKE 'EL-%1') SELECT id, label FROM nodes WHERE id NOT IN (SELECT src FROM e) AND id NOT IN (SELECT dst FROM e)")
def orphans(spark, sf_dir):
    """Once orders don't name their customers, and the first lines are gone, orders of one line are orphans."""
    e = tables.business_edges(spark, sf_dir).where("rel <> 'PLACED_BY' AND id NOT LIKE 'EL-%1'")
    return filters.orphans(tables.business_nodes(spark, sf_dir), e).select("id", F.element_at("labels", 1).alias("label"))


@query("f7_tiers", f"WITH {NODES} SELECT id, CASE label WHEN 'Master' THEN 'MASTER' WHEN 'Spec' THEN 'SPEC' WHEN 'Adr' THEN 'ADR' ELSE 'USER' END AS tier, label = 'Master' AS forbidden FROM nodes")
def tiers(spark, sf_dir):
    t = scalar.tier(F.col("labels"))
    return tables.business_nodes(spark, sf_dir).select("id", t.alias("tier"), (t == "MASTER").alias("forbidden"))


def history(spark, sf_dir):
    return changes.versions(tables.event_versions(spark, sf_dir), "event_id")


@query("w2_version_history", f"WITH {VERSIONS} SELECT user_id AS id, event_id, {WHEN.format('valid_from')} AS valid_from, {WHEN.format('valid_to')} AS valid_to FROM v")
def version_history(spark, sf_dir):
    return history(spark, sf_dir).select("id", "event_id", when("valid_from").alias("valid_from"), when("valid_to").alias("valid_to"))


@query("j15_versions_at_times", f"WITH {VERSIONS} SELECT e.event_id AS asked, v.event_id AS held FROM events e JOIN v ON e.user_id = v.user_id AND v.valid_from <= e.ts - INTERVAL 1 DAY AND (v.valid_to IS NULL OR e.ts - INTERVAL 1 DAY < v.valid_to)")
def versions_at_times(spark, sf_dir):
    times = tables.event_versions(spark, sf_dir).select("id", F.col("event_id").alias("asked"), F.expr("valid_from - INTERVAL 1 DAY").alias("t"))
    return changes.at_times(history(spark, sf_dir).select("id", "event_id", "valid_from", "valid_to"), times).select("asked", F.col("event_id").alias("held"))


@query("u1_union_distinct", f"WITH {EDGES} SELECT src AS id FROM edges UNION SELECT dst FROM edges")
def union_distinct(spark, sf_dir):
    e = tables.business_edges(spark, sf_dir)
    return e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()


@query("u2_difference", "SELECT 'P-' || p_partkey AS id FROM part EXCEPT SELECT 'P-' || l_partkey FROM lineitem WHERE l_quantity > 45")
def difference(spark, sf_dir):
    p, li = tables.table(spark, sf_dir, "part").select("p_partkey"), tables.table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_partkey")
    return p.join(li, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select(F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("id"))


@query("u3_intersection", "SELECT 'P-' || p_partkey AS id FROM part INTERSECT SELECT 'P-' || l_partkey FROM lineitem")
def intersection(spark, sf_dir):
    p, li = tables.table(spark, sf_dir, "part").select("p_partkey"), tables.table(spark, sf_dir, "lineitem").select("l_partkey")
    return p.join(li, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select(F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("id"))


def expiring(spark, sf_dir):
    n = tables.business_nodes(spark, sf_dir)
    return n.withColumn("expires_at", F.when(F.element_at("labels", 1) == "Order", F.expr("valid_from + INTERVAL 900 DAYS")))


@query("p1_prune", f"""WITH {NODES}, {EDGES}, e AS (SELECT * FROM edges WHERE rel <> 'LOCATED_IN'), old AS (SELECT id FROM nodes WHERE label = 'Order' AND TIMESTAMP '1998-01-01' > valid_from + INTERVAL 900 DAYS)
SELECT id FROM old UNION SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM e) AND id NOT IN (SELECT dst FROM e)""")
def prune(spark, sf_dir):
    """Without places, customers who never ordered are orphans beside the expired orders."""
    return changes.to_prune(expiring(spark, sf_dir), filters.relations(tables.business_edges(spark, sf_dir), rels=["PART_OF", "PLACED_BY", "CONTAINS", "SUPPLIED_BY"]), NOW)
