"""Traversals, context, importance, communities and clusters over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import clusters, filters, graph, importance, packed
from ..session import Store
from ..sources import tables
from .base import EDGES, GRAPH, IMPACTS, NODES, query


def parts(spark, sf_dir):
    return tables.business_nodes(spark, sf_dir), tables.business_edges(spark, sf_dir)


def flat(found):
    return found.select("seed", "id", "depth", F.array_join("path", ">").alias("path"))


@query("t1_neighbors", f"""WITH {EDGES}, live AS (SELECT * FROM edges WHERE valid_to IS NULL),
one AS (SELECT src AS seed, dst AS id, 1 AS depth, min([id]) AS path FROM live WHERE src LIKE 'O-%' AND dst <> src GROUP BY 1, 2),
two AS (SELECT one.seed, e.dst AS id, 2 AS depth, min(list_append(one.path, e.id)) AS path FROM one JOIN live e ON e.src = one.id WHERE e.dst <> one.seed GROUP BY 1, 2)
SELECT seed, id, depth, array_to_string(path, '>') AS path FROM (FROM one UNION ALL FROM two WHERE (seed, id) NOT IN (SELECT (seed, id) FROM one))""")
def neighbors(spark, sf_dir):
    """Two steps from every order: its customer, and the customer's nation."""
    n, e = parts(spark, sf_dir)
    return flat(graph.neighbors(n, e, tables.business_nodes(spark, sf_dir, "O").select("id"), 2))


@query("t1_neighbors_as_of", f"""WITH {NODES}, {EDGES}, live AS (SELECT * FROM edges WHERE valid_from <= TIMESTAMP '1996-06-01' AND (valid_to IS NULL OR TIMESTAMP '1996-06-01' < valid_to) AND rel IN ('PLACED_BY', 'CONTAINS')),
there AS (SELECT id FROM nodes WHERE valid_from <= TIMESTAMP '1996-06-01'), both_ways AS (SELECT src AS a, dst AS b, id FROM live UNION ALL SELECT dst, src, id FROM live)
SELECT a AS seed, b AS id, 1 AS depth, min(id) AS path FROM both_ways WHERE a LIKE 'C-%' AND b IN (FROM there) GROUP BY 1, 2""")
def neighbors_as_of(spark, sf_dir):
    """A step from every customer, both ways, over two types of edge, at a time."""
    n, e = parts(spark, sf_dir)
    return flat(graph.neighbors(n, e, tables.business_nodes(spark, sf_dir, "C").select("id"), 1, rels=["PLACED_BY", "CONTAINS"], direction="both", as_of="1996-06-01T00:00:00"))


@query("t2_hql_traverse", f"WITH {EDGES} SELECT dst AS id, 1 AS depth FROM edges WHERE src = 'C-7' AND rel = 'LOCATED_IN' AND valid_to IS NULL")
def hql_traverse(spark, sf_dir):
    return Store(*parts(spark, sf_dir)).hql("TRAVERSE FROM C-7 DEPTH 1 REL LOCATED_IN").select("id", "depth")


CLOSURE = f"""{GRAPH}, live AS (SELECT * FROM edges WHERE valid_to IS NULL), walk AS (
  SELECT src AS seed, dst AS id, 1 AS depth FROM live WHERE src LIKE 'C-%' OR src LIKE 'S-%'
  UNION SELECT walk.seed, live.dst, walk.depth + 1 FROM walk JOIN live ON live.src = walk.id)
SELECT seed, id, min(depth) AS depth FROM walk GROUP BY 1, 2"""


@query("t3_closure", CLOSURE)
def closure(spark, sf_dir):
    """All that customers and suppliers lie in, however far."""
    n, e = parts(spark, sf_dir)
    seeds = tables.business_nodes(spark, sf_dir, "C").select("id").union(tables.business_nodes(spark, sf_dir, "S").select("id"))
    return graph.closure(n, e, seeds, paths=False)


def next_customers(spark, sf_dir):
    """A cyclic graph: an edge from each customer to the next of its nation, the last to the first."""
    c = "SELECT c_custkey, lead(c_custkey) OVER w AS nxt, first_value(c_custkey) OVER w AS fst FROM {c} WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)"
    e = spark.sql(c, c=tables.table(spark, sf_dir, "customer"))
    to = F.coalesce("nxt", "fst").cast("string")
    e = e.select(F.concat(F.lit("E"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_custkey").cast("string").alias("src"), to.alias("dst"), F.lit("next").alias("rel"), F.lit(None).cast("timestamp").alias("valid_to"))
    return e.select(F.col("src").alias("id"), "valid_to"), e


@query("t3_cyclic_closure", """SELECT CAST(c_custkey AS VARCHAR) AS id, min(CAST(c_custkey AS VARCHAR)) OVER w AS class, count(*) OVER w - 1 AS links FROM customer WINDOW w AS (PARTITION BY c_nationkey)""")
def cyclic_closure(spark, sf_dir):
    """Rings of the customers of a nation: each with its ring, all others of which it reaches, and how many they are."""
    return graph.inferred(*next_customers(spark, sf_dir), {"near": "next"}, "near")


@query("t5_context", f"""{GRAPH}, b AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), one AS (SELECT DISTINCT b AS id FROM b WHERE a = 'R-2'),
two AS (SELECT DISTINCT b.b AS id FROM one JOIN b ON b.a = one.id), reached AS (SELECT 'R-2' AS id UNION FROM one UNION FROM two), inside AS (SELECT 'R-2' AS id UNION FROM one)
SELECT 'node' AS kind, id FROM nodes WHERE id IN (FROM reached) UNION ALL SELECT 'edge', id FROM edges WHERE src IN (FROM inside) OR dst IN (FROM inside)""")
def context(spark, sf_dir):
    c = graph.context(*parts(spark, sf_dir), "R-2", "H2")
    return c["nodes"].select(F.lit("node").alias("kind"), "id").union(c["edges"].select(F.lit("edge"), "id"))


@query("t8_budget_compression", "SELECT label AS cluster_id, 'Theme-' || label AS theme, count(*) AS member_count FROM embeddings GROUP BY label")
def budget_compression(spark, sf_dir):
    """Over its budget a context gives all cluster summaries instead."""
    n, e = parts(spark, sf_dir)
    c = graph.context(n, e, "R-2", "H2", 10, cluster_summaries(spark, sf_dir))
    return c["super_nodes"].select("cluster_id", "theme", "member_count")


@query("t9_hql_context", f"WITH {NODES} SELECT id, label FROM nodes WHERE id IN ('N-3', 'R-' || (SELECT n_regionkey FROM nation WHERE n_nationkey = 3)) OR id IN (SELECT 'C-' || c_custkey FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'S-' || s_suppkey FROM supplier WHERE s_nationkey = 3)")
def hql_context(spark, sf_dir):
    return Store(*parts(spark, sf_dir)).hql('CONTEXT FOR "N-3" TIER H1 BUDGET 100000000')["nodes"].select("id", F.element_at("labels", 1).alias("label"))


@query("t7_token_estimate", "SELECT event_type, CAST(floor(sum(octet_length(encode(json(props)))) / 4) AS BIGINT) AS tokens FROM events GROUP BY 1")
def token_estimate(spark, sf_dir):
    return graph.token_estimates(tables.table(spark, sf_dir, "events"), "event_type")


@query("t11_degrees", f"WITH {EDGES} SELECT dst AS id, count(DISTINCT id) AS in_degree FROM edges GROUP BY 1")
def degrees(spark, sf_dir):
    return graph.degrees(tables.business_edges(spark, sf_dir))


def propagation(rounds: int) -> str:
    """SQL of rounds of label propagation over the places of customers and suppliers."""
    sql = f"WITH {NODES}, {EDGES}, b AS (SELECT src AS id, dst AS other FROM edges WHERE rel IN ('LOCATED_IN', 'PART_OF') UNION ALL SELECT dst, src FROM edges WHERE rel IN ('LOCATED_IN', 'PART_OF')), l0 AS (SELECT id, id AS label FROM nodes WHERE label IN ('Master', 'Spec', 'Adr', 'Customer'))"
    for i in range(1, rounds + 1):
        sql += f""", h{i} AS (SELECT b.id, l.label, count(*) AS n FROM b JOIN l{i - 1} l ON l.id = b.other GROUP BY 1, 2), w{i} AS (SELECT id, arg_min(label, (-n, label)) AS won FROM h{i} GROUP BY 1),
        l{i} AS (SELECT l.id, coalesce(won, label) AS label FROM l{i - 1} l LEFT JOIN w{i} USING (id))"""
    return f"{sql} SELECT id, label FROM l{rounds}"


def placed(spark, sf_dir):
    n, e = parts(spark, sf_dir)
    return n.where(F.element_at("labels", 1).isin("Master", "Spec", "Adr", "Customer")).select("id", F.col("id").alias("label")), filters.relations(e, rels=["LOCATED_IN", "PART_OF"])


@query("t12_label_propagation", propagation(1))
def label_propagation(spark, sf_dir):
    return graph.propagate(*placed(spark, sf_dir))


@query("t13_communities", propagation(5))
def communities(spark, sf_dir):
    return graph.communities(*placed(spark, sf_dir), rounds=5)


def caused_orders(spark, sf_dir):
    """(id, caused_by): each order is caused by the one before of its customer."""
    return spark.sql("SELECT CAST(o_orderkey AS STRING) AS id, CAST(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS STRING) AS caused_by FROM {o}", o=tables.table(spark, sf_dir, "orders"))


@query("t14_causes", """WITH o AS (SELECT o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, o_custkey FROM orders)
SELECT CAST(s.k AS VARCHAR) AS seed, CAST(o.k AS VARCHAR) AS id, CAST(s.n - o.n AS INTEGER) AS depth FROM o s JOIN o USING (o_custkey) WHERE s.n > o.n""")
def causes(spark, sf_dir):
    """The whole chain that led to every order, back to its customer's first."""
    return graph.causes(caused_orders(spark, sf_dir)).select("seed", "id", "depth")


@query("t16_cooccurrence", """WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT unnest(generate_series(1, len(w))) AS i, w FROM w), q AS (SELECT w[i] AS x, unnest(w[i + 1 : i + 3]) AS y FROM p)
SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS n FROM q WHERE x <> y GROUP BY 1, 2""")
def cooccurrence(spark, sf_dir):
    return graph.cooccurrence(tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), 3)[1]


@query("t16_terms", """SELECT term, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\\pL\\pN]+')) AS term FROM documents) WHERE term <> '' GROUP BY 1""")
def terms(spark, sf_dir):
    return graph.cooccurrence(tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), 3)[0]


# Importance


@query("a2_impact", f"WITH {NODES}, {EDGES}, {IMPACTS} SELECT id, in_degree, round(impact, 6) AS impact FROM impacts")
def impact(spark, sf_dir):
    return importance.impacts(*parts(spark, sf_dir)).select("id", "in_degree", F.round("impact", 6).alias("impact"))


@query("a2_lazy_impact", f"WITH {NODES}, {EDGES}, {IMPACTS} SELECT id, round(CASE in_degree WHEN 0 THEN CAST(0.7 AS DOUBLE) ELSE impact END, 6) AS impact FROM impacts")
def lazy_impact(spark, sf_dir):
    return importance.impacts(*parts(spark, sf_dir), mode="lazy").select("id", F.round("impact", 6).alias("impact"))


@query("a3_stability", "SELECT o_orderkey AS id, CAST(CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.8 ELSE 0.4 END AS DOUBLE) AS score FROM orders")
def stability(spark, sf_dir):
    o = tables.business_nodes(spark, sf_dir).where("id LIKE 'O-%'")
    return o.select(F.substring("id", 3, 20).cast("bigint").alias("id"), scalar.stability(F.col("props")).alias("score"))


@query("a4_refresh_some", f"WITH {NODES}, {EDGES}, {IMPACTS} SELECT id, round(CASE WHEN label = 'Part' THEN impact ELSE CAST(0.7 AS DOUBLE) END, 6) AS impact FROM impacts")
def refresh_some(spark, sf_dir):
    n, e = parts(spark, sf_dir)
    return importance.refreshed(n, e, n.where("id LIKE 'P-%'").select("id")).select("id", F.round("impact", 6).alias("impact"))


# Clusters: the members are embeddings with their label as cluster, and as importance what the label's parity gives


def members(spark, sf_dir):
    return tables.vectors(spark, sf_dir).select(F.col("node_id").alias("id"), F.col("cluster_id").cast("bigint").alias("cluster_id"), (F.lit(0.4) + (F.col("node_id") % 7) / 10.0).alias("impact"))


def cluster_summaries(spark, sf_dir, snapshot=0, vectors=None):
    v = tables.vectors(spark, sf_dir) if vectors is None else vectors
    return clusters.summaries(members(spark, sf_dir), v.drop("cluster_id"), snapshot)


MEMBERS = "m AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS cluster_id, CAST(0.4 AS DOUBLE) + (vec_id % 7) / CAST(10 AS DOUBLE) AS impact, embedding FROM embeddings)"
CENTROIDS = "x AS (SELECT cluster_id, id, unnest(generate_series(1, len(embedding))) AS p, unnest(embedding) AS x FROM m), mean AS (SELECT cluster_id, p, avg(CAST(x AS DOUBLE)) AS x FROM x GROUP BY 1, 2), cent AS (SELECT cluster_id, list(x ORDER BY p) AS c FROM mean GROUP BY 1)"


@query("a6_cluster_summaries", f"WITH {MEMBERS}, {CENTROIDS}, s AS (SELECT cluster_id, count(*) AS member_count, avg(impact) AS impact FROM m GROUP BY 1) SELECT cluster_id, 'Theme-' || cluster_id AS theme, member_count, round(impact, 6) AS impact, round(list_sum(c), 5) AS centroid_sum, round(sqrt(list_dot_product(c, c)), 6) AS centroid_norm FROM s JOIN cent USING (cluster_id)")
def summaries(spark, sf_dir):
    s = cluster_summaries(spark, sf_dir)
    total = lambda f: F.aggregate("centroid", F.lit(0.0), lambda a, x: a + f(x))
    return s.select("cluster_id", "theme", "member_count", F.round("impact", 6).alias("impact"), F.round(total(lambda x: x), 5).alias("centroid_sum"), F.round(F.sqrt(total(lambda x: x * x)), 6).alias("centroid_norm"))


@query("a7_meta_edges", f"WITH {EDGES}, c AS (SELECT 'O-' || o_orderkey AS id, CAST(o_custkey % 10 AS BIGINT) AS k FROM orders UNION ALL SELECT 'P-' || p_partkey, CAST(p_partkey % 10 AS BIGINT) FROM part UNION ALL SELECT 'S-' || s_suppkey, CAST(s_suppkey % 10 AS BIGINT) FROM supplier) SELECT a.k AS from_cluster, b.k AS to_cluster, count(*) AS weight FROM edges JOIN c a ON a.id = src JOIN c b ON b.id = dst WHERE a.k <> b.k GROUP BY 1, 2")
def meta_edges(spark, sf_dir):
    return clusters.meta_edges(all_edges(spark, sf_dir), dealt(spark, sf_dir))


def all_edges(spark, sf_dir):
    """The edges, for what moves them all."""
    return tables.business_edges(spark, sf_dir, lambda pairs: packed.distinct(pairs, "l_partkey"))


def dealt(spark, sf_dir):
    k = lambda name, prefix, key, by: tables.table(spark, sf_dir, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), (F.col(by) % 10).cast("bigint").alias("cluster_id"))
    return k("orders", "O-", "o_orderkey", "o_custkey").union(k("part", "P-", "p_partkey", "p_partkey")).union(k("supplier", "S-", "s_suppkey", "s_suppkey"))


@query("a8_drift", f"""WITH {MEMBERS}, {CENTROIDS}, m2 AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS cluster_id, embedding FROM embeddings WHERE vec_id % 3 > 0), x2 AS (SELECT cluster_id, unnest(generate_series(1, len(embedding))) AS p, unnest(embedding) AS x FROM m2), c2 AS (SELECT cluster_id, list(x ORDER BY p) AS c FROM (SELECT cluster_id, p, avg(CAST(x AS DOUBLE)) AS x FROM x2 GROUP BY 1, 2) GROUP BY 1)
SELECT CAST(0 AS BIGINT) AS snapshot_id, cluster_id, CAST(NULL AS DOUBLE) AS drift FROM cent UNION ALL SELECT 1, c2.cluster_id, round(1 - list_cosine_similarity(c2.c, cent.c), 6) FROM c2 LEFT JOIN cent USING (cluster_id)""")
def drift(spark, sf_dir):
    """The second snapshot lost a third of the vectors."""
    later = tables.vectors(spark, sf_dir).where("node_id % 3 > 0")
    h = cluster_summaries(spark, sf_dir).union(cluster_summaries(spark, sf_dir, 1, later))
    return clusters.drift(h).select("snapshot_id", "cluster_id", F.round("drift", 6).alias("drift"))


@query("a9_cluster_history", f"WITH {MEMBERS} SELECT CAST(s AS BIGINT) AS snapshot_id, CAST(2 AS BIGINT) AS cluster_id, (SELECT count(*) FROM m WHERE cluster_id = 2) AS member_count FROM generate_series(0, 1) t(s)")
def cluster_history(spark, sf_dir):
    h = cluster_summaries(spark, sf_dir).union(cluster_summaries(spark, sf_dir, 1))
    return clusters.history_of(h, 2).select("snapshot_id", "cluster_id", "member_count")


@query("a10_structural_gaps", f"WITH {MEMBERS}, {CENTROIDS}, s AS (SELECT cluster_id, avg(impact) AS impact FROM m GROUP BY 1 HAVING avg(impact) >= 0.5) SELECT a.cluster_id AS cluster_a, b.cluster_id AS cluster_b, round(1 / (1 + list_distance(a.c, b.c)), 6) AS similarity FROM (FROM cent JOIN s USING (cluster_id)) a JOIN (FROM cent JOIN s USING (cluster_id)) b ON a.cluster_id < b.cluster_id WHERE 1 / (1 + list_distance(a.c, b.c)) > 0.4")
def structural_gaps(spark, sf_dir):
    """A threshold of 0.4, as these clusters lie far apart."""
    return clusters.gaps(cluster_summaries(spark, sf_dir), min_similarity=0.4).select("cluster_a", "cluster_b", F.round("similarity", 6).alias("similarity"))


@query("a16_themes", "SELECT CAST(o_custkey % 10 AS BIGINT) AS cluster_id, mode_of AS theme FROM (SELECT o_custkey % 10 AS o_custkey, arg_min(o_orderpriority, (-n, o_orderpriority)) AS mode_of FROM (SELECT o_custkey % 10 AS o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1)")
def themes(spark, sf_dir):
    o = tables.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).cast("bigint").alias("cluster_id"), F.array("o_orderpriority").alias("labels"))
    return clusters.themes(o)
