"""What the store does as a whole, over the driver's tables: writes, logs, snapshots, replication, the language's further forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import runtime
from ..functions import ed25519
from ..operators import clusters, filters, graph, importance, index
from ..session import Store
from ..sources import tables
from .base import EDGES, IMPACTS, NODES, query
from .on_graph import all_edges, dealt, parts
from .on_vectors import SHIFT, first_vector, hits, hybrid, nodes

NOW = "1998-01-01T00:00:00+00:00"


def folder(spark, name: str) -> str:
    return f"{runtime.shared_folder(spark)}/{name}-{uuid.uuid4()}"


def sources_of(spark, sf_dir, prefix: str, key: str, table: str):
    """(id, src, dst, rel) and the other columns of a history: edges LOCATED_IN."""
    e = filters.relations(tables.business_edges(spark, sf_dir), "LOCATED_IN").where(F.col("src").startswith(f"{prefix}-"))
    none = F.lit(None)
    return e.select("id", "src", "dst", "rel", F.lit("{}").alias("props"), "valid_from", "valid_to", none.cast("timestamp").alias("recorded_at"), none.cast("string").alias("superseded_by"), F.lit(0.7).alias("impact"), none.cast("string").alias("caused_by"), F.struct(F.lit(1).cast("bigint").alias("time"), F.lit("p").alias("peer_id")).alias("clock"))


def suppliers(spark, sf_dir, **more) -> Store:
    """Suppliers and nations with all columns of a store, and where they lie."""
    none = F.lit(None)
    n = tables.business_nodes(spark, sf_dir, "S").union(tables.business_nodes(spark, sf_dir, "N"))
    n = n.select("id", "labels", "props", "impact", none.cast("array<double>").alias("embedding"), F.lit("en").alias("lang"), "valid_from", "valid_to", none.cast("string").alias("caused_by"), "expires_at", F.struct(F.lit(1).cast("bigint").alias("time"), F.lit("p").alias("peer_id")).alias("clock"))
    return Store(n, sources_of(spark, sf_dir, "S", "s_suppkey", "supplier"), clock=lambda: NOW, **more)


@query("s7_social_csv", "SELECT CAST(c_custkey AS VARCHAR) AS id, 'Person' AS kind, c_name AS about FROM customer UNION ALL SELECT 'post-' || p_partkey, 'Post', p_name FROM part UNION ALL SELECT 'knows-' || c_custkey || '-' || (c_custkey + 1), 'knows', c_custkey || '>' || (c_custkey + 1) FROM customer")
def social_csv(spark, sf_dir):
    """Customers as persons and parts as posts, written as the three files and read back."""
    path, c = folder(spark, "social"), tables.table(spark, sf_dir, "customer")
    write = lambda df, name: df.write.csv(f"{path}/{name}.csv", header=True)
    write(c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("-").alias("gender")), "person")
    write(tables.table(spark, sf_dir, "part").select(F.concat(F.lit("post-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("content")), "post")
    write(c.select(F.col("c_custkey").alias("source_id"), (F.col("c_custkey") + 1).alias("target_id")), "knows")
    n, e = tables.read_social(spark, path)
    about = F.coalesce(F.get_json_object("props", "$.name"), F.get_json_object("props", "$.content"))
    return n.select("id", F.element_at("labels", 1).alias("kind"), about.alias("about")).union(e.select("id", "rel", F.concat_ws(">", "src", "dst")))


@query("s10_language_centroid", hybrid(10, 0.5, q="(SELECT list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x + coalesce(CAST([0.1, -0.2, 0.3] AS DOUBLE[])[i], 0)) FROM embeddings WHERE vec_id = 0)"))
def language_centroid(spark, sf_dir):
    """Registered twice: the last centroid of a language counts."""
    s = Store(nodes(spark, sf_dir), filters.relations(tables.business_edges(spark, sf_dir), "none"), tables.vectors(spark, sf_dir))
    s.set_language_centroid("th", [9.0])
    s.set_language_centroid("th", SHIFT)
    return hits(s.hybrid_search(first_vector(spark, sf_dir), 10, lang="th"))


@query("m1_add_nodes", "SELECT 'N-' || n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'again' ELSE n_name END AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'th' ELSE 'en' END AS lang, CAST(0.7 AS DOUBLE) AS impact, CASE WHEN n_nationkey % 2 = 0 THEN row_number() OVER (PARTITION BY n_nationkey % 2 ORDER BY n_nationkey) + 25 ELSE n_nationkey + 1 END AS time FROM nation")
def add_nodes(spark, sf_dir):
    """All nations, then every other one again, which replaces it."""
    s = Store.empty(spark, clock=lambda: NOW)
    rows = tables.table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    s.add_nodes([{"id": f"N-{r.n_nationkey}", "labels": ["Nation"], "props": {"name": r.n_name}} for r in rows])
    for r in rows:
        if r.n_nationkey % 2 == 0:
            s.add_node(id=f"N-{r.n_nationkey}", props={"name": "again"}, lang="th")
    return filters.live(s.nodes).select("id", F.get_json_object("props", "$.name").alias("name"), "lang", "impact", F.col("clock.time").alias("time"))


@query("m3_bulk_edges", "SELECT 'PART_OF-' || n_nationkey AS id, 'N-' || n_nationkey AS src, 'R-' || n_regionkey AS dst FROM nation")
def bulk_edges(spark, sf_dir):
    s = Store.empty(spark, clock=lambda: NOW)
    s.add_edges([{"id": f"PART_OF-{r.n_nationkey}", "from": f"N-{r.n_nationkey}", "to": f"R-{r.n_regionkey}", "rel": "PART_OF"} for r in tables.table(spark, sf_dir, "nation").collect()])
    return s.query(rel="PART_OF").select("id", "src", "dst")


LEFT = "l AS (SELECT s_suppkey AS k, s_name AS name, s_nationkey AS nation FROM supplier WHERE s_acctbal >= 0)"


@query("m8_log_and_replay", f"""WITH {LEFT} SELECT 'node' AS kind, 'S-' || k AS id, CASE WHEN k = (SELECT min(k) FROM l) THEN 'renamed' ELSE name END AS name FROM l UNION ALL SELECT 'before', 'S-' || k, name FROM l WHERE k = (SELECT min(k) FROM l)
UNION ALL SELECT 'edge', 'ES-' || k, 'N-' || nation FROM l UNION ALL SELECT 'node', 'N-' || n_nationkey, n_name FROM nation""")
def log_and_replay(spark, sf_dir):
    """Suppliers are logged; those overdrawn are retracted and one is superseded; the rest is appended, and the log replayed gives the store as it was left."""
    path, s = folder(spark, "log"), suppliers(spark, sf_dir)
    s.append_log(path)
    t = tables.table(spark, sf_dir, "supplier")
    s._retract(t.where("s_acctbal < 0").select(F.concat(F.lit("S-"), F.col("s_suppkey").cast("string")).alias("id")))
    s.supersede_node(f"S-{t.where('s_acctbal >= 0').agg(F.min('s_suppkey')).first()[0]}", {"name": "renamed"})
    s.append_log(path)
    back, name = Store.replay(spark, path), F.get_json_object("props", "$.name").alias("name")
    live, old = filters.live(back.nodes), back.nodes.where("valid_to IS NOT NULL")
    return live.select(F.lit("node").alias("kind"), "id", name).union(old.select(F.lit("before"), "id", name)).union(back.edges.select(F.lit("edge"), "id", "dst"))


@query("m10_snapshot_and_tail", f"WITH {LEFT} SELECT 'node' AS kind, 'S-' || k AS id FROM l UNION ALL SELECT 'node', 'N-' || n_nationkey FROM nation UNION ALL SELECT 'edge', 'ES-' || k FROM l UNION ALL SELECT 'centroid', 'th' UNION ALL SELECT 'peer', 'p1' UNION ALL SELECT 'vote', 'p1'")
def snapshot_and_tail(spark, sf_dir):
    """A snapshot of everything, and what the log got after it."""
    log, path, s = folder(spark, "log"), folder(spark, "snapshot"), suppliers(spark, sf_dir)
    s.set_language_centroid("th", SHIFT)
    s.add_peer("p1", b"k")
    s.propose("q", s.nodes.limit(1).select("id"))
    s.vote("q", "p1", False)
    s.save(path, log)
    s._retract(tables.table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("S-"), F.col("s_suppkey").cast("string")).alias("id")))
    s.append_log(log)
    back = Store.load(spark, path, log)
    own = lambda kind, df, c="id": df.select(F.lit(kind).alias("kind"), F.col(c).alias("id"))
    return own("node", back.nodes).union(own("edge", back.edges)).union(own("centroid", back.centroids, "lang")).union(own("peer", back.peers, "peer_id")).union(own("vote", back.votes, "peer_id"))


@query("o4_traversal_limit", "SELECT seed, id, 1 AS depth FROM (SELECT 'R-' || n_regionkey AS seed, 'N-' || n_nationkey AS id, row_number() OVER (PARTITION BY n_regionkey ORDER BY 'N-' || n_nationkey) AS i FROM nation) WHERE i <= 3")
def traversal_limit(spark, sf_dir):
    """The three nearest of every region, by depth and id."""
    n, e = parts(spark, sf_dir)
    return graph.neighbors(n, e, tables.business_nodes(spark, sf_dir, "R").select("id"), 2, direction="both", rel="PART_OF", limit=3).select("seed", "id", "depth")


@query("o5_by_impact", f"WITH {NODES}, {EDGES}, {IMPACTS}, r AS (SELECT id, round(impact, 6) AS impact FROM impacts WHERE id LIKE 'N-%') SELECT id, impact, CAST(row_number() OVER (ORDER BY impact DESC, id) - 1 AS BIGINT) AS place FROM r")
def by_impact(spark, sf_dir):
    """The nations, reached from the regions, weightiest first."""
    n, e = parts(spark, sf_dir)
    n = importance.refreshed(n, e, tables.business_nodes(spark, sf_dir, "N").select("id")).withColumn("impact", F.round("impact", 6))
    out = graph.neighbors(n, e, tables.business_nodes(spark, sf_dir, "R").select("id"), 1, direction="both", by_impact=True)
    # The order of the result as a column: of one small partition.
    return out.coalesce(1).select("id", "impact", F.monotonically_increasing_id().alias("place"))


@query("t4_inferred_alias", f"WITH {EDGES} SELECT 'C-7' AS seed, n.dst AS id, 1 AS depth FROM edges n WHERE n.src = 'C-7' AND rel = 'LOCATED_IN'")
def inferred_alias(spark, sf_dir):
    """A virtual relation in the language stands for a stored one."""
    return Store(*parts(spark, sf_dir), aliases={"lies_in": "LOCATED_IN"}).hql("TRAVERSE FROM C-7 DEPTH 1 REL INFER(lies_in)").select("seed", "id", "depth")


@query("t15_meta_neighbors", f"WITH {EDGES}, c AS (SELECT 'O-' || o_orderkey AS id, CAST(o_custkey % 10 AS BIGINT) AS k FROM orders UNION ALL SELECT 'P-' || p_partkey, CAST(p_partkey % 10 AS BIGINT) FROM part UNION ALL SELECT 'S-' || s_suppkey, CAST(s_suppkey % 10 AS BIGINT) FROM supplier) SELECT DISTINCT CAST(a.k AS VARCHAR) AS seed, CAST(b.k AS VARCHAR) AS id, 1 AS depth FROM edges JOIN c a ON a.id = src JOIN c b ON b.id = dst WHERE a.k <> b.k")
def meta_neighbors(spark, sf_dir):
    """From every theme, those that edges tie to it."""
    s = Store(tables.business_nodes(spark, sf_dir), all_edges(spark, sf_dir))
    s.meta = runtime.checkpointed(clusters.meta_edges(s.edges, dealt(spark, sf_dir)))
    return s.meta_neighbors(range(10), 1).select("seed", "id", "depth")


@query("g5_clock_merge", "SELECT (SELECT max(event_id) FROM events) AS clock, (SELECT max(event_id) + 1 FROM events) AS next, (SELECT count(DISTINCT user_id) FROM events) AS n")
def clock_merge(spark, sf_dir):
    """A store of the even events takes in the odd ones: its clock jumps to the greatest it has seen."""
    e = tables.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("id"), F.array("event_type").alias("labels"), F.lit("{}").alias("props"), F.col("ts").cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.struct(F.col("event_id").alias("time"), F.lit("p").alias("peer_id")).alias("clock"))
    even = lambda x: e.where(f"clock.time % 2 = {x}")
    s = Store(even(0).limit(0), filters.relations(tables.business_edges(spark, sf_dir), "none").withColumn("clock", F.struct(F.lit(0).cast("bigint").alias("time"), F.lit("p").alias("peer_id"))))
    s.reconcile(even(0))
    s.reconcile(even(1))
    return spark.createDataFrame([(s.logical_clock(), s.tick(), filters.live(s.nodes).count())], "clock bigint, next bigint, n bigint")


@query("g9_untimed_specs", f"WITH {NODES} SELECT id FROM nodes WHERE label = 'Spec' AND CAST(substr(id, 3) AS INTEGER) % 3 = 0")
def untimed_specs(spark, sf_dir):
    """Every third nation has lost the time from which it holds."""
    n = tables.business_nodes(spark, sf_dir)
    return filters.untimed_specs(n.withColumn("valid_from", F.when(~((F.element_at("labels", 1) == "Spec") & (F.substring("id", 3, 9).try_cast("int") % 3 == 0)), F.col("valid_from")))).select("id")


@query("m15_context_json", f"WITH {EDGES}, e AS (SELECT * FROM edges WHERE src = 'N-3' OR dst = 'N-3') SELECT 'nodes' AS part, src AS id FROM e UNION SELECT 'nodes', dst FROM e UNION ALL SELECT 'edges', id FROM e UNION ALL SELECT 'head', 'Resolved N-3 as of Tier H1 (1 hops)'")
def context_json(spark, sf_dir):
    out = Store(*parts(spark, sf_dir)).hql_json('CONTEXT FOR "N-3" TIER H1 BUDGET 100000000')
    return out.select("part", F.coalesce(F.get_json_object("json", "$.id"), F.get_json_object("json", "$.trace")).alias("id"))


@query("x11_signatures", "SELECT n_nationkey AS id, n_nationkey % 3 > 0 AS good FROM nation")
def signatures(spark, sf_dir):
    """Of the nations' names; every third one was changed after it was signed."""
    secret = bytes(range(32))
    n = tables.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).withColumn("list", F.from_json(ed25519.signer(secret)("name"), "array<int>"))
    raw = F.unhex(F.array_join(F.transform("list", lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    said = F.when(F.col("id") % 3 == 0, F.concat("name", F.lit("!"))).otherwise(F.col("name"))
    return n.select("id", ed25519.verified(F.lit(bytearray(ed25519.public_key(secret))), said, raw).alias("good"))


@query("v8_indexed_search")
def indexed_search(spark, sf_dir):
    """Every vector whose id 100 divides, against all, by the index: approximate, so the tests hold its recall against brute force."""
    v = tables.vectors(spark, sf_dir).select("node_id", "embedding")
    return index.nearest(index.build(v, cell_rows=256), v.where("node_id % 100 = 0").withColumnRenamed("node_id", "query_id"), 6)
