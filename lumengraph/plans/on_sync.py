"""Replication, votes, governance and streams over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import runtime
from ..operators import filters, sync
from ..sources import tables
from ..streaming import log
from .base import EDGES, NODES, query
from .on_tables import LAST, event_lines


def versions(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("id"), F.struct(F.col("ts").alias("time"), F.col("event_id").alias("peer")).alias("clock"), "event_type", "value")


@query("a14_last_writer", "SELECT user_id AS id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, round(arg_max(value, (ts, event_id)), 6) AS value FROM events GROUP BY user_id")
def last_writer(spark, sf_dir):
    return sync.latest(versions(spark, sf_dir)).select("id", F.col("clock.peer").alias("event_id"), "event_type", F.round("value", 6).alias("value"))


@query("g4_reconcile", "SELECT user_id AS id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def reconcile(spark, sf_dir):
    """Two replicas that saw different events are merged by clock."""
    e = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.struct(F.col("event_id").alias("time"), F.lit("p").alias("peer_id")).alias("clock"), "event_type")
    a, b = sync.latest(e.where("clock.time % 2 = 0")), sync.latest(e.where("clock.time % 2 = 1"))
    return sync.merge(a, b).select("id", F.col("clock.time").alias("event_id"), "event_type")


@query("g4_trusted_signers", "SELECT event_id, user_id % 4 AS signer FROM events WHERE user_id % 4 = 0 OR (user_id % 4 IN (1, 2) AND event_id % 3 > 0)")
def trusted_signers(spark, sf_dir):
    """Peer 0 is local, peer 3 is unknown, and every third signature of the others is all zeros."""
    e = tables.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).cast("string").alias("signer"), F.col("props").alias("payload"), F.when(F.col("event_id") % 3 == 0, F.unhex(F.lit("0000"))).otherwise(F.unhex(F.lit("00ab"))).alias("signature"))
    peers = spark.createDataFrame([(str(i), bytearray(b"k")) for i in (0, 1, 2)], "peer_id string, public_key binary")
    marked = lambda key, payload, signature: ~F.hex(signature).rlike("^0*$")
    return sync.trusted(e, peers, "0", marked).select("event_id", F.col("signer").cast("bigint").alias("signer"))


@query("j14_refused_signers", "SELECT event_id FROM events WHERE user_id % 4 = 3")
def refused_signers(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).cast("string").alias("signer"))
    peers = spark.createDataFrame([(str(i), bytearray(b"k")) for i in (0, 1, 2)], "peer_id string, public_key binary")
    return sync.refused(e, peers, "0").select("event_id")


@query("a11_vote_tally", "SELECT proposal_id, count(*) FILTER (approve) AS approvals, count(*) FILTER (approve) > 3 AS accepted FROM (SELECT user_id AS proposal_id, event_id % 7 AS peer, arg_max(value > 50, event_id) AS approve FROM events GROUP BY 1, 2) GROUP BY 1")
def vote_tally(spark, sf_dir):
    """Each user is a proposal and its events are the votes of seven peers; a peer's last vote counts."""
    v = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("proposal_id"), (F.col("event_id") % 7).alias("peer_id"), (F.col("value") > 50).alias("approve"), F.col("event_id").alias("position"))
    return sync.tally(v, 7)


@query("g3_promote", f"WITH {NODES}, a AS (SELECT 'C-' || c_custkey AS id FROM customer WHERE c_acctbal > 5000) SELECT id, CASE WHEN id IN (FROM a) THEN label || ',MASTER' ELSE label END AS labels FROM nodes")
def promote(spark, sf_dir):
    a = tables.table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.concat(F.lit("C-"), F.col("c_custkey").cast("string")).alias("id"))
    return sync.promote(tables.business_nodes(spark, sf_dir), a).select("id", F.array_join("labels", ",").alias("labels"))


@query("a13_logical_clock", "SELECT user_id % 4 AS peer, max(event_id) AS clock, max(event_id) + 1 AS next FROM events GROUP BY 1")
def logical_clock(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("peer"), F.struct(F.col("event_id").alias("time")).alias("clock"))
    return sync.clocks(e, "peer")


@query("a15_latency_quantiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def latency_quantiles(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))


def overruling(spark, sf_dir):
    """supersedes edges from each order to its customer, contradicts edges from each supplier to its nation."""
    e = filters.relations(tables.business_edges(spark, sf_dir), rels=["PLACED_BY", "LOCATED_IN"])
    return e.withColumn("rel", F.when(F.col("rel") == "PLACED_BY", "supersedes").otherwise("contradicts"))


@query("g8_cross_tier", f"WITH {EDGES} SELECT id, src, dst, 'contradicts' AS rel FROM edges WHERE rel = 'LOCATED_IN'")
def cross_tier(spark, sf_dir):
    return filters.cross_tier(tables.business_nodes(spark, sf_dir), overruling(spark, sf_dir))


@query("g9_unlinked_adrs", f"WITH {NODES} SELECT id FROM nodes WHERE label = 'Adr' AND id NOT IN (SELECT 'S-' || s_suppkey FROM supplier WHERE s_nationkey < 10)")
def unlinked_adrs(spark, sf_dir):
    """Suppliers, once the edges to nations of key 10 and above are gone."""
    e = filters.relations(tables.business_edges(spark, sf_dir), "LOCATED_IN").where("CAST(substring(dst, 3) AS INT) < 10")
    return filters.unlinked_adrs(tables.business_nodes(spark, sf_dir), e).select("id")


@query("g12_supersedes_cycles", """WITH n AS (SELECT c_custkey AS k, row_number() OVER w AS i, count(*) OVER (PARTITION BY c_nationkey, c_custkey % 37) AS size, c_nationkey AS nation, c_custkey % 37 AS ring FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_custkey % 37 ORDER BY c_custkey))
SELECT CAST(a.k AS VARCHAR) AS seed, CAST(b.k AS VARCHAR) AS id FROM n a JOIN n b ON a.nation = b.nation AND a.ring = b.ring AND a.k <> b.k WHERE a.ring % 2 = 0""")
def supersedes_cycles(spark, sf_dir):
    """Customers supersede the next of their nation and group; in every other group the last one supersedes the first, so all of it supersede one another."""
    c = spark.sql("SELECT c_custkey AS k, c_custkey % 37 AS ring, lead(c_custkey) OVER w AS nxt, first_value(c_custkey) OVER w AS fst FROM {c} WINDOW w AS (PARTITION BY c_nationkey, c_custkey % 37 ORDER BY c_custkey)", c=tables.table(spark, sf_dir, "customer"))
    to = F.coalesce("nxt", F.when(F.col("ring") % 2 == 0, F.col("fst")))
    e = c.select(F.col("k").cast("string").alias("src"), to.cast("string").alias("dst")).where("dst IS NOT NULL")
    return sync.cyclic_supersedes(e)


@query("g12_contradictions", """WITH p AS (SELECT p_partkey AS k, p_size AS s FROM part), i AS (SELECT 'n' || k AS id, k AS a, k + 1 AS c FROM p WHERE s % 2 = 0 UNION ALL SELECT 'i' || k, k, k + 2 FROM p WHERE s % 2 = 0 AND k % 2 = 1), x AS (SELECT k AS a, k + 1 AS b FROM p WHERE s % 3 = 0)
SELECT id FROM i WHERE EXISTS (SELECT 1 FROM x JOIN i j ON j.a = x.b WHERE x.a = i.a AND j.c = i.c)""")
def contradictions(spark, sf_dir):
    """Parts imply (size even) the part two numbers up and their next; they contradict (size a multiple of 3) their next."""
    p = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    key = lambda c: c.cast("string")
    implies = p.where("s % 2 = 0").select(F.concat(F.lit("n"), key(F.col("k"))).alias("id"), key(F.col("k")).alias("src"), key(F.col("k") + 1).alias("dst"), F.lit("implies").alias("rel"))
    far = p.where("s % 2 = 0 AND k % 2 = 1").select(F.concat(F.lit("i"), key(F.col("k"))).alias("id"), key(F.col("k")).alias("src"), key(F.col("k") + 2).alias("dst"), F.lit("implies").alias("rel"))
    against = p.where("s % 3 = 0").select(F.concat(F.lit("c"), key(F.col("k"))).alias("id"), key(F.col("k")).alias("src"), key(F.col("k") + 1).alias("dst"), F.lit("contradicts").alias("rel"))
    return sync.contradictory_implications(implies.union(far).union(against)).select("id")


@query("p5_stream_state", LAST)
def stream_state(spark, sf_dir):
    """The events as a log in the shared folder, in several appends and batches, read as a stream; the state after its last batch."""
    path = f"{runtime.shared_folder(spark)}/stream-{uuid.uuid4()}"
    lines = event_lines(spark, sf_dir)
    for part in range(3):
        tables.append_log(lines.where(F.col("position") % 3 == part), f"{path}/log")
    q = log.to_table(log.read(spark, f"{path}/log", 10), f"{path}/state", f"{path}/checkpoint")
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    s = log.state(spark, f"{path}/state").where("kind = 'Node'")
    return s.select("id", F.col("clock.time").alias("time"), F.get_json_object("payload", "$.labels[0]").alias("label"), F.get_json_object("payload", "$.props.k").cast("bigint").alias("k"))
