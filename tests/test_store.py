"""The store's operations on small graphs."""

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lumengraph.functions import ed25519
from lumengraph.operators import filters, index, search
from lumengraph.session import NotFound, ReadOnly, Store
from lumengraph.sources import tables
from lumengraph.streaming import log

NOW = dt.datetime(2026, 6, 1, tzinfo=dt.timezone.utc)


def ids(df, c="id"):
    return {r[c] for r in df.select(c).collect()}


@pytest.fixture
def store(spark):
    return Store.empty(spark, clock=lambda: NOW)


def chain(store):
    store.add_nodes([{"id": x, "props": {"text": x * 3}} for x in "ABC"])
    store.add_edges([{"id": "E1", "from": "A", "to": "B", "rel": "knows"}, {"id": "E2", "from": "B", "to": "C", "rel": "knows"}])
    return store


def test_traverse_one_step(store):
    chain(store)
    assert ids(store.hql("TRAVERSE FROM A DEPTH 1 REL knows")) == {"B"}
    assert ids(store.hql("TRAVERSE FROM A DEPTH 2 REL ANY")) == {"B", "C"}
    assert ids(store.hql("TRAVERSE FROM A DEPTH 1 REL INFER(knows)")) == {"B", "C"}
    assert ids(store.hql("TRAVERSE FROM nobody DEPTH 3 REL knows")) == set()
    assert ids(store.neighbors("A", 0)) == set()


def test_search_finds_the_nearest(store):
    store.add_nodes([{"id": "v1", "embedding": [1, 0, 0]}, {"id": "v2", "embedding": [0, 1, 0]}])
    assert [r.id for r in store.hql("SEARCH Node SIMILAR TO [0.9, 0.1, 0.0] K 1").collect()] == ["v1"]
    assert len(store.hql("MATCH Node SIMILAR TO [0.9, 0.1, 0.0] ALPHA 0.5").collect()) == 2


def test_context_tiers(store):
    chain(store)
    package = lambda tier, **more: store.retrieve_context("A", tier, **more)
    assert ids(package("H0")["nodes"]) == {"A"} and not package("H0")["edges"].count()
    assert ids(package("H1")["nodes"]) == {"A", "B"} and ids(package("H1")["edges"]) == {"E1"}
    assert ids(package("H2")["nodes"]) == {"A", "B", "C"}
    assert "H2" in package("H2")["trace"]
    assert not store.retrieve_context("nobody")["nodes"].count()


def test_budget(store):
    store.add_node(id="A", props={"text": "x" * 100}, embedding=[0.1] * 8)
    p = store.retrieve_context("A", "H1", 10)
    assert not p["nodes"].count() and not p["edges"].count() and p["super_nodes"].count()
    assert store.hql("CONTEXT FOR A TIER H1 BUDGET 5000")["nodes"].count() == 1


def test_as_of(store):
    store.add_nodes([{"id": "Concept-A", "valid_from": "2024-01-01T00:00:00Z"}, {"id": "Concept-B", "valid_from": "2024-01-01T00:00:00Z"}, {"id": "Concept-C", "valid_from": "2026-01-01T00:00:00Z"}])
    store.add_edges([{"id": "E1", "from": "Concept-A", "to": "Concept-B", "rel": "r", "valid_from": "2024-02-01T00:00:00Z"}, {"id": "E2", "from": "Concept-A", "to": "Concept-C", "rel": "r", "valid_from": "2026-02-01T00:00:00Z"}])
    at = lambda t: ids(store.hql(f'TRAVERSE FROM Concept-A DEPTH 1 REL r AS OF "{t}"'))
    assert at("2024-06-01T00:00:00Z") == {"Concept-B"} == at("2025-01-01T00:00:00Z")
    assert at("2027-01-01T00:00:00Z") == {"Concept-B", "Concept-C"}
    assert at("2024-01-15T00:00:00Z") == set()


def test_expired_nodes_go_with_their_edges(spark):
    now = [NOW]
    s = Store.empty(spark, clock=lambda: now[0])
    s.add_nodes([{"id": "ephemeral-1", "ttl": 2}, {"id": "durable-1"}, {"id": "durable-2"}])
    s.add_edges([{"from": "durable-1", "to": "ephemeral-1", "rel": "r"}, {"from": "durable-1", "to": "durable-2", "rel": "r"}])
    now[0] = NOW + dt.timedelta(seconds=3)
    assert ids(s.optimize()) == {"ephemeral-1"}
    assert ids(s.nodes) == {"durable-1", "durable-2"} and s.edges.count() == 1


def test_orphans_go_but_not_masters(store):
    store.add_nodes([{"id": "alone"}, {"id": "axiom", "labels": ["MASTER"]}], system=True)
    assert ids(store.prune()) == {"alone"}


def test_governance_and_batches(store):
    with pytest.raises(filters.Forbidden, match="403 Forbidden"):
        store.add_node(id="m", labels=["master"])
    store.add_node(id="u", labels=["USER"])
    with pytest.raises(filters.Forbidden):
        store.execute_batch([{"id": "x", "labels": ["USER"]}, {"id": "y", "labels": ["MASTER"]}], [])
    assert ids(store.nodes) == {"u"}
    assert store.execute_batch([{"id": "x"}], [{"from": "x", "to": "x", "rel": "self"}]) == {"nodes": 1, "edges": 1}


def test_retract(store):
    chain(store)
    store.retract_node("A")
    assert ids(store.edges) == {"E2"} and ids(store.nodes) == {"B", "C"}
    store.retract_node("nobody")
    store.retract_edge("E2")
    assert not filters.live(store.edges).count() and store.edges.count() == 1


def test_supersede_keeps_history(store):
    store.add_node(id="A", props={"v": 1}, valid_from="2024-01-01T00:00:00Z")
    store.supersede_node("A", {"v": 2}, caused_by="why")
    assert store.nodes.count() == 2
    assert [r.props for r in filters.as_of(store.nodes, "2025-01-01T00:00:00Z").collect()] == ['{"v":1}']
    assert [(r.props, r.caused_by) for r in filters.live(store.nodes).collect()] == [('{"v":2}', "why")]
    with pytest.raises(NotFound):
        store.supersede_node("nobody")


def test_superseding_edges(store):
    chain(store)
    store.add_edge(supersede=True, id="E9", from_="A", to="B", rel="knows")
    assert {(r.id, r.superseded_by) for r in store.edges.collect()} == {("E1", "E9"), ("E2", None), ("E9", None)}
    assert ids(store.query(src="A", dst="B")) == {"E9"}
    assert ids(store.query(src="A", include_invalid=True, limit=1)) == {"E1"}


def test_dimension_and_compaction(spark):
    s = Store.empty(spark, clock=lambda: NOW, dim=3)
    with pytest.raises(ValueError):
        s.add_node(id="x", embedding=[1.0])
    s.add_nodes([{"id": f"node_{i}", "embedding": [i, 0, 0]} for i in range(100)])
    s._retract(spark.createDataFrame([(f"node_{i}",) for i in range(90)], "id string"))
    assert s.compact_vectors() == 10
    assert s.hybrid_search([99, 0, 0], 1, 0.0).first().id == "node_99"


def test_snapshot_and_log(store, spark, tmp_path):
    store.add_node(id="persist_1", embedding=[0.5] * 4, props={"k": "บ้าน"})
    chain(store)
    store.save(str(tmp_path / "snap"))
    again = Store.load(spark, str(tmp_path / "snap"))
    assert ids(again.nodes) == {"persist_1", "A", "B", "C"} and again.vectors.count() == 1 and again.logical_clock() == store.logical_clock()
    store.append_log(str(tmp_path / "log"))
    back = Store.replay(spark, str(tmp_path / "log"))
    assert {tuple(r) for r in back.nodes.select("id", "props", "clock.time").collect()} == {tuple(r) for r in store.nodes.select("id", "props", "clock.time").collect()}
    assert {tuple(r) for r in back.edges.select("id", "src", "dst").collect()} == {tuple(r) for r in store.edges.select("id", "src", "dst").collect()}
    assert back.merkle_root() != Store.empty(spark).merkle_root() == "0" * 64


def test_log_of_either_shape(spark, tmp_path):
    (tmp_path / "a.wal").write_text(
        '{"Node":{"id":"n","labels":["L"],"props":{"a":1}}}\nnonsense\n'
        '{"event":{"Batch":{"nodes":[{"id":"b"}],"edges":[{"id":"e","from":"n","to":"b","rel":"r"}]}},"signature":[1],"signer_peer_id":"p"}\n'
        '{"Node":{"id":"n","labels":["L"],"props":{"a":2}}}\n{"Node":{"id":"gone"}}\n{"Delete":{"id":"gone"}}\n'
    )
    s = Store.replay(spark, str(tmp_path / "a.wal"))
    assert {(r.id, r.props) for r in s.nodes.collect()} == {("n", '{"a":2}'), ("b", None)}
    assert [(r.id, r.src, r.dst) for r in s.edges.collect()] == [("e", "n", "b")]


def test_batches_in_the_log(spark, tmp_path):
    """Lists of events, lists in lists; an event of a batch counts by its place."""
    (tmp_path / "a.wal").write_text(
        '{"Batch":[{"Node":{"id":"a","props":{"v":1}}},{"Edge":{"id":"e","from":"a","to":"b","rel":"r"}},{"Batch":[{"Node":{"id":"b"}},{"Batch":[{"Node":{"id":"a","props":{"v":2}}}]}]}]}\n'
        '{"event":{"Batch":[{"Node":{"id":"c"}}]},"signature":[1],"signer_peer_id":"p"}\n{"Batch":[]}\n{"Batch":[{"Delete":{"id":"c"}}]}\n'
    )
    s = Store.replay(spark, str(tmp_path / "a.wal"))
    assert {(r.id, r.props) for r in s.nodes.collect()} == {("a", '{"v":2}'), ("b", None)} and ids(s.edges) == {"e"}


def test_later_files_count_whatever_their_size(spark, tmp_path):
    (tmp_path / "1.wal").write_text('{"Node":{"id":"x","props":{"v":1}}}\n')
    (tmp_path / "2.wal").write_text('{"Node":{"id":"x","props":{"v":0}}}\n' * 5000 + '{"Node":{"id":"x","props":{"v":2}}}\n')
    (tmp_path / "3.wal").write_text('{"Node":{"id":"y"}}\n' * 100)
    assert {(r.id, r.props) for r in Store.replay(spark, str(tmp_path)).nodes.collect()} == {("x", '{"v":2}'), ("y", None)}


def state(s):
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.drop("embedding").collect())
    return rows(s.nodes), rows(s.edges)


def test_log_gives_the_store_back(spark, tmp_path):
    """Writes, retractions, versions and batches, appended in several steps; only what is new is appended."""
    now, log = [NOW], str(tmp_path / "log")
    s = Store.empty(spark, clock=lambda: now[0])
    chain(s)
    assert s.append_log(log) == 0
    now[0] += dt.timedelta(seconds=1)
    s.supersede_node("B", {"v": 2})
    s.retract_node("A")
    s.add_edge(id="E3", from_="C", to="B", rel="knows")
    s.append_log(log)
    now[0] += dt.timedelta(seconds=1)
    s.add_edge(supersede=True, id="E4", from_="C", to="B", rel="knows")
    s.add_node(id="A", props={"back": True})
    s.execute_batch([{"id": "D"}], [{"id": "E5", "from": "D", "to": "A", "rel": "r"}])
    s.retract_edge("E5")
    last = s.append_log(log)
    assert s.append_log(log) == last == 2 and spark.read.text(f"{log}/0000000002").count() == 5
    back = Store.replay(spark, log)
    assert state(back) == state(s) and back.logical_clock() == s.logical_clock()
    assert ids(filters.as_of(back.nodes, NOW + dt.timedelta(milliseconds=500))) == {"B", "C"}
    s.compact(log)
    assert state(Store.replay(spark, log)) == state(s) and len(list((tmp_path / "log").iterdir())) == 1


def test_snapshots_hold_everything(spark, tmp_path):
    s, path, log = Store.empty(spark, clock=lambda: NOW), str(tmp_path / "snap"), str(tmp_path / "log")
    s.add_nodes([{"id": "n1", "embedding": [1, 0]}, {"id": "n2", "embedding": [1, 0]}])
    s.add_edge(id="e", from_="n1", to="n2", rel="r")
    s.set_language_centroid("th", [1.0])
    s.add_peer("p", b"k"), s.add_peer("q", b"k")
    s.propose("x", spark.createDataFrame([("n1",)], "id string"))
    s.vote("x", "p", True)
    s.detect_communities(3), s.generate_meta_graph()
    assert s.save(path, log) == 0
    s.add_node(id="late")
    s.append_log(log)
    back = Store.load(spark, path, log, clock=lambda: NOW)
    assert ids(back.nodes) == {"n1", "n2", "late"} and back.snapshot_id == 1 and back.history.count() == s.history.count() == 2 and back.logical_clock() == s.logical_clock()
    assert back.centroids.first().lang == "th" and back.peers.count() == 2 and back.labels.count() == 2
    assert back.vote("x", "q", True) and "MASTER" in back.nodes.where("id = 'n1'").first().labels
    assert ids(Store.load(spark, path).nodes) == {"n1", "n2"}
    back.save(path, keep=1)
    assert len(list((tmp_path / "snap").iterdir())) == 1 and ids(Store.load(spark, path).nodes) == {"n1", "n2", "late"}


def test_a_batch_with_a_bad_edge_changes_nothing(store):
    store.add_node(id="x")
    for edges in ([{"from": "x", "rel": "r"}], [{"from": "x", "to": "x", "rel": "r", "valid_from": "no time"}]):
        with pytest.raises((KeyError, ValueError)):
            store.execute_batch([{"id": "Q"}], edges)
    assert ids(store.nodes) == {"x"} and not store.edges.count() and store.logical_clock() == 1


def test_many_small_writes(store, monkeypatch):
    """Writes move nothing until lineage is cut; what they leave doesn't depend on when that is."""
    for i in range(20):
        store.add_node(id=f"n{i % 7}", props={"v": i})
    assert {(r.id, r.props) for r in store.nodes.collect()} == {(f"n{i % 7}", f'{{"v":{i}}}') for i in range(13, 20)}
    assert store.logical_clock() == 20


def test_repeated_ids_in_one_call(store):
    store.add_nodes([{"id": "a", "props": {"v": 1}}, {"id": "a", "props": {"v": 2}}, {}, {}])
    assert store.nodes.count() == 3 and store.nodes.where("id = 'a'").first().props == '{"v":2}'
    assert all(re.fullmatch(r"N-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", i) for i in ids(store.nodes) - {"a"})


def test_signed_logs(spark, tmp_path):
    secret = bytes(range(32))
    s = Store.empty(spark, clock=lambda: NOW, key=secret)
    s.add_node(id="a", props={"k": "บ้าน"})
    s.append_log(str(tmp_path / "log"))
    r = json.loads(spark.read.text(str(tmp_path / "log/0000000000")).first()[0])
    assert r["signer_peer_id"] == s.peer_id and len(r["signature"]) == 64 and ids(Store.replay(spark, str(tmp_path / "log")).nodes) == {"a"}
    other = Store.empty(spark)
    other.add_peer(s.peer_id, ed25519.public_key(secret))
    e = tables.event_json(s.nodes, "Node").first()[0]
    other.reconcile_signed(spark.createDataFrame([(s.peer_id, e, bytearray(r["signature"]))], "signer string, payload string, signature binary"))
    assert ids(other.nodes) == {"a"}


def test_reconcile_keeps_history(store, spark):
    store.add_node(id="A", props={"v": 1}, valid_from="2024-01-01T00:00:00+00:00")
    store.supersede_node("A", {"v": 2})
    remote = filters.live(store.nodes).withColumn("props", F.lit('{"v":3}')).withColumn("clock", F.struct(F.lit(9).cast("bigint").alias("time"), F.lit("z").alias("peer_id"))).withColumn("valid_from", F.expr("valid_from + INTERVAL 1 HOUR"))
    store.reconcile(remote)
    assert {(r.props, r.valid_to is None) for r in store.nodes.collect()} == {('{"v":1}', False), ('{"v":3}', True)}


def test_gossip_by_files(spark, tmp_path):
    """Events that other peers leave in a folder are merged as they come."""
    s = Store.empty(spark, clock=lambda: NOW)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1").write_text('{"Node":{"id":"x","clock":{"time":7,"peer_id":"p"}}}\n')
    q = log.read(spark, str(tmp_path / "in")).writeStream.foreachBatch(lambda b, _: s.reconcile_signed(b.select(F.lit("local").alias("signer"), F.col("line").alias("payload"), F.lit(None).cast("binary").alias("signature")))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None and ids(s.nodes) == {"x"} and s.logical_clock() == 7


def test_language_forms(store):
    chain(store)
    store.aliases["reports"] = "knows"
    assert ids(store.hql("TRAVERSE FROM A DEPTH 1 REL INFER(reports)")) == {"B", "C"}
    rows = {(r.part, json.loads(r.json).get("id")) for r in store.hql_json("CONTEXT FOR A TIER H1").collect()}
    assert rows == {("head", None), ("nodes", "A"), ("nodes", "B"), ("edges", "E1")}
    assert [json.loads(r.json)["id"] for r in store.hql_json("TRAVERSE FROM A DEPTH 1 REL knows").collect()] == ["B"]


def test_the_index_finds_neighbours(store, spark):
    r = random.Random(2)
    store.add_nodes([{"id": f"v{i}", "embedding": [r.gauss(0, 1) + 9 * (i % 5) for _ in range(6)]} for i in range(300)])
    q = store.vectors.where("node_id IN ('v0', 'v7')").withColumnRenamed("node_id", "query_id")
    store.rebuild_index(k=5, cell_rows=30)
    got = sorted(map(tuple, store.indexed_search(q, 5).collect()))
    want = sorted(map(tuple, search.nearest_many(store.vectors, q, 5).collect()))
    assert len({g[:2] for g in got} & {w[:2] for w in want}) >= 9 and len(got) == 10
    more = store.cells.insert(spark.createDataFrame([("new", store.vectors.where("node_id = 'v0'").first().embedding), ("odd", [1.0])], "node_id string, embedding array<double>"))
    assert {(x.node_id, x.dist) for x in index.nearest(more, q.where("query_id = 'v0'"), 2).collect()} == {("v0", 0.0), ("new", 0.0)}


def test_read_only(spark):
    s = Store.empty(spark, read_only=True)
    for write in (lambda: s.add_node(id="x"), lambda: s.vote("p", "a", True), lambda: s.set_language_centroid("th", [1.0]), lambda: s.propose("p", s.nodes.select("id"))):
        with pytest.raises(ReadOnly):
            write()


def replica(spark, props, clock, **more):
    s = Store.empty(spark, clock=lambda: NOW, **more)
    s.add_node(id="node-1", props=props)
    s.nodes = s.nodes.withColumn("clock", F.struct(F.lit(clock).cast("bigint").alias("time"), F.lit("p").alias("peer_id")))
    s.time = clock
    return s


def test_last_writer_wins_either_way(spark):
    a, b = replica(spark, {"v": "Version A"}, 2), replica(spark, {"v": "Version B"}, 10)
    na, nb = a.nodes, b.nodes
    a.reconcile(nb), b.reconcile(na)
    assert {r.props for s in (a, b) for r in s.nodes.collect()} == {'{"v":"Version B"}'}
    c = replica(spark, {}, 1)
    c.reconcile(replica(spark, {}, 100).nodes)
    assert c.logical_clock() == 100 and c.tick() == 101


def test_forged_and_unknown_signatures(spark):
    s = Store.empty(spark, clock=lambda: NOW)
    s.add_peer("known", b"key")
    line = lambda i: f'{{"Node":{{"id":"{i}","clock":{{"time":5,"peer_id":"p"}}}}}}'
    secret = b"s" * 32
    s.add_peer("signs", ed25519.public_key(secret))
    good = line("good")
    e = [("known", line("forged"), bytearray(64)), ("stranger", line("strange"), bytearray(b"x")), ("known", line("odd"), bytearray(b"sig")), ("signs", line("other"), bytearray(ed25519.sign(secret, good.encode()))), ("signs", good, bytearray(ed25519.sign(secret, good.encode()))), ("signs", line("none"), None)]
    e = spark.createDataFrame(e, "signer string, payload string, signature binary")
    s.reconcile_signed(e, verify=None)
    assert not ids(s.nodes)
    s.reconcile_signed(e)
    assert ids(s.nodes) == {"good"} and s.logical_clock() == 5


def test_votes(store, spark):
    store.add_node(id="n", labels=["Note"])
    for p in "abc":
        store.add_peer(p, b"k")
    store.propose("p1", spark.createDataFrame([("n",)], "id string"))
    assert not store.vote("p1", "a", True) and not store.vote("p1", "a", True)
    assert store.vote("p1", "b", True)
    assert store.nodes.first().labels == ["Note", "MASTER"]
    with pytest.raises(NotFound):
        store.vote("p2", "a", True)


def test_drift_and_history(store):
    store.add_nodes([{"id": "node-1", "embedding": [1, 0]}, {"id": "node-2", "embedding": [1, 0]}])
    store.add_edge(from_="node-1", to="node-2", rel="r")
    store.detect_communities(5)
    first = store.generate_meta_graph()
    assert {r.drift for r in first.collect()} == {None}
    store.add_node(id="node-3", embedding=[0, 1])
    store.add_edge(from_="node-3", to="node-2", rel="r")
    store.detect_communities(5)
    second = store.generate_meta_graph().collect()
    assert any(r.drift is not None for r in second)
    kept = next(r.cluster_id for r in second if r.drift is not None)
    assert store.meta_history(kept).count() == 2


def test_language_shift_and_verification(store):
    store.add_nodes([{"id": "m", "labels": ["MASTER"], "embedding": [1, 0]}, {"id": "n", "embedding": [0, 1]}], system=True)
    store.set_language_centroid("th", [-1.0, 1.0])
    assert store.hybrid_search([1, 0], 1, 0.0, lang="th").first().id == "n"
    assert store.hybrid_search([1, 0], 1, 0.0, lang="unset").first().id == "m"
    assert store.semantic_verify({"labels": ["Note"]})
    store.add_edges([{"from": f"x{i}", "to": "m", "rel": "r"} for i in range(10)])
    assert not store.semantic_verify({"labels": ["Note"], "embedding": [1, 0]})
    assert store.semantic_verify({"labels": ["MASTER"], "embedding": [1, 0]})


def test_thai_identifiers(store):
    store.add_node(id="บ้าน")
    for t in ("บาน", "บ้น", "บ้าน"):
        assert store.resolve(t) == "บ้าน"
    assert store.resolve("zzz") is None


def test_status(store):
    assert store.status()["open"] and store.status()["schema_version"] == 1
