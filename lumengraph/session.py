"""The store: tables of nodes and edges, and every operation on them as a method.

Tables are immutable DataFrames; a write replaces the store's reference by a new one, for nodes and edges at once. A write adds a step to the tables' plans and
moves nothing; every CUT_EVERY writes the tables are checkpointed. Reads are lazy. What a write changed waits as events for append_log().
Time is a parameter of the store (``clock``), so tests need no waiting.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime, schema
from .functions import ed25519, vector
from .operators import changes, clusters, filters, graph, importance, index, lexical, search, sync
from .plans import hql as language
from .runtime import checkpointed
from .sources import tables

#: Writes until the tables' lineage is cut, and sets of events until they are gathered.
CUT_EVERY, GATHER_EVERY = 16, 32
#: Tables of a snapshot beside nodes and edges, by the attribute that holds them.
MORE = {"vectors": "_vectors", "centroids": "centroids", "peers": "peers", "votes": "votes", "proposals": "proposals", "history": "history", "meta": "meta", "labels": "labels"}


class ReadOnly(PermissionError):
    pass


class NotFound(LookupError):
    pass


class Store:
    """nodes, edges: history tables. Columns that a read doesn't need may be missing, so read-only stores work over any projection.

    key: a secret of 32 bytes, with which the log is signed; the store's peer_id then is that of its public key.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, vectors: DataFrame | None = None, peer_id: str = "local", read_only: bool = False, clock: Callable[[], object] = lambda: dt.datetime.now(dt.timezone.utc), dim: int | None = None, key: bytes | None = None, aliases: dict[str, str] | None = None):
        self._nodes, self._edges, self.read_only, self.clock, self.dim, self.key = nodes, edges, read_only, clock, dim, key
        self.peer_id = sync.peer_of(ed25519.public_key(key)) if key else peer_id
        self.aliases = dict(aliases or {})
        self.spark: SparkSession = nodes.sparkSession
        self._vectors, self.centroids, self.history, self.meta, self.labels = vectors, None, None, None, None
        self.peers = self.spark.createDataFrame([], schema.PEER)
        self.proposals = self.spark.createDataFrame([], schema.PROPOSAL)
        self.votes = self.spark.createDataFrame([], schema.VOTE)
        self.time, self.snapshot_id, self._n_votes, self._writes = None, 0, 0, 0
        # What no log has yet; of a store over given tables all they hold.
        self._events: list[DataFrame] = []
        self._given, self._n_events, self.cells = True, 0, None

    @property
    def nodes(self) -> DataFrame:
        return self._nodes

    @nodes.setter
    def nodes(self, df: DataFrame) -> None:
        self._nodes = df

    @property
    def edges(self) -> DataFrame:
        return self._edges

    @edges.setter
    def edges(self, df: DataFrame) -> None:
        self._edges = df

    def _known(self) -> Store:
        """For a store whose tables a log or snapshot already has."""
        self._given = False
        return self

    @classmethod
    def empty(cls, spark: SparkSession, **more) -> Store:
        out = cls(*changes.empty(spark), **more)._known()
        out.time = 0
        return out

    @classmethod
    def load(cls, spark: SparkSession, path: str, log: str | None = None, **more) -> Store:
        """The last whole snapshot under the path; with a log, what was appended to it since is replayed onto the snapshot."""
        n = max(runtime.numbers(spark, path), default=None)
        root = path if n is None else runtime.numbered(path, n)
        t = tables.load_snapshot(spark, root)
        out = cls(t["nodes"], t["edges"], **more)._known()
        state = {} if n is None else json.loads(spark.read.text(f"{root}/state").first()[0])
        for name in state.get("tables", []):
            setattr(out, MORE[name], spark.read.parquet(f"{root}/{name}"))
        out.time, out.snapshot_id, out._n_votes = state.get("time"), state.get("snapshot_id", 0), state.get("votes", 0)
        if log is not None:
            tail = tables.read_log(spark, log, state.get("log", -1))
            if tail.limit(1).count():
                first = F.struct(F.lit("").alias("file"), F.lit(0).cast("bigint").alias("block"), F.monotonically_increasing_id().alias("line")).alias("position")
                out._replayed(tables.log_lines(out.nodes, out.edges).select(first, "line").union(tail))
        return out

    @classmethod
    def replay(cls, spark: SparkSession, path: str, **more) -> Store:
        """From an event log; lines that don't parse are skipped, signed and bare events are read alike."""
        out = cls(*changes.empty(spark), **more)._known()
        out._replayed(tables.read_log(spark, path))
        return out

    def _replayed(self, lines: DataFrame) -> None:
        r = checkpointed(tables.replay(lines))
        self._nodes, self._edges, self.time = tables.nodes_of(r), tables.edges_of(r), None

    # Writes

    def _write(self) -> None:
        if self.read_only:
            raise ReadOnly("the store is read-only")

    def _change(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> None:
        """Takes over new tables, both at once."""
        self._nodes, self._edges = self._nodes if nodes is None else nodes, self._edges if edges is None else edges
        self._writes += 1
        if self._writes % CUT_EVERY == 0:
            self._nodes, self._edges = checkpointed(self._nodes), checkpointed(self._edges)

    def _record(self, *events: DataFrame) -> None:
        """Events (event) for the log, in order."""
        for e in events:
            self._n_events += 1
            self._events.append(e.select(F.lit(self._n_events).alias("n"), "event"))
        if len(self._events) > GATHER_EVERY:
            self._events = [checkpointed(reduce(DataFrame.union, self._events))]

    def tick(self, n: int = 1) -> int:
        """The first of n new clock values."""
        first, self.time = self.logical_clock() + 1, self.logical_clock() + n
        return first

    def _checked(self, inputs: list[dict], system: bool = False) -> list[dict]:
        """The last input of each id; raises if any may not be written."""
        if any(self.dim and x.get("embedding") and len(x["embedding"]) != self.dim for x in inputs):
            raise ValueError(f"vectors must have {self.dim} dimensions")
        filters.govern_inputs([x.get("labels") or [] for x in inputs], system)
        return list({x.get("id") or i: x for i, x in enumerate(inputs)}.values())

    def add_nodes(self, inputs: list[dict], system: bool = False) -> DataFrame:
        """Checks them all before any is written. Of inputs with the same id the last counts."""
        self._write()
        inputs = self._checked(inputs, system)
        new = changes.node_rows(self.spark, inputs, self.clock(), self.logical_clock() + 1, self.peer_id)
        self.time += len(inputs)
        self._change(nodes=changes.put(self.nodes, new))
        self._record(tables.event_json(new, "Node"))
        return new

    def add_node(self, system: bool = False, **node) -> DataFrame:
        return self.add_nodes([node], system)

    def add_edges(self, inputs: list[dict], supersede: bool = False) -> DataFrame:
        self._write()
        inputs = list({x.get("id") or i: x for i, x in enumerate(inputs)}.values())
        now = self.clock()
        new = changes.edge_rows(self.spark, inputs, now, self.logical_clock() + 1, self.peer_id)
        self.time += len(inputs)
        if supersede:
            edges = changes.supersede_edges(self.edges, new, now)
            closed = edges.join(new.select(F.col("id").alias("superseded_by")), "superseded_by", "left_semi").where(F.col("valid_to") == filters.moment(now))
            self._record(tables.event_json(closed.select(*self.edges.columns), "Edge"))
            self._change(edges=edges)
        else:
            self._change(edges=changes.put(self.edges, new))
        self._record(tables.event_json(new, "Edge"))
        return new

    def add_edge(self, supersede: bool = False, **edge) -> DataFrame:
        """Ends go by the names from and to; from_ is taken for from."""
        return self.add_edges([{("from" if k == "from_" else k): v for k, v in edge.items()}], supersede)

    def execute_batch(self, nodes: list[dict], edges: list[dict]) -> dict[str, int]:
        """All or nothing: both kinds of rows are made before either table changes, and the log gets them as one event."""
        self._write()
        n_nodes, n_edges = len(nodes), len(edges)
        nodes, edges = self._checked(nodes), list({x.get("id") or i: x for i, x in enumerate(edges)}.values())
        now, first = self.clock(), self.logical_clock() + 1
        new = changes.node_rows(self.spark, nodes, now, first, self.peer_id)
        ties = changes.edge_rows(self.spark, edges, now, first + len(nodes), self.peer_id)
        self.time += len(nodes) + len(edges)
        self._change(changes.put(self.nodes, new), changes.put(self.edges, ties))
        both = tables.event_json(new, "Node").union(tables.event_json(ties, "Edge"))
        self._record(both.agg(F.concat(F.lit('{"Batch":['), F.array_join(F.collect_list("event"), ","), F.lit("]}")).alias("event")))
        return {"nodes": n_nodes, "edges": n_edges}

    def supersede_node(self, id_: str, props=None, caused_by: str | None = None) -> DataFrame:
        self._write()
        old = filters.live(filters.by_id(self.nodes, id_))
        found = old.select("labels").first()
        if not found:
            raise NotFound(id_)
        filters.govern_inputs([found.labels])
        now = self.clock()
        new = old.withColumn("clock", F.struct(F.lit(self.tick()).cast("bigint").alias("time"), F.lit(self.peer_id).alias("peer_id"))).withColumn("caused_by", F.lit(caused_by) if caused_by else F.col("caused_by"))
        if props is not None:
            new = new.withColumn("props", F.lit(props if isinstance(props, str) else json.dumps(props, separators=(",", ":"), ensure_ascii=False)))
        table = changes.supersede(self.nodes, checkpointed(new), now)
        at = filters.moment(now)
        self._record(*(tables.event_json(filters.by_id(table, id_).where(w), "Node") for w in (F.col("valid_to") == at, F.col("valid_to").isNull())))
        self._change(nodes=table)
        return filters.live(filters.by_id(self.nodes, id_))

    def retract_node(self, id_: str) -> None:
        """Gone with every edge that touches it; the log gets a tombstone. Unknown ids change nothing."""
        self._write()
        self._retract(self.spark.createDataFrame([(id_,)], "id string"))

    def _retract(self, ids: DataFrame) -> None:
        self._change(*changes.retract_nodes(self.nodes, self.edges, ids))
        self._record(tables.event_json(ids.select("id"), "DeleteNode"))

    def retract_edge(self, id_: str, at=None) -> DataFrame:
        self._write()
        self._change(edges=changes.close(self.edges, self.spark.createDataFrame([(id_,)], "id string"), at or self.clock()))
        own = filters.by_id(self.edges, id_)
        self._record(tables.event_json(own, "Edge"))
        return own

    # Reads

    @property
    def vectors(self) -> DataFrame:
        """(node_id, embedding): those given, else the current nodes'."""
        if self._vectors is not None:
            return self._vectors
        if "embedding" not in self.nodes.columns:
            return self.spark.createDataFrame([], "node_id string, embedding array<double>")
        return filters.live(self.nodes).where("embedding IS NOT NULL").select(F.col("id").alias("node_id"), "embedding")

    def scored(self) -> DataFrame:
        """Nodes with their derived impact where the columns are there; otherwise with the stored one."""
        if {"labels", "props", "impact"} <= set(self.nodes.columns):
            return importance.refreshed(self.nodes, self.edges)
        return self.nodes if "impact" in self.nodes.columns else self.nodes.withColumn("impact", F.lit(None).cast("double"))

    def query(self, **q) -> DataFrame:
        return filters.edge_query(self.edges, **q)

    def neighbors(self, seeds, depth: int | None = 1, **more) -> DataFrame:
        return graph.neighbors(self.nodes, self.edges, seeds, depth, **more)

    def hybrid_search(self, query, k: int, alpha: float = 0.5, lang: str | None = None, as_of=None, **more) -> DataFrame:
        return search.hybrid_search(self.vectors, self.scored(), query, k, alpha, lang, as_of, self.centroids, **more)

    def rebuild_index(self, **parameters) -> None:
        """Fits the index of nearest vectors anew; indexed_search() reads it."""
        self.cells = index.build(self.vectors.select("node_id", "embedding"), **parameters)

    def indexed_search(self, queries: DataFrame, k: int, **more) -> DataFrame:
        """(query_id, node_id, dist, rank) of queries (query_id, embedding), by the index; it is built where there is none."""
        if self.cells is None:
            self.rebuild_index(k=k)
        return index.nearest(self.cells, queries, k, **more)

    def ranked_context(self, query, k: int, **more) -> DataFrame:
        return self.hybrid_search(query, k, 0.4, **more)

    def retrieve_context(self, target: str, tier: str = "H1", budget: int | None = None, fuzzy: bool = False) -> dict:
        if fuzzy:
            target = self.resolve(target) or target
        return graph.context(filters.live(self.nodes), self.edges, target, tier, budget, self._summaries() if budget is not None else None)

    def resolve(self, text: str) -> str | None:
        """The identifier that the text means, exactly or nearly."""
        got = lexical.resolve(lexical.interned(self.nodes, self.edges), self.spark.createDataFrame([(text,)], "query string")).first()
        return got.id if got else None

    def semantic_verify(self, node: dict) -> bool:
        """Whether a new node may stand beside those of tier MASTER that resemble it."""
        return not node.get("embedding") or not search.conflicts(self.vectors, self.scored(), node["embedding"], list(node.get("labels") or []))

    def set_language_centroid(self, lang: str, centroid) -> None:
        self._write()
        new = self.spark.createDataFrame([(lang, [float(x) for x in centroid])], "lang string, centroid array<double>")
        self.centroids = new if self.centroids is None else self.centroids.where(F.col("lang") != lang).union(new)

    def hql(self, text: str):
        """Runs a query of the language: a DataFrame, or a package for CONTEXT."""
        c = language.parse(text)
        if isinstance(c, language.Search):
            return self.hybrid_search(c.vector, c.k, 0.0, c.lang, c.as_of)
        if isinstance(c, language.Match):
            return self.hybrid_search(c.vector, 10, c.alpha, c.lang, c.as_of)
        if isinstance(c, language.Traverse):
            seed = (self.resolve(c.seed) or c.seed) if c.fuzzy else c.seed
            return self.neighbors(seed, None if c.inferred else c.depth, rel=self.aliases.get(c.rel, c.rel) if c.inferred else c.rel, as_of=c.as_of)
        return self.retrieve_context(c.target, c.tier, c.budget if c.budget is not None else 32000, c.fuzzy)

    def hql_json(self, text: str) -> DataFrame:
        """(part, json): the result as JSON, an object a row."""
        out = self.hql(text)
        return graph.as_json(out) if isinstance(out, dict) else out.select(F.lit("row").alias("part"), F.to_json(F.struct(*out.columns)).alias("json"))

    # Clusters

    def detect_communities(self, rounds: int = 1) -> DataFrame:
        """(id, label) of nodes with a vector; the first labels are the ids."""
        first = self.vectors.select(F.col("node_id").alias("id"), F.col("node_id").alias("label"))
        self.labels = checkpointed(graph.communities(first, filters.live(self.edges), rounds))
        return self.labels

    def _members(self) -> DataFrame:
        label = self.labels if self.labels is not None else self.vectors.select(F.col("node_id").alias("id"), F.col("node_id").alias("label"))
        return label.join(filters.live(self.scored()).select("id", "impact", "labels"), "id").withColumn("cluster_id", F.xxhash64("label"))

    def _summaries(self) -> DataFrame:
        own = clusters.summaries(self._members(), self.vectors, self.snapshot_id, filters.moment(self.clock()))
        return own.withColumn("drift", F.lit(None).cast("double"))

    def generate_meta_graph(self) -> DataFrame:
        """One more snapshot of all cluster summaries, with drift since the one before; returns it."""
        self.snapshot_id += 1
        new = self._summaries().drop("drift")
        past = new if self.history is None else self.history.drop("drift").union(new)
        self.history = checkpointed(clusters.drift(past))
        self.meta = checkpointed(clusters.meta_edges(filters.live(self.edges), self._members()))
        return self.history.where(F.col("snapshot_id") == self.snapshot_id)

    def meta_history(self, cluster_id: int) -> DataFrame:
        return clusters.history_of(self.history, cluster_id)

    def structural_gaps(self, **more) -> DataFrame:
        return clusters.gaps(self._summaries(), self.meta, **more)

    def meta_neighbors(self, seeds, depth: int = 1) -> DataFrame:
        """Traversal over themes: clusters that edges tie to those of the seeds."""
        e = self.meta.select(F.concat_ws(">", F.col("from_cluster").cast("string"), F.col("to_cluster").cast("string")).alias("id"), F.col("from_cluster").cast("string").alias("src"), F.col("to_cluster").cast("string").alias("dst"), F.lit("meta").alias("rel"), F.lit(None).cast("timestamp").alias("valid_to"))
        n = e.select(F.col("src").alias("id"), "valid_to").union(e.select("dst", "valid_to")).distinct()
        return graph.neighbors(n, e, [str(s) for s in seeds], depth)

    # Replication and consensus

    def logical_clock(self) -> int:
        if self.time is None:
            self.time = changes.clock_of(self.nodes, self.edges)
        return self.time

    def add_peer(self, peer_id: str, public_key: bytes) -> None:
        self.peers = self.peers.where(F.col("peer_id") != peer_id).union(self.spark.createDataFrame([(peer_id, bytearray(public_key))], schema.PEER))

    def reconcile(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> None:
        """Merges remote rows by clock; the own clock never falls behind what it has seen. The log gets the rows that applied."""
        self._write()
        own, new = self.logical_clock(), {}
        for name, kind, remote in (("nodes", "Node", nodes), ("edges", "Edge", edges)):
            if remote is not None:
                new[name] = checkpointed(sync.merge(getattr(self, name), remote))
                self._record(tables.event_json(new[name].join(remote.select("id", "clock"), ["id", "clock"], "left_semi").select(*new[name].columns), kind))
        self._change(**new)
        self.time = max(own, changes.clock_of(self.nodes, self.edges))

    def reconcile_signed(self, events: DataFrame, verify=ed25519.verified) -> None:
        """Events (signer, payload, signature), a line of the log as payload; those of unknown signers or without a valid signature are left out."""
        good = sync.trusted(events, self.peers, self.peer_id, verify)
        lines = good.select(F.monotonically_increasing_id().alias("position"), F.col("payload").alias("line"))
        e = sync.latest(tables.events(lines).withColumn("key", F.concat_ws(":", "kind", "id")).withColumn("clock", F.struct("time", "peer_id", "position", "sub")), key="key")
        e = checkpointed(e)
        self.reconcile(tables.nodes_of(e), tables.edges_of(e))

    def propose(self, proposal_id: str, ids: DataFrame) -> str:
        """ids: (id) of the nodes that should become MASTER."""
        self._write()
        own = ids.select(F.lit(proposal_id).alias("proposal_id"), "id")
        self.proposals = checkpointed(self.proposals.where(F.col("proposal_id") != proposal_id).union(own))
        return proposal_id

    def vote(self, proposal_id: str, peer_id: str, approve: bool) -> bool:
        """Whether the proposal has its majority now; then its nodes are MASTER."""
        self._write()
        ids = self.proposals.where(F.col("proposal_id") == proposal_id).select("id")
        if not ids.limit(1).count():
            raise NotFound(proposal_id)
        self.votes = self.votes.union(self.spark.createDataFrame([(proposal_id, peer_id, approve, self._n_votes)], schema.VOTE))
        self._n_votes += 1
        if self._n_votes % CUT_EVERY == 0:
            self.votes = checkpointed(self.votes)
        ok = bool(sync.tally(self.votes.where(F.col("proposal_id") == proposal_id), self.peers.count()).where("accepted").count())
        if ok:
            nodes = sync.promote(self.nodes, ids)
            self._record(tables.event_json(nodes.join(ids, "id", "left_semi").select(*nodes.columns), "Node"))
            self._change(nodes=nodes)
        return ok

    def merkle_root(self) -> str:
        lines = tables.log_lines(self.nodes, self.edges).select(F.struct(F.xxhash64("line"), "line").alias("position"), "line")
        return sync.digest(lines).first()[0]

    # Maintenance

    def prune(self) -> DataFrame:
        """Expired nodes and orphans go; (id) of them comes back."""
        self._write()
        ids = checkpointed(changes.to_prune(self.nodes, self.edges, self.clock()))
        self._retract(ids)
        return ids

    def optimize(self) -> DataFrame:
        out = self.prune()
        self.generate_meta_graph()
        return out

    def compact(self, log: str | None = None) -> None:
        """Only current rows stay; a log is written anew with them, and its older folders go."""
        self._write()
        nodes, edges = changes.compact(self.nodes, self.edges, self.clock())
        self.nodes, self.edges = checkpointed(nodes), checkpointed(edges)
        if log is not None:
            self._events, self._given = [], True
            last = self.append_log(log)
            for n in runtime.numbers(self.spark, log):
                if n < last:
                    runtime.delete(self.spark, runtime.numbered(log, n))

    def compact_vectors(self) -> int:
        """Drops vectors of nodes that are gone; the number that stays."""
        if self._vectors is not None:
            self._vectors = checkpointed(changes.compact_vectors(self._vectors, filters.live(self.nodes)))
        return self.vectors.count()

    def save(self, path: str, log: str | None = None, keep: int = 2) -> int:
        """Everything the store holds as the next numbered snapshot under the path; its number. It counts once it is whole, and older ones than the last few go.

        With a log, what waits is appended first, and the snapshot knows how far the log had come.
        """
        mark = self.append_log(log) if log is not None else -1
        n = max(runtime.numbers(self.spark, path), default=-1) + 1
        root = runtime.numbered(path, n)
        more = {name: df for name, at in MORE.items() if (df := getattr(self, at)) is not None}
        tables.save_snapshot({"nodes": self.nodes, "edges": self.edges} | more, root)
        state = {"time": self.logical_clock(), "snapshot_id": self.snapshot_id, "votes": self._n_votes, "log": mark, "tables": [*more]}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/state")
        runtime.finish(self.spark, root)
        # From here on the store reads what it wrote, not what may go.
        for name in ("nodes", "edges", *more):
            setattr(self, {"nodes": "_nodes", "edges": "_edges"}.get(name) or MORE[name], self.spark.read.parquet(f"{root}/{name}"))
        for old in runtime.numbers(self.spark, path)[:-keep]:
            runtime.delete(self.spark, runtime.numbered(path, old))
        return n

    def append_log(self, path: str) -> int:
        """Writes the events since the last call, signed if the store has a key; the number of the log's last folder."""
        if self._given:
            given = [tables.event_json(df, kind) for df, kind in ((self.nodes, "Node"), (self.edges, "Edge"))]
            self._events, self._given = [e.select(F.lit(0).alias("n"), "event") for e in given], False
        if not self._events:
            return max(runtime.numbers(self.spark, path), default=-1)
        lines = tables.as_lines(reduce(DataFrame.union, self._events), "n", peer_id=self.peer_id, key=self.key)
        n = tables.append_log(lines, path, "n")
        self._events = []
        return n

    def status(self) -> dict:
        memory = self.spark._jvm.java.lang.Runtime.getRuntime().totalMemory() >> 20
        return {"engine": schema.ENGINE_NAME, "schema_version": schema.SCHEMA_VERSION, "open": True, "read_only": self.read_only, "clock": self.logical_clock(), "memory_mb": memory}


def nearest_language(centroids: DataFrame, query) -> DataFrame:
    """Languages by the distance of their centroid from a vector, nearest first."""
    return centroids.select("lang", vector.l2(F.col("centroid"), vector.literal(query)).alias("dist")).orderBy("dist", "lang")
