"""Approximate nearest neighbours: a hierarchical navigable small-world graph (Malkov and Yashunin 2016) per shard.

Rows are dealt to cells by the nearest of some centroids, which are fitted on a bounded sample; a cell of more than ``shard_rows`` is
split further by a hash of the id, so a shard never grows with the table. A shard's graph is kept as flat arrays: the nodes
of each level, and a row of neighbour numbers a node, -1 where there is none. Equal vectors are one node, which holds all their ids, so a
group of copies of any size can neither fill the lists of neighbours nor hide what lies around it.

A query visits the shards of its nearest cells, as many as hold ``target`` of the neighbours of held-out rows of the sample: few
where the vectors form groups, most of them where they don't. The k nearest of all answers stay. Searching works on many queries in
step: each step expands the nearest unexpanded candidates of all queries of a batch.

Points are inserted in batches that double the graph, those with the highest level first; a shard being bounded, the candidates
of an inserted point come from matrix products with what is there instead of a search, and are pruned to diverse ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

NEIGHBOURS, DEGREE, EF_BUILD, EF_SEARCH, SHARD_ROWS, SEED = 10, 20, 64, 96, 8192, 9
#: The sample that the centroids of a dimension are fitted on, and the most centroids; what share of the sample's neighbours the visited cells must hold.
SAMPLE_ROWS, MAX_CELLS, TARGET = 16384, 1024, 0.98
#: Rows whose id this divides are the registered query's queries. Rows of a block of queries.
EVERY, QUERY_BLOCK = 100, 8192
_FAR = np.float32(np.inf)
GRAPH = "dim int, cell int, part int, ids binary, starts binary, vectors binary, nodes array<binary>, links array<binary>"


class Graph:
    """vectors of the nodes; ids of all rows, node by node from starts on; by level (from 0 up) the nodes that are on it and their rows of neighbours."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, vectors: np.ndarray, nodes: list[np.ndarray], links: list[np.ndarray]):
        self.ids, self.starts, self.vectors, self.nodes, self.links = ids, starts, vectors, nodes, links
        self.norms = np.einsum("nd,nd->n", vectors, vectors)
        self.row = []
        for own in nodes:
            self.row.append(np.full(len(vectors), -1, np.int32))
            self.row[-1][own] = np.arange(len(own), dtype=np.int32)

    def beam(self, queries: np.ndarray, start: np.ndarray, level: int, ef: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and squared distances of the ef nearest found on a level by query, nearest first; -1 and infinity where there are fewer."""
        row, links, n = self.row[level], self.links[level], len(queries)
        found, far = np.full((n, ef), -1, np.int32), np.full((n, ef), _FAR, np.float32)
        length = np.einsum("nd,nd->n", queries, queries)
        seen = np.zeros((n, len(self.vectors)), bool)
        k = min(ef, start.shape[1])
        first = np.einsum("nd,nkd->nk", queries, self.vectors[start])
        first = self.norms[start] - 2 * first + length[:, None]
        order = np.argsort(first, axis=1, kind="stable")[:, :k]
        found[:, :k], far[:, :k] = np.take_along_axis(start, order, 1), np.take_along_axis(first, order, 1)
        np.put_along_axis(seen, start, True, 1)
        done = found < 0
        live = np.arange(n)
        while len(live):
            at = np.argsort(done[live], axis=1, kind="stable")[:, :width]
            fresh = ~np.take_along_axis(done[live], at, 1)
            some = fresh.any(axis=1)
            live, at, fresh = live[some], at[some], fresh[some]
            if not len(live):
                break
            who = np.take_along_axis(found[live], at, 1)
            done[live[:, None], at] = True
            near = np.where(fresh[:, :, None], links[row[np.where(fresh, who, self.nodes[level][0])]], -1).reshape(len(live), -1)
            ok = near >= 0
            near = np.where(ok, near, 0)
            ok &= ~seen[live[:, None], near]
            # The same neighbour of two expanded nodes counts once.
            by = np.argsort(np.where(ok, near, -1), axis=1, kind="stable")
            s = np.take_along_axis(np.where(ok, near, -1), by, 1)
            twice = np.zeros_like(ok)
            np.put_along_axis(twice, by[:, 1:], s[:, 1:] == s[:, :-1], 1)
            ok &= ~twice
            seen[live[:, None].repeat(near.shape[1], 1)[ok], near[ok]] = True
            most = int(ok.sum(axis=1).max())
            if not most:
                continue
            pack = np.argsort(~ok, axis=1, kind="stable")[:, :most]
            near, ok = np.take_along_axis(near, pack, 1), np.take_along_axis(ok, pack, 1)
            d = self.norms[near] - 2 * np.matmul(self.vectors[near], queries[live][:, :, None])[:, :, 0] + length[live, None]
            d = np.where(ok, d, _FAR)
            all_d = np.concatenate([far[live], d], axis=1)
            best = np.argsort(all_d, axis=1, kind="stable")[:, :ef]
            far[live] = np.take_along_axis(all_d, best, 1)
            found[live] = np.take_along_axis(np.concatenate([found[live], np.where(ok, near, -1)], axis=1), best, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], ~ok], axis=1), best, 1)
        return found, far

    def search(self, queries: np.ndarray, k: int, ef: int = EF_SEARCH) -> tuple[np.ndarray, np.ndarray]:
        """Node numbers and distances of the k nearest nodes by query, nearest first, ties by their least id; -1 where there are fewer."""
        out, dist = np.full((len(queries), k), -1, np.int64), np.full((len(queries), k), np.inf)
        step = max(16, min(512, (1 << 23) // max(1, len(self.vectors))))
        least = self.ids[self.starts[:-1]]
        for a in range(0, len(queries), step):
            q = queries[a : a + step]
            at = np.full((len(q), 1), self.nodes[-1][0], np.int32)
            for level in range(len(self.nodes) - 1, 0, -1):
                at = self.beam(q, at, level, 1)[0]
            found, _ = self.beam(q, at, 0, max(ef, k))
            # Exact distances, in double precision.
            d = np.sqrt(np.square(self.vectors[found].astype(np.float64) - q[:, None].astype(np.float64)).sum(axis=2))
            d = np.where(found >= 0, d, np.inf)
            order = np.lexsort((least[found], d), axis=1)[:, :k]
            found, d = np.take_along_axis(found, order, 1), np.take_along_axis(d, order, 1)
            out[a : a + step, : found.shape[1]], dist[a : a + step, : found.shape[1]] = found, d
        return out, dist

    def neighbours(self, own: np.ndarray, queries: np.ndarray, k: int, ef: int = EF_SEARCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, id, distance) of the k nearest ids by query but its own, ties by id."""
        found, far = self.search(queries, k + 1, ef)
        ok = found >= 0
        q, node, dist = np.nonzero(ok)[0], found[ok], far[ok]
        # No node needs to give more than k + 1 of its ids: they are sorted.
        size = np.minimum(self.starts[node + 1] - self.starts[node], k + 1)
        q, dist = np.repeat(q, size), np.repeat(dist, size)
        ids = self.ids[np.repeat(self.starts[node], size) + np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size)]
        keep = ids != own[q]
        q, dist, ids = q[keep], dist[keep], ids[keep]
        order = np.lexsort((ids, dist, q))
        q, dist, ids = q[order], dist[order], ids[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[keep], ids[keep], dist[keep]


def diverse(vectors: np.ndarray, norms: np.ndarray, points: np.ndarray, near: np.ndarray, far: np.ndarray, m: int) -> np.ndarray:
    """Of each point's candidates (nearest first, -1 for none), m that are nearer to the point than to one another; the nearest others fill up."""
    out = np.full((len(points), m), -1, np.int32)
    for a in range(0, len(points), 256):
        c, d = near[a : a + 256], far[a : a + 256]
        safe = np.where(c >= 0, c, 0)
        v = vectors[safe]
        between = norms[safe][:, :, None] + norms[safe][:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        kept, count = np.zeros(c.shape, bool), np.zeros(len(c), int)
        for i in range(c.shape[1]):
            good = (c[:, i] >= 0) & (count < m) & ~(kept & (between[:, i] <= d[:, i, None])).any(axis=1)
            kept[:, i] = good
            count += good
        order = np.argsort(np.where(c < 0, 2, np.where(kept, 0, 1)), axis=1, kind="stable")[:, :m]
        out[a : a + 256, : order.shape[1]] = np.take_along_axis(c, order, 1)
    return out


def candidates(vectors: np.ndarray, norms: np.ndarray, new: np.ndarray, end: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each new point, the ef nearest others among the first end, nearest first, and their squared distances."""
    near, far, k = np.full((len(new), ef), -1, np.int32), np.full((len(new), ef), _FAR, np.float32), min(ef, end - 1)
    for a in range(0, len(new), 512):
        p = new[a : a + 512]
        d = norms[p][:, None] + norms[:end] - 2 * vectors[p] @ vectors[:end].T
        d[np.arange(len(p)), p] = _FAR
        at = np.argpartition(d, k - 1, axis=1)[:, :k]
        own = np.take_along_axis(d, at, 1)
        order = np.lexsort((at, own), axis=1)
        near[a : a + 512, :k], far[a : a + 512, :k] = np.take_along_axis(at, order, 1), np.take_along_axis(own, order, 1)
    return near, far


def build(ids: np.ndarray, vectors: np.ndarray, degree: int = DEGREE, ef: int = EF_BUILD, seed: int = SEED) -> Graph:
    """The graph of a shard; the same rows give the same graph in whatever order they come."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], np.ascontiguousarray(vectors[order], np.float32) + np.float32(0)
    # Equal vectors are one node, numbered by its least id.
    raw = vectors.view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel()
    _, first, node = np.unique(raw, return_index=True, return_inverse=True)
    turn = np.argsort(first, kind="stable")
    n = len(first)
    level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(degree)).astype(int)
    top = int(level.max())
    # Points take part by level, highest first, so the nodes of a level are a prefix of the order of insertion.
    turn = turn[np.argsort(-level, kind="stable")]
    level = np.sort(level)[::-1]
    place = np.empty(n, np.int64)
    place[turn] = np.arange(n)
    node, vectors = place[node], np.ascontiguousarray(vectors[first[turn]])
    order = np.lexsort((ids, node))
    starts = np.searchsorted(node[order], np.arange(n + 1))
    nodes = [np.arange(int((level >= x).sum()), dtype=np.int32) for x in range(top + 1)]
    links = [np.full((len(own), degree * (1 if x else 2)), -1, np.int32) for x, own in enumerate(nodes)]
    g = Graph(ids[order], starts, vectors, nodes, links)

    def tie(x: int, new: np.ndarray, near: np.ndarray, far: np.ndarray) -> None:
        """Links new points on level x both ways; rows that overflow keep a diverse choice."""
        own = diverse(vectors, g.norms, new, near, far, degree)
        links[x][new, :degree] = own
        src, dst = np.repeat(new, degree), own.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        to, first, count = np.unique(dst, return_index=True, return_counts=True)
        room = links[x].shape[1]
        for a in range(0, len(to), 1024):
            t, f, c = to[a : a + 1024], first[a : a + 1024], count[a : a + 1024]
            come = np.full((len(t), int(c.max())), -1, np.int32)
            at = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            come[np.repeat(np.arange(len(t)), c), at] = src[np.repeat(f, c) + at]
            # What is linked from both ends counts once.
            b = links[x][t]
            come[(come[:, :, None] == b[:, None, :]).any(axis=2)] = -1
            b = np.concatenate([b, come], axis=1)
            safe = np.where(b >= 0, b, 0)
            d = g.norms[safe] + g.norms[t][:, None] - 2 * np.matmul(vectors[safe], vectors[t][:, :, None])[:, :, 0]
            d = np.where(b >= 0, d, _FAR)
            o = np.argsort(d, axis=1, kind="stable")[:, : 2 * room]
            b, d = np.take_along_axis(b, o, 1), np.take_along_axis(d, o, 1)
            over = (b >= 0).sum(axis=1) > room
            rows = b[:, :room].copy() if b.shape[1] >= room else np.concatenate([b, np.full((len(b), room - b.shape[1]), -1, np.int32)], axis=1)
            if over.any():
                rows[over] = diverse(vectors, g.norms, t[over], b[over], d[over], room)
            links[x][t] = rows

    for x in range(top, -1, -1):
        done, n = 1, len(nodes[x])
        while done < n:
            end = min(n, 2 * done)
            new = np.arange(done, end)
            tie(x, new, *candidates(vectors, g.norms, new, end, ef))
            done = end
    return g


# Cells


def fit(sample: np.ndarray, n: int, seed: int = SEED, rounds: int = 8) -> np.ndarray:
    """n centroids of a sample (Lloyd); fewer where the sample has fewer different rows."""
    own = np.unique(sample, axis=0)
    c = own[np.random.default_rng(seed).permutation(len(own))[:n]]
    for _ in range(rounds):
        at = closest(sample, c, 1)[:, 0]
        order = np.argsort(at, kind="stable")
        some, first, size = np.unique(at[order], return_index=True, return_counts=True)
        c[some] = np.add.reduceat(sample[order].astype(np.float64), first) / size[:, None]
    return c


def closest(rows: np.ndarray, centroids: np.ndarray, k: int) -> np.ndarray:
    """The numbers of the k nearest centroids of each row, nearest first, ties by number."""
    length, out = np.einsum("nd,nd->n", centroids, centroids), np.empty((len(rows), k), np.int32)
    for a in range(0, len(rows), 4096):
        d = length - 2 * rows[a : a + 4096] @ centroids.T
        out[a : a + 4096] = d.argmin(axis=1)[:, None] if k == 1 else np.argsort(d, axis=1, kind="stable")[:, :k]
    return out


def calibrated(sample: np.ndarray, centroids: np.ndarray, k: int, target: float, held: int = 512) -> int:
    """How many cells a query must visit, so that of held-out rows of the sample the share target of their k nearest others lies in them."""
    q = sample[:: max(1, len(sample) // held)]
    cell = closest(sample, centroids, 1)[:, 0]
    d = np.einsum("nd,nd->n", sample, sample) - 2 * q @ sample.T
    d[np.arange(len(q)), np.arange(len(q)) * max(1, len(sample) // held)] = np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return 1
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    order = closest(q, centroids, len(centroids))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(centroids), dtype=np.int32), order.shape), 1)
    deep = np.sort(np.take_along_axis(place, cell[near], 1).ravel())
    return int(deep[min(len(deep) - 1, int(np.ceil(target * len(deep))))]) + 1


@dataclass
class Index:
    """graphs: a row a shard (dim, cell, part and the flat arrays); by dimension the centroids and the number of cells that a query visits. A dimension without centroids is one cell."""

    graphs: DataFrame
    centroids: dict[int, np.ndarray]
    probes: dict[int, int]
    n_shards: int


def rows_of(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, dim) of the usable rows, one an id and dimension: that of the least vector."""
    v = common.pick(vectors, vec_id="bigint", embedding="array<float>").where("vec_id IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = float('infinity'))")
    v, key = v.withColumn("dim", F.size("embedding")), ["dim", "vec_id"]
    again = common.checkpointed(v.groupBy(*key).count().where("count > 1").select(*key))
    if again.limit(1).count():
        small = common.checked_broadcast(again)
        least = v.join(small, key, "left_semi").groupBy(*key).agg(F.min("embedding").alias("embedding"))
        v = v.join(small, key, "left_anti").select(*v.columns).union(least.select(*v.columns))
    return v


def dealt(v: DataFrame, centroids: dict[int, np.ndarray], probes: dict[int, int]) -> DataFrame:
    """v with the cell; a row for each of the cells that probes says, one where it says nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                some = b.filter(pa.array(dims == dim))
                if dim not in centroids:
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.zeros(some.num_rows, np.int32))], names=["vec_id", "embedding", "dim", "cell"])
                    continue
                k = probes.get(dim, 1)
                cell = closest(some.column(1).flatten().to_numpy().reshape(-1, dim), centroids[dim], k)
                some = some.take(pa.array(np.repeat(np.arange(some.num_rows), k))) if k > 1 else some
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell.ravel())], names=["vec_id", "embedding", "dim", "cell"])

    return v.mapInArrow(run, "vec_id bigint, embedding array<float>, dim int, cell int")


def index(vectors: DataFrame, k: int = NEIGHBOURS, shard_rows: int = SHARD_ROWS, seed: int = SEED, sample_rows: int = SAMPLE_ROWS, max_cells: int = MAX_CELLS, target: float = TARGET) -> Index:
    """Every usable row of vectors in the graph of its shard; see nearest() for what is usable. The centroids are fitted on the sample_rows of least hash of each dimension that needs several cells."""
    v = rows_of(vectors)
    # Half-full shards: cells differ in size. A few cells even over a small table, so that tasks share the work.
    wanted = lambda n: max(min(8, n // 250), -(-2 * n // shard_rows))
    # A dimension that needs several cells has at least 500 rows, or more than half a shard: there are few of them.
    large = {r.dim: r.n for r in v.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("n") > min(499, shard_rows // 2)).collect() if wanted(r.n) > 1}
    centroids, probes = {}, {}
    for dim, n in sorted(large.items()):
        drawn = v.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample_rows).select("embedding").toPandas()
        sample = np.stack(drawn["embedding"].to_list()).astype(np.float32)
        centroids[dim] = fit(sample, min(max_cells, wanted(n)), seed)
        probes[dim] = min(len(centroids[dim]), calibrated(sample, centroids[dim], k, target))
    v = common.checkpointed(dealt(v, centroids, {}))
    counts = common.checkpointed(v.groupBy("dim", "cell").agg(F.count("*").alias("n")).select("dim", "cell", F.ceil(F.col("n") / shard_rows).cast("int").alias("parts")))
    n_shards = counts.agg(F.coalesce(F.sum("parts"), F.lit(0))).first()[0]
    split = v.join(common.checked_broadcast(counts), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(seed)), "parts").cast("int"))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        g = build(pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["embedding"].to_list()).astype(np.float32), seed=seed)
        key = {c: [int(pdf[c].iloc[0])] for c in ("dim", "cell", "part")}
        return pd.DataFrame(key | {"ids": [g.ids.tobytes()], "starts": [g.starts.astype(np.int64).tobytes()], "vectors": [g.vectors.tobytes()], "nodes": [[x.tobytes() for x in g.nodes]], "links": [[x.tobytes() for x in g.links]]})

    # A number of partitions that is asked for stays: shards are work, however few bytes they are.
    split = split.repartition(max(1, min(10_000, 2 * n_shards)), "dim", "cell", "part")
    graphs = common.checkpointed(split.select("dim", "cell", "part", "vec_id", "embedding").groupBy("dim", "cell", "part").applyInPandas(make, GRAPH))
    return Index(graphs, centroids, probes, n_shards)


def search(own: Index, queries: DataFrame, k: int = NEIGHBOURS, ef: int = EF_SEARCH, probes: dict[int, int] | None = None) -> DataFrame:
    """A row for each of the k nearest indexed rows of each query; see nearest(). probes: cells to visit by dimension, in place of the calibrated number."""
    q = common.checkpointed(dealt(rows_of(queries), own.centroids, own.probes if probes is None else probes))
    blocks = q.groupBy("dim", "cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks"))
    q = q.join(common.checked_broadcast(common.checkpointed(blocks)), ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks"))
    q = q.groupBy("dim", "cell", "block").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("queries"))
    # A block goes to each part of its cell, where the graph is: no task holds more than one shard's pairs for being in one cell.
    parts = own.graphs.select("dim", "cell", "part")
    n = max(1, min(10_000, 2 * own.n_shards))
    q = q.join(common.checked_broadcast(common.checkpointed(parts)), ["dim", "cell"]).repartition(n, "dim", "cell", "part")
    pairs = own.graphs.repartition(n, "dim", "cell", "part").join(q, ["dim", "cell", "part"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                x = {c: b.column(i)[r] for i, c in enumerate(b.schema.names)}
                dim = x["dim"].as_py()
                read = lambda raw, kind, width=None: np.frombuffer(raw, kind) if width is None else np.frombuffer(raw, kind).reshape(-1, width)
                links = [read(raw, np.int32, DEGREE * (1 if i else 2)) for i, raw in enumerate(x["links"].as_py())]
                g = Graph(read(x["ids"].as_py(), np.int64), read(x["starts"].as_py(), np.int64), read(x["vectors"].as_py(), np.float32, dim), [read(raw, np.int32) for raw in x["nodes"].as_py()], links)
                asked = x["queries"].values
                ids = asked.field("vec_id").to_numpy()
                at, near, far = g.neighbours(ids, asked.field("embedding").flatten().to_numpy().reshape(-1, dim), k, ef)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.full(len(at), dim, np.int32)), pa.array(near), pa.array(far)], names=["vec_id", "dim", "neighbour_id", "distance"])

    found = pairs.select("dim", "ids", "starts", "vectors", "nodes", "links", "queries").mapInArrow(answer, "vec_id bigint, dim int, neighbour_id bigint, distance double")
    # Each task keeps the k best of a query before anything moves.
    w = Window.partitionBy("dim", "vec_id").orderBy("distance", "neighbour_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("vec_id", "dim", "rank", "neighbour_id", "distance")


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = NEIGHBOURS, ef: int = EF_SEARCH, **parameters) -> DataFrame:
    """A row for each of the k nearest of each query: vec_id, dim, rank (from 1), neighbour_id, distance (Euclidean).

    Without queries every row is one; a query's own id is never among its neighbours. Rows without an id, without a vector, with an
    empty one or one that holds a null, NaN or infinity give and are no neighbours. Vectors are only held against those of their dimension:
    an id with vectors of two dimensions is two things, told apart by dim. Rows that repeat id and dimension count once, with the
    least vector. Equal distances go by id; equal vectors are all found, however many. With fewer than k
    others, all are given. Vectors of any length are taken whole. Extra columns aren't read; an empty table or one of nulls gives an empty result.
    """
    return search(index(vectors, k, **parameters), vectors if queries is None else queries, k, ef)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows whose id EVERY divides, against all rows."""
    v = common.table(spark, sf_dir, "embeddings")
    return nearest(v, v.where(F.col("vec_id") % EVERY == 0))
