"""Nearest vectors, blended with importance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector
from ..runtime import block_pairs, in_blocks
from . import filters

#: Rows of a block, whose product with another is one matrix of this side.
BLOCK = 2048


def nearest(vectors: DataFrame, query, k: int, squared: bool = False) -> DataFrame:
    """The k nearest of vectors to one literal vector: vectors' columns and dist. One scan, one top-k: nothing is shuffled but k rows a task."""
    d = vector.l2(F.col("embedding"), vector.literal(query) if not hasattr(query, "_jc") else query, squared)
    return vectors.withColumn("dist", d).where("dist IS NOT NULL").orderBy("dist", "node_id").limit(k)


def blended(dist, impact, alpha: float):
    return (1 - dist) * (1 - alpha) + F.coalesce(impact, F.lit(0.0)) * alpha


def shifted(query, lang: str | None, centroids: DataFrame | None):
    """The query as a column, moved by its language's centroid where one is registered."""
    q = vector.literal(query)
    row = centroids.where(F.col("lang") == lang).select("centroid").first() if lang is not None and centroids is not None else None
    return vector.shift(q, vector.literal(row[0])) if row else q


def hybrid_search(
    vectors: DataFrame, nodes: DataFrame, query, k: int, alpha: float = 0.5, lang: str | None = None, as_of=None, centroids: DataFrame | None = None, prefilter: bool = False, min_impact: float | None = None, squared: bool = False, include_invalid: bool = False,
) -> DataFrame:
    """(id, dist, impact, score), best first: 2k nearest, then those valid at the time, then the k of best score.

    The time filters after the 2k nearest are found, so fewer than k may come; prefilter turns that round. impact is the stored one.
    """
    there = filters.as_of(nodes, as_of, include_invalid).select("id", "impact")
    if min_impact is not None:
        there = there.where(F.col("impact") >= min_impact)
    if prefilter:
        vectors = vectors.join(there.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    near = nearest(vectors.select("node_id", "embedding"), shifted(query, lang, centroids), 2 * k, squared).select(F.col("node_id").alias("id"), "dist")
    # near has at most 2k rows, so it is the side to broadcast.
    return F.broadcast(near).join(there, "id").withColumn("score", blended(F.col("dist"), F.col("impact"), alpha)).orderBy(F.desc("score"), "id").limit(k)


def ranked_context(vectors: DataFrame, nodes: DataFrame, query, k: int, **more) -> DataFrame:
    return hybrid_search(vectors, nodes, query, k, alpha=0.4, **more)


def proximity_score(impact, dist, depth):
    """0.5 importance, 0.3 similarity, 0.2 nearness in the graph."""
    return 0.5 * F.coalesce(impact, F.lit(0.0)) + 0.3 * (1 - dist) + 0.2 / (1 + depth)


def conflicts(vectors: DataFrame, nodes: DataFrame, query, labels: list[str]) -> bool:
    """Whether a new node with this vector and labels is refused: one of its 3 best hits scores above 0.8, has other labels and is MASTER."""
    hits = ranked_context(vectors, nodes, query, 3, include_invalid=True).join(nodes.select("id", "labels"), "id")
    own = F.array(*(F.lit(x) for x in labels)).cast("array<string>")
    return bool(hits.where((F.col("score") > 0.8) & (F.col("labels") != own) & F.array_contains("labels", "MASTER")).limit(1).count())


def best_of_pairs(k: int):
    """For mapInArrow over pairs (left, right) of blocks of (id, e): of each right row the k nearest left ones, as (query_id, node_id, dist). Rows meet those of their own length only."""

    def by_length(rows: pa.StructArray) -> dict[int, tuple[pa.Array, np.ndarray]]:
        ids, e = rows.field("id"), rows.field("e")
        sizes = np.asarray(e.value_lengths())
        return {int(n): (ids.filter(pa.array(sizes == n)), np.asarray(e.filter(pa.array(sizes == n)).flatten(), np.float64).reshape(-1, n)) for n in np.unique(sizes) if n}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                left, right = by_length(b.column(0)[r].values), by_length(b.column(1)[r].values)
                for n in left.keys() & right.keys():
                    (own, m), (ids, x) = left[n], right[n]
                    names, length = np.array(own.to_pylist()), np.einsum("qd,qd->q", x, x)
                    d = length[:, None] - 2 * x @ m.T + np.einsum("nd,nd->n", m, m)[None]
                    # A rounded distance finds the candidates; those within its error of the kth are measured exactly.
                    kk = min(k, len(m))
                    bound = np.partition(d, kk - 1, axis=1)[:, kk - 1] + 1e-9 * (1 + length)
                    qi, vi = np.nonzero(d <= bound[:, None])
                    exact = np.sqrt(np.square(m[vi] - x[qi]).sum(axis=1))
                    order = np.lexsort((names[vi], exact, qi))
                    qi, vi, exact = qi[order], vi[order], exact[order]
                    keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < kk
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(qi[keep])), own.take(pa.array(vi[keep])), pa.array(exact[keep])], names=["query_id", "node_id", "dist"])

    return run


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, node_id, dist, rank): the k nearest of vectors (node_id, embedding) to each of queries (query_id, embedding), exact.

    Both sides are gathered into blocks, and each pair of blocks is one matrix product in numpy, of which only the k best a query go on:
    the work grows with rows times queries, where index.nearest() visits some cells. Vectors meet queries of their own length only. Ties go by id.
    """
    kinds = dict(vectors.dtypes)["node_id"], dict(queries.dtypes)["query_id"]
    v, q = (d.where(F.col("embedding").isNotNull()).select(F.col(c).alias("id"), F.col("embedding").cast("array<double>").alias("e")) for d, c in ((vectors, "node_id"), (queries, "query_id")))
    size = q.agg(F.coalesce(F.max(F.size("e")), F.lit(0))).first()[0]
    found = block_pairs(in_blocks(v, block), in_blocks(q, block), 8 * size + 16).mapInArrow(best_of_pairs(k), f"query_id {kinds[1]}, node_id {kinds[0]}, dist double")
    w = Window.partitionBy("query_id").orderBy("dist", "node_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
