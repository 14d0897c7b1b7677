"""An index for nearest vectors: cells around centroids that are fitted on a bounded sample; a query measures the rows of its nearest cells exactly.

How many cells a query visits is found on held-out rows of the sample, so that the wanted share of their neighbours lies in them. Cells
are gathered into blocks of bounded size, so a cell that holds a third of all rows is many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import checkpointed, in_blocks
from . import search

#: Rows of the sample, the most cells, rows a cell should have, and the share of neighbours that the visited cells must hold.
SAMPLE_ROWS, MAX_CELLS, CELL_ROWS, RECALL = 8192, 1024, 4096, 0.97


@dataclass
class Cells:
    """rows: (node_id, embedding, cell), one row a vector of the index's length; centroids, and the number of cells that a query visits."""

    rows: DataFrame
    centroids: np.ndarray
    probes: int

    def insert(self, vectors: DataFrame) -> Cells:
        """With more vectors (node_id, embedding); those of other lengths are left out. The centroids stay."""
        return Cells(self.rows.union(_dealt(vectors, self.centroids, 1, "node_id")), self.centroids, self.probes)


def _near(rows: np.ndarray, centroids: np.ndarray, k: int) -> np.ndarray:
    return np.argsort(np.einsum("nd,nd->n", centroids, centroids) - 2 * rows @ centroids.T, axis=1, kind="stable")[:, :k].astype(np.int32)


def _dealt(vectors: DataFrame, centroids: np.ndarray, k: int, name: str) -> DataFrame:
    kind, dim = dict(vectors.dtypes)[name], centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = _near(b.column(1).flatten().to_numpy().reshape(-1, dim), centroids, k)
            some = b.take(pa.array(np.repeat(np.arange(b.num_rows), cell.shape[1])))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell.ravel())], names=[name, "embedding", "cell"])

    usable = vectors.select(name, F.col("embedding").cast("array<double>").alias("embedding")).where((F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
    return usable.mapInArrow(run, f"{name} {kind}, embedding array<double>, cell int")


def build(vectors: DataFrame, dim: int | None = None, k: int = 10, cell_rows: int = CELL_ROWS, sample_rows: int = SAMPLE_ROWS, recall: float = RECALL, seed: int = 7) -> Cells:
    """Over vectors (node_id, embedding) of one length, by default the most frequent. The sample is the rows of least hash."""
    v = vectors.where("size(embedding) > 0")
    sizes = v.groupBy(F.size("embedding").alias("d")).count()
    top = (sizes if dim is None else sizes.where(F.col("d") == dim)).orderBy(F.desc("count"), "d").first()
    if top is None:
        return Cells(vectors.select("node_id", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(0).alias("cell")).limit(0), np.zeros((1, dim or 1)), 1)
    own = v.where((F.size("embedding") == top.d) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
    drawn = own.orderBy(F.xxhash64("node_id", F.lit(seed)), "node_id").limit(sample_rows).select("embedding").collect()
    sample = np.array([r.embedding for r in drawn], np.float64)
    some = np.unique(sample, axis=0)
    c = some[np.random.default_rng(seed).permutation(len(some))[: max(1, min(MAX_CELLS, -(-top["count"] // cell_rows)))]]
    for _ in range(8):
        at = _near(sample, c, 1)[:, 0]
        for i in np.unique(at):
            c[i] = sample[at == i].mean(axis=0)
    # Where the neighbours of held-out rows lie, in the order in which their cells would be visited.
    at, held = _near(sample, c, 1)[:, 0], np.arange(0, len(sample), max(1, len(sample) // 512))
    d = np.einsum("nd,nd->n", sample, sample) - 2 * sample[held] @ sample.T
    d[np.arange(len(held)), held] = np.inf
    near = np.argsort(d, axis=1)[:, : max(1, min(k, len(sample) - 1))]
    turn = np.argsort(_near(sample[held], c, len(c)), axis=1)
    deep = np.sort(np.take_along_axis(turn, at[near], 1).ravel())
    return Cells(checkpointed(_dealt(own, c, 1, "node_id")), c, int(deep[min(len(deep) - 1, int(np.ceil(recall * len(deep))))]) + 1)


def nearest(cells: Cells, queries: DataFrame, k: int, probes: int | None = None, block: int = search.BLOCK) -> DataFrame:
    """(query_id, node_id, dist, rank): of each of queries (query_id, embedding) the k nearest rows in its nearest cells. Ties go by id."""
    q = _dealt(queries, cells.centroids, min(len(cells.centroids), probes or cells.probes), "query_id")
    kinds = dict(cells.rows.dtypes)["node_id"], dict(q.dtypes)["query_id"]
    left, right = (in_blocks(d.select("cell", F.col(name).alias("id"), F.col("embedding").alias("e")), block, "cell") for d, name in ((cells.rows, "node_id"), (q, "query_id")))
    pairs = left.withColumnRenamed("rows", "left").join(right.withColumnRenamed("rows", "right"), "cell").select("left", "right")
    found = pairs.mapInArrow(search.best_of_pairs(k), f"query_id {kinds[1]}, node_id {kinds[0]}, dist double")
    w = Window.partitionBy("query_id").orderBy("dist", "node_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
