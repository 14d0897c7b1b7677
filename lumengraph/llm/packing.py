"""Packing documents into training sequences: first-fit decreasing with a tournament tree of bin capacities.

Documents are dealt at random (a seeded hash) into groups of about ``group_size``, and each group is packed on its own, so
groups run in parallel and no group grows with the table. In a group, the longest piece goes first, each into the first
bin with room; the tree over the bins' free room finds that bin in a logarithm of steps.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CAPACITY, GROUP_SIZE, SEED = 2048, 20_000, 11
#: Repeats of a row that are made at once.
REPEATS = 10_000


class Tournament:
    """Free room of bins; the leftmost with enough room is found from the root down. The tree doubles as bins are opened."""

    def __init__(self, capacity: int):
        self.capacity, self.leaves, self.opened = capacity, 1, 0
        self.tree = [0, capacity]

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset in it) of the first bin that has room for size; opens one if none has."""
        if self.tree[1] < size:
            n = self.leaves
            leaves = self.tree[n:] + [self.capacity] * n
            self.leaves, self.tree = 2 * n, [0] * (2 * n) + leaves
            for i in range(2 * n - 1, 0, -1):
                self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])
        tree, i = self.tree, 1
        while i < self.leaves:
            i *= 2
            if tree[i] < size:
                i += 1
        offset, out = self.capacity - tree[i], i - self.leaves
        tree[i] -= size
        while i > 1:
            i //= 2
            best = max(tree[2 * i], tree[2 * i + 1])
            if tree[i] == best:
                break
            tree[i] = best
        self.opened = max(self.opened, out + 1)
        return out, offset


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) by item, in the order given; equal sizes are placed in that order. Sizes must be 1 to capacity."""
    t, out = Tournament(capacity), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = t.place(sizes[i])
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, group_size: int = GROUP_SIZE, seed: int = SEED, n_tokens: str | None = None) -> DataFrame:
    """A row for each piece of a document: doc_id, piece, n_tokens, group_id, bin_id, bin_offset. Bins are numbered within a group.

    Length is the column n_tokens names, else the number of whitespace-separated words. A document longer than the
    capacity is cut into full pieces and a rest, numbered from 0; nothing is dropped, however long. Documents without a token (null,
    empty and blank texts, null or negative lengths) give no row. Equal lengths go by id (nulls first), then piece. Repeated rows are packed
    each on its own and spread over the groups, so no id, null included, can fill one. Extra columns aren't read. An empty table, or one of nulls, gives an empty result.
    """
    if n_tokens:
        d = common.pick(docs, doc_id="bigint", **{n_tokens: "bigint"}).select("doc_id", F.col(f"`{n_tokens}`").alias("size"))
    else:
        d = common.pick(docs, doc_id="bigint", text="string").select("doc_id", common.words(F.col("text")).alias("size"))
    d = d.where(F.col("size") > 0)
    groups = max(1, -(-common.pick(docs, doc_id="bigint").count() // group_size))
    # Rows that repeat are counted, and numbered, so that their hashes differ.
    d = d.groupBy("doc_id", "size").agg(F.count("*").alias("n")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / REPEATS))))
    d = d.withColumn("again", F.explode(F.sequence(F.col("b") * REPEATS, F.least("n", (F.col("b") + 1) * REPEATS) - 1)))
    d = d.select("doc_id", "size", F.pmod(F.xxhash64("doc_id", "size", "again", F.lit(seed)), F.lit(groups)).cast("int").alias("group_id"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "size"], na_position="first", kind="stable")
        ids, at, sizes = [], [], []
        for i, n in zip(pdf["doc_id"].astype("Int64").tolist(), pdf["size"].astype(int).tolist()):
            for k in range(-(-n // capacity)):
                ids.append(i), at.append(k), sizes.append(min(capacity, n - k * capacity))
        placed = first_fit_decreasing(sizes, capacity)
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "piece": at, "n_tokens": sizes, "group_id": [pdf["group_id"].iloc[0]] * len(ids), "bin_id": [b for b, _ in placed], "bin_offset": [o for _, o in placed]})

    return d.groupBy("group_id").applyInPandas(run, "doc_id bigint, piece int, n_tokens bigint, group_id int, bin_id int, bin_offset bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
