"""Fuzzy resolution of identifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.scalar import jaro_winkler_many
from ..runtime import at_most, block_pairs, checkpointed, in_blocks

THRESHOLD = 0.20
#: Rows of a block of ids or of queries.
BLOCK = 2048
#: Queries up to which each id is held against all of them.
FEW_QUERIES = 1000


def postings(ids: DataFrame) -> DataFrame:
    """(token, id): the inverted index of identifiers."""
    return ids.select(F.explode(scalar.tokens(F.col("id"))).alias("token"), "id").distinct()


def sharing(ids: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, id, shared): the ids that share tokens with a query, and how many. Single characters are tokens too, so this suits few queries, which then go to the ids, or rare tokens, which meet by the index; resolve() compares blocks by bounds."""
    asked = queries.select(F.col(queries.columns[0]).alias("query")).where("query IS NOT NULL").distinct()
    if at_most(asked, FEW_QUERIES):
        own = ids.select("id").where("id IS NOT NULL").distinct().withColumn("tokens", scalar.tokens(F.col("id")))
        met = own.crossJoin(F.broadcast(asked.withColumn("wanted", scalar.tokens(F.col("query")))))
        return met.select("query", "id", F.size(F.array_intersect("wanted", "tokens")).cast("bigint").alias("shared")).where("shared > 0")
    return asked.select("query", F.explode(scalar.tokens(F.col("query"))).alias("token")).join(postings(ids), "token").groupBy("query", "id").agg(F.count("*").alias("shared"))


def interned(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Every identifier in use: nodes, edges, and ends of edges whether or not they exist."""
    return nodes.select("id").union(edges.select("id")).union(edges.select("src")).union(edges.select("dst")).distinct()


def resolve(ids: DataFrame, queries: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(query, id, score): the id itself where it exists; else the most similar (Jaro-Winkler) of all, if above the threshold, which is no less than 0; ties by id.

    Exact, by bounds: the letters that two texts have in common in any order, and the first four in theirs, limit the similarity. Ids in order of their letters
    are cut into blocks, which hold groups of equal letters and beginnings, and every block of queries meets every one of them. The first pass finds the highest
    bound of each query, the second compares it with the groups of that bound, the third with all groups whose bound is no less than the score then reached.
    """
    if threshold < 0:
        raise ValueError("a threshold below 0 would let in ids that have nothing in common with the query")
    q = queries.select(F.col(queries.columns[0]).alias("text")).where("text IS NOT NULL").distinct()
    own = ids.select(F.col("id").alias("text")).where("text IS NOT NULL").distinct()
    exact = q.join(own, "text", "left_semi")
    asked = checkpointed(q.join(own, "text", "left_anti"))
    letters = F.array_sort(F.split("text", ""))
    n = max(1, -(-own.count() // block))
    ordered = own.withColumn("letters", letters).repartitionByRange(min(n, 1000), "letters", "text").sortWithinPartitions("letters", "text")
    left = checkpointed(ordered.select("text", F.floor(F.monotonically_increasing_id() / block).alias("b")).groupBy("b").agg(F.collect_list(F.struct("text")).alias("rows")).select("rows"))

    def met(asked: DataFrame, run, columns: str) -> DataFrame:
        return block_pairs(left, in_blocks(asked, block), 200).mapInArrow(run, columns)

    top = met(asked, highest_bounds, "text string, top double").groupBy("text").agg(F.max("top").alias("top"))
    top = checkpointed(top.where("top > 0"))
    first = checkpointed(best_rows(met(top.withColumn("least", F.col("top")), best_by_bounds, "query string, id string, score double")))
    more = top.join(first.withColumnRenamed("query", "text"), "text").select("text", "top", F.col("score").alias("least"))
    found = best_rows(first.union(met(more, best_by_bounds, "query string, id string, score double")))
    return found.where(F.col("score") > threshold).union(exact.select(F.col("text").alias("query"), F.col("text").alias("id"), F.lit(1.0).alias("score")).where(F.col("score") > threshold))


def best_rows(found: DataFrame) -> DataFrame:
    """Of (query, id, score) the row of the highest score for each query, ties by id."""
    return found.groupBy("query").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("b")).select("query", F.col("b.id").alias("id"), (-F.col("b.s")).alias("score"))


#: Bounds and scores are rounded differently.
ROUNDING = 1e-9


def block_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.StructArray, slice, np.ndarray, list[list[str]]]]:
    """For every pair of blocks, a few queries at a time: the queries' fields, which of them, the bounds of queries by groups, and the texts of each group."""
    last, names, keys = None, [], []
    for b in batches:
        for left, right in zip(b.column(0), b.column(1)):
            own, asked = left.values.field("text").to_pylist(), right.values
            if own != last:
                groups: dict[tuple[str, str], list[str]] = {}
                for t in own:
                    groups.setdefault(("".join(sorted(t)), t[:4]), []).append(t)
                last, names, keys = own, list(groups.values()), list(groups)
            texts = asked.field("text").to_pylist()
            for at in range(0, len(texts), 256):
                part = slice(at, at + 256)
                yield asked, part, bounds(texts[part], keys), names


def highest_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for asked, part, bound, _ in block_bounds(batches):
        yield pa.RecordBatch.from_arrays([asked.field("text")[part], pa.array(bound.max(axis=1))], names=["text", "top"])


def best_by_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best id in the block of each query (text, top, least), of the groups whose bound is between least and top, or below it once top was compared (least < top)."""
    for asked, part, bound, names in block_bounds(batches):
        top, least = (asked.field(k)[part].to_numpy(zero_copy_only=False) for k in ("top", "least"))
        wanted, out = bound >= least[:, None] - ROUNDING, []
        again = least < top
        wanted[again] &= bound[again] < top[again, None] - ROUNDING
        for i in np.flatnonzero(wanted.any(axis=1)):
            text, some = asked.field("text")[part.start + int(i)].as_py(), [n for g in np.flatnonzero(wanted[i]) for n in names[g]]
            score = jaro_winkler_many(text, some)
            best = score.max()
            out.append((text, min(some[k] for k in np.flatnonzero(score == best)), float(best)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["query", "id", "score"])


def bounds(texts: list[str], groups: list[tuple[str, str]]) -> np.ndarray:
    """For each text and each group (letters, first four of them) what its Jaro-Winkler similarity to a member is at most: 0 without a common letter."""
    alphabet = {c: i for i, c in enumerate(sorted(set("".join(texts))))}

    def counts(strings):
        out = np.zeros((len(alphabet), len(strings)), np.int32)
        for i, s in enumerate(strings):
            for c in s:
                if c in alphabet:
                    out[alphabet[c], i] += 1
        return out

    a, b = counts(texts), counts([g[0] for g in groups])
    common = np.zeros((len(texts), len(groups)), np.int32)
    for x, y in zip(a, b):
        if y.any():
            common += np.minimum(x[:, None], y[None])
    m, n = np.array([len(t) for t in texts])[:, None], np.array([len(g[0]) for g in groups])[None]
    jaro = np.where(common > 0, (common / np.maximum(m, 1) + common / np.maximum(n, 1) + 1) / 3, 0.0)
    same, alive = np.zeros(common.shape, np.int32), np.ones(common.shape, bool)
    for i in range(4):
        heads = [np.array([t[i] if i < len(t) else "" for t in s])[:] for s in (texts, [g[1] for g in groups])]
        alive &= (heads[0][:, None] == heads[1][None]) & (heads[0] != "")[:, None]
        same += alive
    return np.where(jaro > 0.7, jaro + 0.1 * same * (1 - jaro), jaro)
