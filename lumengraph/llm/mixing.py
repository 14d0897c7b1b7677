"""Mixing sources to target weights where sources overlap: a min-cost flow.

A document is a text; the sources that list it (its rows may come from several) are its membership pattern. Documents are
aggregated by pattern, so the flow has a node a pattern and a node a source, however many documents there are. Tokens
flow from patterns to the quotas of their sources. The first pass over a pattern's tokens is free, and each repetition of
them costs more than the last (convex), so nothing is repeated while unused tokens could serve, by any rerouting. Each
unit of flow pays only for the arc by which it enters, so successive shortest paths fill the passes level by level: a
maximum flow (Dinic) is augmented a level at a time, which gives the least cost. Passes go on until every quota is filled, or up to
max_passes where that is given; then a quota may stay short, as does that of a source without tokens.

A pattern that gets f tokens of its c is emitted f // c times whole, and documents in seeded order once more, while they fit into f % c.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAX_PASSES, TEMPERATURE, SEED, BUCKETS = None, 0.5, 17, 4096


class Network:
    """Maximum flow by Dinic's blocking flows, with capacities that may grow between runs."""

    def __init__(self, n: int):
        self.to, self.room, self.out = [], [], [[] for _ in range(n)]

    def arc(self, a: int, b: int, capacity: int) -> int:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [capacity, 0]
        return len(self.to) - 2

    def augment(self, s: int, t: int) -> None:
        while True:
            level = [-1] * len(self.out)
            level[s], todo = 0, deque([s])
            while todo:
                a = todo.popleft()
                for e in self.out[a]:
                    if self.room[e] and level[self.to[e]] < 0:
                        level[self.to[e]] = level[a] + 1
                        todo.append(self.to[e])
            if level[t] < 0:
                return
            at, path = [0] * len(self.out), []
            while True:
                a = self.to[path[-1]] if path else s
                if a == t:
                    f = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= f
                        self.room[e ^ 1] += f
                    path = path[: next(i for i, e in enumerate(path) if not self.room[e])]
                    continue
                while at[a] < len(self.out[a]):
                    e = self.out[a][at[a]]
                    if self.room[e] and level[self.to[e]] == level[a] + 1:
                        break
                    at[a] += 1
                if at[a] < len(self.out[a]):
                    path.append(self.out[a][at[a]])
                elif path:
                    at[self.to[path.pop() ^ 1]] += 1
                else:
                    break


def route(capacity: dict[tuple[str, ...], int], quota: dict[str, int], max_passes: int | None = MAX_PASSES) -> dict[tuple[str, ...], dict[str, int]]:
    """Tokens by pattern and source at the least repetition cost; patterns and sources are taken in sorted order, so ties are settled alike each time.

    Several passes are taken at once while all their tokens find a quota: then each of them alone would be used up too, and the cost is the same.
    """
    patterns, sources = sorted(p for p in capacity if capacity[p] > 0), sorted(quota)
    number = {s: 1 + len(patterns) + i for i, s in enumerate(sources)}
    net = Network(2 + len(patterns) + len(sources))
    end = 1 + len(patterns) + len(sources)
    enter = [net.arc(0, 1 + i, 0) for i in range(len(patterns))]
    across = {(p, s): net.arc(1 + i, number[s], quota[s]) for i, p in enumerate(patterns) for s in p if s in number}
    for s in sources:
        net.arc(number[s], end, quota[s])
    live, done, step = range(len(patterns)), 0, 1
    while live and (max_passes is None or done < max_passes):
        if max_passes is not None:
            step = min(step, max_passes - done)
        kept = net.room[:]
        for i in live:
            net.room[enter[i]] += capacity[patterns[i]] * step
        net.augment(0, end)
        left = [i for i in live if not net.room[enter[i]]]  # a pattern with tokens over reaches no open quota, now or later
        if step > 1 and len(left) < len(live):
            net.room, step = kept, step // 2
            continue
        live, done = left, done + step
        step = step * 2 if done >= 4 else 1
    return {p: {s: net.room[across[p, s] ^ 1] for s in p if s in number and net.room[across[p, s] ^ 1]} for p in patterns}


def quotas(tokens: dict[str, int], budget: int, weights: dict[str, float] | None) -> dict[str, int]:
    """Whole tokens by source that add up to the budget; without weights they go as tokens ** TEMPERATURE. The largest fractions round up."""
    w = {s: x for s, x in (weights or {s: n**TEMPERATURE for s, n in tokens.items()}).items() if x > 0}
    total = sum(w.values())
    exact = {s: budget * x / total for s, x in w.items()}
    out = {s: int(x) for s, x in exact.items()}
    for s in sorted(out, key=lambda s: (out[s] - exact[s], s))[: budget - sum(out.values())]:
        out[s] += 1
    return out


def text_key(text):
    return F.unhex(F.md5(text.cast("binary")))


def plan(docs: DataFrame, weights: dict[str, float] | None = None, budget: int | None = None, max_passes: int | None = MAX_PASSES, seed: int = SEED) -> tuple[DataFrame, dict]:
    """(chosen, flows): chosen has (text_key, doc_id, pattern, n_tokens, copies) of each text that is chosen, flows has the tokens by pattern and source.

    A text's rows count once; the least doc_id (nulls last) stands for them. Length is in whitespace-separated words. budget:
    tokens in all, by default those of all different texts. weights: by source; default as in quotas().
    """
    d = common.pick(docs, doc_id="bigint", text="string", source="string")
    d = d.select("doc_id", F.coalesce("source", F.lit("unknown")).alias("source"), text_key(F.col("text")).alias("text_key"), common.words(F.col("text")).alias("n_tokens")).where("n_tokens > 0")
    one = d.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.array_sort(F.collect_set("source")).alias("sources"), F.first("n_tokens").alias("n_tokens"))
    one = common.checkpointed(one.withColumn("draw", F.shiftrightunsigned(F.xxhash64("text_key", F.lit(seed)), 1)))
    counted = {tuple(r.sources): r.n for r in one.groupBy("sources").agg(F.sum("n_tokens").alias("n")).collect()}
    by_source: dict[str, int] = {}
    for p, n in counted.items():
        for s in p:
            by_source[s] = by_source.get(s, 0) + n
    flows = route(counted, quotas(by_source, sum(counted.values()) if budget is None else budget, weights) if by_source else {}, max_passes)
    spark = docs.sparkSession
    total = {p: sum(f.values()) for p, f in flows.items()}
    rows = [([*p], total[p] // counted[p], total[p] % counted[p]) for p in flows]
    passes = common.checked_broadcast(spark.createDataFrame(rows, "sources array<string>, whole bigint, rest bigint"))
    dealt = one.join(passes, "sources")
    # A running total over a whole pattern would be one task: totals by bucket of the draw first, then within the bucket where the rest ends.
    bucket = F.shiftright("draw", 63 - BUCKETS.bit_length() + 1)
    sums = dealt.groupBy("sources", "rest", bucket.alias("bucket")).agg(F.sum("n_tokens").alias("n"))
    running = F.sum("n").over(Window.partitionBy("sources").orderBy("bucket"))
    edge = common.checkpointed(sums.withColumn("upto", running).where("upto > rest").groupBy("sources", "rest").agg(F.min(F.struct("bucket", "upto", "n")).alias("m")).select("sources", "rest", F.col("m.bucket").alias("edge"), (F.col("rest") - F.col("m.upto") + F.col("m.n")).alias("left")))
    near = dealt.drop("rest").withColumn("bucket", bucket).join(common.checked_broadcast(edge), "sources")
    inside = near.where("bucket = edge").withColumn("upto", F.sum("n_tokens").over(Window.partitionBy("sources").orderBy("draw", "text_key").rowsBetween(Window.unboundedPreceding, 0)))
    last = inside.select("text_key", "doc_id", "sources", "n_tokens", (F.col("whole") + (F.col("upto") <= F.col("left")).cast("int")).alias("copies"))
    sure = near.where("bucket <> edge").select("text_key", "doc_id", "sources", "n_tokens", (F.col("whole") + (F.col("bucket") < F.col("edge")).cast("int")).alias("copies"))
    return sure.union(last).where("copies > 0").select("text_key", "doc_id", F.array_join("sources", "|").alias("pattern"), "n_tokens", "copies"), flows


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """A row for each text that is chosen: doc_id, pattern (its sources, joined by |), n_tokens, copies.

    Documents without a token (null, empty, blank) are never chosen. A null source is 'unknown'. Repeated rows and
    exact copies are one text, under all their sources, with the least doc_id (nulls last). Texts of any length are read whole. Extra columns aren't read; an
    empty table, or one of nulls, gives an empty result. Equal draws go by the text's key.
    """
    return plan(docs, **parameters)[0].select("doc_id", "pattern", "n_tokens", "copies")


def select(docs: DataFrame, **parameters) -> DataFrame:
    """The chosen rows of docs, each as often as plan() says, with all their columns as they are.

    Of a text's rows, the one of the least doc_id (nulls last) is taken, and of rows that repeat id and text the one whose columns as JSON are least. Rows without a
    word, null and empty texts included, are never chosen; ties go as in mix(). Columns of clashing names are kept; a table without texts, or an empty
    one, gives none.
    """
    at_id, at_text = common.position(docs, "doc_id"), common.position(docs, "text")
    if at_text is None:
        return docs.limit(0)
    chosen = common.checkpointed(plan(docs, **parameters)[0].select("text_key", F.col("doc_id").alias("chosen_id"), "copies"))
    own = common.numbered(docs)
    id_, key = F.col(f"__{at_id}").cast("bigint") if at_id is not None else F.lit(None).cast("bigint"), text_key(F.col(f"__{at_text}").cast("string"))
    one = common.one_of_repeats(own, id_, key, F.col(f"__{at_text}").isNotNull())
    found = one.withColumn("k", key).join(common.checked_broadcast(chosen), (F.col("k") == F.col("text_key")) & id_.eqNullSafe(F.col("chosen_id")))
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select(*own.columns).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"))
