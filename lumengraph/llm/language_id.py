"""Language identification by prediction with partial matching (PPM).

A context tree per language, over bytes, of contexts of up to ``order`` bytes. From counts frozen after training, method C
gives p(b | context) = count / (n + d) and the escape probability d / (n + d), n being the count of all bytes seen in the
context and d the number of different ones; a context that a language never saw costs nothing to leave, and below the
empty context each byte costs 8 bits. No exclusion is made. A text costs each language the sum of its bytes' code
lengths; the smallest sum wins. Costs are whole 1/1024 bits, so sums don't depend on the order of addition.

A text is accepted if the winner's contexts gain something: if it costs less than the letters alone do, which is the least
sum, over the languages, of code lengths in the empty context. Texts in a language that isn't known, shuffled letters,
code and random bytes cost more than that by several bits a byte, texts in a known language about 1.7 less. The rule
is the same for texts of all lengths.

Training takes ``docs_per_lang`` different documents of each of the ``max_langs`` languages that most documents carry, those with the least hash of their
id: these bounds are parameters. Scoring covers every byte of every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

ORDER = 4
DOCS_PER_LANG, MAX_LANGS = 200, 200
#: Bits a byte that the contexts must gain on the letters alone.
MIN_GAIN = 0.0
UNIT = 1024
_MULT = np.uint64(0x9E3779B97F4A7C15)


class HashTable:
    """Open addressing in two numpy arrays: uint64 keys to row numbers, looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(len(keys) * 2).bit_length()))
        n = 1 << (64 - int(self.shift))
        self.mask = np.int64(n - 1)
        self.keys, self.rows = np.zeros(n, np.uint64), np.full(n, -1, np.int32)
        slot = ((keys * _MULT) >> self.shift).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.rows[slot[todo]] < 0]
            at, first = np.unique(slot[free], return_index=True)
            self.keys[at], self.rows[at] = keys[free[first]], free[first]
            todo = np.setdiff1d(todo, free[first], assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    def find(self, codes: np.ndarray) -> np.ndarray:
        slot = ((codes * _MULT) >> self.shift).astype(np.int64)
        out = self.rows[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != codes))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            s = slot[todo]
            out[todo] = self.rows[s]
            todo = todo[(self.rows[s] >= 0) & (self.keys[s] != codes[todo])]
        return out


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """The code of the n bytes that end at each place, from place n-1 on."""
    out = np.zeros(len(data) - n + 1, np.uint64)
    for i in range(n):
        out = (out << np.uint64(8)) | data[i : len(data) - n + 1 + i].astype(np.uint64)
    return out


def lead(order: int) -> bytes:
    """What stands before every text, so that its first bytes have a context too."""
    return b"\n" * order


class Model:
    """Frozen statistics of all languages, compiled to tables of costs by context order."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER):
        self.order, self.langs = order, sorted(texts)
        self.tables: list[tuple] = []
        n_langs = len(self.langs)
        data = {k: [np.frombuffer(lead(order) + t.encode("utf-8", "replace"), np.uint8) for t in texts[k]] for k in self.langs}
        below = None
        for j in range(order + 1):
            counts, contexts = [], []
            for k in self.langs:
                parts = [grams(d[order - j :], j + 1) for d in data[k] if len(d) > order]
                g, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
                ctx, first, d = np.unique(g >> np.uint64(8), return_index=True, return_counts=True)
                n = np.add.reduceat(c, first) if len(c) else c
                counts.append((g, c)), contexts.append((ctx, n, d))
            union = np.unique(np.concatenate([np.zeros(0, np.uint64), *(g for g, _ in counts)])) if j else np.arange(256, dtype=np.uint64)
            union_ctx = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x for x, _, _ in contexts)]))
            cost, escape = np.zeros((len(union), n_langs), np.int32), np.zeros((len(union_ctx), n_langs), np.int32)
            rest = below(union & np.uint64(256 ** j - 1)) if j else np.full((256, n_langs), 8 * UNIT, np.int32)
            for x in range(n_langs):
                (g, c), (ctx, n, d) = counts[x], contexts[x]
                if not len(g):
                    cost[:, x] = rest[:, x]
                    continue
                esc = np.rint(-np.log2(d / (n + d)) * UNIT).astype(np.int32)
                escape[np.searchsorted(union_ctx, ctx), x] = esc
                at = np.minimum(np.searchsorted(ctx, union >> np.uint64(8)), len(ctx) - 1)
                known = ctx[at] == union >> np.uint64(8)
                cost[:, x] = rest[:, x] + np.where(known, esc[at], 0)
                seen = np.searchsorted(union, g)
                own = np.searchsorted(ctx, g >> np.uint64(8))
                cost[seen, x] = np.rint(-np.log2(c / (n[own] + d[own])) * UNIT).astype(np.int32)
            table = (union, cost, union_ctx, escape)
            self.tables.append((HashTable(union), cost, HashTable(union_ctx), escape))
            below = lambda codes, t=table: t[1][np.searchsorted(t[0], codes)]

    def costs(self, data: np.ndarray) -> np.ndarray:
        """Cost of each byte after the lead by language; data begins with the lead."""
        total = np.zeros((max(0, len(data) - self.order), len(self.langs)), np.int32)
        if not len(total) or not self.langs:
            return total
        codes, todo = grams(data, self.order + 1), None
        for j in range(self.order, -1, -1):
            find, cost, find_ctx, escape = self.tables[j]
            now = codes if todo is None else codes[todo]
            row = now.astype(np.int64) & 255 if j == 0 else find.find(now)
            hit = row >= 0
            if todo is None:
                total[hit] = cost[row[hit]]
                todo = np.flatnonzero(~hit)
            else:
                total[todo[hit]] += cost[row[hit]]
                todo = todo[~hit]
            if not len(todo):
                break
            ctx = find_ctx.find(codes[todo] >> np.uint64(8))
            ok = ctx >= 0
            total[todo[ok]] += escape[ctx[ok]]
            codes[todo] &= np.uint64(256**j - 1)
        return total

    def score(self, texts: list[str | None], chunk: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code lengths in 1/1024 bits, by text and language; bytes by text; the least code length of the letters alone by text. Long texts are scored in pieces that overlap by the context, which gives the same sums."""
        out, size, letters = np.zeros((len(texts), len(self.langs)), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        single = self.tables[0][1].astype(np.int64)
        pending, count = [], 0

        def flush():
            nonlocal pending, count
            if pending:
                data = np.concatenate([p for _, p in pending])
                costs = self.costs(np.concatenate([np.zeros(self.order, np.uint8), data]))
                start = 0
                for i, p in pending:  # the lead of each piece isn't part of its text
                    out[i] += costs[start + self.order : start + len(p)].sum(axis=0, dtype=np.int64)
                    start += len(p)
            pending, count = [], 0

        for i, t in enumerate(texts):
            raw = np.frombuffer(lead(self.order) + (t or "").encode("utf-8", "replace"), np.uint8)
            size[i] = len(raw) - self.order
            if self.langs:
                letters[i] = (np.bincount(raw[self.order :], minlength=256) @ single).min()
            for a in range(0, size[i], chunk):
                pending.append((i, raw[a : a + chunk + self.order]))
                count += len(pending[-1][1])
                if count >= chunk:
                    flush()
        flush()
        return out, size, letters

    def decide(self, texts: list[str | None], min_gain: float = MIN_GAIN, wanted: frozenset[str] | None = None) -> dict[str, list]:
        bits, size, letters = self.score(texts)
        n = len(texts)
        if not self.langs:
            return {"language": ["und"] * n, "bits": [None] * n, "margin_bits": [None] * n, "gain_bits": [None] * n, "accepted": [False] * n}
        best = bits.argmin(axis=1)
        low = bits[np.arange(n), best]
        rest = np.partition(bits, 1, axis=1)[:, 1] if len(self.langs) > 1 else low
        ok = (size > 0) & (letters - low > min_gain * size * UNIT)
        if wanted is not None:
            ok &= np.array([x in wanted for x in self.langs])[best]
        whole = lambda x: [v / UNIT if s else None for v, s in zip(x.tolist(), size)]
        return {"language": [self.langs[b] if s else "und" for b, s in zip(best, size)], "bits": whole(low), "margin_bits": whole(rest - low), "gain_bits": whole(letters - low), "accepted": ok.tolist()}


def train(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, order: int = ORDER, max_langs: int = MAX_LANGS) -> Model:
    """Statistics of documents that carry a language, a text and an id; rows that repeat all three count once, ties of the hash go by id, then by the text's hash.

    No labelled text gives a model without languages. Never more than docs_per_lang * max_langs texts come to the driver.
    """
    d = common.pick(docs, doc_id="bigint", text="string", lang="string").where("lang IS NOT NULL AND doc_id IS NOT NULL AND text <> ''")
    langs = [r.lang for r in d.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()]
    if not langs:
        return Model({}, order)
    d = d.where(F.col("lang").isin(langs)).withColumn("h", F.xxhash64("text"))
    # Ids and hashes are ranked, not texts; repeats share a rank.
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "h")
    key = ["lang", "doc_id", "h"]
    chosen = d.select(*key).withColumn("n", F.dense_rank().over(w)).where(F.col("n") <= docs_per_lang).select(*key).distinct()
    rows = d.join(F.broadcast(chosen), key).groupBy(*key).agg(F.first("text").alias("text")).collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.doc_id, r.h)):
        texts.setdefault(r.lang, []).append(r.text)
    return Model(texts, order)


def identify(docs: DataFrame, model: Model, min_gain: float = MIN_GAIN, wanted: set[str] | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, language, bits (of the whole text under that language), margin_bits (by which the next is longer), gain_bits (on the letters alone), accepted.

    wanted: only these languages are accepted; None means all that the model knows. Null and empty texts: 'und', null bits, not
    accepted. Equal code lengths: the first language by name; a gain of just min_gain isn't accepted. Repeated rows are judged one by one,
    null ids are carried, extra columns are not read, an empty table gives an empty result. Texts of any length are scored
    whole, in pieces that share their context. A model without languages accepts nothing.
    """
    only = None if wanted is None else frozenset(wanted)
    kinds = {"doc_id": pa.int64(), "language": pa.string(), "bits": pa.float64(), "margin_bits": pa.float64(), "gain_bits": pa.float64(), "accepted": pa.bool_()}
    return common.map_batches(
        common.pick(docs, doc_id="bigint", text="string"),
        lambda x, _: {"doc_id": x["doc_id"]} | model.decide(x["text"], min_gain, only),
        "doc_id bigint, language string, bits double, margin_bits double, gain_bits double, accepted boolean", kinds,
    )


def keep_identified(docs: DataFrame, model: Model, min_gain: float = MIN_GAIN, wanted: set[str] | None = None) -> DataFrame:
    """The rows of docs that identify() accepts, with all their columns as they are, but lang, where there is one: it becomes the language found.

    Null and empty texts go. Rows that repeat are judged one by one and stay as often as they come; ties as in identify(). Null ids
    and nulls in any other column stay as they are; columns of clashing names, too. An empty table, or one without text, gives none.
    """
    at, lang = common.position(docs, "text"), common.position(docs, "lang")
    only = None if wanted is None else frozenset(wanted)
    if at is None:
        return docs.limit(0)
    if lang is not None and dict(docs.dtypes).get(docs.columns[lang]) != "string":
        lang = None

    def run(batches):
        for whole in batches:
            for b in common.slices(whole):
                found = model.decide(b.column(at).to_pylist(), min_gain, only)
                columns = list(b.columns)
                if lang is not None:
                    columns[lang] = pa.array(found["language"], b.schema.field(lang).type)
                yield pa.RecordBatch.from_arrays(columns, schema=b.schema).filter(pa.array(found["accepted"], pa.bool_()))

    own = common.numbered(docs)
    return own.mapInArrow(run, own.schema).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
