"""Near-duplicate removal: circulant MinHash (Li and Li 2021), banding, exact Jaccard verification, components.

A text's set is its shingles of ``shingle`` lower-case words. Each shingle falls on a place of a ring of 2**32 places. One permutation
(sigma) scatters the places, and all signature coordinates come from one more (pi): coordinate k is the least of pi,
circularly shifted by k, over the set's places. Both are bijections of 32-bit numbers that are computed and not stored, so the ring
is large enough for texts of any length: two unrelated texts of a million shingles meet in about one place in 4,000.

Documents with the same words in the same order are one content. Contents that agree in all coordinates of a band are
candidates. In a bucket every content is held against the least one. Where a bucket's members still lie in several components after
that, all pairs of different components that reach the threshold are found by a similarity join with prefix filter (Chaudhuri, Ganti and
Kaushik 2006): two sets that have the share t in common have one of the rarest 1 - t of their shingles in common, so only
contents that share a rare shingle meet. No bucket is capped, and none is expanded into its pairs.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHINGLE, THRESHOLD = 3, 0.55
BANDS, ROWS = 40, 4
SEED = 5
#: A band that more contents than this share is led by an aggregate instead of a window; at most so many bands are.
HOT_ROWS, HOT_BANDS = 10_000, 1000
#: Words whose hashes a worker keeps before it starts anew, and characters whose words are taken at once; results don't depend on them.
MAX_WORDS, PIECE = 300_000, 1 << 20
_WORD, _REST = re.compile(r"\w+"), re.compile(r"\w*")
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def permutations(seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The odd multipliers of sigma and of pi."""
    return np.random.default_rng(seed).integers(1 << 30, 1 << 31, 5, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def word_hashes(found: list[str]) -> np.ndarray:
    known = common.worker_store().setdefault("near_dedup_words", {})
    if len(known) > MAX_WORDS:
        known.clear()
    got = [*map(known.get, found)]
    if None in got:
        for i, h in enumerate(got):
            if h is None:
                w = found[i]
                got[i] = known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
    return np.array(got, np.uint64)


def text_hashes(text: str | None, piece: int = PIECE) -> np.ndarray:
    """A hash of each word in order; long texts are read in pieces that end between words."""
    text, at, out = (text or "").lower(), 0, []
    while at < len(text):
        end = _REST.match(text, min(len(text), at + piece)).end()
        out.append(word_hashes(_WORD.findall(text, at, end)))
        at = end
    return out[0] if len(out) == 1 else np.concatenate([np.zeros(0, np.uint64), *out])


def shingles(text: str | None, n: int = SHINGLE) -> tuple[np.ndarray, bytes | None]:
    """Hashes of the distinct shingles, and a digest of all words in order; a text of fewer words is one shingle."""
    h = text_hashes(text)
    if not len(h):
        return np.zeros(0, np.uint64), None
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * _P1
        out ^= out >> np.uint64(29)
    return np.unique(out), xxhash.xxh128_digest(h.tobytes())


def signature(hashes: np.ndarray, n_coordinates: int, odd: np.ndarray) -> np.ndarray:
    """For k from 0: the least of pi(sigma(x) + k) over the set's places x."""
    at = (hashes >> np.uint64(32)).astype(np.uint32)
    at ^= at >> np.uint32(15)
    at *= odd[0]
    at ^= at >> np.uint32(13)
    at *= odd[1]
    # pi begins with a multiplication, which the shift passes through.
    at *= odd[2]
    shift = np.arange(n_coordinates, dtype=np.uint32) * odd[2]
    out, size = np.full(n_coordinates, 0xFFFFFFFF, np.uint32), min(len(at), 512)
    z, high = np.empty((size, n_coordinates), np.uint32), np.empty((size, n_coordinates), np.uint32)
    for a in range(0, len(at), 512):
        p = at[a : a + 512]
        y, h = z[: len(p)], high[: len(p)]
        np.add(p[:, None], shift, out=y)
        for by, m in ((16, odd[3]), (15, odd[4])):
            np.right_shift(y, np.uint32(by), out=h)
            y ^= h
            y *= m
        np.minimum(out, y.min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band, the band's number included."""
    out = np.arange(1, bands + 1, dtype=np.uint64) * _P2
    for r in sig.reshape(bands, rows).astype(np.uint64).T:
        out = (out ^ r) * _P1
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the edges (a, b) with the least node of its component.

    Large-star and small-star steps in turn (Kiveris and others 2014) until nothing changes: a logarithm of rounds in practice.
    """
    e = common.checkpointed(edges.select("a", "b").where("a <> b").distinct())
    last = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: each larger neighbour of u is tied to the least of u and its neighbours.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours are tied to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("b"), F.col("m").alias("a")), F.struct(F.col("u").alias("b"), F.col("m").alias("a")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        e = common.checkpointed(small)
        state = e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if state == last:
            return e.select(F.col("b").alias("node"), F.col("a").alias("root")).union(e.select("a", "a").distinct())
        last = state


def contents(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_hash, content, bands) of the documents that have an id and a word."""
    odd = permutations()

    def run(x, _):
        out = [shingles(t, n) for t in x["text"]]
        keys = [band_keys(signature(s, bands * rows, odd), bands, rows) if len(s) else None for s, _ in out]
        return {"doc_id": x["doc_id"], "text_hash": x["text_hash"], "content": [c for _, c in out], "bands": keys}

    d = common.pick(docs, doc_id="bigint", text="string").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return common.map_batches(d.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), run, "doc_id bigint, text_hash bigint, content binary, bands array<bigint>", {"doc_id": pa.int64(), "text_hash": pa.int64(), "content": pa.binary(), "bands": pa.list_(pa.int64())}).where(F.col("content").isNotNull())


def buckets(keyed: DataFrame) -> DataFrame:
    """(band, content, leader) of the bands that several contents share; the leader is the least content.

    A window brings a bucket to one task. The bands that very many share are found first, by a sketch that moves nothing but itself, and their
    leaders by an aggregate that combines on the map side; which way a band takes doesn't change what comes out.
    """
    top = keyed.agg(F.expr(f"approx_top_k(band, {HOT_BANDS}, {10 * HOT_BANDS})").alias("x")).select(F.explode("x").alias("x"))
    hot = common.checkpointed(top.where(F.col("x.count") > HOT_ROWS).select(F.col("x.item").alias("band")))
    w = Window.partitionBy("band")
    cold = keyed.join(F.broadcast(hot), "band", "left_anti")
    out = cold.select("band", "content", F.min("content").over(w).alias("leader"), F.count("*").over(w).alias("n")).where("n > 1").drop("n")
    if hot.limit(1).count():
        some = keyed.join(F.broadcast(hot), "band", "left_semi")
        leaders = common.checkpointed(some.groupBy("band").agg(F.min("content").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n"))
        out = out.union(some.join(F.broadcast(leaders), "band").select("band", "content", "leader"))
    return common.checkpointed(out)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of contents whose sets have at least the threshold in common."""
    s = sets.select(F.col("content").alias("b"), F.col("shingles").alias("sb"))
    joined = pairs.join(s, "b").join(sets.select(F.col("content").alias("a"), F.col("shingles").alias("sa")), "a")
    both = F.size(F.array_intersect("sa", "sb"))
    return joined.where(both >= threshold * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def across(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b), a below b, of members (content, root) of different roots that share one of the rarest shingles of both: all that may reach the threshold are among them."""
    own = sets.join(members, "content").select("content", "root", F.size("shingles").alias("n"), "shingles")
    terms = own.select("content", F.explode("shingles").alias("term"))
    often = terms.groupBy("term").agg(F.count("*").alias("df"))
    # Shingles of one content alone count for the prefix but find nobody.
    ranked = terms.join(often, "term").groupBy("content").agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("t"))
    size = F.size("t")
    prefix = F.slice("t", 1, (size - F.ceil(size * threshold - 1e-9) + 1).cast("int"))
    rare = ranked.select("content", F.explode(F.filter(prefix, lambda x: x["df"] > 1)).alias("x")).select("content", F.col("x.term").alias("term"))
    rare = common.checkpointed(rare.join(own.select("content", "root", "n"), "content"))
    a, b = (rare.select("term", *(F.col(c).alias(f"{c}_{side}") for c in ("content", "root", "n"))) for side in "ab")
    met = a.join(b, "term").where((F.col("content_a") < F.col("content_b")) & (F.col("root_a") != F.col("root_b")) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")))
    return met.select(F.col("content_a").alias("a"), F.col("content_b").alias("b")).distinct()


def duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row for each document that has to go: doc_id, text_hash (xxhash64 of its text), kept_id (the document that stays for it).

    Of each group the least doc_id stays. Documents without a word (null, empty, punctuation only) and those without an id
    belong to no group. Rows that repeat both id and text are one document here. Different texts under one id are judged each
    on its own. Texts of any length are read whole. Extra columns aren't read; an empty table, or one of nulls, gives an empty result.
    """
    sig = common.checkpointed(contents(docs, n, bands, rows))
    # One row a content, with the document that stands for it, and whether others have it too.
    doc = F.struct("doc_id", "text_hash")
    unique = sig.groupBy("content").agg(F.min(doc).alias("m"), (F.max(doc) > F.min(doc)).alias("several"), F.first("bands").alias("bands"))
    unique = common.checkpointed(unique.select("content", "m.*", "several", "bands"))
    shared = buckets(unique.select(F.explode("bands").alias("band"), "content"))
    star = common.checkpointed(shared.where("content <> leader").select(F.col("leader").alias("a"), F.col("content").alias("b")).distinct())
    wanted = shared.select("content").distinct()
    ids = common.checkpointed(unique.select("content", "doc_id", "text_hash").join(wanted, "content", "left_semi"))
    texts = common.pick(docs, doc_id="bigint", text="string").where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("text_hash", F.xxhash64("text"))
    texts = texts.join(common.checked_broadcast(ids), ["doc_id", "text_hash"]).select("content", "text")

    def run(x, _):
        return {"content": x["content"], "shingles": [shingles(t, n)[0].view(np.int64) for t in x["text"]]}

    # Rows that repeat a document give its set twice; the aggregate leaves one.
    sets = common.checkpointed(common.map_batches(texts, run, "content binary, shingles array<bigint>", {"content": pa.binary(), "shingles": pa.list_(pa.int64())}).groupBy("content").agg(F.first("shingles").alias("shingles")))
    passed = common.checkpointed(verified(star, sets, threshold))
    roots = common.checkpointed(components(passed))
    # Where a bucket still holds several components, the links between them.
    member = shared.select("band", "content").join(roots.withColumnRenamed("node", "content"), "content", "left").withColumn("root", F.coalesce("root", "content"))
    split = member.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    mixed = common.checkpointed(member.join(split, "band", "left_semi").select("content", "root").distinct())
    pairs = common.checkpointed(across(mixed, sets, threshold).join(star, ["a", "b"], "left_anti"))
    more = common.checkpointed(verified(pairs, sets, threshold))
    if more.limit(1).count():
        roots = common.checkpointed(components(passed.union(more)))
    # Contents of several documents form a group even alone.
    group = unique.select("content", "doc_id", "several").join(roots.withColumnRenamed("node", "content"), "content", "left").where("several OR root IS NOT NULL").withColumn("root", F.coalesce("root", "content"))
    kept = common.checkpointed(group.join(group.groupBy("root").agg(F.min("doc_id").alias("kept_id")), "root").select("content", "kept_id"))
    return sig.select("doc_id", "text_hash", "content").join(common.checked_broadcast(kept), "content").where("doc_id <> kept_id").select("doc_id", "text_hash", "kept_id").distinct()


def keep_one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs without those that duplicates() names, with all their columns as they are.

    Of rows that repeat an id and a text that isn't null, the one whose columns as JSON are least stays. Rows without an id, without a text or without a word all
    stay, as do ties of different texts under one id. Columns of clashing names are kept; a table without ids or texts comes
    back as it is; an empty one gives none.
    """
    at_id, at_text = common.position(docs, "doc_id"), common.position(docs, "text")
    if at_id is None or at_text is None:
        return docs
    gone = common.checkpointed(duplicates(docs, **parameters).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")))
    own = common.numbered(docs)
    id_, hash_ = F.col(f"__{at_id}").cast("bigint"), F.xxhash64(F.col(f"__{at_text}").cast("string"))
    kept = own.join(common.checked_broadcast(gone), (id_ == F.col("gone_id")) & (hash_ == F.col("gone_hash")), "left_anti")
    return common.one_of_repeats(kept, id_, hash_, F.col(f"__{at_id}").isNotNull() & F.col(f"__{at_text}").isNotNull()).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of a document that goes, kept_id of the one that stays for it."""
    return duplicates(common.table(spark, sf_dir, "documents")).select("doc_id", "kept_id").distinct()
