"""Each operator against brute force, an exact round trip or held-out accuracy."""

import collections
import hashlib
import itertools
import json
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumengraph.llm import ann, bit_packing, chat_format, html_extract, language_id, mixing, near_dedup, order_minhash, packing, registry, token_count


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# Token counts


def test_counts_are_the_best_segmentation(spark, docs):
    """Viterbi over every word by itself, character by character."""
    pieces, known = token_count.load_pieces(), {}

    def count(word):
        if word not in known:
            t = "▁" + word
            best = [(0, 0)] + [None] * len(t)
            for end in range(1, len(t) + 1):
                options = [(s, n) for s, n in ((-(best[a][0] + pieces[t[a:end]]), best[a][1] + 1) for a in range(end) if t[a:end] in pieces)]
                if t[end - 1] not in pieces:
                    size = len(t[end - 1].encode())
                    options.append((-(best[end - 1][0] + token_count.UNKNOWN * size), best[end - 1][1] + size))
                s, n = min(options)
                best[end] = (-s, n)
            known[word] = best[-1][1]
        return known[word]

    texts = {r.doc_id: r.text for r in docs.limit(60).collect()}
    got = {r.doc_id: (r.n_tokens, r.n_pretokens) for r in token_count.count_tokens(docs.where(F.col("doc_id").isin(list(texts))), pieces).collect()}
    assert got == {i: (sum(map(count, t.split())), len(t.split())) for i, t in texts.items()}


def test_the_trie_keeps_terminal_counts():
    t = token_count.Trie(token_count.Pieces({"▁": -3, "a": -2, "b": -2, "ab": -3, "▁a": -4}))
    assert [t.insert(w) for w in ("ab", "abab", "ab", "b")] == [2, 3, 2, 2]
    # mark, a, b, a, b for the first three words, one more for the last: shared prefixes are scored once
    assert len(t.score) == 7 and [n for n in t.terminal if n >= 0] == [2, 3, 2]
    c = token_count.Counter({"▁": -3, "a": -2})
    c.trie.clear()
    assert c.count(["a a", None, "", "aa"]) == [(4, 2), (0, 0), (0, 0), (3, 1)]


# Fingerprints


def test_fingerprints_by_brute_force(spark, docs):
    mult, add = (x.tolist() for x in order_minhash.orders(order_minhash.M, order_minhash.SEED))
    mask = 2**64 - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def one(t):
        k, seen, items = min(order_minhash.K, len(t)), collections.Counter(), []
        for a in range(len(t) - k + 1):
            c = 0
            for ch in t[a : a + k]:
                c = (c * 0x100000001B3 + ord(ch)) & mask
            c = mix(c)
            items.append((c, mix((c + mix(seen[c] + 1)) & mask)))
            seen[c] += 1
        out = []
        for j in range(order_minhash.M):
            least = sorted(sorted(range(len(items)), key=lambda i: ((items[i][1] * mult[j] + add[j]) & mask, i))[: order_minhash.L])
            h = j + 1
            for i in least:
                h = mix((h * 0x100000001B3 + items[i][0]) & mask)
            out.append(h - 2**64 if h >= 2**63 else h)
        return out

    some = docs.where("n_chars < 1200").limit(25)
    texts = {r.doc_id: r.text for r in some.collect()}
    got = {r.doc_id: r.fingerprint for r in order_minhash.fingerprints(docs.where(F.col("doc_id").isin(list(texts)))).collect()}
    assert got == {i: one(t) for i, t in texts.items()}


def test_fingerprints_feel_order(spark):
    r = random.Random(6)
    parts = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(60)) for _ in range(40)]
    text, moved, edited = "".join(parts), "".join(parts[20:] + parts[:20]), "".join(parts[:7] + [parts[7][:30], "!"] + parts[8:])
    shuffled = "".join(random.Random(1).sample(parts, 40))
    d = spark.createDataFrame([(0, text), (1, edited), (2, moved), (3, shuffled)], "doc_id bigint, text string")
    f = {r.doc_id: r.fingerprint for r in order_minhash.fingerprints(d, m=512).collect()}
    same = lambda i: sum(a == b for a, b in zip(f[0], f[i]))
    assert same(1) > same(2) > same(3)


# Nearest neighbours


def brute_nearest(m, ids, asked, k=10):
    """{id: the set of its k nearest others}"""
    out = {}
    for q in np.flatnonzero(asked):
        d = ((m - m[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        out[int(ids[q])] = {int(x) for x in ids[np.lexsort((ids, d))[:k]]}
    return out


@pytest.mark.parametrize("shard_rows", [ann.SHARD_ROWS, 120])
def test_recall_against_brute_force(spark, sf, shard_rows):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = v.collect()
    m, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
    want, place = brute_nearest(m, ids, np.ones(len(ids), bool)), {int(i): n for n, i in enumerate(ids)}
    got = collections.defaultdict(dict)
    for r in ann.nearest(v, shard_rows=shard_rows).collect():
        got[r.vec_id][r.rank] = (r.distance, r.neighbour_id)
    assert all(sorted(x) == list(range(1, 11)) and [x[k] for k in range(1, 11)] == sorted(x.values()) for x in got.values())
    assert all(math.isclose(dist, np.sqrt(((m[place[q]] - m[place[n]]) ** 2).sum()), rel_tol=1e-9) for q, x in got.items() for dist, n in x.values())
    assert np.mean([len(want[q] & {n for _, n in got[q].values()}) / 10 for q in want]) >= 0.95


def test_the_query_asks_for_a_hundredth(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    m, ids = np.array([r.embedding for r in rows], np.float64), np.array([r.vec_id for r in rows])
    want, got = brute_nearest(m, ids, ids % 100 == 0), collections.defaultdict(set)
    for r in registry.QUERIES["op3_nearest_neighbours"](spark, sf).collect():
        got[r.vec_id].add(r.neighbour_id)
    assert len(want) > 1 and got.keys() == want.keys() and np.mean([len(want[q] & got[q]) / 10 for q in want]) >= 0.95


def test_recall_on_a_larger_shard():
    r = np.random.default_rng(2)
    m = r.normal(size=(6000, 64)).astype(np.float32)
    g = ann.build(np.arange(6000), m)
    q, near, _ = g.neighbours(np.arange(300), m[:300], 10)
    want = brute_nearest(m.astype(float), np.arange(6000), np.arange(6000) < 300)
    assert np.mean([len(set(near[q == i].tolist()) & want[i]) / 10 for i in range(300)]) >= 0.9


def test_groups_need_few_cells(spark):
    """Where the vectors form groups, a query visits few of the cells and still finds its neighbours."""
    r = np.random.default_rng(5)
    m = (r.normal(size=(40, 16))[np.arange(4000) % 40] * 8 + r.normal(size=(4000, 16))).astype(np.float32)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id bigint, embedding array<float>")
    own = ann.index(v, shard_rows=200)
    assert len(own.centroids[16]) == 40 and own.probes[16] < 14
    want, got = brute_nearest(m.astype(float), np.arange(4000), np.arange(4000) % 50 == 0), collections.defaultdict(set)
    for x in ann.search(own, v.where("vec_id % 50 = 0")).collect():
        got[x.vec_id].add(x.neighbour_id)
    assert np.mean([len(want[q] & got[q]) / 10 for q in want]) >= 0.95
    one = ann.search(own, v.where("vec_id % 50 = 0"), probes={16: 1})
    assert one.count() <= 800 and one.where("rank > 10").count() == 0


def test_a_third_are_copies(spark):
    """Copies of one vector spread over several shards; they find one another, and hide no other row's neighbours."""
    r = np.random.default_rng(3)
    m = r.normal(size=(1200, 8)).astype(np.float32)
    m[::3] = m[0]
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id bigint, embedding array<float>")
    got = collections.defaultdict(set)
    for x in ann.nearest(v, v.where("vec_id % 100 < 3"), shard_rows=100).collect():
        got[x.vec_id].add(x.neighbour_id)
    want = brute_nearest(m.astype(float), np.arange(1200), np.arange(1200) % 100 < 3)
    assert np.mean([len(want[q] & got[q]) / 10 for q in want]) >= 0.97
    assert all(got[q] == want[q] for q in want if q % 3 == 0)


# Bit packing


def test_packed_ids_come_back(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=bit_packing.VOCABULARY)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bit_packing.pack_tokens(docs, bit_packing.load_model(), block_ids=64).collect():
        want = sp.encode(texts[r.doc_id])
        assert r.n_tokens == len(want) and r.bit_width == 15 and len(r.packed) == -(-15 * len(want) // 8)
        assert bit_packing.unpack(r.packed, 15, r.n_tokens).tolist() == want
        for b in range(len(r.block_offsets)):
            assert bit_packing.unpack_block(r.packed, 15, r.n_tokens, r.block_offsets, b, 64).tolist() == want[64 * b : 64 * b + 64]
        if want:
            assert bit_packing.unpack(r.packed, 15, 1, len(want) // 2).tolist() == [want[len(want) // 2]]


def test_bits_in_pieces():
    """However many ids are spread into bits at once, the bytes are those of one long row of bits."""
    ids = np.random.default_rng(1).integers(0, 1 << 15, 3 * bit_packing.PACK_IDS + 5)
    whole = "".join(f"{i:015b}" for i in ids.tolist())
    whole += "0" * (-len(whole) % 8)
    assert bit_packing.pack(ids, 15) == int(whole, 2).to_bytes(len(whole) // 8, "big")


def test_widths():
    assert [bit_packing.bit_width(n) for n in (1, 2, 3, 256, 257, 50257)] == [1, 1, 2, 8, 9, 16]
    with pytest.raises(ValueError):
        bit_packing.pack(np.array([8]), 3)


# Mixing


def brute_flow(capacity, quota, passes):
    """Least cost of a maximum flow by trying every split, for tiny cases."""
    arcs = [(p, s) for p in capacity for s in p]
    best = None
    for split in itertools.product(*(range(min(quota[s], capacity[p] * passes) + 1) for p, s in arcs)):
        by_p, by_s = collections.Counter(), collections.Counter()
        for (p, s), f in zip(arcs, split):
            by_p[p] += f
            by_s[s] += f
        if all(by_s[s] <= quota[s] for s in quota) and all(by_p[p] <= capacity[p] * passes for p in capacity):
            cost = sum(sum((i // capacity[p]) for i in range(by_p[p])) for p in capacity)
            key = (-sum(split), cost)
            best = key if best is None or key < best else best
    return best


def test_flow_has_the_least_cost():
    r = random.Random(5)
    for _ in range(25):
        capacity = {("a",): r.randint(1, 3), ("a", "b"): r.randint(1, 3), ("b",): r.randint(1, 2)}
        quota = {"a": r.randint(0, 5), "b": r.randint(0, 5)}
        got = mixing.route(capacity, quota, 3)
        used = {p: sum(f.values()) for p, f in got.items()}
        cost = sum(sum(i // capacity[p] for i in range(n)) for p, n in used.items())
        assert (-sum(used.values()), cost) == brute_flow(capacity, quota, 3)
        assert all(sum(f.get(s, 0) for f in got.values()) <= quota[s] for s in quota)


def test_passes_rise_until_quotas_are_met():
    tokens = {f"s{i:02}": 100_000 for i in range(20)} | {"rare": 2_000}
    quota = mixing.quotas(tokens, sum(tokens.values()), None)
    assert quota["rare"] > 4 * tokens["rare"]
    assert {s: f[s] for (s,), f in mixing.route({(s,): n for s, n in tokens.items()}, quota).items()} == quota
    assert mixing.route({("a",): 1, ("a", "b"): 2}, {"a": 10**9, "b": 7, "none": 5})[("a",)]["a"] > 10**8
    r = random.Random(6)
    for _ in range(6):
        capacity = {("a",): r.randint(1, 2), ("a", "b"): r.randint(1, 2), ("b",): 1}
        quota = {"a": r.randint(0, 14), "b": r.randint(0, 11)}
        got = mixing.route(capacity, quota)
        cost = sum(sum(i // capacity[p] for i in range(sum(f.values()))) for p, f in got.items())
        assert (-sum(sum(f.values()) for f in got.values()), cost) == brute_flow(capacity, quota, 25)


def brute_mix(rows, draw):
    """The flow's choice, text by text, in plain Python: (pattern, tokens, copies) by doc_id. rows: (doc_id, text, source)."""
    sources, n, first = collections.defaultdict(set), {}, {}
    for i, t, s in rows:
        if t.split():
            sources[t].add(s)
            n[t] = len(t.split())
            first[t] = min(i, first.get(t, i))
    pattern = {t: tuple(sorted(s)) for t, s in sources.items()}
    capacity, by_source = collections.Counter(), collections.Counter()
    for t, p in pattern.items():
        capacity[p] += n[t]
        by_source.update({s: n[t] for s in p})
    flow, out = mixing.route(dict(capacity), mixing.quotas(dict(by_source), sum(capacity.values()), None)), {}
    for p, f in flow.items():
        key = {t: hashlib.md5(t.encode()).digest() for t in pattern if pattern[t] == p}
        whole, rest = divmod(sum(f.values()), capacity[p])
        upto = 0
        for t in sorted(key, key=lambda t: (draw[key[t]], key[t])):
            upto += n[t]
            copies = whole + (upto <= rest)
            if copies:
                out[first[t]] = ("|".join(p), n[t], copies)
    return out


@pytest.fixture(scope="module")
def draw(docs):
    """The seeded place of each text in its pattern's order."""
    k = docs.select(mixing.text_key(F.col("text")).alias("k")).distinct()
    return {bytes(r.k): r.d for r in k.select("k", F.shiftrightunsigned(F.xxhash64("k", F.lit(mixing.SEED)), 1).alias("d")).collect()}


def test_mix_by_brute_force(docs, draw):
    want = brute_mix([(r.doc_id, r.text, r.source) for r in docs.collect()], draw)
    assert {r.doc_id: (r.pattern, r.n_tokens, r.copies) for r in mixing.mix(docs).collect()} == want


def test_weights_are_met(spark):
    rows = [(i, f"text {i} " + "w " * 8, f"s{i % 2}") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(d, weights={"s0": 3, "s1": 1}, budget=2400).groupBy("pattern").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n")).collect()
    assert {r.pattern: r.n for r in got} == {"s0": 1800, "s1": 600}


# Near copies


def brute_duplicates(rows):
    """(doc_id, kept_id) from the components of all pairs at the threshold, every pair tried. rows: (doc_id, text)."""
    words = {i: re.findall(r"\w+", t.lower()) for i, t in rows}
    sets = {i: {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} for i, w in words.items() if w}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both >= near_dedup.THRESHOLD * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {(i, find(i)) for i in sets if find(i) != i}


def test_duplicates_by_brute_force(docs):
    want = brute_duplicates([(r.doc_id, r.text) for r in docs.collect()])
    got = {(r.doc_id, r.kept_id) for r in near_dedup.duplicates(docs).collect()}
    assert len(got & want) >= 0.95 * len(want) and not {d for d, _ in got} - {d for d, _ in want}


def test_hot_groups_and_edits(spark):
    r = random.Random(3)
    base = [f"word{r.randrange(5000)}" for _ in range(300)]
    edit = lambda k: " ".join(w if r.random() > 0.03 else f"new{r.randrange(9999)}" for w in base) if k else " ".join(base)
    rows = [(i, edit(i % 3)) for i in range(900)] + [(1000 + i, " ".join(f"w{r.randrange(5000)}" for _ in range(120))) for i in range(100)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(x.doc_id, x.kept_id) for x in near_dedup.duplicates(d).collect()}
    assert got == {(i, 0) for i in range(1, 900)}
    assert {x.doc_id for x in near_dedup.keep_one_of_each(d).collect()} == {0, *range(1000, 1100)}


def test_hot_bands_come_out_alike(docs, monkeypatch):
    want = sorted(map(tuple, near_dedup.duplicates(docs).collect()))
    monkeypatch.setattr(near_dedup, "HOT_ROWS", 1)
    assert sorted(map(tuple, near_dedup.duplicates(docs).collect())) == want


def test_the_prefix_join_finds_all_pairs(spark):
    r = random.Random(7)
    base = [r.sample(range(3000), 60) for _ in range(12)]
    sets = [sorted({*r.sample(b, r.randrange(20, 60)), *r.sample(range(9000, 9040), r.randrange(0, 30))}) for b in base for _ in range(12)]
    s = spark.createDataFrame([(bytearray([i]), x) for i, x in enumerate(sets)], "content binary, shingles array<bigint>")
    members = s.selectExpr("content", "unhex(lpad(hex(ascii(substring(hex(content), 2, 1)) % 3), 2, '0')) AS root")
    root = {bytes(x.content)[0]: bytes(x.root) for x in members.collect()}
    got = {(bytes(x.a)[0], bytes(x.b)[0]) for x in near_dedup.verified(near_dedup.across(members, s, 0.55), s, 0.55).collect()}
    want = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if root[a] != root[b] and len({*sets[a]} & {*sets[b]}) >= 0.55 * len({*sets[a]} | {*sets[b]})}
    assert len(want) > 20 and got == want


def test_signatures_estimate_jaccard():
    odd = near_dedup.permutations()
    words = [f"w{i}" for i in range(900)]
    sig = lambda w: near_dedup.signature(near_dedup.shingles(" ".join(w), 1)[0], 512, odd)
    assert np.mean(sig(words[:600]) == sig(words[300:])) == pytest.approx(1 / 3, abs=0.08)


def test_signatures_by_brute_force():
    """One permutation for all coordinates, shifted around the ring; neither collides."""
    odd, m = near_dedup.permutations().tolist(), 2**32 - 1

    def sigma(x):
        x = (x ^ x >> 15) * odd[0] & m
        return (x ^ x >> 13) * odd[1] & m

    def pi(x):
        x = x * odd[2] & m
        x = (x ^ x >> 16) * odd[3] & m
        return (x ^ x >> 15) * odd[4] & m

    h = np.random.default_rng(4).integers(0, 2**63, 700, dtype=np.uint64)
    places = [sigma(int(x) >> 32) for x in h]
    assert near_dedup.signature(h, 40, near_dedup.permutations()).tolist() == [min(pi((p + k) & m) for p in places) for k in range(40)]
    assert len({pi(sigma(x)) for x in range(100_000)}) == 100_000


def test_long_unrelated_texts_are_no_candidates():
    r = np.random.default_rng(6)
    a, b = (near_dedup.band_keys(near_dedup.signature(r.integers(0, 2**63, 2_000_000, dtype=np.uint64), 160, near_dedup.permutations()), 40, 4) for _ in "ab")
    assert not set(a) & set(b)


def test_words_in_pieces():
    text = "".join(random.Random(8).choice("ab c,ß漢") for _ in range(5000))
    assert near_dedup.text_hashes(text, 7).tolist() == near_dedup.text_hashes(text).tolist() == near_dedup.word_hashes(re.findall(r"\w+", text.lower())).tolist()


# HTML


def test_held_out_pages(spark, sf):
    """Fitted on some pages, right on others, whose own marks are the truth."""
    pages = spark.read.parquet(sf.replace("0.001", "0.01") + "/pages.parquet")
    fit, rest = pages.where("page_id % 2 = 0"), pages.where("page_id % 2 = 1")
    truth = {}
    for r in rest.collect():
        y = html_extract.marked(html_extract.blocks(r.html))
        if y is not None:
            truth[r.page_id] = y
    got = {r.page_id: r.labels for r in html_extract.extract(rest, html_extract.train(fit)).collect()}
    right = [a == bool(b) for i, y in truth.items() for a, b in zip(got[i], y)]
    assert len(truth) > 20 and np.mean(right) > 0.97


def test_labels_by_brute_force():
    """The forward pass, one block and one unit at a time."""
    r = np.random.default_rng(1)
    m = html_extract.Labeller(hidden=3)
    m.fit([r.normal(size=(3, html_extract.WIDTH))], [np.array([0.0, 1.0, 0.0])], epochs=2)
    sequences = [r.normal(size=(n, html_extract.WIDTH)) for n in (1, 4, 6)]
    sigmoid = lambda z: 1 / (1 + math.exp(-z))

    def states(rows, d):
        h, c, out = [0.0] * 3, [0.0] * 3, []
        for x in rows if d == "f" else rows[::-1]:
            z = [m.w[f"c{d}"][j] + sum(x[i] * m.w[f"x{d}"][i, j] for i in range(len(x))) + sum(h[i] * m.w[f"h{d}"][i, j] for i in range(3)) for j in range(12)]
            c = [sigmoid(z[3 + u]) * c[u] + sigmoid(z[u]) * math.tanh(z[9 + u]) for u in range(3)]
            h = [sigmoid(z[6 + u]) * math.tanh(c[u]) for u in range(3)]
            out.append(h)
        return out if d == "f" else out[::-1]

    p = m.probabilities(*html_extract.padded(sequences))
    for row, s in zip(p, sequences):
        for got, f, b in zip(row, states(s, "f"), states(s, "b")):
            assert got == pytest.approx(sigmoid(m.w["k"][0] + sum(x * w for x, w in zip(f + b, m.w["o"]))))
    assert [y.tolist() for y in m.label(sequences)] == [(row[: len(s)] >= 0.5).tolist() for row, s in zip(p, sequences)]


def test_lstm_gradients():
    r = np.random.default_rng(0)
    m = html_extract.Labeller(hidden=3)
    x, mask = html_extract.padded([r.normal(size=(4, html_extract.WIDTH)), r.normal(size=(2, html_extract.WIDTH))])
    y = (r.random(mask.shape) > 0.5).astype(float)
    _, g = m.gradients(x, mask, y)
    for k, w in m.w.items():
        at = tuple(r.integers(0, n) for n in w.shape)
        w[at] += 1e-5
        up = m.gradients(x, mask, y)[0]
        w[at] -= 2e-5
        down = m.gradients(x, mask, y)[0]
        w[at] += 1e-5
        assert g[k][at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_context_decides():
    """A block's label depends on its neighbours: the same words before and after a heading."""
    a = html_extract.blocks("<div><p>same words</p><h1>Start</h1><p>same words</p></div>")
    assert [t for _, t, _ in a] == ["same words", "Start", "same words"]
    v = html_extract.vectors(a)
    m = html_extract.Labeller()
    m.fit([v] * 16, [np.array([0.0, 0.0, 1.0])] * 16, epochs=60)
    assert m.label([v])[0].tolist() == [False, False, True]


# Packing


def first_fit(sizes, capacity):
    room, out = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((b for b, r in enumerate(room) if r >= sizes[i]), None)
        if b is None:
            b, room = len(room), [*room, capacity]
        out[i] = (b, capacity - room[b])
        room[b] -= sizes[i]
    return out


def test_tournament_is_first_fit():
    r = random.Random(1)
    for n in (0, 1, 7, 300):
        sizes = [r.randint(1, 50) for _ in range(n)]
        assert packing.first_fit_decreasing(sizes, 50) == first_fit(sizes, 50)


def test_pack_by_brute_force(spark, docs):
    sizes = sorted((r.doc_id, len(r.text.split())) for r in docs.collect())
    pieces = [(i, k, min(512, n - 512 * k)) for i, n in sizes for k in range(-(-n // 512))]
    want = {(i, k): (n, *p) for (i, k, n), p in zip(pieces, first_fit([n for _, _, n in pieces], 512))}
    assert {(r.doc_id, r.piece): (r.n_tokens, r.bin_id, r.bin_offset) for r in packing.pack(docs, 512).collect()} == want


def test_repeats_fill_no_group(spark):
    d = spark.range(30_000).selectExpr("CASE WHEN id % 3 > 0 THEN id END AS doc_id", "'a b c' AS text")
    got = packing.pack(d, 512, group_size=1000)
    sizes = [r["count"] for r in got.groupBy("group_id").count().collect()]
    assert sum(sizes) == 30_000 and len(sizes) == 30 and max(sizes) < 1500
    assert got.where("doc_id IS NULL").count() == 10_000


def test_groups_hold_all(spark, docs):
    got = packing.pack(docs, 512, group_size=20).collect()
    assert len({r.group_id for r in got}) > 5
    fill = collections.Counter()
    for r in got:
        fill[r.group_id, r.bin_id] += r.n_tokens
    assert max(fill.values()) <= 512 and sum(fill.values()) == sum(len(r.text.split()) for r in docs.collect())


# Language ID


def brute_counts(texts, order):
    seen = collections.defaultdict(collections.Counter)
    for t in texts:
        b = language_id.lead(order) + t.encode()
        for i in range(order, len(b)):
            for j in range(order + 1):
                seen[j, b[i - j : i]][b[i]] += 1
    return {k: (c, sum(c.values()), len(c)) for k, c in seen.items()}


def brute_cost(seen, text, order):
    b, total = language_id.lead(order) + text.encode(), 0
    for i in range(order, len(b)):
        for j in range(order, -1, -1):
            if found := seen.get((j, b[i - j : i])):
                c, n, d = found
                if b[i] in c:
                    total += round(-math.log2(c[b[i]] / (n + d)) * 1024)
                    break
                total += round(-math.log2(d / (n + d)) * 1024)
        else:
            total += 8 * 1024
    return total


def brute_letters(seen, text):
    """What the text costs in the empty context."""
    c, n, d = seen[0, b""]
    out = [round(-math.log2(c[b] / (n + d)) * 1024) if b in c else round(-math.log2(d / (n + d)) * 1024) + 8 * 1024 for b in text.encode()]
    return sum(out)


def brute_accepts(seen, text, order):
    """seen: by language."""
    return min(brute_cost(c, text, order) for c in seen.values()) < min(brute_letters(c, text) for c in seen.values())


def test_code_lengths_by_brute_force():
    train = {"en": ["the cat sat on the mat", "a hat"], "de": ["die katze saß auf der matte"]}
    m = language_id.Model(train, 3)
    for t in ("the hat", "der hut ist ß", "\x00zz", "mat" * 50):
        bits, size, letters = m.score([t])
        seen = [brute_counts(train[k], 3) for k in ("de", "en")]
        assert bits[0].tolist() == [brute_cost(c, t, 3) for c in seen] and size[0] == len(t.encode())
        assert letters[0] == min(brute_letters(c, t) for c in seen)
    assert np.array_equal(m.score(["the cat sat " * 20], chunk=7)[0], m.score(["the cat sat " * 20])[0])


def test_held_out_languages(spark, sf):
    d = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet").where("lang IS NOT NULL")
    model = language_id.train(d.where("doc_id % 2 = 0"), docs_per_lang=60)
    rest = d.where("doc_id % 2 = 1 AND n_chars > 200")
    got = {r.doc_id: r for r in language_id.identify(rest, model).collect()}
    right = [got[r.doc_id].language == r.lang for r in rest.collect()]
    assert np.mean(right) > 0.95
    assert np.mean([r.accepted for r in got.values()]) > 0.99


@pytest.mark.parametrize("unknown", ["de", "en", "es", "fr"])
def test_unknown_languages_are_rejected(spark, sf, unknown):
    """At a rate of 95 % at least; some documents that carry the language are written in another."""
    d = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    model = language_id.train(d.where(F.col("lang") != unknown))
    got = language_id.identify(d.where(F.col("lang") == unknown), model).collect()
    assert len(got) > 50 and np.mean([r.accepted for r in got]) < 0.05


def test_junk_is_rejected_and_documents_stay(spark, sf):
    d, r = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet"), random.Random(2)
    model = language_id.train(d.where("doc_id % 2 = 0"), docs_per_lang=60)
    texts = [x.text for x in d.where("doc_id % 2 = 1").collect()]
    junk = [
        *("".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(200)) for _ in range(50)), *("".join(chr(r.randrange(0x3B1, 0x3C9)) for _ in range(100)) for _ in range(50)),
        *("".join(chr(r.randrange(32, 127)) for _ in range(300)) for _ in range(50)), *(f"for(int i=0;i<n;i++){{a[i]=b[i]*{k};}}" for k in range(50)), *("".join(r.sample(t[:2000], len(t[:2000]))) for t in texts[:50] if len(t) > 300),
    ]
    assert sum(model.decide(junk)["accepted"]) == 0
    assert np.mean(model.decide(texts)["accepted"]) > 0.99
    assert sum(model.decide(texts, wanted=frozenset({"de"}))["accepted"]) < 0.3 * len(texts)


def test_the_language_found_is_carried(spark):
    model = language_id.Model({"en": ["the same text once more and then another"], "de": ["noch ein Text und dann der andere"]})
    d = spark.createDataFrame([(1, "then the same text", "fr"), (2, "und dann noch ein", None), (3, "漢字漢字", "en")], "doc_id bigint, text string, lang string")
    assert sorted(map(tuple, language_id.keep_identified(d, model).collect())) == [(1, "then the same text", "en"), (2, "und dann noch ein", "de")]
    assert [r.doc_id for r in language_id.keep_identified(d, model, wanted={"de"}).collect()] == [2]


def test_the_sample_is_bounded(spark):
    rows = [(1, "one and the same", "en")] * 500 + [(1, f"another of the same id {i}", "en") for i in range(50)] + [(9, "x", lang) for lang in "abcdef"]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train(d, docs_per_lang=5, max_langs=3)
    assert model.langs == ["a", "b", "en"]


# Chat


def visit(turns):
    """The same prompt and counts, part by part."""
    prompt, records, text_tokens, held = "", [], 0, 0
    for turn, role, text in turns:
        try:
            parts = json.loads(text)
            assert isinstance(parts, list) and parts and all(isinstance(p, dict) and "type" in p for p in parts)
        except (ValueError, AssertionError):
            parts = [{"type": "text", "text": text}]
        prompt += f"<|{role}|>\n"
        for p in parts:
            kind = p["type"]
            if kind in ("image", "audio", "document"):
                n = {
                    "image": lambda: math.ceil(p["width"] / 28) * math.ceil(p["height"] / 28) if "width" in p and "height" in p else 256,
                    "audio": lambda: math.ceil(p["seconds"] * 25) if "seconds" in p else 250, "document": lambda: math.ceil(p["pages"]) * 512 if "pages" in p else 512,
                }[kind]()
                prompt += f"<|{kind}:{len(records)}|>"
                records.append((len(records), kind, p.get("url", ""), turn, n))
                held += n
            else:
                prompt += p.get("text", "")
                text_tokens += len(p.get("text", "").split())
        prompt += "<|end|>\n"
    return prompt, records, text_tokens, held, text_tokens + held + 4 * len(turns)


def test_typed_parts(spark):
    turns = [
        (1, "user", json.dumps([{"type": "text", "text": "look at "}, {"type": "image", "url": "i.png", "width": 100, "height": 57}, {"type": "text", "text": " and hear"}, {"type": "audio", "url": "a.wav", "seconds": 1.5}])),
        (2, "assistant", "[not json] plain"), (3, "user", json.dumps([{"type": "document", "pages": 3, "url": "d.pdf"}, {"type": "image"}, {"type": "odd", "text": "kept"}])), (4, "user", "[]"), (5, "user", '[1, 2]'), (6, "user", '{"type": "text"}'),
    ]
    d = spark.createDataFrame([(7, *t) for t in reversed(turns)], "conv_id bigint, turn bigint, role string, text string")
    r = chat_format.format_chat(d).first()
    assert (r.prompt, [tuple(a) for a in r.attachments], r.n_text_tokens, r.n_attachment_tokens, r.n_tokens) == visit(turns)


@pytest.mark.parametrize("name", ["op10_chat_format", "chat_typed_parts"])
def test_chat_like_sql(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    duckdb.execute(f"CREATE OR REPLACE VIEW conversations AS FROM read_parquet('{sf}/conversations.parquet')")
    want = duckdb.sql(registry.ORACLES[name]).select(*cols).fetchall()
    got = sorted(map(tuple, df.select(*cols).collect()))
    assert got == sorted(want) and (name == "op10_chat_format" or any('"tokens":38' in r.attachments for r in df.select("attachments").collect()))


# All together


def test_pipeline_runs_stage_by_stage(spark, sf, tmp_path):
    d, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, d, sf).write.parquet(str(tmp_path / str(i)))
        d = spark.read.parquet(str(tmp_path / str(i)))
        seen.append(d.count())
    assert seen[0] >= seen[1] > 0
    assert sorted(map(tuple, d.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))


def test_pipeline_by_brute_force(spark, docs, draw, sf):
    """All four stages in plain Python, each on what the one before left."""
    rows, order = [(r.doc_id, r.text, r.source, r.lang) for r in docs.collect()], language_id.ORDER
    seen = {k: brute_counts([t for _, t, _, lang in rows if lang == k], order) for k in {r[3] for r in rows}}
    rows = [r for r in rows if r[1] and brute_accepts(seen, r[1], order)]
    gone = {i for i, _ in brute_duplicates([r[:2] for r in rows])}
    rows = [r for r in rows if r[0] not in gone]
    chosen = brute_mix([r[:3] for r in rows], draw)
    cap = packing.CAPACITY
    pieces = [(i, k, min(cap, n - cap * k)) for i, (_, n, copies) in sorted(chosen.items()) for _ in range(copies) for k in range(-(-n // cap))]
    want = sorted((*p, *b) for p, b in zip(pieces, first_fit([n for _, _, n in pieces], cap)))
    assert sorted((r.doc_id, r.piece, r.n_tokens, r.bin_id, r.bin_offset) for r in corpus_pipeline.run(spark, sf).collect()) == want


def test_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES if k.startswith("op")) == list(range(1, 11))
    assert set(registry.ORACLES) <= set(registry.QUERIES)
