"""Nulls in any column, empty and very long texts, repeated rows, empty tables, clashing extra columns: for every operator and stage."""

import numpy as np
import pytest

import corpus_pipeline
from lumengraph.llm import ann, bit_packing, chat_format, html_extract, language_id, mixing, near_dedup, order_minhash, packing, token_count

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, n_tokens string, content string, bands int, copies string, shingles string, `__0` string, `TEXT` string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(200_000))
ROWS = [
    (1, "the same text once more", "en", "a", 23), (1, "the same text once more", "en", "a", 23), (2, "the same text once more", "en", "b", 23), (3, None, "en", "a", None), (4, "", None, None, 0),
    (5, "  \n\t ", "de", "a", 5), (None, "a text without an id", None, "b", 20), (6, LONG, "en", "a", len(LONG)), (7, "x", None, None, 1), (8, "naïve 漢字 \U0001f600 text", "fr", "b", 15), (9, "another text", None, "a", 12), (9, "yet another text", "de", None, 16),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "s", "n", "c", 1, "k", "h", "u", "T") for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def model(spark):
    return language_id.Model({"en": ["the same text once more and then another"], "de": ["noch ein Text und dann der andere"]})


@pytest.fixture(scope="module")
def pieces():
    return token_count.load_pieces()


def by_doc(spark, docs, model, pieces):
    return {
        "token_count": lambda d: token_count.count_tokens(d, pieces), "fingerprints": order_minhash.fingerprints, "bit_packing": lambda d: bit_packing.pack_tokens(d, bit_packing.load_model()),
        "language": lambda d: language_id.identify(d, model), "near_dedup": near_dedup.duplicates, "mixing": mixing.mix, "packing": packing.pack,
    }


def test_rows_one_by_one(spark, docs, model, pieces):
    ops = by_doc(spark, docs, model, pieces)
    t = ops["token_count"](docs).collect()
    assert len(t) == len(ROWS) and sum(r.doc_id is None for r in t) == 1
    assert {r.doc_id: (r.n_tokens, r.n_pretokens) for r in t if r.doc_id in (3, 4, 5)} == {3: (0, 0), 4: (0, 0), 5: (0, 0)}
    assert next(r for r in t if r.doc_id == 6).n_pretokens == 200_000
    f = ops["fingerprints"](docs).collect()
    assert len(f) == len(ROWS) and {r.fingerprint is None for r in f if r.doc_id in (3, 4)} == {True}
    assert len({tuple(r.fingerprint) for r in f if r.doc_id in (1, 2)}) == 1
    assert next(r for r in f if r.doc_id == 7).n_kmers == 1
    b = ops["bit_packing"](docs).collect()
    assert len(b) == len(ROWS) and {(r.n_tokens, bytes(r.packed), tuple(r.block_offsets)) for r in b if r.doc_id in (3, 4)} == {(0, b"", ())}
    g = ops["language"](docs).collect()
    assert len(g) == len(ROWS) and {(r.language, r.bits, r.accepted) for r in g if r.doc_id in (3, 4)} == {("und", None, False)}


def test_dedup_edges(docs):
    got = {(r.doc_id, r.kept_id) for r in near_dedup.duplicates(docs).collect()}
    assert got == {(2, 1)}
    kept = near_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r[0] is None, r[0] or 0) for r in kept.collect())
    assert [i for none, i in ids if not none] == [1, 3, 4, 5, 6, 7, 8, 9, 9] and sum(none for none, _ in ids) == 1


def test_mixing_edges(docs):
    rows = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert not {3, 4, 5} & set(rows) and rows.get(1, rows.get(6)) is not None
    assert all(r.copies >= 1 and r.n_tokens > 0 for r in rows.values())
    picked = mixing.select(docs)
    assert picked.columns == docs.columns
    n = {}
    for r in picked.collect():
        n[r[1]] = n.get(r[1], 0) + 1
    want = {r.n_tokens: r.copies for r in rows.values()}
    assert {len(t.split()): k for t, k in n.items()} == want


def test_packing_edges(docs):
    got = packing.pack(docs, capacity=64).collect()
    assert not {3, 4, 5} & {r.doc_id for r in got}
    assert sum(r.n_tokens for r in got) == sum(len(t.split()) for _, t, *_ in ROWS if t)
    assert sum(r.doc_id == 1 for r in got) == 2 and sum(r.doc_id is None for r in got) == 1
    assert packing.pack(docs, n_tokens="n_chars").where("doc_id = 3").count() == 0


def test_filters_keep_the_columns(docs, model):
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id IN (3, 4)").count() == 0
    assert kept.where("doc_id = 1").count() == 2


def test_untrained_language_model(spark, docs):
    none = language_id.train(docs.where("lang IS NULL"))
    assert {r.accepted for r in language_id.identify(docs, none).collect()} == {False}
    assert language_id.train(docs).langs == ["de", "en", "fr"]


@pytest.mark.parametrize(("name", "rows"), [("token_count", True), ("fingerprints", True), ("bit_packing", True), ("language", True), ("near_dedup", False), ("mixing", False), ("packing", False)])
def test_empty_and_null_tables(spark, docs, model, pieces, name, rows):
    """Operators that answer row by row answer for each row of nulls; the others have nothing to say."""
    op = by_doc(spark, docs, model, pieces)[name]
    assert op(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None,) * len(docs.columns)] * 3, DOCS)
    assert op(nulls).count() == (3 if rows else 0)
    assert op(spark.createDataFrame([(1,)], "doc_id bigint")).count() == (1 if rows else 0)  # no text column at all


def test_which_of_repeated_rows_stays(spark):
    """The one whose columns as JSON are least, in whatever order they come."""
    rows = [(1, "one text of some words", "b", 2), (1, "one text of some words", "a", 9), (1, "one text of some words", None, 1), (2, "something else is written here", "z", 1), (2, "something else is written here", "z", 1)]
    for order in (rows, rows[::-1]):
        d = spark.createDataFrame(order, "doc_id bigint, text string, source string, extra int").repartition(3)
        want = {(1, "one text of some words", "a", 9), (2, "something else is written here", "z", 1)}
        assert {tuple(r) for r in near_dedup.keep_one_of_each(d).collect()} == want and near_dedup.keep_one_of_each(d).count() == 2
        assert {tuple(r) for r in mixing.select(d, weights={"a": 1, "z": 1}).collect()} == want


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages(spark, docs, tmp_path, stage):
    docs = docs.toDF(*docs.columns[:-1], "other")  # a file can't hold two names that differ by case only
    out = stage[1](spark, docs, str(tmp_path))
    assert stage[0] == "packing" or out.columns == docs.columns
    out.write.parquet(str(tmp_path / "out"))
    assert stage[1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_ann_edges(spark):
    rows = [(1, [1.0, 0.0], 7), (1, [0.5, 0.0], 7), (2, [1.0, 1.0], 7), (3, None, 7), (4, [], 7), (5, [float("nan"), 1.0], 7), (6, [None, 1.0], 7), (None, [1.0, 2.0], 7), (8, [1.0, 0.0, 0.0], 7), (9, [1.0, 1.0], 7), (10, [1.0, 1.0], None)]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, dim int").selectExpr("*", "1 AS shard", "1 AS part", "2 AS cell", "'x' AS ids", "2 AS rank", "0 AS Embedding2")
    got = {}
    for r in ann.nearest(v).collect():
        got.setdefault(r.vec_id, []).append((r.rank, r.neighbour_id, round(r.distance, 4)))
    assert sorted(got) == [1, 2, 9, 10]
    assert sorted(got[2]) == [(1, 9, 0.0), (2, 10, 0.0), (3, 1, round(1.25**0.5, 4))]
    for none in (v.limit(0), v.where("vec_id = 8"), spark.createDataFrame([(None,) * 3] * 3, "vec_id bigint, embedding array<float>, label int"), spark.createDataFrame([(1,)], "vec_id bigint")):
        assert ann.nearest(none).count() == 0


def test_ann_keeps_dimensions_apart(spark):
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0, 0.0]), (3, [0.0, 9.0, 0.0]), (4, [0.5] * 5000), (5, [0.25] * 5000)]
    got = {(r.vec_id, r.dim, r.rank): (r.neighbour_id, round(r.distance, 4)) for r in ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()}
    assert got == {
        (1, 2, 1): (2, 1.0), (2, 2, 1): (1, 1.0), (1, 3, 1): (3, 2.0), (3, 3, 1): (1, 2.0), (4, 5000, 1): (5, round(0.25 * 5000**0.5, 4)), (5, 5000, 1): (4, round(0.25 * 5000**0.5, 4))
    }


def test_chat_edges(spark):
    turns = spark.createDataFrame([(1, 2, "user", "second"), (1, 1, None, None), (1, 2, "user", "second"), (None, 1, "user", "lost"), (None, 1, "user", "lost"), (2, None, "a", ""), (3, 1, "user", "x " * 100_000)], "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS prompt", "'q' AS parts", "'z' AS turns", "0 AS flat")
    rows = chat_format.format_chat(turns).collect()
    got = {r.conv_id: r for r in rows}
    assert got[1].prompt == "<|unknown|>\n<|end|>\n<|user|>\nsecond<|end|>\n<|user|>\nsecond<|end|>\n" and got[1].n_turns == 3
    assert [(r.n_turns, r.n_tokens) for r in rows if r.conv_id is None] == [(1, 5), (1, 5)]
    assert got[2].n_tokens == 4 and got[3].n_text_tokens == 100_000
    assert chat_format.format_chat(turns.limit(0)).count() == 0
    nulls = chat_format.format_chat(spark.createDataFrame([(None,) * 4] * 3, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert [(r.n_turns, r.prompt, r.n_tokens) for r in nulls] == [(1, "<|unknown|>\n<|end|>\n", 4)] * 3


def test_chat_slots_are_no_text(spark):
    """Texts that look like what stands for an attachment come out as they are; many attachments are numbered in order."""
    odd = "a\x01sb\x01ec\x01"
    images = "[" + ",".join('{"type":"image","url":"%d"}' % i for i in range(2000)) + "]"
    turns = [(1, 1, "r\x01s", odd), (1, 2, "user", images), (1, 3, "user", '[{"type":"text","text":"\\u0001s"},{"type":"audio"}]')]
    r = chat_format.format_chat(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")).first()
    assert r.prompt == f"<|r\x01s|>\n{odd}<|end|>\n<|user|>\n" + "".join(f"<|image:{i}|>" for i in range(2000)) + "<|end|>\n<|user|>\n\x01s<|audio:2000|><|end|>\n"
    assert [(a.number, a.ref) for a in r.attachments[:2000]] == [(i, str(i)) for i in range(2000)]


def test_html_edges(spark):
    labeller = html_extract.Labeller()
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<p>unclosed <b>text"), (None, "<div>no id</div>"), (3, "<p>unclosed <b>text"), (4, "<p>word</p>" * 5000), (5, "no tags < at all > & more")], "page_id bigint, html string").selectExpr("*", "'t' AS text", "1 AS labels")
    got = html_extract.extract(pages, labeller).collect()
    assert len(got) == 7 and {(r.text, r.n_blocks, tuple(r.labels)) for r in got if r.page_id in (1, 2)} == {("", 0, ())}
    assert next(r for r in got if r.page_id == 4).n_blocks == 5000
    assert html_extract.extract(pages.limit(0), labeller).count() == 0
    assert html_extract.train(pages.limit(0)).w.keys() == labeller.w.keys()
    # Without a marked page nothing is learnt, and nothing is called main text.
    none = html_extract.train(pages)
    assert not none.fitted and {(r.text, any(r.labels)) for r in html_extract.extract(pages, none).collect()} == {("", False)}
    nulls = html_extract.extract(spark.createDataFrame([(None, None)] * 3, "page_id bigint, html string"), labeller).collect()
    assert [(r.page_id, r.text, r.n_blocks) for r in nulls] == [(None, "", 0)] * 3


def test_a_very_long_page():
    found = html_extract.blocks("<p>word</p>" * 30_000 + "<article><p>of the matter</p></article>")
    m = html_extract.Labeller()
    m.fit([html_extract.vectors(found[-3:])], [np.array([0.0, 0.0, 1.0])], epochs=30)
    y = m.label([html_extract.vectors(found)])[0]
    assert len(y) == 30_001 and y[-1] and not y[:-1].any()
    again = [("marked", p) for p in ("<article>a</article>", "<p>b</p>")] * 2
    assert html_extract.marked(html_extract.blocks(again[0][1])).tolist() == [1.0] and html_extract.marked(html_extract.blocks(again[1][1])) is None


def test_one_page_of_a_repeated_id_is_learnt_from(spark):
    pages = spark.createDataFrame([(1, f"<article>text {i}</article><p>other</p>") for i in range(300)], "page_id bigint, html string")
    assert html_extract.train(pages, epochs=1).fitted


@pytest.mark.parametrize("page, want", [
    ("<html><head><title>T</title><meta charset=u><body><p>text</p>", ["text"]),
    ("<head><title>T <p> x</title><noscript><img src=a></noscript><style>p {}</style><article>text</article><pre>&lt;/head></pre></head>", ["text", "</head>"]),
    ("<head><title>T</title>text alone", ["text alone"]),
    ("<head>\ufeff<title>T</title>stray</head><p>text</p>", ["text"]),
    ("<p>one</p><svg width='1'/><article>text</article><svg><text>drawn</text></svg><p>two</p>", ["one", "text", "two"]),
    ("<p>one</p><svg width='1'><path d='M0'><article>text</article><svg><text>drawn</text></svg><p>two</p>", ["one", "text", "two"]),
    ("<svg><svg><text>drawn</text></svg><foreignObject><p>drawn</p></foreignObject></svg><p>text</p>", ["text"]),
    ("<noscript><p>text</p><noscript>hidden</noscript><p>two</p>", ["text", "two"]),
    ("<template><p>text</p><template>hidden</template><p>two</p>", ["text", "two"]),
    ("<p>text</p><script>hidden <p>hidden</p>", ["text"]),
])
def test_html_left_open(page, want):
    assert [text for _, text, _ in html_extract.blocks(page)] == want
