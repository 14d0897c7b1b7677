"""Main-text extraction from HTML by a recurrent block labeller.

A page becomes a sequence of leaf blocks: runs of text under one block element, each with its tag path. A block is read as a
vector: its path's tags and its words, both hashed, and a few sizes. A bidirectional LSTM in numpy reads the whole
sequence and labels every block as main text or not, so a label depends on the whole document.

The labeller is fitted by the query that uses it, on ``train_pages`` pages (the bound is a parameter; those with the least hash
of their id). The labels come from pages that mark their main text with article or main; that mark and page chrome's tags are hidden from
half of the training pages, so that words, sizes and neighbours count too.
"""

from __future__ import annotations

import html as entities
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TRAIN_PAGES, EPOCHS, HIDDEN, SEED = 240, 12, 12, 3
PATH_DIM, WORD_DIM, SIZES = 24, 16, 5
WIDTH = PATH_DIM + WORD_DIM + SIZES
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)(?![\w-])[^>]*>.*?(?:</\1\s*>|\Z)|<(head|svg|noscript|template)(?![\w-])([^>]*)>|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_TITLE_END = re.compile(r"</title\s*>", re.I)
_IN_HEAD = frozenset("base basefont bgsound link meta html head".split())
#: Tags that no drawing has outside a foreignObject, desc or title: they end an svg that was left open.
_NOT_IN_SVG = frozenset("article aside b big blockquote body br center code dd div dl dt em embed footer form h1 h2 h3 h4 h5 h6 head header hr i img li listing main menu meta nav nobr ol p pre ruby s section small span strike strong sub sup table tt u ul var".split())
_HOLDS_HTML = frozenset(("foreignobject", "desc", "title"))
_INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i img input ins del kbd label mark q s samp small span strong sub sup time tt u var wbr br".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_MAIN, _CHROME = frozenset(("article", "main")), frozenset(("nav", "footer", "aside", "header"))
_SPACE = re.compile(r"\s+")


def skipped(page: str, m: re.Match, ends: dict[int, int]) -> int:
    """Where the text goes on after the opening tag m of a head, svg, noscript or template. ends: what earlier calls found out by position.

    A head goes on to its closing tag or what can't be in a head, an svg to its closing tag or what can't be in a drawing; of anything
    else that is left open, and of an empty svg, only the tag is skipped.
    """
    if m.start() in ends:
        return ends[m.start()]
    name = m[2].lower()
    if name == "head":
        return head_end(page, m.end(), ends)
    if name == "svg" and m[3].endswith("/"):
        return m.end()
    opened, holding, at = [m], 0, m.end()
    while t := _TOKEN.search(page, at):
        at = t.end()
        tag = (t[2] or t[5] or "").lower()
        if tag == name and t[4]:
            ends[opened.pop().start()] = at
            if not opened:
                return at
        elif tag == name and not (name == "svg" and t[3].endswith("/")):
            opened.append(t)
        elif name == "svg" and tag in _HOLDS_HTML and not t[0].endswith("/>"):
            holding = max(0, holding + (-1 if t[4] else 1))
        elif name == "svg" and tag in _NOT_IN_SVG and not t[4] and not holding:
            return t.start()
    for t in opened:
        ends[t.start()] = t.end()
    return m.end()


def head_end(page: str, at: int, ends: dict[int, int]) -> int:
    """The end of a head whose content begins at a position. Stray text is part of a head only if the closing tag comes before anything else of a body."""
    first = None
    while True:
        t = _TOKEN.search(page, at)
        between = page[at : t.start() if t else len(page)]
        if first is None and between.strip("\ufeff \t\r\n\f"):
            first = at
        if not t:
            return len(page) if first is None else first
        at = t.end()
        tag = (t[2] or t[5] or "").lower()
        if tag in ("noscript", "template") and t[2]:
            at = skipped(page, t, ends)
        elif tag == "title" and not t[4] and (closed := _TITLE_END.search(page, at)):
            at = closed.end()
        elif tag == "head" and t[4]:
            return at
        elif t[4] and tag not in ("body", "html", "br") or tag in _IN_HEAD and not t[4] and not (tag == "head" and first is not None) or not tag:
            continue
        else:
            return t.start() if first is None else first


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    """(tag path, text, characters inside links) by block, in document order; unclosed and stray tags are tolerated."""
    out, path, text, linked, in_link, at = [], [], [], 0, 0, 0
    page, ends = page or "", {}

    def flush():
        nonlocal linked
        joined = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
        if joined:
            out.append((tuple(path), joined, min(linked, len(joined))))
        text.clear()
        linked = 0

    def take(s: str):
        nonlocal linked
        if s:
            text.append(s)
            if in_link:
                linked += len(s.strip())

    while m := _TOKEN.search(page, at):
        take(page[at : m.start()])
        at = skipped(page, m, ends) if m[2] else m.end()
        tag = (m[5] or "").lower()
        if not tag:
            continue
        if tag in _INLINE:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                in_link = max(0, in_link + (-1 if m[4] else 1))
            continue
        flush()
        if m[4]:
            if tag in path:
                while path.pop() != tag:
                    pass
        elif tag not in _VOID:
            if tag in ("p", "li") and path and path[-1] == tag:  # these close each other
                path.pop()
            kind = re.search(r"""\b(?:class|id)\s*=\s*["']?([\w-]+)""", m[6] or "")
            path.append(tag)
            if kind:  # the class is one more step of the path
                path.append(f".{kind[1].lower()}")
    take(page[at:])
    flush()
    return out


def vectors(found: list[tuple[tuple[str, ...], str, int]], hide: bool = False) -> np.ndarray:
    """A row a block. hide: without the tags that mark main text or chrome."""
    out = np.zeros((len(found), WIDTH), np.float32)
    for i, (path, text, linked) in enumerate(found):
        row = out[i]
        for depth, tag in enumerate(path):
            if not (hide and (tag in _MAIN or tag in _CHROME or tag[0] == ".")):
                h = crc32(tag.encode())
                row[h % PATH_DIM] += 1 if h & 0x10000 else -1
        ws = text.lower().split()
        for w in ws:
            h = crc32(w.encode("utf-8", "replace"))
            row[PATH_DIM + h % WORD_DIM] += 1 if h & 0x10000 else -1
        row[PATH_DIM : PATH_DIM + WORD_DIM] /= np.sqrt(len(ws))
        row[-5:] = np.log1p(len(ws)) / 4, np.log1p(len(text)) / 6, linked / max(1, len(text)), sum(c in ".,;:!?" for c in text[-1:]), len(path) / 8
    return out


class Labeller:
    """Two LSTMs over a padded batch of sequences, one from each end, and a logistic layer on both."""

    def __init__(self, hidden: int = HIDDEN, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.hidden, self.fitted = hidden, False
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = r.normal(0, 0.3 / np.sqrt(WIDTH) * 3, (WIDTH, 4 * hidden))
            self.w[f"h{d}"] = r.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            self.w[f"c{d}"] = np.zeros(4 * hidden)
            self.w[f"c{d}"][hidden : 2 * hidden] = 1.0  # remember at first
        self.w["o"], self.w["k"] = r.normal(0, 0.3, 2 * hidden), np.zeros(1)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool = True) -> tuple[np.ndarray, list]:
        """States by step, and what the way back needs if it is kept; in the precision of x."""
        n, steps, _ = x.shape
        hid = self.hidden
        h, c = np.zeros((n, hid), x.dtype), np.zeros((n, hid), x.dtype)
        out, kept = np.zeros((n, steps, hid), x.dtype), []
        pre = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = pre[:, t] + h @ self.w[f"h{d}"]
            i, f, o = (1 / (1 + np.exp(-z[:, a * hid : (a + 1) * hid])) for a in (0, 1, 2))
            g = np.tanh(z[:, 3 * hid :])
            new = f * c + i * g
            squashed = np.tanh(new)
            m = mask[:, t, None]  # padding leaves the state as it is
            if keep:
                kept.append((t, h, c, i, f, o, g, squashed, m))
            h, c = np.where(m, o * squashed, h), np.where(m, new, c)
            out[:, t] = h
        return out, kept

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, "f", False)[0], self._run(x, mask, "b", False)[0]], axis=2)
        return 1 / (1 + np.exp(-(both @ self.w["o"] + self.w["k"][0])))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the blocks, and its derivatives (back-propagation through time)."""
        hid, ran = self.hidden, {d: self._run(x, mask, d) for d in "fb"}
        both = np.concatenate([ran["f"][0], ran["b"][0]], axis=2)
        p = 1 / (1 + np.exp(-(both @ self.w["o"] + self.w["k"][0])))
        n = mask.sum()
        loss = -(np.where(mask, y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12), 0)).sum() / n
        dz = np.where(mask, p - y, 0) / n
        g = {"o": np.einsum("bt,bth->h", dz, both), "k": np.array([dz.sum()])}
        for a, d in enumerate("fb"):
            top = dz[:, :, None] * self.w["o"][a * hid : (a + 1) * hid]
            dx, dh_w = np.zeros((*mask.shape, 4 * hid)), np.zeros_like(self.w[f"h{d}"])
            dh, dc = np.zeros((len(x), hid)), np.zeros((len(x), hid))
            for t, h, c, i, f, o, gg, squashed, m in reversed(ran[d][1]):
                dh = dh + top[:, t]
                own = np.where(m, dh, 0)
                dnew = np.where(m, dc, 0) + own * o * (1 - squashed**2)
                gate = np.concatenate([dnew * gg * i * (1 - i), dnew * c * f * (1 - f), own * squashed * o * (1 - o), dnew * i * (1 - gg**2)], axis=1)
                dx[:, t] = gate
                dh_w += h.T @ gate
                dh = np.where(m, 0, dh) + gate @ self.w[f"h{d}"].T
                dc = np.where(m, 0, dc) + dnew * f
            g[f"x{d}"] = np.einsum("bti,btj->ij", x, dx)
            g[f"c{d}"], g[f"h{d}"] = dx.sum(axis=(0, 1)), dh_w
        return loss, g

    def fit(self, sequences: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, batch: int = 16, rate: float = 0.02, seed: int = SEED) -> None:
        """Adam; the order of the batches is seeded."""
        r, self.fitted = np.random.default_rng(seed), True
        first, second, step = {k: np.zeros_like(v) for k, v in self.w.items()}, {k: np.zeros_like(v) for k, v in self.w.items()}, 0
        for _ in range(epochs):
            order = r.permutation(len(sequences))
            for a in range(0, len(order), batch):
                some = order[a : a + batch]
                x, mask = padded([sequences[i] for i in some])
                y = np.zeros(mask.shape)
                for j, i in enumerate(some):
                    y[j, : len(labels[i])] = labels[i]
                _, g = self.gradients(x, mask, y)
                step += 1
                for k in self.w:
                    first[k] = 0.9 * first[k] + 0.1 * g[k]
                    second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                    self.w[k] = self.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def label(self, sequences: list[np.ndarray], most: int = 4096) -> list[np.ndarray]:
        """Whether each block is main text; no block is, before the labeller was fitted. Sequences of like length share a batch of at most so many blocks; none is cut."""
        out: list[np.ndarray] = [np.zeros(len(s), bool) for s in sequences]
        if not self.fitted:
            return out
        order, a = sorted((i for i in range(len(sequences)) if len(sequences[i])), key=lambda i: len(sequences[i])), 0
        while a < len(order):
            b = a + 1
            while b < len(order) and (b - a + 1) * len(sequences[order[b]]) <= most:
                b += 1
            x, mask = padded([sequences[i] for i in order[a:b]], np.float32)
            p = self.probabilities(x, mask)
            for j, i in enumerate(order[a:b]):
                out[i] = p[j, : len(sequences[i])] >= 0.5
            a = b
        return out


def padded(sequences: list[np.ndarray], kind: type = np.float64) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, sequences))
    x, mask = np.zeros((len(sequences), steps, WIDTH), kind), np.zeros((len(sequences), steps), bool)
    for i, s in enumerate(sequences):
        x[i, : len(s)], mask[i, : len(s)] = s, True
    return x, mask


def marked(found: list[tuple[tuple[str, ...], str, int]]) -> np.ndarray | None:
    """Labels from the page's own marks: inside article or main. None if it marks nothing."""
    y = np.array([bool(_MAIN.intersection(p)) for p, _, _ in found], float)
    return y if len(y) and 0 < y.sum() else None


def train(pages: DataFrame, train_pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """Fitted on the sample that the module describes; ties of the hash go by id, and of several pages of an id the least is read. Without a marked page nothing is fitted."""
    p = common.pick(pages, page_id="bigint", html="string").where("page_id IS NOT NULL AND html IS NOT NULL")
    ids = [r.page_id for r in p.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(train_pages).collect()]
    rows = sorted((r.page_id, r.html) for r in p.where(F.col("page_id").isin(ids)).groupBy("page_id").agg(F.min("html").alias("html")).collect()) if ids else []
    xs, ys = [], []
    for n, (_, text) in enumerate(rows):
        found = blocks(text)
        y = marked(found)
        if y is not None:
            xs.append(vectors(found, hide=n % 2 == 1))
            ys.append(y)
    out = Labeller(seed=seed)
    if xs:
        out.fit(xs, ys, epochs)
    out.w = {k: v.astype(np.float32) for k, v in out.w.items()}
    return out


def extract(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """A row for each row of pages: page_id, text (the main blocks, a line each), n_blocks, labels (a boolean a block).

    Null and empty pages and those without text: empty text, no blocks. Repeated rows are taken one by one and equal pages get equal labels, null ids are
    carried, extra columns aren't read, an empty table gives an empty result. Any broken markup is read as far as it goes. Pages of any
    length are read whole, every block with the whole page as context. A probability of just one half is main text. Without a fitted labeller no block is main text.
    """

    def run(x, _):
        text, n, labels = [], [], []
        for a in range(0, len(x["html"]), 200):
            found = [blocks(h) for h in x["html"][a : a + 200]]
            for f, y in zip(found, labeller.label([vectors(f) for f in found])):
                text.append("\n".join(t for (_, t, _), k in zip(f, y) if k))
                n.append(len(f))
                labels.append(y.tolist())
        return {"page_id": x["page_id"], "text": text, "n_blocks": n, "labels": labels}

    return common.map_batches(common.pick(pages, page_id="bigint", html="string"), run, "page_id bigint, text string, n_blocks bigint, labels array<boolean>", {"page_id": pa.int64(), "text": pa.string(), "n_blocks": pa.int64(), "labels": pa.list_(pa.bool_())})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
