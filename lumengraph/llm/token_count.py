"""Token counts of a unigram tokenizer, by dynamic programming over a trie of pre-tokens.

A pre-token is a whitespace-separated word with the word mark in front. The distinct pre-tokens that a worker meets are inserted in a trie, which lives on from
batch to batch; the best forward score of a prefix (a trie node) is the maximum, over the vocabulary pieces that end there, of the score of the
shorter prefix plus the piece's. It is computed once, when the node is made, for all words that ever share the prefix, and the node where a word
ends stores its number of tokens. Equal scores: fewer tokens.

The vocabulary is a public one, whose pieces come with merge ranks: piece of rank r has score -ln(r + 1) - ln(H), H being
the sum of 1/(r + 1) over all pieces (Zipf's law), in whole millionths, so that sums are exact. A character that is no piece costs as many tokens as
it has bytes in UTF-8, at UNKNOWN each.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SCALE = 1_000_000
UNKNOWN = -20 * SCALE
MARK = "▁"
#: Words and nodes that a worker keeps before it starts anew; results don't depend on them.
MAX_WORDS, MAX_NODES = 300_000, 600_000


def load_pieces(path: str = VOCABULARY) -> dict[str, int]:
    """Score by piece, of the pieces that are text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(own))))
    return {p: round((-math.log(r + 1) - total) * SCALE) for r, p in enumerate(own)}


class Pieces:
    """The vocabulary as an automaton: which pieces end at a character, given the state before it (Aho and Corasick)."""

    def __init__(self, scores: dict[str, int]):
        self.scores = scores
        self.states = {"": 0}
        for p in scores:
            for n in range(1, len(p) + 1):
                self.states.setdefault(p[:n], len(self.states))
        self.names = list(self.states)
        self.next: list[dict[str, int]] = [{} for _ in self.names]
        self.ends: list[list[tuple[int, int]] | None] = [None] * len(self.names)

    def step(self, state: int, c: str) -> int:
        """The state after one more character: the longest end of what was read that begins a piece. Found once, then kept."""
        name, states = self.names[state] + c, self.states
        while (out := states.get(name)) is None:
            name = name[1:]
        self.next[state][c] = out
        return out

    def ending(self, state: int) -> list[tuple[int, int]]:
        """(length, score) of the pieces that end in a state."""
        name = self.names[state]
        self.ends[state] = out = [(n, s) for n in range(1, len(name) + 1) if (s := self.scores.get(name[-n:])) is not None]
        return out


class Trie:
    """Nodes in flat lists: by node the best score and the token count of its prefix, its state among the pieces, and the tokens of the word that ends there (-1 where none does).

    children has the node by parent and character (one number for both). A word's walk makes and scores only the nodes that no word before it made.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.score, self.tokens, self.state, self.terminal = [0], [0], [0], [-1]

    def insert(self, word: str) -> int:
        """The number of tokens of the word, which its last node then holds."""
        nxt, ends, scores, children = self.pieces.next, self.pieces.ends, self.pieces.scores, self.children
        score, tokens, state = self.score, self.tokens, self.state
        node, path, text = 0, [0], MARK + word
        for at, c in enumerate(text, 1):
            key = node << 21 | ord(c)
            child = children.get(key)
            if child is None:
                here = state[node]
                now = nxt[here].get(c)
                here = self.pieces.step(here, c) if now is None else now
                found = ends[here]
                if found is None:
                    found = self.pieces.ending(here)
                best = None
                for n, s in found:
                    before = path[at - n]
                    s += score[before]
                    if best is None or s > best or (s == best and tokens[before] < fewest):
                        best, fewest = s, tokens[before]
                fewest = 1 + (fewest if best is not None else 0)
                if c not in scores:
                    size = len(c.encode("utf-8", "replace"))
                    s, t = score[node] + UNKNOWN * size, tokens[node] + size
                    if best is None or s > best or (s == best and t < fewest):
                        best, fewest = s, t
                children[key] = child = len(score)
                score.append(best), tokens.append(fewest), state.append(here), self.terminal.append(-1)
            path.append(child)
            node = child
        self.terminal[node] = tokens[node]
        return tokens[node]


class Counter:
    """Counts of texts. known has the terminal counts by word: a word is walked through the trie once."""

    def __init__(self, pieces: dict[str, int]):
        self.trie, self.known = Trie(Pieces(pieces)), {}

    def count(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """Tokens and pre-tokens by text."""
        known, insert, out = self.known, self.trie.insert, []
        for t in texts:
            if len(known) > MAX_WORDS:
                known.clear()
            if len(self.trie.score) > MAX_NODES:
                self.trie.clear()
            found = t.split() if t else []
            got = [*map(known.get, found)]
            if None in got:
                for i, n in enumerate(got):
                    if n is None:
                        w = found[i]
                        n = known.get(w)
                        got[i] = known.setdefault(w, insert(w)) if n is None else n
            out.append((sum(got), len(found)))
        return out


def count_tokens(docs: DataFrame, pieces: dict[str, int]) -> DataFrame:
    """A row for each row of docs: doc_id, n_tokens, n_pretokens. No shuffle.

    Null, empty and blank texts have 0 of both. Repeated rows are counted one by one, null ids are carried, extra columns
    aren't read, an empty table gives an empty result. Texts of any length are counted whole, and a word of any length is one walk. Ties as in the module.
    """
    key = hash((len(pieces), sum(pieces.values())))

    def run(x, _):
        store = common.worker_store()
        if store.get("token_count", (None,))[0] != key:
            store["token_count"] = key, Counter(pieces)
        done = store["token_count"][1].count(x["text"])
        return {"doc_id": x["doc_id"], "n_tokens": [a for a, _ in done], "n_pretokens": [b for _, b in done]}

    return common.map_batches(common.pick(docs, doc_id="bigint", text="string"), run, "doc_id bigint, n_tokens bigint, n_pretokens bigint", {"doc_id": pa.int64(), "n_tokens": pa.int64(), "n_pretokens": pa.int64()})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"), load_pieces())
