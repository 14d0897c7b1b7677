"""Token ids in fixed-width bit packing.

Each id takes the fewest bits that the vocabulary allows, most significant bit first. Ids are packed in blocks of
``block_ids`` (a multiple of 8, so every block begins on a byte), and the byte offset of every block is stored: a reader
unpacks any block, or any id, with numpy and without the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_IDS, PACK_IDS = 1024, 1 << 14
#: Encoded words that a worker keeps before it starts anew; results don't depend on it.
MAX_WORDS = 300000


def bit_width(vocab_size: int) -> int:
    """The bits that the largest id, vocab_size - 1, needs; at least 1."""
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    ids = np.asarray(ids, np.uint32)
    if not len(ids):
        return b""
    if int(ids.max()) >> width:
        raise ValueError(f"id {int(ids.max())} doesn't fit in {width} bits")
    shift = np.arange(width - 1, -1, -1, dtype=np.uint32)
    # As many at once as end on a byte and stay in the cache: bits are spread out only there.
    return b"".join(np.packbits(((ids[a : a + PACK_IDS, None] >> shift) & 1).astype(np.uint8).ravel()).tobytes() for a in range(0, len(ids), PACK_IDS))


def unpack(data: bytes, width: int, n: int, start: int = 0) -> np.ndarray:
    """n ids from the id numbered start on."""
    first, skip = divmod(start * width, 8)
    raw = np.frombuffer(data, np.uint8, count=(skip + n * width + 7) // 8, offset=first) if n else np.zeros(0, np.uint8)
    bits = np.unpackbits(raw)[skip : skip + n * width].reshape(n, width)
    return bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width - 1, -1, -1, dtype=np.uint32))


def block_offsets(n: int, width: int, block_ids: int = BLOCK_IDS) -> list[int]:
    return [b * block_ids * width // 8 for b in range(-(-n // block_ids))]


def unpack_block(data: bytes, width: int, n: int, offsets: list[int], block: int, block_ids: int = BLOCK_IDS) -> np.ndarray:
    """The ids of one block, from its bytes alone."""
    end = offsets[block + 1] if block + 1 < len(offsets) else len(data)
    return unpack(data[offsets[block] : end], width, min(block_ids, n - block * block_ids))


class Encoder:
    """Ids of texts. Merges never cross a space, so single words are encoded once and kept; texts for which that could differ are encoded whole."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.kind = np.uint16 if len(pieces) <= 65536 else np.uint32
        self.starts = np.array([p.startswith("▁") for p in pieces])
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces)
        self.known: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Encodes many words in one call: in the ids of the joined words, each word begins at a piece with the word mark."""
        ids = np.asarray(self.sp.encode(" ".join(words), num_threads=1), self.kind)
        at = np.flatnonzero(self.starts[ids]).tolist()
        if len(at) != len(words):
            raise RuntimeError("a word doesn't begin with a word mark")
        raw, size = ids.tobytes(), ids.itemsize
        self.known.update(zip(words, (raw[a * size : b * size] for a, b in zip(at, [*at[1:], len(ids)]))))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        known, out = self.known, []
        if len(known) > MAX_WORDS:
            known.clear()
        parts = [t.split(" ") if t and self.by_word and "  " not in t and "▁" not in t and t[0] != " " and t[-1] != " " else None for t in texts]
        got = [[*map(known.get, p)] if p else [] for p in parts]
        new = [*{w for p, g in zip(parts, got) if None in g for w, i in zip(p, g) if i is None}]
        for a in range(0, len(new), 500):
            self.learn(new[a : a + 500])
        for t, p, g in zip(texts, parts, got):
            out.append(np.frombuffer(b"".join([known[w] if i is None else i for w, i in zip(p, g)]), self.kind) if p else np.asarray(self.sp.encode(t, num_threads=1) if t else [], self.kind))
        return out


def pack_tokens(docs: DataFrame, model: bytes, block_ids: int = BLOCK_IDS) -> DataFrame:
    """A row for each row of docs: doc_id, n_tokens, bit_width, block_offsets (array of bigint), packed (binary). No shuffle; whole texts.

    Null and empty texts: no tokens, no blocks, empty bytes. Repeated rows are packed one by one, and equal texts give equal bytes, null ids are carried,
    extra columns aren't read, an empty table gives an empty result. Texts of any length are packed whole, block by block.
    """
    if block_ids % 8:
        raise ValueError("block_ids must be a multiple of 8")
    key = hash(model)

    def run(x, _):
        store = common.worker_store()
        if store.get("bit_packing", (None,))[0] != key:
            store["bit_packing"] = key, Encoder(model)
        encoder = store["bit_packing"][1]
        width, ids = bit_width(encoder.sp.get_piece_size()), []
        for a in range(0, len(x["text"]), 500):
            ids += encoder.encode(x["text"][a : a + 500])
        return {"doc_id": x["doc_id"], "n_tokens": [len(i) for i in ids], "bit_width": [width] * len(ids), "block_offsets": [block_offsets(len(i), width, block_ids) for i in ids], "packed": [pack(i, width) for i in ids]}

    kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "bit_width": pa.int32(), "block_offsets": pa.list_(pa.int64()), "packed": pa.binary()}
    return common.map_batches(common.pick(docs, doc_id="bigint", text="string"), run, "doc_id bigint, n_tokens bigint, bit_width int, block_offsets array<bigint>, packed binary", kinds)


def load_model(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(common.table(spark, sf_dir, "documents"), load_model())
