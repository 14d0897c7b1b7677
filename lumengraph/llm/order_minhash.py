"""Document fingerprints: order MinHash (Marçais, DeBlasio, Pandey, Kingsford 2019).

Every k-mer of characters is numbered by its occurrence in the text. For each of m orders, the l least (k-mer, occurrence) pairs
are taken, put back in text order, and the tuple of their k-mers is hashed. Two texts agree in a coordinate with a
probability that falls as their edit distance grows, moved passages included.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

K, L, M, SEED = 8, 3, 16, 20240607
_A, _B, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x100000001B3)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def orders(m: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, m, dtype=np.uint64)


def kmers(text: str, k: int) -> np.ndarray:
    """A 64-bit code of each k-mer; a shorter text is one k-mer."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    k = min(k, len(c))
    out = np.zeros(len(c) - k + 1, np.uint64)
    for i in range(k):
        out = out * _P + c[i : len(c) - k + 1 + i]
    return mix(out)


def occurrences(codes: np.ndarray) -> np.ndarray:
    """How often the same code stands earlier in the text."""
    order = np.argsort(codes, kind="stable")
    s = codes[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    start = np.flatnonzero(new)
    out = np.empty(len(s), np.uint64)
    out[order] = np.arange(len(s)) - np.repeat(start, np.diff(np.append(start, len(s))))
    return out


def fingerprint(text: str | None, k: int, l: int, mult: np.ndarray, add: np.ndarray) -> list[int] | None:  # noqa: E741
    """m signed 64-bit numbers; None for a null or empty text. With fewer than l k-mers all of them are taken."""
    if not text:
        return None
    codes = kmers(text, k)
    base = mix(codes + mix(occurrences(codes) + np.uint64(1)))
    n, m = len(codes), len(mult)
    least = min(l, n)
    # Nearly always at least l of n values lie below this bound; where not, the whole array is partitioned.
    bound = np.uint64(min(2**64 - 1, 2**64 * 10 * l // n))
    picked = np.empty((m, least), np.int64)
    for j in range(m):
        h = base * mult[j]
        h += add[j]
        at = np.flatnonzero(h <= bound)
        if len(at) < least:
            at = np.argpartition(h, least - 1)[:least]
        near = h[at]
        # The position breaks ties of hashes, so that any way of finding the least ones agrees.
        picked[j] = at[np.lexsort((at, near))[:least]] if len(at) > least else at
    picked.sort(axis=1)
    out = np.arange(1, m + 1, dtype=np.uint64)
    for i in range(least):
        out = mix(out * _P + codes[picked[:, i]])
    return out.view(np.int64).tolist()


def fingerprints(docs: DataFrame, k: int = K, l: int = L, m: int = M, seed: int = SEED) -> DataFrame:  # noqa: E741
    """A row for each row of docs: doc_id, n_kmers, fingerprint (array of m bigint). No shuffle; whole texts.

    Null and empty texts: 0 k-mers, null fingerprint. A text shorter than k is one k-mer. Repeated rows are taken one by
    one and equal texts get equal fingerprints, null ids are carried, extra columns aren't read, an empty table gives an empty result.
    Of k-mers whose hashes are equal the earlier counts as less. Texts of any length are read whole.
    """
    mult, add = orders(m, seed)

    def run(x, _):
        return {"doc_id": x["doc_id"], "n_kmers": [max(1, len(t) - k + 1) if t else 0 for t in x["text"]], "fingerprint": [fingerprint(t, k, l, mult, add) for t in x["text"]]}

    return common.map_batches(common.pick(docs, doc_id="bigint", text="string"), run, "doc_id bigint, n_kmers bigint, fingerprint array<bigint>", {"doc_id": pa.int64(), "n_kmers": pa.int64(), "fingerprint": pa.list_(pa.int64())})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.table(spark, sf_dir, "documents"))
