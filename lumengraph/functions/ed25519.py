"""Signatures after RFC 8032 (Ed25519), in whole numbers: some milliseconds each, for logs and replicas without a library of their own."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

PRIME, ORDER = 2**255 - 19, 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, PRIME) % PRIME
ROOT = pow(2, (PRIME - 1) // 4, PRIME)
ZERO = (0, 1, 1, 0)


def _join(p, q):
    """The sum of two points in extended coordinates."""
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % PRIME, (p[1] + p[0]) * (q[1] + q[0]) % PRIME
    c, d = 2 * p[3] * q[3] * D % PRIME, 2 * p[2] * q[2] % PRIME
    return (b - a) * (d - c) % PRIME, (d + c) * (b + a) % PRIME, (d - c) * (d + c) % PRIME, (b - a) * (b + a) % PRIME


def _times(n: int, p):
    out = ZERO
    for bit in bin(n)[2:]:
        out = _join(out, out)
        if bit == "1":
            out = _join(out, p)
    return out


def _same(p, q) -> bool:
    return not (p[0] * q[2] - q[0] * p[2]) % PRIME and not (p[1] * q[2] - q[1] * p[2]) % PRIME


def _x(y: int, odd: int) -> int | None:
    if y >= PRIME:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, -1, PRIME) % PRIME
    x = pow(square, (PRIME + 3) // 8, PRIME)
    if (x * x - square) % PRIME:
        x = x * ROOT % PRIME
    if (x * x - square) % PRIME or not x and odd:
        return None
    return x if x & 1 == odd else PRIME - x


def _read(raw: bytes):
    n = int.from_bytes(raw, "little")
    y, odd = n & (1 << 255) - 1, n >> 255
    x = _x(y, odd)
    return None if x is None else (x, y, 1, x * y % PRIME)


def _write(p) -> bytes:
    z = pow(p[2], -1, PRIME)
    x, y = p[0] * z % PRIME, p[1] * z % PRIME
    return (y | (x & 1) << 255).to_bytes(32, "little")


BASE = _read((4 * pow(5, -1, PRIME) % PRIME).to_bytes(32, "little"))


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    return int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254, h[32:]


def public_key(seed: bytes) -> bytes:
    """Of a secret of 32 bytes."""
    return _write(_times(_secret(seed)[0], BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix = _secret(seed)
    r = _hash(prefix, message) % ORDER
    first = _write(_times(r, BASE))
    k = _hash(first, public_key(seed), message) % ORDER
    return first + ((r + k * a) % ORDER).to_bytes(32, "little")


def verify(key: bytes, message: bytes, signature: bytes) -> bool:
    if len(key) != 32 or len(signature) != 64:
        return False
    a, r, s = _read(key), _read(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= ORDER:
        return False
    return _same(_times(s, BASE), _join(r, _times(_hash(signature[:32], key, message) % ORDER, a)))


@F.pandas_udf(BooleanType())
def verified(key: pd.Series, payload: pd.Series, signature: pd.Series) -> pd.Series:
    """False where anything is null."""
    ok = lambda k, p, s: k is not None and p is not None and s is not None and verify(bytes(k), p.encode(), bytes(s))
    return pd.Series([ok(*x) for x in zip(key, payload, signature)], dtype=bool)


def signer(seed: bytes):
    """A function of a column of texts that gives their signatures as JSON lists of numbers, as the log holds them."""

    @F.pandas_udf("string")
    def signed(payload: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else str(list(sign(seed, p.encode()))).replace(" ", "") for p in payload], dtype=object)

    return signed
