"""Scalar expressions: tiers, stability, importance, JSON, identifiers, digests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

TIER_WEIGHTS = {"MASTER": 1.0, "SPEC": 0.8, "ADR": 0.6, "USER": 0.3}
STABILITY = {"stable": 1.0, "active": 0.8, "draft": 0.4, "deprecated": 0.1}
DEFAULT_STABILITY, DEFAULT_IMPACT = 0.8, 0.7
HOPS = {f"H{i}": i for i in range(6)}


def has_label(labels: Column, name: str) -> Column:
    return F.coalesce(F.exists(labels, lambda x: F.upper(x) == name), F.lit(False))


def tier(labels: Column) -> Column:
    """The first of MASTER, SPEC, ADR that a label names, whatever its case; else USER."""
    return F.when(has_label(labels, "MASTER"), "MASTER").when(has_label(labels, "SPEC"), "SPEC").when(has_label(labels, "ADR"), "ADR").otherwise("USER")


def tier_weight(name: Column) -> Column:
    out = F.lit(TIER_WEIGHTS["USER"])
    for k, w in TIER_WEIGHTS.items():
        out = F.when(name == k, F.lit(w)).otherwise(out)
    return out


def json_field(props: Column, name: str) -> Column:
    return F.get_json_object(props, f"$.{name}")


def stability(props: Column) -> Column:
    value, out = json_field(props, "stability"), F.lit(DEFAULT_STABILITY)
    for k, w in STABILITY.items():
        out = F.when(value == k, F.lit(w)).otherwise(out)
    return out


def impact(in_degree: Column, labels: Column, props: Column) -> Column:
    """Half by in-degree, saturated at ten; the rest by tier and stability."""
    return 0.5 * F.least(F.lit(1.0), F.coalesce(in_degree, F.lit(0)) / 10.0) + 0.3 * tier_weight(tier(labels)) + 0.2 * stability(props)


def hops(tier_name: Column) -> Column:
    """H0 to H5 are 0 to 5 hops, anything else counts as H1."""
    return F.when(tier_name.rlike("^H[0-5]$"), F.substring(tier_name, 2, 1).cast("int")).otherwise(F.lit(1))


def compact_bytes(props: Column) -> Column:
    """Bytes in UTF-8 of a JSON value without spaces between its tokens; what doesn't parse counts as it is."""
    return F.octet_length(F.coalesce(F.to_json(F.try_parse_json(props)), props))


def strip_marks(text: Column) -> Column:
    return F.regexp_replace(text, r"[\p{Mn}\p{Mc}\p{Me}]", "")


def tokens(text: Column) -> Column:
    """Lower-case characters, the characters left once combining marks are gone (where there were any), and bigrams."""
    chars = lambda t: F.filter(F.split(t, ""), lambda c: c != "")
    bare = strip_marks(text)
    pairs = F.when(F.length(text) > 1, F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, 2))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(chars(F.lower(text)), F.when(bare != text, chars(F.lower(bare))).otherwise(F.array().cast("array<string>")), pairs))


def peer_id(public_key: Column) -> Column:
    return F.substring(F.sha2(public_key, 256), 1, 16)


def add_seconds(ts: Column, seconds: Column) -> Column:
    return ts + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def letters(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points in a matrix, 0 after the end, and lengths."""
    n = np.array([len(s) for s in strings])
    out = np.zeros((len(strings), max(1, int(n.max(initial=0)))), np.uint32)
    for i, s in enumerate(strings):
        out[i, : n[i]] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, n


def jaro_winkler_many(one: str, strings: list[str]) -> np.ndarray:
    """Jaro-Winkler similarity of one string to each of many, vectorised over the many. The prefix of up to 4 counts where Jaro is above 0.7."""
    m, (b, n) = len(one), letters(strings)
    rows = np.arange(len(strings))
    window = np.maximum(np.maximum(m, n) // 2 - 1, 0)
    used, hits = np.zeros(b.shape, bool), np.zeros((len(strings), m), bool)
    place = np.arange(b.shape[1])[None]
    for i, c in enumerate(one):
        ok = (b == ord(c)) & ~used & (np.abs(place - i) <= window[:, None]) & (place < n[:, None])
        at = ok.argmax(axis=1)
        got = ok[rows, at]
        used[rows[got], at[got]] = True
        hits[:, i] = got
    matches = hits.sum(axis=1)
    a = np.array([ord(c) for c in one], np.uint32)
    # Matched characters of both in order, packed to the left: those that differ are half transpositions.
    left = np.take_along_axis(np.broadcast_to(a, hits.shape), np.argsort(~hits, axis=1, kind="stable"), 1)
    right = np.take_along_axis(b, np.argsort(~used, axis=1, kind="stable"), 1)
    k = min(left.shape[1], right.shape[1])
    swapped = ((left[:, :k] != right[:, :k]) & (np.arange(k)[None] < matches[:, None])).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (matches / m + matches / n + (matches - swapped) / matches) / 3 if m else np.zeros(len(strings))
    jaro = np.where(matches > 0, jaro, 0.0)
    jaro = np.where((n == 0) & (m == 0), 1.0, jaro)
    same = np.zeros(len(strings), int)
    alive = np.ones(len(strings), bool)
    for i in range(min(4, m, b.shape[1])):
        alive &= (b[:, i] == ord(one[i])) & (i < n)
        same += alive
    return np.where(jaro > 0.7, jaro + 0.1 * same * (1 - jaro), jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Row by row; rows with the same left side are computed together."""
    out = pd.Series(np.nan, index=a.index)
    frame = pd.DataFrame({"a": a, "b": b}).dropna()
    for one, g in frame.groupby("a", sort=False):
        out[g.index] = jaro_winkler_many(one, g["b"].tolist())
    return out.astype(object).where(out.notna(), None)
