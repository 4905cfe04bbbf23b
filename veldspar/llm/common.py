"""Words, shingles and row versions shared by the operators of this subpackage."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Lower-cased maximal runs of letters and digits."""
    return WORD.findall(text.lower()) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def one_row_each(df: DataFrame, key: str, *values: str) -> DataFrame:
    """``(key, *values)``: one row per key, of several different ones the least; null keys are dropped, since they identify no record.

    Only keys are counted over all rows.  The values of a key that comes once are never shuffled; those of the others are, and they combine on the map side, so a key
    with a third of all rows costs no more than another.
    """
    rows = df.where(F.col(key).isNotNull()).select(key, *values)
    more = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    once = keep_by(rows, more, key, "left_anti")
    again = keep_by(rows, more, key, "left_semi").groupBy(key).agg(F.min(F.struct(*values)).alias("s")).select(key, *[F.col(f"s.{v}").alias(v) for v in values])
    return once.select(key, *values).unionByName(again)


def keep_by(df: DataFrame, keys: DataFrame, column: str, how: str, most: int = 500_000) -> DataFrame:
    """A semi or anti join that broadcasts the keys where a count shows them to be few, and shuffles beyond."""
    few = keys.limit(most + 1).count() <= most
    return df.join(F.broadcast(keys) if few else keys, column, how)


class WordHashes:
    """64-bit hashes of words, with a bounded cache."""

    def __init__(self, limit: int = 200_000):
        self.seen: dict[str, int] = {}
        self.limit = limit

    def __call__(self, tokens: list[str]) -> np.ndarray:
        seen, h = self.seen, xxhash.xxh3_64_intdigest
        if len(seen) > self.limit:
            seen.clear()
        for t in set(tokens):
            if t not in seen:
                seen[t] = h(t)
        return np.fromiter((seen[t] for t in tokens), np.uint64, len(tokens))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(3) + GOLDEN + h[i : len(h) - n + 1 + i])
    return out


def shingle_sets(texts: list[str | None], n: int, least_words: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts at once: (hashes, offsets, counts of each hash).

    Texts with fewer than ``least_words`` words have none.
    """
    flat: list[str] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = words(t)
        if len(w) >= max(least_words, n):
            sizes[i] = len(w)
            flat += w
    doc = np.repeat(np.arange(len(texts)), sizes)
    w = window_hashes(hashes(flat), n)
    if not len(w):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64), np.empty(0, np.int64)
    inside = doc[: len(w)] == doc[n - 1 :]
    w, doc = w[inside], doc[: len(w)][inside]
    order = np.lexsort((w, doc))
    w, doc = w[order], doc[order]
    first = np.ones(len(w), bool)
    first[1:] = (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    counts = np.diff(np.append(at, len(w)))
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(doc[at], minlength=len(texts)), out=offsets[1:])
    return w[at], offsets, counts


def to_lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def jaccard(a: Column, b: Column) -> Column:
    """Common elements over all elements of two arrays without repeats; null if both are empty."""
    common = F.size(F.array_intersect(a, b))
    return common / F.nullif(F.size(a) + F.size(b) - common, F.lit(0))
