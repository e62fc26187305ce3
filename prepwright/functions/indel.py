"""Normalised insert/delete similarity, 200 * LCS / (|a| + |b|), as an Arrow UDF.

The longest common subsequences of a whole batch of pairs are found together, with the
published bit-vector recurrence (Crochemore et al. 2001, Hyyro 2004) on numpy columns: one
step per character of the longer batch, 64 positions of the other text per machine word.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors need no installed copy of this package: the helpers travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Characters whose masks are held at once; a longer pair makes a batch of its own.
BATCH_CHARS = 1 << 19
CODE_BITS = 21


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the number of the text of each."""
    sizes = [len(t) for t in texts]
    return (np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64),
            np.repeat(np.arange(len(texts)), sizes))


def _batch_lcs(a: list[str], b: list[str]) -> np.ndarray:
    """LCS lengths of pairs whose ``a`` texts take the same number of words."""
    size_a, size_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    words = max(1, -(-int(size_a.max()) // 64))
    codes, owner = _codes(a)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(size_a) - size_a, size_a)
    keys, at = np.unique((owner << CODE_BITS) | codes, return_inverse=True)
    # Where each character of a pair's ``a`` stands, one bit per position; the last row is of no character.
    masks = np.zeros((len(keys) + 1, words), np.uint64)
    np.bitwise_or.at(masks, (at, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    codes, owner = _codes(b)
    wanted = (owner << CODE_BITS) | codes
    found = np.searchsorted(keys, wanted)
    hit = found < len(keys)
    hit[hit] = keys[found[hit]] == wanted[hit]
    found = np.where(hit, found, len(keys))
    begin = np.cumsum(size_b) - size_b
    order = np.argsort(-size_b, kind="stable")
    begin, left = begin[order], size_b[order]
    free = np.full((len(a), words), ~np.uint64(0))
    for step in range(int(size_b.max())):
        active = int(np.searchsorted(-left, -step, "left"))   # pairs with a character left
        mask, carry = masks[found[begin[:active] + step]], np.zeros(active, np.uint64)
        for w in range(words):
            now = free[:active, w]
            used = now & mask[:, w]
            total = now + used
            over = total < now
            total += carry
            carry = (over | (total < carry)).astype(np.uint64)
            free[:active, w] = total | (now & ~used)
    bits = np.arange(words * 64).reshape(words, 64)
    inside = np.clip(size_a[order][:, None] - bits[:, 0], 0, 64)
    keep = np.where(inside == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(inside, 63).astype(np.uint64)) - np.uint64(1))
    out = np.empty(len(a), np.int64)
    out[order] = np.bitwise_count(~free & keep).sum(axis=1)
    return out


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair."""
    out = np.zeros(len(a), np.int64)
    width = np.array([-(-len(x) // 64) for x in a])
    for words in np.unique(width[width > 0]):
        same = np.flatnonzero(width == words)
        chars = np.cumsum([(len(a[i]) * words + len(b[i])) for i in same])
        for part in np.split(same, np.flatnonzero(np.diff(chars // BATCH_CHARS)) + 1):
            part = part[[len(b[i]) > 0 for i in part]]
            if len(part):
                out[part] = _batch_lcs([a[i] for i in part], [b[i] for i in part])
    return out


def similarities(a: list, b: list) -> np.ndarray:
    """Similarity 0..100 of each pair; NaN if a text is missing, 100 for two empty texts."""
    missing = np.array([x is None or y is None for x, y in zip(a, b)], bool)
    a, b = ["" if x is None else x for x in a], ["" if x is None else x for x in b]
    size = np.array([len(x) + len(y) for x, y in zip(a, b)], float)
    same = np.where(size > 0, 200.0 * lcs_lengths(a, b) / np.maximum(size, 1), 100.0) if len(a) else size
    return np.where(missing, np.nan, same)


@F.pandas_udf(T.DoubleType())
def _similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(similarities(a.tolist(), b.tolist()))


def indel_ratio(a: Column, b: Column) -> Column:
    """Similarity 0..100 of two text columns; NULL if either is NULL."""
    return F.when(a.isNotNull() & b.isNotNull(), _similarity_udf(a, b))
