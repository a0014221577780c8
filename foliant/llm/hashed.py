"""Hashed n-grams of whole texts, and bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Units (bytes or characters) of a text that are hashed at once; pieces overlap by the longest n-gram.
PIECE = 1 << 18
_MUL = np.uint64(0x9E3779B97F4A7C15)


def grams(text: np.ndarray, sizes: tuple[int, ...], bits: int):
    """Buckets of the n-grams of each size, one array a size and piece; each place in the text (an array of its bytes or code points) counts once."""
    longest = max(sizes)
    for at in range(0, max(1, len(text)), PIECE):
        data = text[at : at + PIECE + longest - 1].astype(np.uint64)
        acc = np.zeros(len(data), np.uint64)
        for n in range(1, longest + 1):
            if len(data) < n:
                break
            acc = (acc[: len(data) - n + 1] + data[n - 1 :] + np.uint64(1)) * _MUL
            acc ^= acc >> np.uint64(29)
            if n in sizes:
                yield ((acc[: PIECE if at + PIECE < len(text) else None] * _MUL + np.uint64(n)) * _MUL >> np.uint64(64 - bits)).astype(np.int64)


def sampled(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most so many rows, those first in the order of a hash of the id; rows with a null id are left out."""
    rows = rows.where(F.col(id_col).isNotNull())
    n = rows.count()
    share = F.pmod(F.xxhash64(id_col, F.lit(3)), F.lit(1_000_000))
    near = rows if n <= most else rows.where(share < int(1_000_000 * min(1.0, 1.2 * most / n) + 1))
    return near.orderBy(F.xxhash64(id_col, F.lit(3)), id_col).limit(most)
