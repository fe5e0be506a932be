"""Hashed character n-grams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_STEP = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1], np.uint32)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)


def cells(codes: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """The cell (0 .. 2**bits - 1) of every n-gram of each of the orders."""
    out = []
    for k in orders:
        n = len(codes) - k + 1
        if n > 0:
            h = np.full(n, k, np.uint32)
            for j in range(k):
                h = (h ^ codes[j : j + n]) * _STEP[j]
                h ^= h >> np.uint32(15)
            out.append((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def balanced(rows: DataFrame, label: str, key: str, each: int) -> tuple[DataFrame, list]:
    """About ``each`` rows of every label, by a hash of ``key``, and the labels; all rows of a label that has fewer."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # one row for each label
    width = 1 << 20
    share = F.coalesce(*[F.when(F.col(label) == v, F.lit(min(width, int(width * each / n)))) for v, n in counts.items()], F.lit(0))
    return rows.where(F.pmod(F.xxhash64(key), F.lit(width)) < share), sorted(counts)
