"""Hashes whose bits must agree with other systems: canonical Murmur3 (x86, 32 bit), FNV-1a 64, ring positions. Vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_M = 0xFFFFFFFF


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """The scalar definition, unsigned."""
    c1, c2, h = 0xCC9E2D51, 0x1B873593, seed & _M
    whole = len(data) & ~3
    for i in range(0, whole, 4):
        k = int.from_bytes(data[i : i + 4], "little") * c1 & _M
        k = ((k << 15) | (k >> 17)) & _M
        h ^= k * c2 & _M
        h = ((h << 13) | (h >> 19)) & _M
        h = (h * 5 + 0xE6546B64) & _M
    tail = int.from_bytes(data[whole:], "little")
    if len(data) > whole:
        k = tail * c1 & _M
        k = ((k << 15) | (k >> 17)) & _M
        h ^= k * c2 & _M
    return fmix32(h ^ len(data))


def fmix32(h: int) -> int:
    h &= _M
    h = (h ^ (h >> 16)) * 0x85EBCA6B & _M
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & _M
    return h ^ (h >> 16)


def murmur3_many(values: list[bytes], seed: int = 0) -> np.ndarray:
    """All values at once: grouped by length, so that each group is a matrix of 32-bit blocks."""
    out = np.zeros(len(values), dtype=np.uint32)
    lengths = np.fromiter(map(len, values), dtype=np.int64, count=len(values))
    with np.errstate(over="ignore"):
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            raw = np.frombuffer(b"".join(values[i] for i in at), dtype=np.uint8).reshape(len(at), n)
            h = np.full(len(at), seed & _M, dtype=np.uint32)
            rot = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
            mix = lambda k: rot(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
            whole = n // 4 * 4
            for k in np.ascontiguousarray(raw[:, :whole]).view("<u4").T if whole else ():
                h = rot(h ^ mix(k), 13) * np.uint32(5) + np.uint32(0xE6546B64)
            if n > whole:
                k = np.zeros(len(at), dtype=np.uint32)
                for j in range(n - whole):
                    k |= raw[:, whole + j].astype(np.uint32) << np.uint32(8 * j)
                h ^= mix(k)
            h ^= np.uint32(n)
            h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
            h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            out[at] = h ^ (h >> np.uint32(16))
    return out


def fnv1a64(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def java_hash(text: str) -> int:
    """The 31-polynomial over UTF-16 code units, as a signed 32-bit integer."""
    h = 0
    for unit in memoryview(text.encode("utf-16-le", "surrogatepass")).cast("H"):
        h = (31 * h + unit) & _M
    return h - (1 << 32) if h >> 31 else h


def ring_position(text: str) -> int:
    """A non-negative position: the avalanche of the polynomial hash, absolute in 32 bits (the one value without an absolute stays negative)."""
    h = fmix32(java_hash(text))
    s = h - (1 << 32) if h >> 31 else h
    return abs(s) if s != -(1 << 31) else s


def _bytes(values: pd.Series) -> list[bytes]:
    return [b"" if v is None else v.encode("utf-8", "surrogatepass") if isinstance(v, str) else bytes(v) for v in values]


def murmur3(column: Column, seed: int = 0) -> Column:
    """Canonical Murmur3 of a string or binary column, unsigned in a long; null stays null."""

    def run(values: pd.Series) -> pd.Series:
        return pd.Series(murmur3_many(_bytes(values), seed).astype(np.int64)).where(values.notna().to_numpy()).astype("Int64")

    return F.pandas_udf(run, T.LongType())(column)


def ring(column: Column) -> Column:
    def run(values: pd.Series) -> pd.Series:
        return values.map(ring_position, na_action="ignore").astype("Int64")

    return F.pandas_udf(run, T.LongType())(column)


def fnv64(column: Column) -> Column:
    """FNV-1a 64 of a string or binary column as a signed long."""

    def run(values: pd.Series) -> pd.Series:
        h = np.array([fnv1a64(b) for b in _bytes(values)], dtype=np.uint64).view(np.int64)
        return pd.Series(h).where(values.notna().to_numpy()).astype("Int64")

    return F.pandas_udf(run, T.LongType())(column)
