"""Seeded hashes as Column expressions.

xxHash64 with seed 42 is built in; other seeds use the same JVM expression where the session is a
classic one.  The 32-bit and finalizer hashes have no built-in form with a free seed and run as
Arrow-batched UDFs over NumPy vectors; they are for checking against other systems, not for joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

M32 = 0xFFFFFFFF


def xxhash64(col: Column, seed: int = 42) -> Column:
    """64-bit xxHash of an int (4 bytes) or bigint (8 bytes) column, as a signed long.

    The JVM's own expression in a classic session; a remote one has none to reach, and hashes Arrow
    batches of the bigint ``col`` with NumPy.
    """
    if seed == 42:
        return F.xxhash64(col)
    from pyspark import SparkContext

    if SparkContext._active_spark_context is None:
        return xxhash64_arrow(col, seed)
    from pyspark.sql.classic.column import Column as Classic

    jvm = SparkContext._active_spark_context._jvm
    utils = getattr(getattr(jvm.org.apache.spark.sql.classic, "ExpressionUtils$"), "MODULE$")
    children = jvm.PythonUtils.toSeq([utils.expression(col._jc)])
    return Classic(utils.column(jvm.org.apache.spark.sql.catalyst.expressions.XxHash64(children, int(seed))))


def np_xxh64(words: np.ndarray, seed: int = 0) -> np.ndarray:
    """xxHash64 of rows of one or two 32-bit little-endian words."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    turned = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    h = np.full(len(words), np.uint64(seed)) + p5 + np.uint64(4 * words.shape[1])
    if words.shape[1] == 2:
        k = np.ascontiguousarray(words).view(np.uint64).ravel()
        h = turned(h ^ (turned(k * p2, 31) * p1), 27) * p1 + p4
    else:
        h = turned(h ^ (words[:, 0].astype(np.uint64) * p1), 23) * p2 + p3
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def xxhash64_arrow(col: Column, seed: int = 0, wide: bool = True) -> Column:
    """``xxhash64`` of an int or (``wide``) bigint column without the JVM's expression."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(np_xxh64(_words(s, wide), seed).view(np.int64))

    return run(col.cast("long") if wide else col.cast("int"))


def mul32(a: Column | int, b: Column | int) -> Column:
    """a * b mod 2**32 of longs in [0, 2**32), without overflow under ANSI arithmetic."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))
    low = a * b.bitwiseAND(F.lit(0xFFFF).cast("long"))
    high = F.shiftleft((a * F.shiftright(b, 16)).bitwiseAND(F.lit(0xFFFF).cast("long")), 16)
    return (low + high).bitwiseAND(F.lit(M32).cast("long"))


def fmix32(col: Column, seed: int = 0) -> Column:
    """The MurmurHash3 32-bit finalizer of (value xor seed), as a long in [0, 2**32)."""
    mask = F.lit(M32).cast("long")
    h = col.cast("long").bitwiseAND(mask).bitwiseXOR(F.lit(seed & M32).cast("long"))
    h = mul32(h.bitwiseXOR(F.shiftright(h, 16)), 0x85EBCA6B)
    h = mul32(h.bitwiseXOR(F.shiftright(h, 13)), 0xC2B2AE35)
    return h.bitwiseXOR(F.shiftright(h, 16))


def np_fmix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    h = x.astype(np.int64).view(np.uint64) ^ np.uint64(seed)
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(m)
    return h ^ (h >> np.uint64(33))


def fmix64(col: Column, seed: int = 0) -> Column:
    """The MurmurHash3 64-bit finalizer of (value xor seed), as a signed long."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(np_fmix64(s.to_numpy(), seed).view(np.int64))

    return run(col.cast("long"))


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def np_murmur32(words: np.ndarray, seed: int = 0) -> np.ndarray:
    """MurmurHash3 x86 32-bit of rows of 32-bit little-endian words."""
    h = np.full(len(words), np.uint32(seed))
    for k in words.T:
        k = _rot(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = _rot(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4 * words.shape[1])
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def np_xxh32(words: np.ndarray, seed: int = 0) -> np.ndarray:
    """xxHash32 of rows of fewer than four 32-bit little-endian words."""
    p2, p3, p4, p5 = (np.uint32(x) for x in (2246822519, 3266489917, 668265263, 374761393))
    h = np.full(len(words), np.uint32(seed)) + p5 + np.uint32(4 * words.shape[1])
    for k in words.T:
        h = _rot(h + k * p3, 17) * p4
    h = (h ^ (h >> np.uint32(15))) * p2
    h = (h ^ (h >> np.uint32(13))) * p3
    return h ^ (h >> np.uint32(16))


def _words(s: pd.Series, wide: bool) -> np.ndarray:
    return s.to_numpy().astype(np.int64 if wide else np.int32).view(np.uint32).reshape(len(s), -1)


def murmur32(col: Column, seed: int = 0, wide: bool = False) -> Column:
    """MurmurHash3 32-bit of an int (or, ``wide``, bigint) column, as a long in [0, 2**32)."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(np_murmur32(_words(s, wide), seed).astype(np.int64))

    return run(col)


def xxhash32(col: Column, seed: int = 0, wide: bool = False) -> Column:
    """xxHash32 of an int (or, ``wide``, bigint) column, as a long in [0, 2**32)."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(np_xxh32(_words(s, wide), seed).astype(np.int64))

    return run(col)
