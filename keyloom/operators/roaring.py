"""Portable compressed integer bitmaps: parse, validate, serialize, and exact membership by join.

Bitmaps are bytes in the public portable format (32-bit, and 64-bit as buckets of those).  Parsing
gives a table of containers (bucket, hi, kind, card, low values, words, runs); membership is an
equi-join on (bucket, hi) and a test inside the container.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the portable format.
COOKIE_PLAIN = 12346
COOKIE_RUNS = 12347
OFFSETS_FROM = 4
ARRAY_MOST = 4096
BITSET_BYTES = 8192

SCHEMA = "bucket long, hi int, kind string, card int, low array<int>, words array<long>, runs array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Container:
    hi: int
    card: int
    values: tuple[int, ...] = ()
    words: tuple[int, ...] = ()
    runs: tuple[tuple[int, int], ...] = ()  # first and last, both inside

    @property
    def kind(self) -> str:
        return "runs" if self.runs else "bitset" if self.words else "array"

    def __contains__(self, low: int) -> bool:
        if self.runs:
            i = bisect_right(self.runs, (low, 1 << 16)) - 1
            return i >= 0 and self.runs[i][0] <= low <= self.runs[i][1]
        if self.words:
            return bool(self.words[low >> 6] >> (low & 63) & 1)
        i = bisect_right(self.values, low) - 1
        return i >= 0 and self.values[i] == low

    def row(self, bucket: int) -> tuple:
        signed = [w - (1 << 64) if w >> 63 else w for w in self.words]
        return bucket, self.hi, self.kind, self.card, list(self.values) or None, signed or None, [{"start": a, "end": b} for a, b in self.runs] or None


class _Reader:
    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def take(self, form: str) -> tuple:
        size = struct.calcsize("<" + form)
        if self.at + size > len(self.data):
            raise ValueError("the bitmap is truncated")
        out = struct.unpack_from("<" + form, self.data, self.at)
        self.at += size
        return out


def parse32(data: bytes, at: int = 0) -> tuple[list[Container], int]:
    """(containers, end) of a 32-bit bitmap; ValueError if it is malformed."""
    r = _Reader(data, at)
    (cookie,) = r.take("I")
    flags = b""
    if cookie & 0xFFFF == COOKIE_RUNS:
        n = (cookie >> 16) + 1
        flags = r.take(f"{(n + 7) // 8}s")[0]
    elif cookie == COOKIE_PLAIN:
        (n,) = r.take("I")
        if n > 1 << 16:
            raise ValueError("too many containers")
    else:
        raise ValueError("an unknown cookie")
    heads = [r.take("HH") for _ in range(n)]
    if any(a[0] >= b[0] for a, b in zip(heads, heads[1:], strict=False)):
        raise ValueError("container keys must increase")
    offsets = r.take(f"{n}I") if n and (not flags or n >= OFFSETS_FROM) else None
    if offsets and any(a >= b for a, b in zip(offsets, offsets[1:], strict=False)):
        raise ValueError("container offsets must increase")
    out = []
    for i, (hi, less) in enumerate(heads):
        if offsets:
            if at + offsets[i] < r.at:
                raise ValueError("a container offset points into what precedes it")
            r.at = at + offsets[i]
        card = less + 1
        if flags and flags[i // 8] >> (i % 8) & 1:
            (k,) = r.take("H")
            flat = r.take(f"{2 * k}H")
            runs = tuple((s, s + more) for s, more in zip(flat[::2], flat[1::2], strict=True))
            if any(e > 0xFFFF for _, e in runs) or any(a[1] >= b[0] for a, b in zip(runs, runs[1:], strict=False)):
                raise ValueError("runs must increase within a container")
            out.append(Container(hi, card, runs=runs))
        elif card > ARRAY_MOST:
            out.append(Container(hi, card, words=r.take(f"{BITSET_BYTES // 8}Q")))
        else:
            out.append(Container(hi, card, values=r.take(f"{card}H")))
    return out, r.at


def parse64(data: bytes) -> dict[int, list[Container]]:
    """bucket -> containers of a 64-bit bitmap."""
    r = _Reader(data)
    (n,) = r.take("Q")
    out: dict[int, list[Container]] = {}
    last = -1
    for _ in range(n):
        (key,) = r.take("I")
        if key <= last:
            raise ValueError("bucket keys must increase")
        out[key], r.at = parse32(data, r.at)
        last = key
    return out


def _containers(values: Iterable[int], runs: bool) -> Iterator[Container]:
    groups: dict[int, list[int]] = {}
    for v in sorted(set(values)):
        groups.setdefault(v >> 16, []).append(v & 0xFFFF)
    for hi, low in groups.items():
        spans: list[list[int]] = []
        for x in low:
            if spans and spans[-1][1] == x - 1:
                spans[-1][1] = x
            else:
                spans.append([x, x])
        plain = 2 * len(low) if len(low) <= ARRAY_MOST else BITSET_BYTES
        if runs and 2 + 4 * len(spans) < plain:
            yield Container(hi, len(low), runs=tuple((a, b) for a, b in spans))
        elif len(low) > ARRAY_MOST:
            words = [0] * (BITSET_BYTES // 8)
            for x in low:
                words[x >> 6] |= 1 << (x & 63)
            yield Container(hi, len(low), words=tuple(words))
        else:
            yield Container(hi, len(low), values=tuple(low))


def serialize32(values: Iterable[int], runs: bool = False) -> bytes:
    """Portable bytes of 32-bit values; with ``runs``, run containers where they are smaller."""
    found = list(_containers(values, runs))
    flagged = any(c.runs for c in found)
    if flagged:
        flags = bytearray((len(found) + 7) // 8)
        for i, c in enumerate(found):
            flags[i // 8] |= bool(c.runs) << (i % 8)
        head = struct.pack("<I", COOKIE_RUNS | (len(found) - 1) << 16) + bytes(flags)
    else:
        head = struct.pack("<II", COOKIE_PLAIN, len(found))
    head += b"".join(struct.pack("<HH", c.hi, c.card - 1) for c in found)
    bodies = []
    for c in found:
        if c.runs:
            bodies.append(struct.pack(f"<H{2 * len(c.runs)}H", len(c.runs), *[x for a, b in c.runs for x in (a, b - a)]))
        else:
            bodies.append(struct.pack(f"<{len(c.words)}Q", *c.words) if c.words else struct.pack(f"<{len(c.values)}H", *c.values))
    if not flagged or len(found) >= OFFSETS_FROM:
        at = len(head) + 4 * len(found)
        for b in bodies:
            head += struct.pack("<I", at)
            at += len(b)
    return head + b"".join(bodies)


def serialize64(values: Iterable[int], runs: bool = False) -> bytes:
    buckets: dict[int, list[int]] = {}
    for v in values:
        buckets.setdefault(v >> 32, []).append(v & 0xFFFFFFFF)
    return struct.pack("<Q", len(buckets)) + b"".join(struct.pack("<I", k) + serialize32(buckets[k], runs) for k in sorted(buckets))


class RoaringBitmap:
    """A read-only set of 32- or 64-bit integers; 64-bit keys in Spark are the raw bits of a long."""

    def __init__(self, spark: SparkSession, data: bytes, bits: int = 32) -> None:
        if bits not in (32, 64):
            raise ValueError("bits must be 32 or 64")
        self.bits, self.data = bits, bytes(data)
        self.buckets = {0: parse32(self.data)[0]} if bits == 32 else parse64(self.data)
        self._index = {(b, c.hi): c for b, cs in self.buckets.items() for c in cs}
        self.table = spark.createDataFrame([c.row(b) for b, cs in self.buckets.items() for c in cs], SCHEMA)

    @property
    def cardinality(self) -> int:
        return sum(c.card for c in self._index.values())

    @property
    def empty(self) -> bool:
        return not self.cardinality

    @property
    def size_bytes(self) -> int:
        return len(self.data)

    def __contains__(self, value: int) -> bool:
        c = self._index.get((value >> 32, (value >> 16) & 0xFFFF))
        return c is not None and value & 0xFFFF in c

    def contains(self, queries: DataFrame, key: str = "key") -> DataFrame:
        return contains(self.table, queries, key)


def contains(table: DataFrame, queries: DataFrame, key: str = "key") -> DataFrame:
    """Queries with ``found``: exact membership in a container table; a null key is in none."""
    k = F.col(key).cast("long")
    placed = queries.withColumn("__bucket", F.shiftrightunsigned(k, 32)).withColumn("__hi", F.shiftright(k, 16).bitwiseAND(F.lit(0xFFFF).cast("long")).cast("int"))
    joined = placed.join(table.select(F.col("bucket").alias("__bucket"), F.col("hi").alias("__hi"), "kind", "low", "words", "runs"), ["__bucket", "__hi"], "left")
    low = F.col(key).cast("long").bitwiseAND(F.lit(0xFFFF).cast("long")).cast("int")
    bit = F.expr(f"shiftrightunsigned(get(words, cast(shiftright(cast({key} AS bigint) & 65535L, 6) AS int)), cast(cast({key} AS bigint) & 63L AS int)) & 1L")
    hit = F.when(F.col("kind") == "array", F.array_contains("low", low)).when(F.col("kind") == "bitset", bit == 1).when(F.col("kind") == "runs", F.exists("runs", lambda r: low.between(r["start"], r["end"])))
    return joined.select(*queries.columns, F.coalesce(hit, F.lit(False)).alias("found"))
