"""Sectorized Bloom filters as a sparse table of blocks (block, w0 ... wk); an absent block is 0."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.hashing import M32, mul32, xxhash64
from keyloom.operators.batch import Predicate, selected

# The salts of the split-block filter family; results depend on them.
SALTS = (
    0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31,
    0xB24BCDFF, 0xB6843D6D, 0x6DB04543, 0x3A12EFDD, 0xB0DDD463, 0x8D22F6E7, 0xB82F1E53, 0x7DB9F86B,
    0xC7AFE639, 0xFB135CD7, 0x693256E1, 0x9466D871, 0x23D3D02F, 0x6461D049, 0x66A91621, 0xBAA3006F,
    0x52FB8D99, 0x3EA88B4F, 0x0F470CFD, 0xB1DB79A5, 0x9809FCD1, 0xBCED4445, 0x2EB7C737, 0x2CEA6803,
    0x156F1955, 0x8813C027, 0xA26819F9, 0x4C3B57BD, 0x7DF94487, 0xB975E769, 0xB8F20CB5, 0x5C9E2E77,
    0x5FB1735F, 0x3A6F759B, 0x3C090923, 0xFCED424D, 0xA187A6A9, 0x6F070A41, 0x2C85233B, 0x7E62258B,
    0x2771EF17, 0x13BBF093, 0x4FF059E5, 0xE3CE3D0F, 0xF1B4789F, 0x9FBB6173, 0x6A320CF5, 0x1BE2C481,
    0x7BA8222B, 0x6FD619B3, 0x7B1BBF0D, 0x8B8993AD, 0x448ECA95, 0x82AB09D9, 0x2CE53909, 0x4F548685,
)


@dataclass(frozen=True)
class Policy:
    """A block of ``words`` 32-bit words, ``bits`` of them set by a key in all, and the hash's seed.

    Keys are hashed as ``key_type`` (int or bigint); for float keys pass their int bits, so that -0.0
    and 0.0 stay different (``float_bits``).
    """

    words: int = 8
    bits: int = 8
    seed: int = 0
    key_type: str = "bigint"

    def __post_init__(self) -> None:
        if self.words < 1 or self.words & (self.words - 1) or self.words > 32:
            raise ValueError("words must be a power of two up to 32")
        if self.bits % self.words or not self.words <= self.bits <= min(64, 32 * self.words):
            raise ValueError("bits must be a multiple of words and at most 64")

    def place(self, key: Column, blocks: int) -> list[Column]:
        """The block of a key and its pattern in each word."""
        h = xxhash64(key.cast(self.key_type), self.seed)
        low = h.bitwiseAND(F.lit(M32).cast("long"))
        block = F.shiftright(F.shiftrightunsigned(h, 32) * F.lit(blocks).cast("long"), 32)
        per = self.bits // self.words
        ones = F.array(*[F.lit(1 << b).cast("long") for b in range(32)])
        pattern = [reduce(lambda a, b: a.bitwiseOR(b), [F.element_at(ones, (F.shiftright(mul32(low, SALTS[w * per + b]), 27) + 1).cast("int")) for b in range(per)]) for w in range(self.words)]
        return [block.alias("block"), *[x.alias(f"w{w}") for w, x in enumerate(pattern)]]


def add_word(word: Column, pattern: Column) -> Column:
    """A word with a key's pattern set: what one key does to one word."""
    return word.bitwiseOR(pattern)


def contains_word(word: Column, pattern: Column) -> Column:
    """Whether a word holds all of a key's pattern."""
    return word.bitwiseAND(pattern) == pattern


def float_bits(col: Column) -> Column:
    """The 32 bits of a float column as an int."""
    import pandas as pd

    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(s.to_numpy().astype("<f4").view("<i4"))

    return run(col.cast("float"))


DEFAULT = Policy()
#: 256-bit blocks, one bit in each of eight words.
ARROW = Policy(8, 8)


@dataclass(frozen=True)
class BloomFilter:
    table: DataFrame
    blocks: int
    policy: Policy = field(default_factory=Policy)

    @classmethod
    def create(cls, spark: SparkSession, blocks: int, policy: Policy = DEFAULT) -> BloomFilter:
        if blocks < 1:
            raise ValueError("a filter needs a block")
        if blocks >= 1 << 31:
            raise OverflowError("block numbers of 2**31 and more overflow a long product")
        words = ", ".join(f"w{w} long" for w in range(policy.words))
        return cls(spark.createDataFrame([], f"block long, {words}"), blocks, policy)

    @property
    def num_words(self) -> int:
        return self.blocks * self.policy.words

    @property
    def size_bytes(self) -> int:
        return 4 * self.num_words

    def _names(self) -> list[str]:
        return [f"w{w}" for w in range(self.policy.words)]

    def _compatible(self, other: BloomFilter) -> None:
        if (self.blocks, self.policy) != (other.blocks, other.policy):
            raise ValueError("filters of different size or policy")

    def add(self, batch: DataFrame, predicate: Predicate | None = None, key: str = "key") -> BloomFilter:
        rows = batch.filter(selected(batch, predicate) & F.col(key).isNotNull()).select(*self.policy.place(F.col(key), self.blocks))
        return self._merged(rows)

    def _merged(self, rows: DataFrame) -> BloomFilter:
        return replace(self, table=self.table.union(rows).groupBy("block").agg(*[F.bit_or(w).alias(w) for w in self._names()]))

    def contains(self, queries: DataFrame, predicate: Predicate | None = None, key: str = "key") -> DataFrame:
        """Queries with ``found``: true for every added key, rarely for another; false if not selected."""
        placed = queries.select("*", *[c.alias(f"__q{i}") for i, c in enumerate(self.policy.place(F.col(key), self.blocks))])
        joined = placed.join(self.table.withColumnRenamed("block", "__block"), F.col("__q0") == F.col("__block"), "left")
        hit = reduce(and_, [contains_word(F.col(w), F.col(f"__q{i + 1}")) for i, w in enumerate(self._names())])
        return joined.select(*queries.columns, F.coalesce(hit & selected(queries, predicate), F.lit(False)).alias("found"))

    def merge(self, other: BloomFilter) -> BloomFilter:
        self._compatible(other)
        return self._merged(other.table)

    def intersect(self, other: BloomFilter) -> BloomFilter:
        """Blockwise AND: holds every key of both, and may hold more than an intersection's filter."""
        self._compatible(other)
        right = other.table.select(F.col("block"), *[F.col(w).alias(f"r_{w}") for w in self._names()])
        return replace(self, table=self.table.join(right, "block").select("block", *[F.col(w).bitwiseAND(F.col(f"r_{w}")).alias(w) for w in self._names()]))

    def clear(self) -> BloomFilter:
        return replace(self, table=self.table.limit(0))
