"""HyperLogLog as a sparse table of registers (idx, rank); an absent register is 0.

Adding is a grouped maximum, merging a union of tables: both are partial aggregations of at most 2**p
rows a task, whatever the input.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.hashing import xxhash64
from keyloom.operators.hll_tables import BIASES, RAW_ESTIMATES


def precision_of_kb(kb: int) -> int:
    if kb not in (8, 16, 32, 64, 128, 256):
        raise ValueError("a sketch takes a power of two from 8 to 256 KB")
    return (kb * 1024).bit_length() - 1


def precision_of_deviation(sigma: float) -> int:
    """The smallest precision whose standard deviation 1.04 / sqrt(2**p) is at most ``sigma``."""
    if sigma <= 0:
        raise ValueError("a standard deviation must be positive")
    return max(13, math.ceil(2 * math.log2(1.04 / sigma)))


def register(key: Column, p: int, seed: int = 0) -> tuple[Column, Column]:
    """(idx, rank) of a key: its hash's first p bits, and the place of the first 1 bit after them."""
    h = xxhash64(key, seed)
    tail = F.shiftleft(h, p).bitwiseOR(F.lit(1 << (p - 1)).cast("long"))
    return F.shiftrightunsigned(h, 64 - p).cast("int"), (F.lit(65) - F.length(F.bin(tail))).cast("int")


#: Up to this estimate of linear counting it is the better one, by precision.
THRESHOLDS = {13: 6500, 14: 11500, 15: 20000, 16: 50000, 17: 120000, 18: 350000}


def _bias(_spark: SparkSession, p: int, e: Column) -> Column:
    """Mean bias of the six known raw estimates nearest to ``e``, in any session; of two as near the lower goes first."""
    known = F.zip_with(F.lit(list(RAW_ESTIMATES[p])), F.lit(list(BIASES[p])), lambda r, b: F.struct(F.abs(e - r).alias("off"), r.alias("raw"), b.alias("bias")))
    return F.aggregate(F.slice(F.array_sort(known), 1, 6), F.lit(0.0), lambda acc, x: acc + x["bias"]) / F.lit(6.0)


@dataclass(frozen=True)
class HyperLogLog:
    registers: DataFrame
    p: int
    seed: int = 0

    @classmethod
    def create(cls, spark: SparkSession, p: int | None = None, kb: int | None = None, deviation: float | None = None, seed: int = 0) -> HyperLogLog:
        if sum(x is not None for x in (p, kb, deviation)) != 1:
            raise ValueError("give one of p, kb and deviation")
        p = p if p is not None else precision_of_kb(kb) if kb is not None else precision_of_deviation(deviation)
        if not 13 <= p <= 18:
            raise ValueError("the precision must be from 13 to 18")
        return cls(spark.createDataFrame([], "idx int, rank int"), p, seed)

    @property
    def sketch_kb(self) -> int:
        return (1 << self.p) // 1024

    def add(self, batch: DataFrame, key: str = "key") -> HyperLogLog:
        idx, rank = register(F.col(key), self.p, self.seed)
        new = batch.filter(F.col(key).isNotNull()).select(idx.alias("idx"), rank.alias("rank"))
        return replace(self, registers=self.registers.union(new).groupBy("idx").agg(F.max("rank").alias("rank")))

    def merge(self, other: HyperLogLog) -> HyperLogLog:
        if (self.p, self.seed) != (other.p, other.seed):
            raise ValueError("sketches of different precision or seed do not merge")
        return replace(self, registers=self.registers.union(other.registers).groupBy("idx").agg(F.max("rank").alias("rank")))

    def statistics(self) -> DataFrame:
        """One row: z, the sum of 2**-rank over all registers, and the number of zeros."""
        m = 1 << self.p
        held = self.registers.agg(F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rank"))), F.lit(0.0)).alias("s"), F.count(F.lit(1)).alias("n"))
        return held.select((F.col("s") + (F.lit(m) - F.col("n"))).alias("z"), (F.lit(m) - F.col("n")).alias("zeros"))

    def estimate(self) -> int:
        """The number of distinct keys: ``estimate_df`` as a number."""
        return self.estimate_df().first()[0]

    def estimate_df(self) -> DataFrame:
        """One row, lazily: linear counting up to 2.5 m and up to the precision's threshold, else the raw estimate less its bias."""
        m = float(1 << self.p)
        row = self.statistics().withColumn("e", F.lit(0.7213 / (1 + 1.079 / m) * m * m) / F.col("z"))
        row = row.withColumn("h", F.when(F.col("zeros") > 0, F.lit(m) * F.log(F.lit(m) / F.col("zeros"))))
        linear = F.col("h").isNotNull() & ((F.col("e") <= 2.5 * m) | (F.col("h") <= THRESHOLDS[self.p]))
        corrected = F.when(F.col("e") < 5.0 * m, F.col("e") - _bias(self.registers.sparkSession, self.p, F.col("e"))).otherwise(F.col("e"))
        return row.select(F.round(F.when(linear, F.col("h")).otherwise(corrected)).cast("long").alias("estimate"))

    def clear(self) -> HyperLogLog:
        return replace(self, registers=self.registers.limit(0))
