"""Input batches: explicit order, stencil predicates, sentinels, prefix sums and prefix admission."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Predicate = Callable[[Column], Column]


def is_sentinel(col: Column, sentinel: object) -> Column:
    """Bitwise equality with a reserved value: NaN equals NaN, and -0.0 is not 0.0."""
    if sentinel is None:
        return F.lit(False)
    if isinstance(sentinel, float):
        if math.isnan(sentinel):
            return F.isnan(col)
        if sentinel == 0.0:
            return col.cast("string") == F.lit("-0.0" if math.copysign(1, sentinel) < 0 else "0.0")
    return col == F.lit(sentinel)


def selected(batch: DataFrame, predicate: Predicate | None, stencil: str = "stencil") -> Column:
    """Whether the predicate admits a row's stencil; all rows without a predicate, none where it is null."""
    return F.lit(True) if predicate is None else F.coalesce(predicate(batch[stencil]), F.lit(False))


_INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def typed(batch: DataFrame, state: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``batch`` with these columns in the state's types: wider integers are the only cast made silently."""
    have, want = dict(batch.dtypes), dict(state.dtypes)
    for c in columns:
        if c in have and have[c] != want[c]:
            if have[c] not in _INTEGRAL or want[c] not in _INTEGRAL or _INTEGRAL.index(have[c]) > _INTEGRAL.index(want[c]):
                raise TypeError(f"column {c} is {have[c]} and the container's is {want[c]}")
            batch = batch.withColumn(c, F.col(c).cast(want[c]))
    return batch


def exclusive_scan(df: DataFrame, value: Column, name: str, order: str = "ord", within: tuple[str, ...] = ()) -> DataFrame:
    """Add the sum of ``value`` over all rows before this one by ``order`` (unique longs), of its group ``within`` those columns.

    Four levels of 16 bits of ``order``: each window sees at most 65,536 rows, whatever their number,
    so no task holds the whole input.  The upper three levels are scanned on their totals (one row for
    up to 65,536) and folded into one offset, so the input is shuffled once.
    """
    level = df.withColumn("__v", value.cast("long")).withColumn("__b1", F.shiftright(F.col(order), 16))
    ones = level.groupBy(*within, "__b1").agg(F.sum("__v").alias("__v")).withColumn("__b2", F.shiftright("__b1", 16))
    twos = ones.groupBy(*within, "__b2").agg(F.sum("__v").alias("__v")).withColumn("__b3", F.shiftright("__b2", 16))
    threes = twos.groupBy(*within, "__b3").agg(F.sum("__v").alias("__v"))

    def before(by: str, *parts: str) -> Column:
        frame = Window.partitionBy(*within, *parts).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("__v").over(frame), F.lit(0))

    offsets = threes.select(*within, "__b3", before("__b3").alias("__off"))  # at most 65,536 rows a group
    for rows, own, above in ((twos, "__b2", "__b3"), (ones, "__b1", "__b2")):
        scanned = rows.select(*within, own, above, before(own, above).alias("__s"))
        offsets = _matched(scanned, offsets, (*within, above)).select(*within, own, (F.col("__off") + F.col("__s")).alias("__off"))
    out = _matched(level.withColumn("__s0", before(order, "__b1")), offsets, (*within, "__b1"))
    return out.select(*df.columns, (F.col("__s0") + F.col("__off")).alias(name))


def _matched(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Inner join on equal keys, with the left names."""
    renamed = right.select(*[F.col(c).alias(f"__r{c}" if c in keys else c) for c in right.columns])
    return left.join(renamed, reduce(and_, [F.col(c) == F.col(f"__r{c}") for c in keys])).drop(*[f"__r{c}" for c in keys])


def admit_prefix(rows: DataFrame, state: DataFrame, capacity: int | None, order: str = "ord") -> DataFrame:
    """The first rows by ``order`` that fit beside ``state``; all of them without a capacity."""
    if capacity is None:
        return rows
    room = F.lit(capacity) - state.agg(F.count(F.lit(1)).alias("n")).scalar()
    return exclusive_scan(rows, F.lit(1), "__rank", order).filter(F.col("__rank") < room).drop("__rank")
