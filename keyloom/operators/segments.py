"""Segmented maps: state as a log of segments, oldest first, and the column steps of reading one.

A key may stand in several segments; the newest holds its value, and a row with ``deleted`` hides
what is below.  One aggregation over the union reads any number of segments; compaction writes it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.operators.batch import is_sentinel


def merge_find(first: Column, second: Column, empty: Any) -> Column:
    """The first of two lookups that hit; a NaN ``empty`` counts as a miss like any other."""
    return F.when(~is_sentinel(first, empty), first).otherwise(second)


def merge_contains(first: Column, second: Column) -> Column:
    return first | second


def extract_keys(rows: DataFrame) -> DataFrame:
    return rows.select("key")


def count_zero(rows: DataFrame, mask: str) -> DataFrame:
    """One row: how many masks are 0."""
    return rows.agg(F.count_if(F.col(mask) == 0).alias("zeros"))


def mask_is_zero(mask: Column) -> Column:
    return mask == 0


def mask_non_zero(mask: Column) -> Column:
    return mask != 0


@dataclass(frozen=True)
class SegmentedMap:
    """Segments are DataFrames (key, value, deleted)."""

    segments: tuple[DataFrame, ...]
    empty_value: Any

    def append(self, batch: DataFrame) -> SegmentedMap:
        """One more segment from ``batch(ord, key, value)``: the last of a key.  No join with what is there."""
        new = batch.groupBy("key").agg(F.max_by("value", "ord").alias("value")).withColumn("deleted", F.lit(False))
        return replace(self, segments=(*self.segments, new))

    def erase(self, batch: DataFrame) -> SegmentedMap:
        kind = dict(self.segments[0].dtypes)["value"]
        return replace(self, segments=(*self.segments, batch.select("key").distinct().select("key", F.lit(None).cast(kind).alias("value"), F.lit(True).alias("deleted"))))

    def to_df(self) -> DataFrame:
        """(key, value) of what is alive: one partial aggregation over all segments."""
        parts = [s.select("key", "value", "deleted", F.lit(i).alias("version")) for i, s in enumerate(self.segments)]
        newest = reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.max_by(F.struct("value", "deleted"), "version").alias("s"))
        return newest.filter("NOT s.deleted").select("key", "s.value")

    def compact(self) -> SegmentedMap:
        return replace(self, segments=(self.to_df().withColumn("deleted", F.lit(False)),))

    def find(self, queries: DataFrame) -> DataFrame:
        found = queries.join(self.to_df().withColumnRenamed("value", "__value"), "key", "left")
        return found.select(*queries.columns, F.coalesce("__value", F.lit(self.empty_value)).alias("found_value"))

    def contains(self, queries: DataFrame) -> DataFrame:
        found = queries.join(self.to_df().select("key", F.lit(True).alias("__hit")), "key", "left")
        return found.select(*queries.columns, F.coalesce("__hit", F.lit(False)).alias("found"))
