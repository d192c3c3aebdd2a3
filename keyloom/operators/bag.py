"""Bags: multisets of keys and multimaps of (key, value) rows, with ordered retrieval."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.operators.batch import Predicate, admit_prefix, exclusive_scan, is_sentinel, selected, typed
from keyloom.operators.keyed import CHAIN, Outcome
from keyloom.sources.snapshots import snapshot


def _checked(capacity: int | None) -> None:
    if capacity is not None and capacity < 1:
        raise ValueError("capacity must be positive")


def _fits(rows: DataFrame, limit: int | None) -> DataFrame:
    """``rows``, or an error before any is returned if there are more than ``limit``."""
    if limit is not None and (n := rows.limit(limit + 1).count()) > limit:
        raise OverflowError(f"{n} or more rows do not fit in an output of {limit}")
    return rows


#: Copies of a row made at once when it is expanded.
CHUNK = 1 << 16


def _expanded(rows: DataFrame, n: str, name: str) -> DataFrame:
    """Each row ``n`` times, numbered from 0; in chunks, so that no array is longer than ``CHUNK``, whatever ``n``."""
    chunks = rows.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / CHUNK))))
    last = F.least(F.lit(CHUNK - 1).cast("long"), F.col(n) - 1 - F.col("__chunk") * CHUNK)
    return chunks.withColumn(name, F.explode(F.sequence(F.col("__chunk") * CHUNK, F.col("__chunk") * CHUNK + last))).drop("__chunk")


@dataclass(frozen=True)
class Multiset:
    """Keys with multiplicities.  ``state`` has key and seq, the order of admission."""

    state: DataFrame
    empty_key: Any
    capacity: int | None = None
    #: Inserts since the state was last written.
    depth: int = 0

    @classmethod
    def create(cls, spark: SparkSession, key_type: str, empty_key: Any, capacity: int | None = None) -> Multiset:
        _checked(capacity)
        return cls(spark.createDataFrame([], f"key {key_type}, seq long"), empty_key, capacity)

    def insert(self, batch: DataFrame, predicate: Predicate | None = None) -> Outcome:
        """Admit the earliest valid rows up to the capacity, repeats included.  ``failed``: sentinels and overflow.

        An insert refers to the state for its size too, so every third of a chain writes it first.
        """
        self = self.snapshot() if self.depth >= 2 else self
        rows = typed(batch.filter(selected(batch, predicate)), self.state, ("key",))
        new = admit_prefix(rows.filter(~(F.col("key").isNull() | is_sentinel(F.col("key"), self.empty_key))), self.state, self.capacity)
        counts = rows.agg(F.count(F.lit(1)).alias("n")).join(new.agg(F.count(F.lit(1)).alias("inserted")), F.lit(True)).select("inserted", (F.col("n") - F.col("inserted")).alias("failed"))
        size = F.coalesce(self.state.agg((F.max("seq") + 1).alias("n")).scalar(), F.lit(0))
        placed = exclusive_scan(new, F.lit(1), "__at").select("key", (F.col("__at") + size).alias("seq"))
        return Outcome(replace(self, state=self.state.unionByName(placed), depth=self.depth + 1), counts)

    def snapshot(self) -> Multiset:
        """The same bag over its state as written: later plans begin there."""
        return replace(self, state=snapshot(self.state), depth=0)

    def _counts(self, canonical: Callable[[Column], Column] | None = None) -> DataFrame:
        key = canonical(F.col("key")) if canonical else F.col("key")
        return self.state.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("__n"))

    def contains(self, queries: DataFrame, predicate: Predicate | None = None) -> DataFrame:
        found = queries.join(self._counts(), "key", "left")
        return found.select(*queries.columns, F.coalesce(F.col("__n").isNotNull() & selected(queries, predicate), F.lit(False)).alias("found"))

    def find(self, queries: DataFrame, predicate: Predicate | None = None) -> DataFrame:
        found = queries.join(self._counts(), "key", "left")
        hit = F.col("__n").isNotNull() & selected(queries, predicate)
        return found.select(*queries.columns, F.when(hit, F.col("key")).otherwise(F.lit(self.empty_key)).alias("found"))

    def count_each(self, queries: DataFrame, predicate: Predicate | None = None, outer: bool = False, equal: Callable[[Column], Column] | None = None) -> DataFrame:
        """Queries with their key's multiplicity, 0 if absent or not selected; ``outer``: at least 1, as a left join yields.

        With ``equal``, keys are equal where that expression of them is: it must be an equivalence.
        """
        asked = queries.withColumn("__k", equal(F.col("key")) if equal else F.col("key"))
        found = asked.join(self._counts(equal).withColumnRenamed("key", "__h"), F.col("__k") == F.col("__h"), "left")
        n = F.when(selected(queries, predicate), F.coalesce("__n", F.lit(0))).otherwise(F.lit(0))
        return found.select(*[queries[c] for c in queries.columns], (F.greatest(n, F.lit(1)) if outer else n).cast("long").alias("multiplicity"))

    def count(self, queries: DataFrame) -> DataFrame:
        """One row: the rows of the inner join, repeated queries counted.  Aggregated before joining: nothing is expanded."""
        asked = queries.groupBy("key").agg(F.count(F.lit(1)).alias("__q"))
        return asked.join(self._counts(), "key").agg(F.coalesce(F.sum(F.col("__q") * F.col("__n")), F.lit(0)).alias("total"))

    def retrieve(self, queries: DataFrame, limit: int | None = None) -> DataFrame:
        """Inner-join rows with ``pos`` in query order; an error instead if there are more than ``limit``."""
        hits = queries.join(self._counts(), "key")
        placed = exclusive_scan(hits, F.col("__n"), "__at")
        rows = _expanded(placed.select("key", "__at", "__n"), "__n", "__k")
        return _fits(rows.select((F.col("__at") + F.col("__k")).alias("pos"), F.col("key").alias("probe"), F.col("key").alias("match")), limit)

    def retrieve_all(self, limit: int | None = None) -> DataFrame:
        """All keys with ``pos``, their order of admission."""
        return _fits(self.state.select(F.col("seq").alias("pos"), "key"), limit)

    def size(self) -> int:
        return self.state.count()

    def clear(self) -> Multiset:
        return replace(self, state=self.state.sparkSession.createDataFrame([], self.state.schema), depth=0)


@dataclass(frozen=True)
class Multimap:
    """Rows (key, value) with repeats: the build side of an equi-join."""

    state: DataFrame
    empty_key: Any
    empty_value: Any
    capacity: int | None = None
    #: Inserts since the state was last written.
    depth: int = 0

    @classmethod
    def create(cls, spark: SparkSession, key_type: str, value_type: str, empty_key: Any, empty_value: Any, capacity: int | None = None) -> Multimap:
        _checked(capacity)
        return cls(spark.createDataFrame([], f"key {key_type}, value {value_type}"), empty_key, empty_value, capacity)

    def _reserved(self) -> Column:
        key, value = F.col("key"), F.col("value")
        return key.isNull() | value.isNull() | is_sentinel(key, self.empty_key) | is_sentinel(value, self.empty_value)

    def insert(self, batch: DataFrame, predicate: Predicate | None = None, check: bool = True) -> Outcome:
        """Admit the prefix of the selected rows that fits; ``failed`` counts the rest.

        A reserved key or value among them is an error, and then nothing is inserted.  ``check=False``
        leaves that to the plan: the error comes when the result is computed, without a job here.  A
        long chain of inserts writes the state first.
        """
        self = self.snapshot() if self.depth >= (CHAIN if self.capacity is None else 2) else self
        rows = typed(batch.filter(selected(batch, predicate)), self.state, ("key", "value"))
        if check:
            if rows.filter(self._reserved()).limit(1).count():
                raise ValueError("a selected row holds a reserved key or value")
        else:
            rows = rows.withColumn("key", F.when(self._reserved(), F.raise_error(F.lit("a selected row holds a reserved key or value")).cast(dict(rows.dtypes)["key"])).otherwise(F.col("key")))
        new = admit_prefix(rows, self.state, self.capacity).select("key", "value")
        counts = rows.agg(F.count(F.lit(1)).alias("n")).join(new.agg(F.count(F.lit(1)).alias("inserted")), F.lit(True)).select("inserted", (F.col("n") - F.col("inserted")).alias("failed"))
        return Outcome(replace(self, state=self.state.unionByName(new), depth=self.depth + 1), counts)

    def snapshot(self) -> Multimap:
        """The same rows as written: later plans begin there."""
        return replace(self, state=snapshot(self.state), depth=0)

    def contains(self, queries: DataFrame, predicate: Predicate | None = None) -> DataFrame:
        found = queries.join(self.state.select("key").distinct().withColumn("__hit", F.lit(True)), "key", "left")
        return found.select(*queries.columns, F.coalesce(F.col("__hit") & selected(queries, predicate), F.lit(False)).alias("found"))

    def find(self, queries: DataFrame, predicate: Predicate | None = None) -> DataFrame:
        """Queries with the least value of their key, or the empty value."""
        least = self.state.groupBy("key").agg(F.min("value").alias("__value"))
        found = queries.join(least, "key", "left")
        return found.select(*queries.columns, F.coalesce(F.when(selected(queries, predicate), F.col("__value")), F.lit(self.empty_value)).alias("found_value"))

    def count(self, queries: DataFrame) -> DataFrame:
        """One row: the rows of the inner join, from per-key counts of both sides."""
        asked = queries.groupBy("key").agg(F.count(F.lit(1)).alias("__q"))
        held = self.state.groupBy("key").agg(F.count(F.lit(1)).alias("__n"))
        return asked.join(held, "key").agg(F.coalesce(F.sum(F.col("__q") * F.col("__n")), F.lit(0)).alias("total"))

    def retrieve(self, queries: DataFrame, limit: int | None = None) -> DataFrame:
        """Inner-join rows with ``pos``: query order, values ascending within a query."""
        held = self.state.groupBy("key").agg(F.count(F.lit(1)).alias("__n"))
        starts = exclusive_scan(queries.join(held, "key"), F.col("__n"), "__at").select("ord", "key", "__at")
        # ranks of the values within a key: those of a (key, value) are alike, so a run expands at its first rank
        runs = self.state.groupBy("key", "value").agg(F.count(F.lit(1)).alias("__c"))
        if dict(self.state.dtypes)["value"] in ("tinyint", "smallint", "int", "bigint"):
            runs = exclusive_scan(runs.withColumn("__o", F.col("value").cast("long")), F.col("__c"), "__r", "__o", ("key",))
        else:  # no bits to scan by: one task sorts the different values of a key
            before = Window.partitionBy("key").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
            runs = runs.withColumn("__r", F.coalesce(F.sum("__c").over(before), F.lit(0)))
        rows = _expanded(starts.join(runs, "key"), "__c", "__k")
        return _fits(rows.select((F.col("__at") + F.col("__r") + F.col("__k")).alias("pos"), F.col("key").alias("probe"), "value"), limit)

    def retrieve_all(self, limit: int | None = None) -> DataFrame:
        """All rows, in no order."""
        return _fits(self.state.select("key", "value"), limit)

    def size(self) -> int:
        return self.state.count()

    def clear(self) -> Multimap:
        return replace(self, state=self.state.sparkSession.createDataFrame([], self.state.schema), depth=0)
