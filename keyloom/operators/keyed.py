"""Keyed relations: sets, maps and growing maps as immutable DataFrames.

A container is a relation (key[, value]) with unique keys; each operation is a pure function of it and
a batch.  Batches have ``ord`` (unique long: the input's order), ``key``, for maps ``value``, and for
the conditional forms ``stencil``.  Of equal keys the first by ``ord`` wins an insert and the last an
upsert.  Operations are lazy, and the scalar properties of an ``Outcome`` run a job; each refers to the
state once, so a chain's plan grows by one aggregation a batch.  An operation that would make the
chain longer than ``CHAIN`` (or stand on one that a capacity cuts, which refers to the state more
often) writes the state first; ``snapshot`` does so at will.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import capacity as slots
from keyloom.operators.batch import Predicate, admit_prefix, is_sentinel, selected, typed
from keyloom.sources.snapshots import snapshot

#: Operations that may stand on one another before the state is written: each refers to the state once.
CHAIN = 16


@dataclass(frozen=True)
class Outcome:
    """What an operation made: the new container, its counts (one lazy row), and rows if it returns any."""

    container: Any
    counts: DataFrame
    rows: DataFrame | None = None

    def __getattr__(self, name: str) -> int:
        if name.startswith("_") or name not in self.counts.columns:
            raise AttributeError(name)
        return self.counts.first()[name]


@dataclass(frozen=True)
class StaticSet:
    """Distinct keys, at most ``capacity`` of them if one is given."""

    state: DataFrame
    empty_key: Any
    capacity_asked: int | None = None
    erased_key: Any = None
    bucket_size: int = 1
    probing: str = "double"
    #: Custom equality: keys are equal where this expression of them is.  It must be an equivalence.
    canonical: Callable[[Column], Column] | None = None
    #: Operations since the state was last written.
    depth: int = 0

    values = ()

    @classmethod
    def create(cls, spark: SparkSession, key_type: str, empty_key: Any, capacity: int | None = None, **more: Any) -> StaticSet:
        return cls(spark.createDataFrame([], f"key {key_type}"), empty_key, capacity, **more)

    # -- metadata
    def with_erased_key(self, key: Any) -> Any:
        """Reserve a second key, which inserts then refuse like the empty one; deletion itself needs no mark."""
        if key == self.empty_key:
            raise ValueError("the empty and the erased key must differ")
        return replace(self, erased_key=key)

    def key_equal(self, a: Column, b: Column) -> Column:
        """Whether two keys are one key here."""
        return self.canonical(a) == self.canonical(b) if self.canonical else a == b

    def _own(self, df: DataFrame) -> DataFrame:
        """``df`` with its keys in canonical form; the containers hold that form."""
        return df.withColumn("key", F.when(self._valid(), self.canonical(F.col("key"))).otherwise(F.col("key"))) if self.canonical else df

    @property
    def capacity(self) -> int | None:
        return None if self.capacity_asked is None else slots.rounded(self.capacity_asked, self.bucket_size, self.probing)

    def to_df(self) -> DataFrame:
        return self.state

    def size(self) -> int:
        return self.state.count()

    def clear(self) -> StaticSet:
        return replace(self, state=self.state.sparkSession.createDataFrame([], self.state.schema), depth=0)

    # -- parts
    def _valid(self) -> Column:
        key = F.col("key")
        return ~(key.isNull() | is_sentinel(key, self.empty_key) | is_sentinel(key, self.erased_key))

    def _typed(self, batch: DataFrame) -> DataFrame:
        return typed(batch, self.state, ("key", *self.values))

    def _taken(self, batch: DataFrame, predicate: Predicate | None) -> DataFrame:
        return self._own(self._typed(batch.filter(selected(batch, predicate)) if predicate else batch))

    def snapshot(self) -> Any:
        """The same container over its state as written: later plans begin there."""
        return replace(self, state=snapshot(self.state), depth=0)

    def _base(self) -> Any:
        """This container, written first if the chain under it is long."""
        return self.snapshot() if self.depth >= (CHAIN if self.capacity is None else 1) else self

    def _with(self, state: DataFrame) -> Any:
        return replace(self, state=state.select(*self.state.columns), depth=self.depth + 1)

    # -- updates
    def _merged(self, rows: DataFrame, last: bool = False) -> DataFrame:
        """State and batch by key in one aggregation: key, values, ``ord`` (the first batch row's), ``__old``, ``__n`` batch rows.

        The value is the stored one, else that of the first batch row; with ``last``, of the last batch
        row if there is one.  Rows that no container takes are counted under a null key.
        """
        stored = self.state.select("key", *self.values, F.lit(None).cast("long").alias("ord"), F.lit(True).alias("__old"))
        fresh = rows.select(F.when(self._valid(), F.col("key")).alias("key"), *self.values, F.col("ord").cast("long").alias("ord"), F.lit(False).alias("__old"))
        old = [F.max(F.when(F.col("__old"), F.col(v))).alias(f"__old_{v}") for v in self.values]
        new = [(F.max_by if last else F.min_by)(F.when(~F.col("__old"), F.col(v)), "ord").alias(f"__new_{v}") for v in self.values]
        both = stored.unionByName(fresh).groupBy("key").agg(*old, *new, F.min("ord").alias("ord"), F.max("__old").alias("__old"), F.count_if(~F.col("__old")).alias("__n"))
        keep = (F.col("__n") == 0) if last else F.col("__old")
        return both.select("key", *[F.when(keep, F.col(f"__old_{v}")).otherwise(F.col(f"__new_{v}")).alias(v) for v in self.values], "ord", "__old", "__n")

    def _fitting(self, merged: DataFrame) -> DataFrame:
        """Merged rows without the null key and, of new keys, those that fit."""
        held = merged.filter("key IS NOT NULL")
        if self.capacity is None:
            return held
        return held.filter("__old").unionByName(admit_prefix(held.filter("NOT __old"), held.filter("__old"), self.capacity))

    def _counts(self, merged: DataFrame, fitting: DataFrame) -> DataFrame:
        """One row: the batch's rows, keys inserted, rows whose key is stored.  One pass where nothing overflows."""
        n, new = F.coalesce(F.sum("__n"), F.lit(0)), F.count_if(F.col("key").isNotNull() & ~F.col("__old"))
        stored = F.coalesce(F.sum(F.when(F.col("key").isNotNull(), F.col("__n"))), F.lit(0))
        if self.capacity is None:
            return merged.agg(n.alias("n"), new.alias("inserted"), stored.alias("stored"))
        return merged.agg(n.alias("n")).join(F.broadcast(fitting.agg(new.alias("inserted"), stored.alias("stored"))))  # one row each

    def insert(self, batch: DataFrame, predicate: Predicate | None = None) -> Outcome:
        """Insert if absent.  ``failed`` counts sentinels, keys present or repeated, and overflow; rows not selected are no failures."""
        self = self._base()
        merged = self._merged(self._taken(batch, predicate))
        fitting = self._fitting(merged)
        counts = self._counts(merged, fitting).select("inserted", (F.col("n") - F.col("inserted")).alias("failed"))
        return Outcome(self._with(fitting), counts)

    def insert_async(self, batch: DataFrame, predicate: Predicate | None = None) -> Any:
        self = self._base()
        return self._with(self._fitting(self._merged(self._taken(batch, predicate))))

    def insert_and_find(self, batch: DataFrame) -> Outcome:
        """Each row with the stored key (value, for maps) and whether this row inserted it; sentinel and overflow: empty, false."""
        self = self._base()
        batch = self._own(self._typed(batch))
        merged = self._merged(batch)
        fitting = self._fitting(merged)
        shown = self.values or ("key",)
        stored = fitting.select("key", F.when(~F.col("__old"), F.col("ord")).alias("__ord"), *[F.col(v).alias(f"__{v}") for v in shown])
        rows = batch.join(stored, "key", "left")
        found = [F.coalesce(f"__{v}", F.lit(e)).alias("found" if v == "key" else f"found_{v}") for v, e in zip(shown, self._empties(), strict=True)]
        inserted = F.coalesce(F.col("ord") == F.col("__ord"), F.lit(False)).alias("inserted")
        return Outcome(self._with(fitting), self._counts(merged, fitting).select("inserted"), rows.select(*batch.columns, *found, inserted))

    def erase(self, batch: DataFrame) -> Outcome:
        """Delete keys.  ``failed`` counts rows beyond the distinct keys deleted; a repeated key succeeds once."""
        self = self._base()
        batch = self._own(self._typed(batch))
        asked = batch.groupBy("key").agg(F.count(F.lit(1)).alias("__n"))
        hits = asked.join(self.state.select("key", F.lit(1).alias("__hit")), "key", "left")
        counts = hits.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n"), F.count("__hit").alias("deleted")).select("deleted", (F.col("n") - F.col("deleted")).alias("failed"))
        return Outcome(self.erase_async(batch), counts)

    def erase_async(self, batch: DataFrame) -> Any:
        self = self._base()
        return self._with(self.state.join(self._own(self._typed(batch)).select("key"), "key", "left_anti"))

    # -- queries
    def _empties(self) -> tuple:
        return (self.empty_key,)

    def find(self, queries: DataFrame, predicate: Predicate | None = None) -> DataFrame:
        """Queries with the stored key (value, for maps), or the empty one for a miss or a row not selected."""
        queries = self._own(queries)
        shown = self.values or ("key",)
        stored = self.state.select("key", *[F.col(v).alias(f"__{v}") for v in shown])
        found = queries.join(stored, "key", "left")
        ok = selected(queries, predicate)
        return found.select(*queries.columns, *[F.coalesce(F.when(ok, F.col(f"__{v}")), F.lit(e)).alias("found" if v == "key" else f"found_{v}") for v, e in zip(shown, self._empties(), strict=True)])

    def contains(self, queries: DataFrame, predicate: Predicate | None = None) -> DataFrame:
        queries = self._own(queries)
        found = queries.join(self.state.select("key", F.lit(True).alias("__hit")), "key", "left")
        return found.select(*queries.columns, F.coalesce(F.col("__hit") & selected(queries, predicate), F.lit(False)).alias("found"))

    def count(self, queries: DataFrame) -> DataFrame:
        """One row: the query rows that hit, repeats counted."""
        return self._own(queries).join(self.state.select("key"), "key", "left_semi").agg(F.count(F.lit(1)).alias("hits"))

    def for_each(self, queries: DataFrame, *aggregates: Column) -> DataFrame:
        """Aggregates over the matching (query, slot) rows; without any, those rows."""
        rows = self._own(queries).select("ord", "key").join(self.state, "key")
        return rows.agg(*aggregates) if aggregates else rows


@dataclass(frozen=True)
class StaticMap(StaticSet):
    """Unique keys with a value each."""

    empty_value: Any = -1
    probing: str = "linear"

    values = ("value",)

    @classmethod
    def create(cls, spark: SparkSession, key_type: str, value_type: str, empty_key: Any, empty_value: Any, capacity: int | None = None, **more: Any) -> Any:
        return cls(spark.createDataFrame([], f"key {key_type}, value {value_type}"), empty_key, capacity, empty_value=empty_value, **more)

    def _empties(self) -> tuple:
        return (self.empty_value,)

    def insert_or_assign(self, batch: DataFrame) -> Outcome:
        """Upsert: the last row of a key wins.  ``failed``: sentinels and overflow; ``assigned``: rows that hit a key already there."""
        self = self._base()
        merged = self._merged(self._taken(batch, None), last=True)
        fitting = self._fitting(merged)
        counts = self._counts(merged, fitting)
        counts = counts.select("inserted", (F.col("stored") - F.col("inserted")).alias("assigned"), (F.col("n") - F.col("stored")).alias("failed"))
        return Outcome(self._with(fitting), counts)

    def insert_or_assign_async(self, batch: DataFrame) -> Any:
        self = self._base()
        return self._with(self._fitting(self._merged(self._taken(batch, None), last=True)))

    def assign(self, batch: DataFrame, predicate: Predicate | None = None) -> Any:
        """Update values of keys that are there; never inserts."""
        self = self._base()
        merged = self._merged(self._taken(batch, predicate), last=True)
        return self._with(merged.filter("key IS NOT NULL AND __old"))


@dataclass(frozen=True)
class DynamicMap(StaticMap):
    """A map that grows: no overflow.  Counts report successes.

    ``growth`` follows the segments that an engine with fixed-size tables would open for the same
    batches; here they are a number alone.  Counts that it needs stay lazy until it is asked.
    """

    grown: slots.Growth = field(default_factory=lambda: slots.Growth.of(1024))
    #: Batches since then: (one-row counts with n, inserted and deleted, how the next segment is prepared).
    pending: tuple[tuple[DataFrame, str], ...] = ()

    @classmethod
    def create(cls, spark: SparkSession, key_type: str, value_type: str, empty_key: Any, empty_value: Any, initial: int = 1024, erased_key: Any = None) -> DynamicMap:
        if erased_key is not None and erased_key == empty_key:
            raise ValueError("the empty and the erased key must differ")
        return cls(spark.createDataFrame([], f"key {key_type}, value {value_type}"), empty_key, None, erased_key, empty_value=empty_value, grown=slots.Growth.of(initial))

    @property
    def capacity(self) -> None:
        return None

    @property
    def growth(self) -> slots.Growth:
        """Segments and the rows in each, from the counts of all batches so far (a job for those not counted yet)."""
        now = self.grown
        for counts, prepares in self.pending:
            row = counts.first()
            now = now.erased(row["deleted"]) if row["deleted"] else now.after(row["n"], row["inserted"], prepares)
        return now

    @property
    def segments(self) -> tuple[int, ...]:
        return self.growth.segments

    @property
    def total_capacity(self) -> int:
        return sum(self.segments)

    @property
    def num_segments(self) -> int:
        return len(self.segments)

    def settled(self) -> DynamicMap:
        """The same map with its growth counted."""
        return replace(self, grown=self.growth, pending=())

    def snapshot(self) -> DynamicMap:
        return replace(super().snapshot(), grown=self.growth, pending=())

    def _and(self, container: DynamicMap, n: Column, inserted: Column, deleted: Column, counts: DataFrame, prepares: str = "spread") -> DynamicMap:
        one = counts.select(n.cast("long").alias("n"), inserted.cast("long").alias("inserted"), deleted.cast("long").alias("deleted"))
        return replace(container, pending=(*container.pending, (one, prepares)))

    def reserve(self, n: int) -> DynamicMap:
        """Open segments until they take ``n`` rows; an empty first segment is no obstacle."""
        return replace(self, grown=self.growth.reserved(n), pending=())

    def insert(self, batch: DataFrame, predicate: Predicate | None = None) -> Outcome:
        out = super().insert(batch, predicate)
        n = F.col("inserted") + F.col("failed")
        return replace(out, container=self._and(out.container, n, F.col("inserted"), F.lit(0), out.counts))

    def insert_async(self, batch: DataFrame, predicate: Predicate | None = None) -> DynamicMap:
        """As ``insert``; its growth counts every row of the batch as new."""
        rows = batch.filter(selected(batch, predicate)) if predicate else batch
        counts = rows.agg(F.count(F.lit(1)).alias("n"))
        return self._and(super().insert_async(batch, predicate), F.col("n"), F.col("n"), F.lit(0), counts, "always")

    def insert_or_assign(self, batch: DataFrame) -> Outcome:
        out = super().insert_or_assign(batch)
        n = F.col("inserted") + F.col("assigned") + F.col("failed")
        return replace(out, container=self._and(out.container, n, F.col("inserted"), F.lit(0), out.counts))

    def erase(self, batch: DataFrame) -> Outcome:
        out = super().erase(batch)
        return replace(out, container=self._and(out.container, F.lit(0), F.lit(0), F.col("deleted"), out.counts))

    def append_unique(self, batch: DataFrame) -> DynamicMap:
        """Insert keys that the caller knows to be new and distinct: no join, no shuffle."""
        counts = batch.agg(F.count(F.lit(1)).alias("n"))
        added = replace(self, state=self.state.unionByName(self._typed(batch).select("key", "value")), depth=self.depth + 1)
        return self._and(added, F.col("n"), F.col("n"), F.lit(0), counts, "never")

    def clear(self) -> DynamicMap:
        """Empty; segments and capacity stay."""
        return replace(super().clear(), grown=self.growth.cleared(), pending=())
