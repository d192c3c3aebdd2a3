"""Registered queries of the keyed collections and sketches, with DuckDB SQL for each.

Batches come from the driver tables: events (ord event_id, key user_id), orders (ord o_orderkey, key
o_custkey) and customer as queries, with some keys moved out of range so that misses occur.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import hashing
from keyloom.operators import bloom, roaring
from keyloom.operators.bag import Multimap, Multiset
from keyloom.operators.batch import exclusive_scan, is_sentinel
from keyloom.operators.hll import HyperLogLog, register
from keyloom.operators.keyed import DynamicMap, StaticMap, StaticSet
from keyloom.operators.segments import SegmentedMap, count_zero, extract_keys, mask_is_zero, mask_non_zero, merge_contains, merge_find
from keyloom.sources.tables import batch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EMPTY = -1
#: A capacity that binds: fewer slots than there are keys.
SMALL = 97

_PARTS = """
e AS (SELECT event_id AS ord, user_id AS key, event_id AS value, event_type AS stencil FROM events),
o AS (SELECT o_orderkey AS ord, o_custkey AS key, o_orderkey AS value, o_orderstatus AS stencil FROM orders),
q AS (SELECT c_custkey AS ord, CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 1000000 ELSE c_custkey END AS key, c_mktsegment AS stencil FROM customer),
ks AS (SELECT key, min(ord) AS ord, arg_min(value, ord) AS value FROM e GROUP BY key),
kp AS (SELECT key, min(ord) AS ord, arg_min(value, ord) AS value FROM e WHERE stencil = 'purchase' GROUP BY key),
m AS (SELECT key, arg_min(value, ord) AS value FROM o GROUP BY key)
"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    return batch(table(spark, d, "events"), "event_id", "user_id", "event_id", "event_type")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return batch(table(spark, d, "orders"), "o_orderkey", "o_custkey", "o_orderkey", "o_orderstatus")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    q = batch(table(spark, d, "customer"), "c_custkey", "c_custkey", stencil="c_mktsegment")
    return q.withColumn("key", F.when(F.col("key") % 5 == 0, F.col("key") + 1000000).otherwise(F.col("key")))


def _set(spark: SparkSession, capacity: int | None = None) -> StaticSet:
    return StaticSet.create(spark, "bigint", EMPTY, capacity, probing="linear")


def _map(spark: SparkSession, capacity: int | None = None) -> StaticMap:
    return StaticMap.create(spark, "bigint", "bigint", EMPTY, EMPTY, capacity)


def _dmap(spark: SparkSession) -> DynamicMap:
    return DynamicMap.create(spark, "bigint", "bigint", EMPTY, EMPTY)


def _is(value: str):
    return lambda s: s == value


def _orders_map(spark: SparkSession, d: str) -> StaticMap:
    return _map(spark).insert_async(_orders(spark, d))


def _add(name: str, sql: str | None):
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"WITH {_PARTS}\n{sql}"
        return f

    return put


# ---- sets
_add("set_insert_outcome", "SELECT (SELECT count(*) FROM ks) AS inserted, (SELECT count(*) FROM e) - (SELECT count(*) FROM ks) AS failed")(lambda s, d: _set(s).insert(_events(s, d)).counts)
_add("set_insert_keys", "SELECT key FROM ks")(lambda s, d: _set(s).insert_async(_events(s, d)).to_df())
_add("set_insert_capacity", f"SELECT key FROM ks ORDER BY ord LIMIT {SMALL}")(lambda s, d: _set(s, SMALL).insert_async(_events(s, d)).to_df())
_add("set_insert_capacity_outcome", f"SELECT least({SMALL}, (SELECT count(*) FROM ks)) AS inserted, (SELECT count(*) FROM e) - least({SMALL}, (SELECT count(*) FROM ks)) AS failed")(lambda s, d: _set(s, SMALL).insert(_events(s, d)).counts)
_add("set_insert_if", "SELECT key FROM kp")(lambda s, d: _set(s).insert_async(_events(s, d), _is("purchase")).to_df())
_add("set_insert_and_find", "SELECT e.ord, e.key, e.key AS found, e.ord = ks.ord AS inserted FROM e JOIN ks USING (key)")(lambda s, d: _set(s).insert_and_find(_events(s, d)).rows.select("ord", "key", "found", "inserted"))
_add("set_find", f"SELECT q.ord, q.key, coalesce(m.key, {EMPTY}) AS found FROM q LEFT JOIN m USING (key)")(lambda s, d: _set(s).insert_async(_orders(s, d)).find(_queries(s, d)).drop("stencil"))
_add("set_find_if", f"SELECT q.ord, q.key, CASE WHEN q.stencil = 'BUILDING' THEN coalesce(m.key, {EMPTY}) ELSE {EMPTY} END AS found FROM q LEFT JOIN m USING (key)")(lambda s, d: _set(s).insert_async(_orders(s, d)).find(_queries(s, d), _is("BUILDING")).drop("stencil"))
_add("set_contains", "SELECT q.ord, q.key, m.key IS NOT NULL AS found FROM q LEFT JOIN m USING (key)")(lambda s, d: _set(s).insert_async(_orders(s, d)).contains(_queries(s, d)).drop("stencil"))
_add("set_contains_if", "SELECT q.ord, q.key, m.key IS NOT NULL AND q.stencil = 'BUILDING' AS found FROM q LEFT JOIN m USING (key)")(lambda s, d: _set(s).insert_async(_orders(s, d)).contains(_queries(s, d), _is("BUILDING")).drop("stencil"))
_add("set_count", "SELECT count(*) AS hits FROM o WHERE key IN (SELECT key FROM q)")(lambda s, d: _set(s).insert_async(_queries(s, d)).count(_orders(s, d)))
_add("set_erase", "SELECT key FROM m WHERE key NOT IN (SELECT key FROM q)")(lambda s, d: _set(s).insert_async(_orders(s, d)).erase_async(_queries(s, d)).to_df())
_add("set_erase_outcome", "SELECT (SELECT count(*) FROM m WHERE key IN (SELECT key FROM q)) AS deleted, (SELECT count(*) FROM q) - (SELECT count(*) FROM m WHERE key IN (SELECT key FROM q)) AS failed")(lambda s, d: _set(s).insert_async(_orders(s, d)).erase(_queries(s, d)).counts)
_add("set_for_each_even", "SELECT count(*) FILTER (key % 2 = 0) AS evens, coalesce(sum(key) FILTER (key % 2 = 0), 0)::BIGINT AS total FROM o WHERE key IN (SELECT key FROM q)")(
    lambda s, d: _set(s).insert_async(_queries(s, d)).for_each(_orders(s, d), F.count_if(F.col("key") % 2 == 0).alias("evens"), F.coalesce(F.sum(F.when(F.col("key") % 2 == 0, F.col("key"))), F.lit(0)).alias("total"))
)
_add("set_union", "SELECT key FROM m UNION SELECT key FROM q")(lambda s, d: _set(s).insert_async(_orders(s, d)).insert_async(_queries(s, d)).to_df())
_add("set_intersect", "SELECT key FROM m INTERSECT SELECT key FROM q")(lambda s, d: _set(s).insert_async(_queries(s, d)).contains(_set(s).insert_async(_orders(s, d)).to_df()).filter("found").select("key"))

# ---- maps
_add("map_insert_first_wins", "SELECT key, value FROM ks")(lambda s, d: _map(s).insert_async(_events(s, d)).to_df())
_add("map_insert_outcome", "SELECT (SELECT count(*) FROM ks) AS inserted, (SELECT count(*) FROM e) - (SELECT count(*) FROM ks) AS failed")(lambda s, d: _map(s).insert(_events(s, d)).counts)
_add("map_insert_capacity", f"SELECT key, value FROM ks ORDER BY ord LIMIT {SMALL}")(lambda s, d: _map(s, SMALL).insert_async(_events(s, d)).to_df())
_add("map_insert_if", "SELECT key, value FROM kp")(lambda s, d: _map(s).insert_async(_events(s, d), _is("purchase")).to_df())
_add("map_upsert_last_wins", "SELECT key, arg_max(value, ord) AS value FROM e GROUP BY key")(lambda s, d: _map(s).insert_or_assign_async(_events(s, d)).to_df())
_add("map_upsert_over_state", "SELECT coalesce(x.key, m.key) AS key, coalesce(x.value, m.value) AS value FROM m FULL JOIN (SELECT key, arg_max(value, ord) AS value FROM e GROUP BY key) x ON x.key = m.key")(
    lambda s, d: _orders_map(s, d).insert_or_assign_async(_events(s, d)).to_df()
)
_add(
    "map_upsert_counts",
    "SELECT (SELECT count(*) FROM ks WHERE key NOT IN (SELECT key FROM m)) AS inserted, (SELECT count(*) FROM e) - (SELECT count(*) FROM ks WHERE key NOT IN (SELECT key FROM m)) AS assigned, 0::BIGINT AS failed",
)(lambda s, d: _orders_map(s, d).insert_or_assign(_events(s, d)).counts)
_add("map_assign_if", "SELECT m.key, coalesce(x.value, m.value) AS value FROM m LEFT JOIN (SELECT key, arg_max(value, ord) AS value FROM e WHERE stencil = 'purchase' GROUP BY key) x ON x.key = m.key")(
    lambda s, d: _orders_map(s, d).assign(_events(s, d), _is("purchase")).to_df()
)
_add("map_insert_and_find", "SELECT e.ord, e.key, ks.value AS found_value, e.ord = ks.ord AS inserted FROM e JOIN ks USING (key)")(lambda s, d: _map(s).insert_and_find(_events(s, d)).rows.select("ord", "key", "found_value", "inserted"))
_add("map_find", f"SELECT q.ord, q.key, coalesce(m.value, {EMPTY}) AS found_value FROM q LEFT JOIN m USING (key)")(lambda s, d: _orders_map(s, d).find(_queries(s, d)).drop("stencil"))
_add("map_find_if", f"SELECT q.ord, q.key, CASE WHEN q.stencil = 'BUILDING' THEN coalesce(m.value, {EMPTY}) ELSE {EMPTY} END AS found_value FROM q LEFT JOIN m USING (key)")(lambda s, d: _orders_map(s, d).find(_queries(s, d), _is("BUILDING")).drop("stencil"))
_add("map_contains", "SELECT q.ord, q.key, m.key IS NOT NULL AS found FROM q LEFT JOIN m USING (key)")(lambda s, d: _orders_map(s, d).contains(_queries(s, d)).drop("stencil"))
_add("map_contains_if", "SELECT q.ord, q.key, m.key IS NOT NULL AND q.stencil = 'BUILDING' AS found FROM q LEFT JOIN m USING (key)")(lambda s, d: _orders_map(s, d).contains(_queries(s, d), _is("BUILDING")).drop("stencil"))
_add("map_count", "SELECT count(*) AS hits FROM e WHERE key IN (SELECT key FROM m)")(lambda s, d: _orders_map(s, d).count(_events(s, d)))
_add("map_erase", "SELECT key, value FROM m WHERE key NOT IN (SELECT key FROM q)")(lambda s, d: _orders_map(s, d).erase_async(_queries(s, d)).to_df())
_add("map_erase_outcome", "SELECT (SELECT count(*) FROM m WHERE key IN (SELECT key FROM e)) AS deleted, (SELECT count(*) FROM e) - (SELECT count(*) FROM m WHERE key IN (SELECT key FROM e)) AS failed")(lambda s, d: _orders_map(s, d).erase(_events(s, d)).counts)
_add("map_for_each", "SELECT count(*) AS n, sum(m.value)::BIGINT AS total, max(m.value) AS most FROM e JOIN m USING (key)")(
    lambda s, d: _orders_map(s, d).for_each(_events(s, d), F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("most"))
)
_add("map_clear", "SELECT key, value FROM m WHERE false")(lambda s, d: _orders_map(s, d).clear().to_df())

# ---- growing maps
_add("dmap_insert", "SELECT count(*) AS inserted FROM ks")(lambda s, d: _dmap(s).insert(_events(s, d)).counts.select("inserted"))
_add("dmap_reinsert_keeps_old", "SELECT key, value FROM ks")(lambda s, d: (lambda m: m.insert_async(_events(s, d).withColumn("value", F.lit(0).cast("long"))).to_df())(_dmap(s).insert_async(_events(s, d))))
_add("dmap_upsert_new_count", "SELECT count(*) AS inserted FROM ks WHERE key NOT IN (SELECT key FROM m)")(lambda s, d: _dmap(s).insert_async(_orders(s, d)).insert_or_assign(_events(s, d)).counts.select("inserted"))
_add("dmap_find", f"SELECT q.ord, q.key, coalesce(m.value, {EMPTY}) AS found_value FROM q LEFT JOIN m USING (key)")(lambda s, d: _dmap(s).insert_async(_orders(s, d)).find(_queries(s, d)).drop("stencil"))
_add("dmap_contains", "SELECT q.ord, q.key, m.key IS NOT NULL AS found FROM q LEFT JOIN m USING (key)")(lambda s, d: _dmap(s).insert_async(_orders(s, d)).contains(_queries(s, d)).drop("stencil"))
_add("dmap_erase_deleted", "SELECT count(*) AS deleted FROM m WHERE key IN (SELECT key FROM q)")(lambda s, d: _dmap(s).insert_async(_orders(s, d)).erase(_queries(s, d)).counts.select("deleted"))
_add("dmap_append_unique", "SELECT ord AS key, key AS value FROM o")(lambda s, d: _dmap(s).append_unique(_orders(s, d).select(F.col("ord").alias("key"), F.col("key").alias("value"))).to_df())

_log = lambda s, d: SegmentedMap((s.createDataFrame([], "key bigint, value bigint, deleted boolean"),), EMPTY).append(_orders(s, d)).append(_events(s, d)).erase(_queries(s, d).filter("key % 2 = 0"))
_ALIVE = "(SELECT key, value FROM (SELECT coalesce(x.key, y.key) AS key, coalesce(x.value, y.value) AS value FROM (SELECT key, arg_max(value, ord) AS value FROM o GROUP BY key) y FULL JOIN (SELECT key, arg_max(value, ord) AS value FROM e GROUP BY key) x ON x.key = y.key) WHERE key NOT IN (SELECT key FROM q WHERE key % 2 = 0))"
_add("segments_compact", f"SELECT key, value FROM {_ALIVE} a")(lambda s, d: _log(s, d).compact().to_df())
_add("segments_find", f"SELECT q.ord, q.key, coalesce(a.value, {EMPTY}) AS found_value FROM q LEFT JOIN {_ALIVE} a ON a.key = q.key")(lambda s, d: _log(s, d).find(_queries(s, d)).drop("stencil"))
_add("segments_merge", f"SELECT q.ord, coalesce(m.value, x.value, {EMPTY}) AS found_value, m.key IS NOT NULL OR x.key IS NOT NULL AS found FROM q LEFT JOIN m ON m.key = q.key LEFT JOIN ks x ON x.key = q.key")(
    lambda s, d: _orders_map(s, d)
    .find(_queries(s, d))
    .select("ord", F.col("found_value").alias("a"))
    .join(_map(s).insert_async(_events(s, d)).find(_queries(s, d)).select("ord", F.col("found_value").alias("b")), "ord")
    .select("ord", merge_find(F.col("a"), F.col("b"), EMPTY).alias("found_value"), merge_contains(F.col("a") != EMPTY, F.col("b") != EMPTY).alias("found"))
)
_add("segments_count_zero", "SELECT count(*) FILTER (key % 3 = 0) AS zeros FROM q")(lambda s, d: count_zero(_queries(s, d).select((F.col("key") % 3).alias("mask")), "mask"))

# ---- multisets
_bag = lambda s, d, cap=None: Multiset.create(s, "bigint", EMPTY, cap).insert(_orders(s, d)).container
_add("mset_insert_prefix", "SELECT key, count(*) AS n FROM (SELECT key FROM o ORDER BY ord LIMIT 5000) GROUP BY key")(lambda s, d: _bag(s, d, 5000).state.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
_add("mset_insert_outcome", "SELECT least(5000, count(*)) AS inserted, count(*) - least(5000, count(*)) AS failed FROM o")(lambda s, d: Multiset.create(s, "bigint", EMPTY, 5000).insert(_orders(s, d)).counts)
_add("mset_insert_if", "SELECT key, count(*) AS n FROM o WHERE stencil = 'F' GROUP BY key")(lambda s, d: Multiset.create(s, "bigint", EMPTY).insert(_orders(s, d), _is("F")).container.state.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
_add("mset_contains", "SELECT q.ord, q.key, m.key IS NOT NULL AS found FROM q LEFT JOIN m USING (key)")(lambda s, d: _bag(s, d).contains(_queries(s, d)).drop("stencil"))
_add("mset_contains_if", "SELECT q.ord, q.key, m.key IS NOT NULL AND q.stencil = 'BUILDING' AS found FROM q LEFT JOIN m USING (key)")(lambda s, d: _bag(s, d).contains(_queries(s, d), _is("BUILDING")).drop("stencil"))
_add("mset_find", f"SELECT q.ord, q.key, coalesce(m.key, {EMPTY}) AS found FROM q LEFT JOIN m USING (key)")(lambda s, d: _bag(s, d).find(_queries(s, d)).drop("stencil"))
_add("mset_find_if", f"SELECT q.ord, q.key, CASE WHEN q.stencil = 'BUILDING' THEN coalesce(m.key, {EMPTY}) ELSE {EMPTY} END AS found FROM q LEFT JOIN m USING (key)")(lambda s, d: _bag(s, d).find(_queries(s, d), _is("BUILDING")).drop("stencil"))
_COUNTS = "q LEFT JOIN (SELECT key, count(*) AS n FROM o GROUP BY key) c USING (key)"
_add("mset_count_each", f"SELECT q.ord, q.key, coalesce(n, 0) AS multiplicity FROM {_COUNTS}")(lambda s, d: _bag(s, d).count_each(_queries(s, d)).drop("stencil"))
_add("mset_count_each_outer", f"SELECT q.ord, q.key, greatest(coalesce(n, 0), 1) AS multiplicity FROM {_COUNTS}")(lambda s, d: _bag(s, d).count_each(_queries(s, d), outer=True).drop("stencil"))
_add("mset_count_total", f"SELECT coalesce(sum(n), 0)::BIGINT AS total FROM {_COUNTS}")(lambda s, d: _bag(s, d).count(_queries(s, d)))
_add("mset_retrieve", "SELECT row_number() OVER (ORDER BY q.ord) - 1 AS pos, q.key AS probe, q.key AS match FROM q JOIN o ON o.key = q.key")(lambda s, d: _bag(s, d).retrieve(_queries(s, d)))
_add("mset_retrieve_all", "SELECT row_number() OVER (ORDER BY ord) - 1 AS pos, key FROM o")(lambda s, d: _bag(s, d).retrieve_all())

# ---- multimaps
_mm = lambda s, d, cap=None, p=None: Multimap.create(s, "bigint", "bigint", EMPTY, EMPTY, cap).insert(_orders(s, d), p, check=False).container
_add("mmap_insert_prefix", "SELECT key, value FROM o ORDER BY ord LIMIT 5000")(lambda s, d: _mm(s, d, 5000).retrieve_all())
_add("mmap_insert_outcome", "SELECT least(5000, count(*)) AS inserted, count(*) - least(5000, count(*)) AS failed FROM o")(lambda s, d: Multimap.create(s, "bigint", "bigint", EMPTY, EMPTY, 5000).insert(_orders(s, d)).counts)
_add("mmap_insert_if", "SELECT key, value FROM o WHERE stencil = 'F'")(lambda s, d: _mm(s, d, p=_is("F")).retrieve_all())
_add("mmap_contains", "SELECT q.ord, q.key, m.key IS NOT NULL AS found FROM q LEFT JOIN m USING (key)")(lambda s, d: _mm(s, d).contains(_queries(s, d)).drop("stencil"))
_add("mmap_contains_if", "SELECT q.ord, q.key, m.key IS NOT NULL AND q.stencil = 'BUILDING' AS found FROM q LEFT JOIN m USING (key)")(lambda s, d: _mm(s, d).contains(_queries(s, d), _is("BUILDING")).drop("stencil"))
_MIN = "q LEFT JOIN (SELECT key, min(value) AS v FROM o GROUP BY key) c USING (key)"
_add("mmap_find_min", f"SELECT q.ord, q.key, coalesce(v, {EMPTY}) AS found_value FROM {_MIN}")(lambda s, d: _mm(s, d).find(_queries(s, d)).drop("stencil"))
_add("mmap_find_if", f"SELECT q.ord, q.key, CASE WHEN stencil = 'BUILDING' THEN coalesce(v, {EMPTY}) ELSE {EMPTY} END AS found_value FROM {_MIN}")(lambda s, d: _mm(s, d).find(_queries(s, d), _is("BUILDING")).drop("stencil"))
_add("mmap_count", "SELECT count(*) AS total FROM q JOIN o ON o.key = q.key")(lambda s, d: _mm(s, d).count(_queries(s, d)))
_add("mmap_retrieve", "SELECT row_number() OVER (ORDER BY q.ord, o.value) - 1 AS pos, q.key AS probe, o.value FROM q JOIN o ON o.key = q.key")(lambda s, d: _mm(s, d).retrieve(_queries(s, d)))
_add("mmap_retrieve_all", "SELECT key, value FROM o")(lambda s, d: _mm(s, d).retrieve_all())

# ---- chains, reserved keys, capacities, metadata
def _slices(spark: SparkSession, d: str, n: int) -> list[DataFrame]:
    """The events as ``n`` batches."""
    return [_events(spark, d).filter(F.pmod(F.col("ord"), F.lit(n)) == i) for i in range(n)]


def _one(spark: SparkSession, **values: int) -> DataFrame:
    """One row of numbers."""
    return spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in values.items()])


_add("set_insert_chain", "SELECT key FROM ks")(lambda s, d: reduce(lambda c, b: c.insert_async(b), _slices(s, d, 50), _set(s)).to_df())
_add(
    "map_mixed_chain",
    "SELECT coalesce(a.key, m.key) AS key, coalesce(a.value, m.value) AS value FROM (SELECT key, arg_max(value, ord) AS value FROM e WHERE ord % 2 = 1 GROUP BY key) a FULL JOIN (SELECT key, value FROM m WHERE key NOT IN (SELECT key FROM q)) m ON a.key = m.key",
)(lambda s, d: _orders_map(s, d).erase_async(_queries(s, d)).insert_or_assign_async(_events(s, d).filter("ord % 2 = 1")).to_df())
_add("map_erased_key", "SELECT (SELECT count(*) FROM ks WHERE key <> 7) AS inserted, (SELECT count(*) FROM e) - (SELECT count(*) FROM ks WHERE key <> 7) AS failed")(lambda s, d: _map(s).with_erased_key(7).insert(_events(s, d)).counts)
_add("map_erase_async", "SELECT key, value FROM m WHERE key NOT IN (SELECT key FROM e)")(lambda s, d: _orders_map(s, d).erase_async(_events(s, d)).to_df())
_add("map_key_equal", "SELECT q.ord, m.key IS NOT NULL AS found FROM q LEFT JOIN (SELECT DISTINCT key // 10 AS key FROM o) m ON m.key = q.key // 10")(
    lambda s, d: StaticMap.create(s, "bigint", "bigint", EMPTY, EMPTY, canonical=lambda k: F.floor(k / 10)).insert_async(_orders(s, d)).contains(_queries(s, d)).select("ord", "found")
)
_CAPACITIES = (0, 1, 5, 6, 97, 1000, 65_537)
_add(
    "capacity_rounded",
    f"SELECT c AS asked, 5 * ((greatest(c, 1) + 4) // 5 + (c = 0)::INT) AS linear, 5 * (SELECT min(n) FROM range(2, 20000) t(n) WHERE n >= greatest((greatest(c, 1) + 4) // 5, 2) AND NOT EXISTS (SELECT 1 FROM range(2, 142) u(k) WHERE k * k <= n AND n % k = 0)) AS double FROM (SELECT unnest({list(_CAPACITIES)}) AS c)",
)(
    lambda s, d: reduce(
        DataFrame.union,
        [_one(s, asked=c, linear=StaticMap.create(s, "bigint", "bigint", EMPTY, EMPTY, c, bucket_size=5).capacity, double=StaticSet.create(s, "bigint", EMPTY, c, bucket_size=5).capacity) for c in _CAPACITIES],
    )
)
_add("set_metadata", "SELECT (SELECT count(*) FROM ks) AS held, 0 AS cleared, 97 AS capacity")(lambda s, d: (lambda c: _one(s, held=c.size(), cleared=c.clear().size(), capacity=_set(s, SMALL).capacity))(_set(s).insert_async(_events(s, d))))
_add("set_clear", "SELECT key FROM ks WHERE false")(lambda s, d: _set(s).insert_async(_events(s, d)).clear().to_df())
_add("bitwise_sentinel", "SELECT ord, key FROM q WHERE key <> 3")(lambda s, d: _queries(s, d).filter(~is_sentinel(F.col("key"), 3)).select("ord", "key"))

# ---- growing maps: an engine's segments
_GROW = "(SELECT n, 65536 * (1 << greatest(0, ceil(log2((greatest(n, 1) + 10000) / 0.60000002384185791015625 / 65536.0))::INT))::BIGINT AS following FROM (SELECT count(*) AS n FROM e))"
_add(
    "dmap_segments",
    f"SELECT 1 + (n > floor(0.60000002384185791015625 * 32768)::BIGINT - 10000)::INT AS segments, 32768 + CASE WHEN n > floor(0.60000002384185791015625 * 32768)::BIGINT - 10000 THEN following ELSE 0 END AS capacity, (SELECT count(*) FROM ks) AS held FROM {_GROW}",
)(lambda s, d: (lambda c: _one(s, segments=c.num_segments, capacity=c.total_capacity, held=c.size()))(DynamicMap.create(s, "bigint", "bigint", EMPTY, EMPTY, 32_768).insert(_events(s, d)).container))
_add("dmap_reserve", "SELECT 16 AS segments, 2 * 65535 AS capacity")(lambda s, d: (lambda c: _one(s, segments=c.num_segments, capacity=c.total_capacity))(DynamicMap.create(s, "bigint", "bigint", EMPTY, EMPTY, 0).reserve(20_000)))
_add("dmap_erase_async", "SELECT key, value FROM ks WHERE key NOT IN (SELECT key FROM q)")(lambda s, d: _dmap(s).insert_async(_events(s, d)).erase_async(_queries(s, d)).to_df())
_add("dmap_clear", "SELECT 0 AS held, 32768 + CASE WHEN n > floor(0.60000002384185791015625 * 32768)::BIGINT - 10000 THEN following ELSE 0 END AS capacity FROM " + _GROW)(
    lambda s, d: (lambda c: _one(s, held=c.size(), capacity=c.total_capacity))(DynamicMap.create(s, "bigint", "bigint", EMPTY, EMPTY, 32_768).insert(_events(s, d)).container.clear())
)
_add("segments_extract_keys", "SELECT key FROM q")(lambda s, d: extract_keys(_queries(s, d)))
_add("segments_masks", "SELECT ord, key % 3 = 0 AS zero, key % 3 <> 0 AS non_zero FROM q")(lambda s, d: _queries(s, d).select("ord", mask_is_zero(F.col("key") % 3).alias("zero"), mask_non_zero(F.col("key") % 3).alias("non_zero")))

# ---- bags: equality, sizes
_TENS = "q LEFT JOIN (SELECT key // 10 AS key, count(*) AS n FROM o GROUP BY ALL) c ON c.key = q.key // 10"
_add("mset_count_each_equal", f"SELECT q.ord, q.key, coalesce(n, 0) AS multiplicity FROM {_TENS}")(lambda s, d: _bag(s, d).count_each(_queries(s, d).drop("stencil"), equal=lambda k: F.floor(k / 10)))
_add("mset_count_each_outer_equal", f"SELECT q.ord, q.key, greatest(coalesce(n, 0), 1) AS multiplicity FROM {_TENS}")(lambda s, d: _bag(s, d).count_each(_queries(s, d).drop("stencil"), outer=True, equal=lambda k: F.floor(k / 10)))
_add("mset_metadata", "SELECT (SELECT count(*) FROM o) AS held, 0 AS cleared, 5000 AS capacity")(lambda s, d: (lambda c: _one(s, held=c.size(), cleared=c.clear().size(), capacity=_bag(s, d, 5000).capacity))(_bag(s, d)))
_add("mmap_metadata", "SELECT (SELECT count(*) FROM o) AS held, 0 AS cleared, 5000 AS capacity")(lambda s, d: (lambda c: _one(s, held=c.size(), cleared=c.clear().size(), capacity=_mm(s, d, 5000).capacity))(_mm(s, d)))

# ---- hashes in 64-bit unsigned arithmetic, for the SQL of sketches
_P64 = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
_W64 = "18446744073709551616::UHUGEINT"


def _mul(a: str, b: int) -> str:
    return f"(({a})::UHUGEINT * {b}::UHUGEINT % {_W64})::UBIGINT"


def _plus(a: str, b: int) -> str:
    return f"((({a})::UHUGEINT + {b}::UHUGEINT) % {_W64})::UBIGINT"


def _rotated(a: str, r: int) -> str:
    return f"({_mul(a, 1 << r)} | (({a}) >> {64 - r}))"


def _steps(source: str, key: str, *steps: str) -> str:
    """Nested selects, each computing ``x`` (or what the step names) from the one before."""
    sql = f"(SELECT *, {key} AS x FROM {source})"
    for step in steps:
        sql = f"(SELECT * REPLACE ({step} AS x) FROM {sql})"
    return sql


def _unsigned(key: str) -> str:
    return f"(CASE WHEN {key} < 0 THEN {key}::HUGEINT + 18446744073709551616 ELSE {key} END)::UBIGINT"


def _signed(x: str) -> str:
    return f"(CASE WHEN {x} >= 9223372036854775808 THEN {x}::HUGEINT - 18446744073709551616 ELSE {x} END)::BIGINT"


def _xxh64_sql(source: str, key: str = "key") -> str:
    """``source`` with ``x``: 64-bit xxHash of a long with seed 0, unsigned."""
    p1, p2, p3, p4, p5 = _P64
    return _steps(
        source, _unsigned(key), _mul("x", p2), _rotated("x", 31), _mul("x", p1), f"xor(x, {p5 + 8}::UBIGINT)", _rotated("x", 27), _mul("x", p1), _plus("x", p4),
        "xor(x, x >> 33)", _mul("x", p2), "xor(x, x >> 29)", _mul("x", p3), "xor(x, x >> 32)",
    )


def _fmix64_sql(source: str) -> str:
    return _steps(source, _unsigned("key"), "xor(x, x >> 33)", _mul("x", 0xFF51AFD7ED558CCD), "xor(x, x >> 33)", _mul("x", 0xC4CEB9FE1A85EC53), "xor(x, x >> 33)")


def _mul32(a: str, b: int) -> str:
    return f"(({a})::HUGEINT * {b} % 4294967296)::UBIGINT"


def _rotated32(a: str, r: int) -> str:
    return f"({_mul32(a, 1 << r)} | (({a}) >> {32 - r}))"


def _murmur32_sql(source: str) -> str:
    """Of a non-negative int key, with seed 0."""
    return _steps(
        source, "key::UBIGINT", _mul32("x", 0xCC9E2D51), _rotated32("x", 15), _mul32("x", 0x1B873593), _rotated32("x", 13), f"(x * 5 + {0xE6546B64}::UBIGINT) % 4294967296", "xor(x, 4::UBIGINT)",
        "xor(x, x >> 16)", _mul32("x", 0x85EBCA6B), "xor(x, x >> 13)", _mul32("x", 0xC2B2AE35), "xor(x, x >> 16)",
    )


def _xxh32_sql(source: str) -> str:
    """Of a non-negative int key, with seed 0."""
    return _steps(
        source, "key::UBIGINT", f"({_mul32('x', 3266489917)} + {374761393 + 4}::UBIGINT) % 4294967296", _rotated32("x", 17), _mul32("x", 668265263),
        "xor(x, x >> 15)", _mul32("x", 2246822519), "xor(x, x >> 13)", _mul32("x", 3266489917), "xor(x, x >> 16)",
    )


_keys = lambda s, d: _orders_map(s, d).to_df().select("key")
_add("hash_xxhash64", f"SELECT key, {_signed('x')} AS h FROM {_xxh64_sql('m')}")(lambda s, d: _keys(s, d).select("key", hashing.xxhash64(F.col("key"), 0).alias("h")))
_add("hash_fmix64", f"SELECT key, {_signed('x')} AS h FROM {_fmix64_sql('m')}")(lambda s, d: _keys(s, d).select("key", hashing.fmix64(F.col("key")).alias("h")))
_add("hash_murmur32", f"SELECT key, x::BIGINT AS h FROM {_murmur32_sql('m')}")(lambda s, d: _keys(s, d).select("key", hashing.murmur32(F.col("key").cast("int")).alias("h")))
_add("hash_xxhash32", f"SELECT key, x::BIGINT AS h FROM {_xxh32_sql('m')}")(lambda s, d: _keys(s, d).select("key", hashing.xxhash32(F.col("key").cast("int")).alias("h")))

# ---- sketches: registers and words, bit for bit
_REGISTERS = "SELECT (x >> 50)::INT AS idx, max(65 - length(bin({tail})))::INT AS rank FROM {rows} GROUP BY ALL".format(tail="(" + _mul("x", 1 << 14) + " | 8192::UBIGINT)", rows=_xxh64_sql("{source}"))


def _registers_sql(source: str) -> str:
    return _REGISTERS.replace("{source}", source)


_hll = lambda s, d: HyperLogLog.create(s, p=14).add(_orders(s, d))
_add("hll_registers", _registers_sql("o"))(lambda s, d: _hll(s, d).registers)
_add("hll_registers_merge", _registers_sql("(SELECT key FROM o UNION ALL SELECT key FROM e)"))(lambda s, d: _hll(s, d).merge(HyperLogLog.create(s, p=14).add(_events(s, d))).registers)
_add("hll_register_of_a_key", f"SELECT key, (x >> 51)::INT AS idx, (65 - length(bin({_mul('x', 1 << 13)} | 4096::UBIGINT)))::INT AS rank FROM {_xxh64_sql('m')}")(
    lambda s, d: _keys(s, d).select("key", *[c.alias(n) for c, n in zip(register(F.col("key"), 13), ("idx", "rank"), strict=True)])
)
_add("hll_estimate", f"SELECT round(16384 * ln(16384.0 / (16384 - count(*))))::BIGINT AS estimate FROM ({_registers_sql('o')})")(lambda s, d: _hll(s, d).estimate_df())
_add("hll_parameters", "SELECT unnest([8, 16, 32, 64, 128, 256]) AS kb, unnest([13, 14, 15, 16, 17, 18]) AS p, unnest([8, 16, 32, 64, 128, 256]) AS size_kb")(
    lambda s, d: reduce(DataFrame.union, [_one(s, kb=k, p=(h := HyperLogLog.create(s, kb=k)).p, size_kb=h.sketch_kb) for k in (8, 16, 32, 64, 128, 256)])
)
_add("hll_of_deviation", "SELECT per_mille, greatest(13, ceil(2 * log2(1.04 / (per_mille / 1000.0))))::BIGINT AS p FROM (SELECT unnest([11, 8, 6, 4, 3]) AS per_mille)")(
    lambda s, d: reduce(DataFrame.union, [_one(s, per_mille=k, p=HyperLogLog.create(s, deviation=k / 1000).p) for k in (11, 8, 6, 4, 3)])
)
_add("hll_clear", "SELECT 0::BIGINT AS estimate")(lambda s, d: _hll(s, d).clear().estimate_df())


def _words_sql(source: str, blocks: int, policy: bloom.Policy) -> str:
    """(block, w0 ...) of a filter over the keys of ``source``."""
    per = policy.bits // policy.words
    bit = lambda i: f"(1::BIGINT << (((x % 4294967296) * {bloom.SALTS[i]}::HUGEINT % 4294967296)::BIGINT >> 27))"
    words = ", ".join(f"bit_or({' | '.join(bit(w * per + b) for b in range(per))}) AS w{w}" for w in range(policy.words))
    return f"SELECT (((x >> 32)::HUGEINT * {blocks})::BIGINT >> 32) AS block, {words} FROM {_xxh64_sql(source)} GROUP BY ALL"


_bf = lambda s, d, p=None: bloom.BloomFilter.create(s, 257).add(_orders(s, d), p)
_add("bloom_words", _words_sql("o", 257, bloom.DEFAULT))(lambda s, d: _bf(s, d).table)
_add("bloom_words_wide", _words_sql("o", 61, bloom.Policy(4, 16)))(lambda s, d: bloom.BloomFilter.create(s, 61, bloom.Policy(4, 16)).add(_orders(s, d)).table)
_add("bloom_words_arrow", _words_sql("e", 1021, bloom.ARROW))(lambda s, d: bloom.BloomFilter.create(s, 1021, bloom.ARROW).add(_events(s, d)).table)
_add("bloom_add_if_words", _words_sql("(SELECT * FROM o WHERE stencil = 'F')", 257, bloom.DEFAULT))(lambda s, d: _bf(s, d, _is("F")).table)
_add("bloom_merge_words", _words_sql("(SELECT key FROM o UNION ALL SELECT key FROM e)", 257, bloom.DEFAULT))(lambda s, d: _bf(s, d).merge(bloom.BloomFilter.create(s, 257).add(_events(s, d))).table)
_add("bloom_intersect_words", f"SELECT a.block, {', '.join(f'a.w{i} & b.w{i} AS w{i}' for i in range(8))} FROM ({_words_sql('o', 257, bloom.DEFAULT)}) a JOIN ({_words_sql('e', 257, bloom.DEFAULT)}) b USING (block)")(
    lambda s, d: _bf(s, d).intersect(bloom.BloomFilter.create(s, 257).add(_events(s, d))).table
)
_HIT = " AND ".join(f"f.w{i} & k.w{i} = k.w{i}" for i in range(8))
_add("bloom_contains", f"SELECT k.key, coalesce({_HIT}, false) AS found FROM (SELECT key, unnest([1]) FROM (SELECT DISTINCT key FROM q)) z JOIN ({_words_sql('(SELECT DISTINCT key FROM q)', 257, bloom.DEFAULT).replace('GROUP BY ALL', 'GROUP BY key, block').replace('SELECT (((x', 'SELECT key, (((x')}) k USING (key) LEFT JOIN ({_words_sql('o', 257, bloom.DEFAULT)}) f ON f.block = k.block")(
    lambda s, d: _bf(s, d).contains(_queries(s, d)).select("key", "found")
)
_add("bloom_contains_if", f"SELECT q.ord, coalesce({_HIT}, false) AND q.stencil = 'BUILDING' AS found FROM q JOIN ({_words_sql('(SELECT DISTINCT key FROM q)', 257, bloom.DEFAULT).replace('GROUP BY ALL', 'GROUP BY key, block').replace('SELECT (((x', 'SELECT key, (((x')}) k USING (key) LEFT JOIN ({_words_sql('o', 257, bloom.DEFAULT)}) f ON f.block = k.block")(
    lambda s, d: _bf(s, d).contains(_queries(s, d), _is("BUILDING")).select("ord", "found")
)
_add("bloom_word_views", f"SELECT key, w0 | 5 AS added, w0 & 5 = w0 AS held FROM ({_words_sql('m', 257, bloom.DEFAULT).replace('GROUP BY ALL', 'GROUP BY key, block').replace('SELECT (((x', 'SELECT key, (((x')})")(
    lambda s, d: _keys(s, d).select("key", bloom.DEFAULT.place(F.col("key"), 257)[1]).select("key", bloom.add_word(F.lit(5).cast("long"), F.col("w0")).alias("added"), bloom.contains_word(F.lit(5).cast("long"), F.col("w0")).alias("held"))
)
_add("bloom_clear", "SELECT key, false AS found FROM q")(lambda s, d: _bf(s, d).clear().contains(_queries(s, d)).select("key", "found"))
_add("bloom_metadata", "SELECT 257 AS blocks, 257 * 8 AS words, 257 * 32 AS bytes")(lambda s, d: (lambda f: _one(s, blocks=f.blocks, words=f.num_words, bytes=f.size_bytes))(_bf(s, d)))
_add("bloom_no_false_negative", "SELECT count(*) AS asked, count(*) AS found FROM o")(lambda s, d: _bf(s, d).contains(_orders(s, d)).agg(F.count(F.lit(1)).alias("asked"), F.count_if("found").alias("found")))
_add("bloom_prefilter_semijoin", "SELECT q.ord, q.key FROM q WHERE key IN (SELECT key FROM o)")(lambda s, d: _bf(s, d).contains(_queries(s, d)).filter("found").select("ord", "key").join(_orders(s, d).select("key"), "key", "left_semi").select("ord", "key"))
_ROARING = roaring.serialize32([*range(0, 100_000, 1000), *range(300_000, 600_000, 3), *range(700_000, 800_000)], runs=True)
_add("roaring_contains", "SELECT ord, k AS key, (k < 100000 AND k % 1000 = 0) OR (k >= 300000 AND k < 600000 AND k % 3 = 0) OR (k >= 700000 AND k < 800000) AS found FROM (SELECT ord, key * 613 % 900000 AS k FROM o)")(
    lambda s, d: roaring.RoaringBitmap(s, _ROARING).contains(_orders(s, d).select("ord", (F.col("key") * 613 % 900000).alias("key")))
)
_WIDE = [b + x for b in (0, 7 << 32) for x in [*range(0, 60_000, 7), *range(70_000, 75_000)]]
_add("roaring64_contains", "SELECT ord, k AS key, (low < 60000 AND low % 7 = 0) OR (low >= 70000 AND low < 75000) AS found FROM (SELECT ord, low + CASE WHEN ord % 2 = 0 THEN 30064771072 ELSE 0 END AS k, low FROM (SELECT ord, key * 613 % 90000 AS low FROM o))")(
    lambda s, d: roaring.RoaringBitmap(s, roaring.serialize64(_WIDE), 64).contains(_orders(s, d).select("ord", (F.col("key") * 613 % 90000 + F.when(F.col("ord") % 2 == 0, F.lit(7 << 32)).otherwise(F.lit(0))).alias("key")))
)
_add("roaring_metadata", "SELECT 200100 AS cardinality, 0 AS empty, 48056 AS bytes, 1 AS none_is_empty")(
    lambda s, d: (lambda b: _one(s, cardinality=b.cardinality, empty=int(b.empty), bytes=b.size_bytes, none_is_empty=int(roaring.RoaringBitmap(s, roaring.serialize32([])).empty)))(roaring.RoaringBitmap(s, _ROARING))
)

# ---- support
_add("exclusive_scan", "SELECT ord, coalesce(sum(key) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM o")(lambda s, d: exclusive_scan(_orders(s, d).select("ord", "key"), F.col("key"), "before").select("ord", "before"))
_add(
    "hash_fmix32",
    "SELECT key, xor(h3, h3 >> 16)::BIGINT AS h FROM (SELECT key, ((xor(h2, h2 >> 13)::HUGEINT * 3266489909) % 4294967296)::BIGINT AS h3 FROM (SELECT key, ((xor(key, key >> 16)::HUGEINT * 2246822507) % 4294967296)::BIGINT AS h2 FROM m))",
)(
    lambda s, d: _orders_map(s, d).to_df().select("key", hashing.fmix32(F.col("key")).alias("h"))
)
