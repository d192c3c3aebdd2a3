"""Keyed containers against a plain dictionary model, and their contracts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from keyloom.operators.keyed import CHAIN, DynamicMap, StaticMap, StaticSet

EMPTY = -1


def rows(n, unique, seed, empties=True):
    r = random.Random(seed)
    keys = [r.randint(1, 2 * unique) for _ in range(n)]
    if empties:
        keys[:: max(1, n // 5)] = [EMPTY] * len(keys[:: max(1, n // 5)])
    return [(i, k, r.randint(1, 10**6), i % 3) for i, k in enumerate(keys)]


def frame(spark, data):
    return spark.createDataFrame(data, "ord long, key long, value long, stencil int")


def contents(m):
    return {r["key"]: r["value"] for r in m.to_df().collect()}


@pytest.mark.parametrize("capacity", [None, 5, 1000])
def test_insert_first_wins_and_prefix_is_admitted(spark, capacity):
    data = rows(60, 20, 1)
    want = {}
    for _, k, v, _ in data:
        if k != EMPTY and k not in want and (capacity is None or len(want) < capacity):
            want[k] = v
    out = StaticMap.create(spark, "long", "long", EMPTY, EMPTY, capacity).insert(frame(spark, data))
    assert contents(out.container) == want
    assert (out.inserted, out.failed) == (len(want), len(data) - len(want))


def test_upsert_last_wins_and_counts(spark):
    first, second = rows(40, 15, 2), rows(40, 25, 3)
    m = StaticMap.create(spark, "long", "long", EMPTY, EMPTY).insert_async(frame(spark, first))
    have = contents(m)
    out = m.insert_or_assign(frame(spark, second))
    want = have | {k: v for _, k, v, _ in second if k != EMPTY}
    assert contents(out.container) == want
    assert out.inserted == len(want) - len(have)
    assert out.failed == sum(k == EMPTY for _, k, _, _ in second)
    assert out.assigned == len(second) - out.failed - out.inserted


def test_upsert_overflow_fails_rows_of_keys_without_a_slot(spark):
    data = [(0, 1, 10, 0), (1, 2, 20, 0), (2, 3, 30, 0), (3, 3, 31, 0), (4, 1, 11, 0)]
    out = StaticMap.create(spark, "long", "long", EMPTY, EMPTY, 2).insert_or_assign(frame(spark, data))
    assert contents(out.container) == {1: 11, 2: 20}
    assert (out.inserted, out.assigned, out.failed) == (2, 1, 2)


def test_conditional_forms(spark):
    data = rows(50, 20, 4)
    m = StaticMap.create(spark, "long", "long", EMPTY, EMPTY)
    odd = lambda s: s != 0
    out = m.insert(frame(spark, data), odd)
    want = {}
    for _, k, v, s in data:
        if s and k != EMPTY:
            want.setdefault(k, v)
    assert contents(out.container) == want
    assert out.failed == sum(s != 0 for *_, s in data) - len(want)
    changed = out.container.assign(frame(spark, [(0, k, -7, 1) for k in list(want)[:3]] + [(9, 10**9, -7, 1)]), odd)
    assert contents(changed) == want | {k: -7 for k in list(want)[:3]}
    found = {r["ord"]: r["found_value"] for r in out.container.find(frame(spark, data), odd).collect()}
    assert found == {i: want.get(k, EMPTY) if s else EMPTY for i, k, _, s in data}
    hit = {r["ord"]: r["found"] for r in out.container.contains(frame(spark, data), odd).collect()}
    assert hit == {i: bool(s) and k in want for i, k, _, s in data}


def test_insert_and_find(spark):
    base, data = rows(20, 10, 5), rows(40, 20, 6)
    m = StaticMap.create(spark, "long", "long", EMPTY, EMPTY).insert_async(frame(spark, base))
    have, want = contents(m), {}
    model = dict(have)
    for i, k, v, _ in data:
        if k == EMPTY:
            want[i] = (EMPTY, False)
        else:
            want[i] = (model.setdefault(k, v), k not in have and sum(r[1] == k for r in data[: i + 1]) == 1)
    out = m.insert_and_find(frame(spark, data))
    assert {r["ord"]: (r["found_value"], r["inserted"]) for r in out.rows.collect()} == want
    assert contents(out.container) == model


def test_erase_count_for_each(spark):
    data = rows(60, 20, 7)
    m = StaticMap.create(spark, "long", "long", EMPTY, EMPTY).insert_async(frame(spark, data))
    have = contents(m)
    keys = [(0, next(iter(have)), 0, 0), (1, next(iter(have)), 0, 0), (2, 10**9, 0, 0)]
    out = m.erase(frame(spark, keys))
    assert (out.deleted, out.failed) == (1, 2)
    assert contents(out.container) == {k: v for k, v in have.items() if k != keys[0][1]}
    assert m.count(frame(spark, data)).first()["hits"] == sum(k in have for _, k, _, _ in data)
    assert sorted(r["value"] for r in m.for_each(frame(spark, data)).collect()) == sorted(have[k] for _, k, _, _ in data if k in have)
    assert contents(m.clear()) == {}


def test_set_forms(spark):
    data = rows(30, 10, 8)
    s = StaticSet.create(spark, "long", EMPTY)
    out = s.insert_and_find(frame(spark, data))
    keys = {k for _, k, _, _ in data} - {EMPTY}
    assert {r["key"] for r in out.container.to_df().collect()} == keys
    assert sum(r["inserted"] for r in out.rows.collect()) == len(keys)
    assert {r["ord"]: r["found"] for r in out.container.find(frame(spark, data)).collect()} == {i: k for i, k, _, _ in data}


def test_reserved_key_and_float_sentinels(spark):
    out = StaticMap.create(spark, "long", "long", EMPTY, EMPTY).insert(frame(spark, [(0, EMPTY, 123, 0), (1, 12345, 777, 0)]))
    assert (out.inserted, out.failed) == (1, 1)
    f = spark.createDataFrame([(0, float("nan")), (1, 0.0), (2, -0.0), (3, 1.5)], "ord long, key double")
    kept = StaticSet.create(spark, "double", float("nan")).insert(f)
    assert kept.failed == 2  # NaN is reserved; -0.0 is the same key as 0.0
    zero = StaticSet.create(spark, "double", 0.0).insert(f.filter("ord = 2"))
    assert zero.failed == 0  # -0.0 is not the reserved 0.0


def test_empty_batches(spark):
    none = frame(spark, [])
    out = StaticMap.create(spark, "long", "long", EMPTY, EMPTY, 3).insert(none)
    assert (out.inserted, out.failed, contents(out.container)) == (0, 0, {})
    assert out.container.find(none).count() == 0


def test_chained_operations_plan_linearly(spark):
    batches = [[(100 * b + i, (7 * b + i) % 90, b, 0) for i in range(12)] for b in range(50)]
    m, want = StaticMap.create(spark, "long", "long", EMPTY, EMPTY), {}
    frames = [frame(spark, b) for b in batches]
    for b, f in zip(batches, frames, strict=True):
        if b[0][2] % 5 == 4:
            m = m.erase_async(f.filter("ord % 2 = 0"))
            for o, k, *_ in b:
                if o % 2 == 0:
                    want.pop(k, None)
        elif b[0][2] % 3 == 2:
            m = m.insert_or_assign_async(f)
            want |= {k: v for _, k, v, _ in b}
        else:
            m = m.insert_async(f)
            for _, k, v, _ in b:
                want.setdefault(k, v)
    assert m.depth <= CHAIN
    began = time.perf_counter()
    plan = m.to_df()._jdf.queryExecution().optimizedPlan().toString()
    assert time.perf_counter() - began < 1 and plan.count("LogicalRDD") + plan.count("Relation") <= CHAIN + 1
    assert contents(m) == want


def test_chained_inserts_under_a_capacity(spark):
    m, want = StaticSet.create(spark, "long", EMPTY, 40, probing="linear"), []
    for b in range(5):
        keys = [(i, 11 * b + i, 0, 0) for i in range(15)]
        out = m.insert(frame(spark, keys))
        new = [k for _, k, _, _ in keys if k not in want][: 40 - len(want)]
        want += new
        assert (out.inserted, out.failed) == (len(new), 15 - len(new))
        m = out.container
        assert m.depth <= 1
    assert {r["key"] for r in m.to_df().collect()} == set(want)


def test_snapshots_keep_what_is_held(spark):
    m = StaticMap.create(spark, "long", "long", EMPTY, EMPTY).insert_async(frame(spark, rows(30, 12, 3)))
    s = m.snapshot()
    assert s.depth == 0 and contents(s) == contents(m)
    assert "Aggregate" not in s.to_df()._jdf.queryExecution().optimizedPlan().toString()


def test_batches_of_other_types_are_refused(spark):
    m = StaticMap.create(spark, "long", "long", EMPTY, EMPTY)
    for bad in ("ord long, key string, value long", "ord long, key long, value double", "ord long, key double, value long"):
        with pytest.raises(TypeError):
            m.insert(spark.createDataFrame([], bad))
    assert contents(m.insert_async(spark.createDataFrame([(0, 1, 2)], "ord long, key int, value int"))) == {1: 2}
    with pytest.raises(TypeError):
        StaticSet.create(spark, "int", EMPTY).insert(spark.createDataFrame([], "ord long, key long"))


def test_null_values_are_values(spark):
    m = StaticMap.create(spark, "long", "long", EMPTY, EMPTY).insert_async(frame(spark, [(0, 1, None, 0), (1, 1, 5, 0), (2, 2, 6, 0), (3, None, 7, 0)]))
    assert contents(m) == {1: None, 2: 6}
    assert contents(m.insert_async(frame(spark, [(0, 1, 9, 0)]))) == {1: None, 2: 6}
    assert contents(m.insert_or_assign_async(frame(spark, [(0, 2, 9, 0), (1, 2, None, 0)]))) == {1: None, 2: None}


def test_growth_follows_the_batches(spark):
    empty = DynamicMap.create(spark, "long", "long", EMPTY, EMPTY, 0)
    assert empty.reserve(1).total_capacity > 0  # an empty first segment grows
    out = empty.insert(frame(spark, [(0, 1, 2, 0)]))
    assert out.inserted == 1 and out.container.size() == 1 and out.container.segments == (2, 32_768)
    batch = spark.range(9_660).selectExpr("id AS ord", "id + 2 AS key", "id AS value")
    more = out.container.insert(batch).container
    assert more.segments == (2, 32_768, 65_536) and more.growth.filled == (0, 1, 9_660)
    again = more.insert(batch).container  # all there: rows of the batch still need room
    assert again.growth.filled == (0, 1, 9_660) and again.size() == 9_661
    assert again.clear().segments == again.segments and again.clear().size() == 0
    assert more.erase(batch.filter("key <= 101")).container.growth.size == 9_561
    assert more.erase_async(batch).growth.size == 9_661  # not counted until asked for
    assert empty.append_unique(batch).growth.filled == (0, 9_660)
    assert empty.insert_async(batch.union(batch)).growth.size == 19_320  # counts every row
    assert again.settled().pending == () and again.settled().growth == again.growth


def test_growing_map(spark):
    with pytest.raises(ValueError):
        DynamicMap.create(spark, "long", "long", EMPTY, EMPTY, erased_key=EMPTY)
    data = rows(50, 20, 9)
    m = DynamicMap.create(spark, "long", "long", EMPTY, EMPTY, 20_000)
    out = m.insert(frame(spark, data))
    again = out.container.insert(frame(spark, [(i, k, 0, 0) for i, k, _, _ in data]))
    assert again.inserted == 0 and contents(again.container) == contents(out.container)
    assert out.container.insert_or_assign(frame(spark, [(0, 10**9, 1, 0), (1, next(iter(contents(m.insert_async(frame(spark, data)))), 0), 5, 0)])).inserted == 1
    big = m.reserve(30_000)
    assert big.num_segments > 1 and big.total_capacity > m.total_capacity and m.num_segments == 1
    assert m.append_unique(frame(spark, [(0, 1, 2, 0)])).size() == 1


def test_custom_equality_and_erased_key(spark):
    tens = StaticMap.create(spark, "long", "long", EMPTY, EMPTY, canonical=lambda k: F.floor(k / 10))
    m = tens.insert_async(frame(spark, [(0, 11, 1, 0), (1, 19, 2, 0), (2, 25, 3, 0), (3, EMPTY, 4, 0)]))
    assert contents(m) == {1: 1, 2: 3}
    assert [r["found_value"] for r in m.find(frame(spark, [(0, 14, 0, 0), (1, 20, 0, 0), (2, 30, 0, 0)])).orderBy("ord").collect()] == [1, 3, EMPTY]
    assert spark.range(1).select(m.key_equal(F.lit(11), F.lit(18))).first()[0]
    assert m.erase(frame(spark, [(0, 29, 0, 0)])).deleted == 1
    marked = StaticMap.create(spark, "long", "long", EMPTY, EMPTY).with_erased_key(-2)
    assert marked.insert(frame(spark, [(0, -2, 1, 0), (1, 3, 1, 0)])).failed == 1
    with pytest.raises(ValueError):
        marked.with_erased_key(EMPTY)
