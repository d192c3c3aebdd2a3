"""Multisets and multimaps: worked examples, models and errors."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from keyloom.operators import bag as bag_module
from keyloom.operators.bag import Multimap, Multiset

LOW, TOP = -(2**31), 2**31 - 1


def batch(spark, keys, stencil=None):
    return spark.createDataFrame([(i, k, (stencil or [0] * len(keys))[i]) for i, k in enumerate(keys)], "ord long, key int, stencil int")


def pairs(spark, data, stencil=None):
    return spark.createDataFrame([(i, k, v, (stencil or [0] * len(data))[i]) for i, (k, v) in enumerate(data)], "ord long, key int, value int, stencil int")


def test_multiset_keeps_the_earliest_and_their_order(spark):
    out = Multiset.create(spark, "int", -1, 5).insert(batch(spark, [7, 2, 7, TOP, -4, 2, 9]))
    assert out.failed == 2
    bag = out.container
    assert [r["key"] for r in bag.retrieve_all().orderBy("pos").collect()] == [7, 2, 7, TOP, -4]
    q = batch(spark, [7, 8, 7, -4])
    assert bag.count(q).first()["total"] == 5
    assert [r["match"] for r in bag.retrieve(q).orderBy("pos").collect()] == [7, 7, 7, 7, -4]
    with pytest.raises(OverflowError):
        bag.retrieve(q, limit=4)


def test_multiset_predicate_and_multiplicities(spark):
    keys, stencil = [3, -1, 3, 8, 9, -2], [3, 4, 5, 1, 0, 6]
    least = 3
    out = Multiset.create(spark, "int", -1).insert(batch(spark, keys, stencil), lambda s: s >= least)
    assert (out.failed, out.container.size()) == (1, 3)
    q = batch(spark, keys)
    assert [r["multiplicity"] for r in out.container.count_each(q).orderBy("ord").collect()] == [2, 0, 2, 0, 0, 1]
    assert [r["multiplicity"] for r in out.container.count_each(q, outer=True).orderBy("ord").collect()] == [2, 1, 2, 1, 1, 1]
    assert [r["found"] for r in out.container.contains(q).orderBy("ord").collect()] == [True, False, True, False, False, True]
    assert [r["found"] for r in out.container.find(q).orderBy("ord").collect()] == [3, -1, 3, -1, -1, -2]


def test_counts_pass_32_bits_without_expanding(spark):
    n = 65_536
    copies = spark.range(n).selectExpr("id AS ord", "5 AS key", "0 AS stencil")
    bag = Multiset.create(spark, "int", -1).insert(copies).container
    assert bag.count(copies).first()["total"] == n * n


def test_inserts_after_inserts_go_behind(spark):
    bag = Multiset.create(spark, "int", -1).insert(batch(spark, [3, 1])).container.insert(batch(spark, [2, 3])).container
    assert [r["key"] for r in bag.retrieve_all().orderBy("pos").collect()] == [3, 1, 2, 3]


def test_multimap_worked_example(spark):
    mm = Multimap.create(spark, "int", "int", LOW, LOW, 7).insert(pairs(spark, [(3, 9), (-7, 4), (3, -8), (3, -8), (-7, -3), (9, 7), (3, 2)])).container
    q = batch(spark, [3, -7, 3, 42, LOW])
    assert [r["found_value"] for r in mm.find(q).orderBy("ord").collect()] == [-8, -3, -8, LOW, LOW]
    assert mm.count(q).first()["total"] == 10
    got = mm.retrieve(q).orderBy("pos").collect()
    assert [r["pos"] for r in got] == list(range(10))
    assert [r["probe"] for r in got] == [3] * 4 + [-7] * 2 + [3] * 4
    assert [r["value"] for r in got] == [-8, -8, 2, 9, -3, 4, -8, -8, 2, 9]
    assert Counter((r["key"], r["value"]) for r in mm.retrieve_all().collect())[(3, -8)] == 2


def test_multimap_reserved_values_stop_the_whole_insert(spark):
    mm = Multimap.create(spark, "int", "int", LOW, LOW)
    data = pairs(spark, [(1, 4), (2, LOW), (LOW, 7)], [1, 0, 0])
    with pytest.raises(ValueError):
        mm.insert(data)
    assert mm.size() == 0
    assert mm.insert(data, lambda s: s == 1).container.size() == 1
    with pytest.raises(Exception, match="reserved"):
        mm.insert(data, check=False).container.retrieve_all().collect()


def test_selected_prefix_in_order(spark):
    n, cap = 2049, 513
    data = spark.range(n).selectExpr("id AS ord", "cast(id + 1 AS int) AS key", "cast(id + 7 AS int) AS value", "cast(id % 3 AS int) AS stencil")
    out = Multimap.create(spark, "int", "int", LOW, LOW, cap).insert(data, lambda s: s != 0)
    chosen = [i for i in range(n) if i % 3][:cap]
    assert sorted((r["key"], r["value"]) for r in out.container.retrieve_all().collect()) == [(i + 1, i + 7) for i in chosen]
    assert out.failed == sum(1 for i in range(n) if i % 3) - cap


def test_capacity_must_be_positive(spark):
    for make in (lambda: Multiset.create(spark, "int", -1, 0), lambda: Multimap.create(spark, "int", "int", LOW, LOW, 0)):
        with pytest.raises(ValueError):
            make()


def test_counts_under_a_given_equality(spark):
    bag = Multiset.create(spark, "long", -1).insert(spark.createDataFrame([(0, 11), (1, 19), (2, 25), (3, 11)], "ord long, key long")).container
    q = spark.createDataFrame([(0, 14), (1, 20), (2, 30), (3, 14)], "ord long, key long")
    tens = lambda k: F.floor(k / 10)
    assert [tuple(r) for r in bag.count_each(q, equal=tens).orderBy("ord").collect()] == [(0, 14, 3), (1, 20, 1), (2, 30, 0), (3, 14, 3)]
    assert [r[2] for r in bag.count_each(q, outer=True, equal=tens).orderBy("ord").collect()] == [3, 1, 1, 3]


def test_expansion_in_chunks_and_ranks_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(bag_module, "CHUNK", 4)
    keys = [(i, i % 3) for i in range(40)]
    bag = Multiset.create(spark, "long", -1).insert(spark.createDataFrame(keys, "ord long, key long")).container
    got = sorted(tuple(r) for r in bag.retrieve(spark.createDataFrame([(0, 2), (1, 0), (2, 9)], "ord long, key long")).collect())
    assert got == [(p, k, k) for p, k in enumerate([2] * 13 + [0] * 14)]
    values = [(i, i % 2, (i * 7919) % 300_000 - 100_000) for i in range(200)] + [(200, 1, 5)] * 9
    for kind in ("long", "double"):
        mm = Multimap.create(spark, "long", kind, -1, -1).insert(spark.createDataFrame([(i, k, float(v) if kind == "double" else v) for i, k, v in values], f"ord long, key long, value {kind}")).container
        rows = sorted(tuple(r) for r in mm.retrieve(spark.createDataFrame([(0, 1), (1, 0)], "ord long, key long")).collect())
        want = [(k, v) for q in (1, 0) for k, v in sorted((k, v) for _, k, v in values if k == q)]
        assert rows == [(p, k, v) for p, (k, v) in enumerate(want)]


def test_batches_of_other_types_are_refused(spark):
    with pytest.raises(TypeError):
        Multiset.create(spark, "int", -1).insert(spark.createDataFrame([], "ord long, key long"))
    with pytest.raises(TypeError):
        Multimap.create(spark, "long", "long", -1, -1).insert(spark.createDataFrame([], "ord long, key long, value string"))


def test_chained_inserts_plan_boundedly(spark):
    frames = [spark.createDataFrame([(i, (3 * b + i) % 7, 100 * b + i) for i in range(4)], "ord long, key long, value long") for b in range(9)]
    bag, rows = Multiset.create(spark, "long", -1), Multimap.create(spark, "long", "long", -1, -1, 30)
    for f in frames:
        bag, rows = bag.insert(f).container, rows.insert(f).container
        assert bag.depth <= 3 and rows.depth <= 3
    want = [(3 * b + i) % 7 for b in range(9) for i in range(4)]
    assert [r["key"] for r in bag.retrieve_all().orderBy("pos").collect()] == want
    assert sorted(tuple(r) for r in rows.retrieve_all().collect()) == sorted([((3 * b + i) % 7, 100 * b + i) for b in range(9) for i in range(4)][:30])
    assert bag.clear().size() == rows.clear().size() == 0
