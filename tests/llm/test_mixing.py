import math
from collections import defaultdict

from pyspark.sql import functions as F

from keyloom.llm import mixing
from tests.llm.conftest import SCHEMA


def targets(sizes, weights=(1, 2, 3), cap=3.0):
    """Shares by weight; what passes a cap is shared again until none does."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        share = left / sum(w[s] for s in free)
        over = {s for s in free if share * w[s] > cap * sizes[s]}
        if not over:
            return out | {s: share * w[s] for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def check(rows, most_off=1.0):
    size = defaultdict(int)
    for r in rows:
        size[r["source"]] += r["size"]
    want = targets(dict(size))
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        assert r["source_size"] == size[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] % max(1, r["size"]) == 0
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in size:
        assert abs(taken[s] - want[s]) <= 3 * largest[s] * most_off + 1


def test_targets_follow_weights_and_caps(spark):
    rows = [(i, "w " * (1 + i * 7 % 40), "en", f"s{i % 7}" if i % 11 else None, 1) for i in range(700)]
    rows += [(1000 + i, "w " * 30, "en", "hot", 1) for i in range(500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    check(found)
    assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    per = {r["doc_id"]: r["copies"] for r in found}
    applied = mixing.apply_mix(docs).groupBy("doc_id").count().collect()
    assert {r[0]: r[1] for r in applied} == {k: v for k, v in per.items() if v}


def test_a_capped_source_takes_each_document_three_times(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "small", 1), (2, "c", "en", "small", 1), (3, "w " * 500, "en", "tall", 1), (4, "w " * 500, "en", "tall", 1)], SCHEMA)
    found = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert found[1]["target"] == 9.0 and found[1]["copies"] == 3 and found[2]["copies"] == 3


def test_nasty_and_empty(nasty, none):
    found = mixing.mix(nasty).collect()
    assert len(found) == nasty.count()
    check(found)
    assert all(r["size"] == 0 and r["taken"] == 0 for r in found if r["doc_id"] in (4, 5, 6))
    assert mixing.apply_mix(nasty).columns == nasty.columns
    assert mixing.mix(none).count() == 0 and mixing.apply_mix(none).count() == 0


def test_applied_copies_are_the_planned_ones_with_repeated_and_null_ids(spark):
    rows = [(i // 2 if i % 3 else None, "w " * (1 + i % 9), "en", f"s{i % 4}", i) for i in range(600)]
    rows += [(7000, "a b c", "en", "s0", 1)] * 2 + [(7001, "d e f", "en", "s2", 1)] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    planned = defaultdict(int)
    for r in mixing.mix(docs).filter("copies > 0").collect():
        planned[r["doc_id"], r["source"], r["size"]] += r["copies"]
    applied = mixing.apply_mix(docs).select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").count().collect()
    assert {tuple(r)[:3]: r[3] for r in applied} == planned
