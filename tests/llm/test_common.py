"""Joins around hot keys, ranks across tasks."""

import random

from pyspark.sql import functions as F

from keyloom.llm.common import components, distributed_rank, spread_join


def test_spread_join_is_the_join(spark):
    r = random.Random(2)
    rows = [(i, "hot" if i % 3 == 0 else None if i % 50 == 7 else f"k{r.randrange(900)}") for i in range(5000)]
    left = spark.createDataFrame(rows, "id long, key string")
    counted = left.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("m")).filter("c > 1")
    got = spread_join(left, counted, ["key"], 5000)
    assert got.columns == ["key", "id", "m"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(counted.drop("c"), "key").collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2
    assert spread_join(left.limit(0), counted.limit(0), ["key"], 0).count() == 0


def test_ranks_of_a_hot_group(spark):
    rows = [("hot" if i % 3 else None if i % 5 else f"g{i % 7}", i * 7919 % 1000, i) for i in range(2000)]
    got = distributed_rank(spark.createDataFrame(rows, "g string, x long, id long").repartition(6), ["g"], ["x", "id"], "rank").collect()
    want = {}
    for g in {r[0] for r in rows}:
        for k, (_, x, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]), 1):
            want[i] = k
    assert {r["id"]: r["rank"] for r in got} == want


def test_components_of_a_star_and_a_path(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(60)] + [(9000, i) for i in range(8000, 8500)]
    random.Random(1).shuffle(edges)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == dict.fromkeys(range(3000), 0) | dict.fromkeys(range(5000, 5061), 5000) | dict.fromkeys([*range(8000, 8500), 9000], 8000)
