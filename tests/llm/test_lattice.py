import numpy as np
import pytest

from keyloom.llm import lattice
from keyloom.llm.common import components

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.98):
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links = {id(r): [] for r in ok}
    for i, a in enumerate(ok):
        for b in ok[i + 1 :]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links[id(a)].append(b)
                    links[id(b)].append(a)
    comp = {id(r): r[0] for r in ok}
    while True:
        new = {id(r): min([comp[id(r)], *(comp[id(x)] for x in links[id(r)])]) for r in ok}
        if new == comp:
            break
        comp = new
    return sorted((r[0], len(links.get(id(r), [])), comp.get(id(r), r[0])) for r in rows if r[0] is not None)


def vectors(n, dim, seed, spread):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((max(1, n // 5), dim))
    return [(i, [float(x) for x in centers[rng.integers(len(centers))] + spread * rng.standard_normal(dim)], int(rng.integers(3))) for i in range(n)]


def test_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(1)
    near = np.vstack([np.zeros(8), lattice.roots()])
    assert near.shape == (241, 8) and np.allclose((lattice.roots() ** 2).sum(axis=1), 2)
    x = rng.uniform(-3, 3, (500, 8))
    p = lattice.decode(x)
    assert (((2 * p) % 2 == 0).all(axis=1) | ((2 * p) % 2 == 1).all(axis=1)).all() and (p.sum(axis=1) % 2 == 0).all()
    d = ((x - p) ** 2).sum(axis=1)
    assert d.max() <= 1 + 1e-9  # the covering radius
    for q in near:
        assert (((x - p - q) ** 2).sum(axis=1) >= d - 1e-9).all()


@pytest.mark.parametrize(("dim", "codes"), [(16, None), (64, None), (64, 2), (64, 3)])
def test_same_links_as_all_pairs(spark, dim, codes):
    rows = vectors(400, dim, dim, 0.09)
    want = brute(rows)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in lattice.near_duplicates(spark.createDataFrame(rows, SCHEMA), codes=codes).collect())
    true, found = sum(x[1] for x in want), sum(x[1] for x in got)
    assert true > 200 and 0.98 * true <= found <= true
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))


def unit(rng, n, dim):
    x = rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def planted(n, dim, seed, cosine=0.98):
    """``n`` pairs at that very cosine."""
    rng = np.random.default_rng(seed)
    a, b = unit(rng, n, dim), rng.standard_normal((n, dim))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


@pytest.mark.parametrize("dim", [64, 384])
@pytest.mark.parametrize("codes", [1, 2, 3, 4, 5])
def test_recall_at_the_very_threshold(codes, dim):
    a, b = planted(2000, dim, codes)
    tables, zero = lattice.tables_for(codes), np.zeros(2000, np.int64)
    (own_a, probe_a), (own_b, probe_b) = (lattice.cells(x, zero, codes, tables) for x in (a, b))
    met = (own_a == own_b) | (probe_a == own_b[..., None]).any(axis=2) | (probe_b == own_a[..., None]).any(axis=2)
    recall = met.any(axis=1).mean()
    print(f"{codes} codes, {tables} tables, {dim} dimensions: recall {recall:.4f}")
    assert recall >= 0.98


def test_pairs_compared_do_not_grow_with_the_input():
    rng, per = np.random.default_rng(0), []
    for n in (1_000, 10_000, 100_000):
        codes = lattice.codes_for(n)
        own, probe = lattice.cells(unit(rng, n, 64), np.zeros(n, np.int64), codes, 1)
        homes, counts = np.unique(own, return_counts=True)
        spots, met = np.unique(probe, return_counts=True)
        crossed = np.isin(spots, homes)
        per.append(((counts * (counts - 1) / 2).sum() + (met[crossed] * counts[np.searchsorted(homes, spots[crossed])]).sum()) / n)
    assert max(per) < 4, per


def test_planted_pairs_are_linked(spark):
    a, b = planted(300, 64, 9, 0.9805)
    rows = [(i, [float(v) for v in x], 1) for i, x in enumerate(np.concatenate([a, b]))]
    got = {r["vec_id"]: r for r in lattice.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    linked = [i for i in range(300) if got[i + 300]["component_id"] == i and not got[i + 300]["kept"] and got[i]["n_links"] == got[i + 300]["n_links"] == 1]
    assert len(linked) >= 0.95 * 300


def test_large_cells_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 16)
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in np.ones(16) + 0.01 * rng.standard_normal(16)], 1) for i in range(90)]
    got = lattice.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["n_links"], r["component_id"], r["kept"]) for r in got} == {(89, 0, True), (89, 0, False)}


def test_rows_that_link_with_nothing(spark):
    v, nan, inf = [1.0, 2.0, 3.0], float("nan"), float("inf")
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 3.0], 1), (8, [nan, 1.0, 1.0], 1), (9, [inf, 1.0, 1.0], 1), (10, [], 1), (11, [2.0, 4.0, 6.0], 1), (12, [1.0, 2.0], 1), (None, v, 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS rep", "2 AS w", "'x' AS cell", "3 AS n_links", "4 AS key")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in lattice.near_duplicates(df).collect() if r["vec_id"] is not None)
    assert got == brute(rows)
    alone = [r for r in lattice.near_duplicates(df).collect() if r["vec_id"] is None]
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in alone] == [(0, None, True)]
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}
