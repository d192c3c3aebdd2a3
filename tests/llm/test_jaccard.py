import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import jaccard
from tests.llm.conftest import SCHEMA, prose


def shingle_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    comp = {i: i for i, _ in rows if i is not None}
    links = [(a[0], b[0]) for (a, x), (b, y) in ((p, q) for i, p in enumerate(zip(rows, sets, strict=True)) for q in list(zip(rows, sets, strict=True))[i + 1 :]) if a[0] is not None and b[0] is not None and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    while True:
        new = dict(comp)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == comp:
            return sorted(((i, len(s), comp.get(i)) for (i, _), s in zip(rows, sets, strict=True)), key=str)
        comp = new


def edited(text, seed, n):
    r, words = random.Random(seed), text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"edit{r.randrange(10**6)}"
    return " ".join(words)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect()), key=str)


def family(seed, n, words, most):
    base = prose(seed, words)
    return [edited(base, 1000 * seed + i, i % (most + 1)) for i in range(n)]


@pytest.mark.parametrize("block", [1 << 20, 700])
def test_same_classes_as_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "ROWS", min(4096, block // 100))
    passage = prose(77, 60)
    texts = [t for s in range(6) for t in family(s, 14, 60 + 30 * s, 3 + s)]
    texts += [prose(200 + i, 150) + " " + passage for i in range(20)] + [passage] * 3 + [edited(passage, i, 2) for i in range(6)]
    texts += ["one two", "ONE two", "one", "a b c d e", "a b c d e f", "A B C D E"]
    rows = list(enumerate(texts))
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    assert got(df) == brute(rows)


def test_tree_prunes_nothing_that_links():
    r = np.random.default_rng(3)
    base = [np.unique(r.integers(0, 2**63, 120, dtype=np.uint64)) for _ in range(12)]
    sets = []
    for i in range(150):
        s = base[i % 12].copy()
        s[r.choice(len(s), int(r.integers(0, 30)), replace=False)] = r.integers(0, 2**63, dtype=np.uint64)
        sets.append(np.unique(s))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if jaccard.similar(a, sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = [find(i) for i in range(len(sets))]
    own = list(range(len(sets)))
    for a, b in jaccard.tree_links(sets, np.arange(len(sets))):
        x, y = want[a], want[b]
        assert x == y
        own = [min(own[a], own[b]) if o in (own[a], own[b]) else o for o in own]
    assert own == want


def test_traversal_alone_finds_every_pair():
    r = np.random.default_rng(5)
    base = np.unique(r.integers(0, 2**63, 90, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[r.random(len(base)) > 0.08], r.integers(0, 2**63, 5, dtype=np.uint64)])) for _ in range(60)]
    sizes = np.array([len(s) for s in sets])
    tree = jaccard.SignatureTree(np.array([jaccard.bitmap(s, 256) for s in sets]), sizes, np.arange(60))
    seen = {(int(i), int(j)) for a, b in tree.pairs() for i, j in zip(a, b, strict=True)}
    assert {(i, j) for i in range(60) for j in range(i + 1, 60) if jaccard.similar(sets[i], sets[j])} <= seen


def test_nasty_and_empty(nasty, none):
    rows = [(r["doc_id"], r["text"]) for r in nasty.collect()]
    assert got(nasty) == brute(rows)
    assert got(none) == []
    kept = jaccard.keep_one(nasty)
    assert kept.columns == nasty.columns
    assert_one_of_each(rows, [(r["doc_id"], r["text"]) for r in kept.collect()])
    assert jaccard.keep_one(none).collect() == [] and jaccard.keep_one(none).columns == nasty.columns


def assert_one_of_each(rows, kept):
    """Every row a document: one of each group stays, of its smallest doc_id (null last); rows without words stay."""
    numbered = [(k, t) for k, (_, t) in enumerate(rows)]
    groups = {}
    for k, _, c in brute(numbered):
        groups.setdefault(c, []).append(k)
    allowed = [{rows[k] for k in g if rows[k][0] == min((rows[j][0] for j in g), key=lambda i: (i is None, i or 0))} for g in groups.values()]
    left = list(kept)
    for choices in sorted(allowed, key=len):
        one = next(x for x in left if x in choices)
        left.remove(one)
    assert left == []


def test_repeated_rows_and_null_ids_leave_one(spark):
    base, other = prose(1, 90), prose(2, 90)
    rows = [(1, base), (1, base), (1, base), (None, base), (None, base), (2, edited(base, 1, 1)), (2, other), (7, other), (7, other), (None, prose(3, 40)), (None, ""), (None, ""), (9, None), (9, None), (5, prose(4, 40)), (5, prose(5, 40))]
    for part in (rows, [(i, t) for i, t in rows if i is not None], [(3, base), (4, base), (6, other)]):
        kept = jaccard.keep_one(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in part], SCHEMA).withColumn("component", F.lit("x")))
        assert_one_of_each(part, [(r["doc_id"], r["text"]) for r in kept.collect()])


def test_halved_bitmaps():
    s = np.unique(np.random.default_rng(1).integers(0, 2**63, 300, dtype=np.uint64))
    wide, half = jaccard.bitmap(s, 1024), jaccard.bitmap(s, 512)
    assert (wide[:8] | wide[8:] == half).all()
    assert [jaccard.width_of(n) for n in (1, 128, 129, 10**6)] == [256, 256, 512, 1 << 16]
