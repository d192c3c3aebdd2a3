import math
import random
import re

import duckdb

from keyloom.llm import quality
from tests.llm.conftest import SCHEMA, prose

SHORT = "tea sun map cup ink oak elm fig rye bay dew fog".split()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen, where = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            where |= {j for i in at for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(where)


def test_counts_of_nasty_texts(spark, nasty, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(nasty, labels).collect()
    texts = sorted(((r["doc_id"], *counts(r["text"])) for r in nasty.collect()), key=str)
    assert sorted((tuple(r)[:6] for r in got), key=str) == texts
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"])  # too few labels to certify a cutoff
    assert quality.judge(none, labels).count() == 0
    assert quality.judge(nasty, labels.limit(0)).count() == nasty.count()


def test_repeats_and_lines(spark):
    texts = ["a b c a b c", "a a a a", "x y z\nx y z\n\n\nx y z ", "a b c d a b c e", "# $ | <>", prose(1, 900) + " " + prose(1, 900)]
    got = {r["doc_id"]: tuple(r)[1:6] for r in quality.judge(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA), spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert got == {i: counts(t) for i, t in enumerate(texts)}


def test_path_tightens_each_rule_in_turn():
    assert len(quality.PATH) == sum(len(cuts) for _, _, cuts in quality.RULES.values())
    for rule, (_, way, cuts) in quality.RULES.items():
        own = [c for r, c in quality.PATH if r == rule]
        assert own == list(cuts) == sorted(cuts, reverse=way > 0)


def plain(docs, labels, alpha=quality.ALPHA, delta=quality.DELTA):
    """doc_id -> kept, by plain Python: every step of the path is tested with all the cutoffs before it."""
    good = {i for i, q in labels if q == 1}
    rate = {"symbols": lambda c: c[2] / max(c[1], 1), "long_words": lambda c: c[1] / max(c[0], 1), "short_words": lambda c: c[1] / max(c[0], 1), "dup_lines": lambda c: c[3] / max(c[5], 1), "repeats": lambda c: c[4] / max(c[0], 1)}

    def rejected(c, steps):
        return any((rate[r](c) - cut) * quality.RULES[r][1] > 0 for r, cut in quality.PATH[:steps])

    seen = {}
    for i, text, lang in docs:
        c = (*counts(text), len([x for x in text.split("\n") if WORD.search(x)]))
        seen[i] = (lang, c, c[0] < 50 or 100 * c[4] > 50 * c[0])
    strata = {seen[i][0] for i in good if not seen[i][2]}
    steps = {}
    for stratum in strata:
        own = [seen[i][1] for i in good if seen[i][0] == stratum and not seen[i][2]]
        n, last = len(own), -1
        for s in range(len(quality.PATH) + 1):
            k = sum(rejected(c, s) for c in own)
            if sum(math.comb(n, j) * alpha**j * (1 - alpha) ** (n - j) for j in range(k + 1)) > delta / len(strata):
                break
            last = s
        steps[stratum] = max(last, 0)
    return {i: not failed and not rejected(c, steps.get(lang, 0)) for i, (lang, c, failed) in seen.items()}


def test_cutoffs_are_certified_per_stratum_and_match_sql(spark):
    r = random.Random(8)
    rows = []
    for i in range(1500):
        junk = i % 9 == 0
        text = prose(i % 50, 60, SHORT) + " # $" * (20 if junk else 0)
        if not junk and i % 7 == 0:  # good documents with some symbols: the path stops before it rejects them
            text += " #" * r.randrange(1, 30)
        rows.append((i, text, "en" if i % 20 else "rare", "s", 1))
    labels = [(i, 0 if i % 9 == 0 else 1) for i in range(0, 1500, 2)]
    docs, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {x["doc_id"]: x for x in quality.judge(docs, lab).collect()}
    assert {i: x["kept"] for i, x in got.items()} == plain([x[:3] for x in rows], labels)
    own = {x["steps"] for i, x in got.items() if i % 20}
    assert len(own) == 1 and 0 < own.pop() < len(quality.PATH)
    assert any(x["kept"] != (not x["base_failed"]) for x in got.values())
    assert {x["steps"] for i, x in got.items() if i % 20 == 0} == {0}  # too few labels there for a cutoff
    c = duckdb.connect()
    c.register("documents", docs.toPandas())
    c.register("labels", lab.toPandas())
    want = c.execute(quality.judge_sql()).fetchall()
    assert sorted(want, key=str) == sorted((tuple(x) for x in got.values()), key=str)


def test_few_hundred_labels_certify(spark):
    rows = [(i, prose(i, 60, SHORT) + (" #" * 60 if i >= 200 else ""), "en", "s", 1) for i in range(240)]
    lab = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")
    got = quality.judge(spark.createDataFrame(rows, SCHEMA), lab).collect()
    assert all(x["steps"] == len(quality.PATH) and x["kept"] == (x["doc_id"] < 200) for x in got)


def test_repeats_of_millions_of_words_are_exact(spark):
    n = 3_000_000
    df = spark.range(2).selectExpr("id AS doc_id", f"concat(array_join(transform(sequence(1, {n}), x -> cast(x AS string)), ' '), if(id = 1, ' 7 8 9', '')) AS text", "'en' AS lang")
    got = {x["doc_id"]: (x["n_words"], x["n_repeat_words"]) for x in quality.judge(df, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert got == {0: (n, 0), 1: (n + 3, 6)}


def test_tail(spark):
    from pyspark.sql import functions as F

    for n, k, p in ((10, 3, 0.2), (500, 0, 0.01), (4000, 60, 0.02)):
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        got = spark.range(1).select(quality._tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).first()[0]
        assert math.isclose(got, want, rel_tol=1e-6)


def test_edges_of_f_and_form_feed(spark):
    texts = ["off foo off", "fff fff fff ff", "f", "\x0cone two\x0c", "a\nf\nff\nf\nf", " \x0b\x0c\r\n\x0c\n", "ein Ruf auf\n\x0c\nauf", "\x0b\x0cf\x0c"]
    got = {r["doc_id"]: tuple(r)[1:6] for r in quality.judge(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA), spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert got == {i: counts(t) for i, t in enumerate(texts)}
